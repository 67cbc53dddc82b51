"""Deleting rows and columns of a result set."""

from __future__ import annotations

import logging

from factlake.functions.filters import Filters, delete_filter
from factlake.operators.base import ResultSet
from factlake.plans.report import OperationReport
from factlake.sources.lake import FILE, POSITION, ROW

log = logging.getLogger("factlake")


class Deleter(ResultSet):
    def delete_rows(
        self, filters: Filters, perform_cleanup: bool | None = None, compact_after_update: bool = False, run_id: str | None = None, commit_message: str | None = None, commit_info: dict | None = None
    ) -> OperationReport:
        """Delete the rows that match, then (in a snapshot of its own) columns that are left without values. No match, no snapshot."""
        where = delete_filter(filters)
        with self.transaction("delete_rows", run_id, commit_message, commit_info) as (t, report):
            own = self.state()
            if isinstance(filters, str) and filters.strip().upper() == "TRUE":
                report.rows_deleted = own.rows
                own.files, own.deletes, own.inline = {}, [], []
            else:
                # Only files whose ranges can match are searched.
                near = None if isinstance(filters, str) else self.lake.files_for(own, list(filters))
                gone = self.lake.scan(own, internal=True, files=near).filter(where).select(ROW, FILE, POSITION).persist()
                try:
                    report.rows_deleted = t.delete_positions(own, gone)
                finally:
                    gone.unpersist()
            if report.rows_deleted:
                self.touch(t)
                self.audit_within(report)
        if report.rows_deleted and (self.auto_cleanup if perform_cleanup is None else perform_cleanup):
            try:
                report.columns_dropped += self.cleanup_null_only_columns()
            except Exception as error:
                log.warning("cleanup failed: %s", error)
                report.warnings.append(f"the rows are deleted, but the cleanup failed: {error}")
            report.after(self.lake, self.state())
        if compact_after_update:
            self.compact_after(report)
        return report

    def delete_columns(
        self,
        columns: list[str],
        validate_dependencies: bool = True,
        cascade: bool = False,
        compact_after_update: bool = False,
        run_id: str | None = None,
        commit_message: str | None = None,
        commit_info: dict | None = None,
    ) -> OperationReport:
        """Drop columns, all or none; no file is rewritten."""
        wanted = list(dict.fromkeys(columns or []))
        if not wanted:
            raise ValueError("there are no columns to delete")
        if unknown := [c for c in wanted if not self.column_exists(c)]:
            raise ValueError(f"unknown columns {unknown}")
        if keys := [c for c in wanted if self.is_primary_key(c)]:
            raise ValueError(f"primary key columns can't be deleted: {keys}")
        with self.transaction("delete_columns", run_id, commit_message, commit_info) as (t, report):
            if validate_dependencies:
                self._check_dependencies(wanted, cascade, report)
            for column in wanted:
                self.drop_with_references(t, column, cascade or not validate_dependencies)
                report.columns_dropped.append(column)
            self.touch(t)
            self.audit_within(report)
        if compact_after_update:
            self.compact_after(report)
        return report

    def _check_dependencies(self, wanted: list[str], cascade: bool, report: OperationReport) -> None:
        """All refusals in one ValueError; references from columns that go as well don't count."""
        refused = []
        for column in wanted:
            used = [c for c in (*self.children(column), *self.label_columns(column)) if c not in wanted]
            if used and not cascade:
                refused.append(f"{column} is referred to by {used}")
            elif used:
                report.warnings.append(f"references to {column} are cleared: {used}")
            if self.is_categorical(column):
                report.warnings.append(f"{column} is categorical")
        if refused:
            raise ValueError("; ".join(refused) + "; cascade clears the references")
