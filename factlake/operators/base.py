"""What all managers of a result set share: its metadata, and transactions that report and audit."""

from __future__ import annotations

import json
import logging
import threading
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime, timedelta
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlake.functions import links
from factlake.functions.filters import quoted
from factlake.functions.types import DATASET, METADATA, TEXT_FIELDS, aggregation, default_label, refuse_composites, spark_type, sql_type, wider
from factlake.plans.report import OperationReport
from factlake.sources.lake import Lake, Transaction, schema_parts
from factlake.sources.log import Table

log = logging.getLogger("factlake")
FACT, META, DATASET_META = "fact_table", "metadata", "dataset_metadata"


def now() -> str:
    return datetime.now(UTC).replace(tzinfo=None).isoformat(timespec="microseconds")


class ResultSet:
    """The three tables of a schema."""

    def __init__(self, lake: Lake, schema: str = "main", categorical_threshold: int | None = 50, audit_level: Any = "BASIC", auto_cleanup: bool = True, compaction_window: timedelta | None = None):
        if compaction_window is not None and compaction_window <= timedelta(0):
            raise ValueError("compaction_window must be positive")
        schema_parts(schema)
        self.lake, self.schema, self.spark = lake, schema, lake.spark
        self.categorical_threshold, self.audit_level, self.auto_cleanup, self.compaction_window = categorical_threshold, audit_level, auto_cleanup, compaction_window
        self.last_report: OperationReport | None = None
        self._report: OperationReport | None = None
        self._lock = threading.RLock()

    # --- reads -----------------------------------------------------------------------------------------------------------

    def state(self, table: str = FACT) -> Table:
        return self.lake.table_state(self.schema, table)

    def fact(self) -> DataFrame:
        return self.lake.table(self.schema, FACT)

    def metadata(self) -> list[dict[str, Any]]:
        """The metadata rows; none if there is no such table."""
        if not self.lake.exists(self.schema, META):
            return []
        return [json.loads(x["row"]) for x in self.state(META).inline]

    def metadata_frame(self) -> DataFrame:
        return self.spark.createDataFrame([tuple(m.get(f.name) for f in METADATA) for m in self.metadata()], METADATA)

    def dataset(self) -> dict[str, Any]:
        rows = self.state(DATASET_META).inline if self.lake.exists(self.schema, DATASET_META) else []
        return json.loads(rows[0]["row"]) if rows else {}

    def columns(self) -> list[str]:
        return [c.name for c in self.state().columns]

    def column_exists(self, column: str, table: str = FACT) -> bool:
        return self.lake.exists(self.schema, table) and self.state(table).column(column) is not None

    def _field(self, column: str, name: str, default: Any = None) -> Any:
        return next((m.get(name) for m in self.metadata() if m["name"] == column), default)

    def is_categorical(self, column: str) -> bool:
        return bool(self._field(column, "is_categorical", False))

    def is_primary_key(self, column: str) -> bool:
        return bool(self._field(column, "is_primary_key", False))

    def categorical_columns(self) -> list[str]:
        return [m["name"] for m in self.metadata() if m["is_categorical"]]

    def primary_keys(self) -> list[str]:
        """In declared order."""
        flagged = {m["name"] for m in self.metadata() if m["is_primary_key"]}
        declared = [k for k in self.state().keys if k in flagged]
        return declared + sorted(flagged - set(declared))

    def parents(self) -> dict[str, str | None]:
        return {m["name"]: m.get("parent_name") for m in self.metadata()}

    def labels(self) -> dict[str, str]:
        return {m["name"]: m["label_for"] for m in self.metadata() if m.get("label_for")}

    def children(self, column: str) -> list[str]:
        return sorted(c for c, p in self.parents().items() if p == column)

    def label_columns(self, code: str) -> list[str]:
        return sorted(c for c, x in self.labels().items() if x == code)

    def column_hierarchies(self) -> list[list[str]]:
        return links.chains(self.parents())

    def value_label_columns(self) -> dict[str, list[str]]:
        return {code: self.label_columns(code) for code in sorted(set(self.labels().values()))}

    def cluster_by(self) -> list[str] | None:
        found = self.dataset().get("cluster_by")
        return json.loads(found) if found else None

    def described(self) -> list[tuple[str, str, str]]:
        """(table, column, type) of the three tables."""
        return [(n, c.name, c.type) for n in (DATASET_META, FACT, META) if self.lake.exists(self.schema, n) for c in self.state(n).columns]

    def key_combinations(self, columns: list[str] | None = None) -> DataFrame:
        """Distinct values of the primary key, or of some of its columns, lazily."""
        wanted = columns or self.primary_keys()
        unknown = [c for c in wanted if not self.column_exists(c)]
        if not wanted or unknown:
            raise ValueError(f"unknown columns {unknown}" if unknown else "there is no primary key")
        return self.fact().select(*map(quoted, wanted)).distinct()

    def rollup(self, by: list[str], columns: list[str] | None = None) -> DataFrame:
        """The fact table grouped by some columns, the others by their declared default aggregation."""
        made = {"SUM": F.sum, "AVG": F.avg, "MAX": F.max, "MIN": F.min, "COUNT": F.count, "MEDIAN": F.median, "MODE": F.mode}
        wanted = {m["name"]: m["default_aggregation"] for m in self.metadata() if m.get("default_aggregation") and m["name"] not in by}
        chosen = {c: a for c, a in wanted.items() if columns is None or c in columns}
        if not chosen:
            raise ValueError("no column has a default aggregation")
        return self.fact().groupBy(*map(quoted, by)).agg(*[made[a](F.col(quoted(c))).alias(c) for c, a in chosen.items()])

    # --- metadata writes -------------------------------------------------------------------------------------------------

    def put_metadata(self, t: Transaction, rows: list[dict[str, Any]]) -> None:
        t.replace_rows(self.schema, META, sorted(({f.name: r.get(f.name) for f in METADATA} for r in rows), key=lambda r: r["label"]))

    def put_dataset(self, t: Transaction, **fields: Any) -> None:
        row = {f.name: None for f in DATASET} | self.dataset() | fields
        t.replace_rows(self.schema, DATASET_META, [row])

    def touch(self, t: Transaction) -> None:
        if self.lake.exists(self.schema, DATASET_META):
            self.put_dataset(t, updated_at=now())

    def _change(self, t: Transaction, column: str, **fields: Any) -> None:
        self.put_metadata(t, [m | fields if m["name"] == column else m for m in self.metadata()])

    def add_metadata(self, t: Transaction, column: str, df: DataFrame, label: str | None = None, others: int = 0) -> None:
        """A new column's row, or only the type of a known one: categorical is inferred once."""
        kind = sql_type(df.schema[column].dataType)
        if self._field(column, "name"):
            self._change(t, column, sql_type=kind, **({"label": label} if label else {}))
            return
        few = False
        if isinstance(df.schema[column].dataType, T.StringType) and self.categorical_threshold is not None:
            few = df.agg(F.count_distinct(F.col(quoted(column)))).first()[0] <= self.categorical_threshold
        row = {"name": column, "label": label or default_label(column), "sql_type": kind, "is_categorical": few, "is_primary_key": False}
        self.put_metadata(t, [*self.metadata(), row])

    def update_column_metadata(self, column: str, **fields: Any) -> None:
        """Change a column's label, flags, links or texts, in one transaction; everything is checked first."""
        rows = {m["name"]: m for m in self.metadata()}
        if column not in rows:
            raise ValueError(f"unknown column {column}")
        unknown = set(fields) - {"label", "is_categorical", *TEXT_FIELDS}
        if unknown:
            raise ValueError(f"fields that can't be set: {sorted(unknown)}")
        if "label" in fields and not fields["label"]:
            raise ValueError("a label can't be empty")
        if "is_categorical" in fields and not isinstance(fields["is_categorical"], bool):
            raise ValueError("is_categorical is True or False")
        if fields.get("default_aggregation") is not None:
            fields["default_aggregation"] = aggregation(fields["default_aggregation"])
        new = {n: dict(m) for n, m in rows.items()}
        new[column] |= fields
        parents = {n: m.get("parent_name") for n, m in new.items()}
        labels = {n: m["label_for"] for n, m in new.items() if m.get("label_for")}
        if fields.get("parent_name"):
            if fields["parent_name"] not in rows:
                raise ValueError(f"unknown parent column {fields['parent_name']}")
            if new[column].get("label_for"):
                raise ValueError(f"{column} is a label column: it can't have a parent")
        links.check_forest(parents)
        links.check_labels(labels, {n: m["sql_type"] for n, m in new.items()}, self.primary_keys(), parents)
        if fields.get("label_for"):
            links.check_dependency(self.fact(), fields["label_for"], column)
        members = {n for n, p in parents.items() if p} | {p for p in parents.values() if p}
        if fields.get("is_categorical") is False and column in members:
            raise ValueError(f"{column} is part of a hierarchy and so categorical")
        for name in members:
            if not new[name]["is_categorical"]:
                log.warning("%s is made categorical: it is part of a hierarchy", name)
                new[name]["is_categorical"] = True
        with self.lake.transaction(message=f"metadata of {column}") as t:
            self.put_metadata(t, list(new.values()))

    def delete_column_metadata(self, column: str) -> None:
        with self.lake.transaction(message=f"metadata of {column}") as t:
            self.put_metadata(t, [m for m in self.metadata() if m["name"] != column])

    def update_cluster_by(self, columns: list[str] | None) -> None:
        """Change the declared key and the sort key of later writes together; no data is rewritten."""
        if not columns:
            raise ValueError("cluster_by needs columns")
        unknown = [c for c in columns if not self.column_exists(c)]
        if unknown:
            raise ValueError(f"unknown cluster_by columns {unknown}")
        with self.lake.transaction(message="cluster_by") as t:
            self.set_cluster_by(t, columns)
            self.touch(t)

    def set_cluster_by(self, t: Transaction, columns: list[str] | None) -> None:
        self.state().sort_key = list(columns or [])
        self.put_dataset(t, cluster_by=json.dumps(columns) if columns else None)

    # --- columns ---------------------------------------------------------------------------------------------------------

    def drop_with_references(self, t: Transaction, column: str, cascade: bool = False) -> None:
        """Take a column out of links (if asked), the sort key, the fact table and the metadata. No file is rewritten."""
        if cascade:
            for name, fields in (("parent_name", self.children(column)), ("label_for", self.label_columns(column))):
                for other in fields:
                    log.warning("%s of %s is cleared: %s is dropped", name, other, column)
                    self._change(t, other, **{name: None})
        key = self.cluster_by()
        if key and column in key:
            self.set_cluster_by(t, [c for c in key if c != column] or None)
        t.drop_column(self.state(), column)
        self.put_metadata(t, [m for m in self.metadata() if m["name"] != column])

    def null_only_columns(self) -> list[str] | None:
        """Columns without a value, by one scan; None for an empty table."""
        names = self.columns()
        row = self.fact().agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.col(quoted(c))).alias(f"c{i}") for i, c in enumerate(names)]).first()
        return None if not row["rows"] else [c for i, c in enumerate(names) if not row[f"c{i}"]]

    def cleanup_null_only_columns(self) -> list[str]:
        """Drop columns without values: never keys, and a parent or code only after what refers to it."""
        found = self.null_only_columns()
        waiting = [c for c in found or [] if not self.is_primary_key(c)]
        dropped: list[str] = []
        if not waiting:
            return dropped
        with self.lake.transaction(message="drop empty columns") as t:
            while ready := [c for c in waiting if not self.children(c) and not self.label_columns(c)]:
                for column in ready:
                    self.drop_with_references(t, column)
                    dropped.append(column)
                waiting = [c for c in waiting if c not in ready]
            for column in waiting:
                log.warning("%s is empty, but kept: other columns refer to it", column)
            self.touch(t)
        return dropped

    def resolve_types(self, t: Transaction, batch: DataFrame, report: OperationReport) -> None:
        """Widen fact columns that the batch's types exceed. An all-null batch column widens nothing."""
        own = self.state()
        wanted = []
        for column in batch.columns:
            stored = own.column(column)
            if stored is None:
                continue
            was, new = sql_type(T._parse_datatype_string(stored.type)), sql_type(batch.schema[column].dataType)
            if (to := wider(was, new)) != was:
                wanted.append((stored, was, to))
        if not wanted:
            return
        row = batch.agg(*[F.count(F.col(quoted(c.name))).alias(f"c{i}") for i, (c, _, _) in enumerate(wanted)]).first()
        for i, (stored, was, to) in enumerate(wanted):
            if row[f"c{i}"]:
                stored.type = spark_type(to)
                self._change(t, stored.name, sql_type=to)
                report.changes.append(f"sql_type({stored.name}): {was} -> {to}")

    # --- transactions ----------------------------------------------------------------------------------------------------

    @contextmanager
    def transaction(self, operation: str, run_id: str | None = None, message: str | None = None, info: dict | None = None) -> Iterator[tuple[Transaction, OperationReport]]:
        """One snapshot and one report; a nested call joins both. On an error nothing is published and the partial report stays."""
        with self._lock:
            if self._report is not None:
                with self.lake.transaction() as t:
                    yield t, self._report
                return
            known = self.state() if self.lake.exists(self.schema, FACT) else None
            report = OperationReport(operation, f"{self.schema}.{FACT}", run_id).before(self.lake, known)
            self._report = self.last_report = report
            try:
                with self.lake.transaction(run_id, message or operation, info) as t:
                    yield t, report
                report.success = True
            finally:
                self._report = None
                report.after(self.lake, self.state() if self.lake.exists(self.schema, FACT) else None)

    def audit_within(self, report: OperationReport) -> None:
        """Audit the staged state: a critical issue is a RuntimeError, a high one a warning of the report."""
        from factlake.operators.audit import Auditor, Severity

        if self.audit_level is None:
            return
        found = Auditor(self.lake, self.schema).validate_database(self.audit_level)
        critical = found.by_severity(Severity.CRITICAL)
        if critical:
            raise RuntimeError("; ".join(i.message for i in critical))
        report.warnings += [i.message for i in found.by_severity(Severity.HIGH)]

    def compact_after(self, report: OperationReport, threshold: float = 0.1) -> None:
        from factlake.operators.maintenance import Maintenance

        newer = datetime.now(UTC).replace(tzinfo=None) - self.compaction_window if self.compaction_window else None
        Maintenance(self.lake).compact(FACT, self.schema, delete_threshold=threshold, newer_than=newer, report=report)
        report.after(self.lake, self.state())


def as_frame(lake: Lake, data: Any) -> DataFrame:
    """A Spark, pandas or Arrow frame as a Spark frame without composite columns. An instant becomes the time of day that it is in UTC, whatever the session's zone."""
    df = data if isinstance(data, DataFrame) else lake.spark.createDataFrame(data)
    refuse_composites(df.schema)
    for f in df.schema:
        if isinstance(f.dataType, T.TimestampType):
            utc = F.to_utc_timestamp(F.col(quoted(f.name)), F.current_timezone())
            df = df.withColumn(f.name, utc.cast("timestamp_ntz"))
        elif isinstance(f.dataType, T.NullType):
            df = df.withColumn(f.name, F.col(quoted(f.name)).cast("string"))
    return df
