"""Audits of a result set. BASIC reads only the log and the metadata; COMPREHENSIVE scans the fact table as well."""

from __future__ import annotations

import json
import logging
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from enum import Enum
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from factlake.functions import links
from factlake.functions.duplicates import null_profile, repeated_keys
from factlake.functions.types import METADATA, compatible, sql_type
from factlake.operators.base import DATASET_META, FACT, META, ResultSet

log = logging.getLogger("factlake")


class Level(Enum):
    BASIC = "BASIC"
    COMPREHENSIVE = "COMPREHENSIVE"


class Kind(Enum):
    STRUCTURE = "structure"
    METADATA = "metadata"
    TYPES = "types"
    LINKS = "links"
    KEYS = "keys"
    DATA = "data"


class Severity(Enum):
    CRITICAL = "critical"
    HIGH = "high"
    MEDIUM = "medium"
    LOW = "low"
    INFO = "info"


@dataclass
class Issue:
    kind: Kind
    severity: Severity
    message: str
    table: str | None = None
    column: str | None = None
    details: dict[str, Any] = field(default_factory=dict)


@dataclass
class ValidationReport:
    schema: str
    level: Level
    issues: list[Issue] = field(default_factory=list)
    checks: int = 0
    started: datetime = field(default_factory=lambda: datetime.now(UTC))
    seconds: float | None = None
    recommendations: list[str] = field(default_factory=list)

    def add(self, *args: Any, **fields: Any) -> None:
        self.issues.append(Issue(*args, **fields))

    def by_severity(self, severity: Severity) -> list[Issue]:
        return [i for i in self.issues if i.severity is severity]

    def by_kind(self, kind: Kind) -> list[Issue]:
        return [i for i in self.issues if i.kind is kind]

    def critical_count(self) -> int:
        return len(self.by_severity(Severity.CRITICAL))

    def finalize(self) -> ValidationReport:
        self.seconds = (datetime.now(UTC) - self.started).total_seconds()
        advice = {
            Kind.STRUCTURE: "build the missing tables again, or restore a snapshot",
            Kind.METADATA: "bring the metadata in line with the fact table",
            Kind.TYPES: "align the declared types with the stored ones",
            Kind.LINKS: "repair parent_name and label_for by update_column_metadata or update_value_labels",
            Kind.KEYS: "remove repeated keys",
            Kind.DATA: "look at empty and sparse columns",
        }
        self.recommendations = [advice[k] for k in Kind if self.by_kind(k)]
        return self

    def to_df(self, spark) -> DataFrame:
        rows = [(i.kind.value, i.severity.value, i.table, i.column, i.message) for i in self.issues]
        return spark.createDataFrame(rows, "kind string, severity string, table string, column string, message string")


class Auditor(ResultSet):
    def validate_database(self, level: Level | str = Level.BASIC) -> ValidationReport:
        """All checks of a level. A check that fails to run is a HIGH issue, and the others still run."""
        level = Level(level) if isinstance(level, str) else level
        report = ValidationReport(self.schema, level)
        try:
            present = {n for n in (FACT, META, DATASET_META) if self.lake.exists(self.schema, n)}
            rows = self.metadata()
        except Exception as error:
            report.add(Kind.STRUCTURE, Severity.CRITICAL, f"the state can't be read: {error}")
            return report.finalize()
        checks: list[Callable] = [self._tables, self._metadata, self._dataset, self._columns, self._types, self._links]
        if level is Level.COMPREHENSIVE:
            checks += [self._keys, self._dependencies, self._quality]
        for check in checks:
            report.checks += 1
            try:
                check(report, present, rows)
            except Exception as error:
                report.add(Kind.STRUCTURE, Severity.HIGH, f"{check.__name__[1:]} couldn't be checked: {error}")
        return report.finalize()

    def _tables(self, report: ValidationReport, present: set[str], rows: list[dict]) -> None:
        for name in (FACT, META, DATASET_META):
            if name not in present:
                report.add(Kind.STRUCTURE, Severity.CRITICAL if name == META else Severity.HIGH, f"{name} is missing", name)

    def _metadata(self, report: ValidationReport, present: set[str], rows: list[dict]) -> None:
        if META not in present:
            return
        if not rows:
            report.add(Kind.METADATA, Severity.HIGH, "the metadata has no rows", META)
        if missing := [f.name for f in METADATA if self.state(META).column(f.name) is None]:
            report.add(Kind.METADATA, Severity.HIGH, f"the metadata lacks columns {missing}", META)
        for name in ("name", "label", "sql_type"):
            if n := sum(r.get(name) is None for r in rows):
                report.add(Kind.METADATA, Severity.MEDIUM, f"{n} metadata rows have no {name}", META, name)
        if twice := sorted(n for n, c in Counter(r.get("name") for r in rows).items() if c > 1 and n):
            report.add(Kind.METADATA, Severity.HIGH, f"the metadata names columns twice: {twice}", META)

    def _dataset(self, report: ValidationReport, present: set[str], rows: list[dict]) -> None:
        if DATASET_META in present and (n := self.state(DATASET_META).rows) != 1:
            report.add(Kind.METADATA, Severity.MEDIUM, f"dataset_metadata has {n} rows rather than one", DATASET_META)

    def _columns(self, report: ValidationReport, present: set[str], rows: list[dict]) -> None:
        if not {FACT, META} <= present:
            return
        fact, named = set(self.columns()), {r["name"] for r in rows if r.get("name")}
        if extra := sorted(fact - named):
            report.add(Kind.METADATA, Severity.HIGH, f"columns without metadata: {extra}", FACT)
        if extra := sorted(named - fact):
            report.add(Kind.METADATA, Severity.HIGH, f"metadata without a column: {extra}", META)

    def _types(self, report: ValidationReport, present: set[str], rows: list[dict]) -> None:
        if FACT not in present:
            return
        physical = {c.name: sql_type(T._parse_datatype_string(c.type)) for c in self.state().columns}
        for r in rows:
            if r.get("name") in physical and r.get("sql_type") and not compatible(r["sql_type"], physical[r["name"]]):
                report.add(Kind.TYPES, Severity.MEDIUM, f"{r['name']} is declared {r['sql_type']} but stored as {physical[r['name']]}", FACT, r["name"])

    def _links(self, report: ValidationReport, present: set[str], rows: list[dict]) -> None:
        named = {r["name"]: r.get("sql_type") for r in rows}
        parents = {r["name"]: r.get("parent_name") for r in rows}
        for column, parent in parents.items():
            if parent and parent not in named:
                report.add(Kind.LINKS, Severity.HIGH, f"{column} has an unknown parent {parent}", META, column)
        for check in (lambda: links.check_forest(parents), lambda: links.check_labels({r["name"]: r["label_for"] for r in rows if r.get("label_for")}, named, [r["name"] for r in rows if r.get("is_primary_key")], parents)):
            try:
                check()
            except ValueError as error:
                report.add(Kind.LINKS, Severity.HIGH, str(error), META)

    def _keys(self, report: ValidationReport, present: set[str], rows: list[dict]) -> None:
        keys = [r["name"] for r in rows if r.get("is_primary_key")]
        if FACT in present and keys and (n := repeated_keys(self.fact(), keys).count()):
            report.add(Kind.KEYS, Severity.HIGH, f"{n} primary key values are repeated", FACT, details={"duplicate_count": n})

    def _dependencies(self, report: ValidationReport, present: set[str], rows: list[dict]) -> None:
        for r in rows:
            if r.get("label_for"):
                try:
                    links.check_dependency(self.fact(), r["label_for"], r["name"])
                except ValueError as error:
                    report.add(Kind.LINKS, Severity.CRITICAL, str(error), FACT, r["name"])

    def _quality(self, report: ValidationReport, present: set[str], rows: list[dict]) -> None:
        if FACT not in present:
            return
        names = self.columns()
        found = null_profile(self.fact().toDF(*[f"c{i}" for i in range(len(names))])).first()
        total = found["total_rows"]
        if not total:
            report.add(Kind.DATA, Severity.MEDIUM, "the fact table is empty", FACT)
            return
        for i, name in enumerate(names):
            share = found[f"null_c{i}"] / total
            if share == 1:
                report.add(Kind.DATA, Severity.HIGH, f"{name} has no values", FACT, name)
            elif share > 0.5:
                report.add(Kind.DATA, Severity.MEDIUM, f"{name} is null in {share:.0%} of rows", FACT, name)

    def get_quick_health_check(self) -> dict[str, Any]:
        """status: healthy, warning, critical, empty or error."""
        try:
            if not self.lake.exists(self.schema, FACT) or not self.lake.exists(self.schema, META):
                return {"status": "critical", "rows": None, "columns": None, "issues": ["a table is missing"]}
            rows, report = self.state().rows, self.validate_database(Level.BASIC)
            worst = "critical" if report.critical_count() else "warning" if report.by_severity(Severity.HIGH) else "healthy"
            return {"status": worst if worst == "critical" or rows else "empty", "rows": rows, "columns": len(self.columns()), "issues": [i.message for i in report.issues], "updated_at": json.loads(json.dumps(self.dataset().get("updated_at")))}
        except Exception as error:
            log.warning("health check failed: %s", error)
            return {"status": "error", "rows": None, "columns": None, "issues": [str(error)]}
