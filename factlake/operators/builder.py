"""Building a result set: infer its metadata from a frame and persist the three tables in one snapshot."""

from __future__ import annotations

import json
import logging
import warnings
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlake.functions import links
from factlake.functions.duplicates import remove_duplicates, repeated_keys
from factlake.functions.filters import quoted
from factlake.functions.types import DATASET, METADATA, SCHEMA_VERSION, check_column_metadata, default_label, sql_type, warn_name
from factlake.operators.base import DATASET_META, FACT, META, ResultSet, as_frame, now
from factlake.plans.report import OperationReport
from factlake.sources.lake import Lake

log = logging.getLogger("factlake")


class ResultSetBuilder:
    """Schema inference over ``df`` and its build into ``schema`` of ``lake``."""

    def __init__(
        self,
        lake: Lake,
        df: Any,
        schema: str = "main",
        categorical_threshold: int | None = None,
        primary_keys: Sequence[str] | None = None,
        categorical_overrides: Mapping[str, bool] | None = None,
        hierarchies: Mapping[str, str] | None = None,
        value_labels: Mapping[str, str] | None = None,
        label: str | None = None,
        description: str | None = None,
        source: str | None = None,
    ):
        self.lake, self.schema, self.df = lake, schema, as_frame(lake, df)
        self.categorical_threshold, self.primary_keys = categorical_threshold, list(primary_keys or [])
        self.categorical_overrides, self.hierarchies, self.value_labels = dict(categorical_overrides or {}), dict(hierarchies or {}), dict(value_labels or {})
        self.label, self.description, self.source = label, description, source
        columns = set(self.df.columns)
        for what, names in (
            ("primary_keys", self.primary_keys),
            ("categorical_overrides", self.categorical_overrides),
            ("hierarchies", [*self.hierarchies, *self.hierarchies.values()]),
            ("value_labels", [*self.value_labels, *self.value_labels.values()]),
        ):
            if unknown := [n for n in names if n not in columns]:
                raise ValueError(f"{what} names unknown columns: {unknown}")
        if not self.primary_keys:
            warnings.warn("no primary key: duplicates are judged by all columns, and updates by key aren't possible", UserWarning, stacklevel=2)
        self.last_report: OperationReport | None = None

    def _links(self, field: str, declared: dict[str, str], given: dict[str, dict[str, Any]]) -> dict[str, str]:
        """Links from the builder's argument and from column_metadata: they must agree."""
        out = dict(declared)
        for column, fields in given.items():
            target = fields.get(field)
            if target is None:
                continue
            if target not in self.df.columns:
                raise ValueError(f"{field} of {column} is an unknown column: {target}")
            if out.get(column, target) != target:
                raise ValueError(f"{field} of {column} is both {out[column]} and {target}")
            out[column] = target
        return out

    def _checked(self, column_metadata: dict[str, dict[str, Any]] | None) -> tuple[dict, dict[str, str], dict[str, str], dict[str, str]]:
        """(column_metadata, SQL types, parents, labels): what can be told without reading a row."""
        given = check_column_metadata(column_metadata, self.df.columns)
        kinds = {f.name: sql_type(f.dataType) for f in self.df.schema}
        for name in kinds:
            warn_name(name)
        parents = self._links("parent_name", self.hierarchies, given)
        links.check_forest(parents)
        labels = self._links("label_for", self.value_labels, given)
        links.check_labels(labels, kinds, self.primary_keys, parents)
        for name in {*parents, *parents.values()}:
            if self.categorical_overrides.get(name) is False:
                raise ValueError(f"{name} is part of a hierarchy and so categorical")
        return given, kinds, parents, labels

    def infer_metadata(self, column_labels: Mapping[str, str] | None = None, column_metadata: dict[str, dict[str, Any]] | None = None, data: DataFrame | None = None) -> list[dict[str, Any]]:
        """One row a column; one job counts the distinct values of all text columns (of ``data``, if it isn't the builder's frame)."""
        given, kinds, parents, labels = self._checked(column_metadata)
        texts = [f.name for f in self.df.schema if isinstance(f.dataType, T.StringType)]
        few: dict[str, bool] = {}
        if self.categorical_threshold is not None and texts:
            own = self.df if data is None else data
            row = own.agg(*[F.count_distinct(F.col(quoted(c))).alias(f"c{i}") for i, c in enumerate(texts)]).first()
            few = {c: row[f"c{i}"] <= self.categorical_threshold for i, c in enumerate(texts)}
        members = {*parents, *parents.values()}
        rows = []
        for name, kind in kinds.items():
            categorical = self.categorical_overrides.get(name, few.get(name, False))
            if name in members and not categorical:
                log.warning("%s is made categorical: it is part of a hierarchy", name)
                categorical = True
            own = given.get(name, {})
            shown = own.get("label") or (column_labels or {}).get(name) or default_label(name)
            links_ = {"parent_name": parents.get(name), "label_for": labels.get(name)}
            rows.append({"name": name, "label": shown, "sql_type": kind, "is_categorical": categorical, "is_primary_key": name in self.primary_keys} | {k: v for k, v in own.items() if k != "label"} | links_)
        return sorted(rows, key=lambda r: r["label"])

    def metadata_frame(self, **options: Any) -> DataFrame:
        return self.lake.spark.createDataFrame([tuple(m.get(f.name) for f in METADATA) for m in self.infer_metadata(**options)], METADATA)

    def build(self, **options: Any) -> tuple[DataFrame, DataFrame]:
        """(metadata, fact) frames, nothing written."""
        return self.metadata_frame(**options), self.df

    def build_schema(
        self,
        column_labels: Mapping[str, str] | None = None,
        column_metadata: dict[str, dict[str, Any]] | None = None,
        check_duplicates: bool = True,
        keep: str = "none",
        order_by: list | None = None,
        partition_by: Sequence[str] | None = None,
        cluster_by: Sequence[str] | None = None,
        run_id: str | None = None,
        commit_message: str | None = None,
        commit_info: dict | None = None,
        files: int | None = None,
    ) -> OperationReport:
        """Write the result set in one snapshot; whatever fails leaves the lake as it was. Files are disjoint ranges of cluster_by (the key by default).

        What is inferred and validated is what was written, whatever the frame would give a second time.
        """
        *_, labels = self._checked(column_metadata)
        df = self.df
        if check_duplicates:
            df = remove_duplicates(df, keep, self.primary_keys or None, order_by)
        key = list(cluster_by or self.primary_keys)
        if unknown := [c for c in key if c not in df.columns]:
            raise ValueError(f"cluster_by names unknown columns: {unknown}")
        managed = ResultSet(self.lake, self.schema, self.categorical_threshold)
        with managed.transaction("build_schema", run_id, commit_message, commit_info) as (t, report):
            self.last_report = report
            self.lake.create_schema(self.schema)
            for name in (FACT, META, DATASET_META):
                if self.lake.exists(self.schema, name):
                    raise ValueError(f"{self.schema} has a {name} already")
            t.create(self.schema, META, METADATA)
            t.create(self.schema, DATASET_META, DATASET)
            fact = t.create(self.schema, FACT, df.schema, key, list(partition_by or []), self.primary_keys)
            report.rows_inserted = t.insert(fact, df, files)
            written = managed.fact()
            # What was left with one row a key needs no second look; keep="none" reads the frame twice, and a frame may differ.
            if self.primary_keys and (not check_duplicates or keep == "none") and not repeated_keys(written, self.primary_keys).isEmpty():
                raise ValueError(f"the primary key {self.primary_keys} isn't unique")
            for label, code in labels.items():
                links.check_dependency(written, code, label)
            rows = self.infer_metadata(column_labels, column_metadata, written)
            physical = {c.name: sql_type(T._parse_datatype_string(c.type)) for c in fact.columns}
            managed.put_metadata(t, [m | {"sql_type": physical[m["name"]]} for m in rows])
            managed.put_dataset(
                t, label=self.label or self.schema, description=self.description, source=self.source, updated_at=now(), schema_version=SCHEMA_VERSION, cluster_by=json.dumps(key) if key else None
            )
        return report

    def display_schema(self) -> None:
        for name, column, kind in ResultSet(self.lake, self.schema).described():
            print(f"{self.schema}.{name}.{column}: {kind}")
