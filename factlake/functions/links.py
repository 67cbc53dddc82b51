"""Links between columns: hierarchies (child to parent) and value labels (label column to code column)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.functions.filters import quoted
from factlake.functions.names import free_name

SAMPLE = 10


def check_forest(parent_of: Mapping[str, str | None]) -> None:
    """ValueError if a chain of parents comes back to where it began."""
    for start in parent_of:
        seen, at = {start}, parent_of.get(start)
        while at is not None:
            if at in seen:
                raise ValueError(f"the hierarchy has a cycle at {at}")
            seen.add(at)
            at = parent_of.get(at)


def chains(parent_of: Mapping[str, str | None]) -> list[list[str]]:
    """Root-to-leaf chains, one a leaf, sorted; columns without links are left out."""
    try:
        check_forest(parent_of)
    except ValueError as error:
        raise RuntimeError(str(error)) from error
    parents = {p for p in parent_of.values() if p is not None}
    found = []
    for leaf, parent in parent_of.items():
        if leaf in parents or parent is None:
            continue
        chain, at = [leaf], parent
        while at is not None:
            chain.append(at)
            at = parent_of.get(at)
        found.append(chain[::-1])
    return sorted(found)


def check_labels(label_for: Mapping[str, str], columns: Mapping[str, str], keys: Iterable[str], parent_of: Mapping[str, str | None]) -> None:
    """ValueError if a label column breaks the structure. ``columns``: SQL types by name."""
    in_hierarchy = {c for c, p in parent_of.items() if p} | {p for p in parent_of.values() if p}
    for label, code in label_for.items():
        if code not in columns:
            raise ValueError(f"{label} labels an unknown column {code}")
        if label == code:
            raise ValueError(f"{label} can't label itself")
        if code in label_for:
            raise ValueError(f"{label} labels {code}, which is a label itself")
        if columns.get(label) != "VARCHAR":
            raise ValueError(f"the label column {label} must be text")
        if label in set(keys):
            raise ValueError(f"the label column {label} can't be part of the primary key")
        if label in in_hierarchy:
            raise ValueError(f"the label column {label} can't be part of a hierarchy")


def broken_codes(df: DataFrame, code: str, label: str) -> DataFrame:
    """(code, labels) of codes that don't determine their label: several, or some rows without. Null codes don't count."""
    own = df.select(F.col(quoted(code)).alias("code"), F.col(quoted(label)).alias("label")).filter("code IS NOT NULL")
    found = own.groupBy("code").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("label").alias("labelled"), F.count(F.lit(1)).alias("rows"))
    broken = found.filter("low < high OR (labelled > 0 AND labelled < rows)")
    shown = F.array_compact(F.array("low", F.when(F.col("high") != F.col("low"), F.col("high")), F.when(F.col("labelled") < F.col("rows"), F.lit("<null>"))))
    return broken.select(F.col("code").alias(code), shown.alias(free_name([code], "labels")))


def null_code_rows(df: DataFrame, code: str, label: str) -> DataFrame:
    """Rows with a label but no code."""
    return df.filter(F.col(quoted(code)).isNull() & F.col(quoted(label)).isNotNull())


def check_dependency(df: DataFrame, code: str, label: str, codes: DataFrame | None = None) -> None:
    """ValueError unless each code has one label, and no code no label. ``codes``: one column, the only codes to look at."""
    own, nulls = df.select(F.col(quoted(code)).alias("code"), F.col(quoted(label)).alias("label")), True
    own_codes = own
    if codes is not None:
        only = codes.select(F.col(quoted(codes.columns[0])).alias("only")).distinct()
        nulls = not only.filter("only IS NULL").isEmpty()
        own_codes = own.join(only, F.col("code") == F.col("only"), "left_semi")
    bad = broken_codes(own_codes, "code", "label").limit(SAMPLE).collect()
    if bad:
        shown = ", ".join(f"{r[0]!r}: {list(r[1])}" for r in bad)
        raise ValueError(f"{code} doesn't determine {label} ({shown}); use update_value_labels to change the label of a code everywhere")
    if nulls:
        count = null_code_rows(own, "code", "label").count()
        if count:
            raise ValueError(f"{count} rows have a {label} but no {code}; use update_value_labels to change labels")
