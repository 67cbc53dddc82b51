"""Duplicate rows and keys."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factlake.functions.filters import quoted
from factlake.functions.names import free_name

log = logging.getLogger("factlake")
KEEPS = ("none", "first", "last", "any")


def remove_duplicates(df: DataFrame, keep: str = "none", keys: list[str] | None = None, order_by: list | None = None) -> DataFrame:
    """``df`` with one row of each key (all columns without ``keys``), or with none of a repeated key's rows.

    Rows have no order of their own: first and last go by ``order_by``, else by the position at which Spark reads them, which is
    only repeatable for a source that is read the same way again; none reads ``df`` twice. Null keys are equal to each other. All of it
    is combined before the shuffle, so a key that many rows share reaches one task as a few rows.
    """
    if keep not in KEEPS:
        raise ValueError(f"keep is one of {KEEPS}")
    by = keys or df.columns
    if keep == "any":
        return df.dropDuplicates(by)
    if keep == "none":
        # Repeated keys alone are gathered: rows move only if these are too many to broadcast.
        gone = repeated_keys(df, by)
        names = [free_name(df.columns, f"_of{i}") for i in range(len(by))]
        gone = gone.select(*[F.col(quoted(c)).alias(n) for c, n in zip(by, names, strict=True)])
        return df.join(gone, [F.col(quoted(c)).eqNullSafe(F.col(n)) for c, n in zip(by, names, strict=True)], "left_anti")
    at, rank = free_name(df.columns, "_position"), free_name(df.columns, "_rank")
    own = df if order_by else df.withColumn(at, F.monotonically_increasing_id())
    order = [F.col(quoted(c)) if isinstance(c, str) else c for c in order_by or [at]]
    order = [c.desc() for c in order] if keep == "last" else [c.asc() for c in order]
    over = Window.partitionBy(*map(quoted, by)).orderBy(*order)
    return own.withColumn(rank, F.row_number().over(over)).filter(F.col(rank) == 1).select(*map(quoted, df.columns))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, occurrences) of keys that several rows have; the count's name is lengthened if a key has it."""
    count = free_name(keys, "occurrences")
    return df.groupBy(*map(quoted, keys)).agg(F.count(F.lit(1)).alias(count)).filter(F.col(count) > 1)


def null_profile(df: DataFrame) -> DataFrame:
    """One row, one scan: total_rows and null_<column> for each column."""
    nulls = [(F.count(F.lit(1)) - F.count(F.col(quoted(c)))).alias(f"null_{c}") for c in df.columns]
    return df.agg(F.count(F.lit(1)).alias("total_rows"), *nulls)
