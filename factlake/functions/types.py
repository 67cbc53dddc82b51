"""SQL type names, the widening lattice and the metadata contract of a result set."""

from __future__ import annotations

import logging
import re
from typing import Any

from pyspark.sql import types as T

log = logging.getLogger("factlake")

#: Text fields of a column's metadata that only its producer sets.
TEXT_FIELDS = ("parent_name", "label_for", "unit", "display_format", "family", "description", "default_aggregation")
AGGREGATIONS = frozenset({"SUM", "AVG", "MAX", "MIN", "COUNT", "MEDIAN", "MODE"})
METADATA = T.StructType(
    [T.StructField(n, T.StringType(), False) for n in ("name", "label", "sql_type")]
    + [T.StructField(n, T.BooleanType(), False) for n in ("is_categorical", "is_primary_key")]
    + [T.StructField(n, T.StringType(), True) for n in TEXT_FIELDS]
)
DATASET = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("label", "description", "source")]
    + [T.StructField("updated_at", T.TimestampNTZType()), T.StructField("schema_version", T.IntegerType()), T.StructField("cluster_by", T.StringType())]
)
SCHEMA_VERSION = 1

_NAMES: dict[type, str] = {
    T.StringType: "VARCHAR",
    T.BooleanType: "BOOLEAN",
    T.ByteType: "TINYINT",
    T.ShortType: "SMALLINT",
    T.IntegerType: "INTEGER",
    T.LongType: "BIGINT",
    T.FloatType: "FLOAT",
    T.DoubleType: "DOUBLE",
    T.DateType: "DATE",
    T.TimestampNTZType: "TIMESTAMP",
    T.TimestampType: "TIMESTAMP",
    T.DayTimeIntervalType: "INTERVAL",
    T.BinaryType: "BLOB",
    T.NullType: "VARCHAR",
}
if hasattr(T, "TimeType"):
    _NAMES[T.TimeType] = "TIME"

SYNONYMS = {
    "TEXT": "VARCHAR", "STRING": "VARCHAR", "CHAR": "VARCHAR", "BPCHAR": "VARCHAR", "INT": "INTEGER", "INT4": "INTEGER", "SIGNED": "INTEGER",
    "INT2": "SMALLINT", "INT1": "TINYINT", "INT8": "BIGINT", "LONG": "BIGINT", "FLOAT8": "DOUBLE", "FLOAT4": "FLOAT", "REAL": "FLOAT", "BOOL": "BOOLEAN",
    "BYTEA": "BLOB", "BINARY": "BLOB", "DATETIME": "TIMESTAMP", "TIMESTAMP_NTZ": "TIMESTAMP",
}

#: Rank of the widening lattice: level, then bits.
_RANK = {
    "BOOLEAN": (1, 1), "UTINYINT": (2, 8), "TINYINT": (2, 8), "USMALLINT": (2, 16), "SMALLINT": (2, 16), "UINTEGER": (2, 32), "INTEGER": (2, 32),
    "UBIGINT": (2, 64), "BIGINT": (2, 64), "UHUGEINT": (2, 128), "HUGEINT": (2, 128), "FLOAT": (3, 32), "DOUBLE": (3, 64), "VARCHAR": (4, 0),
}
_NEXT_SIGNED = {8: "SMALLINT", 16: "INTEGER", 32: "BIGINT", 64: "HUGEINT"}
_CONTAINERS = {
    "BOOLEAN": "boolean", "TINYINT": "tinyint", "UTINYINT": "smallint", "SMALLINT": "smallint", "USMALLINT": "int", "INTEGER": "int", "UINTEGER": "bigint",
    "BIGINT": "bigint", "UBIGINT": "decimal(20,0)", "HUGEINT": "decimal(38,0)", "UHUGEINT": "decimal(38,0)", "FLOAT": "float", "DOUBLE": "double", "VARCHAR": "string",
}


def sql_type(kind: T.DataType) -> str:
    """The SQL name of a Spark type; ValueError for composites and unknown types."""
    if isinstance(kind, T.DecimalType):
        return "HUGEINT" if (kind.precision, kind.scale) == (38, 0) else f"DECIMAL({kind.precision},{kind.scale})"
    for known, name in _NAMES.items():
        if isinstance(kind, known):
            return name
    raise ValueError(f"{kind.simpleString()} columns aren't supported: flatten or serialise them first")


def spark_type(name: str) -> str:
    """The Spark type that holds a type of the lattice."""
    return _CONTAINERS[name]


def refuse_composites(schema: T.StructType) -> None:
    bad = []
    for field in schema:
        try:
            sql_type(field.dataType)
        except ValueError as error:
            bad.append(f"{field.name}: {error}")
    if bad:
        raise ValueError("; ".join(bad))


def wider(stored: str, incoming: str) -> str:
    """The type for both; types outside the lattice keep what is stored, and nothing narrows."""
    if stored == incoming or stored not in _RANK or incoming not in _RANK:
        return stored
    a, b = _RANK[stored], _RANK[incoming]
    if a == b and a[0] == 2:  # one is unsigned
        return _NEXT_SIGNED.get(a[1], stored)
    return incoming if b > a else stored


def compatible(declared: str, physical: str) -> bool:
    def plain(name: str) -> str:
        base = name.upper().split("(")[0].strip()
        return SYNONYMS.get(base, base)

    return plain(declared) == plain(physical)


def check_column_metadata(given: dict[str, dict[str, Any]] | None, columns: list[str]) -> dict[str, dict[str, Any]]:
    """``given`` with aggregations in capitals; ValueError for unknown columns, fields or aggregations."""
    out = {}
    for column, fields in (given or {}).items():
        if column not in columns:
            raise ValueError(f"column_metadata names an unknown column: {column}")
        unknown = set(fields) - {"label", *TEXT_FIELDS}
        if unknown:
            raise ValueError(f"column_metadata of {column} has unknown fields: {sorted(unknown)}")
        own = dict(fields)
        if own.get("default_aggregation") is not None:
            own["default_aggregation"] = aggregation(own["default_aggregation"])
        out[column] = own
    return out


def aggregation(name: str) -> str:
    if str(name).upper() not in AGGREGATIONS:
        raise ValueError(f"{name!r} is no default aggregation: one of {sorted(AGGREGATIONS)}")
    return str(name).upper()


def warn_name(column: str) -> None:
    if not re.fullmatch(r"[a-z_][a-z0-9_]*", column):
        log.warning("column %r isn't in snake case: it works, but needs quotes everywhere", column)


def default_label(column: str) -> str:
    return column.replace("_", " ").title()
