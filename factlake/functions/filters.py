"""Row filters: conjunctions of (column, operator, value), disjunctions of those, or SQL text, as Columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

Condition = tuple[str, str, Any]
Filters = str | Sequence[Condition] | Sequence[Sequence[Condition]] | None

_COMPARE = {
    "=": lambda c, v: c == v,
    "==": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "in": lambda c, v: c.isin(list(v)),
    "not in": lambda c, v: ~c.isin(list(v)),
    # Of any column as text; % stands for any characters, _ for one.
    "like": lambda c, v: c.cast("string").like(v),
    "not like": lambda c, v: ~c.cast("string").like(v),
}
_PLAIN = {"in", "not in", "like", "not like"}


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def condition(term: Condition) -> Column:
    if not isinstance(term, tuple) or len(term) != 3:
        raise TypeError(f"a condition is (column, operator, value), not {term!r}")
    name, op, value = term
    if op.lower() not in _COMPARE:
        raise ValueError(f"unknown operator {op!r}")
    if op.lower().endswith("like") and not isinstance(value, str):
        raise TypeError(f"{op} takes a text, not {value!r}")
    return _COMPARE[op.lower()](F.col(quoted(name)), value if op.lower() in _PLAIN else F.lit(value))


def disjunction(filters: Sequence) -> list[list[Condition]]:
    """Filters as a list of conjunctions; TypeError for another shape."""
    if all(isinstance(x, tuple) for x in filters):
        return [list(filters)]
    if all(isinstance(x, list) and x and all(isinstance(y, tuple) for y in x) for x in filters):
        return [list(x) for x in filters]
    raise TypeError("filters are a list of conditions or a list of lists of conditions")


def to_column(filters: Filters) -> Column | None:
    """None without filters; text is SQL."""
    if filters is None:
        return None
    if isinstance(filters, str):
        return F.expr(filters)
    if not isinstance(filters, list | tuple) or isinstance(filters, tuple):
        raise TypeError("filters are None, SQL text or a list")
    if not filters:
        return None
    return reduce(or_, [reduce(and_, map(condition, terms)) for terms in disjunction(filters)])


def delete_filter(filters: Filters) -> Column:
    """As to_column, but a full delete must be spelled out ("TRUE")."""
    if filters is None or isinstance(filters, dict) or not filters:
        raise ValueError('a delete needs filters; to delete all rows pass "TRUE"')
    if isinstance(filters, str):
        if not filters.strip():
            raise ValueError('a delete needs filters; to delete all rows pass "TRUE"')
        return F.expr(filters)
    try:
        return to_column(list(filters))
    except TypeError as error:
        raise ValueError(str(error)) from error


def may_match(terms: list[list[Condition]], ranges: dict[str, tuple[Any, Any]]) -> bool:
    """Whether a file with these (min, max) can hold a row that the filters keep; unknown columns and mixed types can."""

    def one(term: Condition) -> bool:
        name, op, value = term
        low, high = ranges.get(name, (None, None))
        if low is None or high is None:
            return True
        try:
            match op.lower():
                case "=" | "==":
                    return low <= value <= high
                case "<":
                    return low < value
                case "<=":
                    return low <= value
                case ">":
                    return high > value
                case ">=":
                    return high >= value
                case "in":
                    return any(low <= v <= high for v in value)
        except TypeError:
            pass
        return True

    return any(all(map(one, conjunction)) for conjunction in terms)
