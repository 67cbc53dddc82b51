"""Column names that no frame at hand has."""

from __future__ import annotations

from collections.abc import Iterable

#: What the engine adds to rows while it works begins like this; no column of a table may.
RESERVED = "__factlake_"


def free_name(taken: Iterable[str], wanted: str) -> str:
    """``wanted``, lengthened until none of ``taken`` is it (names compare without case)."""
    known = {c.lower() for c in taken}
    while wanted.lower() in known:
        wanted += "_"
    return wanted


def refuse_reserved(names: Iterable[str]) -> None:
    if bad := [n for n in names if n.lower().startswith(RESERVED)]:
        raise ValueError(f"column names that begin with {RESERVED} are reserved: {bad}")
