"""What an operation did, measured from snapshots and file lists rather than estimated."""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass, field
from typing import Any

from factlake.sources.lake import Lake
from factlake.sources.log import Table


@dataclass
class OperationReport:
    operation: str
    table: str
    run_id: str | None = None
    success: bool = False
    rows_before: int | None = None
    rows_after: int | None = None
    rows_inserted: int = 0
    rows_updated: int = 0
    rows_deleted: int = 0
    columns_added: list[str] = field(default_factory=list)
    columns_dropped: list[str] = field(default_factory=list)
    files_before: int | None = None
    files_after: int | None = None
    bytes_before: int | None = None
    bytes_after: int | None = None
    delete_files_before: int | None = None
    delete_files_after: int | None = None
    snapshot_before: int | None = None
    snapshot_after: int | None = None
    warnings: list[str] = field(default_factory=list)
    changes: list[str] = field(default_factory=list)
    maintenance: dict[str, Any] = field(default_factory=dict)
    started: float = field(default_factory=time.time)
    seconds: float | None = None

    def before(self, lake: Lake, own: Table | None) -> OperationReport:
        self.snapshot_before = lake.state.version
        if own is not None:
            self.rows_before, self.files_before, self.bytes_before, self.delete_files_before = measures(own)
        return self

    def after(self, lake: Lake, own: Table | None) -> OperationReport:
        self.snapshot_after, self.seconds = lake.state.version, time.time() - self.started
        if own is not None:
            self.rows_after, self.files_after, self.bytes_after, self.delete_files_after = measures(own)
        return self

    def summary(self) -> str:
        """One line."""
        parts = [f"{self.operation} on {self.table}: {'ok' if self.success else 'failed'}"]
        parts.append(f"+{self.rows_inserted} rows, ~{self.rows_updated} updated, -{self.rows_deleted} deleted")
        if self.bytes_before is not None and self.bytes_after is not None:
            parts.append(f"{self.bytes_before / 1e6:.1f} -> {self.bytes_after / 1e6:.1f} MB")
        if self.snapshot_after is not None:
            parts.append(f"snapshot {self.snapshot_before} -> {self.snapshot_after}")
        if self.seconds is not None:
            parts.append(f"{self.seconds:.1f} s")
        if self.warnings:
            parts.append(f"{len(self.warnings)} warnings")
        return ", ".join(parts)

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)


def measures(own: Table) -> tuple[int, int, int, int]:
    """(rows, files, bytes, tombstone files) of a table's state: no scan."""
    return own.rows, len(own.files), sum(f.bytes for f in own.files.values()), len({d.path for d in own.live_deletes()})
