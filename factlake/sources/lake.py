"""A lake: tables of immutable Parquet files under one snapshot log, read as DataFrames and written by transactions."""

from __future__ import annotations

import json
import math
import os
import re
import threading
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import replace
from datetime import date, datetime, timedelta
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlake.functions.filters import Filters, disjunction, may_match, quoted, to_column
from factlake.functions.names import RESERVED, free_name, refuse_reserved
from factlake.sources.log import Column, ConcurrentWriteError, DataFile, DeleteFile, Log, State, Table
from factlake.sources.stores import LogStore

#: Layout of data files; a lake's own options override them.
OPTIONS: dict[str, Any] = {
    "compression": "zstd",
    "target_file_size": 100_000_000,
    "row_group_bytes": 32 << 20,
    "row_group_rows": 122_880,
    "data_inlining_row_limit": 0,
    "parquet_version": "PARQUET_2_0",
}
#: Columns of a file, from the first, whose ranges are logged, besides those of the sort key.
RANGED = 4
ROW, FILE, POSITION = f"{RESERVED}row_id", f"{RESERVED}file", f"{RESERVED}position"
#: Folders of a partitioned write.
PART = f"{RESERVED}p"
#: Characters of a text that a logged range keeps, below which input a sorted write is one file, and the groups that one job rewrites.
BOUND_CHARS, ONE_FILE_BYTES, JOB_GROUPS = 64, 8 << 20, 64
#: Written files whose footers the driver reads itself, and tombstones that are written as one file.
FOOTERS, ONE_FILE_DELETES = 16, 1_000_000
#: Times that a commit is put on top of others that touched other tables.
REBASES = 16


def schema_parts(path: str) -> list[str]:
    """The levels of a dotted schema path; an empty level is a ValueError."""
    parts = path.split(".") if isinstance(path, str) else []
    if not parts or any(not p.strip() for p in parts):
        raise ValueError(f"bad schema path {path!r}")
    return parts


def normal_root(root: str) -> str:
    """A local path as an absolute one; an URI as it is."""
    return root if re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*:/", root) else os.path.abspath(root)


class Lake:
    """A catalog at ``root``. Several lakes can share a session; none is current.

    A ``version`` or a ``timestamp`` (not both) pins all reads to a snapshot and makes the lake read-only.
    """

    def __init__(self, spark: SparkSession, root: str, read_only: bool = False, version: int | None = None, timestamp: Any = None, options: dict[str, Any] | None = None, store: LogStore | None = None):
        if version is not None and timestamp is not None:
            raise ValueError("pass a version or a timestamp, not both")
        self.spark, self.root = spark, normal_root(root)
        self.log = Log(spark, self.root, store)
        self.read_only = read_only or version is not None or timestamp is not None
        self._lock, self._open, self._cached = threading.RLock(), None, None
        if timestamp is not None:
            version = self.log.version_at(timestamp)
        self.pinned = version
        if not self.read_only:
            self.log.prepare()
        if options and not self.read_only:
            with self.transaction(message="options") as t:
                t.state.options |= options

    # --- state -----------------------------------------------------------------------------------------------------------

    @property
    def state(self) -> State:
        """Of the open transaction, else of the pinned or the last snapshot."""
        if self._open is not None:
            return self._open.state
        version = self.pinned if self.pinned is not None else self.log.latest()
        if self._cached is None or self._cached.version != version:
            self._cached = self.log.state(version) if version else State()
        return self._cached

    def option(self, name: str) -> Any:
        return self.state.options.get(name, OPTIONS.get(name))

    def key(self, schema: str, table: str) -> str:
        return f"{'.'.join(schema_parts(schema))}/{table}"

    def exists(self, schema: str, table: str) -> bool:
        return self.key(schema, table) in self.state.tables

    def schemas(self) -> list[str]:
        return sorted(self.state.schemas)

    def create_schema(self, schema: str) -> None:
        """Create each level of a path that isn't there."""
        parts = schema_parts(schema)
        wanted = {".".join(parts[: i + 1]) for i in range(len(parts))}
        if not wanted <= self.state.schemas:
            with self.transaction(message=f"create schema {schema}") as t:
                t.state.schemas |= wanted

    def table_state(self, schema: str, table: str, version: int | None = None) -> Table:
        state = self.state if version is None else self.log.state(version)
        found = state.tables.get(self.key(schema, table))
        if found is None:
            raise ValueError(f"there is no table {schema}.{table}")
        return found

    # --- reads -----------------------------------------------------------------------------------------------------------

    def table(self, schema: str, table: str = "fact_table", version: int | None = None, timestamp: Any = None, filters: Filters = None) -> DataFrame:
        """A table's rows at a snapshot. With ``filters``, files whose ranges can't match aren't read."""
        if version is not None and timestamp is not None:
            raise ValueError("pass a version or a timestamp, not both")
        if timestamp is not None:
            version = self.log.version_at(timestamp)
        return self.scan(self.table_state(schema, table, version), filters=filters)

    def files_for(self, own: Table, filters: Filters) -> list[DataFile]:
        files = list(own.files.values())
        if not filters or isinstance(filters, str):
            return files
        terms = disjunction(filters)
        names = {c.physical: c for c in own.columns}

        def ranges(f: DataFile) -> dict[str, tuple]:
            # A widened column's old ranges are of another type: they prune nothing.
            own_types = {p: f.types.get(p) for p in f.ranges}
            return {names[p].name: tuple(_typed(x, names[p].type) for x in r) for p, r in f.ranges.items() if p in names and names[p].type == own_types[p]}

        return [f for f in files if may_match(terms, ranges(f))]

    def scan(self, own: Table, internal: bool = False, filters: Filters = None, files: Sequence[DataFile] | None = None, inline: bool = True) -> DataFrame:
        """Rows of a table's state; ``internal`` adds ROW, FILE and POSITION (the last two null for inlined rows)."""
        chosen = list(files) if files is not None else self.files_for(own, filters)
        masked = {d.target for d in own.live_deletes()}
        groups: dict[tuple, list[DataFile]] = {}
        for f in chosen:
            groups.setdefault((tuple(sorted(f.types.items())), f.path in masked, f.row_id is None, f.path.count("/")), []).append(f)
        parts = [self._scan_group(own, group, is_masked, internal) for (_, is_masked, *_), group in groups.items()]
        if inline and own.inline:
            parts.append(self._scan_inline(own, internal))
        if not parts:
            fields = [T.StructField(c.name, T._parse_datatype_string(c.type)) for c in own.columns]
            extra = [T.StructField(ROW, T.LongType()), T.StructField(FILE, T.StringType()), T.StructField(POSITION, T.LongType())] if internal else []
            parts.append(self.spark.createDataFrame([], T.StructType(fields + extra)))
        out = reduce(lambda a, b: a.unionByName(b), parts)
        where = to_column(filters)
        return out if where is None else out.filter(where)

    def _scan_group(self, own: Table, group: list[DataFile], masked: bool, internal: bool) -> DataFrame:
        types = group[0].types
        explicit = group[0].row_id is None
        schema = T.StructType([T.StructField(p, T._parse_datatype_string(t)) for p, t in types.items()] + ([T.StructField(ROW, T.LongType())] if explicit else []))
        df = self.spark.read.schema(schema).parquet(*[f"{self.root}/{f.path}" for f in group])
        columns = [(F.col(quoted(c.physical)) if c.physical in types else F.lit(None)).cast(c.type).alias(c.name) for c in own.columns]
        if not internal and not masked:
            return df.select(*columns)
        # Of a single file all rows have one path and one first row id.
        alone = group[0] if len(group) == 1 else None
        name = F.lit(alone.path) if alone else _below(group[0].path.count("/"))
        position = F.col("_metadata.row_index")
        hidden = [name.alias(FILE), position.alias(POSITION)]
        if internal and explicit:
            hidden.append(F.col(ROW))
        out = df.select(*columns, *hidden)
        if masked:
            targets = {f.path for f in group}
            paths = sorted({d.path for d in own.live_deletes() if d.target in targets})
            gone = self.spark.read.schema("file string, position long").parquet(*[f"{self.root}/{p}" for p in paths])
            gone = gone.select(F.col("file").alias(f"{RESERVED}gone"), F.col("position").alias(f"{RESERVED}at"))
            out = out.join(gone, (F.col(FILE) == F.col(f"{RESERVED}gone")) & (F.col(POSITION) == F.col(f"{RESERVED}at")), "left_anti")
        if not internal:
            return out.select(*[quoted(c.name) for c in own.columns])
        if not explicit and alone:
            out = out.withColumn(ROW, F.lit(alone.row_id).cast("long") + F.col(POSITION))
        elif not explicit:
            name, start = f"{RESERVED}name", f"{RESERVED}start"
            starts = self.spark.createDataFrame([(f.path, f.row_id) for f in group], f"{name} string, {start} long")
            # As many rows as files of this scan.
            met = out.join(F.broadcast(starts) if len(group) <= 10_000 else starts, F.col(FILE) == F.col(name))
            out = met.withColumn(ROW, F.col(start) + F.col(POSITION))
        return out.select(*[quoted(c.name) for c in own.columns], ROW, FILE, POSITION)

    def _scan_inline(self, own: Table, internal: bool) -> DataFrame:
        schema = T.StructType([T.StructField(c.physical, T._parse_datatype_string(c.type)) for c in own.columns])
        rows = self.spark.createDataFrame([(x["id"], x["row"]) for x in own.inline], f"{ROW} long, json string")
        parsed = rows.select(ROW, F.from_json("json", schema).alias("parsed"))
        columns = [F.col(f"parsed.{quoted(c.physical)}").alias(c.name) for c in own.columns]
        hidden = [F.col(ROW), F.lit(None).cast("string").alias(FILE), F.lit(None).cast("long").alias(POSITION)] if internal else []
        return parsed.select(*columns, *hidden)

    def snapshots(self) -> DataFrame:
        """Snapshots, newest first: snapshot_id, snapshot_time, author, commit_message, extra_info, changed."""
        rows = []
        for v in reversed(self.log.versions()):
            c = self.log.commit(v)
            rows.append((v, c["time"], c.get("author"), c.get("message"), json.dumps(c.get("extra_info")) if c.get("extra_info") else None, sorted({*c["tables"], *c["dropped"], *c["schemas"]})))
        schema = "snapshot_id long, _time string, author string, commit_message string, extra_info string, changed array<string>"
        return self.spark.createDataFrame(rows, schema).select("snapshot_id", F.col("_time").cast("timestamp_ntz").alias("snapshot_time"), "author", "commit_message", "extra_info", "changed").orderBy(F.desc("snapshot_id"))

    def changes(self, schema: str, table: str, start: int, end: int) -> DataFrame:
        """Rows that differ between the snapshots ``start - 1`` and ``end``: change_type, _row_id and the columns of ``end``.

        Only files that one of both has, or has other tombstones for, are read. The first two names are lengthened where a column has them.
        """
        after = self.table_state(schema, table, end)
        state = self.log.state(start - 1) if start > 1 else State()
        before = state.tables.get(self.key(schema, table), Table())

        def marks(t: Table) -> dict[str, list[str]]:
            found: dict[str, list[str]] = {}
            for d in t.deletes:
                found.setdefault(d.target, []).append(d.path)
            return {p: sorted(x) for p, x in found.items()}

        marked, marked_after = marks(before), marks(after)
        same = {p for p in before.files if p in after.files and marked.get(p) == marked_after.get(p)}
        old = self.scan(Table(columns=after.columns, files=before.files, deletes=before.deletes, inline=before.inline), True, files=[f for p, f in before.files.items() if p not in same])
        new = self.scan(after, True, files=[f for p, f in after.files.items() if p not in same])
        names = [c.name for c in after.columns]
        old, new = (x.select(F.col(ROW).alias("id"), F.struct(*map(quoted, names)).alias(side)) for x, side in ((old, "old"), (new, "new")))
        met = old.join(new, "id", "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")))
        updated = F.col("old").isNotNull() & F.col("new").isNotNull()
        entries = F.filter(
            F.array(
                F.struct(F.when(updated, "update_preimage").otherwise("delete").alias("kind"), F.col("old").alias("r")),
                F.struct(F.when(updated, "update_postimage").otherwise("insert").alias("kind"), F.col("new").alias("r")),
            ),
            lambda e: e["r"].isNotNull(),
        )
        out = met.select("id", F.explode(entries).alias("e"))
        kind, row = free_name(names, "change_type"), free_name(names, "_row_id")
        return out.select(F.col("e.kind").alias(kind), F.col("id").alias(row), *[F.col(f"e.r.{quoted(n)}").alias(n) for n in names])

    def register_views(self, schema: str, prefix: str = "") -> list[str]:
        """Temp views of a schema's tables, for SQL text; their names."""
        start, out = f"{'.'.join(schema_parts(schema))}/", []
        for key in self.state.tables:
            if key.startswith(start):
                name = prefix + key[len(start) :]
                self.table(schema, key[len(start) :]).createOrReplaceTempView(name)
                out.append(name)
        return sorted(out)

    def sql(self, text: str, schema: str) -> DataFrame:
        """Spark SQL over the tables of a schema."""
        self.register_views(schema)
        return self.spark.sql(text)

    def arrow(self, text: str, schema: str) -> pa.Table:
        """The whole result of Spark SQL over the tables of a schema as an Arrow table: for results that fit the driver."""
        return self.sql(text, schema).toArrow()

    # --- writes ----------------------------------------------------------------------------------------------------------

    @contextmanager
    def transaction(self, author: str | None = None, message: str | None = None, extra_info: dict | None = None) -> Iterator[Transaction]:
        """Staged changes, published as one snapshot when the block ends, dropped when it raises. A nested block joins the open one."""
        if self.read_only:
            raise PermissionError("this lake is read-only")
        with self._lock:
            if self._open is not None:
                yield self._open
                return
            before = self.state
            own = Transaction(self, before.copy())
            own.author, own.message, own.extra_info = author, message, extra_info
            json.dumps(extra_info)  # a bad one fails before anything is written
            self._open = own
            try:
                yield own
                self._open = None
                if own.state != before:
                    facts = {"author": own.author, "message": own.message, "extra_info": own.extra_info}
                    try:
                        own.version = self.log.write(before, own.state, facts)
                    except ConcurrentWriteError:
                        own.state = self._rebased(before, own.state, facts)
                        own.version = own.state.version
                    self._cached = own.state
            finally:
                self._open = None

    def _rebased(self, before: State, mine: State, facts: dict[str, Any]) -> State:
        """The state that is published where others have committed since ``before``, if none of them touched what this one changed."""
        changed = {k for k in {*before.tables, *mine.tables} if before.tables.get(k) != mine.tables.get(k)}
        options = {k: v for k, v in mine.options.items() if before.options.get(k) != v}
        for _ in range(REBASES):
            last = self.log.state()
            for v in range(before.version + 1, last.version + 1):
                other = self.log.commit(v)
                if met := sorted(changed & {*other["tables"], *other["dropped"]}) or sorted(set(options) & set(other["options"])):
                    raise ConcurrentWriteError(f"snapshot {v} of another writer changed {met} as well")
            state = last.copy()
            state.schemas |= mine.schemas - before.schemas
            state.options |= options
            for k in changed:
                if k not in mine.tables:
                    state.tables.pop(k, None)
                    continue
                known = before.tables.get(k, Table())
                table = state.tables[k] = mine.tables[k].copy()
                table.files = {p: f if p in known.files else replace(f, added=last.version + 1) for p, f in table.files.items()}
            try:
                self.log.write(last, state, facts)
                return state
            except ConcurrentWriteError:
                continue
        raise ConcurrentWriteError(f"other writers were faster {REBASES} times")


class Transaction:
    """Changes on a copy of the state; files that it writes are unreferenced until it is published."""

    def __init__(self, lake: Lake, state: State):
        self.lake, self.state, self.version = lake, state, None
        self.author = self.message = self.extra_info = None

    def table(self, schema: str, table: str) -> Table:
        return self.lake.table_state(schema, table)

    def create(self, schema: str, table: str, fields: T.StructType, sort_key: Sequence[str] = (), partition_by: Sequence[str] = (), keys: Sequence[str] = ()) -> Table:
        own = Table(sort_key=list(sort_key), partition_by=list(partition_by), keys=list(keys))
        self.state.tables[self.lake.key(schema, table)] = own
        for f in fields:
            self.add_column(own, f.name, f.dataType.simpleString())
        return own

    def add_column(self, own: Table, name: str, kind: str) -> None:
        """A name that an older column had gets another physical one, so old values don't come back."""
        refuse_reserved([name])
        used = {c.physical for c in own.columns} | {p for f in own.files.values() for p in f.types} | {p for x in own.inline for p in json.loads(x["row"])}
        physical = name if name not in used else f"{name}__{own.next_column}"
        own.columns.append(Column(name, "string" if kind == "void" else "timestamp_ntz" if kind == "timestamp" else kind, physical))
        own.next_column += 1

    def drop_column(self, own: Table, name: str) -> None:
        own.columns = [c for c in own.columns if c.name != name]
        own.sort_key = [c for c in own.sort_key if c != name]

    def replace_rows(self, schema: str, table: str, rows: list[dict[str, Any]]) -> None:
        """The rows of a small table, kept in the log."""
        own = self.table(schema, table)
        own.inline = [{"id": own.next_row + i, "row": json.dumps(r)} for i, r in enumerate(rows)]
        own.next_row += len(rows)

    def _prepared(self, own: Table, df: DataFrame, row_ids: bool) -> DataFrame:
        have = set(df.columns)
        columns = [(F.col(quoted(c.name)) if c.name in have else F.lit(None)).cast(c.type).alias(c.physical) for c in own.columns]
        return df.select(*columns, *([ROW] if row_ids else []))

    def _order(self, own: Table) -> list:
        by = [next(c.physical for c in own.columns if c.name == n) for n in own.sort_key]
        return [F.col(quoted(c)).asc_nulls_last() for c in by]

    def _parted(self, own: Table, ready: DataFrame) -> tuple[DataFrame, list[str]]:
        """With a column for each partition expression, the hex of its value: folders are named by it, the columns themselves stay in the file."""
        names = [f"{PART}{i}" for i in range(len(own.partition_by))]
        values = [F.coalesce(F.hex(_partition_value(own, x).cast("string").cast("binary")), F.lit("null")).alias(n) for x, n in zip(own.partition_by, names, strict=True)]
        return (ready.select("*", *values) if names else ready), names

    def _pieces(self, df: DataFrame) -> tuple[int | None, int]:
        """(files of the target size that the bytes of what the rows are read from ask for, these bytes); None if they aren't known."""
        leaves, total = df._jdf.queryExecution().optimizedPlan().collectLeaves(), 0
        for i in range(leaves.size()):
            total += int(leaves.apply(i).stats().sizeInBytes())
        return (None, total) if total >= 1 << 60 else (max(1, -(-total // self.lake.option("target_file_size"))), total)

    def _arranged(self, own: Table, df: DataFrame, parts: list[str], files: int | None, spread: bool) -> DataFrame:
        """Rows by partition value and sort key, nulls last; with ``spread``, files of disjoint ranges of them (a shuffle), about as large as the option says.

        Ranges split whatever one partition value holds too much of: a hot value is many files, each task's.
        """
        order = self._order(own)
        by = [*parts, *(order or ([F.xxhash64(*[F.col(quoted(c.physical)) for c in own.columns])] if parts else []))]
        if files == 1:
            df = df.coalesce(1)
        elif by and spread:
            wanted, size = (files, 0) if files else self._pieces(df)
            if not files and wanted == 1 and size < ONE_FILE_BYTES:
                df = df.coalesce(1)
            else:
                df = df.repartitionByRange(wanted, *by) if wanted and (files or wanted > 1) else df.repartitionByRange(*by)
        elif files:
            df = df.repartition(files)
        return df.sortWithinPartitions(*parts, *order) if by else df

    def _save(self, own: Table, ready: DataFrame, parts: list[str], row_ids: bool) -> list[DataFile]:
        lake, folder = self.lake, f"data/{uuid.uuid4().hex}"
        writer = ready.write.option("compression", lake.option("compression")).option("parquet.block.size", lake.option("row_group_bytes")).option("parquet.writer.version", lake.option("parquet_version"))
        (writer.partitionBy(*parts) if parts else writer).parquet(f"{lake.root}/{folder}")
        return self._measured(own, folder, row_ids)

    def write(self, own: Table, df: DataFrame, row_ids: bool = False, files: int | None = None, spread: bool = True) -> list[DataFile]:
        """Rows as new data files of a table (not yet added to it). ``row_ids``: df has ROW, kept as a column."""
        ready, parts = self._parted(own, self._prepared(own, df, row_ids))
        if files == 1 and own.sort_key and not parts and self._pieces(ready)[0] != 1:
            return self._in_one(own, ready, row_ids)
        return self._save(own, self._arranged(own, ready, parts, files, spread), parts, row_ids)

    def _in_one(self, own: Table, ready: DataFrame, row_ids: bool) -> list[DataFile]:
        """More than the target size as one file: ranges are sorted by a task each and kept on disk, and one task writes them one after the other."""
        ranges = self._arranged(own, ready, [], None, True).persist(StorageLevel.DISK_ONLY)
        try:
            ranges.count()
            # Partitions that are all kept, or none, are joined in their order.
            return self._save(own, ranges.coalesce(1), [], row_ids)
        finally:
            ranges.unpersist()

    def rewrite(self, own: Table, groups: Sequence[Sequence[DataFile]]) -> list[DataFile]:
        """The live rows of each group of files as one new file (one a partition value, if it has several): JOB_GROUPS groups a job, a task each."""
        spark, out = self.lake.spark, []
        # A union of single partitions would else count as single itself, and put all groups in one task.
        name = "spark.sql.unionOutputPartitioning"
        before = spark.conf.get(name, None)
        spark.conf.set(name, "false")
        try:
            for at in range(0, len(groups), JOB_GROUPS):
                frames = []
                for group in groups[at : at + JOB_GROUPS]:
                    rows = self.lake.scan(own, internal=True, files=group, inline=False).drop(FILE, POSITION)
                    ready, parts = self._parted(own, self._prepared(own, rows, True))
                    frames.append(self._arranged(own, ready, parts, 1, False))
                out += self._save(own, reduce(lambda a, b: a.union(b), frames), parts, True)
        finally:
            spark.conf.unset(name) if before is None else spark.conf.set(name, before)
        return out

    def _measured(self, own: Table, folder: str, row_ids: bool) -> list[DataFile]:
        """The written files with their rows, sizes and ranges: of a few files from their footers, of more by one column-pruned job.

        Long texts are bounded by their first characters.
        """
        lake = self.lake
        sizes = {p: s for p, (s, _) in lake.log.listing(folder, deep=True).items() if p.rsplit("/", 1)[-1].startswith("part-")}
        types = {c.physical: c.type for c in own.columns}
        key = [c.physical for c in own.columns if c.name in {*own.sort_key, *own.keys} or any(c.name in x for x in own.partition_by)]
        ranged = list(dict.fromkeys([*key, *list(types)[:RANGED]]))
        ranged = [p for p in ranged if re.match(r"(tinyint|smallint|int|bigint|float|double|string|date|timestamp_ntz)$", types[p])]
        found = {p: self._footer(p, {r: types[r] for r in ranged}) for p in sizes} if len(sizes) <= FOOTERS else self._scanned(own, folder, types, ranged)
        out = []
        for path in sorted(sizes):
            rows, ranges = found.get(path, (0, {}))
            if not rows:
                continue
            out.append(DataFile(path, rows, sizes[path], types, ranges, None if row_ids else own.next_row, self.state.version + 1))
            if not row_ids:
                own.next_row += rows
        return out

    def _footer(self, path: str, types: dict[str, str]) -> tuple[int, dict[str, list]]:
        """(rows, ranges) of one Parquet file, by the statistics of its row groups; a column without them has no range."""
        files = self.lake.log.files
        parquet = files.jvm.org.apache.parquet.hadoop
        reader = parquet.ParquetFileReader.open(parquet.util.HadoopInputFile.fromPath(files.path(path), files.conf))
        try:
            blocks, rows = reader.getFooter().getBlocks(), 0
            ends: dict[str, list] = {p: [] for p in types}
            unknown = set()
            for block in blocks:
                rows += block.getRowCount()
                for column in block.getColumns():
                    name = ".".join(column.getPath().toArray())
                    if name not in types:
                        continue
                    stats = column.getStatistics()
                    if stats.hasNonNullValue():
                        low, high = stats.genericGetMin(), stats.genericGetMax()
                        ends[name] += [low.toStringUsingUTF8(), high.toStringUsingUTF8()] if types[name] == "string" else [low, high]
                    elif stats.getNumNulls() < block.getRowCount():
                        unknown.add(name)
        finally:
            reader.close()
        ranges = {}
        for name, kind in types.items():
            low, high = (min(ends[name]), max(ends[name])) if ends[name] and name not in unknown else (None, None)
            if low is not None and kind == "date":
                low, high = (date(1970, 1, 1) + timedelta(days=x) for x in (low, high))
            elif low is not None and kind == "timestamp_ntz":
                low, high = (datetime(1970, 1, 1) + timedelta(microseconds=x) for x in (low, high))
            ranges[name] = _bounds(low, high)
        return rows, ranges

    def _scanned(self, own: Table, folder: str, types: dict[str, str], ranged: list[str]) -> dict[str, tuple[int, dict[str, list]]]:
        lake = self.lake
        schema = T.StructType([T.StructField(p, T._parse_datatype_string(t)) for p, t in types.items()])
        df = lake.spark.read.schema(schema).parquet(f"{lake.root}/{folder}")
        # One character more than is kept, to see whether there are more.
        shown = [F.substring(quoted(p), 1, BOUND_CHARS + 1) if types[p] == "string" else F.col(quoted(p)) for p in ranged]
        aggregates = [f(x).alias(f"{n}{i}") for i, x in enumerate(shown) for n, f in (("lo", F.min), ("hi", F.max))]
        name = f"{RESERVED}name"
        rows = df.groupBy(_below(2 + len(own.partition_by)).alias(name)).agg(F.count(F.lit(1)).alias("rows"), *aggregates).collect()
        return {r[name]: (r["rows"], {p: _bounds(r[f"lo{i}"], r[f"hi{i}"]) for i, p in enumerate(ranged)}) for r in rows}

    def insert(self, own: Table, df: DataFrame, files: int | None = None) -> int:
        """Add rows; few enough go to the log."""
        limit = self.lake.option("data_inlining_row_limit")
        if limit:
            rows = self._prepared(own, df, False).limit(limit + 1).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).collect()
            if len(rows) <= limit:
                own.inline = own.inline + [{"id": own.next_row + i, "row": r["j"]} for i, r in enumerate(rows)]
                own.next_row += len(rows)
                return len(rows)
        written = self.write(own, df, files=files)
        own.files |= {f.path: f for f in written}
        return sum(f.rows for f in written)

    def delete_positions(self, own: Table, matched: DataFrame) -> int:
        """Tombstones for rows (FILE, POSITION, ROW); a file without rows left is removed whole."""
        lake = self.lake
        inline = {r[0] for r in matched.filter(F.col(FILE).isNull()).select(ROW).limit(len(own.inline)).collect()} if own.inline else set()
        own.inline = [x for x in own.inline if x["id"] not in inline]
        gone = matched.filter(F.col(FILE).isNotNull())
        counts = {r[FILE]: r["count"] for r in gone.groupBy(FILE).count().collect()}
        dead: dict[str, int] = {}
        for d in own.live_deletes():
            dead[d.target] = dead.get(d.target, 0) + d.rows
        full = {p for p, n in counts.items() if n + dead.get(p, 0) >= own.files[p].rows}
        partly = {p: n for p, n in counts.items() if p not in full}
        if partly:
            folder = f"deletes/{uuid.uuid4().hex}"
            rows = gone.filter(~F.col(FILE).isin(sorted(full))) if 0 < len(full) <= 1000 else gone
            rows = rows.select(F.col(FILE).alias("file"), F.col(POSITION).alias("position"))
            one = sum(partly.values()) <= ONE_FILE_DELETES
            (rows.coalesce(1) if one else rows).write.parquet(f"{lake.root}/{folder}")
            # A tombstone file may name several targets: each gets an entry with its own share.
            parts = {p: s for p, (s, _) in lake.log.listing(folder).items() if p.rsplit("/", 1)[-1].startswith("part-")}
            if one and len(parts) == 1:
                shares = [(p, next(iter(parts)), n) for p, n in partly.items()]
            else:
                name = F.element_at(F.split("_metadata.file_path", "/"), -1)
                found = lake.spark.read.parquet(f"{lake.root}/{folder}").groupBy("file", name.alias("name")).count().collect()
                shares = [(r["file"], f"{folder}/{r['name']}", r["count"]) for r in found if r["file"] in partly]
            own.deletes = own.deletes + [DeleteFile(p, at, n, parts[at], self.state.version + 1) for p, at, n in shares]
        own.files = {p: f for p, f in own.files.items() if p not in full}
        own.deletes = own.live_deletes()
        return sum(counts.values()) + len(inline)

    def replace_files(self, own: Table, old: Sequence[str], new: list[DataFile]) -> None:
        own.files = {p: f for p, f in own.files.items() if p not in set(old)} | {f.path: f for f in new}
        own.deletes = own.live_deletes()


def _partition_value(own: Table, text: str):
    """A partition expression: a column, year/month/day/hour of one, or bucket(n, column)."""
    found = re.fullmatch(r"(?:(year|month|day|hour)\((.+)\)|bucket\((\d+)\s*,\s*(.+)\)|(.+))", text.strip())
    name = (found[2] or found[4] or found[5]).strip()
    column = own.column(name)
    if column is None:
        raise ValueError(f"unknown partition column {name}")
    col = F.col(quoted(column.physical))
    if found[1]:
        return {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour}[found[1]](col)
    return F.pmod(F.hash(col), F.lit(int(found[3]))) if found[3] else col


def _below(slashes: int):
    """A row's file as a path below the root, with so many slashes."""
    return F.substring_index("_metadata.file_path", "/", -slashes - 1)


def _bounds(low: Any, high: Any) -> list:
    """Plain bounds of values; of longer texts their first BOUND_CHARS characters, the upper one rounded up (none if it can't be)."""
    low, high = _plain(low), _plain(high)
    if isinstance(low, str):
        low = low[:BOUND_CHARS]
    if isinstance(high, str) and len(high) > BOUND_CHARS:
        kept = high[:BOUND_CHARS].rstrip("\U0010ffff")
        after = ord(kept[-1]) + 1 if kept else None
        high = None if after is None else kept[:-1] + chr(0xE000 if 0xD800 <= after <= 0xDFFF else after)
    return [low, high]


def partition_of(file: DataFile) -> tuple[str, ...]:
    """The folders that name a file's partition values; none if it wasn't written by any."""
    return tuple(x for x in file.path.split("/") if x.startswith(PART))


def _plain(value: Any) -> Any:
    """A bound as plain JSON; NaN bounds nothing."""
    if isinstance(value, float) and math.isnan(value):
        return None
    return value if value is None or isinstance(value, int | float | str) else str(value)


def _typed(value: Any, kind: str) -> Any:
    """A logged bound as a value that only compares with its own kind: text never prunes dates."""
    if value is None:
        return None
    return date.fromisoformat(value) if kind == "date" else datetime.fromisoformat(value) if kind == "timestamp_ntz" else value
