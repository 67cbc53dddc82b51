"""Size-tiered compaction of an append-only store of shards, under versioned manifests.

Arrivals are written as small immutable Parquet shards. Shards below the target size fall into tiers, by the logarithm of
their size; when a tier has ``FANOUT`` shards, they are merged in groups of about the target size. A merged shard falls into a
higher tier, so each row is rewritten a logarithmic number of times. A manifest lists the shards of a version; the next version is
published under a name that is given away once, so readers see a whole version or the one before, and two writers can't publish the same.
By default that is a rename that refuses an existing target, which HDFS and local disks have; over a plain object store, which hasn't, manifests
belong in a database (``store``). Merging reads whole shards and writes one file a group, with no shuffle.

A lost executor's task is run again under Spark's committer; a job that dies leaves files that no manifest names, for vacuum().

Defined results: rows come back as they arrived, nulls and repeats included, in no order; an empty arrival adds no rows but
fixes the schema of a new store; an arrival with other columns than the store's raises. Columns can have any names: located() lengthens its own.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlake.llm.common import free_name
from factlake.sources.stores import Folder, LogStore

TARGET_BYTES = 128 << 20
SMALLEST_BYTES = 1 << 20
FANOUT = 4
#: From this share of the target on a shard is left as it is.
FULL = 0.75
#: Groups merged in one job: each is a branch of its plan.
JOB_GROUPS = 64
#: Arrivals of which a table is made to come, and the rows that a shard of one has at most.
ARRIVALS, ARRIVAL_ROWS = 8, 4096


class CommitConflict(RuntimeError):
    """Another writer removed what this one has merged."""


@dataclass(frozen=True)
class Shard:
    path: str  # below the store's root
    bytes: int
    arrival: int  # the version that brought it


def tier(size: int, fanout: int = FANOUT) -> int:
    """0 below SMALLEST_BYTES times the fan-out, then one more for each further factor of it."""
    return max(0, int(math.log(max(size, 1) / SMALLEST_BYTES, fanout))) if size > SMALLEST_BYTES else 0


def plan(shards: list[Shard], target: int = TARGET_BYTES, fanout: int = FANOUT) -> list[list[Shard]]:
    """Groups to merge: of each tier with at least ``fanout`` shards, its shards in order of arrival, up to the target size."""
    tiers: dict[int, list[Shard]] = {}
    for shard in shards:
        if shard.bytes < FULL * target:
            tiers.setdefault(tier(shard.bytes, fanout), []).append(shard)
    groups = []
    for _, own in sorted(tiers.items()):
        if len(own) < fanout:
            continue
        group: list[Shard] = []
        size = 0
        for shard in sorted(own, key=lambda s: (s.arrival, s.path)):
            if group and size + shard.bytes > target:
                groups.append(group)
                group, size = [], 0
            group.append(shard)
            size += shard.bytes
        groups.append(group)
    return [g for g in groups if len(g) > 1]


class ShardStore:
    """A store below ``root``, on any file system that Spark reaches; its manifests are files there, or in ``store``."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET_BYTES, fanout: int = FANOUT, store: LogStore | None = None):
        self.spark, self.root, self.target, self.fanout = spark, root.rstrip("/"), target, fanout
        self.files = Folder(spark, root, "manifests")
        self.store: LogStore = store or self.files
        self.store.prepare()

    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self.store.names() if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> tuple[int, str | None, list[Shard]]:
        """(version, schema, shards) of a version, the last one by default; version 0 is the empty store."""
        known = self.versions()
        version = known[-1] if version is None and known else version or 0
        if not version:
            return 0, None, []
        found = json.loads(self.store.get(f"v{version:020d}.json"))
        return version, found["schema"], [Shard(**s) for s in found["shards"]]

    def _publish(self, version: int, schema: str, shards: list[Shard]) -> bool:
        """Whether this call made the version: false if another writer had made it."""
        return self.store.put(f"v{version:020d}.json", json.dumps({"version": version, "schema": schema, "shards": [asdict(s) for s in shards]}))

    def _commit(self, schema: str, removed: set[str], added: list[Shard]) -> int:
        while True:
            version, old, shards = self.manifest()
            if old is not None and T.StructType.fromJson(json.loads(old)).simpleString() != T.StructType.fromJson(json.loads(schema)).simpleString():
                raise ValueError("the arrival's columns differ from the store's")
            if not removed <= {s.path for s in shards}:
                raise CommitConflict("merged shards are no longer in the store")
            left = [s for s in shards if s.path not in removed]
            mine = [Shard(s.path, s.bytes, s.arrival or version + 1) for s in added]
            if self._publish(version + 1, old or schema, left + mine):
                return version + 1

    def _written(self, below: str, arrival: int) -> list[Shard]:
        found = self.files.fs().listStatus(self.files.path(below))
        return [Shard(f"{below}/{x.getPath().getName()}", x.getLen(), arrival) for x in found if x.getPath().getName().startswith("part-")]

    def append(self, arrival: DataFrame) -> int:
        """The version that holds the arrival, one shard for each of its partitions."""
        below = f"data/{uuid.uuid4().hex}"
        arrival.write.parquet(f"{self.root}/{below}")
        return self._commit(arrival.schema.json(), set(), self._written(below, 0))

    def append_dealt(self, table: DataFrame, arrivals: int = ARRIVALS, rows: int = ARRIVAL_ROWS) -> int:
        """The version after a table has arrived in ``arrivals`` batches, each a version of its own, of shards of at most ``rows`` rows.

        One job writes all shards, each task one after another; however few files or tasks the table has, it is cut into at least as many
        shards as there are arrivals (if it has the rows), and they are dealt to the arrivals in turn.
        """
        below = f"data/{uuid.uuid4().hex}"
        most = max(1, min(rows, -(-table.count() // arrivals)))
        table.write.option("maxRecordsPerFile", most).parquet(f"{self.root}/{below}")
        shards, schema = sorted(self._written(below, 0), key=lambda s: s.path), table.schema.json()
        for i in range(arrivals):
            version = self._commit(schema, set(), shards[i::arrivals])
        return version

    def compact(self) -> int:
        """Merge until no tier is full; the last version."""
        while True:
            version, schema, shards = self.manifest()
            groups = plan(shards, self.target, self.fanout)
            if not groups:
                return version
            for at in range(0, len(groups), JOB_GROUPS):
                some = groups[at : at + JOB_GROUPS]
                below = f"data/{uuid.uuid4().hex}"
                self._merge(schema, some, f"{self.root}/{below}")
                version = self._commit(schema, {s.path for g in some for s in g}, self._written(below, min(s.arrival for g in some for s in g)))

    def _merge(self, schema: str, groups: list[list[Shard]], path: str) -> None:
        """One task and one file a group. A union of single partitions would otherwise count as single itself, and put all groups in one task."""
        before = self.spark.conf.get("spark.sql.unionOutputPartitioning", None)
        self.spark.conf.set("spark.sql.unionOutputPartitioning", "false")
        try:
            merged = None
            for group in groups:
                one = self._scan(schema, group).coalesce(1)
                merged = one if merged is None else merged.union(one)
            merged.write.parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset("spark.sql.unionOutputPartitioning")
            else:
                self.spark.conf.set("spark.sql.unionOutputPartitioning", before)

    def _scan(self, schema: str, shards: list[Shard]) -> DataFrame:
        return self.spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(*[f"{self.root}/{s.path}" for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        _, schema, shards = self.manifest(version)
        if schema is None:
            raise ValueError("the store has no version")
        if not shards:
            return self.spark.createDataFrame([], T.StructType.fromJson(json.loads(schema)))
        return self._scan(schema, shards)

    def located(self, version: int | None = None) -> DataFrame:
        """The rows of a version with the path of their shard below the root (``shard``)."""
        own = self.read(version)
        return own.withColumn(free_name(own, "shard"), F.substring_index("_metadata.file_path", "/", -3))

    def settled(self) -> bool:
        """Whether no tier of the last version is full."""
        return not plan(self.manifest()[2], self.target, self.fanout)

    def vacuum(self, keep: int = 2) -> int:
        """Delete shards that none of the last ``keep`` versions names, and older manifests; the number of files deleted.

        Not to be run while another writer has written shards that it hasn't committed.
        """
        known, fs = self.versions(), self.files.fs()
        kept = {s.path for v in known[-keep:] for s in self.manifest(v)[2]}
        gone, data = 0, self.files.path("data")
        for folder in fs.listStatus(data) if fs.exists(data) else []:
            name = folder.getPath().getName()
            files = self._written(f"data/{name}", 0)
            for shard in files:
                if shard.path not in kept:
                    gone += bool(fs.delete(self.files.path(shard.path), False))
            if not any(s.path in kept for s in files):
                fs.delete(folder.getPath(), True)
        for v in known[:-keep]:
            self.store.drop(f"v{v:020d}.json")
        return gone
