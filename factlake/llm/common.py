"""What the operators share: checkpoints, shared folders, Arrow batch bounds, free column names."""

from __future__ import annotations

import gc
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch handed to a Python worker, so that very long texts don't pile up.
ARROW_BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession, limit: int = ARROW_BATCH_BYTES) -> None:
    """Bound Arrow batches by bytes as well as by rows (the default bounds rows only)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(limit))


_KEPT: list[Callable[[], None]] = []


def sole_cache(clear: Callable[[], None] | None) -> None:
    """Called in a Python worker: drops what another operator keeps there. ``clear`` drops what the calling one will keep, if it keeps anything."""
    while _KEPT and _KEPT[-1] != clear:
        _KEPT.pop()()
    if clear and not _KEPT:
        _KEPT.append(clear)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the session (``spark.checkpoint.dir``); only a local session has a default for it."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None)
    if root is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file:///tmp/checkpoints/factlake"
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """``df`` behind an eager reliable checkpoint: its lineage ends in the shared folder."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffles of finished steps now, not when the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for written tables, below the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/factlake/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete what scratch() named."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until no column of ``df`` has it (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
