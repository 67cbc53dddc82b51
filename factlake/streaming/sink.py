"""A result set as the sink of a stream: each micro-batch is an upsert by primary key, so a replay changes nothing."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from factlake.operators.updater import Updater


def upsert_stream(updater: Updater, stream: DataFrame, checkpoint: str, keep: str = "last", order_by: list | None = None, **trigger: Any) -> StreamingQuery:
    """Start upserting a stream. A batch that is refused fails the query."""

    def batch(df: DataFrame, number: int) -> None:
        if not updater.update_database(df, keep=keep, order_by=order_by, run_id=f"stream-{number}"):
            raise RuntimeError(f"micro-batch {number} wasn't written")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
