"""Queries over orders whose keys go on beyond the shifts that the queries add, so that their batches repeat keys, against their SQL."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from factlake.sources.lake import Lake, Transaction

SOURCE = "/root/testdata/sf0.01/orders.parquet"
#: Queries whose rows differed from their SQL's there, or that failed.
MET = [
    "add_columns_outer_merge",
    "flushed_rows",
    "compaction_result",
    "inlined_rows_result",
    "joined_transaction",
    "recluster_file_ranges",
    "report_measures",
    "storage_measures",
    "storage_report_row",
    "streaming_upsert",
    "table_changes_counts",
    "upsert_change_counts",
    "upsert_result",
    "upsert_then_compact",
]


@pytest.fixture(scope="module")
def grown(tmp_path_factory):
    """The orders three times: keys as they are, and from 1,000,000 and 5,000,000 on, with other prices."""
    folder = tmp_path_factory.mktemp("grown")
    parts = " UNION ALL ".join(f"SELECT o_orderkey + {by} AS o_orderkey, o_custkey, o_orderstatus, o_totalprice + {by // 1000} AS o_totalprice, o_orderdate, o_orderpriority FROM '{SOURCE}'" for by in (0, 1_000_000, 5_000_000))
    duckdb.sql(f"COPY ({parts}) TO '{folder}/orders.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", MET)
def test_query_gives_the_rows_of_its_sql(spark, grown, name):
    found = entry.queries()[name](spark, grown)
    with duckdb.connect() as own:
        own.execute(f"CREATE VIEW orders AS SELECT * FROM '{grown}/orders.parquet'")
        wanted = own.sql(entry.oracle_sql()[name])
        assert found.columns == wanted.columns
        assert Counter(map(tuple, found.collect())) == Counter(wanted.fetchall())


def test_one_large_file_is_sorted_by_several_tasks(spark, tmp_path):
    """The task that writes it sorts nothing: the ranges before it do, as many as the target size asks for."""
    spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("id"), F.col("id").alias("v")).write.parquet(str(tmp_path / "rows"))
    lake = Lake(spark, str(tmp_path / "lake"), options={"target_file_size": 20_000})
    seen = []

    class Watched(Transaction):
        def _save(self, own, ready, parts, row_ids):
            plan = ready._jdf.queryExecution().optimizedPlan()
            seen.append((plan.nodeName(), "InMemoryRelation" in plan.toString(), ready.rdd.glom().map(len).collect()))
            return super()._save(own, ready, parts, row_ids)

    rows = spark.read.parquet(str(tmp_path / "rows"))
    with lake.transaction() as t:
        t.__class__ = Watched
        own = t.create("main", "fact_table", rows.schema, ["id"])
        t.insert(own, rows, files=1)
    (file,) = lake.table_state("main", "fact_table").files.values()
    found = [r.id for r in spark.read.parquet(f"{lake.root}/{file.path}").coalesce(1).collect()]
    assert found == sorted(found) and len(set(found)) == file.rows == 20_000
    assert seen == [("Repartition", True, [20_000])]
