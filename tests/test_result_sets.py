"""Result sets on a real lake: builds, upserts, deletes, links, audits, storage and recovery, with their errors."""

from __future__ import annotations

import datetime as dt
import warnings

import pytest
from pyspark.sql import functions as F

from factlake.functions import links
from factlake.functions.duplicates import remove_duplicates, repeated_keys
from factlake.functions.filters import delete_filter, to_column
from factlake.functions.types import compatible, sql_type, wider
from factlake.operators.audit import Auditor, Level, Severity
from factlake.operators.base import ResultSet
from factlake.operators.builder import ResultSetBuilder
from factlake.operators.deleter import Deleter
from factlake.operators.maintenance import Maintenance, MaintenancePolicy, overlap_ratio
from factlake.operators.recovery import Recovery
from factlake.operators.updater import Updater
from factlake.sources.connect import connect, postgres_options, s3_explicit
from factlake.sources.lake import Lake, normal_root, schema_parts
from factlake.sources.log import ConcurrentWriteError, LogStoreType

SAMPLE = "id long, category string, value double, date date, status string, high_cardinality string"
ROWS = [(i, "ABACB"[i - 1], i / 10, dt.date(2024, 1, i), "inactive" if i == 2 else "active", f"val_{99 + i}") for i in range(1, 6)]


@pytest.fixture
def lake(spark, tmp_path):
    return Lake(spark, str(tmp_path / "lake"))


@pytest.fixture
def sample(spark):
    return spark.createDataFrame(ROWS, SAMPLE)


@pytest.fixture
def built(lake, sample):
    ResultSetBuilder(lake, sample, categorical_threshold=4, primary_keys=["id"]).build_schema()
    return lake


def rows(lake, schema="main", **options):
    return sorted(map(tuple, lake.table(schema, **options).collect()))


# --- building --------------------------------------------------------------------------------------------------------------


def test_build_writes_three_tables_in_one_snapshot(lake, sample):
    report = ResultSetBuilder(lake, sample, categorical_threshold=4, primary_keys=["id"], label="Sample").build_schema(column_labels={"id": "Identifier"}, run_id="r1")
    own = ResultSet(lake)
    assert rows(lake) == sorted(ROWS) and lake.log.versions() == [1] and report.rows_inserted == 5 and report.success
    assert set(own.categorical_columns()) == {"category", "status"} and own.primary_keys() == ["id"] and own.cluster_by() == ["id"]
    assert [m["label"] for m in own.metadata()] == sorted(m["label"] for m in own.metadata())
    assert own.dataset()["label"] == "Sample" and lake.table("main", "dataset_metadata").count() == 1
    assert lake.table("main", "metadata").filter("unit IS NULL").count() == 6
    assert lake.snapshots().first().author == "r1"


def test_build_keeps_decimal_parameters(spark, lake):
    df = spark.sql("SELECT 1L AS id, CAST(1.5 AS DECIMAL(10,2)) AS price, CAST(3 AS SMALLINT) AS small")
    ResultSetBuilder(lake, df, primary_keys=["id"]).build_schema()
    assert {m["name"]: m["sql_type"] for m in ResultSet(lake).metadata()} == {"id": "BIGINT", "price": "DECIMAL(10,2)", "small": "SMALLINT"}


@pytest.mark.parametrize(("keep", "ids"), [("none", [3]), ("any", [1, 2, 3]), ("first", [1, 2, 3]), ("last", [1, 2, 3])])
def test_duplicates_of_the_key(spark, lake, keep, ids):
    df = spark.createDataFrame([(1, "A", 10.0), (2, "B", 20.0), (3, "A", 30.0), (1, "A", 10.0), (2, "B", 20.0)], "id long, category string, value double")
    ResultSetBuilder(lake, df, primary_keys=["id"]).build_schema(keep=keep)
    assert [r[0] for r in rows(lake)] == ids


def test_build_refuses(spark, lake, sample):
    with pytest.raises(ValueError, match="primary_keys"):
        ResultSetBuilder(lake, sample, primary_keys=["nope"])
    with pytest.warns(UserWarning, match="no primary key"):
        ResultSetBuilder(lake, sample)
    with pytest.raises(ValueError, match="cycle"):
        ResultSetBuilder(lake, sample, primary_keys=["id"], hierarchies={"category": "status", "status": "category"}).infer_metadata()
    with pytest.raises(ValueError, match="aren't supported"):
        ResultSetBuilder(lake, spark.sql("SELECT 1 AS id, array(1) AS nested, map(1, 2) AS m"), primary_keys=["id"])
    with pytest.raises(ValueError, match="isn't unique"):
        ResultSetBuilder(lake, sample.union(sample), primary_keys=["id"]).build_schema(check_duplicates=False)
    with pytest.raises(ValueError, match="aggregation"):
        ResultSetBuilder(lake, sample, primary_keys=["id"]).infer_metadata(column_metadata={"value": {"default_aggregation": "P99"}})
    with pytest.raises(ValueError, match="determine"):
        ResultSetBuilder(lake, sample, primary_keys=["id"], value_labels={"high_cardinality": "category"}).build_schema()
    assert lake.log.versions() == []  # nothing of it stays


def test_sorted_build_has_disjoint_files(spark, lake):
    df = spark.range(5000).select("id", (F.col("id") * 7919 % 1000).alias("k"))
    ResultSetBuilder(lake, df, primary_keys=["id"]).build_schema(check_duplicates=False, cluster_by=["k"], files=3)
    ranges = Maintenance(lake).file_ranges(lake.table_state("main", "fact_table"), "k")
    assert len(ranges) == 3 and overlap_ratio(ranges) == 0.0


# --- upserts ---------------------------------------------------------------------------------------------------------------


def batch(spark, *given):
    return spark.createDataFrame(list(given), SAMPLE)


CHANGED = (1, "A", 99.0, dt.date(2024, 1, 1), "active", "val_100")
NEW = (10, "A", 1.5, dt.date(2024, 3, 1), "active", "val_300")


def test_upsert_writes_only_what_changes(spark, built):
    updater = Updater(built)
    assert updater.update_database(batch(spark, CHANGED, ROWS[1], NEW), run_id="r2")
    r = updater.last_report
    assert (r.rows_inserted, r.rows_updated, r.rows_before, r.rows_after) == (1, 1, 5, 6)
    assert rows(built) == sorted([CHANGED, *ROWS[1:], NEW])
    changes = {(x.change_type, x.id) for x in built.changes("main", "fact_table", 2, 2).collect()}
    assert changes == {("update_preimage", 1), ("update_postimage", 1), ("insert", 10)}


def test_upsert_twice_changes_nothing_more(spark, built):
    updater = Updater(built)
    for _ in range(2):
        updater.update_database(batch(spark, CHANGED, NEW))
    assert (updater.last_report.rows_inserted, updater.last_report.rows_updated) == (0, 0) and rows(built) == sorted([CHANGED, *ROWS[1:], NEW])


def test_upsert_sees_nulls_as_values(spark, built):
    df = spark.createDataFrame([(1, None), (2, 0.2)], "id long, value double")
    updater = Updater(built)
    updater.update_database(df)
    assert updater.last_report.rows_updated == 1 and built.table("main").filter("id = 1").first().value is None


def test_upsert_refusals_leave_the_lake_alone(spark, built):
    updater, before = Updater(built), built.state.version
    for df, match in (
        (spark.createDataFrame([(1,)], "value long"), "lacks key"),
        (spark.createDataFrame([(None, 1.0)], "id long, value double"), "null keys"),
        (spark.createDataFrame([(1, 1.0)], "id long, other double"), "unknown columns"),
    ):
        with pytest.raises(ValueError, match=match):
            updater.update_database(df)
    with pytest.raises(ValueError, match="repeated"):
        updater.update_database(batch(spark, NEW, NEW), check_duplicates_update=False)
    assert updater.update_database(batch(spark, NEW, NEW)) and "no rows" in updater.last_report.warnings[0]
    assert built.state.version == before


def test_a_failing_write_is_false_and_rolled_back(spark, built, monkeypatch):
    updater, before = Updater(built), rows(built)
    monkeypatch.setattr("factlake.sources.lake.Transaction.delete_positions", lambda *a: 1 / 0)
    assert updater.update_database(batch(spark, CHANGED)) is False
    assert rows(built) == before and not updater.last_report.success


def test_two_writers_of_one_version(spark, built):
    other = Lake(spark, built.root)
    _ = other.state
    with pytest.raises(ConcurrentWriteError, match="as well"), other.transaction() as t:
        t.table("main", "fact_table").sort_key = []
        Deleter(built).delete_rows("id = 1", perform_cleanup=False)
    assert len(rows(built)) == 4


def test_writers_of_different_tables_both_commit(spark, built, sample):
    other = Lake(spark, built.root)
    with other.transaction() as t:
        t.state.options["x"] = 1
        ResultSetBuilder(other, sample, "elsewhere", primary_keys=["id"]).build_schema()
        Deleter(built).delete_rows("id = 1", perform_cleanup=False)
    assert built.option("x") == 1 and len(rows(built)) == 4 and len(rows(built, "elsewhere")) == 5
    assert {f.added for f in built.table_state("elsewhere", "fact_table").files.values()} == {built.state.version}


def test_an_upsert_that_meets_another_is_done_anew(spark, built, monkeypatch):
    updater, met = Updater(built), []
    plain = Updater._upsert

    def slow(self, *args):
        if not met:
            met.append(Deleter(Lake(spark, built.root)).delete_rows("id = 2", perform_cleanup=False))
        return plain(self, *args)

    monkeypatch.setattr(Updater, "_upsert", slow)
    assert updater.update_database(batch(spark, CHANGED, NEW))
    assert rows(built) == sorted([CHANGED, *ROWS[2:], NEW])


def test_new_columns_and_widening(spark, built):
    df = spark.createDataFrame([(1, "x", 2**40)], "id long, extra string, status long")
    with pytest.raises(ValueError):
        Updater(built).update_database(df)
    updater = Updater(built)
    assert updater.update_database(spark.createDataFrame([(1, "x")], "id long, extra string"), allow_new_columns=True, column_metadata={"extra": {"unit": "kg"}})
    assert updater.last_report.columns_added == ["extra"] and [m["unit"] for m in updater.metadata() if m["name"] == "extra"] == ["kg"]
    assert updater.update_database(spark.createDataFrame([(2, "many")], "id long, value string"))
    assert updater.last_report.changes == ["sql_type(value): DOUBLE -> VARCHAR"] and built.table("main").filter("id = 2").first().value == "many"


def test_add_columns_is_an_outer_merge(spark, built):
    updater = Updater(built)
    updater.add_columns(spark.createDataFrame([(1, 5), (77, 6)], "id long, score int"))
    found = {r.id: (r.category, r.score) for r in built.table("main").collect()}
    assert found[1] == ("A", 5) and found[77] == (None, 6) and found[2] == ("B", None)
    with pytest.raises(ValueError, match="overwrite"):
        updater.add_columns(spark.createDataFrame([(1, 5)], "id long, score int"))
    with pytest.raises(ValueError, match="value column"):
        updater.add_columns(spark.createDataFrame([(1,)], "id long"))


# --- labels and hierarchies ------------------------------------------------------------------------------------------------


@pytest.fixture
def coded(spark, lake):
    df = spark.createDataFrame([(1, "01", "Chevaux", 1.0), (2, "01", "Chevaux", 2.0), (3, "02", "Bovins", 3.0)], "id long, nc8 string, nc8_libelle string, value double")
    ResultSetBuilder(lake, df, primary_keys=["id"], value_labels={"nc8_libelle": "nc8"}).build_schema()
    return lake


def test_labels_must_follow_codes(spark, coded):
    updater = Updater(coded)
    for df in (
        spark.createDataFrame([(1, "NewLabel")], "id long, nc8_libelle string"),
        spark.createDataFrame([(4, "01", 4.0)], "id long, nc8 string, value double"),
        spark.createDataFrame([(1, "02")], "id long, nc8 string"),
    ):
        with pytest.raises(ValueError, match="update_value_labels"):
            updater.update_database(df)
    assert coded.log.versions() == [1]
    assert updater.update_database(spark.createDataFrame([(1, "N"), (2, "N")], "id long, nc8_libelle string"))


def test_relabelling(spark, coded):
    report = Updater(coded).update_value_labels("nc8_libelle", spark.createDataFrame([("01", "Reproducteurs"), ("99", "none")], "nc8 string, nc8_libelle string"))
    assert report.rows_updated == 2 and "1 codes" in report.warnings[0]
    assert [r[2] for r in rows(coded)] == ["Reproducteurs", "Reproducteurs", "Bovins"]
    with pytest.raises(ValueError):
        Updater(coded).update_value_labels("value", spark.createDataFrame([("01", "x")], "nc8 string, value string"))


def test_dependencies(spark):
    def check(*given, codes=None):
        df = spark.createDataFrame(list(given), "nc8 string, lib string")
        links.check_dependency(df, "nc8", "lib", spark.createDataFrame([(c,) for c in codes], "c string") if codes else None)

    check(("01", "a"), ("01", "a"), ("02", "b"), (None, None))
    for bad in ([("01", "a"), ("01", "b")], [("01", "a"), ("01", None)], [(None, "orphan")]):
        with pytest.raises(ValueError, match="update_value_labels"):
            check(*bad)
    check(("01", "a"), ("01", "b"), ("02", "c"), codes=["02"])


def test_chains():
    assert links.chains({"region": None, "departement": "region", "commune": "departement", "value": None}) == [["region", "departement", "commune"]]
    with pytest.raises(RuntimeError, match="cycle"):
        links.chains({"a": "b", "b": "a", "c": "a"})


def test_column_metadata_is_checked(built):
    own = ResultSet(built)
    own.update_column_metadata("status", parent_name="category", unit="u")
    assert own.column_hierarchies() == [["category", "status"]]
    for fields, match in (({"parent_name": "nope"}, "unknown parent"), ({"label": ""}, "empty"), ({"is_categorical": False}, "hierarchy"), ({"sql_type": "X"}, "can't be set"), ({"label_for": "category"}, "hierarchy|parent")):
        with pytest.raises(ValueError, match=match):
            own.update_column_metadata("status", **fields)


# --- deletes ---------------------------------------------------------------------------------------------------------------


def test_delete_rows_and_empty_columns(spark, lake):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 5)], "id long, kept string, sparse int")
    ResultSetBuilder(lake, df, primary_keys=["id"]).build_schema()
    report = Deleter(lake).delete_rows([("id", "=", 2)])
    assert report.rows_deleted == 1 and report.columns_dropped == ["sparse"] and rows(lake) == [(1, "a")] and len(lake.log.versions()) == 3
    before = lake.state.version
    assert Deleter(lake).delete_rows([("id", ">", 50)]).rows_deleted == 0 and lake.state.version == before
    Deleter(lake).delete_rows("TRUE")
    assert rows(lake) == [] and lake.table_state("main", "fact_table").files == {}
    for bad in (None, {}, [], "", {"a": 1}, [("a", "=", 1), [("b", "=", 2)]]):
        with pytest.raises(ValueError):
            Deleter(lake).delete_rows(bad)


def test_delete_columns(built):
    own = ResultSet(built)
    own.update_column_metadata("status", parent_name="category")
    deleter = Deleter(built)
    for columns in ([], ["nope"], ["id"], ["category"]):
        with pytest.raises(ValueError):
            deleter.delete_columns(columns)
    deleter.delete_columns(["category"], cascade=True)
    assert "category" not in built.table("main").columns and own.parents()["status"] is None


def test_a_dropped_name_comes_back_empty(spark, built):
    Deleter(built).delete_columns(["status"])
    Updater(built).update_database(spark.createDataFrame([(1, "new")], "id long, status string"), allow_new_columns=True)
    assert {r.id: r.status for r in built.table("main").collect()} == {1: "new", 2: None, 3: None, 4: None, 5: None}


# --- filters and types -----------------------------------------------------------------------------------------------------


def test_filters(sample):
    assert sample.filter(to_column([("category", "in", ["A"]), ("value", ">", 0.2)])).count() == 1
    assert sample.filter(to_column([[("id", "=", 1)], [("id", "==", 2)]])).count() == 2
    assert sample.filter(to_column("id <> 1")).count() == 4 and to_column(None) is None
    with pytest.raises(TypeError):
        to_column([("id", "=", 1), [("id", "=", 2)]])
    with pytest.raises(ValueError):
        to_column([("id", "~", 1)])
    assert sample.filter(to_column([("high_cardinality", "like", "%10_"), ("id", "not like", "5")])).count() == 4
    with pytest.raises(ValueError):
        delete_filter(None)


def test_lattice(spark):
    assert wider("INTEGER", "BIGINT") == "BIGINT" and wider("BIGINT", "INTEGER") == "BIGINT" and wider("UINTEGER", "INTEGER") == "BIGINT"
    assert wider("DATE", "VARCHAR") == "DATE" and wider("DOUBLE", "VARCHAR") == "VARCHAR" and wider("BOOLEAN", "TINYINT") == "TINYINT"
    assert compatible("TEXT", "VARCHAR") and compatible("INT8", "BIGINT") and not compatible("DATE", "VARCHAR")
    assert [sql_type(f.dataType) for f in spark.sql("SELECT CAST(1 AS TINYINT), 1.0F, CAST(1 AS DECIMAL(38,0)), timestamp_ntz'2020-01-01', NULL").schema] == ["TINYINT", "FLOAT", "HUGEINT", "TIMESTAMP", "VARCHAR"]


# --- audits ----------------------------------------------------------------------------------------------------------------


def test_audit(built):
    assert Auditor(built).validate_database(Level.COMPREHENSIVE).issues == []
    assert Auditor(built).get_quick_health_check()["status"] == "healthy"
    own = ResultSet(built)
    with built.transaction() as t:
        own.put_metadata(t, [m | {"parent_name": "ghost"} if m["name"] == "value" else m for m in own.metadata() if m["name"] != "status"])
    found = Auditor(built).validate_database("BASIC")
    assert len(found.by_severity(Severity.HIGH)) == 2 and found.recommendations
    assert Auditor(built, "elsewhere").validate_database().critical_count() == 1


def test_basic_audit_reads_no_fact_rows(built, monkeypatch):
    monkeypatch.setattr(Auditor, "fact", lambda self: 1 / 0)
    assert Auditor(built).validate_database(Level.BASIC).issues == []


# --- snapshots and storage -------------------------------------------------------------------------------------------------


def test_time_travel_and_restore(spark, built):
    Updater(built).update_database(spark.createDataFrame([(1, "C", 9.0), (10, "A", 1.0)], "id long, category string, value double"))
    Deleter(built).delete_rows([("id", "=", 2)])
    assert rows(Lake(spark, built.root, version=1)) == sorted(ROWS) and rows(built, version=1) == sorted(ROWS)
    when = built.snapshots().filter("snapshot_id = 1").first().snapshot_time
    assert rows(built, timestamp=when) == sorted(ROWS)
    report = Recovery(built).restore_snapshot(1)
    assert rows(built) == sorted(ROWS) and (report.rows_before, report.rows_after) == (5, 5) and built.log.versions() == [1, 2, 3, 4]
    for arguments in ((99,), (1, []), (1, ["nope"])):
        with pytest.raises(ValueError):
            Recovery(built).restore_snapshot(*arguments)
    Deleter(built).delete_columns(["status"])
    with pytest.raises(ValueError, match="changed"):
        Recovery(built).restore_snapshot(1)
    with pytest.raises(ValueError):
        Lake(spark, built.root, version=1, timestamp=when)
    with pytest.raises(PermissionError):
        Deleter(Lake(spark, built.root, read_only=True)).delete_rows("TRUE")


def test_compaction_keeps_rows(spark, lake):
    ResultSetBuilder(lake, spark.range(2000).select("id", (F.col("id") * 2).alias("v")), primary_keys=["id"]).build_schema()
    for i in range(3):
        Updater(lake).update_database(spark.range(i * 100, i * 100 + 50).select("id", F.lit(-1).cast("long").alias("v")))
    before, keeper = rows(lake), Maintenance(lake)
    assert keeper.storage_report().delete_ratio > 0
    counters = keeper.compact(delete_threshold=0.0)
    assert counters["files_rewritten"] >= 1 and rows(lake) == before and keeper.storage_report().delete_files == 0
    last = lake.state.version
    assert lake.changes("main", "fact_table", last, last).count() == 0  # row ids outlive compaction
    assert keeper.recluster().success and rows(lake) == before
    with pytest.raises(ValueError):
        keeper.recluster(columns=["nope"])


def test_retention(spark, built):
    Updater(built).update_database(batch(spark, CHANGED))
    keeper, before = Maintenance(built), rows(built)
    keeper.recluster()
    assert keeper.expire_snapshots(0, dry_run=True) == [1, 2] and keeper.expire_snapshots(0) == [1, 2]
    assert rows(built) == before and rows(Lake(spark, built.root)) == before
    with pytest.raises(ValueError, match="expired"):
        built.table("main", version=1)
    assert keeper.delete_orphaned_files() == [] and len(keeper.cleanup_files()) >= 2 and rows(built) == before


def test_inlined_rows(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "l"), options={"data_inlining_row_limit": 10})
    ResultSetBuilder(lake, spark.createDataFrame(ROWS, SAMPLE), primary_keys=["id"]).build_schema()
    assert rows(lake) == sorted(ROWS) and lake.table_state("main", "fact_table").files == {}
    Updater(lake).update_database(batch(spark, CHANGED, NEW))
    Deleter(lake).delete_rows([("id", "=", 3)])
    want = sorted([CHANGED, ROWS[1], *ROWS[3:], NEW])
    assert rows(lake) == want
    assert Maintenance(lake).flush_inlined_data() and rows(lake) == want and Maintenance(lake).storage_report().inlined_rows == 0


def test_partitions_and_pruning(spark, lake):
    df = spark.range(1000).select("id", F.expr("date_add(date'2020-01-01', cast(id as int))").alias("day"), (F.col("id") % 3).cast("string").alias("kind"))
    ResultSetBuilder(lake, df, primary_keys=["id"]).build_schema(partition_by=["kind", "year(day)"])
    own = lake.table_state("main", "fact_table")
    assert len(lake.files_for(own, [("kind", "=", "1")])) < len(own.files)
    assert lake.table("main", filters=[("kind", "=", "1"), ("day", "<", dt.date(2020, 1, 11))]).count() == 3
    Maintenance(lake).repartition("fact_table", ["bucket(4, id)"])
    assert lake.table("main").count() == 1000
    with pytest.raises(ValueError):
        Maintenance(lake).set_partitioned_by([])


def test_policy_and_maintain(spark, built):
    for bad in ({"delete_ratio": 2}, {"small_files": -1}, {"max_compacted_files": 0}, {"retention_days": -1}):
        with pytest.raises(ValueError):
            MaintenancePolicy(**bad)
    Updater(built).update_database(batch(spark, CHANGED))
    planned = Maintenance(built).maintain(MaintenancePolicy(delete_ratio=0.0), dry_run=True)
    assert planned.maintenance["rewrite_planned"] and built.state.version == 2
    done = Maintenance(built).maintain(MaintenancePolicy(delete_ratio=0.0, small_files=2))
    assert "rewrite" in done.maintenance and "expire_skipped" in done.maintenance and "ok" in done.summary()


@pytest.mark.parametrize("ranges", [[], [(1, 1)], [(0, 10), (10, 20), (15, 30), (40, 50), (40, 50)], [(0, 100), (1, 2), (3, 4), (100, 101)], [(5, 5), (5, 5), (1, 9)]])
def test_overlap_equals_the_pairwise_definition(ranges):
    hit = {i for i, a in enumerate(ranges) for j, b in enumerate(ranges) if i != j and ((b[0] < a[1] and a[0] < b[1]) or a == b)}
    assert overlap_ratio(ranges) == (len(hit) / len(ranges) if len(ranges) > 1 else 0.0)


# --- namespaces and settings -----------------------------------------------------------------------------------------------


def test_schemas_and_lakes_never_mix(spark, tmp_path, sample):
    one, two = Lake(spark, str(tmp_path / "a")), Lake(spark, str(tmp_path / "b"))
    for lake, schema, df in ((one, "sales.europe", sample), (one, "hr.europe", sample.limit(2)), (two, "sales.europe", sample.limit(1))):
        ResultSetBuilder(lake, df, schema, primary_keys=["id"]).build_schema()
    Deleter(one, "sales.europe").delete_rows("TRUE")
    assert [one.table("sales.europe").count(), one.table("hr.europe").count(), two.table("sales.europe").count()] == [0, 2, 1]
    assert one.schemas() == ["hr", "hr.europe", "sales", "sales.europe"]
    for bad in ("", "a..b", "."):
        with pytest.raises(ValueError):
            schema_parts(bad)


def test_settings(spark, tmp_path):
    lake = connect(spark, str(tmp_path / "l"), schema="a.b")
    assert lake.schemas() == ["a", "a.b"]
    assert "fs.s3a.session.token" not in s3_explicit("k", "s") and postgres_options("db", "h", 5433)["url"] == "jdbc:postgresql://h:5433/db"
    assert normal_root("s3a://b/p/") == "s3a://b/p/" and normal_root("x").startswith("/")


def test_checkpoints_of_the_log(spark, built):
    for i in range(20):
        with built.transaction() as t:
            t.state.options["n"] = i
    assert Lake(spark, built.root).option("n") == 19 and rows(Lake(spark, built.root)) == sorted(ROWS)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert built.log.state(3).options["n"] == 1


# --- names, files, stores --------------------------------------------------------------------------------------------------

CLASHING = ["id", "_copies", "_rank", "_position", "_row_id", "_file", "change_type", "_new_id", "occurrences", "low", "labels"]


@pytest.fixture
def clashing(spark):
    return spark.range(6).select("id", *[(F.col("id") * 10).cast("string").alias(c) for c in CLASHING[1:]])


def test_columns_may_have_any_name_but_reserved_ones(spark, lake, clashing):
    for keep in ("none", "first", "last", "any"):
        kept = remove_duplicates(clashing.union(clashing.filter("id = 1")), keep, ["id"])
        assert kept.columns == CLASHING and kept.count() == (5 if keep == "none" else 6)
    assert repeated_keys(clashing.union(clashing), ["occurrences"]).columns == ["occurrences", "occurrences_"]
    ResultSetBuilder(lake, clashing, primary_keys=["id"], value_labels={"labels": "low"}).build_schema()
    updater = Updater(lake)
    assert updater.update_database(clashing.filter("id < 2").withColumn("_rank", F.lit("new")).unionByName(clashing.filter("id = 5").withColumn("id", F.lit(77).cast("long"))))
    assert (updater.last_report.rows_updated, updater.last_report.rows_inserted) == (2, 1)
    updater.update_value_labels("labels", spark.createDataFrame([("10", "ten")], "low string, labels string"))
    Deleter(lake).delete_rows([("_file", "=", "20")])
    Maintenance(lake).compact(delete_threshold=0.0)
    found = lake.table("main")
    assert found.columns == CLASHING and {r.id: (r._rank, r.labels) for r in found.collect()} == {0: ("new", "0"), 1: ("new", "ten"), 3: ("30", "30"), 4: ("40", "40"), 5: ("50", "50"), 77: ("50", "50")}
    assert lake.changes("main", "fact_table", 2, 2).columns == ["change_type_", "_row_id_", *CLASHING]
    with pytest.raises(ValueError, match="reserved"):
        ResultSetBuilder(lake, spark.sql("SELECT 1 AS id, 2 AS __FACTLAKE_row_id"), "other", primary_keys=["id"]).build_schema()


def test_long_texts_are_bounded_and_still_found(spark, lake):
    values = ["a", "b" * 200, "b" * 64, "é" * 100, "z" + "\U0010ffff" * 90]
    ResultSetBuilder(lake, spark.createDataFrame(list(enumerate(values)), "id long, text string"), primary_keys=["id"]).build_schema()
    (own,) = lake.table_state("main", "fact_table").files.values()
    low, high = own.ranges["text"]
    assert low == "a" and len(high) <= 64 and high > "é" * 100
    assert [lake.table("main", filters=[("text", "=", v)]).count() for v in values] == [1] * 5


@pytest.mark.parametrize("most", [0, 16])
def test_ranges_of_footers_are_those_of_the_rows(spark, lake, monkeypatch, most):
    monkeypatch.setattr("factlake.sources.lake.FOOTERS", most)
    df = spark.sql("SELECT id, date_add(date'1969-12-30', cast(id as int)) AS day, timestamp_ntz'2020-01-01 00:00:00.5' AS at, CAST(NULL AS DOUBLE) AS empty FROM range(100)")
    ResultSetBuilder(lake, df, primary_keys=["id"], categorical_threshold=None).build_schema(files=3)
    files = sorted(lake.table_state("main", "fact_table").files.values(), key=lambda f: f.ranges["id"][0])
    assert sum(f.rows for f in files) == 100 and len(files) == 3
    assert files[0].ranges["id"][0] == 0 and files[-1].ranges["id"][1] == 99 and files[0].ranges["day"][0] == "1969-12-30"
    assert all(f.ranges["at"] == ["2020-01-01 00:00:00.500000"] * 2 and f.ranges["empty"] == [None, None] for f in files)


def test_partitioned_files_settle_and_hot_values_are_split(spark, lake):
    df = spark.range(3000).select("id", F.when(F.col("id") % 10 > 0, "hot").otherwise("cold").alias("kind"))
    ResultSetBuilder(lake, df, primary_keys=["id"]).build_schema(partition_by=["kind"], files=4)
    own = lake.table_state("main", "fact_table")
    hot = [f for f in own.files.values() if f.ranges["kind"][0] == "hot"]
    assert len(hot) > 1 and all(f.ranges["kind"][0] == f.ranges["kind"][1] for f in own.files.values())
    keeper = Maintenance(lake)
    assert [keeper.merge_files()[2] > 0 for _ in range(3)] == [True, False, False]
    assert len(lake.table_state("main", "fact_table").files) == 2 and lake.table("main").count() == 3000


def test_cleanup_leaves_open_transactions_alone(spark, built):
    Deleter(built).delete_rows([("id", "=", 1)], perform_cleanup=False)
    Maintenance(built).recluster()
    other = Lake(spark, built.root)
    with other.transaction() as t:
        t.insert(t.table("main", "fact_table"), batch(spark, NEW))
        assert Maintenance(built).expire_snapshots(0) == [1, 2] and Maintenance(built).cleanup_files(dry_run=True)
        assert len(Maintenance(built).cleanup_files()) >= 2 and Maintenance(built).cleanup_files() == []
    assert rows(Lake(spark, built.root)) == sorted([*ROWS[1:], NEW])


def test_a_log_in_a_database(spark, tmp_path, sample):
    options = {"url": f"jdbc:derby:memory:{tmp_path.name};create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    one = connect(spark, str(tmp_path / "l"), LogStoreType.JDBC, database=options)
    ResultSetBuilder(one, sample, primary_keys=["id"]).build_schema()
    for i in range(17):  # beyond a checkpoint
        with one.transaction() as t:
            t.state.options["n"] = i
    other = connect(spark, str(tmp_path / "l"), LogStoreType.JDBC, database=options)
    assert rows(other) == sorted(ROWS) and other.option("n") == 16 and not (tmp_path / "l" / "_log").exists()
    assert not other.log.store.put(f"{3:020d}.commit.json", "{}")
    with pytest.raises(FileNotFoundError):
        other.log.store.get("nothing")
    with pytest.raises(ValueError):
        connect(spark, str(tmp_path / "l"), LogStoreType.JDBC)


def test_an_upsert_reads_only_near_files(spark, lake):
    df = spark.range(8000).select("id", (F.col("id") * 2).alias("v"))
    ResultSetBuilder(lake, df, primary_keys=["id"]).build_schema(files=8)
    own = lake.table_state("main", "fact_table")
    assert len(lake.files_for(own, [("id", ">=", 10), ("id", "<=", 20)])) == 1
    updater = Updater(lake)
    assert updater.update_database(spark.range(10, 20).select("id", F.lit(-1).cast("long").alias("v")))
    assert updater.last_report.rows_updated == 10 and lake.table("main").filter("v = -1").count() == 10
    # A key that the fact table repeats is refused, if the batch has it.
    with lake.transaction() as t:
        t.insert(t.table("main", "fact_table"), spark.range(5, 6).select("id", F.lit(0).cast("long").alias("v")))
    assert updater.update_database(spark.range(5, 7).select("id", F.lit(1).cast("long").alias("v"))) is False
    assert updater.update_database(spark.range(6, 7).select("id", F.lit(1).cast("long").alias("v")))
