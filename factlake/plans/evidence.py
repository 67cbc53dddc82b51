"""Registered queries of audits, storage, time travel, settings and refusals: outcomes as rows, beside what they must be.

Where the rows are facts of the operation rather than of the tables, the SQL is the list of them.
"""

from __future__ import annotations

import json
import logging
import tempfile
import uuid
import warnings
from collections.abc import Callable
from datetime import UTC, datetime, timedelta
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.functions import links
from factlake.functions.duplicates import null_profile
from factlake.functions.types import warn_name
from factlake.operators.audit import Auditor, Kind, Level, Severity
from factlake.operators.base import ResultSet
from factlake.operators.builder import ResultSetBuilder
from factlake.operators.deleter import Deleter
from factlake.operators.maintenance import Maintenance, MaintenancePolicy, overlap_ratio
from factlake.operators.recovery import Recovery
from factlake.operators.updater import Updater
from factlake.plans.catalogue import BATCH, GEO, UPSERTED, built, fresh_lake, geo_lake, inlined_lake, orders_lake, registered, table, upsert_batch, upserted, upserted_in_parts
from factlake.sources.connect import connect, init_logger, postgres_options, s3_default_chain, s3_explicit
from factlake.sources.lake import Lake
from factlake.sources.log import LogStoreType

Rows = list[tuple]


def listed(schema: str, rows: Rows) -> str:
    """SQL of literal rows, typed as by a Spark schema text."""
    kinds = {"string": "VARCHAR", "long": "BIGINT", "boolean": "BOOLEAN", "double": "DOUBLE"}
    fields = [x.split() for x in schema.split(", ")]

    def literal(x: Any) -> str:
        return "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"

    shown = ", ".join(f"({', '.join(map(literal, r))})" for r in rows)
    return f"SELECT {', '.join(f'CAST("{n}" AS {kinds[k]}) AS "{n}"' for n, k in fields)} FROM (VALUES {shown}) AS t({', '.join(f'"{n}"' for n, _ in fields)})"


def expected(name: str, schema: str, rows: Rows) -> Callable:
    """Register a query that returns rows of Python values, with the rows that it must return."""

    def add(query: Callable[[SparkSession, str], Rows]) -> Callable:
        registered(name, listed(schema, rows))(lambda spark, sf: spark.createDataFrame(query(spark, sf), schema))
        return query

    return add


def outcome(act: Callable[[], Any]) -> str:
    """The error that it ends in, or ok."""
    try:
        act()
    except Exception as error:
        return type(error).__name__
    return "ok"


def changed_metadata(lake: Lake, change: Callable[[dict], dict | None], schema: str = "main") -> None:
    """Write metadata behind the back of the checks; None drops a row."""
    own = ResultSet(lake, schema)
    with lake.transaction() as t:
        own.put_metadata(t, [x for x in map(change, own.metadata()) if x is not None])


def nation_lake(spark: SparkSession, sf: str, **options: Any) -> Lake:
    return built(spark, table(spark, sf, "nation"), ["n_nationkey"], **options)


# --- connections, namespaces, settings -------------------------------------------------------------------------------------


@expected("connect_nested_schemas", "schema string", [("hr",), ("hr.paris",), ("sales",), ("sales.europe",), ("sales.europe.west",)])
def connect_nested(spark, sf):
    root = fresh_lake(spark).root
    connect(spark, root, schema="sales.europe.west")
    lake = connect(spark, root, schema="hr.paris")
    connect(spark, root, schema="unseen", read_only=True)
    return [(s,) for s in lake.schemas()]


@registered("two_catalogs", "SELECT 'all' AS catalog, count(*) AS n FROM orders UNION ALL SELECT 'f', count(*) FROM orders WHERE o_orderstatus = 'F'")
def two_catalogs(spark, sf):
    """Two lakes of one session with the same schema and table names."""
    every, some = orders_lake(spark, sf), built(spark, table(spark, sf, "orders").filter("o_orderstatus = 'F'"), ["o_orderkey"])
    counts = [x.table("main").agg(F.lit(name).alias("catalog"), F.count(F.lit(1)).alias("n")) for name, x in (("all", every), ("f", some))]
    return counts[0].union(counts[1])


@expected(
    "connection_settings",
    "name string, value string",
    [
        ("chain fs.s3a.aws.credentials.provider", "software.amazon.awssdk.auth.credentials.DefaultCredentialsProvider"),
        ("chain fs.s3a.endpoint.region", "eu-west-3"),
        ("explicit fs.s3a.access.key", "key"),
        ("explicit fs.s3a.path.style.access", "true"),
        ("explicit fs.s3a.secret.key", "set"),
        ("postgres driver", "org.postgresql.Driver"),
        ("postgres url", "jdbc:postgresql://db.example:5433/lake"),
        ("postgres user", "reader"),
    ],
)
def settings(spark, sf):
    found = {"chain": s3_default_chain(region="eu-west-3"), "explicit": s3_explicit("key", "secret", path_style=True), "postgres": postgres_options("lake", "db.example", 5433, "reader")}
    return [(f"{kind} {k}", "set" if "secret" in k else v) for kind, options in found.items() for k, v in options.items()]


@expected("lake_options", "name string, value string", [("compression", "snappy"), ("parquet_version", "PARQUET_2_0"), ("row_group_rows", "122880"), ("target_file_size", "1000000")])
def lake_options(spark, sf):
    """Options are kept in the lake: another handle sees them, and a read-only one can't set any."""
    lake = nation_lake(spark, sf, lake=fresh_lake(spark, options={"compression": "snappy", "target_file_size": 1_000_000}))
    other = Lake(spark, lake.root, read_only=True, options={"compression": "none"})
    return [(n, str(other.option(n))) for n in ("compression", "parquet_version", "row_group_rows", "target_file_size")]


@registered("database_log", "SELECT * FROM nation UNION ALL SELECT 100, 'NOWHERE', 0")
def database_log(spark, sf):
    """A lake whose log is in a database behind JDBC (here the embedded one that Spark ships), as for data in a plain object store."""
    options = {"url": f"jdbc:derby:memory:lake{uuid.uuid4().hex};create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    root = fresh_lake(spark).root
    lake = connect(spark, f"{root}-data", LogStoreType.JDBC, database=options, schema="main")
    built(spark, table(spark, sf, "nation"), ["n_nationkey"], lake=lake)
    Updater(lake).update_database(spark.createDataFrame([(100, "NOWHERE", 0)], "n_nationkey int, n_name string, n_regionkey int"))
    return connect(spark, f"{root}-data", LogStoreType.JDBC, database=options, read_only=True).table("main")


@registered("arrow_sink", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def arrow_sink(spark, sf):
    return spark.createDataFrame(nation_lake(spark, sf).arrow("SELECT n_regionkey, count(*) AS n FROM fact_table GROUP BY n_regionkey", "main"))


@expected(
    "schema_columns",
    "table_name string, column_name string, type string",
    [("dataset_metadata", c, t) for c, t in (("label", "string"), ("description", "string"), ("source", "string"), ("updated_at", "timestamp_ntz"), ("schema_version", "int"), ("cluster_by", "string"))]
    + [("fact_table", "n_nationkey", "int"), ("fact_table", "n_name", "string"), ("fact_table", "n_regionkey", "int")]
    + [("metadata", c, "boolean" if c.startswith("is_") else "string") for c in ("name", "label", "sql_type", "is_categorical", "is_primary_key", "parent_name", "label_for", "unit", "display_format", "family", "description", "default_aggregation")],
)
def schema_columns(spark, sf):
    return ResultSet(nation_lake(spark, sf)).described()


@expected("named_logger", "handlers long, same boolean, writes boolean", [(1, True, True)])
def named_logger(spark, sf):
    """Asked for twice, one file handler."""
    with tempfile.TemporaryDirectory() as folder:
        name, path = f"factlake.{uuid.uuid4().hex}", f"{folder}/logs/own.log"
        one, two = init_logger(name, path), init_logger(name, path)
        one.info("a line")
        out = [(len(one.handlers), one is two, "a line" in open(path).read())]
        for handler in one.handlers:
            handler.close()
    return out


# --- metadata --------------------------------------------------------------------------------------------------------------


@expected("dataset_row", "label string, description string, source string, schema_version long, cluster_by string, stamped boolean, touched boolean", [("Nations", "of the world", "a table", 1, '["n_nationkey"]', True, True)])
def dataset_row(spark, sf):
    """The descriptive row, stamped by the build and again by each write."""
    lake = nation_lake(spark, sf, label="Nations", description="of the world", source="a table")
    before = lake.table("main", "dataset_metadata").first()
    Deleter(lake).delete_rows([("n_nationkey", "=", 3)])
    row = lake.table("main", "dataset_metadata").first()
    return [(row.label, row.description, row.source, row.schema_version, row.cluster_by, before.updated_at is not None, row.updated_at > before.updated_at)]


@registered("metadata_by_label", GEO + "SELECT row_number() OVER (ORDER BY label) - 1 AS position, name FROM (VALUES ('c_acctbal', 'C Acctbal'), ('c_custkey', 'C Custkey'), ('n_name', 'N Name'), ('n_nationkey', 'N Nationkey'), ('r_name', 'R Name'), ('r_regionkey', 'R Regionkey')) AS t(name, label)")
def metadata_by_label(spark, sf):
    names = [m["name"] for m in ResultSet(geo_lake(spark, sf)).metadata()]
    return spark.createDataFrame(list(enumerate(names)), "position long, name string")


@expected("odd_column_names", "name string", [("2nd",), ("CamelCase",), ("with space",)])
def odd_names(spark, sf):
    """Names that are accepted with a warning."""
    seen: list[str] = []

    class Collect(logging.Handler):
        def emit(self, record: logging.LogRecord) -> None:
            seen.append(record.args[0] if isinstance(record.args, tuple) else str(record.args))

    logger, handler = logging.getLogger("factlake"), Collect()
    logger.addHandler(handler)
    try:
        for name in ("plain", "_also_plain", "CamelCase", "with space", "2nd", "x2"):
            warn_name(name)
    finally:
        logger.removeHandler(handler)
    return [(n,) for n in seen]


@expected(
    "column_metadata_updates",
    "name string, unit string, parent_name string, is_categorical boolean",
    [("c_acctbal", "EUR", None, False), ("c_custkey", None, None, False), ("n_name", None, None, False), ("n_nationkey", None, "r_regionkey", True), ("r_name", None, None, False), ("r_regionkey", None, "c_custkey_group", True), ("c_custkey_group", None, None, True)],
)
def metadata_updates(spark, sf):
    """A new parent makes both ends categorical."""
    lake = geo_lake(spark, sf)
    Updater(lake).add_columns(table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 7).alias("c_custkey_group")))
    own = ResultSet(lake)
    own.update_column_metadata("c_acctbal", unit="EUR")
    own.update_column_metadata("r_regionkey", parent_name="c_custkey_group")
    return [(m["name"], m["unit"], m["parent_name"], m["is_categorical"]) for m in own.metadata()]


@expected(
    "column_metadata_refusals",
    "attempt string, outcome string",
    [(x, "ValueError") for x in ("cycle", "empty label", "label with parent", "not categorical", "not text", "unknown column", "unknown field", "unknown parent", "wrong flag", "broken dependency")] + [("description", "ok")],
)
def metadata_refusals(spark, sf):
    own = ResultSet(geo_lake(spark, sf))
    wanted = {
        "cycle": ("r_regionkey", {"parent_name": "n_nationkey"}),
        "empty label": ("n_name", {"label": ""}),
        "label with parent": ("n_name", {"parent_name": "r_regionkey"}),
        "not categorical": ("n_nationkey", {"is_categorical": False}),
        "not text": ("c_acctbal", {"label_for": "c_custkey"}),
        "unknown column": ("nope", {"unit": "x"}),
        "unknown field": ("n_name", {"sql_type": "DATE"}),
        "unknown parent": ("c_acctbal", {"parent_name": "nope"}),
        "wrong flag": ("c_acctbal", {"is_categorical": 1}),
        "broken dependency": ("n_name", {"label_for": "r_regionkey"}),
        "description": ("n_name", {"description": "its name"}),
    }
    return [(k, outcome(lambda c=c, f=f: own.update_column_metadata(c, **f))) for k, (c, f) in wanted.items()]


@expected("cascaded_references", "name string, parent_name string, label_for string", [("c_acctbal", None, None), ("c_custkey", None, None), ("n_name", None, "n_nationkey"), ("n_nationkey", None, None), ("r_name", None, None)])
def cascaded(spark, sf):
    """Dropping a parent and code column with cascade clears what refers to it."""
    lake = geo_lake(spark, sf)
    Deleter(lake).delete_columns(["r_regionkey"], cascade=True)
    return [(m["name"], m["parent_name"], m["label_for"]) for m in ResultSet(lake).metadata()]


@expected(
    "sort_key_changes",
    "step string, declared string, sorted_by string",
    [("built", "o_orderkey", "o_orderkey"), ("changed", "o_orderstatus,o_orderdate", "o_orderstatus,o_orderdate"), ("column dropped", "o_orderdate", "o_orderdate"), ("reset", "o_orderdate", ""), ("set", "o_orderdate", "o_custkey")],
)
def sort_keys(spark, sf):
    lake = orders_lake(spark, sf)
    own, keeper, out = ResultSet(lake), Maintenance(lake), []

    def note(step: str) -> None:
        out.append((step, ",".join(own.cluster_by() or []), ",".join(keeper.sorted_by())))

    note("built")
    own.update_cluster_by(["o_orderstatus", "o_orderdate"])
    note("changed")
    Deleter(lake).delete_columns(["o_orderstatus"])
    note("column dropped")
    keeper.reset_sorted_by()
    note("reset")
    keeper.set_sorted_by(["o_custkey"])
    note("set")
    return out


# --- refusals and outcomes of writes ---------------------------------------------------------------------------------------


@expected(
    "upsert_refusals",
    "attempt string, outcome string, versions long",
    [(x, "ValueError", 0) for x in ("composite column", "no primary key", "null key", "repeated key", "unknown column", "without key", "reserved name")] + [("nothing left", "ok", 0)],
)
def upsert_refusals(spark, sf):
    """What is refused leaves no snapshot."""
    lake, bare = nation_lake(spark, sf), built(spark, table(spark, sf, "nation"))
    nation = table(spark, sf, "nation")

    def refused(on: Lake, df: DataFrame, **options: Any) -> tuple[str, int]:
        before = on.log.latest()
        return outcome(lambda: Updater(on).update_database(df, **options)), on.log.latest() - before

    wanted = {
        "composite column": (lake, nation.withColumn("n_list", F.array("n_name")), {"allow_new_columns": True}),
        "no primary key": (bare, nation, {}),
        "null key": (lake, nation.withColumn("n_nationkey", F.lit(None).cast("int")), {}),
        "repeated key": (lake, nation.union(nation), {"check_duplicates_update": False}),
        "unknown column": (lake, nation.withColumn("n_other", F.lit(1)), {}),
        "without key": (lake, nation.drop("n_nationkey"), {}),
        "reserved name": (lake, nation.withColumn("__factlake_x", F.lit(1)), {"allow_new_columns": True}),
        "nothing left": (lake, nation.union(nation), {}),
    }
    return [(k, *refused(on, df, **options)) for k, (on, df, options) in wanted.items()]


@expected(
    "label_checks_on_upsert",
    "batch string, outcome string",
    [("another code only", "ValueError"), ("new code with its label", "ok"), ("new label for one row", "ValueError"), ("no label for a known code", "ValueError"), ("label without code", "ValueError"), ("same label", "ok"), ("untouched columns", "ok")],
)
def label_checks(spark, sf):
    """Codes of the rows that a batch touches keep one label each."""
    lake = geo_lake(spark, sf)
    one = lake.table("main").orderBy("c_custkey").first()
    other = lake.table("main").filter(F.col("n_nationkey") != one.n_nationkey).first()
    wanted = {
        "another code only": ([(one.c_custkey, other.n_nationkey)], "c_custkey long, n_nationkey int"),
        "new code with its label": ([(10**7, 77, "UTOPIA")], "c_custkey long, n_nationkey int, n_name string"),
        "new label for one row": ([(one.c_custkey, "ELSEWHERE")], "c_custkey long, n_name string"),
        "no label for a known code": ([(10**7 + 1, one.n_nationkey)], "c_custkey long, n_nationkey int"),
        "label without code": ([(10**7 + 2, "NOWHERE")], "c_custkey long, n_name string"),
        "same label": ([(one.c_custkey, one.n_name)], "c_custkey long, n_name string"),
        "untouched columns": ([(one.c_custkey, 1.5)], "c_custkey long, c_acctbal double"),
    }
    return [(k, outcome(lambda r=r, s=s: Updater(lake).update_database(spark.createDataFrame(r, s)))) for k, (r, s) in wanted.items()]


@expected("delete_refusals", "attempt string, outcome string", [(x, "ValueError") for x in ("all by nothing", "mixed shapes", "no columns", "primary key", "referred to", "unknown column")] + [("with what refers to it", "ok")])
def delete_refusals(spark, sf):
    deleter = Deleter(geo_lake(spark, sf))
    return [
        ("all by nothing", outcome(lambda: deleter.delete_rows([]))),
        ("mixed shapes", outcome(lambda: deleter.delete_rows([("c_custkey", "=", 1), [("c_custkey", "=", 2)]]))),
        ("no columns", outcome(lambda: deleter.delete_columns([]))),
        ("primary key", outcome(lambda: deleter.delete_columns(["c_custkey"]))),
        ("referred to", outcome(lambda: deleter.delete_columns(["n_nationkey"]))),
        ("unknown column", outcome(lambda: deleter.delete_columns(["nope"]))),
        ("with what refers to it", outcome(lambda: deleter.delete_columns(["n_nationkey", "n_name"]))),
    ]


@registered("filter_like", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority LIKE '%URGENT%' AND CAST(o_orderkey AS VARCHAR) LIKE '1%' AND o_orderstatus NOT LIKE 'F'")
def filter_like(spark, sf):
    return orders_lake(spark, sf).table("main", filters=[("o_orderpriority", "like", "%URGENT%"), ("o_orderkey", "like", "1%"), ("o_orderstatus", "not like", "F")]).select("o_orderkey", "o_orderpriority")


@registered("rolled_back_transaction", "SELECT * FROM orders")
def rolled_back(spark, sf):
    """A failure after two of its operations takes a whole transaction back; the nested ones had joined it."""
    lake = orders_lake(spark, sf)
    try:
        with lake.transaction():
            Deleter(lake).delete_rows([("o_orderstatus", "=", "F")])
            Updater(lake).update_database(upsert_batch(table(spark, sf, "orders")))
            raise InterruptedError
    except InterruptedError:
        pass
    if lake.log.latest() != 1:
        raise RuntimeError("a snapshot was published")
    return lake.table("main")


@registered("joined_transaction", BATCH + "SELECT * FROM (SELECT * FROM batch UNION ALL SELECT o.* FROM orders o WHERE NOT EXISTS (SELECT 1 FROM batch b WHERE b.o_orderkey = o.o_orderkey)) WHERE o_orderstatus <> 'F'")
def joined(spark, sf):
    """Two operations as one snapshot."""
    lake = orders_lake(spark, sf)
    with lake.transaction(author="both"):
        if not Updater(lake).update_database(upsert_batch(table(spark, sf, "orders")), keep="all"):
            raise RuntimeError("the upsert failed")
        Deleter(lake).delete_rows([("o_orderstatus", "=", "F")])
    if lake.log.latest() != 2:
        raise RuntimeError("more than one snapshot was published")
    return lake.table("main")


@expected("audit_blocks_commit", "operation string, outcome string, versions long", [("critical", "RuntimeError", 0), ("high", "ok", 1)])
def audit_blocks(spark, sf):
    """A critical issue of the staged state takes the write back; a high one is a warning of its report."""
    lake, out = geo_lake(spark, sf), []
    changed_metadata(lake, lambda m: m if m["name"] != "c_acctbal" else None)  # a column without metadata: high
    before = lake.log.latest()
    out.append(("high", outcome(lambda: Deleter(lake).delete_rows([("c_custkey", "=", 1)], perform_cleanup=False)), lake.log.latest() - before))
    broken = geo_lake(spark, sf)
    changed_metadata(broken, lambda m: m | {"label_for": "r_regionkey"} if m["name"] == "n_name" else m)  # many names a region: critical
    before = broken.log.latest()
    out.append(("critical", outcome(lambda: Deleter(broken, audit_level="COMPREHENSIVE").delete_rows([("c_custkey", "=", 1)])), broken.log.latest() - before))
    return out


@registered("upsert_then_compact", UPSERTED)
def upsert_then_compact(spark, sf):
    lake = orders_lake(spark, sf)
    updater = Updater(lake, compaction_window=timedelta(days=1))
    if not updater.update_database(upsert_batch(table(spark, sf, "orders")), keep="all", compact_after_update=True):
        raise RuntimeError("the upsert failed")
    if set(updater.last_report.maintenance) != {"files_rewritten", "files_from_rewrite", "files_merged", "files_from_merge"}:
        raise RuntimeError("the report lacks counters")
    return lake.table("main")


@registered("concurrent_writers", "SELECT 'main' AS schema, count(*) AS n FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT 'other', count(*) FROM region")
def concurrent(spark, sf):
    """Writers of different tables both commit; the later one is put on top of the earlier."""
    lake = nation_lake(spark, sf)
    other = Lake(spark, lake.root)
    with other.transaction():
        built(spark, table(spark, sf, "region"), ["r_regionkey"], schema="other", lake=other)
        Deleter(lake).delete_rows([("n_nationkey", "=", 3)])
    counts = [lake.table(s).agg(F.lit(s).alias("schema"), F.count(F.lit(1)).alias("n")) for s in ("main", "other")]
    return counts[0].union(counts[1])


# --- audits ----------------------------------------------------------------------------------------------------------------

ISSUES = "broken string, kind string, severity string, table string, column string, message string"


def issues(lake: Lake, broken: str, level: Level = Level.BASIC, schema: str = "main") -> Rows:
    return [(broken, i.kind.value, i.severity.value, i.table, i.column, i.message) for i in Auditor(lake, schema).validate_database(level).issues]


@expected(
    "audit_structure",
    ISSUES,
    [
        ("no tables", "structure", "high", "fact_table", None, "fact_table is missing"),
        ("no tables", "structure", "critical", "metadata", None, "metadata is missing"),
        ("no tables", "structure", "high", "dataset_metadata", None, "dataset_metadata is missing"),
        ("no metadata rows", "metadata", "high", "metadata", None, "the metadata has no rows"),
        ("no metadata rows", "metadata", "high", "fact_table", None, "columns without metadata: ['n_name', 'n_nationkey', 'n_regionkey']"),
        ("no dataset row", "metadata", "medium", "dataset_metadata", None, "dataset_metadata has 0 rows rather than one"),
        ("two dataset rows", "metadata", "medium", "dataset_metadata", None, "dataset_metadata has 2 rows rather than one"),
    ],
)
def audit_structure(spark, sf):
    lake = nation_lake(spark, sf)
    out = issues(lake, "no tables", schema="elsewhere")
    for broken, table_, rows in (("no metadata rows", "metadata", []), ("no dataset row", "dataset_metadata", []), ("two dataset rows", "dataset_metadata", [{"label": "a"}, {"label": "b"}])):
        with Lake(spark, lake.root).transaction() as t:
            t.replace_rows("main", table_, rows)
            out += issues(t.lake, broken)
            t.state = t.lake.log.state()  # seen, not published
    return out


@expected(
    "audit_metadata",
    ISSUES,
    [
        ("null label", "metadata", "medium", "metadata", "label", "1 metadata rows have no label"),
        ("named twice", "metadata", "high", "metadata", None, "the metadata names columns twice: ['n_name']"),
        ("ghost", "metadata", "high", "metadata", None, "metadata without a column: ['ghost']"),
        ("unnamed column", "metadata", "high", "fact_table", None, "columns without metadata: ['n_name']"),
        ("wrong type", "types", "medium", "fact_table", "n_regionkey", "n_regionkey is declared DATE but stored as INTEGER"),
        ("unknown parent", "links", "high", "metadata", "n_name", "n_name has an unknown parent nowhere"),
        ("circle", "links", "high", "metadata", None, "the hierarchy has a cycle at n_nationkey"),
        ("label of itself", "links", "high", "metadata", None, "n_name can't label itself"),
        ("label that isn't text", "links", "high", "metadata", None, "the label column n_regionkey must be text"),
    ],
)
def audit_metadata(spark, sf):
    lake, out = nation_lake(spark, sf), []
    rows = {m["name"]: m for m in ResultSet(lake).metadata()}

    def broken(name: str, **changes: dict) -> None:
        changed = {n: m | changes.get(n, {}) for n, m in rows.items()}
        more = [rows["n_name"] | changes["more"]] if "more" in changes else []
        with Lake(spark, lake.root).transaction() as t:
            t.replace_rows("main", "metadata", [m for m in [*changed.values(), *more] if "gone" not in m])
            out.extend(issues(t.lake, name))
            t.state = t.lake.log.state()

    broken("null label", n_name={"label": None})
    broken("named twice", more={})
    broken("ghost", more={"name": "ghost"})
    broken("unnamed column", n_name={"gone": True})
    broken("wrong type", n_regionkey={"sql_type": "DATE"})
    broken("unknown parent", n_name={"parent_name": "nowhere"})
    broken("circle", n_regionkey={"parent_name": "n_nationkey"}, n_nationkey={"parent_name": "n_regionkey"})
    broken("label of itself", n_name={"label_for": "n_name"})
    broken("label that isn't text", n_regionkey={"label_for": "n_nationkey"})
    return out


@registered(
    "audit_data",
    listed(
        ISSUES,
        [
            ("empty", "data", "medium", "fact_table", None, "the fact table is empty"),
            ("nulls", "data", "high", "fact_table", "dead", "dead has no values"),
            ("nulls", "data", "medium", "fact_table", "sparse", "sparse is null in 80% of rows"),
            ("synonyms", "none", "none", None, None, "no issue"),
        ],
    )
    + " UNION ALL SELECT 'keys', 'keys', 'high', 'fact_table', NULL, (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) || ' primary key values are repeated'"
    + " UNION ALL SELECT 'dependency', 'links', 'critical', 'fact_table', 'p_type', 'p_brand does not determine p_type'",
)
def audit_data(spark, sf):
    """What only a scan tells, each by its own lake."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", UserWarning)
        empty = built(spark, table(spark, sf, "nation").limit(0), ["n_nationkey"])
    holes = table(spark, sf, "nation").select("n_nationkey", F.expr("CASE WHEN n_nationkey % 5 = 0 THEN n_name END").alias("sparse"), F.lit(None).cast("double").alias("dead"))
    out = issues(empty, "empty", Level.COMPREHENSIVE) + issues(built(spark, holes, ["n_nationkey"]), "nulls", Level.COMPREHENSIVE)
    lines = built(spark, table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"))
    changed_metadata(lines, lambda m: m | {"is_primary_key": m["name"] != "l_returnflag"})
    out += issues(lines, "keys", Level.COMPREHENSIVE)
    parts = built(spark, table(spark, sf, "part").select("p_partkey", "p_brand", "p_type"), ["p_partkey"])
    changed_metadata(parts, lambda m: m | {"label_for": "p_brand"} if m["name"] == "p_type" else m)
    out += [(*i[:5], "p_brand does not determine p_type" if "doesn't determine" in i[5] else i[5]) for i in issues(parts, "dependency", Level.COMPREHENSIVE)]
    nations = nation_lake(spark, sf)
    changed_metadata(nations, lambda m: m | {"sql_type": {"VARCHAR": "TEXT", "INTEGER": "INT4"}[m["sql_type"]]})
    out += issues(nations, "synonyms", Level.COMPREHENSIVE) or [("synonyms", "none", "none", None, None, "no issue")]
    return spark.createDataFrame(out, ISSUES)


@expected("audit_report", "checks long, critical long, by_kind long, by_severity long, recommendations long, timed boolean", [(9, 1, 2, 1, 2, True)])
def audit_report(spark, sf):
    """What the report itself counts: a ghost column (metadata), a wrong type and a broken dependency."""
    lake = geo_lake(spark, sf)
    changed_metadata(lake, lambda m: m | {"label_for": "r_regionkey"} if m["name"] == "n_name" else m | {"label_for": "n_nationkey"} if m["name"] == "r_name" else m)
    changed_metadata(lake, lambda m: m | {"sql_type": "DATE"} if m["name"] == "c_acctbal" else m)
    changed_metadata(lake, lambda m: m | {"unit": "x"} if m["name"] == "c_acctbal" else m)
    found = Auditor(lake).validate_database(Level.COMPREHENSIVE)
    return [(found.checks, found.critical_count(), 2 * len(found.by_kind(Kind.TYPES)), len(found.by_severity(Severity.MEDIUM)), len(found.recommendations), found.seconds is not None)]


@expected("health_checks", "lake string, status string, counted boolean", [("broken", "critical", False), ("emptied", "empty", True), ("sound", "healthy", True), ("unnamed column", "warning", True)])
def health(spark, sf):
    out = []

    def note(name: str, lake: Lake, schema: str = "main") -> None:
        found = Auditor(lake, schema).get_quick_health_check()
        out.append((name, found["status"], found["rows"] is not None))

    lake = nation_lake(spark, sf)
    note("sound", lake)
    note("broken", lake, "elsewhere")
    changed_metadata(lake, lambda m: m if m["name"] != "n_name" else None)
    note("unnamed column", lake)
    other = nation_lake(spark, sf)
    Deleter(other).delete_rows("TRUE")
    note("emptied", other)
    return out


# --- storage ---------------------------------------------------------------------------------------------------------------


@registered("file_bounds", "SELECT 'o_orderkey' AS name, CAST(min(o_orderkey) AS VARCHAR) AS low, CAST(max(o_orderkey) AS VARCHAR) AS high FROM orders UNION ALL SELECT 'o_orderstatus', min(o_orderstatus), max(o_orderstatus) FROM orders UNION ALL SELECT 'o_custkey', CAST(min(o_custkey) AS VARCHAR), CAST(max(o_custkey) AS VARCHAR) FROM orders")
def file_bounds(spark, sf):
    """The ends of the logged ranges of all files are those of the column."""
    lake = orders_lake(spark, sf, build={"files": 5})
    own, out = lake.table_state("main", "fact_table"), []
    for name in ("o_orderkey", "o_custkey", "o_orderstatus"):
        ranges = Maintenance(lake).file_ranges(own, name)
        out.append((name, str(min(r[0] for r in ranges)), str(max(r[1] for r in ranges))))
    return spark.createDataFrame(out, "name string, low string, high string")


@registered("pruning_after_widening", "SELECT * FROM (SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation UNION ALL SELECT 9999999999, 'NATION_BIG') WHERE n_nationkey >= 20")
def pruning_after_widening(spark, sf):
    """Ranges of a column's old type prune nothing."""
    lake = built(spark, table(spark, sf, "nation").select("n_nationkey", "n_name"), ["n_nationkey"])
    Updater(lake).update_database(spark.createDataFrame([(9999999999, "NATION_BIG")], "n_nationkey long, n_name string"))
    return lake.table("main", filters=[("n_nationkey", ">=", 20)])


@expected("pruned_upsert", "files long, near long, after long, changed long", [(8, 1, 9, 1)])
def pruned_upsert(spark, sf):
    """A batch of one key reads one of eight files, and leaves one file more."""
    lake = orders_lake(spark, sf, build={"files": 8})
    seen: list[int] = []
    plain = Lake.files_for
    updater, own = Updater(lake), lake.table_state("main", "fact_table")
    batch = table(spark, sf, "orders").filter("o_orderkey = 7").withColumn("o_totalprice", F.lit(-1.0))

    class Watched(Lake):
        def files_for(self, state, filters):
            found = plain(self, state, filters)
            if filters:
                seen.append(len(found))
            return found

    lake.__class__ = Watched
    updater.update_database(batch)
    return [(len(own.files), seen[0], len(lake.table_state("main", "fact_table").files), updater.last_report.rows_updated)]


@registered(
    "storage_measures",
    BATCH + "SELECT CAST((SELECT count(*) FROM orders) + (SELECT count(*) FROM batch b WHERE b.o_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS BIGINT) AS rows, c AS deleted_rows, "
    "c / CAST((SELECT count(*) FROM orders) + c + (SELECT count(*) FROM batch b WHERE b.o_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS DOUBLE) AS delete_ratio, CAST(0 AS BIGINT) AS inlined_rows, CAST(2 AS BIGINT) AS snapshots, true AS sized, true AS all_small "
    "FROM (SELECT count(*) AS c FROM batch b JOIN orders o USING (o_orderkey) WHERE b.o_totalprice IS DISTINCT FROM o.o_totalprice)",
)
def storage_measures(spark, sf):
    r = Maintenance(upserted_in_parts(spark, sf)[0]).storage_report()
    schema = "rows long, deleted_rows long, delete_ratio double, inlined_rows long, snapshots long, sized boolean, all_small boolean"
    return spark.createDataFrame([(r.rows, r.deleted_rows, r.delete_ratio, r.inlined_rows, r.snapshots, r.bytes > 0 and r.delete_files > 0 and not r.warnings, r.small_files == r.files)], schema)


@registered(
    "overlap_of_files",
    "WITH part AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey <= 3000 THEN 0 WHEN o_orderkey <= 6000 THEN 1 + o_orderkey % 2 ELSE 3 END AS file FROM orders), ends AS (SELECT file, min(k) AS first, max(k) AS last FROM part GROUP BY file) "
    "SELECT avg(CASE WHEN (SELECT count(*) FROM ends y WHERE y.file <> x.file AND (greatest(x.first, y.first) < least(x.last, y.last) OR (x.first = y.first AND x.last = y.last))) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS overlap_ratio FROM ends x",
)
def overlap_of_files(spark, sf):
    """Four files, two of which interleave."""
    orders = table(spark, sf, "orders")
    lake = built(spark, orders.filter("o_orderkey <= 3000"), ["o_orderkey"], build={"files": 1})
    for some in ("o_orderkey > 3000 AND o_orderkey <= 6000 AND o_orderkey % 2 = 0", "o_orderkey > 3000 AND o_orderkey <= 6000 AND o_orderkey % 2 = 1", "o_orderkey > 6000"):
        with lake.transaction() as t:
            t.insert(t.table("main", "fact_table"), orders.filter(some), files=1)
    own = lake.table_state("main", "fact_table")
    return spark.createDataFrame([(overlap_ratio(Maintenance(lake).file_ranges(own, "o_orderkey")),)], "overlap_ratio double")


@registered("flushed_rows", "SELECT * FROM orders UNION ALL SELECT o_orderkey + 1000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey <= 3")
def flushed(spark, sf):
    """Rows that the log had held, as a file; their ids stay, so the feed sees no change."""
    lake = inlined_lake(spark, sf)
    keeper = Maintenance(lake)
    before = keeper.storage_report().inlined_rows
    done, last = keeper.flush_inlined_data(), lake.log.latest()
    if not before or (done, keeper.storage_report().inlined_rows) != ({"fact_table": before}, 0) or not lake.changes("main", "fact_table", last, last).isEmpty():
        raise RuntimeError("all inlined rows should have been flushed, none changed")
    return lake.table("main")


@registered("repartitioned_result", "SELECT * FROM orders")
def repartitioned(spark, sf):
    lake = orders_lake(spark, sf)
    keeper = Maintenance(lake)
    keeper.set_partitioned_by(["o_orderstatus"])
    keeper.reset_partitioned_by()
    keeper.repartition("fact_table", ["month(o_orderdate)", "bucket(2, o_custkey)"])
    own = lake.table_state("main", "fact_table")
    if own.partition_by != ["month(o_orderdate)", "bucket(2, o_custkey)"] or len(own.files) < 24:
        raise RuntimeError("the table isn't partitioned")
    return lake.table("main")


@registered("partitioned_by_day_and_hour", "SELECT * FROM events WHERE event_type = 'click' UNION ALL SELECT * FROM events WHERE event_type = 'purchase' AND value > 50")
def partitioned_times(spark, sf):
    lake = built(spark, table(spark, sf, "events"), ["event_id"], build={"partition_by": ["day(ts)"]})
    days = len(lake.table_state("main", "fact_table").files)
    Maintenance(lake).repartition("fact_table", ["hour(ts)"])
    if days < 28 or len(lake.table_state("main", "fact_table").files) < 24:
        raise RuntimeError("the table isn't partitioned")
    return lake.table("main", filters=[[("event_type", "=", "click")], [("event_type", "=", "purchase"), ("value", ">", 50)]])


@expected("merging_settles", "call long, processed long, created long", [(1, 9, 3), (2, 0, 0), (3, 0, 0)])
def merging(spark, sf):
    """Nine small files of three partition values become three; further calls find nothing to do."""
    orders = table(spark, sf, "orders")
    lake = built(spark, orders.filter("o_orderkey <= 100"), ["o_orderkey"], build={"partition_by": ["o_orderstatus"], "files": 1})
    for low in (100, 200):
        with lake.transaction() as t:
            t.insert(t.table("main", "fact_table"), orders.filter(f"o_orderkey > {low} AND o_orderkey <= {low + 100}"), files=1)
    keeper = Maintenance(lake)
    return [(i, *keeper.merge_files()[2:]) for i in (1, 2, 3)]


@registered("expired_and_cleaned", "SELECT * FROM orders WHERE o_orderstatus = 'O'")
def expired(spark, sf):
    """What only expired snapshots named is deleted; the files of another handle's open transaction aren't, and it commits."""
    lake = orders_lake(spark, sf)
    Deleter(lake).delete_rows([("o_orderstatus", "=", "F")])
    Maintenance(lake).rewrite_data_files(delete_threshold=0.0)
    other, keeper = Lake(spark, lake.root), Maintenance(lake)
    with other.transaction() as t:
        own = t.table("main", "fact_table")
        t.replace_files(own, list(own.files), t.write(own, other.table("main").filter("o_orderstatus = 'O'")))
        own.deletes = []
        gone, deleted = keeper.expire_snapshots(0), keeper.cleanup_files()
    if gone != [1, 2] or not deleted or keeper.cleanup_files() or outcome(lambda: lake.table("main", version=1)) != "ValueError":
        raise RuntimeError(f"expired {gone}, deleted {len(deleted)} files")
    return Lake(spark, lake.root).table("main")


@expected("orphaned_files", "step string, files long", [("deleted", 2), ("listed", 2), ("of seven days", 0), ("left", 0)])
def orphans(spark, sf):
    """Files of a write that was never published."""
    lake = nation_lake(spark, sf)
    try:
        with lake.transaction() as t:
            t.write(t.table("main", "fact_table"), table(spark, sf, "nation"), files=2)
            raise InterruptedError
    except InterruptedError:
        pass
    keeper, soon = Maintenance(lake), datetime.now(UTC).replace(tzinfo=None) + timedelta(minutes=5)
    out = [("of seven days", len(keeper.delete_orphaned_files())), ("listed", len(keeper.delete_orphaned_files(soon))), ("deleted", len(keeper.delete_orphaned_files(soon, dry_run=False))), ("left", len(keeper.delete_orphaned_files(soon)))]
    if lake.table("main").count() != table(spark, sf, "nation").count():
        raise RuntimeError("rows are gone")
    return out


@expected("policy_checks", "policy string, outcome string", [(x, "ValueError") for x in ("delete_ratio", "max_compacted_files", "overlap_ratio", "retention_days", "small_files")] + [("plain", "ok")])
def policies(spark, sf):
    wanted = {"delete_ratio": 1.5, "max_compacted_files": 0, "overlap_ratio": -0.1, "retention_days": -1, "small_files": -1}
    return [(k, outcome(lambda k=k, v=v: MaintenancePolicy(**{k: v}))) for k, v in wanted.items()] + [("plain", outcome(MaintenancePolicy))]


@expected("storage_summary", "starts boolean, fields long", [(True, 6)])
def summary(spark, sf):
    """One line, with what couldn't be measured as unknown."""
    text = Maintenance(nation_lake(spark, sf)).storage_report().summary()
    return [(text.startswith("main.fact_table: 1 files (1 small), "), text.count(",") + 1)]


# --- time travel, reports --------------------------------------------------------------------------------------------------


@expected(
    "changed_tables",
    "snapshot_id long, author string, commit_message string, fact boolean, metadata boolean",
    [(1, None, "build_schema", True, True), (2, "batch-1", "update_database", True, False), (3, "d", "no F", True, False), (4, None, "metadata of o_custkey", False, True)],
)
def changed_tables(spark, sf):
    """Snapshots, classified by what their list of changed tables is like."""
    lake, _ = upserted(spark, sf)
    Deleter(lake).delete_rows([("o_orderstatus", "=", "F")], run_id="d", commit_message="no F")
    ResultSet(lake).update_column_metadata("o_custkey", unit="id")
    text = F.concat(F.lit(","), F.array_join("changed", ","), F.lit(","))
    rows = lake.snapshots().select("snapshot_id", "author", "commit_message", text.like("%main/fact\\_table,%").alias("fact"), text.like("%main/metadata,%").alias("metadata")).collect()
    if [r.snapshot_id for r in rows] != [4, 3, 2, 1]:
        raise RuntimeError("not newest first")
    return [tuple(r) for r in rows]


@expected("last_changes", "last_snapshot long, last_of_fact long, last_of_metadata long, snapshots long, aged boolean", [(3, 2, 3, 3, True)])
def last_changes(spark, sf):
    lake, _ = upserted(spark, sf)
    ResultSet(lake).update_column_metadata("o_custkey", unit="id")
    names = F.array_join("changed", ",")
    found = lake.snapshots().agg(
        F.max("snapshot_id"), F.max(F.when(names.like("%/fact_table%"), F.col("snapshot_id"))), F.max(F.when(names.like("%main/metadata%"), F.col("snapshot_id"))), F.count(F.lit(1))
    )
    days = Maintenance(lake).storage_report().oldest_snapshot_days
    return [(*found.first(), 0 <= days < 1)]


@expected("commit_facts", "author string, commit_message string, extra_info string, refused string, versions long", [("run-7", "a note", '{"rows": [1, 2], "why": "é"}', "TypeError", 2)])
def commit_facts(spark, sf):
    """Author, message and JSON of a commit; what isn't JSON fails before anything is written."""
    lake = nation_lake(spark, sf)
    Deleter(lake).delete_rows([("n_nationkey", "=", 1)], run_id="run-7", commit_message="a note", commit_info={"rows": [1, 2], "why": "é"})
    refused = outcome(lambda: Deleter(lake).delete_rows([("n_nationkey", "=", 2)], commit_info={"bad": object()}))
    row = lake.snapshots().first()
    return [(row.author, row.commit_message, json.dumps(json.loads(row.extra_info), ensure_ascii=False), refused, lake.log.latest())]


@expected("restore_refusals", "attempt string, outcome string", [("changed columns", "ValueError"), ("no tables", "ValueError"), ("unknown snapshot", "ValueError"), ("unknown table", "ValueError"), ("metadata alone", "ok")])
def restore_refusals(spark, sf):
    lake = nation_lake(spark, sf)
    Deleter(lake).delete_columns(["n_regionkey"])
    own = Recovery(lake)
    return [
        ("changed columns", outcome(lambda: own.restore_snapshot(1))),
        ("no tables", outcome(lambda: own.restore_snapshot(1, []))),
        ("unknown snapshot", outcome(lambda: own.restore_snapshot(99))),
        ("unknown table", outcome(lambda: own.restore_snapshot(1, ["nope"]))),
        ("metadata alone", outcome(lambda: own.restore_snapshot(2, ["metadata"]))),
    ]


@registered("time_travel_by_time", "SELECT * FROM orders")
def travel_by_time(spark, sf):
    lake, _ = upserted(spark, sf)
    when = lake.log.commit(1)["time"]
    return Lake(spark, lake.root, timestamp=when).table("main")


@registered(
    "report_measures",
    BATCH + "SELECT 'update_database' AS operation, 'batch-1' AS run_id, (SELECT count(*) FROM orders) AS rows_before, (SELECT count(*) FROM orders) + i AS rows_after, i AS rows_inserted, u AS rows_updated, CAST(0 AS BIGINT) AS rows_deleted, CAST(1 AS BIGINT) AS snapshots, true AS success, true AS measured FROM "
    "(SELECT CAST(count(*) FILTER (WHERE o.o_orderkey IS NULL) AS BIGINT) AS i, CAST(count(*) FILTER (WHERE o.o_orderkey IS NOT NULL AND o.o_totalprice IS DISTINCT FROM b.o_totalprice) AS BIGINT) AS u FROM batch b LEFT JOIN orders o ON o.o_orderkey = b.o_orderkey)",
)
def report_measures(spark, sf):
    r = upserted_in_parts(spark, sf)[1].last_report
    d = r.to_dict()
    measured = d["files_after"] > d["files_before"] and d["bytes_after"] > d["bytes_before"] and d["delete_files_after"] > 0 and d["seconds"] > 0 and "ok" in r.summary() and f"+{r.rows_inserted} rows" in r.summary()
    schema = "operation string, run_id string, rows_before long, rows_after long, rows_inserted long, rows_updated long, rows_deleted long, snapshots long, success boolean, measured boolean"
    return spark.createDataFrame([(r.operation, r.run_id, r.rows_before, r.rows_after, r.rows_inserted, r.rows_updated, r.rows_deleted, r.snapshot_after - r.snapshot_before, r.success, measured)], schema)


@registered(
    "rollup_of_lines",
    "SELECT l_returnflag, CAST(sum(l_quantity) AS DOUBLE) AS l_quantity, round(avg(l_extendedprice), 4) AS l_extendedprice, median(l_discount) AS l_discount, mode(l_linestatus) AS l_linestatus FROM lineitem GROUP BY 1",
)
def rollup_of_lines(spark, sf):
    wanted = {"l_quantity": "SUM", "l_extendedprice": "avg", "l_discount": "Median", "l_linestatus": "MODE"}
    lake = built(spark, table(spark, sf, "lineitem"), build={"column_metadata": {c: {"default_aggregation": a} for c, a in wanted.items()}})
    return ResultSet(lake).rollup(["l_returnflag"]).withColumn("l_extendedprice", F.round("l_extendedprice", 4))


@registered("null_shares", "SELECT count(*) AS total_rows, CAST(0 AS BIGINT) AS null_n_nationkey, count(*) FILTER (WHERE n_nationkey % 5 <> 0) AS null_sparse FROM nation")
def null_shares(spark, sf):
    holes = table(spark, sf, "nation").select("n_nationkey", F.expr("CASE WHEN n_nationkey % 5 = 0 THEN n_name END").alias("sparse"))
    return null_profile(built(spark, holes, ["n_nationkey"]).table("main"))


@registered("touched_codes", BATCH + "SELECT DISTINCT o_orderpriority AS code FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM batch)")
def touched_codes(spark, sf):
    """The codes of the fact rows that a batch's keys meet."""
    keys = upsert_batch(table(spark, sf, "orders")).select("o_orderkey")
    return orders_lake(spark, sf).table("main").join(keys, "o_orderkey", "left_semi").select(F.col("o_orderpriority").alias("code")).distinct()


@expected("dependency_errors", "frame string, outcome string", [("clean", "ok"), ("null code", "ValueError"), ("other codes only", "ok"), ("partly labelled", "ValueError"), ("two labels", "ValueError"), ("clashing names", "ok")])
def dependency_errors(spark, sf):
    """Ten offending codes at most are named; the null check runs if the batch has a null code."""

    def check(rows: Rows, codes: list | None = None) -> str:
        df = spark.createDataFrame(rows, "code string, label string")
        return outcome(lambda: links.check_dependency(df, "code", "label", None if codes is None else spark.createDataFrame([(c,) for c in codes], "c string")))

    clash = spark.createDataFrame([("a", "x")], "low string, labels string")
    return [
        ("clean", check([("01", "a"), ("01", "a"), (None, None)])),
        ("null code", check([(None, "orphan")], [None])),
        ("other codes only", check([("01", "a"), ("01", "b"), (None, "orphan"), ("02", "c")], ["02"])),
        ("partly labelled", check([("01", "a"), ("01", None)])),
        ("two labels", check([("01", "a"), ("01", "b")])),
        ("clashing names", outcome(lambda: links.check_dependency(clash, "low", "labels"))),
    ]
