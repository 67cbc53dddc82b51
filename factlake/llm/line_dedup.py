"""Line dedup by site-relative frequency.

A page is a row, its host a column. A line (trimmed of spaces and tabs) is boilerplate of a host if it is on at least
``MIN_PAGES`` of its pages and on more than ``RATIO`` of them; a line counts once a page. Boilerplate lines are dropped wherever
they are on the host's pages, the others keep their order and bytes; a page of nothing but boilerplate keeps its blank lines only. With
``spare`` such a page stays whole: in a pipeline it is a copy, which near-dedup is to judge by its text.

Lines are counted by (host, 64-bit hash), pre-aggregated before the shuffle, so a hot host is spread over its lines. A host has fewer
boilerplate lines than its mean lines a page over RATIO, hence one small array a host; the arrays are broadcast only if
their measured size is below ``BROADCAST_BYTES``, and are else joined by host, a join that adaptive execution splits for a hot host.

Defined results: a null text stays null and has no lines; a null host is a host of its own; blank lines are never
boilerplate; repeated rows count as so many pages; an empty table gives an empty table. Other columns pass through, whatever their names; a name
for the number of dropped lines that a column has raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.llm.common import cut, free_name

MIN_PAGES = 5
RATIO = 0.02
BROADCAST_BYTES = 8 << 20


def _hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line, F.lit(" \t\r")))


def _not_blank(line: Column) -> Column:
    return F.length(F.trim(line, F.lit(" \t\r"))) > 0


def boilerplate(pages: DataFrame, host: str, text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, lines): the hashes of each host's boilerplate lines, for hosts that have some."""
    own = pages.select(F.col(f"`{host}`").alias("host"), F.col(f"`{text}`").alias("text"))
    lines = F.filter(F.split("text", "\n"), _not_blank)
    counts = (
        own.select("host", F.explode(F.array_distinct(F.transform(lines, _hash))).alias("line"))
        .groupBy("host", "line")
        .agg(F.count(F.lit(1)).alias("on"))
        .filter(F.col("on") >= min_pages)
    )
    totals = own.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).withColumnRenamed("host", "of")
    found = counts.join(totals, F.col("host").eqNullSafe(F.col("of"))).filter(F.col("on") > F.lit(ratio) * F.col("pages"))
    return found.groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("lines"))


def drop_boilerplate(
    pages: DataFrame, host: str, text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, dropped: str | None = None, spare: bool = False
) -> DataFrame:
    """``pages`` with boilerplate lines taken out of their text; ``dropped`` names a column for their number."""
    if dropped is not None and dropped.lower() in {c.lower() for c in pages.columns}:
        raise ValueError(f"there is a column {dropped}")
    found = cut(boilerplate(pages, host, text, ratio, min_pages))
    size = found.agg(F.coalesce(F.sum(F.size("lines") * 8 + F.coalesce(F.length(F.col("host").cast("string")), F.lit(0)) + 64), F.lit(0))).first()[0]
    of, lines = free_name(pages, "_of"), free_name(pages, "_lines")
    found = found.select(F.col("host").alias(of), F.col("lines").alias(lines))
    if size <= BROADCAST_BYTES:
        found = F.broadcast(found)
    joined = pages.join(found, F.col(f"`{host}`").eqNullSafe(F.col(of)), "left")
    parts = F.split(F.col(f"`{text}`"), "\n")
    kept = F.filter(parts, lambda x: ~(_not_blank(x) & F.array_contains(F.col(lines), _hash(x))))
    changed = F.col(lines).isNotNull() & F.exists(kept, _not_blank) if spare else F.col(lines).isNotNull()
    new = F.when(changed, F.array_join(kept, "\n")).otherwise(F.col(f"`{text}`"))
    gone = F.when(changed & F.col(f"`{text}`").isNotNull(), F.size(parts) - F.size(kept)).otherwise(0)
    columns = [new.alias(c) if c == text else F.col(f"`{c}`") for c in pages.columns]
    return joined.select(*columns, *([gone.cast("long").alias(dropped)] if dropped else []))


#: What drop_boilerplate does to documents with their source as host, in DuckDB's SQL.
SQL = f"""
WITH pieces AS (
    SELECT doc_id, source, text, string_split(text, chr(10)) AS parts FROM documents
), lines AS (
    SELECT source, unnest(list_distinct(list_filter(list_transform(parts, lambda x: trim(x, chr(32) || chr(9) || chr(13))), lambda x: length(x) > 0))) AS line FROM pieces
), totals AS (
    SELECT source, count(*) AS pages FROM documents GROUP BY source
), found AS (
    SELECT l.source, l.line FROM lines l JOIN totals t ON l.source IS NOT DISTINCT FROM t.source
    GROUP BY l.source, l.line, t.pages HAVING count(*) >= {MIN_PAGES} AND count(*) > {RATIO}::DOUBLE * t.pages
), sets AS (
    SELECT source, list(line) AS lines FROM found GROUP BY source
), kept AS (
    SELECT p.doc_id, p.source, p.text, p.parts, s.lines,
        list_filter(p.parts, lambda x: NOT list_contains(coalesce(s.lines, []), trim(x, chr(32) || chr(9) || chr(13)))) AS kept
    FROM pieces p LEFT JOIN sets s ON p.source IS NOT DISTINCT FROM s.source
)
SELECT doc_id, source, CASE WHEN lines IS NOT NULL AND text IS NOT NULL THEN array_to_string(kept, chr(10)) ELSE text END AS text,
    CAST(CASE WHEN lines IS NOT NULL AND text IS NOT NULL THEN len(parts) - len(kept) ELSE 0 END AS BIGINT) AS dropped_lines
FROM kept
"""
