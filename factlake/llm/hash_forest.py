"""Approximate nearest neighbours by a hash-prefix forest.

A vector's hash string in a tree is the signs of its products with random directions; a tree is the sorted array of all rows'
strings. A query first descends ``SCOUTS`` of the trees, to its longest prefix that ``LOOK`` rows share. The worst of the k best
found there bounds how near the k-th neighbour is, and so how far all trees must ascend together: to the longest prefixes by which a
vector that near has met the query, in some tree, with probability ``recall``. The vectors below these prefixes are the
candidates; their number follows the data and isn't capped. Where the prefixes would take in as much as a whole tree, one tree is read.

One forest holds the whole table. Its arrays lie in leaves, prefixes of about ``LEAF_ROWS`` rows: what is crowded at one depth is cut by further bits,
and rows that share a whole string by a hash of their id. A row goes once to its leaf of each tree, as 8-bit components; a query goes to the leaves below its
prefix only. Approximate products there come with a bound of their error, so that nothing that may be among the best is lost to the rounding;
what is left, a few rows more than asked for, is scored by exact inner products of the original vectors, in double precision.
Where the rounding leaves a crowd (near copies), the leaf names the query and those rows once each instead of all their pairs; their original vectors
meet in a task for each leaf, which gives the exact best of the leaf, so that rows moved grow with the crowd and not with its square.

Inner products of vectors of different lengths become angles by one more component, which brings every row to the largest norm.
Equal vectors are one row of a tree with their smallest ids (one more than asked for: no more can be in an answer), found by a
pre-aggregated rank, so a vector that a third of all rows share is no hot spot; equal queries are searched once.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, nor do
null ids; repeated ids count as rows of their own among candidates, but a query's own id is never its neighbour; ties go to the smaller id.
Only the two columns named are read, so other columns can have any names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factlake.llm.common import bounded_batches, cut

TREES, BITS = 16, 32
RECALL = 0.9
#: Trees that a query descends first, and the rows that its longest prefix has there at least.
SCOUTS, LOOK = 4, 2048
#: Rows of a leaf on average (twice as many at most), and the bits by which a crowded one is cut.
LEAF_ROWS, STEP = 8192, 3
#: A query is open in a leaf where more than so many times the rows asked for may be among its best.
OPEN = 4
#: Products of a block of queries and rows that are held at a time.
HELD = 1 << 22
#: What single precision may add to an error, relative to the product of the norms.
ROUNDING = 1e-5

LEAF = ["tree", "depth", "node", "part"]
DEALT = "tree int, depth int, node long, part long, query int, lo long, hi long, id long, data binary, size double, bound double"
#: Pairs with the least and the most that their product can be; without id an open query of the leaf (the least is its bound), without query a row that may be among the best of one.
FOUND = "tree int, depth int, node long, part long, query long, id long, low double, high double"


@lru_cache(maxsize=4)
def directions(width: int, trees: int, bits: int) -> np.ndarray:
    return np.random.default_rng(20240601).standard_normal((width, trees * bits))


def strings(vectors: np.ndarray, trees: int, bits: int) -> np.ndarray:
    """Hash strings (rows by trees), their first bit the highest."""
    signs = (vectors @ directions(vectors.shape[1], trees, bits) > 0).reshape(len(vectors), trees, bits)
    return (signs.astype(np.uint64) @ (np.uint64(1) << np.arange(bits - 1, -1, -1, dtype=np.uint64))).astype(np.int64)


def packed(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """8-bit components, the step of each row, and the length of what the rounding took from it."""
    step = np.abs(vectors).max(axis=1) / 127
    codes = np.rint(vectors / step[:, None]).astype(np.int8)
    return codes, step, np.sqrt(((vectors - codes * step[:, None]) ** 2).sum(axis=1))


def ascent(bound: float | None, recall: float = RECALL, trees: int = TREES, bits: int = BITS) -> list[tuple[int, int]]:
    """(tree, depth) of the prefixes under which a vector of cosine ``bound`` or more has met the query with probability ``recall``.

    All trees are at one depth, the first ones a bit deeper where that suffices. One tree from its root, if nothing is known, or if the
    prefixes would hold as many rows as that.
    """
    root = [(trees - 1, 0)]
    if bound is None:
        return root
    same = min(max(1 - math.acos(max(-1.0, min(1.0, bound))) / math.pi, 1e-9), 1 - 1e-9)
    depth = min(bits, math.floor(math.log(1 - (1 - recall) ** (1 / trees)) / math.log(same)))
    missed, deeper = (math.log1p(-(same**d)) if d else -math.inf for d in (depth, depth + 1))
    if depth == bits:
        return [(t, bits) for t in range(trees)]
    more = trees if not depth else max(0, min(trees, math.floor((math.log(1 - recall) - trees * missed) / (deeper - missed))))
    if not depth and trees * deeper > math.log(1 - recall):
        return root
    if (trees - more) * 0.5**depth + more * 0.5 ** (depth + 1) >= 1:
        return root
    return [(t, depth + (t < more)) for t in range(trees)]


def longest(strings_: np.ndarray, own: np.ndarray, depth: int, least: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a sorted leaf at ``depth``: where the rows begin and end that share with each string its longest prefix that ``least`` rows have, else the whole leaf."""
    begin, end = np.zeros(len(own), dtype=np.int64), np.full(len(own), len(strings_))
    for d in range(depth + 1, bits + 1):
        width = bits - d
        low = own >> width << width
        a, b = np.searchsorted(strings_, low), np.searchsorted(strings_, low + (1 << width))
        enough = b - a >= least
        if not enough.any():
            break
        begin, end = np.where(enough, a, begin), np.where(enough, b, end)
    return begin, end


def _spans(begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(begin, end, positions) of equal non-empty spans."""
    order = np.lexsort((end, begin))
    cuts = np.nonzero((np.diff(begin[order]) != 0) | (np.diff(end[order]) != 0))[0] + 1
    for some in np.split(order, cuts):
        if len(some) and begin[some[0]] < end[some[0]]:
            yield int(begin[some[0]]), int(end[some[0]]), some


def least(low: np.ndarray, most: int) -> np.ndarray:
    """The ``most``-th largest of each row; of shorter rows, what all of them reach."""
    if low.shape[1] < most:
        return np.full(len(low), -np.inf, dtype=low.dtype)
    return -np.partition(-low, most - 1, axis=1)[:, most - 1]


class Leaf:
    """The rows of a leaf, by their strings, and what queries find there."""

    def __init__(self, table: pa.Table):
        self.strings, self.ids = table.column("lo").to_numpy(), table.column("id").to_numpy()
        step, self.error = table.column("size").to_numpy(), table.column("bound").to_numpy().astype(np.float32)
        codes = np.frombuffer(b"".join(table.column("data").to_pylist()), dtype=np.int8).reshape(len(step), -1)
        self.rows = codes.astype(np.float32) * step[:, None].astype(np.float32)
        self.told = np.zeros(len(step), dtype=bool)

    def products(self, vectors: np.ndarray, norms: np.ndarray, begin: np.ndarray, end: np.ndarray, reach: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(begin of a span, positions of its queries, products, their errors)."""
        for a, b, some in _spans(begin, end):
            each = max(1, HELD // (b - a))
            for at in range(0, len(some), each):
                own = some[at : at + each]
                yield a, own, vectors[own] @ self.rows[a:b].T, norms[own, None] * (self.error[a:b] + np.float32(ROUNDING * reach))[None, :]

    def found(self, key: list, queries: pa.Table, begin: np.ndarray, end: np.ndarray, bounds: np.ndarray, most: int, reach: float) -> Iterator[pa.RecordBatch]:
        """FOUND of the rows from ``begin`` to ``end`` that reach a query's bound; of a crowd, only those that may be among its ``most`` best here."""
        ids, norms, rounded = queries.column("id").to_numpy(), queries.column("size").to_numpy().astype(np.float32), bounds.astype(np.float32)
        vectors = np.frombuffer(b"".join(queries.column("data").to_pylist()), dtype=np.float32).reshape(len(ids), -1)
        for a, own, product, error in self.products(vectors, norms, begin, end, reach):
            low, high = product - error, product + error
            may = high >= rounded[own, None]
            crowd = np.nonzero(may.sum(axis=1) > OPEN * most)[0]
            may[crowd] &= high[crowd] >= least(low[crowd], most)[:, None]
            undecided = crowd[may[crowd].sum(axis=1) > OPEN * most]
            rows = a + np.nonzero(may[undecided].any(axis=0))[0]
            may[undecided] = False
            which, column = np.nonzero(may)
            yield _found(key, ids[own[which]], self.ids[a + column], low[which, column], high[which, column])
            rows = rows[~self.told[rows]]
            self.told[rows] = True
            yield _found(key, ids[own[undecided]], None, bounds[own[undecided]])
            yield _found(key, None, self.ids[rows])


class Crowd:
    """The rows of a leaf that open queries ask for, with their original vectors."""

    def __init__(self, table: pa.Table):
        self.ids, self.rows = table.column("id").to_numpy(), _matrix(table.column("v").combine_chunks())

    def found(self, key: list, queries: pa.Table, most: int) -> Iterator[pa.RecordBatch]:
        """FOUND of the ``most`` best rows of each query that reach its bound, ties to smaller ids, by products summed in the order of the final scores."""
        ids, bounds, vectors = queries.column("id").to_numpy(), queries.column("bound").to_numpy(), _matrix(queries.column("v").combine_chunks())
        slack = 4 * vectors.shape[1] * np.finfo(np.float64).eps * np.linalg.norm(self.rows, axis=1)
        each = max(1, HELD // 2 // len(self.ids))
        for at in range(0, len(ids), each):
            own = vectors[at : at + each]
            product, error = own @ self.rows.T, np.linalg.norm(own, axis=1)[:, None] * slack[None, :]
            which, column = np.nonzero(product + error >= np.maximum(least(product - error, most), bounds[at : at + each])[:, None])
            score = np.zeros(len(which))
            for x, y in zip(own.T, self.rows.T, strict=True):
                score += x[which] * y[column]
            order = np.lexsort((self.ids[column], -score, which))
            order = order[np.arange(len(order)) - np.searchsorted(which, which[order]) < most]
            yield _found(key, ids[at + which[order]], self.ids[column[order]], score[order], score[order])


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, v, norm) of the rows that take part; v of doubles."""
    own = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    fine = F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    found = own.filter(F.coalesce(fine, F.lit(False))).withColumn("width", F.size("v"))
    widths = found.groupBy("width").count().orderBy(F.desc("count"), "width").limit(1).collect()
    if widths:
        found = found.filter(F.col("width") == widths[0]["width"])
    return found.select("id", "v", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def hashed(vectors: DataFrame, reach: float, asked: bool) -> DataFrame:
    """(id, strings, data, size, bound) of (id, v): of rows 8-bit components, their step and error; of queries single-precision components, their norm and zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column(1))
            norm = np.sqrt((v * v).sum(axis=1))
            rest = np.zeros(len(v)) if asked else np.sqrt(np.maximum(reach**2 - norm**2, 0))
            found = strings(np.column_stack([v, rest]), TREES, BITS)
            data, size, bound = (v.astype(np.float32), norm, np.zeros(len(v))) if asked else packed(v)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * TREES), pa.array(found.ravel()))
            columns = [batch.column(0), lists, pa.array([x.tobytes() for x in data], pa.binary()), pa.array(size), pa.array(bound)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "strings", "data", "size", "bound"])

    return vectors.select("id", "v").mapInArrow(run, "id long, strings array<long>, data binary, size double, bound double")


def crowded(rows: DataFrame, count: int) -> list[tuple[int, DataFrame | None]]:
    """The depths of leaves, and for each the prefixes (tree, node) that are cut further, with their number of parts at the last depth."""
    depth = max(0, min(BITS, round(math.log2(max(1, count) / LEAF_ROWS))))
    left, out = rows.select(F.posexplode("strings").alias("tree", "string")), []
    while True:
        node = F.shiftright("string", BITS - depth).alias("node")
        each = left.groupBy("tree", node).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 2 * LEAF_ROWS)
        found = cut(each.select("tree", "node", F.ceil(F.col("n") / LEAF_ROWS).alias("parts")))
        if found.isEmpty():
            return [*out, (depth, None)]
        out.append((depth, found))
        if depth == BITS:
            return out
        left = left.withColumn("node", node).join(found.select("tree", "node"), ["tree", "node"]).select("tree", "string")
        depth = min(BITS, depth + STEP)


def dealt(df: DataFrame, levels: list[tuple[int, DataFrame | None]], query: int) -> DataFrame:
    """A row of DEALT for each leaf in which strings from ``lo`` to ``hi`` of its tree can lie."""
    left, out = df, []

    def shown(some: DataFrame, depth: int, part) -> DataFrame:
        return some.select("tree", F.lit(depth).alias("depth"), "node", part.cast("long").alias("part"), F.lit(query).alias("query"), "lo", "hi", "id", "data", "size", "bound")

    for depth, cut_further in levels:
        width = BITS - depth
        here = left.withColumn("node", F.explode(F.sequence(F.shiftright("lo", width), F.shiftright("hi", width))))
        first = F.shiftleft("node", width)
        here = here.withColumn("lo", F.greatest("lo", first)).withColumn("hi", F.least("hi", first + F.lit((1 << width) - 1)))
        if cut_further is None:
            out.append(shown(here, depth, F.lit(0)))
            break
        out.append(shown(here.join(cut_further, ["tree", "node"], "left_anti"), depth, F.lit(0)))
        met = here.join(cut_further, ["tree", "node"])
        if depth == BITS:
            # One string in all: cut by a hash of the id; a query goes to each part.
            part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)) if query else F.pmod(F.xxhash64("id"), F.col("parts"))
            out.append(shown(met.withColumn("part", part), depth, F.col("part")))
        left = met.drop("node", "parts")
    return reduce(DataFrame.unionAll, out)


def visit(rows: DataFrame, asked: DataFrame, find: Callable, hold: Callable = Leaf) -> DataFrame:
    """FOUND of what ``find`` (what ``hold`` makes of a leaf's rows, its queries, LEAF) gives in each leaf. Rows of a leaf come before its queries, which stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        key, leaf = None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            marks = np.column_stack([table.column(c).to_numpy() for c in [*LEAF, "query"]])
            cuts = (np.nonzero((np.diff(marks, axis=0) != 0).any(axis=1))[0] + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(marks)], strict=True):
                if a == b:
                    continue
                own = marks[a].tolist()
                if own[:4] != key:
                    held, key, leaf = [], own[:4], None
                some = table.slice(a, b - a)
                if not own[4]:
                    held.append(some)
                    continue
                if leaf is None and held:
                    leaf = hold(pa.concat_tables(held))
                if leaf is not None:
                    yield from find(leaf, some, key)

    both = rows.unionAll(asked).repartition(*LEAF).sortWithinPartitions(*LEAF, "query", "lo")
    return both.mapInArrow(run, FOUND)


def _found(key: list, query: np.ndarray | None, ids: np.ndarray | None, low: np.ndarray | None = None, high: np.ndarray | None = None) -> pa.RecordBatch:
    n = len(ids if query is None else query)
    columns = [pa.array(np.full(n, x), t) for x, t in zip(key, [pa.int32(), pa.int32(), pa.int64(), pa.int64()], strict=True)]
    for x, t in zip((query, ids, low, high), [pa.int64(), pa.int64(), pa.float64(), pa.float64()], strict=True):
        columns.append(pa.nulls(n, t) if x is None else pa.array(x.astype(t.to_pandas_dtype()), t))
    return pa.RecordBatch.from_arrays(columns, names=[*LEAF, "query", "id", "low", "high"])


def decided(found: DataFrame, distinct: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """(query, id, low, high) of FOUND, with the ``most`` best of each leaf for its open queries."""

    def shown(marks: DataFrame, vectors: DataFrame, query: int) -> DataFrame:
        return marks.join(vectors.select("id", "v"), "id").select(*LEAF, F.lit(query).alias("query"), F.col("id").alias("lo"), "id", "v", F.col("low").alias("bound"))

    rows = shown(found.filter(F.col("query").isNull()).select(*LEAF, "id", "low"), distinct, 0)
    asked = shown(found.filter(F.col("id").isNull()).select(*LEAF, F.col("query").alias("id"), "low"), queries, 1)
    exact = visit(rows, asked, lambda crowd, some, key: crowd.found(key, some, most), Crowd)
    pairs = found.filter(F.col("query").isNotNull() & F.col("id").isNotNull())
    return pairs.unionAll(exact).select("query", "id", "low", "high")


def search(vectors: DataFrame, every: int, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    own = cut(usable(vectors, vec_id, vector))
    reach = own.agg(F.max("norm")).first()[0]
    if reach is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # A few smallest ids of each distinct vector; the rank is limited before the shuffle. -0.0 and 0.0 are one.
    plain = own.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    ranked = plain.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("r") <= k + 1)
    distinct = cut(ranked.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("id", F.col("ids")[0]))
    asked = plain.filter(F.col("id") % every == 0)
    queries = cut(asked.groupBy("v").agg(F.min("id").alias("id")))
    rows, hashes = cut(hashed(distinct, reach, False)), cut(hashed(queries, reach, True))
    levels = crowded(rows, rows.count())
    most, look = k + 1, max(LOOK, 2 * (k + 1))

    def spread(trees: range) -> DataFrame:
        in_trees = F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), F.col("strings")[t].alias("lo"), F.col("strings")[t].alias("hi")) for t in trees]))
        return dealt(rows.select("id", "data", "size", "bound", in_trees.alias("t")).select("t.*", "id", "data", "size", "bound"), levels, 0)

    def descend(leaf: Leaf, table: pa.Table, key: list) -> Iterator[pa.RecordBatch]:
        begin, end = longest(leaf.strings, table.column("lo").to_numpy(), key[1], look, BITS)
        yield from leaf.found(key, table, begin, end, np.full(len(table), -np.inf), most, reach)

    def ascend(leaf: Leaf, table: pa.Table, key: list) -> Iterator[pa.RecordBatch]:
        begin = np.searchsorted(leaf.strings, table.column("lo").to_numpy())
        end = np.searchsorted(leaf.strings, table.column("hi").to_numpy(), side="right")
        yield from leaf.found(key, table, begin, end, table.column("bound").to_numpy(), most, reach)

    def merged(found: DataFrame) -> DataFrame:
        """What may be among the best of each query, with the bound that the last of these has reached (null if there are too few)."""
        once = found.groupBy("query", "id").agg(F.max("low").alias("low"), F.min("high").alias("high"))
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("low")))
        last = F.max(F.when(F.col("r") == most, F.col("low"))).over(Window.partitionBy("query"))
        return once.withColumn("r", rank).withColumn("reached", last).filter(F.col("reached").isNull() | (F.col("high") >= F.col("reached"))).drop("r")

    firsts = F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), F.col("strings")[t].alias("lo"), F.col("strings")[t].alias("hi")) for t in range(SCOUTS)]))
    scouts = dealt(hashes.select("id", "data", "size", "bound", firsts.alias("t")).select("t.*", "id", "data", "size", "bound"), levels, 1)
    first = cut(merged(decided(cut(visit(spread(range(SCOUTS)), scouts, descend)), distinct, queries, most)))
    known = first.groupBy("query").agg(F.max("reached").alias("reached"))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, found, data, norm, reached in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for tree, depth in ascent(None if reached is None else reached / (norm * reach), recall):
                    low = found[tree] >> (BITS - depth) << (BITS - depth)
                    out.append((tree, low, low + (1 << (BITS - depth)) - 1, i, data, norm, -math.inf if reached is None else reached))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.float64()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["tree", "lo", "hi", "id", "data", "size", "bound"])

    bounded = hashes.join(known, hashes["id"] == known["query"], "left").select("id", "strings", "data", "size", "reached")
    climbers = dealt(bounded.mapInArrow(prefixes, "tree int, lo long, hi long, id long, data binary, size double, bound double"), levels, 1)
    found = decided(cut(visit(spread(range(TREES)), climbers, ascend)), distinct, queries, most)
    pairs = cut(merged(first.select("query", "id", "low", "high").unionAll(found)).select("query", "id"))
    met = pairs.join(distinct, "id").join(queries.select(F.col("id").alias("query"), F.col("v").alias("w")), "query")
    # One order of summation for all, so that equal vectors score alike.
    exact = met.select("query", "ids", F.aggregate(F.zip_with("v", "w", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x).alias("score"))
    nearest = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    top = cut(exact.select("query", "score", F.explode("ids").alias("vec_id")).withColumn("n", F.row_number().over(nearest)).filter(F.col("n") <= most))
    # Each asking id of a distinct query vector takes its answer, without itself.
    named = asked.select(F.col("id").alias("query_id"), "v").join(queries.withColumnRenamed("id", "query"), "v").select("query_id", "query").distinct()
    answers = named.join(top, "query").filter(F.col("vec_id") != F.col("query_id"))
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return answers.select("query_id", F.row_number().over(last).alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
