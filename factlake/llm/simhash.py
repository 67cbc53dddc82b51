"""SimHash near-duplicate groups by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``radius`` bits share a variant within half the radius of each; and
two fingerprints that share such a variant differ in at most ``radius`` bits. So every fingerprint emits
all variants within half the radius, and the fingerprints that meet in a variant are linked, in a chain
rather than in all pairs: the linked groups are the same.

Shipping 2,081 variants of each 64-bit fingerprint would move thousands of times the fingerprints. Variants
are therefore shuffled by prefix: a fingerprint goes once to each prefix that its variants have (1 + p + p(p-1)/2
of them, for p bits), and the receiving task expands the lower bits. p follows the number of fingerprints
so that a prefix has about ``BUCKET_VARIANTS`` variants. A crowded prefix is split further where it is, so the
memory of a task stays bounded. Links of a prefix leave it as a star; stars are joined by alternating large-star
and small-star rounds, each cut by a checkpoint.

Near-dedup of a corpus (keep_one) goes by the similarity of word-shingle sets. There a document has TABLES fingerprints of 32 bits, and the ball
has radius 2: two documents of similarity 0.8 meet in one of the tables 95 times in 100, for 33 variants a table. The pairs that meet
are judged by all their bits: similar, not similar, or open. First each is compared with the smallest of its variant; documents of equal fingerprint in a
table meet as a star around the smallest, ahead of the shuffle of variants, so a large group of near copies arrives there as its few different
fingerprints. What is similar or open makes a crowd. Similarity is not transitive, so then all other pairs that meet are judged too, but for those within a
crowd. At last all texts of a crowd that no sure link joins are compared whole, in blocks within tasks (crowd_links), so that the pairs of a large group of
near copies, whose number grows with its square, are never rows. Bits say little of a text of few shingles (counts tie): pairs with one of SHORT or fewer are
verified by their shingles alone, and are found exactly, by the rarest of each: two sets of similarity s share one of the n - ceil(s n) + 1 rarest of each.

Defined results: a null text is an empty text; a text without words has fingerprint zero and links like
any other; repeated rows get the same component; a null doc_id takes part, but its component's id is the smallest
doc_id that isn't null (null if there is none). doc_ids are below 2**62.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlake.llm.common import bounded_batches, cut, free_name, release, sole_cache

BITS = 64
#: Variants that a prefix has on average, and the most that are sorted at a time: a prefix with more is split.
BUCKET_VARIANTS, SORTED_VARIANTS = 1 << 20, 1 << 21
#: Ids from here on stand for fingerprints that have no doc_id.
NAMELESS = 1 << 62
SEED = 42
#: Fingerprints of near-dedup, their bits and radius, and the tables whose variants are shuffled at a time.
TABLES, TABLE_BITS, TABLE_RADIUS, TABLES_AT_ONCE = 24, 32, 2, 8
SIMILARITY = 0.8
#: Standard deviations of the share of differing bits beyond which a pair is judged by it alone. What is taken as similar unread errs at most
#: once in 2,000 pairs just below the similarity, what is discarded unread once in 10**9 pairs at it.
SURE_SIMILAR, SURE_DIFFERENT = 3.3, 6.0
WORDS_KEPT = 200_000
#: Edges that are joined on the driver (4 MB); more go through rounds, whose many small jobs cost the driver more than that.
LOCAL_EDGES = 1 << 18
#: Texts and shingles of a block of a crowd, about; shingles whose texts are a matrix at a time.
BLOCK_ROWS, BLOCK_SHINGLES, CODES_AT_ONCE = 64, 1 << 18, 4096
#: Distinct shingles up to which a text has too few for its bits: below 32 the tables find fewer than 95 of 100 pairs of similarity 0.8.
SHORT = 32
#: The table of the keys of short texts.
KEYS = -1


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """The XXH64 of each of a text's word shingles, in order; of all its words if they are fewer; none of a text without words."""
    found = text.encode().lower().split()  # on bytes: A-Z, and white space of ASCII
    if not found:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1)[: len(found) - words + 1].tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], dtype=np.uint64)


def simhashes(hashes: list[np.ndarray], tables: int = 1) -> np.ndarray:
    """SimHashes (rows by tables) of each array of hashes: a bit is set if it is in over half of them. An empty array has zeros.

    Bits are counted eight at a time, each in a byte of a 64-bit sum of at most 255 hashes.
    """
    out = np.zeros((len(hashes), tables), dtype=np.uint64)
    lengths = np.array([len(x) for x in hashes], dtype=np.int64)
    some = np.nonzero(lengths)[0]
    if not len(some):
        return out
    every, lengths = np.concatenate(hashes), lengths[some]
    parts = -(-lengths // 255)
    first = np.cumsum(parts) - parts
    starts = np.repeat(np.cumsum(lengths) - lengths, parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    lanes = np.uint64(0x0101010101010101)
    for t in range(tables):
        mixed = _mixed(every, t)
        ones = np.empty((len(some), 8, 8), dtype=np.int64)
        for k in range(8):
            sums = np.add.reduceat((mixed >> np.uint64(k)) & lanes, starts).astype("<u8").view(np.uint8).reshape(-1, 8)
            ones[:, :, k] = np.add.reduceat(sums.astype(np.int64), first, axis=0)
        bits = ones.reshape(-1, BITS) * 2 > lengths[:, None]
        out[some, t] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprint(text: str, words: int, tables: int = 1) -> list[int]:
    """The SimHashes of a text's word shingles, repeats included: the first of their XXH64, the others of further mixtures of it."""
    return simhashes([shingle_hashes(text, words)], tables)[0].tolist()


class _WordHashes(dict):
    """The XXH64 of words, kept for a worker's life, in bounded memory."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return found


_WORDS = _WordHashes()


def forget_words() -> None:
    """Called at the end of a task: idle workers stay, and their memory counts."""
    _WORDS.clear()


def shingle_set(text: str, words: int) -> np.ndarray:
    """A 64-bit hash of each distinct word shingle, sorted: those of its words, mixed in order. Shingles and no-word texts as in shingle_hashes()."""
    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    own = np.fromiter(map(_WORDS.__getitem__, found), dtype=np.uint64, count=len(found))
    width = min(words, len(own))
    mixed = np.zeros(len(own) - width + 1, dtype=np.uint64)
    for k in range(width):
        mixed = _mixed(mixed ^ own[k : k + len(mixed)], k + 1)
    return np.unique(mixed)


def _mixed(hashes: np.ndarray, table: int) -> np.ndarray:
    """The hashes of one table: for all but the first, a finalizer over the hash and the table's number."""
    if not table:
        return hashes
    x = hashes + np.uint64((table * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, words: int, tables: int = 1, text: str = "text", out: str = "fingerprint", hashes: Callable[[str, int], np.ndarray] = shingle_hashes, few: int | None = None) -> DataFrame:
    """``docs`` without its text, with an array of ``tables`` fingerprints (signed 64-bit) of what ``hashes`` gives. Map-only.

    With ``few`` a column ``shingles`` has the hashes themselves where they are no more than that, else null.
    """
    bounded_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != text]
    name = free_name(docs.select(*rest), out)
    schema = T.StructType([*docs.select(*rest).schema.fields, T.StructField(name, T.ArrayType(T.LongType(), False), False)])
    if few is not None:
        schema = schema.add("shingles", T.ArrayType(T.LongType(), False), True)
    at, kept = docs.columns.index(text), [i for i, c in enumerate(docs.columns) if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_cache(None)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            own = [hashes(x or "", words) for x in texts]
            values = simhashes(own, tables).ravel().view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * tables), pa.array(values))
            some = [] if few is None else [pa.array([x.view(np.int64) if len(x) <= few else None for x in own], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), lists, *some], names=[*rest, name, *["shingles"] * len(some)])
        forget_words()

    return docs.mapInArrow(run, schema)


def masks(bits: int, most: int) -> list[int]:
    """All values of ``bits`` bits with at most ``most`` ones."""
    return [sum(1 << i for i in chosen) for k in range(most + 1) for chosen in combinations(range(bits), k)]


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.astype(np.uint64)).astype(np.int64)


def _roots(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position of each position's component, of links a-b."""
    root = np.arange(count)
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            return root
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]


def link_prefix(prints: np.ndarray, prefix: int, bits: int, half: int, limit: int = SORTED_VARIANTS, width: int = BITS, stars: bool = False, ends: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions) of the distinct fingerprints of ``width`` bits that share a variant under ``prefix``, a value of ``bits`` bits.

    Those of a variant are linked in a chain; with ``stars`` each to the first; with ``ends``, the lowest and
    the highest component of each fingerprint, in all pairs but those of a single component.
    """
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    waiting = [(np.arange(len(prints)), prefix, bits)]
    while waiting:
        own, value, depth = waiting.pop()
        low = width - depth
        top = prints[own] >> np.uint64(low) if depth else np.zeros(len(own), dtype=np.uint64)
        spare = half - _ones(top ^ np.uint64(value))
        own, spare = own[spare >= 0], spare[spare >= 0]
        if len(own) < 2:
            continue
        sizes = [len(masks_of(low, k)) for k in range(half + 1)]
        if sum(int((spare == k).sum()) * sizes[k] for k in range(half + 1)) > limit and low >= 4:
            waiting += [(own, (value << 4) | nibble, depth + 4) for nibble in range(16)]
            continue
        head = np.uint64(value << low if depth else 0)
        tail = np.uint64((1 << low) - 1)
        variants, owners = [], []
        for k in range(half + 1):
            of = own[spare == k]
            if len(of):
                variants.append((head | ((prints[of] & tail)[:, None] ^ masks_of(low, k)[None, :])).ravel())
                owners.append(np.repeat(of, sizes[k]))
        variant, owner = np.concatenate(variants), np.concatenate(owners)
        order = np.lexsort((owner, variant)) if stars else np.argsort(variant)
        variant, owner = variant[order], owner[order]
        same = variant[1:] == variant[:-1]
        meet = np.nonzero(same)[0]
        if len(meet):
            a, b = owner[meet], owner[meet + 1]
            if ends is not None:
                # A variant has no more distinct fingerprints than there are masks, so these steps are as few.
                every, step = [], 1
                while len(at := np.nonzero(variant[step:] == variant[:-step])[0]):
                    x, y = owner[at], owner[at + step]
                    apart = (ends[0][x] != ends[1][x]) | (ends[0][y] != ends[1][y]) | (ends[0][x] != ends[0][y])
                    every.append((x[apart], y[apart]))
                    step += 1
                a, b = (np.concatenate([z[k] for z in every]) for k in (0, 1))
            elif stars:
                firsts = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(owner)), 0))
                a = owner[firsts[meet + 1]]
            pairs = np.divmod(np.unique(np.minimum(a, b) * len(prints) + np.maximum(a, b)), len(prints))
            # What meets is within twice the half radius; the check costs nothing and guards the expansion.
            near = _ones(prints[pairs[0]] ^ prints[pairs[1]]) <= 2 * half
            left.append(pairs[0][near])
            right.append(pairs[1][near])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


_MASKS: dict[tuple[int, int], np.ndarray] = {}


def masks_of(bits: int, most: int) -> np.ndarray:
    if (bits, most) not in _MASKS:
        _MASKS[bits, most] = np.array(masks(bits, most), dtype=np.uint64)
    return _MASKS[bits, most]


def prefix_bits(count: int, half: int, width: int = BITS) -> int:
    """Bits of the prefix by which variants are shuffled, for so many fingerprints."""
    variants = max(1, count) * len(masks(width, half))
    return min(width // 2, max(6 if width == BITS else 3, (variants // BUCKET_VARIANTS).bit_length()))


def linked(nodes: DataFrame, radius: int, count: int, width: int = BITS, pairs: bool = False) -> DataFrame:
    """Links (a, b), a > b, of ``nodes`` (node, print: distinct prints) whose prints of ``width`` bits differ in at most ``radius`` bits.

    A star for each prefix, so a third node may stand between two; with ``pairs`` what link_prefix() gives as stars, for pairs that are
    yet to be verified. A column ``table`` of nodes keeps several sets of prints apart. Only an even radius can be halved, and only then is
    whatever meets in a variant within the radius.
    """
    if radius < 0 or radius % 2:
        raise ValueError("the radius must be even")
    half = radius // 2
    p = prefix_bits(count, half, width)
    top = F.shiftrightunsigned(F.col("print"), width - p)
    steps = F.array(*[F.lit(m).cast("long") for m in masks(p, half)])
    table = F.col("table").cast("long") if "table" in nodes.columns else F.lit(0).cast("long")
    keys = F.transform(steps, lambda m: F.shiftleft(table, p).bitwiseOR(top.bitwiseXOR(m)))
    sent = nodes.select("node", "print", F.explode(keys).alias("prefix"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by prefix; a prefix may span batches."""
        held: list[np.ndarray] = []
        at = None

        def close() -> Iterator[pa.RecordBatch]:
            node, prints = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]).view(np.uint64)
            order = np.argsort(node)
            node, prints = node[order], prints[order]
            a, b = link_prefix(prints, at & ((1 << p) - 1), p, half, width=width, stars=pairs)
            if len(a) and pairs:
                yield pa.RecordBatch.from_arrays([pa.array(node[b]), pa.array(node[a])], names=["a", "b"])
            elif len(a):
                root = _roots(len(node), a, b)
                far = np.nonzero(root != np.arange(len(node)))[0]
                yield pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(node[root[far]])], names=["a", "b"])

        for batch in batches:
            node, prints, prefix = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.nonzero(np.diff(prefix))[0] + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(prefix)], strict=True):
                if a == b:
                    continue
                if at is not None and prefix[a] != at:
                    yield from close()
                    held = []
                at = int(prefix[a])
                held.append((node[a:b], prints[a:b]))
        if held:
            yield from close()

    dealt = sent.repartition("prefix").sortWithinPartitions("prefix")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def unjoined(buckets: DataFrame, radius: int, count: int, width: int) -> DataFrame:
    """(table, print_a, print_b): all pairs of ``buckets`` (table, print, low, high: ends of its components) within ``radius`` bits that hold two components or more.

    A bucket of several components is a pair with itself. What meets is within twice half the radius, so an even radius is exact.
    """
    half = radius // 2
    p = prefix_bits(count, half, width)
    top = F.shiftrightunsigned(F.col("print"), width - p)
    steps = F.array(*[F.lit(m).cast("long") for m in masks(p, half)])
    keys = F.transform(steps, lambda m: F.shiftleft(F.col("table").cast("long"), p).bitwiseOR(top.bitwiseXOR(m)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        at = None

        def close() -> Iterator[pa.RecordBatch]:
            prints, low, high = np.concatenate(held, axis=1)
            a, b = link_prefix(prints.view(np.uint64), at & ((1 << p) - 1), p, half, width=width, ends=(low, high))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), at >> p, dtype=np.int64)), pa.array(prints[a]), pa.array(prints[b])], names=["table", "print_a", "print_b"])

        for batch in batches:
            own = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            prefix = batch.column(3).to_numpy(zero_copy_only=False)
            cuts = np.nonzero(np.diff(prefix))[0] + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(prefix)], strict=True):
                if a == b:
                    continue
                if at is not None and prefix[a] != at:
                    yield from close()
                    held = []
                at = int(prefix[a])
                held.append(own[:, a:b])
        if held:
            yield from close()

    dealt = buckets.select("print", "low", "high", F.explode(keys).alias("prefix")).repartition("prefix").sortWithinPartitions("prefix")
    # A pair may meet in several prefixes, and in either order.
    met = dealt.mapInArrow(run, "table long, print_a long, print_b long")
    met = met.select("table", F.least("print_a", "print_b").alias("print_a"), F.greatest("print_a", "print_b").alias("print_b"))
    return met.union(buckets.filter("low <> high").select(F.col("table").cast("long"), "print", "print")).distinct()


def between(met: DataFrame, own: DataFrame) -> DataFrame:
    """(a, b), a > b: the pairs of nodes of different components, one in each of two buckets that ``met``; ``own`` has table, print, node, component."""
    sides = [own.select("table", F.col("print").alias(f"print_{x}"), F.col("node").alias(f"node_{x}"), F.col("component").alias(f"component_{x}")) for x in ("a", "b")]
    found = met.join(sides[0], ["table", "print_a"]).join(sides[1], ["table", "print_b"]).filter("component_a <> component_b")
    return found.select(F.greatest("node_a", "node_b").alias("a"), F.least("node_a", "node_b").alias("b")).distinct()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step over distinct edges (a, b), a > b."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    lowest = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    met = both.join(lowest, "u")
    out = met.filter(F.col("v") > F.col("u")) if large else met.filter(F.col("v") != F.col("m"))
    out = out.select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.union(lowest.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of its component, for every node that isn't itself the smallest.

    Each round is a large-star and a small-star step, until every node has one edge and no node has edges on both sides, or until
    so few edges are left that the driver joins them.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    while True:
        count, sources = edges.agg(F.count(F.lit(1)), F.count_distinct("a")).first()
        if count <= LOCAL_EDGES:
            return _few_components(edges)
        if count == sources and edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        edges = cut(_star(cut(_star(edges, True)), False))


def _few_components(edges: DataFrame) -> DataFrame:
    """What components() gives, found on the driver."""
    a, b = (column.to_numpy() for column in edges.select("a", "b").toArrow().columns)
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = _roots(len(ids), at[: len(a)], at[len(a) :])
    far = np.nonzero(root != np.arange(len(ids)))[0]
    found = pa.table({"node": pa.array(ids[far], pa.int64()), "component": pa.array(ids[root[far]], pa.int64())})
    return edges.sparkSession.createDataFrame(found)


def _hex(print_: Column) -> Column:
    return F.lower(F.lpad(F.hex(print_), 16, "0"))


def groups(docs: DataFrame, words: int = 5, radius: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (hex), component_id of fingerprints linked at ``radius`` bits or fewer."""
    prints = cut(fingerprints(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), words, out="prints"))
    prints = prints.select("doc_id", F.col("prints")[0].alias("print"))
    # A fingerprint's node is its smallest doc_id; copies of a text meet here, before anything is emitted.
    named = prints.groupBy("print").agg(F.min("doc_id").alias("least"))
    nodes = cut(named.select("print", F.coalesce("least", F.lit(NAMELESS).bitwiseOR(F.abs(F.shiftright(F.xxhash64("print"), 2)))).alias("node")))
    links = cut(linked(nodes, radius, nodes.count()))
    release(docs.sparkSession)
    found = components(links)
    named = cut(nodes.join(found, "node", "left").select("print", F.coalesce("component", "node").alias("component")))
    return prints.join(named, "print").select("doc_id", _hex(F.col("print")).alias("fingerprint"), F.when(F.col("component") < NAMELESS, F.col("component")).alias("component_id"))


def bounds(similarity: float, bits: int) -> tuple[int, int]:
    """Differing bits up to which a pair is surely as similar, and from beyond which it surely is not."""
    apart = math.acos(2 * similarity / (1 + similarity)) / math.pi
    spread = math.sqrt(apart * (1 - apart) / bits)
    return math.floor((apart - SURE_SIMILAR * spread) * bits), math.ceil((apart + SURE_DIFFERENT * spread) * bits)


def rare_keys(nodes: DataFrame, similarity: float) -> DataFrame:
    """(table, print, node): for each of ``nodes`` (node, shingles) its rarest shingles, so many that two sets as similar share one."""
    each = nodes.select("node", F.explode("shingles").alias("print"))
    ranked = each.join(each.groupBy("print").agg(F.count(F.lit(1)).alias("on")), "print").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("on", "print"))).alias("ranked"))
    size = F.size("ranked")
    # The margin is for products that rounding has lifted above a whole number.
    kept = (size - F.ceil(F.lit(similarity) * size - F.lit(1e-9)) + 1).cast("int")
    return ranked.select("node", F.explode(F.slice("ranked", F.lit(1), kept)).alias("own")).select(F.lit(KEYS).alias("table"), F.col("own.print").alias("print"), "node")


def near_links(docs: DataFrame, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Of ``docs`` (doc_id, text; no null ids): (doc_id, node) of all rows, and links (a, b), a > b, of nodes of similar texts.

    A node is the smallest doc_id of those whose fingerprints are all equal. Links are enough to join all similar texts that meet, not all of their pairs.
    """
    spark = docs.sparkSession
    prints = cut(fingerprints(docs, words, TABLES * TABLE_BITS // BITS, out="prints", hashes=shingle_set, few=math.floor(SHORT / similarity)))
    # Equal prints are of equal sets where these are small.
    sized = cut(prints.groupBy("prints").agg(F.min("doc_id").alias("node"), F.min("shingles").alias("shingles")))
    nodes = sized.select("prints", "node")
    keys = cut(rare_keys(sized.filter("shingles IS NOT NULL").select("node", "shingles"), similarity))
    count = nodes.count()
    sure, most = bounds(similarity, TABLES * TABLE_BITS)
    size = F.when(F.col("shingles").isNotNull(), F.size("shingles")).otherwise(1 << 30)
    sides = [sized.select(F.col("node").alias(x), F.col("prints").alias(f"prints_{x}"), F.col("shingles").alias(f"shingles_{x}"), size.alias(f"size_{x}")) for x in ("a", "b")]
    less, more = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
    both = F.size(F.array_intersect("shingles_a", "shingles_b"))
    apart = F.aggregate(F.zip_with("prints_a", "prints_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)

    def spread(of: DataFrame, first: int) -> DataFrame:
        """A row for each table from ``first`` on that is shuffled at a time: the table and its print besides the columns of ``of``."""
        tables = range(first, min(first + TABLES_AT_ONCE, TABLES))
        each = [F.struct(F.lit(t).alias("table"), F.shiftrightunsigned(F.col("prints")[t // 2], TABLE_BITS * (t % 2)).bitwiseAND(F.lit((1 << TABLE_BITS) - 1)).alias("print")) for t in tables]
        return of.select(*[c for c in of.columns if c != "prints"], F.inline(F.array(*each)))

    def open_or_sure(found: DataFrame) -> DataFrame:
        """(a, b, sure): the pairs whose shingles (of a short text) or bits confirm them, and those that bits leave open."""
        pairs = found.distinct().join(sides[0], "a").join(sides[1], "b").withColumn("short", less <= SHORT)
        # Of a short text and one of a size that allows the similarity, both have their shingles here.
        near = F.when(less < F.lit(similarity) * more - F.lit(1e-9), False).otherwise(both / (less + more - both) >= similarity)
        pairs = pairs.withColumn("apart", F.when(~F.col("short"), apart))
        pairs = cut(pairs.filter(F.when(F.col("short"), near).otherwise(F.col("apart") <= most)).select("a", "b", (F.col("short") | (F.col("apart") <= sure)).alias("sure")))
        release(spark)
        return pairs

    least = keys.groupBy("print").agg(F.min("node").alias("least"))
    found = cut(keys.join(least, "print").filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct())
    for first in range(0, TABLES, TABLES_AT_ONCE):
        own = spread(nodes, first)
        least = cut(own.groupBy("table", "print").agg(F.min("node").alias("least")))
        met = own.join(least, ["table", "print"]).filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
        met = cut(met.union(linked(least.withColumnRenamed("least", "node"), TABLE_RADIUS, count, TABLE_BITS, pairs=True)))
        found = found.union(met)
        # The shuffles of these tables can go before those of the next are written.
        release(spark)
    pairs = open_or_sure(found)
    crowds = components(pairs.select("a", "b"))
    # Whatever meets another has been in a pair by now, so all other nodes are out of it.
    some = found.select(F.col("a").alias("node")).union(found.select("b")).distinct()
    joined = nodes.join(some, "node", "left_semi").join(crowds, "node", "left")
    joined = cut(joined.select("node", "prints", F.coalesce("component", "node").alias("component")))
    own = keys.join(joined.select("node", "component"), "node")
    several = own.groupBy("table", "print").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    found = cut(between(several.select("table", F.col("print").alias("print_a"), F.col("print").alias("print_b")), own))
    for first in range(0, TABLES, TABLES_AT_ONCE):
        own = spread(joined, first)
        buckets = cut(own.groupBy("table", "print").agg(F.min("component").alias("low"), F.max("component").alias("high")))
        met = cut(unjoined(buckets, TABLE_RADIUS, count, TABLE_BITS))
        met = cut(between(met, own))
        found = found.union(met)
        release(spark)
    others = open_or_sure(found)
    if not others.isEmpty():
        crowds = components(crowds.select(F.col("node").alias("a"), F.col("component").alias("b")).union(others.select("a", "b")))
    links = cut(pairs.union(others).filter("sure").select("a", "b"))
    return prints.join(nodes, "prints").select("doc_id", "node"), links.union(crowd_links(docs, crowds, components(links), words, similarity))


def crowd_links(docs: DataFrame, crowds: DataFrame, known: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links (a, b), a > b, that join what is similar by whole texts within each of ``crowds`` (node, component), beyond the components ``known``.

    All pairs of a crowd but those of one component are compared, and none is a row: the crowd is dealt into blocks, and a task has two blocks at a
    time. Blocks of the crowd's largest component don't meet one another. A node goes to as many tasks as its crowd has blocks.
    """
    spark = docs.sparkSession
    ends = crowds.select("component").distinct()
    members = crowds.select("node", F.col("component").alias("crowd")).union(ends.select("component", "component"))
    members = cut(members.join(known, "node", "left").select("node", "crowd", F.coalesce("component", "node").alias("component")))
    parts = members.groupBy("crowd", "component").agg(F.count(F.lit(1)).alias("n"))
    mains = cut(parts.groupBy("crowd").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("parts")).filter("parts > 1"))
    members = members.join(mains, "crowd").select("node", "crowd", "component", (F.col("component") != F.col("main")).alias("rest"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingle_set(x or "", words).tobytes() for x in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(own, pa.binary())], names=["node", "crowd", "component", "rest", "own"])
        forget_words()

    # Rows may repeat a doc_id; nodes are of its smallest text then, as good as any other.
    texts = docs.join(members, F.col("doc_id") == F.col("node")).select("node", "crowd", "component", "rest", "text")
    texts = cut(texts.mapInArrow(sets, "node long, crowd long, component long, rest boolean, own binary"))
    size = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum(F.length("own") / 8) / BLOCK_SHINGLES))
    sizes = texts.groupBy("crowd", "rest").agg(size.cast("int").alias("blocks"))
    sizes = cut(sizes.groupBy("crowd").agg(F.max(F.when(F.col("rest"), F.col("blocks"))).alias("rests"), F.max(F.when(~F.col("rest"), F.col("blocks"))).alias("mains")))
    # Blocks of the rest are numbered before those of the largest component.
    block = F.pmod(F.xxhash64("node"), F.when(F.col("rest"), F.col("rests")).otherwise(F.col("mains"))).cast("int") + F.when(F.col("rest"), 0).otherwise(F.col("rests"))
    last = F.col("rests") - 1 + F.when(F.col("rest"), F.col("mains")).otherwise(0)
    dealt = texts.join(sizes, "crowd").select("node", "component", "own", "crowd", block.alias("block"), F.explode(F.sequence(F.lit(0), last)).alias("other"))
    dealt = dealt.select("crowd", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "component", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by crowd and pair of blocks; a pair may span batches."""
        held: list[tuple[int, int, int, np.ndarray]] = []
        at = None

        def close() -> pa.RecordBatch:
            low = [x for x in held if x[0] == at[1]]
            high = low if at[1] == at[2] else [x for x in held if x[0] == at[2]]
            near = similar([x[3] for x in low], [x[3] for x in high], similarity)
            ends = forest([(low[i][1:3], high[j][1:3]) for i, j in np.argwhere(near).tolist()])
            return pa.RecordBatch.from_arrays([pa.array([max(e) for e in ends], pa.int64()), pa.array([min(e) for e in ends], pa.int64())], names=["a", "b"])

        for batch in batches:
            own = zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True)
            for crowd, low, high, block, node, component, data in own:
                if at != (crowd, low, high):
                    if held:
                        yield close()
                    held, at = [], (crowd, low, high)
                held.append((block, node, component, np.frombuffer(data, dtype=np.uint64)))
        if held:
            yield close()

    bounded_batches(spark)
    by = ["crowd", "low", "high"]
    links = cut(dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "a long, b long").distinct())
    release(spark)
    return links


def similar(x: list[np.ndarray], y: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of the sets ``x`` (rows) are as similar to which of ``y``: by shared ones over all of either, 1 if both are empty."""
    lengths = [np.array([len(s) for s in sets], dtype=np.int64) for sets in (x, y)]
    every, codes = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *x, *y]), return_inverse=True)
    codes = np.split(codes, [lengths[0].sum()])
    owners = [np.repeat(np.arange(len(n)), n) for n in lengths]
    order = [np.argsort(c, kind="stable") for c in codes]
    codes, owners = [c[o] for c, o in zip(codes, order, strict=True)], [c[o] for c, o in zip(owners, order, strict=True)]
    both = np.zeros((len(x), len(y)))
    for first in range(0, len(every), CODES_AT_ONCE):
        has = []
        for code, owner, n in zip(codes, owners, lengths, strict=True):
            a, b = np.searchsorted(code, [first, first + CODES_AT_ONCE])
            one = np.zeros((len(n), CODES_AT_ONCE), dtype=np.float32)
            one[owner[a:b], code[a:b] - first] = 1
            has.append(one)
        both += has[0] @ has[1].T
    either = lengths[0][:, None] + lengths[1][None, :] - both
    return np.where(either > 0, both / np.maximum(either, 1), 1.0) >= similarity


def forest(pairs: list[tuple[tuple[int, int], tuple[int, int]]]) -> list[tuple[int, int]]:
    """Of pairs of (node, component) the nodes of so many that all components that pairs join are joined."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (above := root.setdefault(x, x)) != x:
            root[x] = x = root[above]
        return x

    out = []
    for (a, x), (b, y) in pairs:
        if (x := top(x)) != (y := top(y)):
            root[x] = y
            out.append((a, b))
    return out


def keep_one(docs: DataFrame, words: int = 5, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without those that are near copies of a row with a smaller doc_id.

    The document that stays is the one whose doc_id is its component's; of rows that repeat its doc_id, one stays (the first
    by all columns). Rows with a null doc_id stay: they can't be told apart.
    """
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).filter("doc_id IS NOT NULL")
    named, links = near_links(own, words, similarity)
    found = named.join(components(links), "node", "left").select("doc_id", F.coalesce("component", "node").alias("component"))
    own_id, other = F.col(f"`{doc_id}`"), free_name(docs, "_gone")
    gone = cut(found.filter("doc_id <> component").select(F.col("doc_id").alias(other)).distinct())
    left = docs.join(gone, own_id.cast("long") == F.col(other), "left_anti")
    ids = docs.select(own_id.alias("id")).filter("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    if ids.filter("n > 1").isEmpty():
        return left
    rank = free_name(docs, "_rank")
    order = [F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, T.MapType)]
    ranked = left.filter(own_id.isNotNull()).withColumn(rank, F.row_number().over(Window.partitionBy(own_id).orderBy(*order)))
    return ranked.filter(F.col(rank) == 1).drop(rank).unionByName(left.filter(own_id.isNull()))
