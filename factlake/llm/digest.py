"""Quartile bucket digests of documents.

The UTF-8 bytes of a text are read as triplets (positions i, i + 5, i + 11), each hashed into one of 1,024
buckets. A bucket's code, two bits, is the number of quartiles of all counts that its count exceeds. The digest is one byte of
logarithmic length and the codes: 257 bytes, in hex. Two digests differ by the sum of their codes' differences and of a bounded
penalty for the length; likeness is one less that share of the largest possible difference.

Defined results: a null text is an empty text; the digest of an empty text has length code zero and zero codes; a text shorter than
a triplet's span is read as if repeated; equal texts have equal digests. Documents are ordered by doc_id, descending,
nulls last; rows that repeat a doc_id by a hash of their text (where ranges of rows repeat it, within each of the parts that it is cut into); the
last document's next is the first, a lone document's is itself. Columns but the two named aren't read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.llm.common import bounded_batches

BUCKETS = 1024
OFFSETS = (5, 11)
#: Weight of a step of the length code (a factor of 1.1), and the most steps that count.
LENGTH_WEIGHT, LENGTH_STEPS = 12, 16
LARGEST = 3 * BUCKETS + LENGTH_WEIGHT * LENGTH_STEPS
#: Rows of a range of doc_ids on average, and the most ranges; a range is streamed, so it need not fit in memory. A doc_id with two ranges of rows is cut into parts.
RANGE_ROWS, MOST_RANGES = 8192, 10_000
LOWEST = -(1 << 63)
#: Parts that a doc_id can have.
PARTS = 1 << 20


def counts(data: bytes) -> np.ndarray:
    """Triplets in each bucket."""
    if not data:
        return np.zeros(BUCKETS, dtype=np.int64)
    if len(data) <= OFFSETS[1]:
        data *= OFFSETS[1] // len(data) + 2
    total = np.zeros(BUCKETS, dtype=np.int64)
    span, block = OFFSETS[1], 1 << 20
    for at in range(0, len(data) - span, block):
        b = np.frombuffer(data, dtype=np.uint8, count=min(block + span, len(data) - at), offset=at).astype(np.uint32)
        n = len(b) - span
        h = (b[:n] | (b[OFFSETS[0] : n + OFFSETS[0]] << np.uint32(8)) | (b[span:] << np.uint32(16))) * np.uint32(2654435761)
        h ^= h >> np.uint32(15)
        h *= np.uint32(2246822519)
        total += np.bincount(h >> np.uint32(22), minlength=BUCKETS)
    return total


def digest(data: bytes) -> bytes:
    """The digest of a text's UTF-8 bytes."""
    found = counts(data)
    ranked = np.sort(found)
    codes = sum((found > ranked[k * BUCKETS // 4 - 1]).astype(np.uint8) for k in (1, 2, 3))
    packed = codes[0::4] | (codes[1::4] << 2) | (codes[2::4] << 4) | (codes[3::4] << 6)
    length = 0 if not data else min(255, 1 + round(math.log(len(data)) / math.log(1.1)))
    return bytes([length]) + packed.astype(np.uint8).tobytes()


_SPREAD = np.array([[(b >> s) & 3 for s in (0, 2, 4, 6)] for b in range(256)], dtype=np.int8)
#: Summed difference of the four codes in two bytes.
_APART = np.abs(_SPREAD[:, None, :] - _SPREAD[None, :, :]).sum(axis=2).astype(np.uint8)


def difference(a: bytes, b: bytes) -> int:
    """Bounded by LARGEST."""
    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    steps = min(abs(int(x[0]) - int(y[0])), LENGTH_STEPS)
    return int(_APART[x[1:], y[1:]].sum(dtype=np.int64)) + LENGTH_WEIGHT * steps


def likeness(a: bytes, b: bytes) -> float:
    return 1.0 - difference(a, b) / LARGEST


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of every document and of its edited text, and their likeness: the rows of the op9 contract.

    Ids are cut into ranges by approximate quantiles, and a doc_id that is hotter than a range has ranges of its own, into which its rows are
    dealt; each range also gets the head of the range that follows it. So every task sees its documents in order, with one shuffle of the
    compressed texts, a task a range, and no global window.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    own_id = F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LOWEST))
    # A row's number only deals the rows of a hot doc_id to its parts.
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), own_id.alias("key"), F.monotonically_increasing_id().alias("number"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    keys = source.select("key")
    count = keys.count()
    ranges = max(1, min(MOST_RANGES, -(-count // RANGE_ROWS)))
    each = max(1, -(-count // ranges))
    # At most MOST_RANGES / 2 of them.
    hot = {r["key"]: min(PARTS, -(-r["count"] // each)) for r in keys.groupBy("key").count().filter(F.col("count") > 2 * each).collect()}
    shares = ", ".join(f"{i / ranges}D" for i in range(1, ranges))
    bounds = np.zeros(0, dtype=np.int64)
    if shares:
        found = keys.agg(F.expr(f"percentile_approx(key, array({shares}), {min(1_000_000, 20 * ranges + 1000)})")).first()[0]
        # A range ends with its bound: a hot key has one to itself.
        bounds = np.unique(np.array([*found, *hot, *(k - 1 for k in hot if k > LOWEST)], dtype=np.int64))
    parts = F.lit(1)
    for k, n in sorted(hot.items()) if len(hot) <= 100 else ():
        parts = F.when(F.col("key") == k, n).otherwise(parts)
    if len(hot) > 100:
        many = spark.createDataFrame(sorted(hot.items()), "hot long, parts int")
        source = source.join(F.broadcast(many), F.col("key") == F.col("hot"), "left").withColumn("n", F.coalesce("parts", F.lit(1)))
    else:
        source = source.withColumn("n", parts)
    source = source.select("doc_id", "key", F.pmod(F.xxhash64("number"), F.col("n")).cast("int").alias("part"), "text")

    def place(key: np.ndarray, part: np.ndarray) -> np.ndarray:
        """A number of the range, in the order of the documents."""
        return (len(bounds) - np.searchsorted(bounds, key)).astype(np.int64) * PARTS + part

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = place(*(batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)))
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(0)], names=["at", "key"])

    # A row for each range: the head of each.
    heads = {r["at"]: r["head"] for r in source.select("key", "part").mapInArrow(ranged, "at long, key long").groupBy("at").agg(F.max("key").alias("head")).collect()}
    order = sorted(heads)
    #: Which range (or ranges) wants the heads with this key and part after its own documents.
    wanted: dict[tuple[int, int], list[int]] = {}
    for i, at in enumerate(order):
        wanted.setdefault((heads[at], at % PARTS), []).append(order[i - 1])
    dense = {at: i for i, at in enumerate(order)}

    schema = "at int, halo int, key long, tie long, doc_id long, n_chars long, print binary, packed binary"
    names = ["at", "halo", "key", "tie", "doc_id", "n_chars", "print", "packed"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            rows = []
            key, part = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            at = place(key, part).tolist()
            for own, doc, k, p, value in zip(at, batch.column(0).to_pylist(), key.tolist(), part.tolist(), batch.column(3).to_pylist(), strict=True):
                data = value.encode()
                tie = int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)
                rest = (k, tie, doc, len(value), digest(data), squeeze.compress(data))
                rows.append((dense[own], 0, *rest))
                rows += [(dense[other], 1, *rest) for other in wanted.get((k, p), ())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    result = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive by range, own documents in order, then the head of what follows."""
        open_ = zstandard.ZstdDecompressor()
        last, done = None, None
        for batch in batches:
            rows = []
            for at, halo, doc, n, own, packed in zip(*(batch.column(c).to_pylist() for c in ("at", "halo", "doc_id", "n_chars", "print", "packed")), strict=True):
                if done == at:
                    continue
                value = open_.decompress(packed).decode()
                if last is not None:
                    was, chars, print_, before = last
                    new = edited(before, value).encode()
                    new_print = digest(new)
                    rows.append((was, chars, hashlib.sha256(new).hexdigest(), print_.hex(), new_print.hex(), likeness(print_, new_print), likeness(print_, own)))
                last = (doc, n, own, value)
                if halo:
                    last, done = None, at
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), out_kinds, strict=True)], names=result)

    out_kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    dealt = source.mapInArrow(read, schema).repartitionById(max(1, len(order)), F.col("at")).sortWithinPartitions("at", "halo", F.desc("key"), "tie", "packed")
    return dealt.mapInArrow(compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def digests(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with a column of digests in hex (null text: that of the empty text)."""
    from pyspark.sql.types import StringType, StructField, StructType

    from factlake.llm.common import free_name

    bounded_batches(docs.sparkSession)
    name, at = free_name(docs, out), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([digest((x or "").encode()).hex() for x in batch.column(at).to_pylist()], type=pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, StringType(), False)]))
