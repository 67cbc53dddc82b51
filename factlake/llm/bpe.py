"""Byte-level BPE encoding and decoding.

Each pre-token is merged with a segment tree over its byte positions. A leaf holds the rank of the
pair that starts at that position, an inner node the leftmost minimum below it, so the root names the
next merge. A merge touches three leaves (the merged pair, its live left neighbour, the swallowed right
neighbour), each O(log n), hence O(n log n) for a pre-token of n bytes however long it is.

Defined results: a null text is an empty text; an empty text has no ids and decodes to no bytes; repeated
rows give repeated rows; an id outside the vocabulary raises. Input columns are kept, an output name that
clashes with one gets an underscore.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlake.llm.common import bounded_batches, free_name

#: Entries of one generation of the cache of a Python worker; it has two: a full young one becomes the old one.
CACHE_ENTRIES = 150_000
#: Longer pieces are not kept in the cache, only encoded.
CACHE_PIECE = 64
#: Words of up to so many bytes are merged together, so many at a time; longer ones alone, by the same tree.
BLOCK_BYTES, BLOCK_WORDS = 64, 4096
#: Of text in a batch: its pieces are held as Python strings, many times their bytes.
BATCH_BYTES = 2 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token."""
    n = len(piece)
    if n == 0:
        return []
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    size = 1 << max(1, (n - 1).bit_length())
    never = 1 << 62
    tree = [never] * (2 * size)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    get = ranks.get
    # A leaf is rank * size + position: the smallest value is the leftmost among equal ranks.
    for i in range(n - 1):
        if (rank := get(piece[i : i + 2])) is not None:
            tree[size + i] = rank * size + i
    for i in range(size - 1, 0, -1):
        left, right = tree[2 * i], tree[2 * i + 1]
        tree[i] = left if left <= right else right

    def put(position: int, value: int) -> None:
        i = size + position
        tree[i] = value
        i >>= 1
        while i:
            left, right = tree[2 * i], tree[2 * i + 1]
            tree[i] = left if left <= right else right
            i >>= 1

    while (best := tree[1]) < never:
        at = best % size
        gone = after[at]
        end = after[gone]
        after[at] = end
        if end < n:
            before[end] = at
            rank = get(piece[at : after[end]])
            put(at, never if rank is None else rank * size + at)
        else:
            put(at, never)
        put(gone, never)
        if (left := before[at]) >= 0:
            rank = get(piece[left:end])
            put(left, never if rank is None else rank * size + left)
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : after[at]]])
        at = after[at]
    return ids


class PairTable:
    """Rank of two adjacent tokens by their ids, for many pairs at once; every split of a token into two tokens counts."""

    def __init__(self, ranks: dict[bytes, int]):
        self.base = max(ranks.values(), default=0) + 1
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left * self.base + right] = rank
        keys = np.array(sorted(pairs) + [np.iinfo(np.int64).max], dtype=np.int64)
        self.keys, self.values = keys, np.array([pairs.get(int(k), 0) for k in keys], dtype=np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray, none: int) -> np.ndarray:
        wanted = left * self.base + right
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, self.values[at], none)


def merge_block(words: list[bytes], single: np.ndarray, pairs: PairTable) -> list[bytes]:
    """Packed ids of words of at most BLOCK_BYTES bytes: the trees of all words advance together, one merge a round."""
    count, longest = len(words), max(map(len, words))
    size = 1 << max(1, (longest - 1).bit_length())
    never = np.int64(1) << 40
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=count)
    rows = np.arange(count)
    wide = size + 1
    live = np.arange(size) < lengths[:, None]
    token = np.full((count, wide), -1, dtype=np.int64)
    token[:, :size][live] = single[np.frombuffer(b"".join(words), dtype=np.uint8)]
    # One flat slot more than positions: the end of a word, which joins with nothing.
    after = np.minimum(np.arange(1, wide + 1), lengths[:, None])
    before = np.broadcast_to(np.arange(-1, size), (count, wide)).copy()
    joined = live.copy()
    joined[rows, lengths - 1] = False
    tree = np.full((count, 2 * size), never)
    first = np.nonzero(joined)
    ranked = pairs.rank(token[first], token[first[0], first[1] + 1], -1)
    tree[first[0], size + first[1]] = np.where(ranked >= 0, ranked * size + first[1], never)
    for level in range(size.bit_length() - 2, -1, -1):
        low, high = 1 << level, 2 << level
        tree[:, low:high] = np.minimum(tree[:, 2 * low : 2 * high : 2], tree[:, 2 * low + 1 : 2 * high : 2])
    flat_tree, flat_token, flat_after, flat_before = tree.ravel(), token.ravel(), after.ravel(), before.ravel()

    def put(which: np.ndarray, position: np.ndarray, value: np.ndarray) -> None:
        start, i = which * (2 * size), position + size
        flat_tree[start + i] = value
        while size > 1 and len(i) and i[0] > 1:
            i = i >> 1
            flat_tree[start + i] = np.minimum(flat_tree[start + 2 * i], flat_tree[start + 2 * i + 1])

    def pair(which: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Leaf values; a right side at the end of its word joins with nothing."""
        base = which * wide
        got = pairs.rank(flat_token[base + left], np.maximum(flat_token[base + right], 0), -1)
        return np.where((got >= 0) & (right < lengths[which]), got * size + left, never)

    active = rows[tree[:, 1] < never]
    while len(active):
        best = flat_tree[active * (2 * size) + 1]
        at, base = best % size, active * wide
        gone = flat_after[base + at]
        end = flat_after[base + gone]
        flat_token[base + at] = best // size
        flat_token[base + gone] = -1
        flat_after[base + at] = end
        flat_before[base + end] = at
        put(active, gone, np.full(len(active), never))
        put(active, at, pair(active, at, end))
        left = flat_before[base + at]
        has = left >= 0
        put(active[has], left[has], pair(active[has], left[has], at[has]))
        active = active[flat_tree[active * (2 * size) + 1] < never]
    kept = token[:, :size] >= 0
    data = token[:, :size][kept].astype("<i4").tobytes()
    ends = (4 * np.cumsum(kept.sum(axis=1))).tolist()
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


class Encoder:
    """Encodes texts to little-endian 32-bit ids and decodes them, for one vocabulary and pattern."""

    #: A space before white space or at the end belongs to a run of white space, which must not be split.
    _runs = regex.compile(r" (?:\s|\Z)")

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.pattern = regex.compile(pattern)
        # What chunks() and words() know of texts holds for this pattern alone.
        self.known = pattern == public_tokenizers.PATTERN
        self.pairs = PairTable(self.ranks)
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def chunks(self, text: str) -> list[str]:
        """Pieces that merge independently: a space before a non-space always starts a pre-token of the known pattern."""
        if not self.known:
            return [m[0] for m in self.pattern.finditer(text)]
        if self._runs.search(text):
            return self.pattern.findall(text)
        head, *rest = text.split(" ")
        return [head, *[" " + x for x in rest]]

    def words(self, chunk: str) -> list[str]:
        if not self.known:
            return [chunk]  # a pre-token already
        bare = chunk[1:] if chunk[:1] == " " else chunk
        if bare.isalpha():
            return [chunk]
        if bare[-1:] in {",", "."} and bare[:-1].isalpha():
            return [chunk[:-1], bare[-1]]
        return self.pattern.findall(chunk)

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.chunks(x) for x in texts]
        found: dict[str, bytes] = {}
        fresh = []
        for chunk in set().union(*split):
            if (ids := self.young.get(chunk)) is not None:
                found[chunk] = ids
            elif (ids := self.old.get(chunk)) is not None:
                found[chunk] = self.young[chunk] = ids
            else:
                fresh.append(chunk)
        parts = {chunk: self.words(chunk) for chunk in fresh}
        self._merge({w for ws in parts.values() for w in ws}, found)
        for chunk, words in parts.items():
            found[chunk] = found[words[0]] if len(words) == 1 else b"".join(map(found.__getitem__, words))
        out = [b"".join(map(found.__getitem__, x)) for x in split]
        self.young.update((x, found[x]) for x in fresh if len(x) <= CACHE_PIECE)
        if len(self.young) >= CACHE_ENTRIES:
            self.old, self.young = self.young, {}
        return out

    def _merge(self, words: set[str], found: dict[str, bytes]) -> None:
        classes: dict[int, tuple[list[str], list[bytes]]] = {}
        for word in words:
            if word in found:
                continue
            if (ids := self.young.get(word) or self.old.get(word)) is not None:
                found[word] = ids
                continue
            data = word.encode()
            if (whole := self.ranks.get(data)) is not None:
                found[word] = whole.to_bytes(4, "little")
            elif len(data) > BLOCK_BYTES:
                found[word] = np.array(merge_piece(data, self.ranks), dtype="<i4").tobytes()
            else:
                names, block = classes.setdefault((len(data) - 1).bit_length(), ([], []))
                names.append(word)
                block.append(data)
        for names, block in classes.values():
            for i in range(0, len(names), BLOCK_WORDS):
                found.update(zip(names[i : i + BLOCK_WORDS], merge_block(block[i : i + BLOCK_WORDS], self.single, self.pairs), strict=True))

@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


@lru_cache(maxsize=4)
def token_table(path: str) -> pa.Array:
    """The bytes of each id."""
    ranks = load_ranks(path)
    table: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return pa.array(table, type=pa.large_binary())


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with a column of the ids of its texts (array of int). Map-only: no shuffle."""
    bounded_batches(df.sparkSession, BATCH_BYTES)
    name = free_name(df, out)
    # Only the texts need ids; the other columns pass beside them.
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType(), False), False)])
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            parts = own.encode([x or "" for x in batch.column(at).to_pylist()])
            ends = np.cumsum([0, *(len(x) // 4 for x in parts)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), dtype="<i4")))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, name])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with a binary column of the bytes that its ids stand for. Null ids decode to no bytes."""
    bounded_batches(df.sparkSession, BATCH_BYTES)
    name = free_name(df, out)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.BinaryType(), False)])
    at = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_table(path)
        for batch in batches:
            lists = batch.column(at)
            lengths = np.array([x or 0 for x in lists.value_lengths().to_pylist()], dtype=np.int64)
            taken = table.take(lists.flatten())
            if taken.null_count:
                raise ValueError("an id is outside the vocabulary")
            starts = np.frombuffer(taken.buffers()[1], dtype=np.int64, count=len(taken) + 1 + taken.offset)[taken.offset :]
            ends = starts[np.concatenate([[0], np.cumsum(lengths)])]
            data = taken.buffers()[2] or pa.py_buffer(b"")
            view = memoryview(data)
            out_bytes = pa.array([bytes(view[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], type=pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out_bytes], names=[*batch.schema.names, name])

    return df.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The op4 query: digests of the ids and of the decoded bytes of every document."""
    source = docs.select("doc_id", "text")
    done = decode(encode(source, path, pattern).drop("text"), path)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
