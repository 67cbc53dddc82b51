"""Hierarchical multi-length packing of documents into training sequences.

Documents are routed by their length to tiers of window sizes (powers of two); what is longer than the longest window
first fills whole windows of that size. Each tier is packed from the longest to the shortest: a window takes a document of
its own tier, and its gap is filled with the largest pieces of shorter tiers that fit, the last of them cut where
the window ends. So every window is full, and only what is left at the end of a task's input goes to windows of its
power-of-two parts, which need no padding either. Windows are dealt into step groups of an equal number of tokens,
of one tier each where its windows suffice.

A task packs its own input as it streams by, in blocks of ``block_tokens``: no shuffle, memory bounded by the block
and the longest document. Ids of sequences and step groups are unique across tasks (task number in the upper bits).

Defined results: a null text is an empty text, which still has its end id; repeated rows are packed as often as they
occur; a null doc_id is kept as it is. Other columns don't go into the result.
"""

from __future__ import annotations

import json
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache
from struct import Struct

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factlake.llm.common import bounded_batches, sole_cache

TIERS = (256, 512, 1024, 2048)
STEP_TOKENS = 16_384
BLOCK_TOKENS = 1 << 20
#: Entries of one generation of a worker's cache of words; it has two.
CACHE_ENTRIES = 400_000
CACHE_PIECE = 48
# How the files that are read word by word normalise white space and split words. Neither crosses white space.
SPACES = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordTokenizer:
    """Ids of whole texts by a ``tokenizers`` file, through a cache of their white-space-separated words.

    A text is the sum of its words if the file lower-cases, replaces white space as SPACES, splits by SPLIT, and maps bytes to
    characters; other files, and texts with characters outside ``_plain`` (combining marks, scripts whose case folding depends on
    the Unicode version), go through the library whole.
    """

    _plain = regex.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-\u012f\u0132-\u017e\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]*")

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.split = self._by_words(path)
        self.characters = _byte_characters()
        self.added = [x.content for x in self.whole.get_added_tokens_decoder().values()]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def _by_words(path: str) -> regex.Pattern | None:
        """The pattern of the words of a file of the kind described above, else None."""
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        steps = (parts["normalizer"] or {}).get("normalizers", [])
        before = (parts["pre_tokenizer"] or {}).get("pretokenizers", [])
        if steps != [{"type": "NFC"}, SPACES, {"type": "Lowercase"}] or [x["type"] for x in before] != ["Split", "ByteLevel"]:
            return None
        split, level = before
        if split["behavior"] != "Removed" or not split["invert"] or level["add_prefix_space"] or level["use_regex"] or parts["model"]["dropout"] or split["pattern"] != {"Regex": SPLIT}:
            return None
        return regex.compile(split["pattern"]["Regex"])

    def _library(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed little-endian 32-bit ids of each text."""
        split: list[list[str] | None] = []
        for text in texts:
            plain = self.split and self._plain.fullmatch(text) and not any(x in text for x in self.added)
            split.append(text.lower().split() if plain else None)
        found: dict[str, bytes] = {}
        fresh = []
        for word in set().union(*(x for x in split if x)):
            if (ids := self.young.get(word)) is not None:
                found[word] = ids
            elif (ids := self.old.get(word)) is not None:
                found[word] = self.young[word] = ids
            else:
                fresh.append(word)
        for word in fresh:
            found[word] = _packed(self._word(word))
        out = [_packed(self._library(text)) if x is None else b"".join(map(found.__getitem__, x)) for text, x in zip(texts, split, strict=True)]
        self.young.update((x, found[x]) for x in fresh if len(x) <= CACHE_PIECE)
        if len(self.young) >= CACHE_ENTRIES:
            self.old, self.young = self.young, {}
        return out

    def _word(self, word: str) -> list[int]:
        parts = [word] if word.isalpha() else self.split.findall(word)
        model = self.whole.model
        # What _plain lets through of ASCII stands for itself.
        return [t.id for part in parts for t in model.tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(self.characters))]


def _byte_characters() -> dict[int, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


_SHORT = [Struct(f"<{n}I") for n in range(17)]


def _packed(ids: list[int]) -> bytes:
    return Struct(f"<{len(ids)}I").pack(*ids) if len(ids) > 16 else _SHORT[len(ids)].pack(*ids)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


class Piece:
    """A run of a document's ids."""

    __slots__ = ("doc", "ids", "start", "total")

    def __init__(self, doc: int | None, start: int, ids: np.ndarray, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[:at], self.total), Piece(self.doc, self.start + at, self.ids[at:], self.total)


class Shelf:
    """Pieces in order of their length, then of arrival."""

    def __init__(self):
        self.keys: list[tuple[int, int]] = []
        self.pieces: dict[int, Piece] = {}
        self.arrivals = 0
        self.tokens = 0

    def __len__(self) -> int:
        return len(self.keys)

    def add(self, piece: Piece) -> None:
        if not len(piece.ids):
            return
        insort(self.keys, (len(piece.ids), self.arrivals))
        self.pieces[self.arrivals] = piece
        self.arrivals += 1
        self.tokens += len(piece.ids)

    def take(self, most: int) -> Piece | None:
        """The longest piece of at most ``most`` ids."""
        at = bisect_right(self.keys, (most, self.arrivals)) - 1
        if at < 0:
            return None
        _, which = self.keys.pop(at)
        piece = self.pieces.pop(which)
        self.tokens -= len(piece.ids)
        return piece


def pack_block(shelf: Shelf, tiers: tuple[int, ...] = TIERS, last: bool = False) -> list[tuple[int, list[Piece]]]:
    """Full windows (size, pieces) from the shelf. What can't fill a window of the shortest tier stays on it, unless it is the last block."""
    out: list[tuple[int, list[Piece]]] = []

    def fill(size: int, most: int) -> None:
        """One window: first a piece of at most ``most`` ids, then the largest that fit, then one that is cut."""
        pieces, gap = [], size
        while gap:
            piece = shelf.take(min(gap, most))
            if piece is None:
                piece, rest = shelf.take(1 << 62).cut(gap)
                shelf.add(rest)
            pieces.append(piece)
            gap -= len(piece.ids)
        out.append((size, pieces))

    for size in sorted(tiers, reverse=True):
        # A tier's own documents are longer than half its window (but for the shortest tier).
        while shelf.tokens >= size and (size == min(tiers) or shelf.keys[-1][0] > size // 2):
            fill(size, size)
    if last:
        while shelf.tokens:
            size = 1 << (shelf.tokens.bit_length() - 1)
            fill(size, size)
    return out


def step_groups(windows: list[tuple[int, list[Piece]]], step_tokens: int, last: bool) -> tuple[list[list[tuple[int, list[Piece]]]], list[tuple[int, list[Piece]]]]:
    """Groups of windows of ``step_tokens`` tokens each, of one size where they suffice, and the windows that are left.

    Sizes are powers of two that divide the step, so taking the largest first fills each mixed group exactly.
    """
    groups, mixed = [], []
    for size in sorted({s for s, _ in windows}, reverse=True):
        own = [w for w in windows if w[0] == size]
        each = max(1, step_tokens // size)
        whole = len(own) // each * each
        groups += [own[i : i + each] for i in range(0, whole, each)]
        mixed += own[whole:]
    left: list[tuple[int, list[Piece]]] = []
    for window in mixed:
        left.append(window)
        if sum(s for s, _ in left) >= step_tokens:
            groups.append(left)
            left = []
    if last and left:
        groups.append(left)
        left = []
    return groups, left


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 1,
    tiers: tuple[int, ...] = TIERS,
    step_tokens: int = STEP_TOKENS,
    block_tokens: int = BLOCK_TOKENS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row a piece: doc_id, start, length, ids (packed little-endian 32-bit), doc_tokens, sequence_id, offset, window, step_group."""
    bounded_batches(docs.sparkSession)
    longest = max(tiers)
    if any(t & (t - 1) for t in tiers) or step_tokens % longest:
        raise ValueError("tiers must be powers of two, and the longest must divide a step")
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "window", "step_group"]
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, window int, step_group long"
    end = _packed([end_id])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_cache(tokenizer.cache_clear)
        own = tokenizer(tokenizer_path)
        base = TaskContext.get().partitionId() << 40
        shelf, windows, sequences, steps = Shelf(), [], 0, 0

        def emit(groups: list) -> Iterator[pa.RecordBatch]:
            nonlocal sequences, steps
            rows: list[tuple] = []
            for group in groups:
                for size, pieces in group:
                    at = 0
                    for p in pieces:
                        rows.append((p.doc, p.start, len(p.ids), p.ids.tobytes(), p.total, base + sequences, at, size, base + steps))
                        at += len(p.ids)
                    sequences += 1
                steps += 1
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for doc, data in zip(ids, own.encode([x or "" for x in batch.column(1).to_pylist()]), strict=True):
                tokens = np.frombuffer(data + end, dtype="<u4")
                whole, total = len(tokens) // longest * longest, len(tokens)
                for at in range(0, whole, longest):
                    windows.append((longest, [Piece(doc, at, tokens[at : at + longest], total)]))
                shelf.add(Piece(doc, whole, tokens[whole:], total))
                if shelf.tokens + longest * len(windows) >= block_tokens:
                    windows += pack_block(shelf, tiers)
                    groups, windows = step_groups(windows, step_tokens, last=False)
                    yield from emit(groups)
        windows += pack_block(shelf, tiers, last=True)
        groups, windows = step_groups(windows, step_tokens, last=True)
        yield from emit(groups)

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, schema)
