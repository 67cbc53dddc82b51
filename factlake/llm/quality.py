"""Quality classifier: a sparse ensemble of rules over text statistics.

Small boosted trees are grown on statistics of labelled documents; every path from a root to a node is a conjunctive rule. A lasso
logistic regression over the rules keeps a few with weights, and these are compiled into one Spark column over the statistics.

Fitting takes at most ``SAMPLE_ROWS`` labelled documents (those whose id has the smallest hash), and nothing else of the work is
bounded: every whole text is measured and scored.

Defined results: a null text is an empty text; an empty text has statistics zero and a score like any; repeated rows have equal
scores. Labels of one doc_id that disagree count as their majority (a tie as 1); labels with a null don't count. Without
labelled documents of both kinds the score is a constant: the share of label 1, or 0.5 without any. Other columns pass through, whatever
their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlake.llm.common import bounded_batches, free_name, sole_cache

#: Labelled documents that a fit uses at most.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, SHRINK = 30, 3, 32, 0.3
#: Of the lasso, on columns scaled to unit deviation.
PENALTY = 0.002
THRESHOLD = 0.3

STATISTICS = (
    "chars", "words", "word_chars", "distinct_words", "top_word", "distinct_pairs", "short_words", "upper", "digits", "symbols",
    "marks", "stops", "bars", "bangs", "lines_per_word", "distinct_lines", "line_words", "closed_lines", "longest_word", "letters_end",
)

_CLASS = np.zeros((256, 8), dtype=np.int64)
for _i, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*@^~+=<>{}[]\\/_`", b",;:'\"()-", b".?", b"|", b"!", b"\n")):
    _CLASS[list(_set), _i] = 1


def statistics(text: str) -> list[float]:
    """The STATISTICS of one text; zeros if it has no words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    data = text.encode()
    upper, digits, symbols, marks, stops, bars, bangs, breaks = (np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256) @ _CLASS).tolist()
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    chars = sum(map(len, words))
    return [
        float(np.log1p(len(text))),
        float(np.log1p(n)),
        chars / n,
        len(seen) / n,
        max(seen.values()) / n,
        len(set(zip(words, words[1:], strict=False))) / max(1, n - 1),
        sum(c for w, c in seen.items() if len(w) <= 3) / n,
        upper / chars,
        digits / chars,
        symbols / n,
        marks / n,
        stops / n,
        bars / n,
        bangs / n,
        breaks / n,
        len(set(lines)) / len(lines),
        float(np.log1p(n / len(lines))),
        sum(x.rstrip()[-1:] in ".!?:" for x in lines) / len(lines),
        float(np.log1p(max(map(len, seen)))),
        sum(c for w, c in seen.items() if w[-1].isalpha()) / n,
    ]


def measured(docs: DataFrame, text: str = "text", out: str = "_stats") -> DataFrame:
    """``docs`` with a column ``out``, which they don't have: a struct of the STATISTICS. Map-only."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text)
    struct = T.StructType([T.StructField(x, T.DoubleType(), False) for x in STATISTICS])
    schema = T.StructType([*docs.schema.fields, T.StructField(out, struct, False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole_cache(None)
        for batch in batches:
            found = np.array([statistics(x or "") for x in batch.column(at).to_pylist()], dtype=np.float64).reshape(-1, len(STATISTICS))
            stats = pa.StructArray.from_arrays([pa.array(found[:, i]) for i in range(len(STATISTICS))], names=list(STATISTICS))
            yield pa.RecordBatch.from_arrays([*batch.columns, stats], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, schema)


Rule = tuple[tuple[int, bool, float], ...]  # conditions: a statistic, whether it is above (else at most), a bound


@dataclass(frozen=True)
class RuleModel:
    """intercept + sum of the weights of the rules that hold, through the logistic function."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self, stats: str = "_stats") -> Column:
        def sql(rule: Rule) -> str:
            return " AND ".join(f"`{stats}`.{STATISTICS[i]} {'>' if above else '<='} {bound!r}D" for i, above, bound in rule)

        terms = [f"{self.intercept!r}D", *(f"IF({sql(rule)}, {weight!r}D, 0D)" for rule, weight in self.rules)]
        return F.expr(f"1D / (1D + exp(-({' + '.join(terms)})))")

    def scores(self, stats: np.ndarray) -> np.ndarray:
        margin = np.full(len(stats), self.intercept)
        for rule, weight in self.rules:
            margin += weight * holds(rule, stats)
        return 1 / (1 + np.exp(-margin))


def holds(rule: Rule, stats: np.ndarray) -> np.ndarray:
    out = np.ones(len(stats), dtype=bool)
    for i, above, bound in rule:
        out &= (stats[:, i] > bound) if above else (stats[:, i] <= bound)
    return out


def _grow(binned: np.ndarray, edges: list[np.ndarray], residual: np.ndarray, weight: np.ndarray, rows: np.ndarray, path: Rule, depth: int, features: np.ndarray, least: int, found: list[Rule], update: np.ndarray) -> None:
    """Newton steps by greedy splits; ``found`` gets the path of every node, ``update`` the leaves' steps."""
    if path:
        found.append(path)
    best = None
    if depth:
        g, h = residual[rows], weight[rows]
        base = g.sum() ** 2 / (h.sum() + 1)
        for f in features:
            b = binned[rows, f]
            gs, hs, ns = (np.cumsum(np.bincount(b, weights=w, minlength=BINS))[:-1] for w in (g, h, np.ones(len(rows))))
            gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - base
            gain[(ns < least) | (len(rows) - ns < least)] = -1
            k = int(np.argmax(gain[: len(edges[f])])) if len(edges[f]) else 0
            if len(edges[f]) and gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                best = (gain[k], f, k)
    if best is None:
        update[rows] = SHRINK * residual[rows].sum() / (weight[rows].sum() + 1)
        return
    _, f, k = best
    low = binned[rows, f] <= k
    for side, above in ((rows[low], False), (rows[~low], True)):
        _grow(binned, edges, residual, weight, side, (*path, (int(f), above, float(edges[f][k]))), depth - 1, features, least, found, update)


def _lasso(columns: np.ndarray, labels: np.ndarray, penalty: float, rounds: int = 200) -> tuple[float, np.ndarray]:
    """Logistic weights under an L1 penalty, by accelerated proximal gradient steps."""
    n, k = columns.shape
    mean, scale = columns.mean(axis=0), columns.std(axis=0) + 1e-12
    x = (columns - mean) / scale
    # The largest eigenvalue of the Gram matrix bounds the step.
    step = 4 / (np.linalg.eigvalsh(x.T @ x / n)[-1] + 1)
    w, b = np.zeros(k), float(np.log(labels.mean() / (1 - labels.mean())))
    w0, b0, w1, b1, t = w, b, w, b, 1.0
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-(x @ w1 + b1))) - labels
        w = w1 - step * (x.T @ error) / n
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
        b = b1 - step * error.mean()
        t, was = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        w1, b1 = w + (was - 1) / t * (w - w0), b + (was - 1) / t * (b - b0)
        w0, b0 = w, b
    w = w0 / scale
    return float(b0 - w @ mean), w


def fit(stats: np.ndarray, labels: np.ndarray, seed: int = 7) -> RuleModel:
    """A model of label 1, from statistics (rows by STATISTICS) and 0/1 labels. Deterministic."""
    share = labels.mean() if len(labels) else 0.5
    if share in (0.0, 1.0) or len(labels) < 20:
        share = min(max(share, 1e-6), 1 - 1e-6)
        return RuleModel(float(np.log(share / (1 - share))), ())
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(stats[:, i], np.arange(1, BINS) / BINS, method="lower")) for i in range(stats.shape[1])]
    edges = [e[e < stats[:, i].max()] for i, e in enumerate(edges)]
    binned = np.stack([np.searchsorted(e, stats[:, i]) for i, e in enumerate(edges)], axis=1)
    margin = np.full(len(labels), np.log(share / (1 - share)))
    found: list[Rule] = []
    least = max(5, len(labels) // 500)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        features = np.sort(rng.permutation(stats.shape[1])[: max(6, stats.shape[1] // 2)])
        update = np.zeros(len(labels))
        _grow(binned, edges, labels - p, p * (1 - p), np.arange(len(labels)), (), DEPTH, features, least, found, update)
        margin += update
    rules = list(dict.fromkeys(found))
    columns = np.stack([holds(r, stats) for r in rules], axis=1).astype(np.float64)
    # Rules that hold for the same rows are one.
    _, first = np.unique(np.packbits(columns.astype(bool), axis=0), axis=1, return_index=True)
    kept = sorted(int(i) for i in first if 0 < columns[:, i].mean() < 1)
    if not kept:
        return RuleModel(float(np.log(share / (1 - share))), ())
    intercept, weights = _lasso(columns[:, kept], labels, PENALTY)
    return RuleModel(intercept, tuple((rules[i], float(w)) for i, w in zip(kept, weights, strict=True) if w))


def held_out(doc_id: str = "doc_id") -> Column:
    """The fifth of the ids that no fit looks at."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> RuleModel:
    """The model of ``labels`` (doc_id, quality) over ``docs`` (doc_id, text), without the held-out ids."""
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("double").alias("_quality"))
    known = known.filter(F.col("_id").isNotNull() & F.col("_quality").isNotNull() & ~held_out("_id"))
    known = known.groupBy("_id").agg((F.avg("_quality") >= 0.5).cast("double").alias("_label"))
    # Not bounded by the data but by a parameter: safe to broadcast.
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    own = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("text"))
    rows = measured(own.join(F.broadcast(chosen), "_id")).groupBy("_id").agg(F.min("_stats").alias("s"), F.min("_label").alias("y"))
    found = rows.orderBy("_id").select(*[F.col("s")[x] for x in STATISTICS], "y").toArrow()
    table = np.stack([c.to_numpy() for c in found.columns], axis=1) if found.num_rows else np.zeros((0, len(STATISTICS) + 1))
    return fit(table[:, :-1], table[:, -1])


def scored(docs: DataFrame, model: RuleModel, out: str = "score") -> DataFrame:
    """``docs`` with their score. An ``out`` that is a column already raises."""
    if out.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {out}")
    stats = free_name(docs, "_stats")
    return measured(docs, out=stats).select(*[F.col(f"`{c}`") for c in docs.columns], model.column(stats).alias(out))
