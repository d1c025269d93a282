"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted cyclically, one feature at a time, on binned features; what they add is kept as one
lookup table per feature. Then pairs of features get tables of their own in the same way. A score is the sum of
the tables' entries for a document's bins, through the logistic function.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_chunks, documents, texts_as_bytes, written

#: Most labelled rows that the model is fitted on (those with the smallest hash of their id).
SAMPLE = 20_000
#: Parts into which hashes are cut to draw it.
FINE = 10**15
THRESHOLD = 0.3
FEATURES = ("log_bytes", "upper", "lower", "digit", "space", "bang", "pipe", "symbol", "sentence", "non_ascii", "control", "word_length", "distinct_words", "repeats", "line_length", "repeated_lines", "punctuated_words", "title_words")


def _groups() -> np.ndarray:
    g = np.zeros((256, 9))
    for i in range(256):
        c = chr(i)
        column = 0 if "A" <= c <= "Z" else 1 if "a" <= c <= "z" else 2 if c.isdigit() and i < 128 else 3 if c in " \t\n\r\x0b\x0c" else 4 if c in "!?" else 5 if c in "|<>{}[]\\/_" else 6 if c in "%$&*#@^~+=" else 7 if c in ".,;:" else 8 if i >= 128 else None
        if column is not None:
            g[i, column] = 1
    return g


_GROUP = _groups()


def features(raw: bytes) -> list[float]:
    """The document's numbers, in the order of FEATURES; zeros for an empty text."""
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = counts @ _GROUP / n
    words = raw.split()
    w = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    punctuated = sum(x[-1] < 128 and not 0 <= (x[-1] | 32) - 97 < 26 for x in words) / w  # words that end in neither a letter nor a byte beyond ASCII
    title = sum(65 <= x[0] <= 90 for x in words) / w
    control = float(counts[:9].sum() + counts[14:32].sum()) / n
    return [float(np.log1p(n)), *share[:8].tolist(), float(share[8]), control, (n - counts[32]) / w, len(set(words)) / w**0.75, sum(map(eq, words, words[1:])) / w, n / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)), punctuated, title]


def extract(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and x (array of FEATURES), one row per row of docs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_chunks(batches, 1):
            x = [features(t) for t in texts_as_bytes(b.column(1))]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "x": pa.array(x, pa.list_(pa.float64()))})

    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text}` as text").mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class AdditiveModel:
    """edges: inner bin edges of each feature; tables: a number for each bin; pairs: (feature, feature, edges, edges, table)."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for f, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += t[np.searchsorted(e, x[:, f], side="right")]
        for f, g, ef, eg, t in self.pairs:
            z += t[np.searchsorted(ef, x[:, f], side="right"), np.searchsorted(eg, x[:, g], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """The step of each bin: a tree of contiguous leaves, each split where it gains most."""
    cg, ch = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))
    cuts = [0, len(g)]
    worth = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
    while len(cuts) <= leaves:
        best = max(((worth(a, m) + worth(m, b) - worth(a, b), m) for a, b in zip(cuts[:-1], cuts[1:], strict=True) for m in range(a + 1, b)), default=(0, 0))
        if best[0] <= 1e-9:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.empty(len(g))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = -(cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """The step of each cell: a tree of depth two whose cuts, one for each feature, gain most together."""
    cg, ch = (np.pad(v.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for v in (g, h))
    i, j = np.arange(1, g.shape[0]), np.arange(1, g.shape[1])
    if not len(i) or not len(j):
        return np.full(g.shape, -g.sum() / (h.sum() + ridge))

    def quarters(c: np.ndarray) -> list[np.ndarray]:
        a, up, left, all_ = c[i][:, j], c[i][:, -1:], c[-1:][:, j], c[-1, -1]
        return [a, up - a, left - a, all_ - up - left + a]

    gain = sum(qg**2 / (qh + ridge) for qg, qh in zip(quarters(cg), quarters(ch), strict=True))
    a, b = (int(v) + 1 for v in np.unravel_index(gain.argmax(), gain.shape))
    out = np.empty(g.shape)
    for rows in (slice(0, a), slice(a, None)):
        for cols in (slice(0, b), slice(b, None)):
            out[rows, cols] = -g[rows, cols].sum() / (h[rows, cols].sum() + ridge)
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.2, bins: int = 24, pair_bins: int = 8, n_pairs: int = 6, pair_rounds: int = 20, leaves: int = 3, ridge: float = 2.0) -> AdditiveModel:
    """Boost one-feature trees in cycles, then tables for the pairs that the residuals favour.

    Without rows, or with one class only, the score is that class's smoothed share (0.5 without rows).
    """
    p = (y.sum() + 1) / (len(y) + 2)
    model = AdditiveModel(float(np.log(p / (1 - p))))
    n_f = x.shape[1]
    model.edges = [_edges(x[:, f], bins) if len(x) else np.empty(0) for f in range(n_f)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if len(y) == 0 or y.min() == y.max():
        return model
    at = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.edges)]
    z = np.full(len(y), model.intercept)
    slope = lambda: ((q := 1 / (1 + np.exp(-z))) - y, q * (1 - q))
    for _ in range(rounds):
        for f in range(n_f):
            g, h = slope()
            k = len(model.tables[f])
            step = rate * _tree(np.bincount(at[f], g, k), np.bincount(at[f], h, k), leaves, ridge)
            model.tables[f] += step
            z += step[at[f]]
    coarse = [_edges(x[:, f], pair_bins) for f in range(n_f)]
    cat = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(coarse)]
    g, h = slope()
    gains = []
    for a in range(n_f):
        for b in range(a):
            k = len(coarse[b]) + 1
            cell = cat[a] * k + cat[b]
            cg, ch = np.bincount(cell, g), np.bincount(cell, h)
            gains.append(((cg**2 / (ch + 10 * ridge)).sum(), a, b))
    chosen = [(a, b, len(coarse[b]) + 1) for _, a, b in sorted(gains, reverse=True)[:n_pairs]]
    tables = [np.zeros((len(coarse[a]) + 1) * k) for a, _, k in chosen]
    for _ in range(pair_rounds):
        for (a, b, k), t in zip(chosen, tables, strict=True):
            g, h = slope()
            cell = cat[a] * k + cat[b]
            cg, ch = np.bincount(cell, g, len(t)), np.bincount(cell, h, len(t))
            step = _quadrants(cg.reshape(-1, k), ch.reshape(-1, k), 5 * ridge)
            t += rate * step.ravel()
            z += rate * step.ravel()[cell]
    model.pairs = [(a, b, coarse[a], coarse[b], t.reshape(-1, k)) for (a, b, k), t in zip(chosen, tables, strict=True)]
    return model


def training_rows(x: DataFrame, labels: DataFrame, fold: int = 5, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``sample`` labelled rows outside the held-out fold."""
    used = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where(F.col("y").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold != 0))
    n = used.count()
    used = used.where(F.pmod(F.xxhash64("doc_id"), F.lit(FINE)) < int(FINE * min(1.0, sample / max(1, n))))
    rows = x.join(used, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "y", "x").limit(sample).collect()
    return np.array([r["x"] for r in rows], float).reshape(-1, len(FEATURES)), np.array([r["y"] for r in rows], float)


def score_quality(docs: DataFrame, labels: DataFrame, fold: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted, one row per row of docs.

    Only the text is an input. A null text counts as empty and has a score too. Rows without an id are not held out.
    """
    x = written(extract(docs), "quality-features")
    model = fit(*training_rows(x, labels, fold))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.asarray(b.column(1).flatten()).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "score": model.score(values)})

    scored = x.mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
