"""Language ID: a convolutional network over bytes.

Fixed-length windows of bytes are embedded, run through filters of several widths, max-pooled and classified
by softmax. It is trained in numpy on windows of a bounded sample of labelled texts. A text's windows cover it
whole, and their class probabilities are averaged by the letters in each.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_chunks, documents

#: Most labelled documents that the network is trained on, the same number of each language, but EACH of one if there are many; windows of each document.
SAMPLE, EACH, WINDOWS_OF_EACH = 3_000, 50, 6
#: Parts into which hashes are cut to draw it.
FINE = 10**15
WINDOW, EMBED, FILTERS, WIDTHS = 128, 6, 12, (2, 3, 4)
FOLD, HELD = 4, 2
UNKNOWN = "und"
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def windows(raw: bytes) -> np.ndarray:
    """The text in windows of WINDOW bytes; the last is filled up with zeros."""
    n = max(1, -(-len(raw) // WINDOW))
    return np.frombuffer(raw.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


class ByteNet:
    """Parameters and passes; ``classes`` is ordered."""

    def __init__(self, classes: list[str], seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.p = {"e": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)}
        self.p["e"][0] = 0
        for w in WIDTHS:
            self.p[f"c{w}"] = rng.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)
        self.p["o"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(classes))).astype(np.float32)
        self.p["s"] = np.zeros(len(classes), np.float32)

    def forward(self, x: np.ndarray, keep: bool = False):
        """Class probabilities of windows x; with keep also what backward() needs."""
        e = self.p["e"][x]  # n, WINDOW, EMBED
        pooled, kept = [], []
        for w in WIDTHS:
            view = np.lib.stride_tricks.sliding_window_view(e.reshape(len(x), -1), w * EMBED, axis=1)[:, ::EMBED]
            cols = np.ascontiguousarray(view).reshape(-1, w * EMBED)
            y = (cols @ self.p[f"c{w}"]).reshape(len(x), -1, FILTERS)
            if keep:
                top = y.argmax(1)
                best = np.take_along_axis(y, top[:, None], 1)[:, 0]
                kept.append((cols.reshape(len(x), -1, w * EMBED), top))
            else:
                best = y.max(1)
            pooled.append(np.maximum(best + self.p[f"b{w}"], 0))
        f = np.concatenate(pooled, 1)
        z = f @ self.p["o"] + self.p["s"]
        z = np.exp(z - z.max(1, keepdims=True))
        z /= z.sum(1, keepdims=True)
        return (z, f, kept) if keep else z

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        z, f, kept = self.forward(x, keep=True)
        d = z.copy()
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        g = {"o": f.T @ d, "s": d.sum(0), "e": np.zeros_like(self.p["e"])}
        df = (d @ self.p["o"].T) * (f > 0)
        rows = np.arange(len(x))[:, None]
        for k, (w, (cols, top)) in enumerate(zip(WIDTHS, kept, strict=True)):
            dw = df[:, k * FILTERS : (k + 1) * FILTERS]
            at = cols[rows, top]  # n, FILTERS, w * EMBED
            g[f"c{w}"] = np.einsum("nf,nfi->if", dw, at)
            g[f"b{w}"] = dw.sum(0)
            de = (dw[:, :, None] * self.p[f"c{w}"].T[None]).reshape(len(x), FILTERS, w, EMBED)
            for j in range(w):
                np.add.at(g["e"], x[rows, top + j], de[:, :, j])
        g["e"][0] = 0
        return g

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.004, seed: int = 6) -> None:
        """Adam over shuffled batches, in an order that the seed fixes."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        t, last = 0, max(1, epochs * -(-len(x) // batch))
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                pick, t = order[i : i + batch], t + 1
                step = rate * (1 - t / last) + 1e-4
                for k, g in self.gradients(x[pick], y[pick]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= (step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text; UNKNOWN and 0 without a letter."""
        raws = [(t or "").lower().encode() for t in texts]
        known = [bool(re.search(rb"[a-z]", r)) or any(map(str.isalpha, t or "")) for r, t in zip(raws, texts, strict=True)]
        cut = [windows(r) for r, k in zip(raws, known, strict=True) if k]
        out = [(UNKNOWN, 0.0)] * len(texts)
        if not cut or not self.classes:
            return out
        x = np.concatenate(cut)
        p = np.concatenate([self.forward(x[i : i + 512]) for i in range(0, len(x), 512)])
        weight = _LETTER[x].sum(1) + 1e-3
        starts = np.concatenate(([0], np.cumsum([len(c) for c in cut])[:-1]))
        mean = np.add.reduceat(p * weight[:, None], starts) / np.add.reduceat(weight, starts)[:, None]
        best, rows = mean.argmax(1), iter(range(len(cut)))
        for i, k in enumerate(known):
            if k:
                r = next(rows)
                out[i] = (self.classes[best[r]], float(min(1.0, mean[r, best[r]])))
        return out


def fit(docs: DataFrame, sample: int = SAMPLE) -> ByteNet:
    """A network trained on texts outside the held-out fold, evenly spaced windows of each.

    Every language that has labelled texts is learned. Of each at most ``sample`` / languages texts (EACH at least) are
    drawn, those with the smallest hashes of id and text; all of a language with fewer. Equal ones are one.
    Without labelled texts it has no classes, and every text is UNKNOWN.
    """
    used = docs.select(F.col("doc_id").cast("string").alias("k"), "text", "lang").where("text is not null and lang is not null and length(text) > 0")
    used = used.where(F.coalesce(F.crc32(F.col("k").cast("binary")) % FOLD != HELD, F.lit(True)))
    counts = {r["lang"]: r["count"] for r in used.groupBy("lang").count().collect()}  # a row for each language
    quota = max(EACH, sample // max(1, len(counts)))
    # a hash below this draws some 1.5 * quota + 50 rows of a language, from which the smallest are kept
    share = spark_map({lang: min(FINE, int(FINE * (1.5 * quota + 50) / n)) for lang, n in counts.items()})
    parts = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS_OF_EACH - 1)), lambda i: F.substring(F.col("text"), (i * F.greatest(F.lit(0), F.length("text") - WINDOW) / F.lit(WINDOWS_OF_EACH - 1) + 1).cast("int"), F.lit(WINDOW)))
    drawn = used.withColumn("h", F.pmod(F.xxhash64("k", "text"), F.lit(FINE))).where(F.col("h") < share[F.col("lang")])
    drawn = drawn.select("h", "k", "lang", F.array_distinct(parts).alias("parts")).distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "k", "parts"))
    rows = sorted(drawn.withColumn("no", place).where(F.col("no") <= quota).collect(), key=lambda r: (r["h"], r["k"] or "", r["lang"], r["parts"]))
    net = ByteNet(sorted({r["lang"] for r in rows}))
    if net.classes:
        number = {c: i for i, c in enumerate(net.classes)}
        x, y = [], []
        for r in rows:
            for part in r["parts"]:
                w = windows(part.lower().encode())[0]
                if _LETTER[w].any():
                    x.append(w)
                    y.append(number[r["lang"]])
        if x:
            net.train(np.array(x), np.array(y))
    return net


def spark_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair]) if values else F.lit(None).cast("map<string,long>")


def predict(docs: DataFrame, net: ByteNet, columns: list[str]) -> DataFrame:
    """``columns`` of docs and lang_pred, score of each row. columns must have text."""
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    # names apart from the documents' own, whatever these are called
    schema = StructType([*docs.select(*columns).schema.fields, StructField("_lang_pred", StringType()), StructField("_score", DoubleType())])
    at = columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_chunks(batches, at, limit=1 << 20):
            got = net.predict(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g for g, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], [*columns, "_lang_pred", "_score"])

    return docs.select(*columns).mapInArrow(run, schema)


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts and texts without a letter are ``und`` with score 0. Rows without an id are not held out."""
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    out = predict(docs, fit(docs), ["doc_id", "text"])
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLD == HELD, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"))
