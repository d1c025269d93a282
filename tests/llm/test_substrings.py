import hashlib
import random

import pytest
from polyrank.llm import common, substrings
from pyspark.sql import functions as F

from .cases import clashing, empty_documents, odd_documents, store


def brute(rows, length=100):
    """(doc_id, text) in order -> for each: kept bytes and number of removed runs."""
    seen, out = set(), []
    for _, raw in rows:
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(raw)))
        out.append((bytes(b for b, g in zip(raw, gone, strict=True) if not g), spans))
    return out


def compare(spark, df, path):
    rows = sorted(((r.doc_id, r.h, (r.text or "").encode()) for r in df.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    rows = [(i, raw) for i, _, raw in rows]
    got = substrings.op1_substrings(spark, store(df, path)).collect()
    want = [(i, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()) for (i, raw), (kept, spans) in zip(rows, brute(rows), strict=True)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    return got


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passages = [text(rng.randrange(15, 60)) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = [text(rng.randrange(1, 60)) for _ in range(rng.randrange(1, 5))]
        for p in rng.sample(passages, rng.randrange(3)):
            parts.insert(rng.randrange(len(parts) + 1), p)
        if rng.random() < 0.1:
            parts.append(rng.choice(["ab ", "x", "abcdefghijk "]) * rng.randrange(90, 140))
        out.append("".join(parts))
    for _ in range(n // 4):  # near copies
        t = list(rng.choice(out))
        for _ in range(rng.randrange(3)):
            t[rng.randrange(len(t))] = "#"
        out.append("".join(t))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_brute_force(spark, tmp_path, seed, monkeypatch):
    if seed == 2:  # many blocks and buckets
        monkeypatch.setattr(substrings, "BLOCK_BYTES", 20_000)
        monkeypatch.setattr(substrings, "BUCKET_BYTES", 10_000)
    df = spark.createDataFrame(list(enumerate(corpus(seed))), "doc_id long, text string")
    got = compare(spark, df, tmp_path)
    assert sum(r.n_removed for r in got) > 1000


def test_hot_keys_equal_to_brute_force(spark, tmp_path, monkeypatch):
    line = "this line of some sixty bytes stands in each of the documents, "
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(150)) + line * (1 + i % 3 // 2) + "".join(rng.choice("abc ") for _ in range(90 + i % 7))) for i in range(400)]
    rows += [(1000 + i, rows[i % 5][1]) for i in range(300)]
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 30_000)
    monkeypatch.setattr(substrings, "HOT", 8)
    compare(spark, spark.createDataFrame(rows, "doc_id long, text string"), tmp_path)


def test_hot_keys_and_chunks_equal_to_brute_force(spark, tmp_path, monkeypatch):
    for name, n in (("BLOCK_BYTES", 20_000), ("BUCKET_BYTES", 10_000), ("HOT", 1), ("CHUNK", 997), ("BATCH", 3_000)):
        monkeypatch.setattr(substrings, name, n)
    monkeypatch.setattr(common, "PART_BYTES", 5_000)  # more partitions than the session's
    compare(spark, spark.createDataFrame(list(enumerate(corpus(3))), "doc_id long, text string"), tmp_path)


def test_rows_of_one_id_in_several_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 500)
    texts = corpus(4, 40)
    rows = [(i // 4, t) for i, t in enumerate(texts)] + [(None, t) for t in texts[:9]] + [(i, t) for i, t in enumerate(texts[:9])]
    compare(spark, spark.createDataFrame(rows, "doc_id long, text string"), tmp_path)


def test_long_periodic_texts(spark, tmp_path):
    rows = [(1, "a" * 1_000_000), (2, "ab" * 500_000), (3, "line of forty characters that repeats.\n" * 20_000), (4, "a" * 99 + "b" * 99)]
    got = {r.doc_id: r for r in substrings.op1_substrings(spark, store(spark.createDataFrame(rows, "doc_id long, text string"), tmp_path)).collect()}
    assert [got[i].n_removed for i in (1, 2, 3, 4)] == [999_999, 999_998, len(rows[2][1]) - 39, 0]


def test_odd_documents(spark, tmp_path):
    df = odd_documents(spark).withColumns({"raw": F.lit("r"), "blk": F.lit("b"), "th": F.lit(1.5), "row": F.lit(2)})
    compare(spark, clashing(df.union(df).union(spark.createDataFrame([(None, "z" * 250, None, None, 1, "r", "b", 1.5, 2)], df.schema))), tmp_path / "a")
    assert substrings.op1_substrings(spark, store(empty_documents(spark), tmp_path / "b")).count() == 0
    left = {r.doc_id: r for r in substrings.without_repeats(clashing(df)).collect()}
    assert left[2].text is None and left[1].text and left[7].text == "The cat sat on the mat, and then the cat sat on the mat again because it liked the mat."
    assert left[1].score == "clash" and left[1].raw == "r" and left[1].blk == "b" and left[1].th == 1.5 and left[1].row == 2 and left[5].n_chars == len(left[5].text) and substrings.without_repeats(empty_documents(spark)).count() == 0
