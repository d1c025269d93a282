import hashlib
import re

import xxhash
from polyrank.llm import simhash

from .cases import clashing, empty_documents, odd_documents, store


def brute(text):
    """The fingerprint, term by term."""
    w = re.split(r"[\x20\x09-\x0D]+", text.lower())
    votes, all_ = [0] * 64, 0
    for a, b in zip(w, [*w[1:], ""], strict=True):
        h = xxhash.xxh64_intdigest(b.encode(), xxhash.xxh64_intdigest(a.encode(), 42))
        v = max(1, min(simhash.MOST, len(a) + len(b)))
        all_ += v
        for i in range(64):
            votes[i] += v * (h >> i & 1)
    return sum((2 * v > all_) << i for i, v in enumerate(votes))


def test_fingerprints_equal_brute_force(spark, tmp_path):
    got = simhash.op2_simhash(spark, store(clashing(odd_documents(spark)), tmp_path)).collect()
    texts = {r.doc_id: r.text or "" for r in odd_documents(spark).collect()}
    order = sorted(texts, reverse=True)
    after = dict(zip(order, [*order[1:], order[0]], strict=True))
    assert len(got) == len(texts)
    for r in got:
        t, n = texts[r.doc_id], len(texts[r.doc_id])
        edited = t[: n - n // 2] + texts[after[r.doc_id]][: n // 2]
        a, b, c = brute(t), brute(edited), brute(texts[after[r.doc_id]])
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), r.doc_id
        assert r.fingerprint == f"{a:016x}" and r.edited_fingerprint == f"{b:016x}", r.doc_id
        assert r.near_edited == 1 - (a ^ b).bit_count() / 64 and r.near_next == 1 - (a ^ c).bit_count() / 64


def test_repeated_rows_and_null_ids(spark, tmp_path):
    df = odd_documents(spark)
    got = simhash.op2_simhash(spark, store(df.union(df).union(spark.createDataFrame([(None, "a b c d", None, None, 7)], df.schema)), tmp_path)).collect()
    assert len(got) == 21 and len({(r.doc_id, r.fingerprint, r.edited_fingerprint) for r in got}) == 11
    assert simhash.op2_simhash(spark, store(empty_documents(spark), tmp_path)).count() == 0


def test_next_documents_of_one_id_are_the_same_for_both(spark, tmp_path):
    """Of the next id's two texts the one with the smaller hash gives both the edit and the likeness, in any partitions."""
    rows = [(9, "alpha beta gamma delta epsilon zeta"), (5, "one two three four five six seven"), (5, "uno dos tres cuatro cinco seis")]
    th = {t: x for t, x in spark.createDataFrame(rows, "doc_id long, text string").selectExpr("text", "xxhash64(text)").collect()}
    other = min((t for i, t in rows if i == 5), key=th.get)
    text, n = rows[0][1], len(rows[0][1])
    for parts in (1, 3):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        r = next(r for r in simhash.op2_simhash(spark, store(df, tmp_path / str(parts))).collect() if r.doc_id == 9)
        assert r.edited_sha256 == hashlib.sha256((text[: n - n // 2] + other[: n // 2]).encode()).hexdigest()
        assert r.near_next == 1 - (brute(text) ^ brute(other)).bit_count() / 64


def test_near_fingerprints_equal_brute_force(spark):
    import random

    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = {b ^ sum(1 << i for i in rng.sample(range(64), k)) for b in base for k in (0, 1, 2, 3, 4)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in [*signed, *signed[:20], None]], "fp long")
    got = sorted((r.q, r.fp, r.distance) for r in simhash.near_fingerprints(df, df).collect())
    want = sorted((a, b, d) for a in signed for b in signed if (d := ((a ^ b) & (1 << 64) - 1).bit_count()) <= 3)
    assert got == want


def test_successors_over_ranges(spark):
    ids = [i * i * (-1) ** i for i in range(2000)]
    got = {r.id: r.next_id for r in simhash.successors(spark.createDataFrame([(i,) for i in [*ids, None]], "doc_id long")).collect()}
    order = sorted(set(ids), reverse=True)
    assert got == dict(zip(order, [*order[1:], order[0]], strict=True))
