import math
from collections import Counter
from itertools import product

import numpy as np
from polyrank.llm import common
from polyrank.llm import hmm as H

from .cases import clashing, empty_documents, odd_documents, store


def tiny():
    rng = np.random.default_rng(0)
    m = H.Hmm.fresh(np.ones(4), 3)
    m.step = rng.dirichlet(np.ones(3), 3)
    return m


def paths(m, seq):
    """Probability of a sequence and of each path of states, by listing all paths."""
    out = {}
    for z in product(range(3), repeat=len(seq)):
        p = m.start[z[0]] * m.emit[z[0], seq[0]]
        for a, b, x in zip(z, z[1:], seq[1:], strict=False):
            p *= m.step[a, b] * m.emit[b, x]
        out[z] = p
    return out


def test_likelihood_and_counts_equal_the_sum_over_paths():
    m, seqs = tiny(), [np.array([0, 1, 2, 3, 1]), np.array([2]), np.array([3, 3, 0]), np.array([1, 1, 1, 2, 0])]
    score, starts, steps, emits = m.run(seqs, learn=True)
    want_start, want_step, want_emit = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 4))
    for s, got in zip(seqs, score, strict=True):
        ps = paths(m, s)
        total = sum(ps.values())
        assert abs(got - math.log10(total)) < 1e-12
        for z, p in ps.items():
            w = p / total
            want_start[z[0]] += w
            for a, b in zip(z, z[1:], strict=False):
                want_step[a, b] += w
            for a, x in zip(z, s, strict=True):
                want_emit[a, x] += w
    assert np.allclose(starts, want_start) and np.allclose(steps, want_step) and np.allclose(emits, want_emit)
    assert np.allclose(m.run(seqs), score)


def test_cut_sequences_equal_whole_ones(monkeypatch):
    rng = np.random.default_rng(9)
    m = H.Hmm.fresh(np.ones(50), 4)
    m.step = rng.dirichlet(np.ones(4), 4)
    seqs = [rng.integers(0, 50, n) for n in (1, 700, 3, 64, 65, 129, 5000, 8, 16, 17)]
    whole = m.run(seqs, learn=True)
    for segment, batch in ((64, 300_000), (7, 100), (1, 5)):
        monkeypatch.setattr(H, "SEGMENT", segment)
        monkeypatch.setattr(H, "BATCH_TOKENS", batch)
        for x, y in zip(whole, m.run(seqs, learn=True), strict=True):
            assert np.allclose(x, y, rtol=1e-9, atol=1e-9)
        assert np.allclose(whole[0], m.run(seqs), rtol=1e-12)


def test_token_hashes_equal_tokens_one_by_one(monkeypatch):
    monkeypatch.setattr(H, "PIECE", 40)
    texts = [b"", b"  ", b"The cat\tTHE\x0bcat\r\n", b"x" * 200 + b" y", "Éa É\x00 日本".encode(), b"a b c " * 50, b"\xa0 \x85z"]
    hashes, n = H.token_hashes(texts)
    words = [t for x in texts for t in H.tokens(x)]
    assert n.tolist() == [len(H.tokens(x)) for x in texts] and len(hashes) == len(words)
    assert len({(h, w) for h, w in zip(hashes.tolist(), words, strict=True)}) == len(set(words)) == len(set(hashes.tolist()))


def brute_base(rows):
    counts = Counter(t for i, x in rows if not H.held_out(i) for t in H.tokens(x))
    n, v = sum(counts.values()), len(counts)
    return n, {i: (len(H.tokens(x)), sum(counts[t] > 0 for t in H.tokens(x)), sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in H.tokens(x))) for i, x in rows}


def corpus(n=600):
    rng = np.random.default_rng(3)
    vocab = {k: [f"{k}{i}{'xyz'[i % 3]}" for i in range(200)] for k in ("al", "be")}
    out = []
    for i in range(n):
        k = "al" if rng.random() < 0.5 else "be"
        out.append((i, " ".join(vocab[k][min(199, int(rng.exponential(20)))] for _ in range(int(rng.integers(1, 120))))))
    return out


def test_scores_on_held_out_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(H, "BLOCK_BYTES", 30_000)
    monkeypatch.setattr(H, "BUCKET_BYTES", 20_000)
    monkeypatch.setattr(H, "BATCH_TOKENS", 2_000)
    monkeypatch.setattr(common, "PART_BYTES", 20_000)  # more partitions than the session's
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    n, want = brute_base([(i, t.encode()) for i, t in rows])
    got = H.op3_hmm(spark, store(df, tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_tokens, r.n_known) == want[r.doc_id][:2] and abs(r.base_score - want[r.doc_id][2]) < 1e-6
        assert r.train_tokens == n and r.held_out == H.held_out(r.doc_id) and r.score < 0
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)


def test_odd_documents(spark, tmp_path):
    df = odd_documents(spark)
    df = clashing(df.union(df).union(spark.createDataFrame([(None, "the end", None, None, 7)], df.schema)))
    got = H.op3_hmm(spark, store(df, tmp_path / "a")).collect()
    assert len(got) == 21 and all(math.isfinite(r.score) for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (2, 3, 4)} == {1}
    assert H.op3_hmm(spark, store(empty_documents(spark), tmp_path / "b")).count() == 0


def test_rare_words_have_emissions_of_their_own(spark):
    """Two topics of 4,000 words with the same endings, none with 1/6,000 of the tokens: only the words themselves tell."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{w}x0" for w in rng.integers(0, 4000, 100))) for i in range(1600)]
    held = [r for r in H.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)


def test_rounds_go_on_until_the_likelihood_settles(spark):
    *_, history = H.trained(spark.createDataFrame(corpus(), "doc_id long, text string"), 1e-4)
    gains = np.diff(history)
    assert len(history) > 4 and (gains[:-1] >= 1e-4).all() and gains[-1] < 1e-4


def test_one_state_is_the_base_score(spark):
    docs = spark.createDataFrame(corpus(100), "doc_id long, text string")
    texts, sums, words, *_ = H.trained(docs, states=1)
    got = texts.groupBy("blk").cogroup(sums.groupBy("blk")).applyInArrow(lambda d, a: H.score_block(d, a, words), H._ddl(H.SCORES)).collect()
    assert len(got) == 100 and all(abs(r.score - r.base_score) < 1e-4 for r in got)


def test_counts_beyond_32_bits():
    import pyarrow as pa

    rows = [dict(zip(H.BLOCKS.names, (1, b, 0, 1, np.array([7], np.uint64).tobytes(), b"", H.pack(np.array([2**31 + 5])), b"", b""), strict=True)) for b in (0, 1)]
    got = H.start_bucket(pa.Table.from_pylist(rows, H.BLOCKS)).to_pylist()
    assert [H.unpack(r["counts"], 1, np.int64)[0] for r in got if r["p"] == 0] == [2**32 + 10] * 2


def test_batches_are_bounded_whatever_the_texts(monkeypatch):
    sizes, plain = [], H.Hmm._batch
    monkeypatch.setattr(H.Hmm, "_batch", lambda self, seqs, *rest: sizes.append(sum(map(len, seqs))) or plain(self, seqs, *rest))
    rng = np.random.default_rng(2)
    m = H.Hmm.fresh(np.ones(30), 2)
    got = m.run([rng.integers(0, 30, n) for n in [200_000] * 6 + [900_000] + [50] * 100])
    assert np.isfinite(got).all() and sum(sizes) == 2_105_000 and max(sizes) <= H.BATCH_TOKENS + H.SEGMENT


def test_tokens_and_sums_survive_packing():
    rng = np.random.default_rng(3)
    number = rng.zipf(1.3, 5000).clip(max=70_000).astype(np.int64) - 1
    data, order = H.pack_tokens(number, 70_000)
    assert (H.unpack_tokens(data, order, 5000, 70_000) == number).all()
    sums = rng.integers(-(2**62), 2**62, (100, 8))
    assert (H.unpack_sums(H.pack_sums(sums), 100, 8) == sums).all()


def test_numbers_that_rise_take_about_a_byte_or_less():
    rng = np.random.default_rng(4)
    numbers = np.flatnonzero(rng.random(400_000) < 0.4).astype(np.int32)
    packed = H.pack_rising(numbers)
    assert (H.unpack_rising(packed, len(numbers)) == numbers).all() and len(packed) < 0.5 * len(numbers)
    for odd in (np.array([], np.int32), np.array([-1, 2**31 - 1, -(2**31), 0, -1], np.int32), rng.permutation(1000).astype(np.int32)):
        assert (H.unpack_rising(H.pack_rising(odd), len(odd)) == odd).all()
    number = np.minimum(rng.zipf(1.2, 300_000), 200_000) - 1  # most words occur once
    _, number = np.unique(number, return_inverse=True)
    data, order = H.pack_tokens(number, number.max() + 1)
    assert (H.unpack_tokens(data, order, len(number), number.max() + 1) == number).all() and len(order) < number.max() + 1


def test_sums_of_a_block_are_those_of_its_words_by_rank():
    """A shared word (bucket 0, number 0), one of the block's own, a shared one (bucket 1, number 5), after the first round."""
    wide = np.array([[2**40 + 3, 7], [0, 2**33]])
    row = lambda p, n, ids, sums: (0, p, n, ids, H.pack_sums(sums), b"", None)
    table = H._table([row(-2, 1, b"", np.array([[5, 6]])), row(0, 1, H.pack_rising(np.array([0])), wide[:1]), row(1, 1, H.pack_rising(np.array([5])), wide[1:])], H.SUMS)
    text = {"words": 3, "order": H.pack_rising(np.array([2, 0, 1], np.int32)), "shared": H.pack(np.array([1, 0, 1], np.uint8))}
    assert H.block_sums(table, text, 2).tolist() == [wide[1].tolist(), wide[0].tolist(), [5, 6]]
