import random

from polyrank.llm import minhash

from .cases import clashing, empty_documents, odd_documents, store


def brute(rows):
    """{doc_id: (set size, component)} by comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                ra, rb = sorted((root(a), root(b)))
                comp[rb] = ra
    return {i: (len(sets[i]), root(i)) for i in ids}


def edited(rng, words, changes):
    w = list(words)
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return w


def corpus(rng):
    word = lambda: f"w{int(rng.expovariate(0.004))}"
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(90):
        base = [word() for _ in range(rng.randrange(1, 260))]
        if rng.random() < 0.4:
            base[rng.randrange(len(base)) :] = passage
        texts.append(base)
        for _ in range(rng.choice([0, 0, 0, 1, 2, 5])):
            texts.append(edited(rng, base, rng.randrange(0, 4 + len(base) // 40)))
    rng.shuffle(texts)
    return [(i * 3 + 1, " ".join(t)) for i, t in enumerate(texts)]


def test_equal_to_brute_force(spark, tmp_path):
    for seed in (1, 2):
        rows = corpus(random.Random(seed))
        got = minhash.op8_minhash(spark, store(spark.createDataFrame(rows, "doc_id long, text string"), tmp_path / str(seed))).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got) and sum(not r.kept for r in got) > 10


def test_large_families_equal_brute_force(spark, tmp_path, monkeypatch):
    """Families above SMALL, in several blocks, among them one whose members are close to their base only."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(9)
    rows = []
    for size, changes in ((80, 2), (60, 6), (70, 7)):
        base = [f"b{rng.randrange(10**6)}" for _ in range(240)]
        rows += [" ".join(base)] + [" ".join(edited(rng, base, changes)) for _ in range(size)] + [" ".join(base)] * 30
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    got = minhash.op8_minhash(spark, store(spark.createDataFrame(rows, "doc_id long, text string"), tmp_path)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_odd_documents(spark, tmp_path):
    df = odd_documents(spark)
    twice = df.union(df).union(spark.createDataFrame([(None, "The cat sat on the mat", None, None, 1), (3, "x", None, None, 1)], df.schema))
    got = minhash.op8_minhash(spark, store(clashing(twice), tmp_path / "a")).collect()
    assert len(got) == 22
    by = {(r.doc_id, r.n_shingles): r for r in got}
    assert by[7, by_size(by, 7)].component_id == 1 and by[2, 0].component_id == 2 and by[2, 0].kept and by[3, 1].component_id == 3 and by[8, 1].component_id == 3
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert minhash.op8_minhash(spark, store(empty_documents(spark), tmp_path / "b")).count() == 0
    left = sorted((r.doc_id is None, r.doc_id or 0) for r in minhash.without_near_duplicates(clashing(twice)).collect())
    assert left == [*((False, i) for i in (1, 2, 3, 3, 4, 5, 6, 9, 10)), (True, 0)]


def test_rows_of_one_id_stay_if_they_differ(spark):
    rows = [(7, "one text of some words that is like no other"), (7, "quite another text with words of its own"), (None, "x y z"), (None, "x y z"), (None, "w")]
    df = spark.createDataFrame(rows * 2, "doc_id long, text string")
    for n in (1, 5):
        got = minhash.without_near_duplicates(df.repartition(n)).collect()
        assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(set(rows), key=str)


def by_size(by, doc_id):
    return next(n for i, n in by if i == doc_id)
