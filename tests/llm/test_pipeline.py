import random

import corpus_pipeline
import sentencepiece
from polyrank.llm import pieces

from .cases import clashing, empty_documents, odd_documents, store
from .test_minhash import brute as near
from .test_substrings import brute as repeats


def corpus():
    rng = random.Random(8)
    words = {"xx": [f"{a}{b}" for a in ("ran", "tis", "one") for b in ("el", "ist", "ona", "er", "in")], "yy": [f"{a}{b}" for a in ("zwö", "kub", "mäw") for b in ("zuk", "bö", "wük", "kä")]}
    rows = []
    for i in range(150):
        lang = "xx" if rng.random() < 0.6 else "yy"
        text = " ".join(rng.choice(words[lang]) + str(rng.randrange(100)) for _ in range(rng.randrange(20, 200)))
        rows.append((i, text, lang, f"s{i % 4}"))
    for i in range(150, 190):
        rows.append((i, rng.choice(rows)[1], "xx", "s9"))
    rows += [(i, "12 34 ??", "xx", "s1") for i in range(190, 195)]
    return rows


def test_each_stage_against_brute_force(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)
    names = list(stage)

    def go(name, df):
        out = stage[name](spark, df, str(tmp_path))
        if name != names[-1]:
            assert out.dtypes == docs.dtypes
        path = f"{tmp_path}/{names.index(name)}"
        out.write.parquet(path)
        return spark.read.parquet(path)

    one = go(names[0], docs)
    texts = {r.doc_id: r.text for r in one.collect()}
    assert texts == {i: t for i, t, *_ in rows if i < 190}
    two = go(names[1], one)
    comp = near(list(texts.items()))
    assert sorted(r.doc_id for r in two.collect()) == sorted(i for i, (_, c) in comp.items() if i == c)
    three = go(names[2], two)
    left = sorted((r.doc_id, r.text) for r in two.collect())
    want = {i: kept.decode("utf-8", "ignore") for (i, _), (kept, _) in zip(left, repeats([(i, t.encode()) for i, t in left]), strict=True)}
    assert {r.doc_id: r.text for r in three.collect()} == want and all(r.n_chars == len(r.text) for r in three.collect())
    four = go(names[3], three)
    n = lambda t: len(t.split())
    assert abs(sum(n(r.text) for r in four.collect()) - sum(map(n, want.values()))) <= 5
    assert all(want[r.doc_id].startswith(r.text) for r in four.collect())
    five = go(names[4], four)
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    assert sorted(list(r.ids) for r in five.collect()) == sorted(sp.encode(r.text) for r in four.collect())
    store(docs, tmp_path)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == five.count()


def test_odd_and_empty_documents(spark, tmp_path):
    from polyrank.llm import common

    df = odd_documents(spark)
    twice = clashing(df.union(df))
    got = sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, store(twice, tmp_path / "a")).collect())
    docs = twice
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/s{i}")
        docs = spark.read.parquet(f"{tmp_path}/s{i}")
    assert got == sorted((r.doc_id, r.ids_sha256) for r in docs.collect())
    ids = {i for i, _ in got}
    assert ids and not ids & {2, 3, 4, 9, 7}  # null, empty, blank, without letters, a copy of 1
    common.drop_written(spark)
    assert corpus_pipeline.run(spark, store(empty_documents(spark), tmp_path / "b")).count() == 0
