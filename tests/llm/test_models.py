import math
import random

import numpy as np
from polyrank.llm import langid, quality

from .cases import clashing, empty_documents, odd_documents, store


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (3000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = quality.fit(x[:2000], y[:2000])
    assert m.pairs and ((m.score(x[2000:]) >= 0.5) == (y[2000:] > 0.5)).mean() > 0.9


def test_quality_without_rows_or_with_one_class():
    k = len(quality.FEATURES)
    assert quality.fit(np.empty((0, k)), np.empty(0)).score(np.zeros((2, k))).tolist() == [0.5, 0.5]
    assert quality.fit(np.zeros((3, k)), np.ones(3)).score(np.zeros((1, k)))[0] == 0.8
    assert len(quality.features("é a".encode())) == len(quality.features(b"")) == k


def plain_features(text):
    """Every feature from its definition, character by character."""
    raw = text.encode()
    n, words, lines = len(raw), raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    if not n:
        return [0.0] * len(quality.FEATURES)
    share = lambda test: sum(map(test, raw)) / n
    among = lambda chars: share(lambda b: chr(b) in chars and b < 128)
    letter = lambda b: chr(b).isalpha() and b < 128
    w = max(1, len(words))
    return [
        math.log(1 + n), share(lambda b: 65 <= b <= 90), share(lambda b: 97 <= b <= 122), share(lambda b: 48 <= b <= 57),
        among(" \t\n\r\x0b\x0c"), among("!?"), among("|<>{}[]\\/_"), among("%$&*#@^~+="), among(".,;:"), share(lambda b: b >= 128),
        share(lambda b: b < 9 or 14 <= b < 32), sum(b != 32 for b in raw) / w, len(set(words)) / w**0.75,
        sum(words[i] == words[i + 1] for i in range(len(words) - 1)) / w, n / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)),
        sum(x[-1] < 128 and not letter(x[-1]) for x in words) / w, sum(65 <= x[0] <= 90 for x in words) / w,
    ]


def test_quality_features_equal_their_definitions():
    texts = ["Hello, world. Yes! no? 5 end;", "a } ] | {x} [Y]", "", " \n \n", "Été à 日本 x\x01\x1f\n\nline\nline\nB b b", "one two two " * 30]
    for t in texts:
        assert np.allclose(quality.features(t.encode()), plain_features(t)), t
    assert quality.features(texts[0].encode())[quality.FEATURES.index("punctuated_words")] == 1.0 - 0 / 6


def test_table_scores_equal_sums_one_by_one():
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (500, len(quality.FEATURES)))
    m = quality.fit(x, (x[:, 0] * x[:, 1] + x[:, 2] > 0).astype(float))
    for row, got in zip(x[:50], m.score(x[:50]), strict=True):
        z = m.intercept + sum(t[sum(e <= v for e in edges)] for v, edges, t in zip(row, m.edges, m.tables, strict=True))
        z += sum(t[sum(e <= row[f] for e in ef), sum(e <= row[g] for e in eg)] for f, g, ef, eg, t in m.pairs)
        assert abs(got - 1 / (1 + math.exp(-z))) < 1e-9


def test_quality_fits_on_the_documented_number_of_rows(spark):
    x = spark.range(1000).selectExpr("id as doc_id", f"transform(sequence(1, {len(quality.FEATURES)}), i -> cast(id as double)) as x")
    labels = spark.range(1000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    a, b = (quality.training_rows(x.repartition(n), labels, sample=100) for n in (1, 7))
    assert 50 < len(a[0]) <= 100 and (a[0] == b[0]).all() and (a[1] == b[1]).all()


def test_quality_on_odd_documents(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (7, 1, None), (8, None, 1), (None, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = {r.doc_id: r for r in quality.op5_quality(spark, store(clashing(odd_documents(spark)), tmp_path)).collect()}
    assert len(rows) == 10 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    assert rows[2].score == rows[3].score and rows[1].score == rows[7].score
    assert quality.op5_quality(spark, store(empty_documents(spark), tmp_path)).count() == 0


def words(rng, alphabet):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(5, 60)))


def test_network_gradients():
    net, rng = langid.ByteNet(["a", "b"]), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rng.integers(1, 255, (5, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 1, 0, 1])
    loss = lambda: -np.log(net.forward(x)[np.arange(5), y]).mean()
    g = net.gradients(x, y)
    for name in net.p:
        i = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        net.p[name][i] += 1e-6
        up = loss()
        net.p[name][i] -= 2e-6
        assert abs((up - loss()) / 2e-6 - g[name][i]) < 1e-4, name
        net.p[name][i] += 1e-6


def plain_prediction(net, text):
    """Class probabilities of each window by loops over filters and places, averaged by the letters in each."""
    raw = text.lower().encode()
    total, weights = np.zeros(len(net.classes)), 0
    for start in range(0, len(raw), langid.WINDOW):
        window = raw[start : start + langid.WINDOW].ljust(langid.WINDOW, b"\0")
        pooled = []
        for w in langid.WIDTHS:
            for f in range(langid.FILTERS):
                at = [sum(net.p["e"][window[i + j]] @ net.p[f"c{w}"][j * langid.EMBED : (j + 1) * langid.EMBED, f] for j in range(w)) for i in range(langid.WINDOW - w + 1)]
                pooled.append(max(0, max(at) + net.p[f"b{w}"][f]))
        z = np.exp(np.array(pooled) @ net.p["o"] + net.p["s"])
        letters = sum(97 <= b <= 122 or 65 <= b <= 90 or b >= 128 for b in window) + 1e-3
        total, weights = total + letters * z / z.sum(), weights + letters
    return total / weights


def test_predictions_equal_loops():
    net = langid.ByteNet(["a", "b", "c"])
    texts = ["A short text", "é " * 100 + "and more of it, beyond a window", "x" * 128, "1 2 3 " * 30 + "z"]
    for text, (lang, score) in zip(texts, net.predict(texts), strict=True):
        p = plain_prediction(net, text)
        assert lang == net.classes[p.argmax()] and abs(score - p.max()) < 1e-4


def test_a_rare_language_and_rows_without_ids(spark, monkeypatch):
    monkeypatch.setattr(langid, "EACH", 10)
    rng = random.Random(4)
    rows = [(i, words(rng, "aeinrst"), "xx") for i in range(1000)] + [(None, "the same text", "xx")] * 500 + [(5000 + i, words(rng, "zwbkmj"), "rare") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    nets = [langid.fit(docs.repartition(n), sample=60) for n in (1, 5)]
    assert nets[0].classes == ["rare", "xx"] and all((nets[0].p[k] == nets[1].p[k]).all() for k in nets[0].p)


def test_language_of_texts(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, words(rng, "aeinrst" if i % 2 else "äöükzwbm"), "xx" if i % 2 else "yy", "s", 0) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = langid.op9_langid(spark, store(docs, tmp_path)).collect()
    right = [r.lang_pred == ("xx" if r.doc_id % 2 else "yy") for r in out if r.held_out]
    assert len(right) > 50 and np.mean(right) > 0.97 and all(0 <= r.score <= 1 for r in out)


def test_language_of_odd_documents(spark, tmp_path):
    rows = {r.doc_id: r for r in langid.op9_langid(spark, store(clashing(odd_documents(spark)), tmp_path)).collect()}
    assert len(rows) == 10
    assert all((rows[i].lang_pred, rows[i].score) == ("und", 0) for i in (2, 3, 4, 9)) and rows[6].lang_pred != "und"
    assert rows[1].lang_pred == rows[7].lang_pred
    assert langid.op9_langid(spark, store(empty_documents(spark), tmp_path)).count() == 0
