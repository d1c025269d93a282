"""Hand-computed cases, ties, missing values and rejections."""

import math
import random

import numpy as np
import pytest
from polyrank.functions import columns, windows
from polyrank.operators import bootstrap, contracts, geometry, joins, kernels, pairs, selectors, stats
from polyrank.plans import models, runs
from polyrank.sources import readers, writers
from polyrank.streaming import incremental
from pyspark.sql import functions as F


def frame(spark, rows, schema, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


def ranks(spark, values, parts=3):
    d = frame(spark, [(1, i, v) for i, v in enumerate(values)], "g int, id int, v double", parts)
    return [r.c for r in d.select("id", windows.centred_rank("v", "g").alias("c")).orderBy("id").collect()]


@pytest.mark.parametrize("parts", [1, 7])
def test_centred_ranks(spark, parts):
    assert ranks(spark, [1.0, 2.0, 3.0, 4.0], parts) == [-0.25, 0.0, 0.25, 0.5]
    assert ranks(spark, [2.0] * 4, parts) == [0.125] * 4
    assert ranks(spark, [1.0, 2.0, 2.0, 4.0], parts) == [-0.25, 0.125, 0.125, 0.5]
    assert ranks(spark, [1.0, None, 3.0], parts) == [pytest.approx(1 / 3 - 0.5), None, pytest.approx(2 / 3 - 0.5)]


def test_two_level_imputation(spark):
    d = frame(spark, [("A", 0, 1.0), ("A", 1, 3.0), ("A", 2, None), ("B", 3, None), ("B", 4, None)], "g string, id int, v double")
    got = {r.id: r.x for r in d.select("id", windows.imputed("v", "g", 7.0).alias("x")).collect()}
    assert got == {0: 1.0, 1: 3.0, 2: 2.0, 3: 7.0, 4: 7.0}


def test_parsing(spark):
    d = frame(spark, [("nan", "True "), ("inf", "no"), ("1.5", None), ("x", "false"), (None, "TRUE")], "n string, b string", 1)
    got = d.select(columns.finite("n").alias("n"), columns.parsed_bool("b").alias("b"), columns.parsed_bool("b", True).alias("s"), columns.whole_number("n").alias("w")).collect()
    assert [r.n for r in got] == [None, None, 1.5, None, None] and [r.b for r in got] == [True, False, False, False, True]
    assert [r.s for r in got] == [True, None, None, False, True] and {r.w for r in got} == {None}


def test_rank_statistics_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(g, i, float(rng.randrange(6)) if rng.random() > 0.1 else None, rng.random() < 0.4) for g in range(4) for i in range(25)]
    d = frame(spark, rows, "g int, id int, s double, y boolean")
    for g, auc in ((r.g, r.auc) for r in stats.roc_auc(d, "y", "s", "g").collect()):
        pos = [s for h, _, s, y in rows if h == g and y and s is not None]
        neg = [s for h, _, s, y in rows if h == g and not y and s is not None]
        assert auc == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)))
    used = [(s, y) for _, _, s, y in rows if s is not None]
    p, ap, tp, n = sum(y for _, y in used), 0.0, 0, 0
    for s in sorted({s for s, _ in used}, reverse=True):
        block = [y for t, y in used if t == s]
        tp, n = tp + sum(block), n + len(block)
        ap += sum(block) / p * tp / n
    assert stats.average_precision(d, "y", "s").first().ap == pytest.approx(ap)
    assert stats.roc_auc(d.where("y"), "y", "s").first().auc is None
    assert stats.spearman(frame(spark, [(1.0, 2.0), (2.0, 2.0), (3.0, 2.0)], "a double, b double"), "a", "b").first().rho is None


def test_precision_at_fraction_and_save_break(spark):
    d = frame(spark, [(i, 1.0 if i < 5 else 0.5, i % 2 == 0) for i in range(20)], "id int, s double, y boolean")
    got = stats.precision_at_fraction(d, "y", "s", 0.35, ["id"]).first()
    assert (got.selected, got.cutoff) == (7, 0.5) and got.precision == pytest.approx(4 / 7)
    a = frame(spark, [(1, 0.9), (2, 0.1), (3, 0.5)], "g int, t double")
    b = frame(spark, [(1, 0.1), (2, 0.5), (3, 0.3)], "g int, t double")
    assert tuple(stats.save_break(a, b, "t", "g").first()) == (1, 1, 0)


def test_selectors_with_ties_and_missing_scores(spark):
    rows = [(1, 1, 3, None, 0.1), (1, 2, 1, None, 0.2), (2, 3, 1, 0.5, 0.9), (2, 4, 2, 0.5, 0.1), (2, 5, 3, None, 0.95)]
    d = frame(spark, rows, "g int, id int, rank int, s double, t double")
    pick = lambda x: {r.g: r.id for r in x.collect()}
    assert pick(selectors.top1(d, "s", "g", ["id"])) == {1: 1, 2: 3}
    assert pick(selectors.top1_or_rank1(d, "s", "g", "rank", ["id"])) == {1: 2, 2: 3}
    assert pick(selectors.oracle(d, "t", "g", "rank", ["id"])) == {1: 2, 2: 5} == pick(selectors.oracle(d, "t", "g", "rank", ["id"], None))
    f = selectors.flags(d, "s", "g", "rank", ["id"]).where("selected_by_model").groupBy("g").count().collect()
    assert all(r["count"] == 1 for r in f)
    with pytest.raises(ValueError):
        selectors.from_cluster(d.withColumn("c", F.lit(1)), "c", "other", "t", "s", "g", "rank", ["id"])


def test_set_similarity(spark):
    s = "g int, id int, c array<struct<ra:int,rb:int>>"
    d = frame(spark, [(1, 1, [(1, 1), (2, 2)]), (1, 2, [(1, 1), (3, 2)]), (1, 3, [])], s)
    got = {(r.a_id, r.b_id): r for r in pairs.pair_similarity(d, "g", "id", "c", []).collect()}
    assert got[1, 2].jaccard == pytest.approx(1 / 3) and got[1, 2].jaccard_side_a == pytest.approx(1 / 3)
    assert got[1, 2].jaccard_side_b == 1 and got[1, 2].jaccard_sides == pytest.approx(2 / 3)
    assert got[1, 3].jaccard is None and got[1, 3].reason == "second_empty" and not got[2, 3].valid
    m = pairs.similarity_matrix(d, pairs.pair_similarity(d, "g", "id", "c", []), "g", "id", ["id"])
    cells = {(r.i, r.j): (r.value, r.imputed) for r in m.collect()}
    assert cells[1, 1] == (1.0, False) and cells[1, 3] == (pytest.approx(1 / 3), True) == cells[3, 1] and sum(i for _, i in cells.values()) == 4


def test_clusters():
    s, t = frozenset({(1, 1)}), frozenset({(9, 9)})
    assert kernels.cluster_sets([s, s, t, frozenset()], 0.5) == ([1, 1, 2, -1], 0.5)
    assert kernels.cluster_sets([frozenset()] * 3, 0.5) == ([-1, -1, -1], 1 / 3)


def test_average_linkage_against_plain_version():
    rng = np.random.default_rng(5)
    for _ in range(20):
        n = 9
        sim = np.triu(rng.random((n, n)), 1)
        sim = sim + sim.T + np.eye(n)
        groups = [[i] for i in range(n)]
        while len(groups) > 1:
            d, a, b = min((np.mean([1 - sim[i, j] for i in x for j in y]), p, q) for p, x in enumerate(groups) for q, y in enumerate(groups) if p < q)
            if d > 0.45:
                break
            groups[a] += groups.pop(b)
        want = {frozenset(g) for g in groups}
        got = kernels.average_linkage(sim, 0.45)
        assert {frozenset(np.flatnonzero(got == k).tolist()) for k in set(got.tolist())} == want


def test_rigid_poses():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(11, 3)), rng.normal(size=(10, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    assert kernels.aligned_rmsd(a, b, a @ q + 4, b @ q + 4) == pytest.approx(0, abs=1e-9)
    assert kernels.aligned_rmsd(a, b, a, b + [0, 0, 2]) == pytest.approx(2)
    with pytest.raises(ValueError):
        kernels.aligned_rmsd(a, b, a[:5], b)


def test_surface_of_spheres():
    one = kernels.surface(np.zeros((1, 3)), np.array([1.7]), slices=200)
    assert one[0] == pytest.approx(4 * math.pi * 3.1**2)
    two = kernels.surface(np.array([[0.0, 0, 0], [3.1, 0, 0]]), np.array([1.7, 1.7]), slices=400)
    cap = 2 * math.pi * 3.1 * (3.1 - 1.55)  # each loses the cap beyond the middle plane
    assert two.sum() == pytest.approx(2 * (4 * math.pi * 3.1**2 - cap), rel=2e-3)


def test_distance_join_is_strict_and_equal_to_brute_force(spark):
    rng = random.Random(1)
    a = [(0, i, *(rng.randrange(-8, 8) / 2 for _ in range(3))) for i in range(40)] + [(0, 99, 0.0, 0.0, 0.0)]
    b = [(0, i, *(rng.randrange(-8, 8) / 2 for _ in range(3))) for i in range(40)] + [(0, 98, 1.5, 0.0, 0.0)]
    da, db = frame(spark, a, "g int, a int, x double, y double, z double"), frame(spark, b, "g int, b int, x double, y double, z double")
    got = {(r.a, r.b) for r in joins.distance_join(da, db, 1.5, ["g"]).collect()}
    assert got == {(p[1], q[1]) for p in a for q in b if sum((u - v) ** 2 for u, v in zip(p[2:], q[2:], strict=True)) < 2.25} and (99, 98) not in got


def test_best_mapping(spark):
    d = frame(spark, [(1, 0.2, 0.8, True), (2, 0.2, 0.8, False), (3, 0.5, 0.5, True), (4, 0.5, None, True)], "id int, d double, s double, ok boolean")
    got = {r.id: (r.truth, r.mapping, r.gain) for r in geometry.best_mapping(d, "d", "s", F.col("ok")).collect()}
    assert got == {1: (0.8, "swapped", pytest.approx(0.6)), 2: (0.2, "direct", 0.0), 3: (0.5, "direct", 0.0), 4: (0.5, "direct", 0.0)}


def test_accessions(spark):
    d = frame(spark, [("1abc__A1_P1--1abc__B1_P1",), ("1ABC__A1_UNDEFINED--1abc__B1_undefined",), ("x__A_P1--x__B_P2",)], "n string", 1)
    got = d.select(columns.accession("n", 0).alias("a"), columns.accession("n", 1).alias("b"), columns.same_known(columns.accession("n", 0), columns.accession("n", 1)).alias("s"), columns.entry_id("n").alias("e")).collect()
    assert [r.s for r in got] == [True, False, False] and got[2].b == "P2" and got[1].e == "1abc"


def test_stable_hash_equals_python(spark):
    d = frame(spark, [("a",), ("é",), ("x--y",)], "v string")
    assert all(int(r.h) == kernels.hash64("s", r.v) for r in d.select("v", columns.stable_hash("v", "s").alias("h")).collect())


def test_contracts_reject(spark):
    d = frame(spark, [(1, 1, 0.5, 0.1, 0), (1, 1, 0.4, 0.9, 0), (2, 3, 0.1, 0.2, 1)], "g int, id int, score double, truth double, fold int")
    v = contracts.duplicate_keys(d, ["g", "id"])
    assert tuple(v.first()) == ("duplicate_keys", 1, "1,1")
    with pytest.raises(contracts.ContractError, match="duplicate"):
        contracts.require(v)
    with pytest.raises(contracts.ContractError, match="lacks"):
        contracts.require_columns(d, ["nope"])
    with pytest.raises(contracts.ContractError, match="right only"):
        joins.exact_join(d.where("id = 3"), d.where("id = 1").dropDuplicates(["g", "id"]), ["g", "id"])
    with pytest.raises(contracts.ContractError, match="one class"):
        runs.validate(d.dropDuplicates(["g", "id"]), runs.Config(("score",)))
    for bad in ({"features": ()}, {"features": ("a",), "loss": "x"}, {"features": ("a",), "penalty": -1}):
        with pytest.raises(ValueError):
            runs.Config(**bad)


def synthetic(spark, groups=40, size=8):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(groups):
        for i in range(size):
            a, b = rng.normal(), rng.normal()
            t = 1 / (1 + math.exp(-(0.8 * a - 0.5 * b - 0.3 + rng.normal())))
            rows.append((g, g * 100 + i, float(a), float(b), float(t), g % 4, i + 1))
    return rows, spark.createDataFrame(rows, "g int, id int, score double, other double, truth double, fold int, rank int")


def numpy_ridge(x, y, lam):
    x = np.column_stack((np.ones(len(x)), x))
    beta, ridge = np.zeros(x.shape[1]), lam * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        beta += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ beta)
    return beta


def test_ridge_logistic_equals_numpy(spark):
    rows, d = synthetic(spark)
    x, y = np.array([r[2:4] for r in rows]), np.array([r[4] >= 0.5 for r in rows], float)
    beta, _ = models.ridge_logistic(d.withColumn("y", F.col("truth") >= 0.5), ["score", "other"], "y", 2.0)
    assert np.allclose(beta, numpy_ridge(x, y, 2.0), atol=1e-8)
    with pytest.raises(models.NotConverged):
        models.ridge_logistic(d.withColumn("y", F.col("truth") >= 0.5), ["score"], "y", 1.0, rounds=1)


def test_group_softmax_is_a_minimum_and_ignores_shifts(spark):
    rows, d = synthetic(spark, 20, 6)
    d = d.withColumn("y", F.col("truth") >= 0.5)
    w, _ = models.group_softmax(d, ["score", "other"], "y", penalty=1.0)
    x, y, g = np.array([r[2:4] for r in rows]), np.array([r[4] >= 0.5 for r in rows], float), np.array([r[0] for r in rows])

    def loss(b):
        out = b @ b
        for k in set(g):
            m = g == k
            if 0 < y[m].sum() < m.sum():
                z = x[m] @ b
                out -= (y[m] / y[m].sum()) @ (z - z.max() - np.log(np.exp(z - z.max()).sum()))
        return out

    for i in range(2):
        for e in (1e-4, -1e-4):
            b = w.copy()
            b[i] += e
            assert loss(b) > loss(w)
    shifted, _ = models.group_softmax(d.withColumn("score", F.col("score") + F.col("g")), ["score", "other"], "y", penalty=1.0)
    assert np.allclose(w, shifted, atol=1e-6)
    with pytest.raises(ValueError):
        models.group_softmax(d, ["score"], "y", min_mixed=1000)


def test_train_predict_evaluate(spark, tmp_path):
    _, d = synthetic(spark)
    config = runs.Config(("score", "other"), replicates=20)
    roles = runs.Roles(threshold=0.5)
    model, oof = runs.train(d, config, roles)
    assert oof.count() == 320 and "truth" not in runs.predict(d, model, roles).columns
    assert runs.predict(d, model, roles).where("selected_by_model").count() == 40
    again = models.Model.from_dict(model.to_dict())
    a, b = (m.score(d).agg(F.sum("probability")).first()[0] for m in (model, again))
    assert a == b
    e = runs.evaluate(oof, roles, 20)
    assert e.first().auc > 0.6
    with pytest.raises(ValueError):
        models.Model.from_dict({"schema_version": 0})


def test_bootstrap_weights(spark):
    d = frame(spark, [(g,) for g in range(30)], "g int")
    for w in (bootstrap.weights(d, "g", 15), bootstrap.numpy_weights(d, "g", 15, 9)):
        assert [r.s for r in w.groupBy("b").agg(F.sum("w").alias("s")).collect()] == [30] * 15


def test_packed_bootstrap_equals_joined_weights(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(int(g), float(rng.integers(0, 12)) if rng.random() > 0.05 else None, bool(rng.random() < 0.4)) for g in rng.integers(0, 40, 700)]
    d = spark.createDataFrame(rows, "g int, v double, y boolean")
    for name, value in {"ROWS": 100, "HELD": 200, "LEAST": 3}.items():
        monkeypatch.setattr(bootstrap, name, value)
    packed, joined = bootstrap.packed_weights(d, "g", 23, 16), bootstrap.weights(d, "g", 23)
    for a, b, c in ((bootstrap.packed_auc, bootstrap.weighted_auc, "auc"), (bootstrap.packed_brier, bootstrap.weighted_brier, "brier")):
        got, want = ({r.b: r[c] for r in f(d, w, "y", "v", "g").collect()} for f, w in ((a, packed), (b, joined)))
        assert len(want) == 23 and got == pytest.approx(want, rel=1e-12)


def test_metric_difference_has_all_three_metrics(spark, monkeypatch):
    rng = np.random.default_rng(5)
    share = lambda: float(rng.integers(0, 12)) / 12 if rng.random() > 0.05 else None
    rows = [(int(g), share(), float(rng.integers(0, 30)) / 30, bool(rng.random() < 0.4)) for g in rng.integers(0, 40, 700)]
    d = spark.createDataFrame(rows, "g int, a double, b double, y boolean")
    for name, value in {"ROWS": 100, "HELD": 200, "LEAST": 3, "SUMMED": 2}.items():
        monkeypatch.setattr(bootstrap, name, value)

    def metrics(sample, c):
        known = [r for r in sample if r[c] is not None]
        pos, neg = ([r[c] for r in known if r[3] == y] for y in (True, False))
        auc = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg))
        ap = sum(sum(q >= p for q in pos) / sum(r[c] >= p for r in known) for p in pos) / len(pos)
        return np.array([auc, ap, sum((r[3] - r[c]) ** 2 for r in known) / len(sample)])

    by = {g: [r for r in rows if r[0] == g] for g in range(40)}
    draws = [[r for g, n in enumerate(bootstrap.drawn(b, 40)) for r in by[g] * int(n)] for b in range(12)]
    reps = np.array([metrics(x, 1) - metrics(x, 2) for x in draws])
    got = {r.metric: r for r in bootstrap.metric_difference(d, "y", "a", "b", "g", 12).collect()}
    assert set(got) == {"auc", "ap", "brier"}
    for k, m in enumerate(("auc", "ap", "brier")):
        assert [got[m].low, got[m].high] == pytest.approx(list(np.quantile(reps[:, k], [0.025, 0.975])), rel=1e-9) and got[m].replicates == 12
    ranks = bootstrap.packed_ranks(d, bootstrap.packed_weights(d, "g", 12, 16), "y", "a", "g").orderBy("b").collect()
    assert [x for r in ranks for x in (r.auc, r.ap)] == pytest.approx([x for s in draws for x in metrics(s, 1)[:2]], rel=1e-9)
    whole = metrics(rows, 1) - metrics(rows, 2)
    assert [got[m].delta for m in ("auc", "ap", "brier")] == pytest.approx(list(whole), rel=1e-9)


def test_rank_sums_over_steps():
    rng = np.random.default_rng(4)
    i, s, p, q, w = rng.integers(0, 9, 60), rng.integers(0, 5, 60).astype(float), rng.integers(0, 3, 60), rng.integers(0, 3, 60), rng.integers(0, 4, (9, 7)).astype(np.uint8)
    s[:7] = np.nan
    key = np.where(np.isnan(s), 99, s)
    above = (key[:, None] > key) + (key[:, None] == key) / 2
    wp, wn = p[:, None] * w[i], q[:, None] * w[i]
    for step in (1, 4, 100):
        pos, neg, inner = bootstrap.rank_sums(i, s, p, q, w, step)
        assert (pos == wp.sum(0)).all() and (neg == wn.sum(0)).all() and np.allclose(inner, (wp * (above @ wn)).sum(0))


def test_surface_by_samples_equals_all_atoms(monkeypatch):
    rng = np.random.default_rng(6)
    x, radius = rng.normal(0, 2, (200, 3)), rng.uniform(1.2, 2, 200)
    x[:20] = x[20:40]
    monkeypatch.setattr(kernels, "TRIED", ())
    want = kernels.surface(x, radius)
    monkeypatch.setattr(kernels, "TRIED", (16, 64))
    assert np.allclose(kernels.surface(x, radius), want, atol=1e-9) and 0 < (want > 0).sum() < 150
    assert np.allclose(sum(kernels.surface(x, radius, part=k, parts=3) for k in range(3)), want, atol=1e-9)


def test_surface_areas_of_a_group_in_several_tasks(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(g, "AB"[i % 2], *map(float, rng.normal(0, 4, 3))) for g, n in ((1, 90), (2, 3)) for i in range(n)]
    monkeypatch.setattr(kernels, "SHARE", 20)
    got = {r.g: r for r in kernels.surface_areas(spark.createDataFrame(rows, "g int, side string, x double, y double, z double"), "g").collect()}
    for g in (1, 2):
        for name, sides in (("area_a", "A"), ("area_b", "B"), ("area_both", "AB")):
            x = np.array([r[2:] for r in rows if r[0] == g and r[1] in sides])
            assert got[g][name] == pytest.approx(kernels.surface(x, np.full(len(x), 1.7)).sum()) and got[g].status == "ok"


def test_folds_and_spread():
    f = kernels.balanced_folds([(i, "ab"[i % 3 == 0]) for i in range(50)], 5, "s")
    sizes = [sum(v == k for v in f.values()) for k in range(5)]
    assert max(sizes) - min(sizes) <= 1
    x = np.array([[0.0], [0.1], [1.0], [0.5], [0.5]])
    assert set(kernels.spread_out(x, [1, 2, 3, 4, 5], 3, "s", required=[1])) >= {1, 3}


def test_readers(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("# head\n b1\n\na2\n")
    ids = readers.checked_ids(readers.read_id_list(spark, str(tmp_path / "ids.txt")), 2)
    assert sorted(r.id for r in ids.collect()) == ["a2", "b1"]
    with pytest.raises(contracts.ContractError):
        readers.checked_ids(ids, 3)
    d = frame(spark, [('{"a": 0.5}',), ('{"a": 0.5, "b": 0.6}',), ('{"b": true}',), ('{"a": 3}',), ("nonsense",)], "t string", 1)
    assert [r.v for r in d.select(readers.json_number("t", "$.a", "$.b").alias("v")).collect()] == [0.5, None, None, None, None]
    lines = ["ATOM      1  N   ALA R   1      11.104   6.134  -6.504  1.00  0.00           N", "ATOM      2  H   ALA R   1      11.104   6.134  -6.504  1.00  0.00           H", "ATOM      3  CA  GLY R   2       1.000   2.000   3.000  1.00  0.00           C", "HETATM    4  O   HOH R   3       1.000   2.000   3.000  1.00  0.00           O"]
    a = readers.pdb_atoms(spark.createDataFrame([("s", n, x) for n, x in enumerate(lines)], "structure string, n int, value string"))
    got = sorted((r.serial, r.name, r.res, r.x, r.element) for r in a.collect())
    assert got == [(1, "N", 1, 11.104, "N"), (3, "CA", 2, 1.0, "C")]
    assert readers.chain_sequences(a).first().sequence == "AG"
    rep = "A B 1 2 asym 0.0408 0 0 0 0 0 0 x\nB A 1 2 asym 0.0419 0 0 0 0 0 0 x\nA B 1 2 max 0.0419 0 0 0 0 0 0 x\nshort"
    r = readers.parsed_report(spark.createDataFrame([(1, rep)], "k int, t string"), "t", "k").first()
    assert (r.low, r.high, r.ok) == (0.0408, 0.0419, True) and r.mean == pytest.approx(0.04135)


WIDE = "ATOM  {:5d}  CA  {} R{:4d}{}   {:8.3f}   6.134  -6.504  1.00  0.00           {}"


def test_atom_numbers_wider_than_their_columns(spark):
    wide = [WIDE.format(99999, "ALA", 9999, " ", 1.0, "C"), WIDE.format(100000, "GLY", 9999, "B", -2.0, "C"), WIDE.format(100001, "SER", 10000, " ", 3.0, "C"), WIDE.format(100002, "SER", 10000, " ", 3.0, "H"), WIDE.format(1234567, "LYS", 123456, "A", 4.0, "N"), WIDE.format(-10000, "LYS", -1000, " ", 5.0, "N")]
    w = spark.createDataFrame([("s", n, x) for n, x in enumerate(wide)], "structure string, n int, value string")
    got = sorted((r.serial, r.name, r.residue, r.chain, r.number, r.res, r.x, r.y, r.z, r.element) for r in readers.pdb_atoms(w).collect())
    assert got == [(-10000, "CA", "LYS", "R", "-1000 ", 5, 5.0, 6.134, -6.504, "N"), (99999, "CA", "ALA", "R", "9999 ", 1, 1.0, 6.134, -6.504, "C"), (100000, "CA", "GLY", "R", "9999B", 2, -2.0, 6.134, -6.504, "C"), (100001, "CA", "SER", "R", "10000 ", 3, 3.0, 6.134, -6.504, "C"), (1234567, "CA", "LYS", "R", "123456A", 4, 4.0, 6.134, -6.504, "N")]
    assert readers.pdb_problems(w, chains=1).count() == 0


def test_sequence_of_wide_residue_numbers(spark):
    lines = [WIDE.format(n, x, r, " ", 1.0, "C") for n, x, r in ((9, "ALA", 9999), (99999, "GLY", 10000), (100000, "SER", 10001))]
    w = spark.createDataFrame([("s", n, x) for n, x in enumerate(lines)], "structure string, n int, value string")
    assert [tuple(r) for r in readers.chain_sequences(readers.pdb_atoms(w)).collect()] == [("s", "R", "AGS")]


def test_writers(spark, tmp_path):
    writers.write_json(tmp_path / "x.json", {"b": float("nan"), "a": np.float64(1.5)})
    assert (tmp_path / "x.json").read_text() == '{\n  "a": 1.5,\n  "b": null\n}\n'
    d = frame(spark, [(2, "b"), (1, "a")], "i int, s string")
    writers.write_small_csv_gz(d, tmp_path / "a.gz", ["i"])
    writers.write_small_csv_gz(d.repartition(5), tmp_path / "b.gz", ["i"])
    assert (tmp_path / "a.gz").read_bytes() == (tmp_path / "b.gz").read_bytes()
    with pytest.raises(FileExistsError):
        writers.refuse_to_overwrite([tmp_path / "a.gz"])
    assert writers.canonical_digest({"a": 1, "created": "x"}) == writers.canonical_digest({"created": "y", "a": 1})


def test_incremental_groups(spark, tmp_path):
    schema = "g int, v double"
    spark.createDataFrame([(1, 1.0), (2, 5.0)], schema).write.parquet(f"{tmp_path}/all")
    spark.createDataFrame([(2, 7.0)], schema).write.parquet(f"{tmp_path}/in")
    seen = []
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = incremental.upkeep(stream, lambda: spark.read.schema(schema).parquet(f"{tmp_path}/all"), lambda b: b.write.mode("append").parquet(f"{tmp_path}/all"), lambda df, n: seen.extend((r.g, r.m) for r in df.collect()), lambda df: df.groupBy("g").agg(F.avg("v").alias("m")), "g", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert seen == [(2, 6.0)]


def test_results_do_not_depend_on_partitions(spark):
    _, d = synthetic(spark, 10, 6)
    got = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted(map(str, selectors.combo(d.repartition(int(n)), ["score", "other"], "g", ["id"]).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1]


def test_overlap_audit_lists_all_ids(spark):
    """A value that more than 100 ids of each side share loses none of them."""
    from polyrank.operators import sets

    a = sets.levels_long(spark.range(0, 500, 2).withColumn("t", F.lit("x")), "id", {"text": F.col("t")})
    b = sets.levels_long(spark.range(1, 301, 2).withColumn("t", F.lit("x")).union(spark.range(901, 902).withColumn("t", F.lit("alone"))), "id", {"text": F.col("t")})
    got = sets.overlap_audit(a, b).collect()
    want = {"a": sorted(map(str, range(0, 500, 2))), "b": sorted(map(str, range(1, 301, 2)))}
    assert {s: sorted(r.id for r in got if r.side == s) for s in "ab"} == want and len(got) == 400
    assert {(r.level, r.value, r.n_a, r.n_b) for r in got} == {("text", "x", 250, 150)} and len(sets.overlap_audit(a, b.union(b)).collect()) == 400
