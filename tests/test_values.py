"""Queries without SQL against plain Python on the smallest tables, and what the newer operators reject."""

import gzip
import hashlib
import io
import json
import math
import os
import tarfile
import zipfile

import numpy as np
import pandas as pd
import pytest
from polyrank.catalog import QUERIES
from polyrank.functions import columns
from polyrank.operators import contracts, geometry, kernels, ranges, stats
from polyrank.plans import models, runs
from polyrank.sources import readers, writers
from pyspark.sql import functions as F

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def events():
    e = pd.read_parquet(f"{SF}/events.parquet").sort_values(["user_id", "ts", "event_id"])
    truth = e["props"].map(lambda p: json.loads(p).get("k")).astype(float) / 100
    return pd.DataFrame({"g": e["user_id"], "id": e["event_id"], "score": e["value"], "score2": (e["event_id"] * 37 % 101).astype(float), "weight": (e["event_id"] % 5 + 1).astype(float), "fold": e["user_id"] % 5, "truth": truth, "y": truth >= 0.23, "rank": e.groupby("user_id").cumcount() + 1}).reset_index(drop=True)


def newton(x, y, penalty=1.0):
    x = np.column_stack((np.ones(len(x)), x))
    beta, ridge = np.zeros(x.shape[1]), penalty * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        beta += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ beta)
    return beta


def plain_oof(d, features, y, fold):
    out = np.empty(len(d))
    for f in sorted(set(fold)):
        rest, own = (fold != f).to_numpy(), (fold == f).to_numpy()
        x = d[features].fillna(d[features][rest].median())
        mean, sd = x[rest].mean(), x[rest].std(ddof=0)
        x = ((x - mean) / sd.where(sd > 0, 1)).to_numpy(float)
        beta = newton(x[rest], y.to_numpy(float)[rest])
        out[own] = 1 / (1 + np.exp(-(beta[0] + x[own] @ beta[1:])))
    return out


def plain_auc(y, s):
    pos, neg = s[y], s[~y]
    return ((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / (len(pos) * len(neg))


def plain_ap(y, s):
    tp = n = ap = 0
    for v in sorted(set(s), reverse=True):
        block = y[s == v]
        tp, n = tp + block.sum(), n + len(block)
        ap += block.sum() / y.sum() * tp / n
    return ap


FEATURES = ["score", "score2", "weight"]


@tables
def test_out_of_fold_predictions(spark, events):
    got = {r.id: r.probability for r in QUERIES["oof_predictions"](spark, SF).collect()}
    want = dict(zip(events["id"], plain_oof(events, FEATURES, events["y"], events["fold"]), strict=True))
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-4 for i in want)


@tables
def test_ridge_least_squares(spark, events):
    got = {r.term: r.weight for r in QUERIES["ridge_ls"](spark, SF).collect()}
    x = events[FEATURES]
    x = ((x - x.mean()) / x.std(ddof=0)).to_numpy(float)
    want = np.linalg.solve(x.T @ x + np.eye(3), x.T @ events["truth"].to_numpy())
    assert [got[f] for f in FEATURES] == pytest.approx(want.tolist(), abs=1e-6)


@tables
def test_system_risk(spark, events):
    r = QUERIES["system_risk"](spark, SF).first()
    one = events[events["rank"] == 1].set_index("g")
    by = events.groupby("g")["truth"]
    s = pd.DataFrame({"rank1_score": one["score"], "n": by.size().astype(float), "truth_range": by.max() - by.min(), "y": one["y"]})
    p, y = plain_oof(s, ["rank1_score", "n", "truth_range"], s["y"], pd.Series(s.index % 5, index=s.index)), s["y"].to_numpy()
    assert (r["rows"], r.positives) == (len(s), y.sum())
    assert r.auc == pytest.approx(plain_auc(y, p), abs=1e-3) and r.ap == pytest.approx(plain_ap(y, p), abs=1e-3) and r.brier == pytest.approx(((y - p) ** 2).mean(), abs=1e-4)


@tables
def test_ablation(spark, events):
    got = {r.features: r for r in QUERIES["ablation"](spark, SF).collect()}
    for name, features in {"one": ["score"], "two": ["score", "score2"]}.items():
        p, y = plain_oof(events, features, events["y"], events["fold"]), events["y"].to_numpy()
        top = events.assign(p=p).sort_values(["g", "p", "id"], ascending=[True, False, True]).groupby("g").head(1)
        r = got[name]
        assert r.auc == pytest.approx(plain_auc(y, p), abs=1e-4) and r.ap == pytest.approx(plain_ap(y, p), abs=1e-4) and r.brier == pytest.approx(((y - p) ** 2).mean(), abs=1e-4)
        assert r.rate_acceptable == pytest.approx((top["truth"] >= 0.23).mean()) and r.mean_truth == pytest.approx(top["truth"].mean(), abs=1e-5)


@tables
def test_network_out_of_fold(spark, events):
    got = {r.id: r.probability for r in QUERIES["mlp_oof"](spark, SF).collect()}
    d = events.sort_values("id")
    for f in range(5):
        rest = (d["fold"] != f).to_numpy()
        x = d[FEATURES].to_numpy(float)
        x = (x - x[rest].mean(0)) / x[rest].std(0)
        want = models.mlp(x[rest], d["y"].to_numpy(float)[rest], epochs=80)(x[~rest])
        assert [got[i] for i in d["id"][~rest]] == pytest.approx(want.tolist(), abs=1e-4)


def test_network_takes_any_number_of_rows(spark):
    n = 200_010
    d = spark.range(n).selectExpr("id", "cast(id % 3 as int) as fold", "id % 7 < 3 as y", "case when id % 11 = 0 then null else cast(id % 7 as double) end as a", "cast(id % 5 as double) as b")
    got = models.mlp_out_of_fold(d, ["a", "b"], "y", "fold", "id", epochs=1).selectExpr("count(*) as n", "count(distinct id) as ids", "sum(id) as total", "count_if(fold = id % 3) as right", "count_if((probability > 0.5) = (id % 7 < 3)) as learned").first()
    assert (got.n, got.ids, got.total, got.right) == (n, n, n * (n - 1) // 2, n) and got.learned > 0.9 * n


def test_network_learns_what_is_not_linear():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (1500, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    score = models.mlp(x[:1000], y[:1000])
    assert plain_auc(y[1000:] > 0, score(x[1000:])) > 0.95


@tables
def test_files(spark):
    names = sorted(n for n in os.listdir(SF) if n.endswith(".parquet"))
    sizes = {n: os.path.getsize(f"{SF}/{n}") for n in names}
    assert {r.name: r.bytes for r in QUERIES["discover_files"](spark, SF).collect()} == sizes
    got = {r.name: (r.bytes, r.sha256) for r in QUERIES["artifact_manifest"](spark, SF).collect()}
    assert got == {n: (sizes[n], hashlib.sha256(open(f"{SF}/{n}", "rb").read()).hexdigest()) for n in names}
    got = {r.name: (r.missing, r.empty) for r in QUERIES["verify_files"](spark, SF).collect()}
    assert got == {"region.parquet": (False, False), "nation.parquet": (False, False), "absent.parquet": (True, False)}


def test_discovery_rejects(spark, tmp_path):
    for n in ("a/x.pdb", "a/x.json", "a/b/y.pdb"):
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text("{}")
    find = lambda *a, **k: sorted(r.name for r in readers.discover(spark, *a, **k).collect())
    assert find(str(tmp_path), "*.pdb") == ["x.pdb", "y.pdb"] and find(str(tmp_path), "*.pdb", most=1) == ["y.pdb"]
    with pytest.raises(contracts.ContractError, match="sidecars are missing.*y.json"):
        find(str(tmp_path), "*.pdb", sidecar=(".pdb", ".json"))
    (tmp_path / "a/b/y.json").write_text("[1]")
    assert len(find(str(tmp_path), "*.pdb", sidecar=(".pdb", ".json"))) == 2
    with pytest.raises(contracts.ContractError, match="duplicate"):
        find([f"{tmp_path}/a", f"{tmp_path}/a/b"], "*.pdb")
    with pytest.raises(contracts.ContractError, match="fewer than"):
        find(str(tmp_path), "*.cif")
    with pytest.raises(contracts.ContractError, match="json_root"):
        readers.read_json_documents(spark, f"{tmp_path}/a/b/y.json")
    assert readers.read_json_documents(spark, f"{tmp_path}/a/x.json").first().text == "{}"


def test_structure_problems(spark):
    atom = "ATOM  {:>5} {:<4} {:>3} {}{:>4}    {:>8}{:>8}{:>8}  1.00  0.00          {:>2}"
    lines = {
        "good": [atom.format(1, " CA", "ALA", "A", 1, "1.0", "2.0", "3.0", "C"), atom.format(2, " CA", "GLY", "B", 1, "1.0", "2.0", "3.0", "C")],
        "bad": ["MODEL        1", "MODEL        2", atom.format(1, " CA", "ALA", "A", 1, "nan", "2.0", "3.0", "C"), atom.format(2, " H", "ALA", "A", 2, "1.0", "2.0", "3.0", "H")],
    }
    d = spark.createDataFrame([(s, i, x) for s, xs in lines.items() for i, x in enumerate(xs)], "structure string, n int, value string")
    got = {(r.structure, r.problem): r.n for r in readers.pdb_problems(d).collect()}
    assert got == {("bad", "several_models"): 2, ("bad", "coordinates"): 1, ("bad", "residues_without_heavy_atoms"): 1, ("bad", "chains"): 1}


def test_archive_members(spark, tmp_path):
    text = ">101\nACD\n\0"
    with zipfile.ZipFile(tmp_path / "one.zip", "w") as z:
        z.writestr("in/x.a3m", text)
        z.writestr("in/y.a3m", "no")
    with tarfile.open(tmp_path / "two.tar.gz", "w:gz") as t:
        for n in ("a/x.a3m", "b/x.a3m"):
            i = tarfile.TarInfo(n)
            i.size = len(text)
            t.addfile(i, io.BytesIO(text.encode()))
    (tmp_path / "three.tar").write_bytes(b"nonsense")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: r for r in readers.archive_member(files, "x.a3m").collect()}
    assert got["one.zip"].text == text and got["one.zip"].status == "ok"
    assert got["two.tar.gz"].status == "failed" and "2 members" in got["two.tar.gz"].error and got["three.tar"].status == "failed"
    assert {r.status for r in readers.archive_member(files, "x.a3m", 3).collect()} == {"failed"}
    assert readers.alignment_blocks(spark.createDataFrame([(text,)], "t string"), "t").first().block == 101


def test_gzip_csv_is_read(spark, tmp_path):
    with gzip.open(tmp_path / "x.csv.gz", "wt") as f:
        f.write("i,s\n1,a\n2,b\n")
    assert sorted(map(tuple, readers.read_table(spark, str(tmp_path / "x.csv.gz"), ["i"], ["i"], "i int, s string").collect())) == [(1, "a"), (2, "b")]
    with pytest.raises(contracts.ContractError):
        readers.read_table(spark, str(tmp_path / "x.csv.gz"), ["z"], schema="i int, s string")


def test_kernels_keep_going(spark):
    d = spark.createDataFrame([(1, 1, [0.0] * 9, [1.0] * 6), (1, 2, [0.0] * 9, [2.0] * 6), (1, 3, [0.0] * 8, [1.0] * 6), (2, 4, [0.0, 1.0, 2.0] * 3, [1.0] * 6), (2, 5, [0.0, 1.0, 2.0] * 3, [1.0] * 6)], "g int, id int, a array<double>, b array<double>")
    got = {(r.id_1, r.id_2): r.status for r in kernels.pose_rmsd(d.withColumnRenamed("id", "id"), "g", "id", "a", "b").withColumnsRenamed({"key_1": "id_1", "key_2": "id_2"}).collect()}
    assert got == {(1, 2): "ok", (1, 3): "failed", (2, 3): "failed", (4, 5): "ok"}
    atoms = spark.createDataFrame([(1, "A", 0.0, 0.0, 0.0), (1, "B", 9.0, 0.0, 0.0), (2, "A", float("nan"), 0.0, 0.0)], "g int, side string, x double, y double, z double")
    areas = {r.g: r for r in kernels.surface_areas(atoms, "g").collect()}
    assert areas[1].status == "ok" and areas[1].area_both == pytest.approx(2 * areas[1].area_a) and areas[2].status == "failed" and areas[2].area_a is None and "finite" in areas[2].error
    s = spark.createDataFrame([("p", 1, 0.0), ("p", 2, 9.0), ("p", 3, 1.0), ("q", 4, float("nan"))], "s string, id long, v double")
    picks = sorted((r.s, r.pick, r.status) for r in kernels.maximin_sample(s, "s", "id", ["v"], 2).collect() if r.s == "p")
    assert picks == [("p", 1, "ok"), ("p", 2, "ok")] and [r.status for r in kernels.maximin_sample(s, "s", "id", ["v"], 2).where("s = 'q'").collect()] == ["failed"]
    assert [r.status for r in kernels.assign_folds(s.union(s), "id", "s").collect()] == ["failed"]


def test_interface_topology(spark):
    edges = [(1, 1, 1), (1, 2, 1), (1, 3, 2), (2, 7, 7)]
    got = {r.g: r for r in kernels.interface_topology(spark.createDataFrame(edges, "g int, ra int, rb int"), "g", spark.createDataFrame([(1, 50.0)], "g long, area double")).collect()}
    assert (got[1].residues_a, got[1].residues_b, got[1].components, got[1].largest_fraction, got[1].asymmetry, got[1].area_per_residue) == (3, 2, 2, 0.6, 0.2, 10.0)
    assert got[2].components == 1 and got[2].area_per_residue is None and got[2].status == "ok"


def test_topology_without_a_list_of_contacts(spark, monkeypatch):
    rng = np.random.default_rng(3)
    for k in range(60):
        n, m, spread = *rng.integers(1, 50, 2), rng.choice([0.05, 0.15, 0.8])
        xa, xb = rng.normal(0, spread, (n, 3)), rng.normal(0, spread, (m, 3))
        if k % 3 == 0:  # distances of just the cutoff
            xa, xb = np.round(xa / 0.15) * 0.15, np.round(xb / 0.15) * 0.15
        if k % 5 == 0:
            xa[0] = np.nan
        ra, rb = rng.integers(0, n, n), rng.integers(0, m, m)
        monkeypatch.setattr(kernels, "MEASURED", int(rng.choice([1, 40, 1 << 20])))
        monkeypatch.setattr(kernels, "CLUMP", int(rng.choice([1, 3, 1000])))
        touched, label = kernels.touching(xa, ra, n, xb, rb, m, 0.15)
        d = xa[:, None] - xb
        i, j = np.nonzero(d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2] < 0.15 * 0.15)
        assert set(np.flatnonzero(touched)) == set(ra[i]) | set(rb[j] + n)
        assert sorted(np.unique(label[touched], return_counts=True)[1], reverse=True) == kernels.component_sizes([(("A", a), ("B", b)) for a, b in zip(ra[i], rb[j], strict=True)])
    monkeypatch.undo()
    # 10 billion contacts in one ball, and one apart
    n = 100_000
    xa, xb = np.append(rng.normal(0, 0.02, (n, 3)), [[9.0, 9, 9]], 0), np.append(rng.normal(0, 0.02, (n, 3)), [[9.0, 9, 9.1]], 0)
    touched, label = kernels.touching(xa, np.arange(n + 1), n + 1, xb, np.arange(n + 1), n + 1, 0.15)
    assert touched.all() and sorted(np.unique(label, return_counts=True)[1]) == [2, 2 * n]
    rows = [(g, s, i, i // 2, *map(float, x)) for g in (1, 2) for s in "AB" for i, x in enumerate(rng.normal(0, g / 5, (40, 3)))] + [(3, "A", 0, 0, 0.0, 0.0, 0.0), (3, "B", 0, 0, 0.15, 0.0, 0.0), (4, "A", 0, 0, 0.0, 0.0, 0.0)]
    atoms = spark.createDataFrame(rows, "g int, side string, atom int, res int, x double, y double, z double")
    area = spark.createDataFrame([(1, 50.0)], "g long, area double")
    got, want = (sorted(map(tuple, d.collect())) for d in (kernels.interface_topology_of_atoms(atoms, "g", 0.15, area), kernels.interface_topology(geometry.contacts(atoms, 0.15), "g", area)))
    assert got == want and [r[0] for r in got] == [1, 2] and got[1][3] > 1


def test_maximin_and_folds_equal_their_definitions(spark):
    rng = np.random.default_rng(1)
    x, ids = rng.normal(size=(25, 2)), list(range(25))
    got = kernels.spread_out(x, ids, 8, "s")
    chosen = [min(ids, key=lambda i: ((x[i] - np.median(x, 0)) ** 2).sum())]
    while len(chosen) < 8:
        chosen.append(max((i for i in ids if i not in chosen), key=lambda i: min(((x[i] - x[c]) ** 2).sum() for c in chosen)))
    assert got == chosen
    rows = spark.createDataFrame([(i, "abc"[i % 7 % 3]) for i in range(60)], "id long, s string")
    folds = {r.id: r.fold for r in kernels.assign_folds(rows, "id", "s").collect()}
    assert folds == kernels.balanced_folds([(i, "abc"[i % 7 % 3]) for i in range(60)], 5, "s")
    for s in "abc":
        n = np.bincount([f for i, f in folds.items() if "abc"[i % 7 % 3] == s], minlength=5)
        assert n.max() - n.min() <= 1


def test_running_sums_over_ranges(spark):
    rng = np.random.default_rng(3)
    v = sorted(set(np.round(rng.normal(size=400), 2).tolist()))
    d = spark.createDataFrame([(k, x, int(10 * abs(x)) + k) for k in (1, 2) for x in v], "k int, x double, n long")
    got = {(r.k, r.x): r.before_n for r in ranges.running(d, "x", ["n"], ["k"], ranges.bounds(d, "x", 8)).collect()}
    for k in (1, 2):
        total = 0
        for x in v:
            assert got[k, x] == total
            total += int(10 * abs(x)) + k
    assert [r.i for r in ranges.numbered(d, "x").orderBy("x").collect()] == list(range(len(v)))
    empty = d.where("x > 100")
    assert ranges.running(empty, "x", ["n"]).count() == 0 and stats.spearman(empty, "x", "n").first().rho is None
    assert stats.roc_auc(empty.withColumn("y", F.lit(True)), "y", "x").first().positives == 0
    assert stats.precision_at_fraction(empty.withColumn("y", F.lit(True)), "y", "x", 0.5, ["k"]).first().selected == 0


def test_pooled_spearman_equals_average_ranks(spark):
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 30, 700).astype(float), rng.integers(0, 9, 700).astype(float)
    got = stats.spearman(spark.createDataFrame(list(zip(a.tolist(), b.tolist(), strict=True)), "a double, b double").repartition(5), "a", "b").first()
    assert got.n == 700 and got.rho == pytest.approx(pd.Series(a).rank().corr(pd.Series(b).rank()), abs=1e-12)


def test_precision_cut_goes_through_all_ties(spark):
    rows = [(1.0, 1, 1, True), (1.0, 1, 1, False), (1.0, 1, 1, False), (1.0, 1, 2, True), (1.0, 0, 5, True), (0.5, 0, 0, True)]
    d = spark.createDataFrame(rows, "s double, a int, b int, y boolean")
    for fraction, hits in ((1 / 6, 1), (2 / 6, 1), (3 / 6, 1), (4 / 6, 2), (5 / 6, 3), (1.0, 4)):
        r = stats.precision_at_fraction(d, "y", "s", fraction, ["a", "b"]).first()
        assert r.precision == pytest.approx(hits / r.selected), fraction


def test_number_text(spark):
    values = [0.0, 1.0, 0.1, 1 / 3, 1e-4, 9.99999e-5, 123456789.123456, 9999999999.0, 1e10, 12345678901.5, -2.5, 1e300, -1e-300, 100.0, 0.30000000000000004]
    d = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r.t for r in d.select(columns.number_text("v").alias("t")).collect()] == [f"{v:.10g}" for v in values]


def test_columns_and_cutoffs_reject(spark):
    d = spark.createDataFrame([(1, 2, 3)], "a int, truth int, z int")
    with pytest.raises(contracts.ContractError, match="truth"):
        contracts.without_columns(d, ["a"], "truth")
    assert contracts.without_columns(d, ["truth", "no"], "truth").columns == ["a", "z"] and contracts.preferred_first(d, ["z", "no"]).columns == ["z", "a", "truth"]
    contracts.checked_cutoffs(5.0, clash=2.0)
    for bad in ({"contact": 5.0, "clash": 6.0}, {"contact": 0.0}, {"contact": 5.0, "salt": float("nan")}):
        with pytest.raises(contracts.ContractError):
            contracts.checked_cutoffs(**bad)


def test_config_and_artifact_reject():
    good = {"features": ["a"], "folds": [0, 1], "group_size": 8}
    assert runs.Config.from_dict(good).folds == (0, 1)
    for bad in ({"nope": 1}, {"features": ["a", "a"]}, {"max_missing": 2}, {"threshold": -1}, {"folds": [1, 1]}, {"group_size": 0}, {"name": ""}, {"penalty": float("inf")}, {"replicates": 0}):
        with pytest.raises(ValueError):
            runs.Config.from_dict({**good, **bad})
    with pytest.raises(ValueError):
        runs.Config.from_dict({})
    d = models.Model("ridge_logistic", models.Preprocessing("zscore", ["a"], [0.0], [0.0], [1.0]), 0.0, [1.0], 3).to_dict()
    models.Model.from_dict(d)
    for bad in ({"weights": [1.0, 2.0]}, {"intercept": float("nan")}, {"preprocessing": {**d["preprocessing"], "scales": [0.0]}}):
        with pytest.raises(ValueError):
            models.Model.from_dict({**d, **bad})


def test_writers_replace_whole_files(spark, tmp_path):
    target = tmp_path / "x.json"
    writers.write_json(target, {"a": np.float64(1.5), "b": np.array([1, 2]), "c": [float("inf"), {"d": float("nan")}], "p": tmp_path / "q"})
    assert json.loads(target.read_text()) == {"a": 1.5, "b": [1, 2], "c": [None, {"d": None}], "p": str(tmp_path / "q")}
    with pytest.raises(RuntimeError), writers.replacing(target) as f:
        f.write(b"half")
        raise RuntimeError
    assert json.loads(target.read_text())["a"] == 1.5 and os.listdir(tmp_path) == ["x.json"]
    assert writers.portable(tmp_path / "a" / "b.txt", tmp_path) == "a/b.txt" and writers.portable("/etc/hosts", tmp_path) == "hosts"
    rows = spark.createDataFrame([(1, 2, [3.0, 4.0]), (1, 1, [1.0, 2.0])], "g int, slot int, vector array<double>")
    writers.write_matrices(rows, f"{tmp_path}/m", "g", "slot", "vector")
    assert spark.read.parquet(f"{tmp_path}/m").first().matrix == [[1.0, 2.0], [3.0, 4.0]]


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="checkpoint"):
        readers.table_checkpoint(Session())


@tables
def test_reproduction_run(spark, events):
    got = {(r.stage, r.metric): r.value for r in QUERIES["reproduce_run"](spark, SF).collect()}
    hold = events[events["g"] % 5 == 0]
    assert got["holdout", "rows"] == len(hold) and got["holdout", "positives"] == hold["y"].sum()
    rest = events[events["g"] % 5 != 0]
    x = rest[FEATURES]
    mean, sd = x.mean(), x.std(ddof=0)
    beta = newton(((x - mean) / sd).to_numpy(float), rest["y"].to_numpy(float))
    assert [got["model", n] for n in ("intercept", *FEATURES)] == pytest.approx(beta.tolist(), abs=1e-5)
    p = 1 / (1 + np.exp(-(beta[0] + ((hold[FEATURES] - mean) / sd).to_numpy(float) @ beta[1:])))
    assert got["holdout", "auc"] == pytest.approx(plain_auc(hold["y"].to_numpy(), p), abs=1e-5)
    assert got["holdout", "rate_low"] <= got["holdout", "delta_rate"] <= got["holdout", "rate_high"] or math.isclose(got["holdout", "rate_low"], got["holdout", "rate_high"])
