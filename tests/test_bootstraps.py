"""Bootstraps with all replicates at once, and method comparisons, against NumPy loops."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.operators import methods as ME
from glossa.operators import resampling as RS


def drawn(seed, b, code, n):
    return [int(hashlib.md5(f"{seed}-{b}-{code}-{k}".encode()).hexdigest()[:8], 16) % n for k in range(n)]


def ranks(x):
    x = np.asarray(x)
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def cosine(x, y):
    return max(0.0, 1 - x @ y / (np.linalg.norm(x) * np.linalg.norm(y)))


@pytest.fixture(scope="module")
def sentences(spark):
    r = np.random.default_rng(3)
    rows = [(f"c{k}", i, r.normal(size=6).tolist()) for k in range(5) for i in range(3 + k)]
    return rows, spark.createDataFrame(rows, "code string, id long, vec array<double>").repartition(3)


def test_dense_replicates(sentences, monkeypatch):
    rows, df = sentences
    monkeypatch.setattr(RS, "BLOCK", 7)
    got = {(r["it"], r["a"], r["b"]): r["d"] for r in RS.dense_replicates(RS.numbered(df, "code", ["id"]), "code", 30, "s").collect()}
    of = {c: np.array([v for k, _, v in rows if k == c]) for c in {r[0] for r in rows}}
    want = {}
    for it in range(30):
        mean = {c: of[c][drawn("s", it, c, len(of[c]))].mean(0) for c in of}
        want |= {(it, a, b): cosine(mean[a], mean[b]) for a in of for b in of if a < b}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("held", [48 << 20, 10])
def test_sparse_replicates(spark, held, monkeypatch):
    monkeypatch.setattr(RS, "HELD_BYTES", held)
    r = random.Random(2)
    texts = [(f"c{k}", 10 * k + i) for k in range(4) for i in range(4)]
    weights = [(i, f"t{t}", r.random()) for c, i in texts for t in r.sample(range(9) if c != "c3" else range(20, 24), 3)]
    rows = RS.numbered(spark.createDataFrame(texts, "code string, id long"), "code", ["id"])
    got = {(x["it"], x["a"], x["b"]): x["d"] for x in RS.sparse_replicates(rows, spark.createDataFrame(weights, "id long, term string, w double"), "code", 12, "q").collect()}
    vec = {i: np.zeros(24) for _, i in texts}
    for i, t, w in weights:
        vec[i][int(t[1:])] = w
    codes = sorted({c for c, _ in texts})
    for it in range(12):
        mean = {c: np.mean([vec[[i for k, i in texts if k == c][j]] for j in drawn("q", it, c, 4)], 0) for c in codes}
        for a in codes:
            for b in codes:
                if a < b:
                    assert abs(got.pop((it, a, b)) - cosine(mean[a], mean[b])) < 1e-9
    assert not got


def test_against_gold(sentences, spark):
    _, df = sentences
    gold = [("g", f"c{a}", f"c{b}", float((7 * a + 3 * b) % 5)) for a in range(5) for b in range(a + 1, 5)] + [("tiny", "c0", "c1", 1.0), ("flat", "c0", "c9", 1.0)]
    golds = spark.createDataFrame(gold, "gold string, a string, b string, g double")
    role = lambda c: F.when(c < "c2", "dialect").when(c == "c2", "italian").otherwise("external")
    rows = {(r["gold"], r["block"]): r for r in RS.dense_bootstrap(df, "code", ["id"], golds, role, 6, 40, "s").collect()}
    reps = RS.dense_replicates(RS.numbered(df, "code", ["id"]), "code", 40, "s").toPandas()
    g = {(a, b): x for name, a, b, x in gold if name == "g"}
    for block, keep in (("full", lambda a, b: True), ("dialect_external", lambda a, b: a < "c2" and b > "c2")):
        rho = []
        for _, one in reps.groupby("it"):
            p = [(d, g[a, b]) for a, b, d in zip(one.a, one.b, one.d, strict=True) if keep(a, b)]
            rho.append(np.corrcoef(ranks([x for x, _ in p]), ranks([y for _, y in p]))[0, 1])
        r = rows["g", block]
        assert r["n_boot"] == 40 and np.allclose([r["rho_mean"], r["rho_lo"], r["rho_hi"]], [np.mean(rho), np.quantile(rho, 0.025), np.quantile(rho, 0.975)])
    assert all(rows[name, b]["n_boot"] == 0 and rows[name, b]["rho_mean"] is None for name in ("tiny", "flat") for b in ("full", "dialect_external"))


def test_method_driver_trains_nothing(spark, sentences, tmp_path):
    _, df = sentences
    golds = spark.createDataFrame([("g", f"c{a}", f"c{b}", float(a * b)) for a in range(5) for b in range(a + 1, 5)], "gold string, a string, b string, g double")
    role = lambda c: F.lit("dialect")
    run = lambda: RS.run_method(spark, f"{tmp_path}/model", f"{tmp_path}/out", lambda m: m, golds, role, 6, 10)
    with pytest.raises(FileNotFoundError):
        run()
    df.write.parquet(f"{tmp_path}/model")
    first = sorted(map(str, run().collect()))
    df.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/model")  # a finished result is not made again
    assert sorted(map(str, run().collect())) == first and len(first) == 2


@pytest.fixture(scope="module")
def spaces(spark):
    r = np.random.default_rng(5)
    base = r.normal(size=(9, 4))
    of = {"m1": base, "m2": base @ np.linalg.qr(r.normal(size=(4, 4)))[0] * 3, "m3": r.normal(size=(9, 4)), "m4": r.normal(size=(7, 3)), "m5": r.normal(size=(1, 4))}
    rows = [(m, f"v{i}", v.tolist()) for m, x in of.items() for i, v in enumerate(x)]
    return of, spark.createDataFrame(rows, "method string, code string, vec array<double>").repartition(4)


def test_spaces(spaces):
    of, df = spaces
    got = {(r["method_a"], r["method_b"]): r for r in ME.space_table(df).collect()}
    assert len(got) == 10
    for (m, k), r in got.items():
        n = min(len(of[m]), len(of[k]))
        a, b = of[m][:n], of[k][:n]
        assert r["n_varieties"] == n
        if n < 2:
            assert r["procrustes"] is None and r["cka"] is None
            continue
        ca, cb = a - a.mean(0), b - b.mean(0)
        assert abs(r["cka"] - np.linalg.norm(ca.T @ cb) ** 2 / (np.linalg.norm(ca.T @ ca) * np.linalg.norm(cb.T @ cb))) < 1e-9
        if a.shape != b.shape:
            assert r["procrustes"] is None
            continue
        ua, ub = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
        u, _, v = np.linalg.svd(ua.T @ ub)
        assert abs(r["procrustes"] - np.linalg.norm(ua @ (u @ v) - ub) / np.linalg.norm(ub)) < 1e-7
    assert got["m1", "m2"]["procrustes"] < 1e-6 and abs(got["m1", "m2"]["cka"] - 1) < 1e-9


def test_mantel_and_ranks(spark):
    r = np.random.default_rng(1)
    mats = {}
    for m, n in (("m1", 6), ("m2", 6), ("m3", 4), ("m4", 2)):
        d = np.abs(r.normal(size=(n, n)))
        mats[m] = np.triu(d, 1) + np.triu(d, 1).T
    rows = [(m, f"v{i}", f"v{j}", float(d[i, j])) for m, d in mats.items() for i in range(len(d)) for j in range(len(d))]
    df = spark.createDataFrame(rows, "method string, a string, b string, d double")
    tables = ME.compare_methods(df, permutations=99)
    rho = {(x["method_a"], x["method_b"]): x["rho"] for x in tables["correlations"].collect()}
    mantel = {(x["method_a"], x["method_b"]): x for x in tables["mantel"].collect()}
    assert len(rho) == 16 and rho["m1", "m4"] is None and set(mantel) == {("m1", "m2"), ("m1", "m3"), ("m2", "m3")}
    for (m, k), x in mantel.items():
        n = min(len(mats[m]), len(mats[k]))
        i, j = np.triu_indices(n, 1)
        a, b = mats[m][:n, :n], mats[k][:n, :n]
        assert abs(rho[m, k] - np.corrcoef(ranks(a[i, j]), ranks(b[i, j]))[0, 1]) < 1e-9 and rho[m, k] == rho[k, m]
        seen, more = np.corrcoef(a[i, j], b[i, j])[0, 1], 0
        for it in range(99):
            order = sorted(range(n), key=lambda c: (hashlib.md5(f"42-{m}/{k}-{it}-v{c}".encode()).hexdigest(), c))
            to = {c: p for p, c in enumerate(order)}
            moved = [b[to[p], to[q]] for p, q in zip(i.tolist(), j.tolist(), strict=True)]
            more += np.corrcoef(a[i, j], moved)[0, 1] >= seen - 1e-12
        assert abs(x["mantel_r"] - seen) < 1e-9 and abs(x["p_value"] - (more + 1) / 100) < 1e-12 and x["significant_005"] == (x["p_value"] < 0.05)
    lines = ME.report(tables)
    assert lines[0] == "Cross-method comparison" and any(x.startswith("m1 | m2") for x in lines)
    with pytest.raises(ValueError):
        ME.compare_methods(df.where("method = 'm1'"))


def test_sparse_bootstrap_sends_no_sums_of_terms(spark, monkeypatch):
    monkeypatch.setattr(RS, "PIECE", 5)
    monkeypatch.setattr(RS, "SLICE", 8)
    r = random.Random(4)
    texts = [(k, 100 * k + i) for k in range(3) for i in range(7)] + [(None, 999)]
    weights = [(i, f"t{t}", r.random()) for _, i in texts for t in [0, *r.sample(range(1, 60), 9)]]
    rows = RS.numbered(spark.createDataFrame(texts, "code int, id long"), "code", ["id"])
    df = RS.sparse_replicates(rows, spark.createDataFrame(weights, "id long, term string, w double"), "code", 9, "q", observed=True)
    got = {(x["it"], x["a"], x["b"]): x["d"] for x in df.collect()}
    assert not hasattr(RS, "multiplicities") and df.count() == 30  # multiplicities were a list for each row, sums a column of 8 bytes a replicate
    vec = {i: np.zeros(60) for _, i in texts}
    for i, t, w in weights:
        vec[i][int(t[1:])] = w
    for it in range(-1, 9):
        mean = {c: sum(vec[100 * c + j] for j in (range(7) if it < 0 else drawn("q", it, c, 7))) for c in range(3)}
        for a in range(3):
            for b in range(a + 1, 3):
                assert abs(got.pop((it, a, b)) - cosine(mean[a], mean[b])) < 1e-9
    assert not got
