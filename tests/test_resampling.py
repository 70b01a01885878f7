"""Edit-distance intervals and pooled word vectors against plain loops."""

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from glossa.operators import embedding as EM
from glossa.operators import statistics as S
from glossa.operators.relational import draws


def test_distance_intervals_keep_shared_concepts_only(spark):
    rng = np.random.default_rng(3)
    shared = {("x", "y"): [1, 2, 4, 7], ("x", "z"): [3], ("y", "z"): [1, 2, 3, 4, 5, 6, 7, 8]}
    d = {(a, b, i, j): float(rng.integers(0, 9)) / 8 for (a, b), c in shared.items() for i in c for j in c}
    pairs = spark.createDataFrame([(*k, v) for k, v in d.items()], "a string, b string, i long, j long, d double")
    one = spark.createDataFrame([("w", 8)], "code string, n int")
    drawn = {}
    for r in draws(one, ["code"], "n", 20, "s").collect():
        drawn.setdefault(r["b"], []).extend([r["idx"] + 1] * r["mult"])
    assert all(len(x) == 8 for x in drawn.values())
    got = {(r["a"], r["b"]): r[2:] for r in S.distance_intervals(pairs, one, 20, "s").collect()}
    for (a, b), keep in shared.items():
        ld, ldnd = [], []
        for c in drawn.values():
            c = [i for i in c if i in keep]
            if not c:
                continue
            same = np.mean([d[a, b, i, i] for i in c])
            other = [d[a, b, i, j] for p, i in enumerate(c) for q, j in enumerate(c) if p != q]
            ld.append(same)
            ldnd.append(same / np.mean(other) if other and np.mean(other) > 1e-12 else same)
        assert np.allclose(got[a, b], [*np.quantile(ld, [0.025, 0.975]), *np.quantile(ldnd, [0.025, 0.975])])


def test_pooled_word_vectors(spark):
    texts = ["alpha beta gamma", "alpha alpha beta", None, "", "unseen", "Beta gamma delta delta"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    table = EM.word_model(docs, "t", 4, min_count=2).getVectors().select("word", vector_to_array("vector").alias("vec"))
    vecs = {r["word"]: np.array(r["vec"]) for r in table.collect()}
    assert set(vecs) == {"alpha", "beta", "gamma", "delta"}
    got = {r["id"]: r["vec"] for r in EM.pooled(docs, ["id"], "t", table, 4, zero_fill=True).collect()}
    for i, t in enumerate(texts):
        known = [vecs[w] for w in (t or "").lower().split() if w in vecs]
        assert np.allclose(got[i], np.mean(known, axis=0) if known else np.zeros(4))
    buckets = {r["word"]: r["s"] for r in table.select("word", EM.subwords(F.col("word"), (3, 4, 5, 6), 1 << 16).alias("s")).collect()}
    met = {}
    for w, s in buckets.items():
        for x in s:
            met.setdefault(x, []).append(vecs[w])
    got = {r["bucket"]: r["vec"] for r in EM.subword_table(table, 4).collect()}
    assert got.keys() == met.keys() and all(np.allclose(got[x], np.mean(v, axis=0)) for x, v in met.items())


def test_draws_travel_as_blocks_and_sums_meet(spark, monkeypatch):
    from glossa.operators import resampling as RS
    from glossa.operators.relational import draws

    monkeypatch.setattr(RS, "WIDTH", 4)
    rows = [(g, i, k, [float(i * 3 + len(k)), float(g)]) for g, n in ((1, 11), (2, 3)) for i in range(n) for k in ("x", "yy")]
    df = spark.createDataFrame(rows, "g int, idx long, k string, v array<double>")
    sizes = spark.createDataFrame([(1, 11), (2, 3), (3, 0)], "g int, n long")
    assert RS.drawn_blocks(sizes, ["g"], 20, "s").count() == 20 * (3 + 1)  # a row for four rows, not one for each
    parts = RS.resampled_sums(df, ["g"], ["k"], "v", sizes, 20, "s", observed=True).collect()
    got = {}
    for r in parts:
        key = r["g"], r["k"], r["b"]
        got[key] = [x + y for x, y in zip(got.get(key, [0.0, 0.0]), r["sums"], strict=True)]
    times = {(r["g"], r["b"], r["idx"]): r["mult"] for r in draws(sizes.where("n > 0"), ["g"], "n", 20, "s").collect()}
    want = {}
    for g, i, k, v in rows:
        for b in range(-1, 20):
            m = 1 if b < 0 else times.get((g, b, i), 0)
            want[g, k, b] = [x + m * y for x, y in zip(want.get((g, k, b), [0.0, 0.0]), v, strict=True)]
    assert got == want
