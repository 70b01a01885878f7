import numpy as np
from pyspark.sql import functions as F

from glossa.llm import toxicity as T

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    train, rest = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0")
    scored = T.score_documents(docs, T.fit_documents(docs, train)).join(rest.select("doc_id", F.col("toxic").alias("label")), "doc_id").toPandas()
    bad = scored.label == 1
    assert scored.toxic[bad].mean() >= 0.85 and scored.toxic[~bad].mean() <= 0.01
    assert scored.expected_severity[bad].mean() > 1 > 0.1 > scored.expected_severity[~bad].mean()


def test_severity_grades_follow_the_markers():
    texts = [[b"x", b"bad"]] * 6 + [[b"x", b"bad", b"worse", b"worst"]] * 6 + [[b"x"]] * 20
    assert T.severity(texts, np.array([1] * 12 + [0] * 20)).tolist() == [1] * 6 + [2] * 6 + [0] * 20
    assert T.severity([], np.zeros(0)).tolist() == []


def test_thresholds_are_ordered_and_severity_grows():
    rng = np.random.default_rng(0)
    g = rng.integers(0, 3, 600)
    texts = [[b"base"] + [b"bad"] * int(x > 0) + [b"worse"] * int(x > 1) + [b"w%d" % rng.integers(50)] for x in g]
    m = T.fit(texts, g)
    assert m.thresholds[0] < m.thresholds[1] and m.weights[b"bad"] > 0 and m.weights[b"worse"] > 0
    e = [sum(m.grades(t)) for t in (b"base", b"base bad", b"base bad worse")]
    assert e[0] < 0.3 < e[1] < e[2]


def test_edges(spark, table):
    labels = spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 0, 1)], "doc_id long, quality int, toxic int")
    docs = table([None, "", "x" * 100_000, "A b"])
    m = T.fit_documents(docs, labels)
    out = T.score_documents(docs, m).collect()
    assert len(out) == 4 and all(0 <= r["p_severe"] <= r["p_toxic"] <= 1 for r in out)
    none = T.fit_documents(docs, labels.where("false"))
    assert T.accept(docs, none).count() == 4 and T.accept(docs, none).columns == docs.columns
    assert T.score_documents(table([]), none).count() == 0


def objective(x, grades, w, first, gap, l1, l2):
    """The penalised mean log-likelihood, term by term."""
    out = l1 * sum(map(abs, w)) + l2 / 2 * sum(v * v for v in w)
    for row, g in zip(x, grades, strict=True):
        z = sum(v for v, there in zip(w, row, strict=True) if there)
        at_least = [1.0, *(1 / (1 + np.exp(t - z)) for t in (first, first + gap)), 0.0]
        out -= np.log(at_least[g] - at_least[g + 1]) / len(x)
    return out


def plain_optimum(x, grades, l1, l2):
    """Pattern search, one coordinate after another, until no step helps."""
    at, step = np.array([0.0] * len(x[0]) + [0.0, 1.0]), 1.0
    best = objective(x, grades, at[:-2], at[-2], at[-1], l1, l2)
    while step > 1e-4:
        moved = False
        for i in range(len(at)):
            for sign in (1, -1):
                new = at.copy()
                new[i] += sign * step
                if new[-1] >= 0.01 and (value := objective(x, grades, new[:-2], new[-2], new[-1], l1, l2)) < best - 1e-12:
                    at, best, moved = new, value, True
        step = step if moved else step / 2
    return at, best


def test_fit_is_the_optimum_of_its_likelihood():
    rng = np.random.default_rng(3)
    grades = rng.choice(3, 120, p=[0.5, 0.3, 0.2])
    x = [[bool(rng.random() < p) for p in (0.2 + 0.3 * g, 0.9 - 0.3 * g, 0.5)] for g in grades]
    names = [b"up", b"down", b"noise"]
    l1, l2 = 5e-3, 1e-2
    m = T.fit([[w for w, there in zip(names, row, strict=True) if there] for row in x], grades, min_g=0.0, l1=l1, l2=l2, steps=4000)
    found = [m.weights.get(w, 0.0) for w in names]
    at, best = plain_optimum(x, grades, l1, l2)
    assert abs(objective(x, grades, found, m.thresholds[0], m.thresholds[1] - m.thresholds[0], l1, l2) - best) < 1e-5
    assert np.allclose([*found, m.thresholds[0], m.thresholds[1] - m.thresholds[0]], at, atol=0.02)


def test_repeated_ids_are_fitted_alike(spark):
    texts = [(i % 40, ("nice day " if i % 2 else "foul mouth ") + f"w{i % 7}") for i in range(120)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 2 == 0)) for i in range(40)], "doc_id long, quality int, toxic int")
    models = [T.fit_documents(docs.orderBy(F.rand(k)).repartition(3 + k), labels) for k in range(3)]
    assert models[0].weights and models[0] == models[1] == models[2]
