"""One evaluation, its readable files, and the readers and writers around it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.operators import evaluate as EV
from glossa.operators import matrices as M
from glossa.operators import relational as R
from glossa.operators import statistics as S
from glossa.sources import readers, reports, sinks

DIALECT = lambda c: F.when(c < "g3", "dialect").when(c == "g3", "italian").otherwise("external")


@pytest.fixture(scope="module")
def groups(spark):
    r = np.random.default_rng(4)
    centres = r.normal(size=(3, 5)) * 4
    vecs = {f"g{i}": centres[i % 3] + r.normal(size=5) * 0.3 for i in range(9)}
    df = spark.createDataFrame([(k, v.tolist()) for k, v in vecs.items()], "code string, vec array<double>")
    families = spark.createDataFrame([(k, f"f{int(k[1]) % 3}") for k in vecs], "code string, family string")
    u = {k: v / np.linalg.norm(v) for k, v in vecs.items()}
    return df, families, {(a, b): float(max(0.0, 1 - u[a] @ u[b])) if a != b else 0.0 for a in u for b in u}


def silhouette(d, family):
    out = []
    for a in family:
        mean = {f: np.mean([d[a, b] for b in family if b != a and family[b] == f]) for f in set(family.values()) if any(b != a and family[b] == f for b in family)}
        own, other = mean.get(family[a]), min(v for f, v in mean.items() if f != family[a])
        out.append(0.0 if own is None else (other - own) / max(own, other))
    return np.mean(out)


def test_evaluation(spark, groups):
    df, families, d = groups
    golds = spark.createDataFrame([("g", f"g{a}", f"g{b}", float((a * b) % 7)) for a in range(9) for b in range(a + 1, 9)], "gold string, a string, b string, g double")
    ev = EV.Evaluation(df, families, 5, {"f0", "f1"}, {"f1"}, golds, DIALECT)
    fam = {c: f"f{int(c[1]) % 3}" for c, _ in d}
    s = ev.scores()
    assert abs(s["family"] - silhouette(d, fam)) < 1e-9
    assert abs(s["romance vs rest"] - silhouette(d, {c: str(f != "f2") for c, f in fam.items()})) < 1e-9
    assert abs(s["romance, no dialects"] - silhouette(d, {c: str(f != "f2") for c, f in fam.items() if f != "f1"})) < 1e-9
    tables = ev.tables()
    assert set(tables) >= {"distances", "similarity", "nearest_neighbors", "linkage", "projection_mds", "clustering_metrics", "gold_correlations"}
    got = {(r["a"], r["b"]): r["d"] for r in tables["distances"].collect()}
    assert all(abs(got[k] - d[k]) < 1e-9 for k in d)
    agreement = {(r["clusterer"], r["metric"]): r["value"] for r in tables["clustering_metrics"].collect()}
    assert len(agreement) == 6 and all(abs(v - 1) < 1e-9 for v in agreement.values())  # the planted families are found by both
    up = [(d[a, b], float((int(a[1]) * int(b[1])) % 7)) for a in fam for b in fam if a < b]
    rank = lambda x: [sum(v < w for v in x) + (sum(v == w for v in x) + 1) / 2 for w in x]
    rho = {r["block"]: r["rho"] for r in tables["gold_correlations"].collect()}
    assert abs(rho["full"] - np.corrcoef(rank([x for x, _ in up]), rank([y for _, y in up]))[0, 1]) < 1e-9
    assert tables["linkage"].count() == 8 and tables["projection_mds"].count() == 9 and tables["nearest_neighbors"].count() == 27
    ev.close()
    assert EV.Evaluation(df, families.withColumn("family", F.col("code")), 5).silhouette(families.withColumn("family", F.col("code"))) is None
    with pytest.raises(ValueError):
        EV.Evaluation(df.union(df), families, 5)


def test_scaling_keeps_the_distances_of_points_in_a_plane(groups):
    r = np.random.default_rng(2)
    x = r.normal(size=(8, 2))
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    y = M.mds(d)
    assert np.abs(np.linalg.norm(y[:, None] - y[None], axis=2) - d).max() < 0.15


def test_written_reports(spark, groups, tmp_path):
    df, families, _ = groups
    ev = EV.Evaluation(df, families, 5, {"f0"}, {"f1"})
    path = reports.write_lines(spark, f"{tmp_path}/r/silhouette_report.txt", reports.silhouette_report("test", 9, ev.scores() | {"none": None}, ev.silhouettes()))
    lines = open(path, encoding="utf-8").read().splitlines()
    assert lines[0] == "Silhouette report (test)" and "  silhouette (none) = n/a" in lines
    each = [x.split() for x in lines[-9:]]
    assert [x[0][0] for x in each] == ["g"] * 9 and [float(x[2]) for x in each] == sorted((float(x[2]) for x in each), reverse=True)
    two = list(reports.two_sections(ev.clustering().orderBy("clusterer", "metric"), ev.silhouettes().orderBy("code")))
    assert two[0] == "# Global clustering metrics" and two[1] == "metric,value,clusterer" and two[two.index("") + 1] == "# Per-variety silhouette scores" and len(two) == 2 + 6 + 1 + 2 + 9
    pairs = spark.createDataFrame([("a", "b", 0.5), ("a", "c", 0.9), ("b", "c", 0.1)], "a string, b string, similarity double")
    each = spark.createDataFrame([("a", 0.7), ("b", 0.3), ("c", 0.5)], "code string, mean double")
    text = list(reports.alignment_report("m", pairs, each, 12, 2, 1))
    assert [x.split() for x in text if x.split()[:1] in (["a"], ["b"], ["c"]) and "similarity" not in x] == [["a", "c", "0.9000"], ["a", "b", "0.5000"], ["b", "c", "0.1000"], ["a", "0.7000"], ["c", "0.5000"], ["b", "0.3000"]]
    assert list(reports.csv_lines(spark.createDataFrame([('a,"b', None, 0.5)], "x string, y string, z double"))) == ["x,y,z", '"a,""b",,0.500000']
    readme = list(reports.gold_readme(["b.csv", "a.csv"], ["vec"], ["ita"], []))
    assert readme[0].startswith("# ") and readme[-2:] == ["* `a.csv`", "* `b.csv`"] and "* external: none" in readme
    ev.close()


def test_head_and_tail_of_few_rows(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 7), (4, 5)], "k int, v int")
    got = [tuple(r) for r in R.head_tail(df, [("v", True), ("k", False)], 2, 3).orderBy("part", "place").collect()]
    assert got == [("head", 1, 3, 7), ("head", 2, 2, 5), ("tail", 1, 2, 5), ("tail", 2, 4, 5), ("tail", 3, 1, None)]


def test_merged_tables(spark):
    a = spark.createDataFrame([("x", 2, "p"), ("y", 1, None)], "text string, id int, only_a string")
    b = spark.createDataFrame([(1, "z", "q")], "id int, text string, b.c string".replace("b.c", "`b.c`"))
    rows, lost = R.merged({"one": a, "two": b}, {"one": ["id"], "two": ["id"]})
    assert [tuple(r) for r in rows.orderBy("global_id").collect()] == [(1, "one_0", "one", "y", "1"), (2, "one_1", "one", "x", "2"), (3, "two_0", "two", "z", "1")]
    assert lost == {"one": ["only_a"], "two": ["b.c"]}
    rows, lost = R.merged({"one": a, "two": b}, {"one": ["id"], "two": ["id"]}, ["text", "only_a"])
    assert [tuple(r)[3:] for r in rows.orderBy("global_id").collect()] == [("y", ""), ("x", "p"), ("z", "")] and lost["one"] == ["id"]


def test_one_model_with_all_golds(spark, groups):
    _, _, d = groups
    model = spark.createDataFrame([(a, b, x) for (a, b), x in d.items()], "a string, b string, d double")

    def load(path):
        if path == "missing":
            raise FileNotFoundError("no such file")
        rows = [(a, b, x * 2) for (a, b), x in d.items() if a < b and (path != "part" or b < "g3")]
        return spark.createDataFrame(rows, "a string, b string, g double" if path != "bad" else "a string, b string, h double")

    got = {r["gold"]: r for r in S.correlate_all(model, {g: g for g in ("whole", "part", "missing", "bad")}, load, DIALECT).collect()}
    assert abs(got["whole"]["full"] - 1) < 1e-9 and abs(got["whole"]["dialect_external"] - 1) < 1e-9 and got["whole"]["n_shared"] == 9 and got["whole"]["error"] is None
    assert abs(got["part"]["full"] - 1) < 1e-9 and got["part"]["dialect_external"] is None and got["part"]["n_shared"] == 3
    assert got["missing"]["error"] == "no such file" and got["missing"]["n_shared"] == 0 and got["bad"]["full"] is None and got["bad"]["error"]


def test_variants_and_columns(spark, tmp_path):
    assert readers.variant_path("/c/", "wiki", "native", "vec") == "/c/wiki_native/vec/vec.csv"
    for bad in (("wikis", "native"), ("wiki", "raw")):
        with pytest.raises(ValueError, match="unknown"):
            readers.variant_path("/c", *bad)
    for code, text in (("vec", "ciao"), ("fur", "mandi")):
        (tmp_path / "wiki" / code).mkdir(parents=True)
        (tmp_path / "wiki" / code / f"{code}.csv").write_text(f"text,label,article_id\n{text},1,2\n,1,3\n", encoding="utf-8")
    got = sorted(tuple(r) for r in readers.monolingual_variant(spark, str(tmp_path), "wiki", "normalized", ["vec", "fur"]).collect())
    assert got == [("fur", "mandi", 1, 2), ("vec", "ciao", 1, 2)]
    assert [readers.delimiter(h) for h in ('id\ta,b,c', 'a;"b,c,d";e', "a,b", "one", "a\tb\tc,d", "")] == ["\t", ";", ",", ",", "\t", ","]
    p = tmp_path / "t.tsv"
    p.write_text("id\tvec.it\n1\ta, b\n2\t\n", encoding="utf-8")
    assert [r["text"] for r in readers.column(spark, str(p), "vec.it").collect()] == ["a, b", ""]
    with pytest.raises(ValueError, match=r"id, vec\.it"):
        readers.column(spark, str(p), "fur")
    spark.createDataFrame([(2, "b"), (1, "a")], "id int, text string").write.parquet(str(tmp_path / "ok"))
    assert [r["text"] for r in readers.texts_by_id(spark, str(tmp_path / "ok")).collect()] == ["a", "b"]
    spark.createDataFrame([(2, "b"), (2, "a")], "id int, text string").write.parquet(str(tmp_path / "twice"))
    spark.createDataFrame([(2,)], "id int").write.parquet(str(tmp_path / "bare"))
    for bad in ("twice", "bare"):
        with pytest.raises(ValueError):
            readers.texts_by_id(spark, str(tmp_path / bad))


def test_wide_tables(spark):
    rows = [(c, s, i, f"{c}{s[3:]}{i}") for c, n in (("vec", 3), ("ita", 2), ("abc", 4)) for s, k in (("dev", 0), ("devtest", 1)) for i in range(n - k)]
    wide = sinks.parallel_splits(spark.createDataFrame(rows, "code string, split string, pos int, text string"), ["ita", "eng"])
    assert wide.columns == ["sentence_id", "split", "ita", "abc", "vec"]
    assert [tuple(r) for r in wide.orderBy("sentence_id").collect()] == [(0, "dev", "ita0", "abc0", "vec0"), (1, "dev", "ita1", "abc1", "vec1"), (2, "devtest", "itatest0", "abctest0", "vectest0")]
    m = spark.createDataFrame([("x", "y", 0.5, 0.4, 0.6), ("x", "x", 0.0, 0.0, 0.0), ("y", "x", 0.5, 0.4, 0.6), ("y", "y", 0.0, 0.0, 0.0)], "a string, b string, d double, lo double, hi double")
    t = sinks.interval_tables(m, ["x", "y"])
    assert {r["code"]: r["y"] for r in t[""].collect()}["x"] == "0.500 [0.400,0.600]" and {r["code"]: r["y"] for r in t["_ci_hi"].collect()}["x"] == "0.600000" and set(t) == {"", "_ci_lo", "_ci_hi"}
    audit = sinks.audit_table(spark.createDataFrame([("I", "ita", "io", "yo"), ("I", "vec", "mi", "mi"), ("you", "ita", "tu", "tu")], "concept_en string, code string, orth string, asjp string"), ["ita", "vec"])
    assert audit.columns == ["concept_en", "ita_orth", "vec_orth", "ita_asjp", "vec_asjp"] and [tuple(r) for r in audit.orderBy("concept_en").collect()] == [("I", "io", "mi", "yo", "mi"), ("you", "tu", "", "tu", "")]
    res = spark.createDataFrame([("m1", 0.5), ("m2", 0.6)], "model_id string, rho double")
    p = spark.createDataFrame([("m1", 0.01)], "model_id string, p_full double")
    assert sorted(tuple(r) for r in sinks.with_p_values(res, p).collect()) == [("m1", 0.5, 0.01, None), ("m2", 0.6, None, None)]
    assert sinks.with_p_values(res, None).columns == ["model_id", "rho", "p_full", "p_dialect_external"]
