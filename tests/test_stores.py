"""Vector files, staged commits and table grids."""

import json

import numpy as np
import pytest

from glossa.sources import arrays as A
from glossa.sources import grids as G
from glossa.sources.staged import Store, promote_and_sample, save_corpus


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(A.ArrayFiles)
    return spark


def test_files_of_every_kind(source, tmp_path):
    m = np.array([[1.5, -2], [0, 1e-9]])
    np.savez(tmp_path / "good.npz", matrix=m, labels=np.array(["vec", "fur"]), meta=np.array(['{"b": 1, "a": "é"}']))
    np.savez(tmp_path / "bad_meta.npz", matrix=m, labels=np.array(["x", "y"]), meta=np.array(["{not json"]))
    np.savez(tmp_path / "pickled_meta.npz", matrix=m, labels=np.array(["p", "q"]), meta=np.array([{"a": 1}], object))
    (tmp_path / "v.csv").write_text("code,0,1\nlij,1,2\n\nsc,3,\n", encoding="utf-8")
    (tmp_path / "w.tsv").write_text("code\t0\n\"a,b\"\t7\n", encoding="utf-8")
    (tmp_path / "_hidden.csv").write_text("code,0\nz,1\n")
    (tmp_path / "notes.txt").write_text("no vectors")
    rows = {(r["file"], r["pos"]): r for r in source.read.format("arrays").load(str(tmp_path)).collect()}
    assert len(rows) == 9
    assert rows["good.npz", 0]["code"] == "vec" and rows["good.npz", 0]["vec"] == [1.5, -2.0] and json.loads(rows["good.npz", 1]["meta"]) == {"a": "é", "b": 1}
    assert rows["bad_meta.npz", 1]["meta"] is None and rows["pickled_meta.npz", 0]["meta"] is None and rows["pickled_meta.npz", 1]["vec"] == [0, 1e-9]
    assert rows["v.csv", 0]["vec"] == [1, 2] and np.isnan(rows["v.csv", 1]["vec"][1]) and rows["w.tsv", 0]["code"] == "a,b"
    assert A.variety_vectors(source, str(tmp_path / "v.csv")).count() == 2
    gold = {(r["a"], r["b"]): r["d"] for r in A.gold_matrices(source, str(tmp_path / "good.npz")).collect()}
    assert gold == {("vec", "vec"): 1.5, ("vec", "fur"): -2, ("fur", "vec"): 0, ("fur", "fur"): 1e-9}


def test_labels_that_need_pickle_are_refused(source, tmp_path):
    np.savez(tmp_path / "x.npz", matrix=np.eye(1), labels=np.array(["a"], object))
    with pytest.raises(Exception, match="allow_pickle|Object arrays"):
        source.read.format("arrays").load(str(tmp_path)).collect()
    assert source.read.format("arrays").option("pickle", "true").load(str(tmp_path)).first()["code"] == "a"


@pytest.mark.parametrize("kind", ["npz", "csv", "tsv"])
def test_round_trip(source, tmp_path, kind):
    out = str(tmp_path / "out")
    df = source.createDataFrame([(f"c{i}", [i / 3, -i / 7]) for i in range(20)], "code string, vec array<double>").repartition(3)
    save = lambda mode: df.write.format("arrays").option("kind", kind).option("meta", '{"k": 1}').mode(mode).save(out)
    save("append")
    back = source.read.format("arrays").load(out)
    assert sorted((r["code"], r["vec"]) for r in back.collect()) == sorted((r["code"], r["vec"]) for r in df.collect())
    assert {r["meta"] for r in back.collect()} == {'{"k": 1}' if kind == "npz" else None}
    save("append")
    assert source.read.format("arrays").load(out).count() == 40
    save("overwrite")
    assert source.read.format("arrays").load(out).count() == 20 and not (tmp_path / "out" / "_staged").exists()


def test_a_failed_task_leaves_no_file(source, tmp_path):
    out = tmp_path / "out"
    good = source.createDataFrame([("a", [1.0]), ("b", [2.0])], "code string, vec array<double>")
    good.write.format("arrays").mode("append").save(str(out))
    before = sorted(p.name for p in out.iterdir())
    bad = source.createDataFrame([("c", [1.0]), ("d", [1.0, 2.0])], "code string, vec array<double>").coalesce(1)
    with pytest.raises(Exception, match="one length"):
        bad.union(good).write.format("arrays").mode("overwrite").save(str(out))
    assert sorted(p.name for p in out.iterdir()) == before


def test_staged_commit(spark, tmp_path):
    store = Store(spark, str(tmp_path / "corpus"))
    with pytest.raises(FileNotFoundError):
        store.read("sentences")
    sentences = spark.createDataFrame([("vec", 1, f"t{i}") for i in range(5)] + [("fur", 2, "u")], "code string, article_id long, text string")
    articles = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "article_id long, title string")
    assert save_corpus(store, sentences, articles, {"vec": {"raw": 9, "final": 5}}) == 1
    assert {r["article_id"]: r["n_sentences"] for r in store.read("articles").collect()} == {1: 5, 2: 1}
    assert store.manifest()["counts"] == {"vec": {"raw": 9, "final": 5}}
    broken = sentences.selectExpr("raise_error('broken') AS code", "article_id", "text")
    with pytest.raises(Exception, match="broken"):
        store.commit({"articles": articles, "sentences": broken}, {"vec": {"raw": 0}})
    assert store.versions() == [1] and store.read("articles").count() == 2 and store.manifest()["counts"]["vec"]["raw"] == 9

    for _ in range(2):  # done again, the full rows are still the full rows
        summary = {r["code"]: (r["n_complete"], r["n_sampled"]) for r in promote_and_sample(store, "sentences", "code", ["article_id", "text"], 3).collect()}
        assert summary == {"vec": (5, 3), "fur": (1, 1)}
    assert store.read("sentences_complete").count() == 6 and store.read("sentences").count() == 4
    assert store.vacuum() == 2 and store.read("sentences").count() == 4 and store.read("articles").count() == 2


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    store.publish({"paths": {}, "counts": {}})
    monkeypatch.setattr(store, "versions", lambda: [])
    with pytest.raises(RuntimeError):
        store.publish({"paths": {}, "counts": {"lost": 1}})
    monkeypatch.undo()
    assert store.manifest()["counts"] == {} and store.versions() == [1]


def test_spans():
    page = """<table><tr><th rowspan=2>No</th><th colspan="2">A<sup>1</sup></th></tr><tr><td>x<td>y</tr>
    <tr><td>1</td><td rowspan="3">b<br>c</td><td>d &amp; e</td></tr><tr><td>2</td><td><table><tr><td>inner</td></tr></table>z</td></tr><tr><td>3</td></tr><tr></tr></table>"""
    outer, inner = G.tables_of(page)
    assert [[c.strip() for c in r] for r in outer] == [["No", "A<sup>1</sup>", "A<sup>1</sup>"], ["No", "x", "y"], ["1", "b<br>c", "d &amp; e"], ["2", "b<br>c", "z"], ["3", "b<br>c"], []]
    assert inner == [["inner"]] and G.tables_of(None) == G.tables_of("<p>no table") == []
    assert G.grid([[(5, 2, "a"), (1, 1, "b")], [(1, 1, "c")]]) == [["a", "a", "b"], ["a", "a", "c"]]
    assert G.tables_of('<table><tr><td rowspan="0" colspan="x">a</td></tr></table>') == [[["a"]]]


def table(*rows):
    return "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"


PAGES = {
    "italian": table(["No", "English", "Italian", "Lombard", "Friulian", "Venetan", "Sicilian", "Ligurian", "Sardinian"], ["1", "I", "io", "mi", "jo", "mi", "iu", "mi", "deo"], ["x", *"abcdefgh"], ["2", "you", "tu"], [" 3 ", "he", *"abcdefg"]),
    "romance": table(["English", "French", "Spanish", "Catalan"], ["I", "je", "yo", "jo"], [], ["you", "tu"]) + table(["English", "Occitan (general)", "Lengadocian"], ["I", "o", "ieu"], ["you"]),
    "germanic": table(["No", "Old English", "German"], ["1", "ic", "ich"], ["1", "thu", "du"], ["2"], ["3", "he"]),
    "slavic": table(["No", "English", "Slovene", "Serbo-Croatian (x)"], ["1", "I", "jaz<sup>2</sup>", "ja&nbsp;"], ["two", "a", "b", "c"]),
    "single": table(["No", "English", "Shqip"], ["1", "I", "unë"], ["2", "you"], ["3", "he", "ai"]),
}


@pytest.mark.parametrize(
    "name,of,want",
    [
        ("italian", G.ITALIAN, {(1, "concept_en"): "I", (1, "ita"): "io", (1, "lmo"): "mi", (1, "fur"): "jo", (1, "vec"): "mi", (1, "scn"): "iu", (1, "lij"): "mi", (1, "sc"): "deo", (3, "concept_en"): "he", (3, "ita"): "a", (3, "lmo"): "b", (3, "fur"): "c", (3, "vec"): "d", (3, "scn"): "e", (3, "lij"): "f", (3, "sc"): "g"}),
        ("romance", G.ROMANCE, {(1, "fra"): "je", (1, "spa"): "yo", (1, "cat"): "jo", (1, "por"): "", (3, "fra"): "tu", (3, "spa"): "", (3, "cat"): "", (3, "por"): ""}),
        ("romance", G.OCCITAN, {(1, "oci"): "ieu", (2, "oci"): ""}),
        ("germanic", G.GERMANIC, {(1, "deu"): "du", (1, "eng"): "", (3, "deu"): "", (3, "eng"): ""}),
        ("slavic", G.SLAVIC, {(1, "slv"): "jaz", (1, "hrv"): "ja"}),
        ("single", G.single_language("sqi", "albanian"), {(1, "sqi"): "unë", (3, "sqi"): "ai"}),
        ("single", G.single_language("sqi", "shqip"), {(1, "sqi"): "unë", (3, "sqi"): "ai"}),
    ],
)
def test_appendices(spark, name, of, want):
    pages = spark.createDataFrame(list(PAGES.items()) + [("none", None)], "page string, html string")
    got = {(r["n"], r["code"]): r["form"] for r in G.word_forms(G.table_grids(pages, "page"), "page", of).where(f"page = '{name}'").collect()}
    assert got == want
