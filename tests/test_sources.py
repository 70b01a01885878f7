"""Readers and writers on small files."""

import json

import pytest

from glossa.sources import readers, sinks
from glossa.streaming import cleaning


def put(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content, encoding="utf-8")
    return str(path)


def test_parallel_and_pairs(spark, tmp_path):
    p = put(tmp_path / "w.csv", 'id,ita,fur\n1,"a ""x"", b",c\n2,d,e\n')
    got = {(r["id"], r["code"]): r["text"] for r in readers.parallel(spark, p, ["ita", "fur", "vec"], ["id"]).collect()}
    assert got == {("1", "ita"): 'a "x", b', ("1", "fur"): "c", ("2", "ita"): "d", ("2", "fur"): "e"}
    assert readers.beside(spark, p, "ita", ["fur"]).count() == 2
    bad = put(tmp_path / "bad.csv", "id,ita,fur\n1,a,\n2,d,e\n")
    with pytest.raises(ValueError):
        readers.parallel(spark, bad, ["ita", "fur"], ["id"])
    assert readers.parallel(spark, bad, ["ita", "fur"], ["id"], literal_nan=True).where("text = 'nan'").count() == 1


def test_articles_and_stream(spark, tmp_path):
    long = "This is a sentence that is quite long enough. another one glued to it, also long enough here."
    rows = [{"id": "1", "text": long, "title": "t"}, {"id": "2", "text": "  "}]
    put(tmp_path / "a" / "AA" / "x", "\n".join(map(json.dumps, rows)))
    got = readers.articles(spark, str(tmp_path / "a"))
    assert [(r["id"], r["url"], r["title"]) for r in got.collect()] == [(1, "", "t")]
    assert cleaning.clean_stream(got, "vec").count() == 1
    stream = spark.readStream.schema(readers.ARTICLE).option("recursiveFileLookup", "true").json(str(tmp_path / "a"))
    q = cleaning.clean_stream(stream, "vec").writeStream.format("memory").queryName("cleaned").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("cleaned").count() == 1


def test_predictions_and_gold(spark, tmp_path):
    put(tmp_path / "p" / "english-to-FUR.txt", '1. "uno"\n\n- due\n\n\n')
    got = sorted((r["source"], r["target"], r["pos"], r["pred"]) for r in readers.predictions(spark, str(tmp_path / "p")).collect())
    assert got == [("eng", "fur", 0, "uno"), ("eng", "fur", 1, ""), ("eng", "fur", 2, "due")]
    g = put(tmp_path / "g.tsv", "Friulian\tvec\n a \tb\nc\td\n")
    assert sorted((r["pos"], r["target"], r["ref"]) for r in readers.gold_table(spark, g).collect()) == [(0, "fur", "a"), (0, "vec", "b"), (1, "fur", "c"), (1, "vec", "d")]


def test_matrix_round_trip_and_stats(spark, tmp_path):
    p = put(tmp_path / "d.csv", ",x,y\nx,0.0,0.25\ny,0.25,0.0\n")
    m = readers.square_matrix(spark, p)
    wide = {r["code"]: (r["x"], r["y"]) for r in sinks.square_matrix(m, ["x", "y"]).collect()}
    assert wide == {"x": ("0.000000", "0.250000"), "y": ("0.250000", "0.000000")}
    long = spark.createDataFrame([("a", 0, "xx"), ("a", 1, "y"), ("b", 0, "zzz")], "code string, pos int, text string")
    assert {(r["code"], r["n_chars"]) for r in sinks.group_stats(long).collect()} == {("a", 3), ("b", 3), ("total", 6)}
    assert sinks.wide_parallel(long, ["b"]).columns == ["pos", "b", "a"] and sinks.wide_parallel(long, ["b"]).count() == 1
    w = put(tmp_path / "wl.csv", 'n,concept_en,ita,fur\n1,I,"io, me",jo/o\n')
    assert {(r["code"], r["form"]) for r in readers.wordlist(spark, w).collect()} == {("ita", "io"), ("fur", "jo")}


def test_html_tables_and_paths(spark, tmp_path):
    df = spark.createDataFrame([(1, "<table><tr><th>n</th><th>w</th></tr><tr><td>1</td><td>a<sup>x</sup> &amp; b</td></tr></table>")], "id int, html string")
    cells = {(r["row"], r["col"]): r["cell"] for r in readers.html_tables(df, "id").collect()}
    assert cells == {(0, 0): "n", (0, 1): "w", (1, 0): "1", (1, 1): "a & b"}
    put(tmp_path / "r" / "tfidf" / "e1" / "char" / "d.csv", "x")
    put(tmp_path / "r" / "_old" / "e1" / "char" / "d.csv", "x")
    got = readers.model_paths(spark, str(tmp_path / "r"), "d.csv").collect()
    assert [(r["method"], r["experiment"], r["variant"], r["model_id"]) for r in got] == [("tfidf", "e1", "char", "tfidf__e1__char")]


def test_cleaned_corpus(spark, tmp_path):
    s = spark.createDataFrame([(1, "a", "t"), (1, "a", "u")], "article_id int, code string, text string")
    a = spark.createDataFrame([(1, "T"), (2, "U")], "article_id int, title string")
    sinks.cleaned_corpus(s, a, str(tmp_path / "out"))
    assert [(r["article_id"], r["n_sentences"]) for r in spark.read.parquet(str(tmp_path / "out/articles")).collect()] == [(1, 2)]
    assert json.loads(sinks.run_metadata(seed=1))["parameters"] == {"seed": 1}
