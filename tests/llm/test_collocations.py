import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from glossa.llm import collocations as C


def brute(docs, least, top, max_words=3, inside=50):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = Counter(), Counter()
    for text, lang in docs:
        for piece in re.split("[.,;:!?\n\v\f\r]", (text or "").translate(low)):
            ws = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(ws)
            for k in range(1, max_words + 1):
                f.update(((lang or "und"), *ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = {}
    cands = {p for p, a in f.items() if len(p) > 2 and a >= least}
    for lang, *ws in cands:
        a = f[lang, *ws]
        around = [q for q in cands if len(q) == 4 and len(ws) == 2 and q[0] == lang and (q[1:3] == (*ws,) or q[2:] == (*ws,))]
        if any(100 * f[q] >= inside * a for q in around):
            continue
        cuts = [(int(Fraction(1000000 * a * a, f[lang, *ws[:k]] * f[lang, *ws[k:]])), k, f[lang, *ws[:k]], f[lang, *ws[k:]]) for k in range(1, len(ws))]
        score, _, l, r = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), l, r))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1))


def found(df, **how):
    return sorted(tuple(r) for r in C.collocations(df, **how).collect())


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(2)
    words = ["the", "of", "The", "é", "x\xa0y", "\x00", "a-b", *(f"w{i}" for i in range(12))]
    texts = [(None, "en"), ("", None), (" \t ", "en"), ("..,;", "de"), ("New York City " * 40, None)]
    for _ in range(150):
        ws = r.choices(words, [40, 30, 5, 3, 3, 3, 3, *[2] * 12], k=r.randrange(0, 60))
        texts.append(("".join(w + r.choice([" ", " ", " ", "\t", ". ", "\n", ", "]) for w in ws), r.choice(["en", "en", "de", None])))
    return texts + texts[10:20]


@pytest.mark.parametrize("how", [{}, {"top": 7}, {"max_words": 2}, {"inside": 90}, {"inside": 0}])
def test_against_brute_force(spark, corpus, how):
    df = spark.createDataFrame(corpus, "text string, lang string")
    want = brute(corpus, 10, **{"top": 2000} | how)
    assert found(df, **how) == want and len(want) > 5


@pytest.mark.parametrize("change", [{"HOT": 2}, {"HOT": 10**9}, {"STRETCH_WORDS": 5}, {"STRETCH_LENGTH": 7}, {"FIELD_BITS": 6}])
def test_stretches_hot_words_and_the_field_change_nothing(spark, corpus, change, monkeypatch):
    for k, v in change.items():
        monkeypatch.setattr(C, k, v)
    monkeypatch.setattr(C, "CHUNK_BYTES", 20)
    df = spark.createDataFrame(corpus, "text string, lang string").repartition(3)
    assert found(df) == brute(corpus, 10, 2000)


def test_shared_hashes_are_drawn_anew(spark, corpus, monkeypatch):
    counts = C.word_counts
    shared = lambda docs, seed: counts(docs, seed) if seed else counts(docs, seed).selectExpr("id % 3 AS id", "lang", "word", "n")
    monkeypatch.setattr(C, "word_counts", shared)
    docs = C.lang_and_text(spark.createDataFrame(corpus, "text string, lang string"), "text", "lang")
    words, totals, seed = C.frequent_words(docs, 10)
    assert seed == 1
    n = {r["lang"]: r["n"] for r in totals.collect()}
    assert n == {k: sum(r["n"] for r in counts(docs, 1).where("word IS NOT NULL").collect() if r["lang"] == k) for k in n}
    assert all(C.word_hash(r["lang"], 1)(r["word"].encode()) == r["id"] % 2**64 and r["n"] >= 10 for r in words.collect())


def test_counts_beyond_64_bits(spark):
    n = 3_000_000  # a * a * 1000000 is 9e18, just below 2^63; times ten above it
    rows = np.array([[5], [6]], np.uint64)
    got = list(C.grown(rows, np.array([n * 10], np.int64), np.zeros(0, np.uint64), 10))
    assert got[0][1].tolist() == [n * 10]
    row = spark.sql(f"SELECT div(1000000BD * cast({n * 10} as decimal(12,0)) * cast({n * 10} as decimal(12,0)), cast({n * 40} as decimal(12,0)) * cast({n * 30} as decimal(12,0))) AS s").first()
    assert row["s"] == 1000000 // 12


def test_edges(spark):
    schema = "text string, lang string, a int, `rank` int, `x.y` int, word string"
    assert found(spark.createDataFrame([], schema)) == []
    assert found(spark.createDataFrame([(None, None, 1, 1, 1, "w")], schema)) == []
    long = " ".join(["alpha beta"] * 400_000)
    df = spark.createDataFrame([(long, "en", 1, 1, 1, "w")], schema)
    assert [tuple(r)[2:5] for r in C.collocations(df).orderBy("rank").collect()] == [("alpha beta alpha", 399_999, 400_000), ("beta alpha beta", 399_999, 400_000)]
    with pytest.raises(ValueError):
        C.collocations(df, max_words=4)
