import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from glossa.llm import spelling as S


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    s, t = sorted((a, b), key=len)
    return len(t) - len(s) == 1 and any(t[:i] + t[i + 1 :] == s for i in range(len(t)))


def brute(counts, factor=10):
    best, n_near = {}, {}
    for w, n in counts.items():
        others = [o for o in counts if abs(len(o) - len(w)) < 2 and near(w, o)]
        n_near[w] = len(others)
        top = min(others, key=lambda o: (-counts[o], o), default=None)
        best[w] = top if top is not None and counts[top] >= factor * n else None
    out = []
    for w, n in counts.items():
        root = w
        while best[root] is not None:
            root = best[root]
        out.append((w, best[w], root, n, n_near[w], counts[best[w]] if best[w] is not None else None))
    return sorted(out)


def found(df, **how):
    return sorted(tuple(r) for r in S.variants(df, **how).collect())


@pytest.mark.parametrize("factor", [2, 10])
def test_against_brute_force(spark, factor):
    r = random.Random(factor)
    words = {"".join(r.choice("aabé中") for _ in range(r.randrange(0, 7))): r.choice([1, 2, 3, 30, 30, 400, 5000]) for _ in range(500)}
    assert found(spark.createDataFrame(list(words.items()), "word string, n long"), factor=factor) == brute(words, factor)


def test_shared_keys_are_told_apart_on_strings(spark, monkeypatch):
    r = random.Random(1)
    words = {"".join(r.choice("abc") for _ in range(5)): r.randrange(1, 90) for _ in range(60)}
    real = S.keyed
    monkeypatch.setattr(S, "keyed", lambda words: real(words).selectExpr("key % 3 AS key", "id", "at"))
    assert found(spark.createDataFrame(list(words.items()), "word string, n long"), factor=3) == brute(words, 3)


def test_keys_meet_exactly_where_strings_do():
    r = random.Random(4)
    words = sorted({"".join(r.choice("abcÿ") for _ in range(r.randrange(0, 9))) for _ in range(300)}) + ["z" * 3000]
    key, of, at = S.deletion_keys(words)
    left = [words[i] if p < 0 else words[i][: p >> 1] + words[i][(p >> 1) + 1 :] for i, p in zip(of.tolist(), at.tolist(), strict=True)]
    assert len(set(left)) == len(np.unique(key)) and len({*zip(left, key.tolist(), strict=True)}) == len(set(left))
    first = [p < 0 or p & 1 == (p >> 1 == 0 or words[i][(p >> 1) - 1] != words[i][p >> 1]) for i, p in zip(of.tolist(), at.tolist(), strict=True)]
    assert all(first)


def test_key_across_batches(spark, monkeypatch):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        words = {f"abc{c}ef": 10 + i for i, c in enumerate("ghijklmnop")} | {"abcef": 1000}
        assert found(spark.createDataFrame(list(words.items()), "word string, n long")) == brute(words)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_words_of_documents(table, spark):
    r = random.Random(9)
    texts = [None, "", "short ones", "x" * 20_000 + " " + "x" * 19_999, "×÷Àÿabcdefg ABCDEFÀ"]
    vocabulary = ["Recommend", "recomend", "separate", "éclairée", "seperate", "ÉCLAIRÉE", "mississippi"]
    texts += [" ".join(r.choices(vocabulary, [60, 2, 40, 9, 2, 1, 20], k=80)) for _ in range(150)]
    counts = Counter()
    for i, t in enumerate(texts):
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    assert found(S.noisy_words(table(texts))) == brute(counts) and len(counts) > 15
    one = S.noisy_words(table(["letters letters", "letterz"]), min_count=1, noise=None)
    assert sorted(map(tuple, one.collect())) == [("letters", 2), ("letterz", 1)]


def test_edges(spark):
    schema = "n long, word string, id int, `key.x` int, kind string"
    assert found(spark.createDataFrame([], schema)) == []
    rows = [(5, "same", 1, 1, "k"), (6, "same", 1, 1, "k"), (None, "same", 1, 1, "k"), (3, None, 1, 1, "k"), (1, "sane", 1, 1, "k"), (0, "", 1, 1, "k")]
    assert found(spark.createDataFrame(rows, schema)) == brute({"same": 11, "sane": 1, "": 0})
    with pytest.raises(ValueError):
        S.variants(spark.createDataFrame([], schema), factor=1)


def test_chain_of_forms(spark):
    words = {"a" * k: 10**k for k in range(1, 13)}
    assert {r[2] for r in found(spark.createDataFrame(list(words.items()), "word string, n long"))} == {"a" * 12}
