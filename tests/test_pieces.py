"""Merges against a plain loop, one merge after another."""

import random
from collections import Counter

import pyarrow as pa
import pytest

from glossa.operators import pieces as P


def loop(words, merges, alphabet=None, least=2):
    state, out = [(list(w), n) for w, n in words], []
    for _ in range(merges):
        counts = Counter()
        for s, n in state:
            for p in zip(s, s[1:], strict=False):
                if alphabet is None or all(len(x) > 1 or x in alphabet for x in p):
                    counts[p] += n
        best = min(counts, key=lambda p: (-counts[p], p), default=None)
        if best is None or counts[best] < least:
            break
        out.append(best)
        state = [(P.merged(s, *best), n) for s, n in state]
    return out, {"".join(s): s for s, _ in state}


def some_words(seed, letters, n):
    r = random.Random(seed)
    parts = ["".join(r.choice(letters) for _ in range(r.randrange(1, 4))) for _ in range(8)]
    return [(w, r.randrange(1, 60)) for w in {"".join(r.choice(parts) for _ in range(r.randrange(1, 6))) for _ in range(n)}]


@pytest.mark.parametrize("seed,letters,heavy,stretches", [(1, "ab", 3, 1000), (2, "abc", 5, 1000), (3, "abcdefghijk", 4096, 200_000), (4, "abcd", 50, 7), (5, "aé中😀", 8, 40)])
def test_merges_are_those_of_a_loop(spark, seed, letters, heavy, stretches):
    words = some_words(seed, letters, 120)
    df = spark.createDataFrame(words, "word string, n long")
    want, cut = loop(words, 60)
    got = P.learned(df, 60, heavy=heavy, stretches=stretches)
    assert got == want and len(want) > 10
    assert {r["word"]: r["pieces"] for r in P.in_pieces(df, got).collect()} == cut


def test_replay_alone_is_exact_or_stops():
    for seed in range(300):
        words = some_words(seed, "abc"[: 2 + seed % 2], 12)
        counts = Counter()
        for w, n in words:
            for p in zip(w, w[1:], strict=False):
                counts[p] += n
        ranked = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
        heavy = 1 + seed % 6
        rest = ranked[heavy][1] if len(ranked) > heavy else 1
        kept = {p for p, n in ranked[:heavy] if n > rest}
        if len(kept) < 2:
            continue
        stretches = Counter()
        for w, n in words:
            at = 0
            for i in range(1, len(w) + 1):
                if i == len(w) or (w[i - 1], w[i]) not in kept:
                    stretches[w[at:i]] += n
                    at = i
        replay = P.Replay([(list(s), n) for s, n in stretches.items()], kept, rest, set("abc"))
        got = [ranked[0][0]]
        replay.merge(*got[0])
        while p := replay.best(2):
            replay.merge(*p)
            got.append(p)
        assert got == loop(words, len(got))[0]


def test_alphabet_and_coverage(spark):
    words = [("▁aaaa", 50), ("▁aab", 30), ("▁aaq", 1), ("▁b", 4)]
    df = spark.createDataFrame(words, "word string, n long")
    assert P.covered_characters(df, 0.99) == ["a", "▁", "b"]
    assert P.learned(df, 9, ["a", "▁", "b"]) == loop(words, 9, {"a", "▁", "b"})[0]
    assert len(P.trained(df, vocabulary=4 + 3 + 2, coverage=0.99)) == 2
    assert P.trained(df, vocabulary=3) == []


def test_edges(spark):
    schema = "word string, n long, s int, `x.y` int"
    assert P.learned(spark.createDataFrame([], schema), 5) == []
    assert P.learned(spark.createDataFrame([(None, 3, 1, 1), ("a", 9, 1, 1), ("ab", None, 1, 1), ("", 4, 1, 1)], schema), 5) == []
    assert P.learned(spark.createDataFrame([("ab", 1, 1, 1), ("ab", 1, 1, 1), ("a" * 5000 + "b", 1, 1, 1)], schema), 2) == loop([("ab", 2), ("a" * 5000 + "b", 1)], 2)[0]
    df = spark.createDataFrame([("x", "two  words\ttwo"), ("x", None), (None, "")], "code string, text string")
    assert sorted((r["code"], r["word"], r["n"]) for r in P.marked_words(df, ["code"], "text").collect()) == [("x", "▁two", 2), ("x", "▁words", 1)]
    assert {r["term"]: r["tf"] for r in P.piece_counts(P.marked_words(df, ["code"], "text"), ["code"], [("t", "w")]).collect()} == {"▁": 3, "tw": 2, "o": 3, "w": 1, "r": 1, "d": 1, "s": 1}


def test_batches_of_words_are_cut_as_by_a_loop():
    import numpy as np

    for seed in range(60):
        words = [w for w, _ in some_words(seed, "aé😀bc"[: 1 + seed % 5], 40)] + ["", "a", "aaaaa", "aaaaaaaa"]
        merges = loop([(w, 1) for w in words], 25, least=1)[0]
        merges += random.Random(seed).sample(merges, len(merges) // 2)  # a pair that comes back
        symbols = P.Symbols(merges)
        cut, at = P.Merges(merges, symbols).apply(*P._points(pa.array(words)))
        got = [[symbols.name(x) for x in cut[i:j].tolist()] for i, j in zip(at, at[1:], strict=False)]
        want = [list(w) for w in words]
        for m in merges:
            want = [P.merged(s, *m) for s in want]
        assert got == want and at.dtype == np.int64


def test_sizes_that_were_too_large_are_not_tried_again(spark, monkeypatch):
    tried = []
    real = P._stretches
    monkeypatch.setattr(P, "_stretches", lambda state, heavy: tried.append(len(heavy)) or real(state, heavy))
    words = some_words(6, "abcdefgh", 400)
    assert P.learned(spark.createDataFrame(words, "word string, n long"), 40, heavy=4096, stretches=20) == loop(words, 40)[0]
    assert tried[0] <= P.START and len(tried) > 3 and all(b <= 4 * a for a, b in zip(tried, tried[1:], strict=False))


def test_white_space_is_unicode_s(spark):
    t = "a\x1cb c d\x85e​f\xa0g 　h\n"
    for x in (t, t.replace("\x1c", "")):
        got = {r["word"]: r["n"] for r in P.marked_words(spark.createDataFrame([(x, 1), (x, 1), (x, None)], "text string, k int"), ["k"], "text").where("k = 1").collect()}
        want = spark.createDataFrame([(x,)], "t string").selectExpr(r"explode(filter(split(t, '(?U)\\s+'), w -> w <> '')) w").collect()
        assert got == {"▁" + r["w"]: 2 for r in want}


def test_pieces_of_groups(spark):
    rows = [("x", "▁abab", 3), (None, "▁ab", 2), ("x", "▁ab", 1), ("y", None, 5), ("y", "▁c", 10**12)]
    got = P.piece_counts(spark.createDataFrame(rows, "code string, word string, n long"), ["code"], [("a", "b"), ("ab", "ab")]).collect()
    assert {(r["code"], r["term"]): r["tf"] for r in got} == {("x", "▁"): 4, ("x", "abab"): 3, ("x", "ab"): 1, (None, "▁"): 2, (None, "ab"): 2, ("y", "▁"): 10**12, ("y", "c"): 10**12}


def test_weights_are_over_all_pieces(spark):
    from glossa.plans import models

    sf = "/root/testdata/sf0.001"
    steps = models.QUERIES["emb5_piece_model"](spark, sf).collect()
    terms = {r["term"] for r in models.QUERIES["emb5_piece_tfidf"](spark, sf).select("term").distinct().collect()}
    assert len(steps) > 7000 and sum(r["left"] + r["right"] in terms for r in steps[60:]) > 4000
