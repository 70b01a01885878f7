"""Translation metrics and their drivers against plain implementations."""

import math
from collections import Counter

import pytest

from glossa.operators import scoring as SC
from glossa.operators import translation as MT

REFS = ["Il gatto (nero) dorme.", "Costa 3.50 euro, forse 4,20!", "Va bene", "\"Ciao\" disse", "uno due tre quattro cinque", ""]
A = ["Il gatto nero dorme.", "Costa 3.50 euro, forse 4!", "Va bene", "Ciao disse \"", "uno due tre", "niente"]
B = ["Un cane", "costa tanto", "Va male", "", "uno due tre quattro cinque", "x"]


def plain_chrf(pairs):
    p, r = [], []
    for kind in [f"c{n}" for n in range(1, 7)] + ["w1", "w2"]:
        hyp = ref = match = 0
        for a, b in pairs:
            def grams(t):
                n = int(kind[1])
                if kind[0] == "c":
                    t = "".join(t.split())
                    return Counter(t[i : i + n] for i in range(len(t) - n + 1))
                ws = []
                for w in t.split():
                    if len(w) > 1 and w[-1] in MT.PUNCTUATION:
                        ws += [w[:-1], w[-1]]
                    elif len(w) > 1 and w[0] in MT.PUNCTUATION:
                        ws += [w[0], w[1:]]
                    else:
                        ws.append(w)
                return Counter(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1))
            x, y = grams(a), grams(b)
            hyp, ref, match = hyp + x.total(), ref + y.total(), match + (x & y).total()
        if hyp and ref:
            p.append(match / hyp)
            r.append(match / ref)
    p, r = sum(p) / len(p), sum(r) / len(r)
    return 500 * p * r / (4 * p + r) if p + r else 0.0


def tables(spark, a=A, b=B, refs=REFS):
    preds = [(s, "vec", i, t) for s, side in (("ita", a), ("eng", b)) for i, t in enumerate(side)]
    return spark.createDataFrame(preds, "source string, target string, pos long, pred string"), spark.createDataFrame([("vec", i, t) for i, t in enumerate(refs)], "target string, pos long, ref string")


def test_words():
    assert MT.chrf_words('(foo "x bar. a !') == ["(", "foo", '"', "x", "bar", ".", "a", "!"]
    assert MT.bleu_words("Costa 3.50, (forse) &amp; no-1 e 4-5.") == ["Costa", "3.50", ",", "(", "forse", ")", "&", "no-1", "e", "4", "-", "5", "."]


def test_score_files(spark):
    got = {r["source"]: r for r in SC.score_files(*tables(spark)).collect()}
    for source, side in (("ita", A), ("eng", B)):
        pairs = [(x, y) for x, y in zip(side, REFS, strict=True) if x and y]
        assert got[source]["n_sentences"] == len(pairs) and abs(got[source]["chrfpp"] - plain_chrf(pairs)) < 1e-4
    assert 0 < got["ita"]["bleu"] < 100


def test_bleu_of_equal_texts_and_of_none(spark):
    preds, gold = tables(spark, a=REFS)
    got = {r["source"]: r["bleu"] for r in SC.score_files(preds, gold).collect()}
    assert math.isclose(got["ita"], 100)


def test_lengths_that_differ(spark):
    preds, gold = tables(spark, a=A[:4])
    assert {r["source"] for r in SC.score_files(preds, gold, "skip").collect()} == {"eng"}
    assert {r["source"]: r["n_sentences"] for r in SC.score_files(preds, gold, "truncate").collect()} == {"ita": 4, "eng": 4}
    with pytest.raises(ValueError):
        SC.lengths(preds, gold, "guess", ["target"])


def test_significance(spark):
    n = 40
    refs = [f"frase numero {i} di prova con parole" for i in range(n)]
    preds, gold = tables(spark, a=refs, b=[t[::-1] for t in refs], refs=refs)
    r = SC.within_system(preds, gold, ["chrfpp", "bleu"], 60).collect()
    assert len(r) == 2 and all(x["source_a"] == "eng" and x["delta"] < 0 and x["hi"] < 0 and x["p"] == 0 and x["significant_bonf"] for x in r)
    x = SC.cross_system({"A": preds, "B": preds}, gold, ["chrfpp"], 30).collect()
    assert len(x) == 2 and all(y["delta"] == 0 and y["p"] == 1 and not y["significant_bonf"] for y in x)
    wins = SC.win_counts(spark.createDataFrame([(1.0, True), (-1.0, True), (1.0, False)], "delta double, significant_bonf boolean"), []).first()
    assert (wins["wins_a"], wins["wins_b"], wins["ties"]) == (1, 1, 1)


def test_too_few_sentences_are_not_tested(spark):
    assert SC.within_system(*tables(spark, A[:3], B[:3], REFS[:3]), ["chrfpp"], 10).count() == 0
