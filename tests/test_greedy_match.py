import re

import numpy as np

from glossa.operators import embedding as EM
from glossa.operators import translation as MT

WORD = re.compile(r"[^\W\d_]+")
PAIRS = [(0, "Hello there, big world", "hello world"), (1, "A small wörld it is", "It is small"), (2, "12 34", "worlds apart"), (3, None, "x"), (4, "same same", "same")]


def test_greedy_match_scores_every_pair(spark):
    df = spark.createDataFrame(PAIRS, "id int, pred string, ref string")
    want = {}
    for i, pred, ref in PAIRS:
        p, r = (EM.HashingEncoder().encode(WORD.findall(t or "")) for t in (pred, ref))
        s = p @ r.T if len(p) and len(r) else None
        want[i] = None if s is None else [s.max(1).mean(), s.max(0).mean()]
    got = {r["id"]: r for r in MT.token_scores(df, ["id"], EM.HashingEncoder).collect()}
    assert got.keys() == want.keys()
    for i, w in want.items():
        assert got[i]["precision"] is None if w is None else np.allclose([got[i]["precision"], got[i]["recall"]], w)


def test_tokens_as_vectors_give_the_same(spark):
    df = spark.createDataFrame([p for p in PAIRS if p[1]], "id int, pred string, ref string")
    words = lambda c: EM.encode(df.selectExpr("id", f"posexplode(regexp_extract_all({c}, '\\\\p{{L}}+', 0)) AS (pos, w)"), ["id", "pos"], "w", EM.HashingEncoder)
    a = {r["id"]: r["f1"] for r in MT.greedy_match(words("pred"), words("ref"), ["id"]).collect()}
    b = {r["id"]: r["f1"] for r in MT.token_scores(df, ["id"], EM.HashingEncoder).where("f1 IS NOT NULL").collect()}
    assert a.keys() == b.keys() and all(abs(a[i] - b[i]) < 1e-9 for i in a)
