import random
import re

import numpy as np
import pytest

from glossa.llm import decontaminate as C
from glossa.llm.fm_index import FMIndex, suffix_order

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def test_suffix_order_and_search():
    r = random.Random(3)
    for _ in range(60):
        s = np.array([r.randrange(0, 4) for _ in range(r.randrange(1, 60))] + [0], np.int32)
        order = suffix_order(s)
        uniq = [(0, i) if c == 0 else (1, c) for i, c in enumerate(s.tolist())]
        assert order.tolist() == sorted(range(len(s)), key=lambda i: uniq[i:])
        index = FMIndex(s, sample=4)
        pats = np.array([[r.randrange(1, 5) for _ in range(3)] for _ in range(20)])
        which, lo, hi = index.search(pats)
        found = {int(w): sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(which, lo, hi, strict=True)}
        for k, p in enumerate(pats):
            want = [i for i in range(len(s) - 2) if (s[i : i + 3] == p).all()]
            assert found.get(k, []) == want


def brute(texts, items, window):
    ws = [WORD.findall(lower(t or "")) for t in texts]
    out = []
    for w in ws:
        hit, which = set(), set()
        for item, t in items:
            q = WORD.findall(lower(t or ""))
            n = min(window, len(q))
            for k in range(len(q) - n + 1 if n else 0):
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == q[k : k + n]:
                        hit |= set(range(i, i + n))
                        which.add(str(item))
        out.append((len(w), len(hit), sorted(which)))
    return out


def cases():
    r = random.Random(4)
    vocab = [f"wörd{i}" if i % 5 == 0 else f"w{i}" for i in range(30)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([2, 5, 10, 14, 30])))) for i in range(12)] + [(99, None), (98, "..."), (3, "Repeated ID words here")]
    texts = [None, "", "--- ...", "w1"]
    for _ in range(40):
        t = " ".join(r.choice(vocab + ["other"]) for _ in range(r.randrange(0, 50)))
        if r.random() < 0.6:
            q = (r.choice(items)[1] or "").split()
            a = r.randrange(0, max(1, len(q) // 2))
            t += " " + ", ".join(q[a:]).upper().replace("Ö", "ö") + "! " + " ".join(q)
        texts.append(t)
    return texts, items


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_hits_equal_brute_force(spark, table, block):
    texts, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in C.hits(table(texts), bench, block_bytes=block).collect()}
    for i, (n, hit, which) in enumerate(brute(texts, items, 10)):
        assert (got[i]["n_words"], sum(s["end"] - s["start"] for s in got[i]["spans"]), sorted(got[i]["items"])) == (n, hit, which), texts[i]


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_cleaned_texts_have_no_hits_left_where_cut(spark, table, block):
    texts, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = table(texts)
    kept = {r["doc_id"]: r for r in C.cleaned(docs, bench, block_bytes=block).collect()}
    for i, (n, hit, _) in enumerate(brute(texts, items, 10)):
        if not hit:
            assert kept[i]["text"] == texts[i]
        elif hit == n:
            assert i not in kept
        else:
            assert len(WORD.findall(lower(kept[i]["text"]))) == n - hit and kept[i]["n_chars"] == len(kept[i]["text"])


def test_empty_tables(spark, table):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert C.report(C.hits(table(["a b c"]), bench)).first()["contaminated"] is False
    assert C.hits(table([]), bench).count() == 0
