import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from glossa.llm import suffix_dedup as D
from glossa.llm.repeats import repeat_groups


def maximal_repeats(texts, least):
    places = defaultdict(list)
    for t, x in enumerate(texts):
        for i in range(len(x)):
            for j in range(i + least, len(x) + 1):
                places[x[i:j]].append((t, i))
    out = []
    for s, at in places.items():
        left = {texts[t][i - 1] if i else ("start", t) for t, i in at}
        right = {texts[t][i + len(s)] if i + len(s) < len(texts[t]) else ("end", t) for t, i in at}
        if len(at) > 1 and (len(left) > 1 or any(i == 0 for _, i in at)) and (len(right) > 1 or any(i + len(s) == len(texts[t]) for t, i in at)):
            out.append((len(s), sorted(at)))
    return sorted(out)


def test_interval_tree_gives_all_maximal_repeats():
    r = random.Random(5)
    for k in range(150):
        texts = [bytes(r.choice(b"ab" if k % 2 else b"abc") for _ in range(r.randrange(0, 14))) for _ in range(r.randrange(1, 5))]
        least = r.randrange(1, 4)
        assert sorted(repeat_groups(texts, least)) == maximal_repeats(texts, least), texts


def brute(texts, least):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + least] for b in raw for i in range(len(b) - least + 1))
    for b in raw:
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - least + 1):
            if seen[b[i : i + least]] > 1:
                gone[i + 1 : i + 1 + least] = True
        inner = gone[1:-1]
        yield len(b), int(inner.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(bytes(c for c, g in zip(b, inner, strict=True) if not g)).hexdigest()


def check(table, texts, least):
    out = {r["doc_id"]: r for r in D.deduplicated(table(texts), least).collect()}
    for i, want in enumerate(brute(texts, least)):
        r = out[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want, i
    assert len(out) == len(texts)


def test_planted_repeats(table):
    r = random.Random(1)
    word = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    passages = [word(n) for n in (24, 30, 55, 90, 300)]
    texts = [None, "", "short", "x" * 500, "ab" * 200]
    for i in range(60):
        parts = [word(r.randrange(0, 60))]
        for _ in range(r.randrange(0, 4)):
            p = r.choice(passages)
            a = r.randrange(0, len(p) // 2)
            parts += [p[a : a + r.randrange(10, len(p))], word(r.randrange(0, 40))]
        texts.append("".join(parts))
    texts += texts[5:12] + [texts[9][:-3] + "!"] + ["\n".join([passages[4]] * 3)]
    check(table, texts, 24)


@pytest.mark.parametrize("texts", [[], [None, None], ["a" * 199], ["q" * 201], ["z" * 200, "z" * 200], ["k" * 5000 + "j" * 100]])
def test_edges(table, texts):
    check(table, texts, 200)


def test_extra_columns_and_null_ids(spark):
    df = spark.createDataFrame([(None, "w" * 300, 1, "k"), (3, "w" * 300, 2, "k")], "doc_id long, text string, copies int, key string")
    assert [r["n_removed"] for r in D.deduplicated(df).collect()] == [300, 300]


@pytest.mark.parametrize("partitions", [3, 5, 200])
def test_every_anchor_is_judged_whatever_the_partitions(spark, table, partitions):
    r = random.Random(7)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    texts = [word(r.randrange(1, 9)) + p + word(r.randrange(1, 9)) for p in [word(20) for _ in range(400)] for _ in range(2)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        check(table, texts, 18)  # three hashes a window: anchors are spread over all values
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_anchors_are_dealt_evenly_by_their_leading_bits():
    data = np.random.default_rng(3).integers(97, 123, 200_000).astype(np.uint8)
    _, _, anchor, _ = D.anchors(data, np.array([len(data)]), D.RollingHash(), D.MIN_BYTES)
    share = np.bincount((anchor >> np.uint64(57)).astype(np.int64), minlength=128) / len(anchor)
    assert share.max() < 0.05  # the smallest of 185 hashes, as it is, begins with seven zero bits three times in four
