"""Masked characters, and skip-gram vectors over subwords."""

import hashlib
import random

import numpy as np
import pytest

from glossa.operators import masking as MK
from glossa.operators import subwords as SW


def test_masking(spark):
    texts = [(1, "abc" * 1000), (2, None), (3, ""), (4, " é"), (5, "abc" * 1000), (1, "abc" * 1000)]
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in texts], "id long, text string, part int, `x.y` int").drop("part")
    got = MK.masked(df, ["id"], "text", length=100).orderBy("id", "part").collect()
    assert [r for r in got if r["id"] == 2][0]["input_ids"] == [MK.BEGIN, MK.END] == [r for r in got if r["id"] == 3][0]["input_ids"]
    chosen = marked = other = 0
    back = {1: [], 5: []}
    for r in got:
        assert r["input_ids"][0] == MK.BEGIN and r["input_ids"][-1] == MK.END and len(r["input_ids"]) == len(r["labels"]) <= 100
        if r["id"] == 4:
            assert r["input_ids"][1:3] == [MK.MASK, MK.BEGIN] and r["labels"][1:3] == [MK.IGNORED] * 2
        if r["id"] in back:
            for i, label in zip(r["input_ids"][1:-1], r["labels"][1:-1], strict=True):
                if label != MK.IGNORED:
                    assert label - 2 + 0x20 in map(ord, "abc")
                    chosen, marked, other = chosen + 1, marked + (i == MK.MASK), other + (i not in (MK.MASK, label - 2 + 0x20))
                else:
                    assert chr(i) in "abc"
            back[r["id"]] += r["labels"][1:-1]
    assert 0.12 < chosen / 9000 < 0.18 and 0.75 < marked / chosen < 0.85 and 0.06 < other / chosen < 0.14
    twice = [tuple(r["labels"]) for r in got if r["id"] == 1]
    assert len(back[1]) == 6000 and len(twice) == 2 * len(set(twice)) and back[5] != back[1][:3000]  # equal keys alike, others not
    assert MK.masked(df, ["id"], "text", length=100, first_only=True).count() == 6


def test_masking_is_that_of_a_loop(spark):
    """Keys that fill one and two blocks of MD5, parts, positions of one to four digits."""
    from glossa.functions import rules

    points = [p for a, b in rules.CODE_POINTS for p in range(a, b + 1)]
    texts = [("k" * n, "aé漢😀\x00\ue003z" * m) for n in (1, 40, 44, 45, 46, 47, 48, 49, 60, 64, 130) for m in (1, 2, 40, 330)]
    df = spark.createDataFrame(texts, "id string, text string")
    for length, first_only in ((52, False), (1300, False), (102, True)):
        want = []
        for key, t in texts:
            for part in range(1 if first_only else max(1, -(-len(t) // (length - 2)))):
                ids, labels = [], []
                for i, c in enumerate(t[part * (length - 2) : (part + 1) * (length - 2)], 1):
                    h = hashlib.md5(f"42-{key}-{part}-{i}".encode()).hexdigest()
                    p, chosen = ord(c), int(h[:8], 16) < int(0.15 * 2**32) and c not in "\x00\ue003"
                    what = int(h[8:16], 16) % 100
                    ids.append(p if not chosen or what >= 90 else MK.MASK if what < 80 else points[int(h[16:24], 16) % len(points)])
                    labels.append((points.index(p) + 2 if p in points else 1) if chosen else MK.IGNORED)
                want.append((key, part, [MK.BEGIN, *ids, MK.END], [MK.IGNORED, *labels, MK.IGNORED]))
        rows = MK.masked(df, ["id"], "text", length=length, first_only=first_only).collect()
        assert sorted((r["id"], r["part"], r["input_ids"], r["labels"]) for r in rows) == sorted(want)
        assert all(r["attention_mask"] == [1] * len(r["input_ids"]) for r in rows)


def test_many_digests_at_once():
    from glossa.functions import md5

    prefixes = [b"p" * n for n in (0, 1, 44, 52, 53, 54, 55, 56, 63, 64, 65, 118, 119, 120, 128, 200)]
    counts = np.array([0, 9, 10, 120, 99, 100, 1200, 5] * 2)
    want = [hashlib.md5(p + str(i).encode()).hexdigest() for p, n in zip(prefixes, counts, strict=True) for i in range(1, n + 1)]
    assert ["".join(f"{x:08x}" for x in column) for column in md5.numbered(prefixes, counts).T.tolist()] == want
    assert md5.numbered([], np.zeros(0, np.int64)).shape == (4, 0)


def test_padding(spark):
    df = spark.createDataFrame([(1, "ab", "x"), (2, "abcdef", "x"), (3, "a", "y")], "id long, text string, batch string")
    m = MK.masked(df, ["id", "batch"], "text", share=0)
    got = {r["id"]: r for r in MK.padded(m, "batch").collect()}
    assert got[1]["input_ids"] == [MK.BEGIN, 97, 98, MK.END, 0, 0, 0, 0] and got[1]["attention_mask"] == [1] * 4 + [0] * 4 and got[1]["labels"] == [MK.IGNORED] * 8
    assert len(got[3]["input_ids"]) == 3 and len(got[2]["input_ids"]) == 8


def test_alias_table():
    w = np.array([0.0, 1, 2, 7, 0, 3])
    n = np.bincount(SW.Alias.of(w).draw(np.random.default_rng(1), 60_000), minlength=6)
    assert n[0] == n[4] == 0 and np.abs(n / 60_000 - w / w.sum()).max() < 0.01


def test_pairs_lie_in_the_window():
    a, b = SW.pairs_of(np.arange(9), 3, np.random.default_rng(0))
    assert len(a) > 10 and set(np.abs(a - b).tolist()) <= {1, 2, 3} and len(set(zip(a.tolist(), b.tolist(), strict=True))) == len(a)
    assert len(SW.pairs_of(np.arange(1), 3, np.random.default_rng(0))[0]) == 0


@pytest.fixture(scope="module")
def planted(spark):
    r = random.Random(7)
    topics = [["river", "water", "boat", "fishing", "harbour"], ["bread", "flour", "oven", "baking", "yeast"], ["engine", "wheel", "motor", "driving", "garage"]]
    rows = [(i, [r.choice(topics[i % 3]) for _ in range(8)]) for i in range(900)] + [(1000, None), (1001, []), (1002, [None, "once"])]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    return topics, df, SW.trained(df, "id", dims=24, epochs=8, rows=1 << 12, replicas=3, sample=1.0)


def test_neighbours_of_planted_words(planted):
    topics, _, model = planted
    words = [w for t in topics for w in t]
    v = np.array([model.vector(w) for w in words])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = v @ v.T
    for i in range(len(words)):
        order = [words[j] for j in np.argsort(-near[i]) if j != i]
        assert set(order[:4]) == set(topics[i // 5]) - {words[i]}, (words[i], order)


def test_unseen_words_have_vectors(planted):
    topics, _, model = planted
    cos = lambda a, b: float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))
    new = model.vector("fishings")
    assert cos(new, model.vector("fishing")) > 0.6 and cos(new, model.vector("water")) > cos(new, model.vector("oven"))


def test_runs_repeat_and_models_are_kept(spark, planted, tmp_path):
    _, df, model = planted
    again = SW.trained(df, "id", dims=24, epochs=8, rows=1 << 12, replicas=3, sample=1.0)
    assert np.allclose(again.inner, model.inner, atol=1e-5)
    SW.save(spark, model, f"{tmp_path}/m")
    back = SW.load(spark, f"{tmp_path}/m")
    assert (back.inner == model.inner).all() and (back.outer == model.outer).all() and back.sizes == model.sizes
    rows = {r["id"]: r["vec"] for r in SW.embedded(df, ["id"], "tokens", model).collect()}
    assert rows[1000] == rows[1001] == [0.0] * 24 and np.allclose(rows[1002], model.vector("once"), atol=1e-6)
    assert not SW.trained(df.limit(0), "id", dims=4, epochs=1, rows=64).outer.any()


def test_sums_by_halves_and_pairs_of_a_place_together(monkeypatch):
    import pyarrow as pa

    r = np.random.default_rng(2)
    n = r.integers(1, 40, 200)
    x = r.random((n.sum(), 3))
    assert np.allclose(SW.summed(x, n), np.add.reduceat(x, np.cumsum(n) - n, axis=0))
    words = [f"w{i}" for i in range(3000)]
    counts = np.zeros(1 << 14, np.int64)
    for w in words:
        counts[SW.row_of(f"<{w}>", 1 << 14)] += 1
    batch = pa.RecordBatch.from_arrays([pa.array(range(30)), pa.array([words[i::30] for i in range(30)])], ["id", "tokens"])
    seen = []
    monkeypatch.setattr(SW, "learn", lambda model, parts, centre, *_: seen.append((len(centre), len(np.unique(centre)))))
    SW._train(SW.Model(np.zeros((1 << 14, 2), np.float32), np.zeros((1 << 14, 2), np.float32)), [batch], (counts, SW.Alias.of(counts**0.75)), 5, 2, 0.1, r, 1.0)
    assert sum(n for n, _ in seen) > 3000 * 4
    assert all(k < n / 3 for n, k in seen if n == SW.BATCH)  # a batch dealt pair by pair has hardly a word twice
