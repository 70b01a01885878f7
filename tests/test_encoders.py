"""Truncation, pooling and centring against NumPy."""

import hashlib

import numpy as np
import pytest

from glossa.operators import encoders as EN


def state(token, dims):
    return np.concatenate([np.frombuffer(hashlib.md5((token if not k else f"{token}#{k}").encode()).digest(), np.uint8) / 127.5 - 1 for k in range(-(-dims // 16))])[:dims]


@pytest.mark.parametrize("characters,centre,dims", [(False, False, 16), (False, True, 20), (True, True, 5), (True, False, 33)])
def test_vectors(spark, characters, centre, dims):
    texts = ["one two three four five", None, "", "  ", "one", "é中😀x" * 20, "one two three", "w " * 5000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "id long, text string, vec int").repartition(3)
    got = {r["id"]: r["vec"] for r in EN.encode(df, ["id"], "text", lambda: EN.HashedTokens(dims, characters), dims, 3, centre, batch=2).collect()}
    raw = np.array([np.mean([state(x, dims) for x in (list(t or "") if characters else (t or "").split())[:3]] or [np.zeros(dims)], 0) for t in texts])
    want = raw - raw.mean(0) if centre else raw
    want = want / np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-300)
    assert all(np.allclose(got[i], want[i]) for i in range(len(texts)))
    assert EN.encode(df.limit(0), ["id"], "text", EN.HashedTokens, 16, centre=centre).count() == 0


def test_the_mask_decides_what_counts():
    states = np.arange(24.0).reshape(2, 3, 4)
    assert np.allclose(EN.pooled(states, np.array([[1, 0, 1], [0, 0, 0]])), [states[0, [0, 2]].mean(0), np.zeros(4)])
