import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from glossa.llm import sharding as S


def test_rows_of_the_matrix_add_up():
    sizes, cells = np.array([5, 0, 17, 3, 40, 1]), np.array([20, 21, 25])
    m = np.stack([S.matrix_row(sizes, cells, i, 7) for i in range(6)])
    assert (m >= 0).all() and (m.sum(1) == sizes).all() and (m.sum(0) == cells).all()


def test_matrix_entry_has_its_law():
    got = Counter(int(S.matrix_row(np.array([6, 4, 5]), np.array([8, 7]), 1, s)[0]) for s in range(3000))
    rng = np.random.default_rng(0)
    want = Counter(rng.hypergeometric(8, 7, 4, 30000).tolist())
    assert all(abs(got[k] / 3000 - want[k] / 30000) < 0.04 for k in range(5))


def test_large_draws_follow_the_same_law(monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(S, "NUMPY_MAX", 0)
    own = np.array([S.hypergeometric(rng, 4000, 6000, 500) for _ in range(4000)])
    monkeypatch.undo()
    ref = np.random.default_rng(2).hypergeometric(4000, 6000, 500, 40000)
    assert abs(own.mean() - ref.mean()) < 0.6 and abs(own.std() - ref.std()) < 0.5
    big = S.hypergeometric(rng, 4 * 10**10, 6 * 10**10, 10**9)
    assert abs(big - 4 * 10**8) < 10**6
    assert S.hypergeometric(rng, 0, 5, 3) == 0 and S.hypergeometric(rng, 5, 0, 3) == 3


@pytest.mark.parametrize("n", [0, 1, 5, 16, 403])
def test_exact_sizes_and_gapless_slots(table, n):
    out = S.shuffle_into_shards(table([f"text {i}" for i in range(n)]), 16, block_rows=16).select("row.doc_id", "shard", "slot").toPandas()
    assert len(out) == n and sorted(out.doc_id) == list(range(n))
    counts = Counter(out.shard)
    assert n == 0 or max(counts.values()) - min([counts[s] for s in range(16)]) <= 1
    for s, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g))), s


def test_whole_rows_arrive(spark):
    """Rows that differ in other columns only, names that clash, nulls, repeated rows and a very long text."""
    rows = [(None, None, 1, 2, "a"), (1, "é", 3, 4, "b"), (1, "é", 3, 4, "b"), (1, "é", 3, 5, None), (2**60 + 1, "", 5, 6, "c"), (7, "long " * 200_000, 0, 0, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int, cell int, `a.b` string")
    out = S.shuffle_into_shards(df, 4, block_bytes=100)
    assert sorted(map(str, out.select("row.*").collect())) == sorted(map(str, df.collect()))
    assert Counter(r["shard"] for r in out.collect()) in ({0: 1, 1: 2, 2: 1, 3: 2}, {0: 2, 1: 1, 2: 2, 3: 1})


def test_query_columns(spark, tmp_path):
    spark.createDataFrame([(3, "é"), (4, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in S.op1_hypergeometric_shards(spark, str(tmp_path)).collect()}
    assert (got[3]["size"], got[3]["text_crc32"], got[3]["law"], got[3]["grown_shard"]) == (3, zlib.crc32("é".encode()), "rows", None)
    assert (got[4]["size"], got[4]["text_crc32"]) == (1, 0)


def test_blocks_end_by_rows_and_bytes():
    b = pa.RecordBatch.from_arrays([pa.array([5, 1, 1, 9, 1, 1, 1, 30])], ["size"])
    parts = lambda *slices: [t.column(0).to_pylist() for t in S.blocks_of(iter(slices), 0, 3, 10)]
    assert parts(b) == [[5, 1, 1], [9, 1], [1, 1, 30]]
    assert parts(b.slice(0, 2), b.slice(2, 3), b.slice(5)) == parts(b)  # however the rows come in


def test_uniform_over_shards_and_slots(table):
    docs = table([f"{i}" for i in range(12)])
    shards, slots, trials = Counter(), Counter(), 40
    for seed in range(trials):
        for r in S.shuffle_into_shards(docs, 3, seed=seed, block_rows=2).select("row.doc_id", "shard", "slot").collect():
            shards[r["doc_id"], r["shard"]] += 1
            slots[r["doc_id"], r["slot"]] += 1
    for seen, k in ((shards, 3), (slots, 4)):
        want = trials / k
        assert sum((seen[i, j] - want) ** 2 / want for i in range(12) for j in range(k)) < 12 * (k - 1) + 5 * (2 * 12 * (k - 1)) ** 0.5
