"""Uniform shuffle of whole rows into shards of exact size by a hypergeometric communication matrix.

The blocks are stretches of the input's partitions, the cells equal parts of the shards. How many rows block i sends
to cell j is one entry of a random matrix with given row sums (block sizes) and column sums (cell sizes): the
multivariate hypergeometric law that a uniform permutation has. Each block draws its own row of that matrix by walking
down a binary tree over the blocks, every node of which splits its column vector between its halves with a seed of its
own; so nothing of size blocks x cells exists anywhere, and a retried task draws the same numbers. Then: permute inside
the block, deal the rows out by the drawn counts, exchange, permute inside the cell. A shard is a run of whole cells,
its slots are gapless, and every permutation of the rows is equally likely.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: numpy's generator takes populations below this.
NUMPY_MAX = 1_000_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """One draw, for any size: numpy's below 1e9, else inversion over the 14 deviations around the mode."""
    if sample == 0 or good == 0:
        return 0
    if bad == 0:
        return sample
    if good + bad < NUMPY_MAX:
        return int(rng.hypergeometric(good, bad, sample))
    n = good + bad
    lo, hi = max(0, sample - bad), min(good, sample)
    mode = min(hi, max(lo, (sample + 1) * (good + 1) // (n + 2)))
    dev = math.sqrt(max(1.0, sample * (good / n) * (bad / n) * ((n - sample) / max(1, n - 1))))
    a, b = max(lo, mode - int(14 * dev) - 30), min(hi, mode + int(14 * dev) + 30)
    k = np.arange(a, b, dtype=np.float64)
    step = np.log(good - k) + np.log(sample - k) - np.log(k + 1) - np.log(bad - sample + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(step)])
    cdf = np.cumsum(np.exp(logs - logs.max()))
    return a + int(min(np.searchsorted(cdf, rng.random() * cdf[-1], side="right"), b - a))


def split_columns(rng: np.random.Generator, cells: np.ndarray, left: int) -> np.ndarray:
    """How much of each column the left half gets when it holds `left` of all rows."""
    if cells.sum() < NUMPY_MAX:
        return rng.multivariate_hypergeometric(cells, left, method="marginals")
    out = np.zeros_like(cells)
    rest = int(cells.sum())
    for j, c in enumerate(cells.tolist()):
        if left == 0:
            break
        out[j] = got = hypergeometric(rng, c, rest - c, left)
        left -= got
        rest -= c
    return out


def matrix_row(sizes: np.ndarray, cells: np.ndarray, block: int, seed: int) -> np.ndarray:
    """Row `block` of the communication matrix; rows drawn apart add up to the column sums."""
    lo, hi = 0, len(sizes)
    total = np.concatenate([[0], np.cumsum(sizes)])
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, lo, hi])))
        left = split_columns(rng, cells, int(total[mid] - total[lo]))
        lo, hi, cells = (lo, mid, left) if block < mid else (mid, hi, cells - left)
    return cells


def even(total: int, parts: int) -> np.ndarray:
    """Sizes that differ by one at most."""
    return np.diff(np.arange(parts + 1, dtype=np.int64) * total // parts)


def blocks_of(batches: Iterator[pa.RecordBatch], sizes: int, rows: int, limit: int) -> Iterator[pa.Table]:
    """A partition in blocks of at most `rows` rows that end once they hold `limit` bytes, as column `sizes` has it."""
    held, n, size = [], 0, 0
    for b in batches:
        weights = np.cumsum(b.column(sizes).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            before = int(weights[at - 1]) if at else 0
            end = int(np.searchsorted(weights, before + limit - size)) + 1
            end = min(b.num_rows, end, at + rows - n)
            held.append(b.slice(at, end - at))
            n, size, at = n + end - at, size + int(weights[end - 1]) - before, end
            if n >= rows or size >= limit:
                yield pa.Table.from_batches(held)
                held, n, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def shuffle_into_shards(docs: DataFrame, n_shards: int = 16, seed: int = 42, block_rows: int = 8192, block_bytes: int = 16 << 20, max_cells: int = 4096, text_col: str = "text") -> DataFrame:
    """(row, shard, slot): every row of docs, whole, as a struct; counts of the shards differ by one at most.

    docs must give the same partitions in the same order when read again, as files do; a task that finds a block of
    another size fails. Cells are permuted by the sort of a drawn key, which spills, so their size is not bounded by
    memory. Null ids and texts are rows like any other, repeated rows each get a slot, a very long text is a block of
    its own; an empty table gives an empty result; columns may have any names. Fewer rows than shards leave some
    shards empty.
    """
    size = F.octet_length(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).cast("long")
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), size.alias("size"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for i, b in enumerate(blocks_of(batches, 0, block_rows, block_bytes)):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([i], pa.int32()), pa.array([len(b)], pa.int64())], ["part", "i", "n"])

    found = sorted(tuple(r) for r in sized.select("size").mapInArrow(counted, "part int, i int, n long").collect())  # a row a block
    sizes = np.array([n for _, _, n in found], np.int64)
    first = dict(zip([(p, i) for p, i, _ in found], range(len(found)), strict=True))
    total = int(sizes.sum())
    per_shard = max(1, min(max_cells // n_shards, math.ceil(total / n_shards / block_rows)))
    cells = np.concatenate([even(int(s), per_shard) for s in even(total, n_shards)])
    sent = docs.sparkSession.sparkContext.broadcast((sizes, first, cells))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, (sizes, number, cells) = TaskContext.get().partitionId(), sent.value
        for i, b in enumerate(blocks_of(batches, 1, block_rows, block_bytes)):
            block = number.get((part, i), -1)
            if block < 0 or sizes[block] != len(b):
                raise ValueError("the table gives other partitions than when its rows were counted")
            rng = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, 1, block])))
            to = np.repeat(np.arange(len(cells), dtype=np.int32), matrix_row(sizes, cells, block, seed))[rng.permutation(len(b))]
            rows = b.select(["row"]).append_column("cell", pa.array(to, pa.int32())).append_column("key", pa.array(rng.integers(0, 1 << 63, len(b))))
            yield from rows.combine_chunks().to_batches()

    from pyspark.sql.types import IntegerType, LongType, StructType

    dealt = sized.mapInArrow(deal, StructType([sized.schema["row"]]).add("cell", IntegerType()).add("key", LongType()))
    shard, at = F.floor(F.col("cell") / per_shard), F.col("cell") % per_shard
    start = lambda k, n, parts: F.floor(k.cast("decimal(38,0)") * n / parts).cast("long")
    rows_of = start(shard + 1, F.lit(total), n_shards) - start(shard, F.lit(total), n_shards)
    place = F.row_number().over(Window.partitionBy("cell").orderBy("key")) - 1
    return dealt.select("row", shard.cast("int").alias("shard"), (start(at, rows_of, per_shard) + place).cast("long").alias("slot"))


def op1_hypergeometric_shards(spark, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("row.text"), F.lit("")).cast("binary")
    out = shuffle_into_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("row.doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
