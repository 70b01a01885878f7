"""Sentence vectors from encoders with a state for each token: truncation, masked mean pooling, centring, length one.

An encoder is any object with `states(texts, max_length)`, which returns an array (texts, positions, dimensions) and a
mask (texts, positions) of the positions that count. Each worker makes its own once. Models that run on accelerators
plug in here; `HashedTokens` needs neither a model nor a network.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions import vectors as V

#: Positions of an encoder of tokens and of one of characters, and texts that it is given at once.
TOKENS, CHARACTERS, BATCH = 128, 512, 32


class HashedTokens:
    """A token's state is what the MD5 of the token (of token and block number from the second 16 dimensions on) says,
    from -1 to 1; tokens are words between white space, or characters."""

    def __init__(self, dims: int = 16, characters: bool = False):
        self.dims, self.characters, self.known = dims, characters, {}

    def state(self, token: str) -> np.ndarray:
        if token not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            blocks = [hashlib.md5((token if not k else f"{token}#{k}").encode()).digest() for k in range(-(-self.dims // 16))]
            self.known[token] = np.frombuffer(b"".join(blocks), np.uint8)[: self.dims] / 127.5 - 1
        return self.known[token]

    def states(self, texts: list[str], max_length: int) -> tuple[np.ndarray, np.ndarray]:
        tokens = [list(t)[:max_length] if self.characters else t.split()[:max_length] for t in texts]
        longest = max(map(len, tokens), default=0)
        out, mask = np.zeros((len(texts), longest, self.dims)), np.zeros((len(texts), longest))
        for i, ts in enumerate(tokens):
            mask[i, : len(ts)] = 1
            for j, t in enumerate(ts):
                out[i, j] = self.state(t)
        return out, mask


def pooled(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The mean of the states that count; zeros where none does."""
    return np.einsum("bld,bl->bd", states, mask) / np.maximum(mask.sum(1, keepdims=True), 1e-9)


def encode(df: DataFrame, ids: list[str], text_col: str, make_encoder: Callable[[], object], dims: int, max_length: int = TOKENS, centre: bool = False, normalise: bool = True, batch: int = BATCH) -> DataFrame:
    """(ids, vec): texts as vectors of `dims` numbers.

    What is beyond max_length positions is cut, as encoders do. With centre the mean vector of all rows is taken off,
    which needs a second pass over the vectors, before they get length one; a zero vector stays zero. Nulls are empty
    texts. A text's vector does not depend on the texts beside it in a batch.
    """
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make_encoder()
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                vecs = pooled(*encoder.states([t or "" for t in part.column(len(ids)).to_pylist()], max_length))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(ids)], pa.array(vecs.reshape(part.num_rows, dims).tolist(), pa.list_(pa.float64()))], [*ids, "vec"])

    out = df.select(*ids, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"{kinds}, vec array<double>")
    if centre:
        out = out.persist(StorageLevel.MEMORY_AND_DISK)  # models are costly: the second pass reads what the first made
        mean = out.agg(V.mean_of("vec", dims).alias("_mean"))
        out = out.join(F.broadcast(mean)).select(*ids, F.zip_with("vec", "_mean", lambda x, m: x - m).alias("vec"))  # one row
    return out.withColumn("vec", V.unit(F.col("vec"))) if normalise else out


def group_centroids(vecs: DataFrame, code: str, dims: int) -> DataFrame:
    """(code, vec, n): the mean of each group's vectors."""
    return vecs.groupBy(code).agg(V.mean_of("vec", dims).alias("vec"), F.count(F.lit(1)).alias("n"))
