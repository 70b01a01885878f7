"""Encoders of texts as vectors: pluggable, with a deterministic hashing encoder and a trained word model."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions import text
from glossa.functions import vectors as V


class HashingEncoder:
    """Mean of signed hashes of a text's character n-grams, length one: needs no model and no network."""

    def __init__(self, dims: int = 64, sizes: tuple[int, ...] = (3, 4, 5)):
        self.dims, self.sizes = dims, sizes

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        for row, t in zip(out, texts, strict=True):
            for w in t.split():
                w = f" {w} "
                for n in self.sizes:
                    for i in range(max(1, len(w) - n + 1)):
                        h = zlib.crc32(w[i : i + n].encode())
                        row[h % self.dims] += 1 if h >> 31 else -1
            row /= np.linalg.norm(row) or 1
        return out


def encode(df: DataFrame, ids: list[str], text_col: str, make_encoder: Callable[[], object], batch: int = 256) -> DataFrame:
    """(ids, vec): texts through an encoder that each worker makes once. Any object with encode(list) will do."""
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make_encoder()
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                vecs = encoder.encode([t or "" for t in part.column(len(ids)).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(ids)], pa.array(list(vecs), pa.list_(pa.float64()))], [*ids, "vec"])

    return df.select(*ids, text_col).mapInArrow(run, f"{kinds}, vec array<double>")


def word_model(df: DataFrame, text_col: str, dims: int = 32, window: int = 5, min_count: int = 2, iterations: int = 1, seed: int = 42, partitions: int = 8):
    """A skip-gram word model fitted on the letter tokens of a column, in so many tasks whose vectors are averaged."""
    from pyspark.ml.feature import Word2Vec

    tokens = df.select(text.letter_tokens(F.lower(text_col)).alias("tokens")).where(F.size("tokens") > 0)
    return Word2Vec(vectorSize=dims, windowSize=window, minCount=min_count, maxIter=iterations, seed=seed, numPartitions=partitions, inputCol="tokens", outputCol="vec").fit(tokens)


def pooled(df: DataFrame, ids: list[str], text_col: str, vectors: DataFrame, dims: int, zero_fill: bool = False) -> DataFrame:
    """(ids, vec): mean of the word vectors of each row. Rows without a known word are dropped, or zero on request."""
    tokens = df.select(*ids, F.explode(text.letter_tokens(F.lower(text_col))).alias("word"))
    out = tokens.join(vectors, "word").groupBy(*ids).agg(V.mean_of("vec", dims).alias("vec"))
    if not zero_fill:
        return out
    zeros = F.array(*[F.lit(0.0)] * dims)
    return df.select(*ids).join(out, ids, "left").withColumn("vec", F.coalesce("vec", zeros))


def subword_table(vectors: DataFrame, dims: int, sizes: tuple[int, ...] = (3, 4, 5, 6), buckets: int = 1 << 16) -> DataFrame:
    """(bucket, vec): hashed subword vectors, each the mean of the words that hold the subword; a stand-in for
    jointly trained subwords that also covers unseen words."""
    return vectors.select(F.explode(subwords(F.col("word"), sizes, buckets)).alias("bucket"), "vec").groupBy("bucket").agg(V.mean_of("vec", dims).alias("vec"))


def subwords(word, sizes: tuple[int, ...], buckets: int):
    w = F.concat(F.lit("<"), word, F.lit(">"))
    grams = F.flatten(F.transform(F.array(*map(F.lit, sizes)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, n))))
    return F.transform(F.array_distinct(grams), lambda g: F.pmod(F.crc32(g.cast("binary")), F.lit(buckets)))
