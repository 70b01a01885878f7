"""Vectors as array<double> columns: norms, products, means and distances without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def unit(v: Column) -> Column:
    """Length one; a zero vector stays as it is."""
    n = norm(v)
    return F.transform(v, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))


def mean_of(v: str, dims: int) -> Column:
    """Element-wise mean as an aggregate: one accumulator per dimension, combined before the exchange."""
    return F.array(*[F.avg(F.col(v)[i].cast("double")) for i in range(dims)])


def sum_of(v: str, dims: int) -> Column:
    return F.array(*[F.sum(F.col(v)[i].cast("double")) for i in range(dims)])


def centroids(df: DataFrame, keys: list[str], v: str, dims: int) -> DataFrame:
    return df.groupBy(*keys).agg(mean_of(v, dims).alias("vec"))


def cosine_distances(c: DataFrame, key: str, by: list[str] | None = None) -> DataFrame:
    """(by..., a, b, d) of every two of a small table of vectors: 0 on the diagonal, never below 0."""
    by = by or []
    u = c.select(*by, key, unit(F.col("vec")).alias("u"))
    x, y = u.alias("x"), u.alias("y")
    on = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in by]
    pairs = x.join(y, on) if on else x.join(y, F.lit(True))
    d = F.when(F.col(f"x.{key}") == F.col(f"y.{key}"), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - dot(F.col("x.u"), F.col("y.u"))))
    return pairs.select(*[F.col(f"x.{k}").alias(k) for k in by], F.col(f"x.{key}").alias("a"), F.col(f"y.{key}").alias("b"), d.alias("d"))
