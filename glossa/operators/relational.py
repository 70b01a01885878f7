"""Dedup, sampling, ranking, set and assembly operators over long tables with an explicit order."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.functions.md5 import Stream


def hashed(*parts: Column | str) -> Column:
    """A number below 2^32 from the MD5 of dash-joined parts: the engine's only source of randomness."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *[p if isinstance(p, Column) else F.lit(p) for p in parts]).cast("binary")), 1, 8), 16, 10).cast("long")


def order_key(seed: str, *cols: str) -> Column:
    return F.md5(F.concat_ws("-", F.lit(seed), *[F.col(c).cast("string") for c in cols]).cast("binary"))


def drop_all_copies(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys occur once; the others go, every copy. Keys are counted narrow, then semi-joined."""
    single = df.groupBy(*keys).count().where("count = 1").select(*keys)
    return df.join(single, keys, "left_semi")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in an explicit order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def drop_frequent(df: DataFrame, by: list[str], key: Column, limit: int = 10) -> DataFrame:
    """Rows whose key occurs fewer than limit times within `by`; frequent clusters go whole.

    Frequent keys are found by a combined count and removed by an anti join, so a hot key is never one task's rows.
    """
    marked = df.withColumn("_k", key)
    frequent = marked.groupBy(*by, "_k").count().where(F.col("count") >= limit).select(*by, "_k")
    return marked.join(frequent, [*by, "_k"], "left_anti").drop("_k")


def sample_n(df: DataFrame, by: list[str], n: int, seed: str, keys: list[str]) -> DataFrame:
    """n rows of each group without replacement, or all: the first by hash of the row's keys."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(order_key(seed, *keys), *keys))).where(F.col("_n") <= n).drop("_n")


def capped_union(seed_rows: DataFrame, more: DataFrame, by: str, cap: int, seed: str, keys: list[str]) -> DataFrame:
    """All seed rows of a group, then a sample of the others up to cap; the seed is never cut."""
    rows = seed_rows.withColumn("priority", F.lit(0)).unionByName(more.withColumn("priority", F.lit(1)))
    n_seed = F.sum(1 - F.col("priority")).over(Window.partitionBy(by))
    at = F.row_number().over(Window.partitionBy(by).orderBy("priority", order_key(seed, *keys), *keys))
    return rows.withColumn("_seeds", n_seed).withColumn("_n", at).where(F.col("_n") <= F.greatest(F.lit(cap), F.col("_seeds"))).drop("_n", "_seeds")


#: Bytes of a group's texts that one task takes; a larger group is read slice by slice.
SLICE = 64 << 20


def ordered_checksum(df: DataFrame, by: str, order: list[str], text: str, size: int = SLICE) -> DataFrame:
    """(by, checksum): MD5 of each group's texts in order, each ended by a line feed.

    A digest of an ordered stream is sequential by nature, but no task need read it all. A group of at most `size` bytes
    passes through one task, one text at a time. Larger ones, which are few, are cut by their order into slices, and a
    slice's task goes on from the 92 bytes of state that the one before ended with. Null texts are left out; a group
    without any has no checksum; ties are ordered by text.
    """
    rows = df.select(by, text, *order)
    bytes_of = rows.groupBy(by).agg(F.sum(F.octet_length(text) + 1).alias("n"))
    large = [(r[0], r["n"]) for r in bytes_of.where(F.col("n") > size).collect()]
    if not large:
        return _whole_checksums(rows, by, order, text)
    keys = [k for k, _ in large]
    far = F.coalesce(F.col(by).isin([k for k in keys if k is not None]), F.lit(None in keys))
    few = _sliced_checksums(rows.where(far & F.col(text).isNotNull()), by, order, text, sum(-(-n // size) for _, n in large))
    schema = T.StructType([T.StructField(by, df.schema[by].dataType), T.StructField("checksum", T.StringType())])
    return _whole_checksums(rows.where(~far), by, order, text).unionByName(df.sparkSession.createDataFrame(few, schema))


def _sliced_checksums(rows: DataFrame, by: str, order: list[str], text: str, slices: int) -> list[tuple]:
    """(key, checksum) of the groups of an ordered table, read one slice after another; it is exchanged once.

    The beginning of a text takes part in the cut, so that rows of equal order do not all fall into one slice."""
    ordered = rows.repartitionByRange(slices, by, *order, F.substring(text, 1, 32)).sortWithinPartitions(by, *order, text).select(by, text).rdd
    done: list[tuple] = []
    at: tuple | None = None
    for k in range(ordered.getNumPartitions()):
        *ended, at = rows.sparkSession.sparkContext.runJob(ordered, _slice_reader(at), [k])
        done += [(key, Stream(state).hexdigest()) for key, state in ended]
    return done + ([(at[0], Stream(at[1]).hexdigest())] if at else [])


def _slice_reader(before: tuple | None) -> Callable[[Iterator], list]:
    """Reads a slice on from (key, state): groups that ended in it, and last the one that may go on."""

    def run(texts: Iterator) -> list:
        out: list = []
        at, digest, held, n = before[0] if before else None, Stream(before[1]) if before else None, [], 0
        for key, t in texts:
            if digest is None or key != at:
                if digest is not None:
                    digest.update(b"".join(held))
                    out.append((at, digest.state))
                at, digest, held, n = key, Stream(), [], 0
            held += [t.encode(), b"\n"]
            n += len(held[-2]) + 1
            if n > 1 << 20:
                digest.update(b"".join(held))
                held, n = [], 0
        if digest is not None:
            digest.update(b"".join(held))
        return [*out, (at, digest.state) if digest is not None else None]

    return run


def _whole_checksums(rows: DataFrame, by: str, order: list[str], text: str) -> DataFrame:
    kind = rows.schema[by].dataType.simpleString()
    rows = rows.repartition(by).sortWithinPartitions(by, *order, text).select(by, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, at, digest, some = False, None, None, False

        def one() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], type_), pa.array([digest.hexdigest() if some else None], pa.string())], [by, "checksum"])

        for b in batches:
            type_ = b.schema.field(0).type
            for key, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if not begun or key != at:
                    if begun:
                        yield one()
                    begun, at, digest, some = True, key, hashlib.md5(), False
                if t.is_valid:
                    digest.update(t.as_py().encode())
                    digest.update(b"\n")
                    some = True
        if begun:
            yield one()

    return rows.mapInArrow(run, f"`{by}` {kind}, checksum string")


def drawn(seed: str, by: list[str], n: str) -> Column:
    """Which of a group's n rows draw k of replicate b falls on."""
    return F.pmod(hashed(F.lit(seed), F.col("b").cast("string"), *[F.col(c).cast("string") for c in by], F.col("k").cast("string")), F.col(n)).cast("long")


def draws(strata: DataFrame, by: list[str], n: str, iterations: int, seed: str) -> DataFrame:
    """(by..., b, idx, mult): bootstrap draws with replacement as multiplicities. strata holds the size n of each."""
    each = strata.select(*by, n, F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("b")).select(*by, n, "b", F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1)).alias("k"))
    return each.withColumn("idx", drawn(seed, by, n)).groupBy(*by, "b", "idx").agg(F.count(F.lit(1)).alias("mult"))


def permuted(codes: DataFrame, code: str, iterations: int, seed: str) -> DataFrame:
    """(b, code, pos, to): a random order of the codes for each iteration; to is the code it stands for."""
    each = codes.select(code, F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("b"))
    at = each.withColumn("pos", F.row_number().over(Window.partitionBy("b").orderBy(F.md5(F.concat_ws("-", F.lit(seed), F.col("b").cast("string"), F.col(code).cast("string")).cast("binary")), code)))
    sorted_codes = codes.select(F.col(code).alias("to"), F.row_number().over(Window.orderBy(code)).alias("pos"))  # one row a group, small by nature
    return at.join(F.broadcast(sorted_codes), "pos")


def nearest(m: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """The k nearest b of each a, ranked by distance, then code."""
    w = Window.partitionBy(*(by or []), "a").orderBy("d", "b")
    return m.where("a <> b").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def average_rank(value: str | Column, by: list[str]) -> Column:
    """Rank with ties averaged, within groups."""
    v = F.col(value) if isinstance(value, str) else value
    over = Window.partitionBy(*by)
    return F.rank().over(over.orderBy(v)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, v)) - 1) / 2


def funnel(df: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """(stage, n): rows that pass each predicate and all before it, counted in one pass."""
    passed, aggs = F.lit(True), []
    for name, p in stages:
        passed = passed & F.coalesce(p, F.lit(False))
        aggs.append(F.count_if(passed).alias(name))
    row = df.agg(*aggs)
    return row.unpivot([], [n for n, _ in stages], "stage", "n")


def aligned(parts: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """Columns of several tables side by side by key. All must have the same keys, else this fails."""
    out = None
    for name, df in parts.items():
        one = df.select(key, F.col(value).alias(name))
        out = one if out is None else out.join(one, key, "full_outer")
    names = list(parts)
    bad = out.where(" OR ".join(f"`{n}` IS NULL" for n in names)).limit(1).count()
    if bad:
        raise ValueError("the tables have different keys or empty values")
    return out


def head_tail(df: DataFrame, order: list[tuple[str, bool]], head: int, tail: int) -> DataFrame:
    """(part, place, df's columns): the first `head` rows in an order of (column, descending), and the last `tail`,
    placed from 1 in that order within each part. Each is a bounded sort; a short table's rows may be in both."""
    keys = [F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in order]
    back = [F.asc_nulls_first(c) if down else F.desc_nulls_first(c) for c, down in order]
    place = F.row_number().over(Window.orderBy(*keys))  # of head or tail rows
    parts = [df.orderBy(*by).limit(n).withColumn("place", place).withColumn("part", F.lit(part)) for part, by, n in (("head", keys, head), ("tail", back, tail))]
    return parts[0].unionByName(parts[1]).select("part", "place", *[F.col(f"`{c}`") for c in df.columns])


def merged(inputs: dict[str, DataFrame], order: dict[str, list[str]], columns: list[str] | None = None) -> tuple[DataFrame, dict[str, list[str]]]:
    """Tables on top of each other, on given columns or on those that all of them have: (global_id, row_id, dataset,
    columns), and the columns that each table loses. Missing cells are empty; rows are numbered through all tables in
    the order of the names given, `row_id` is `<name>_<place in its table, from 0>`."""
    if columns is None:
        shared = set.intersection(*(set(df.columns) for df in inputs.values()))
        columns = [c for c in next(iter(inputs.values())).columns if c in shared]
    parts = []
    for i, (name, df) in enumerate(inputs.items()):
        at = F.row_number().over(Window.partitionBy(F.lit(name)).orderBy(*order[name]))
        cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns]
        parts.append(df.withColumn("_at", at).select(F.lit(i).alias("_ord"), F.lit(name).alias("dataset"), "_at", *cells))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    sizes = out.groupBy(F.col("_ord").alias("_o")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_o", (F.sum("_n").over(Window.orderBy("_o")) - F.col("_n")).alias("_before"))  # one row a table
    rows = out.join(F.broadcast(before), F.col("_ord") == F.col("_o"))
    lost = {name: [c for c in df.columns if c not in columns] for name, df in inputs.items()}
    return rows.select((F.col("_before") + F.col("_at")).alias("global_id"), F.concat("dataset", F.lit("_"), (F.col("_at") - 1).cast("string")).alias("row_id"), "dataset", *columns), lost
