"""Bootstraps of group centroids with all replicates in one pass, and their correlation with gold distances.

A replicate is a vector of multiplicities: how often each row of a group was drawn. A task multiplies its rows by the
multiplicities of all replicates at once and sends one sum for each group (dense rows), or adds up products of groups over
the terms that it holds (sparse rows); these meet, and distances of all replicates come out. Rows are drawn by hash, so that a replicate does not
depend on partitions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions import vectors as V
from glossa.operators import statistics as S
from glossa.operators.relational import drawn

#: Replicates whose dense centroids meet in one task, bytes of multiplicities in a cell of a sparse one, and weights that
#: it adds up at once.
BLOCK, HELD_BYTES, SLICE = 50, 128 << 20, 4096
#: Rows of a group whose multiplicities travel together, and weights that do.
WIDTH, PIECE = 2048, 1024


def numbered(rows: DataFrame, code: str, order: list[str]) -> DataFrame:
    """rows with their position in their group as `idx`, from 0."""
    return rows.withColumn("idx", (F.row_number().over(Window.partitionBy(code).orderBy(*order)) - 1).cast("long"))


def drawn_blocks(sizes: DataFrame, by: list[str], iterations: int, seed: str, observed: bool = False) -> DataFrame:
    """(by, block, b, counts): how often replicate b draws the rows block * WIDTH and following of a group, a byte a row.

    sizes: (by, n). With `observed`, replicate -1 has every row once. A replicate of a group is drawn in one task, which
    holds one number a row; no draw crosses the network as a row of its own.
    """
    spark = sizes.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    each = sizes.where("n > 0").select(*by, F.col("n").cast("long").alias("n"), F.explode(F.sequence(F.lit(-1 if observed else 0), F.lit(iterations - 1))).alias("b"))
    each = each.repartition(tasks, *by, "b").withColumn("run", F.monotonically_increasing_id())
    each = each.select("run", *by, "n", "b", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("k"))
    rows = each.select("run", F.when(F.col("b") < 0, F.col("k").cast("long")).otherwise(drawn(seed, by, "n")).cast("int").alias("idx"), "n", "b", *by)
    kinds = "".join(f"`{c}` {sizes.schema[c].dataType.simpleString()}, " for c in by)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, head, held = None, None, []

        def cut() -> pa.RecordBatch:
            n = head.column(2)[0].as_py()
            counts = np.bincount(np.concatenate(held), minlength=n)
            if counts.max() > 255:
                raise OverflowError("a row was drawn more than 255 times in one replicate")
            counts = counts.astype(np.uint8)
            at = range(0, n, WIDTH)
            same = pa.array(np.zeros(len(at), np.int64))
            return pa.RecordBatch.from_arrays([*[c.take(same) for c in head.columns[4:]], pa.array(range(len(at)), pa.int32()), head.column(3).take(same), pa.array([counts[k : k + WIDTH].tobytes() for k in at], pa.binary())], [*by, "block", "b", "counts"])

        for batch in batches:
            runs, idx = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            starts = [0, *(np.flatnonzero(np.diff(runs)) + 1).tolist(), len(runs)] if len(runs) else []
            for a, z in zip(starts, starts[1:], strict=False):
                if runs[a] != run:
                    if held:
                        yield cut()
                    run, head, held = runs[a], batch.slice(a, 1), []
                held.append(idx[a:z].copy())
        if held:
            yield cut()

    return rows.mapInArrow(count, f"{kinds}block int, b int, counts binary")


def resampled_sums(rows: DataFrame, by: list[str], keys: list[str], values: str, sizes: DataFrame, iterations: int, seed: str, observed: bool = False) -> DataFrame:
    """(by, keys, b, sums): sums of the arrays `values` of each group and key over the rows that each replicate draws,
    in parts that are still to be added up, one from each WIDTH rows.

    rows: (by, idx, keys, values), arrays of one length; sizes: (by, n), groups without one are left out. A task holds
    the multiplicities of WIDTH rows in all replicates; keys are few.
    """
    placed = rows.select(*by, F.floor(F.col("idx") / WIDTH).cast("int").alias("block"), (F.col("idx") % WIDTH).cast("int").alias("at"), *keys, F.col(values).alias("v"))
    blocks = drawn_blocks(sizes, by, iterations, seed, observed)
    types = {c: rows.schema[c].dataType.simpleString() for c in [*by, *keys]}

    def meet(of: pa.Table, drawn: pa.Table) -> pa.Table:
        if not of.num_rows or not drawn.num_rows:
            return pa.Table.from_arrays([*[of.column(c).slice(0, 0) for c in [*by, *keys]], pa.array([], pa.int32()), pa.array([], pa.list_(pa.float64()))], [*by, *keys, "b", "sums"])
        times = np.frombuffer(b"".join(drawn.column("counts").to_pylist()), np.uint8).reshape(drawn.num_rows, -1).astype(float)
        v = of.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(of.num_rows, -1)
        number: dict = {}
        which = np.array([number.setdefault(k, len(number)) for k in zip(*(of.column(c).to_pylist() for c in keys), strict=True)] if keys else [0] * of.num_rows)
        first = np.unique(which, return_index=True)[1]
        whole = np.zeros((times.shape[1], len(first), v.shape[1]))
        np.add.at(whole, (of.column("at").to_numpy(), which), v)
        sums = (times @ whole.reshape(times.shape[1], -1)).reshape(-1, v.shape[1])  # by replicate, then by key
        n = len(sums)
        pick = pa.array(np.tile(first, times.shape[0]))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * v.shape[1]), pa.array(sums.ravel()))
        return pa.Table.from_arrays([*[of.column(c).take(pick) for c in [*by, *keys]], drawn.column("b").take(pa.array(np.repeat(np.arange(times.shape[0]), len(first)))), lists], [*by, *keys, "b", "sums"])

    met = placed.groupBy(*by, "block").cogroup(blocks.groupBy(*by, "block"))
    return met.applyInArrow(meet, ", ".join(f"`{c}` {t}" for c, t in types.items()) + ", b int, sums array<double>")


def dense_replicates(rows: DataFrame, code: str, iterations: int, seed: str) -> DataFrame:
    """(it, a, b, d): cosine distances, a < b, between the centroids of each replicate. rows: (code, idx, vec).

    A group's vectors have one length. Memory of a task: a block of BLOCK replicates of all groups, a vector for each
    WIDTH rows.
    """
    kind = rows.schema[code].dataType.simpleString()
    sizes = rows.groupBy(code).agg(F.count(F.lit(1)).alias("n"))

    def meet(table: pa.Table) -> pa.Table:
        codes = sorted(set(table.column(code).to_pylist()))
        its = table.column("b").to_numpy()
        at, n = int(its.min()), len(set(its.tolist()))
        v = table.column("sums").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        u = np.zeros((n, len(codes), v.shape[1]))
        place = {c: k for k, c in enumerate(codes)}
        np.add.at(u, (its - at, [place[c] for c in table.column(code).to_pylist()]), v)
        u = u / np.maximum(np.linalg.norm(u, axis=2, keepdims=True), 1e-300)
        d = np.maximum(0, 1 - u @ u.transpose(0, 2, 1))
        i, j = np.triu_indices(len(codes), 1)
        type_ = table.schema.field(code).type
        name = lambda which: pa.array([codes[k] for k in np.tile(which, n).tolist()], type_)
        return pa.Table.from_arrays([pa.array(np.repeat(np.arange(at, at + n), len(i)).astype(np.int32)), name(i), name(j), pa.array(d[:, i, j].ravel())], ["it", "a", "b", "d"])

    sums = resampled_sums(rows, [code], [], "vec", sizes, iterations, seed)
    return sums.groupBy(F.floor(F.col("b") / BLOCK)).applyInArrow(meet, f"it int, a {kind}, b {kind}, d double")


def sparse_replicates(rows: DataFrame, weights: DataFrame, code: str, iterations: int, seed: str, observed: bool = False) -> DataFrame:
    """(it, a, b, d): cosine distances, a < b, between the sparse centroids of each replicate; with `observed`, also of
    all rows as they are, as it = -1.

    rows: (code, idx, id); weights: (id, term, w). Neither centroids nor sums of terms are ever stored: a term's weights
    and the multiplicities of some replicates meet in a cell, one of few by few, so each is sent only as often as there
    are cells in a row. A cell holds the multiplicities of all rows in its replicates, at most HELD_BYTES, and adds up
    products of groups term by term. A row for each group comes to the driver.
    """
    spark = rows.sparkSession
    kind = rows.schema[code].dataType.simpleString()
    sizes = rows.where(F.col(code).isNotNull()).groupBy(code).agg(F.count(F.lit(1)).alias("n"))
    groups = sizes.orderBy(code).collect()
    codes, n = [r[code] for r in groups], np.array([r["n"] for r in groups], np.int64)
    start = np.cumsum(n) - n
    first, total = dict(zip(codes, start.tolist(), strict=True)), int(n.sum())
    side = math.ceil(math.sqrt(2 * spark.sparkContext.defaultParallelism))
    by_replicate = min(iterations + 1, max(side, -(-total * (iterations + 1) // HELD_BYTES)))
    per = -(-(iterations + 1) // by_replicate)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Weights sorted by term as numbers: the term's in this part, the row's, the weight."""
        from pyspark import TaskContext

        part, last, number, seq = TaskContext.get().partitionId(), None, -1, 0
        for b in batches:
            if not b.num_rows:
                continue
            at = pa.array([first[c] for c in b.column(0).unique().to_pylist()], pa.int64())
            row = b.column(1).to_numpy() + at.take(b.column(0).dictionary_encode().indices).to_numpy()
            terms = b.column(2)
            other = np.append(terms[0].as_py() != last, pc.not_equal(terms[1:], terms[:-1]).to_numpy(zero_copy_only=False))
            term = number + np.cumsum(other)
            last, number = terms[-1].as_py(), int(term[-1])
            w = b.column(3).to_numpy()
            at = range(0, len(w), PIECE)
            data = [term[k : k + PIECE].astype("<i4").tobytes() + row[k : k + PIECE].astype("<i4").tobytes() + w[k : k + PIECE].astype("<f8").tobytes() for k in at]
            numbers = np.full(len(at), part % side), np.full(len(at), part), seq + np.arange(len(at))
            seq += len(at)
            yield pa.RecordBatch.from_arrays([*map(pa.array, numbers), pa.array(data, pa.binary())], ["t", "part", "seq", "data"])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, type_ = None, None
        for b in batches:
            type_ = b.schema.field(5).type
            for r, t, is_term, x, y, c, data in zip(*(c.to_pylist() for c in b.columns[:6]), (x.as_py() for x in b.column(6)), strict=True):
                if cell is None or cell.at != (r, t):
                    if cell is not None:
                        yield cell.products(codes, type_, by_replicate)
                    cell = _Cell((r, t), start, total, per)
                if is_term:
                    cell.weigh(x, data)
                else:
                    k = first[c] + y * WIDTH
                    cell.times[k : k + len(data), x] = np.frombuffer(data, np.uint8)
        if cell is not None:
            yield cell.products(codes, type_, by_replicate)

    met = rows.where(F.col(code).isNotNull()).select(code, "idx", "id").join(weights.hint("merge"), "id").select(code, "idx", "term", "w")
    terms = met.repartition("term").sortWithinPartitions("term").mapInArrow(packed, "t long, part long, seq long, data binary")
    terms = terms.select(F.explode(F.sequence(F.lit(0), F.lit(by_replicate - 1))).alias("r"), F.col("t").cast("int").alias("t"), F.lit(1).alias("is_term"), "part", "seq", F.lit(None).cast(kind).alias("c"), "data")
    b = F.col("b") + 1
    times = drawn_blocks(sizes, [code], iterations, seed, observed)
    times = times.select((b % by_replicate).alias("r"), F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias("t"), F.lit(0).alias("is_term"), F.floor(b / by_replicate).alias("part"), F.col("block").cast("long").alias("seq"), F.col(code).alias("c"), F.col("counts").alias("data"))
    sent = terms.unionByName(times).repartition(2 * by_replicate * side, "r", "t").sortWithinPartitions("r", "t", "is_term", "part", "seq")
    parts = sent.mapInArrow(cells, f"it int, a {kind}, b {kind}, x double")
    dots = parts.groupBy("it", "a", "b").agg(F.sum("x").alias("x")).persist()  # a row for each replicate and pair of groups, read three times
    lengths = dots.where("a = b AND x > 0").select("it", "a", F.sqrt("x").alias("len"))
    la, lb = lengths.withColumnRenamed("len", "la"), lengths.withColumnsRenamed({"a": "b", "len": "lb"})
    pairs = la.join(lb, "it").where("a < b").join(dots, ["it", "a", "b"], "left")  # groups that share no term are at distance 1
    return pairs.select("it", "a", "b", F.greatest(F.lit(0.0), 1 - F.coalesce("x", F.lit(0.0)) / (F.col("la") * F.col("lb"))).alias("d"))


class _Cell:
    """Some terms in some replicates: products of the groups' sums of a term, added up over the terms."""

    def __init__(self, at: tuple[int, int], start: np.ndarray, rows: int, per: int):
        self.at, self.start = at, start
        self.times = np.zeros((rows, per), np.uint8)
        self.total = np.zeros((per, len(start), len(start)))
        self.part, self.left = None, (np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0))

    def weigh(self, part: int, data: bytes) -> None:
        """Weights of the next terms; the last term may go on in the next piece of the same part."""
        k = len(data) // 16
        here = np.frombuffer(data, "<i4", k), np.frombuffer(data, "<i4", k, 4 * k), np.frombuffer(data, "<f8", k, 8 * k)
        if part != self.part:
            self.add(*self.left)
            self.part, self.left = part, tuple(x[:0] for x in self.left)
        self.left = here = tuple(np.concatenate(x) for x in zip(self.left, here, strict=True))
        if len(here[0]) < 2 * SLICE or here[0][0] == here[0][-1]:
            return
        cut = np.searchsorted(here[0], here[0][-1])
        self.add(*(x[:cut] for x in here))
        self.left = tuple(x[cut:] for x in here)

    def add(self, term: np.ndarray, row: np.ndarray, w: np.ndarray) -> None:
        if not len(term):
            return
        n_groups = len(self.start)
        group = np.searchsorted(self.start, row, "right") - 1
        key = (term - term[0]).astype(np.int64) * n_groups + group
        order = np.argsort(key, kind="stable")
        keys, of = np.unique(key[order], return_inverse=True)
        row, w = row[order], w[order]
        sums = np.zeros((len(keys), self.times.shape[1]))
        for k in range(0, len(of), SLICE):
            some = of[k : k + SLICE]
            first = np.flatnonzero(np.diff(some, prepend=-1))
            sums[some[first]] += np.add.reduceat(self.times[row[k : k + SLICE]] * w[k : k + SLICE, None], first)
        term, group = keys // n_groups, keys % n_groups
        begin = np.flatnonzero(np.diff(term, prepend=-1))
        size = np.diff(np.append(begin, len(term)))
        alone = np.repeat(size == 1, size)
        for g in np.unique(group[alone]).tolist():
            x = sums[alone & (group == g)]
            self.total[:, g, g] += np.einsum("ij,ij->j", x, x)
        sums, term, group = sums[~alone], np.repeat(np.arange((size > 1).sum()), size[size > 1]), group[~alone]
        step = max(1, SLICE // n_groups)
        for k in range(0, int(term[-1]) + 1 if len(term) else 0, step):
            a, z = np.searchsorted(term, [k, k + step])
            u = np.zeros((min(step, int(term[-1]) + 1 - k), n_groups, sums.shape[1]))
            u[term[a:z] - k, group[a:z]] = sums[a:z]
            self.total += np.matmul(u.transpose(2, 1, 0), u.transpose(2, 0, 1))

    def products(self, codes: list, type_: pa.DataType, step: int) -> pa.RecordBatch:
        """(it, a, b, x), a <= b, of the pairs that share a term."""
        self.add(*self.left)
        i, j = np.triu_indices(len(codes))
        x = self.total[:, i, j].ravel()
        it = np.repeat(np.arange(len(self.total)) * step + self.at[0] - 1, len(i))
        some = np.flatnonzero(x)
        name = lambda k: pa.array(codes, type_).take(pa.array(np.tile(k, len(self.total))[some]))
        return pa.RecordBatch.from_arrays([pa.array(it[some].astype(np.int32)), name(i), name(j), pa.array(x[some])], ["it", "a", "b", "x"])


def against_gold(replicates: DataFrame, observed: DataFrame | None, golds: DataFrame, role: Callable[[Column], Column], alpha: float = 0.05) -> DataFrame:
    """(gold, block, rho_observed, rho_mean, rho_lo, rho_hi, n_boot): rank correlation with each gold, over all pairs and
    over those of a dialect and an external group.

    replicates: (it, a, b, d), observed: (a, b, d) or None where replicate -1 is it, golds: (gold, a, b, g), all with a < b. A replicate without a
    correlation (fewer than three shared pairs, or no variance) is left out; a gold without any keeps a row of nulls.
    """
    both = replicates.select("it", "a", "b", "d")
    both = both if observed is None else both.unionByName(observed.select(F.lit(-1).alias("it"), "a", "b", "d"))
    pairs = S.blocks(both.join(golds, ["a", "b"]), role(F.col("a")), role(F.col("b")))
    rho = S.spearman(pairs, ["gold", "block", "it"], "d", "g")
    seen = rho.where("it = -1").select("gold", "block", F.col("rho").alias("rho_observed"))
    summary = S.bootstrap_summary(rho.where("it >= 0"), ["gold", "block"], "rho", alpha)
    every = golds.select("gold").distinct().withColumn("block", F.explode(F.array(F.lit("full"), F.lit("dialect_external"))))
    out = every.join(seen, ["gold", "block"], "left").join(summary, ["gold", "block"], "left")
    return out.select("gold", "block", "rho_observed", F.col("mean").alias("rho_mean"), F.col("lo").alias("rho_lo"), F.col("hi").alias("rho_hi"), F.coalesce("n_boot", F.lit(0)).cast("long").alias("n_boot"))


def sparse_bootstrap(texts: DataFrame, code: str, weights: DataFrame, golds: DataFrame, role: Callable[[Column], Column], iterations: int = 1000, seed: str = "42") -> DataFrame:
    """`against_gold` for n-gram TF-IDF: texts (code, id), one row a text, and their weights (id, term, w)."""
    rows = numbered(texts.select(code, "id"), code, ["id"]).persist()
    return against_gold(sparse_replicates(rows, weights, code, iterations, seed, observed=True), None, golds, role)


def dense_bootstrap(vecs: DataFrame, code: str, order: list[str], golds: DataFrame, role: Callable[[Column], Column], dims: int, iterations: int = 1000, seed: str = "42") -> DataFrame:
    """`against_gold` for vectors of `dims` numbers: (code, order, vec), one row a sentence."""
    rows = numbered(vecs.select(code, *order, "vec"), code, order)
    observed = V.cosine_distances(V.centroids(vecs, [code], "vec", dims), code).where("a < b")
    return against_gold(dense_replicates(rows, code, iterations, seed), observed, golds, role)


def run_method(spark, model_path: str, out_path: str, vectors_of: Callable[[DataFrame], DataFrame], golds: DataFrame, role: Callable[[Column], Column], dims: int, iterations: int = 1000, seed: str = "42", skip_existing: bool = True) -> DataFrame:
    """The bootstrap of one method from its stored model: `vectors_of` turns the model table at model_path into
    (code, id, vec). Nothing is trained here: a missing model is an error; a finished result is read, not made again."""
    if skip_existing and exists(spark, f"{out_path}/_SUCCESS"):
        return spark.read.parquet(out_path)
    if not exists(spark, model_path):
        raise FileNotFoundError(f"no trained model at {model_path}; bootstraps never train one")
    dense_bootstrap(vectors_of(spark.read.parquet(model_path)), "code", ["id"], golds, role, dims, iterations, seed).write.mode("overwrite").parquet(out_path)
    return spark.read.parquet(out_path)


def exists(spark, path: str) -> bool:
    """Whether a file or folder is there, in whatever store Spark reads it from."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
