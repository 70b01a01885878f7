"""Rank correlations, resampling tests and matrix comparisons: all models, golds and iterations in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.operators.relational import average_rank, draws


def spearman(df: DataFrame, by: list[str], x: str, y: str, least: int = 3) -> DataFrame:
    """(by, rho, n): correlation of average ranks within groups; null below `least` rows or without variance."""
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = ok.select(*by, average_rank(x, by).alias("_x"), average_rank(y, by).alias("_y"))
    n = F.count(F.lit(1))
    out = ranked.groupBy(*by) if by else ranked.groupBy()
    flat = (F.stddev_pop("_x") == 0) | (F.stddev_pop("_y") == 0)
    return out.agg(F.when((n >= least) & ~flat, F.corr("_x", "_y")).alias("rho"), n.alias("n"))


def blocks(pairs: DataFrame, role_a: Column, role_b: Column) -> DataFrame:
    """Each unordered pair in block `full`; pairs of a dialect and an external group also in `dialect_external`."""
    cross = ((role_a == "dialect") & (role_b == "external")) | ((role_a == "external") & (role_b == "dialect"))
    return pairs.withColumn("block", F.explode(F.when(cross, F.array(F.lit("full"), F.lit("dialect_external"))).otherwise(F.array(F.lit("full")))))


def correlate_all(model: DataFrame, golds: dict, load, role, least: int = 3) -> DataFrame:
    """(gold, full, dialect_external, n_shared, error) of one model's distances (a, b, d) with every gold: a row for each,
    with the message and no figures where `load(path)`, which gives (a, b, g), fails or lacks a column."""
    spark, out, failed = model.sparkSession, None, []
    for name, path in golds.items():
        try:
            gold = load(path).select(F.lit(name).alias("gold"), "a", "b", F.col("g").cast("double").alias("g"))
            gold.isEmpty()  # a file that cannot be read fails here, not in the middle of the others
            out = gold if out is None else out.unionByName(gold)
        except Exception as e:
            failed.append((name, str(e).splitlines()[0][:300]))
    errors = spark.createDataFrame(failed, "gold string, error string").select("gold", *[F.lit(None).cast("double").alias(c) for c in ("full", "dialect_external")], F.lit(0).cast("long").alias("n_shared"), "error")
    if out is None:
        return errors
    met = model.where("a < b").join(out.where("a < b"), ["a", "b"])
    rho = spearman(blocks(met, role(F.col("a")), role(F.col("b"))), ["gold", "block"], "d", "g", least)
    one = lambda b: F.max(F.when(F.col("block") == b, F.col("rho")))
    wide = rho.groupBy("gold").agg(one("full").alias("full"), one("dialect_external").alias("dialect_external"))
    codes = met.select("gold", F.explode(F.array("a", "b")).alias("c")).groupBy("gold").agg(F.count_distinct("c").alias("n_shared"))
    every = out.select("gold").distinct()
    found = every.join(wide, "gold", "left").join(codes, "gold", "left")
    return found.select("gold", "full", "dialect_external", F.coalesce("n_shared", F.lit(0)).cast("long").alias("n_shared"), F.lit(None).cast("string").alias("error")).unionByName(errors)


def mantel(pairs: DataFrame, perms: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, rho, p): two-sided permutation test of Spearman's rho between x and y over pairs (a, b).

    perms (b, code, to) relabels the groups of x. Ranks do not change by relabelling, so both sides are ranked once.
    """
    ranked = pairs.select(*by, "a", "b", average_rank(x, by).alias("rx"), average_rank(y, by).alias("ry"))
    seen = ranked.groupBy(*by).agg(F.corr("rx", "ry").alias("rho"))
    p = perms.select(F.col("b").alias("it"), "code", "to")
    pa, pb = p.withColumnsRenamed({"code": "a", "to": "ta"}), p.withColumnsRenamed({"code": "b", "to": "tb"})
    moved = ranked.select(*by, "a", "b", "ry").join(pa, "a").join(pb, ["it", "b"]).select(*by, "it", "ry", F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
    rho = moved.join(ranked.select(*by, "a", "b", "rx"), [*by, "a", "b"]).groupBy(*by, "it").agg(F.corr("rx", "ry").alias("r"))
    return rho.join(seen, by).groupBy(*by).agg(F.max("rho").alias("rho"), ((F.count_if(F.abs("r") >= F.abs("rho") - 1e-12) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))


def bootstrap_summary(rhos: DataFrame, by: list[str], value: str, alpha: float = 0.05) -> DataFrame:
    """(by, mean, lo, hi, n_boot) of finite values, with exact interpolated quantiles."""
    q = F.percentile(value, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return rhos.where(F.col(value).isNotNull()).groupBy(*by).agg(F.avg(value).alias("mean"), q.alias("q"), F.count(F.lit(1)).alias("n_boot")).select(*by, "mean", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), "n_boot")


def bonferroni(p: str, by: list[str]) -> Column:
    return F.least(F.col(p) * F.count(F.lit(1)).over(Window.partitionBy(*by)), F.lit(1.0))


def linear_cka(grams: DataFrame) -> DataFrame:
    """One row: linear CKA of two Gram tables (i, j, k, l), centred by their row, column and overall means."""
    centred = lambda c: F.col(c) - F.avg(c).over(Window.partitionBy("i")) - F.avg(c).over(Window.partitionBy("j")) + F.avg(c).over(Window.partitionBy(F.lit(0)))
    x = grams.select(centred("k").alias("k"), centred("l").alias("l"))
    return x.agg((F.sum(F.col("k") * F.col("l")) / F.sqrt(F.sum(F.col("k") * F.col("k")) * F.sum(F.col("l") * F.col("l")))).alias("cka"))


def distance_intervals(pairs: DataFrame, concepts: DataFrame, iterations: int, seed: str) -> DataFrame:
    """(a, b, ld_lo, ld_hi, lo, hi): 95 % bootstrap intervals of the mean distance and of the mean distance divided by
    that of different concepts, over pairs (a, b, i, j, d) of the concepts that a and b share.

    concepts (code, n) is one row: concepts 1 to n are drawn for all pairs alike, and a pair keeps the drawn ones that
    it shares. Distances are computed once; a resample is a sum weighted by multiplicities. Without a drawn concept a
    resample is left out; with one, or without any distance to another concept, nothing is divided.
    """
    m = draws(concepts, ["code"], "n", iterations, seed).select(F.col("b").alias("it"), (F.col("idx") + 1).alias("c"), "mult")
    x, y = m.withColumnsRenamed({"c": "i", "mult": "mi"}), m.withColumnsRenamed({"c": "j", "mult": "mj"})
    own = F.col("i") == F.col("j")
    every, same, n = F.sum(F.col("mi") * F.col("mj") * F.col("d")), F.sum(F.when(own, F.col("mi") * F.col("d"))), F.sum(F.when(own, F.col("mi")))
    s = pairs.join(x, "i").join(y, ["it", "j"]).groupBy("it", "a", "b").agg(every.alias("every"), same.alias("same"), n.alias("n"))
    e = s.select("a", "b", (F.col("same") / F.col("n")).alias("ld"), F.when(F.col("n") > 1, (F.col("every") - F.col("same")) / (F.col("n") * F.col("n") - F.col("n"))).alias("other"))
    r = e.withColumn("ldnd", F.when(F.col("other") > 1e-12, F.col("ld") / F.col("other")).otherwise(F.col("ld")))
    ends = F.array(F.lit(0.025), F.lit(0.975))
    q = r.groupBy("a", "b").agg(F.percentile("ld", ends).alias("p"), F.percentile("ldnd", ends).alias("q"))
    return q.select("a", "b", F.col("p")[0].alias("ld_lo"), F.col("p")[1].alias("ld_hi"), F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
