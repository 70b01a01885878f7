"""Evaluation of groups in an embedding space, over long tables of distances (a, b, d) or sums of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions import vectors as V


def profiles(m: DataFrame, dim: DataFrame) -> DataFrame:
    """Every ordered pair with similarity and the target's family. dim (code, family) is one row a group."""
    return m.where("a <> b").join(F.broadcast(dim), F.col("b") == F.col("code")).select(F.col("a").alias("source"), F.col("b").alias("target"), F.col("d").alias("distance"), (1 - F.col("d")).alias("similarity"), F.col("family").alias("target_family"))


def cohesion(m: DataFrame, dim: DataFrame) -> DataFrame:
    """Distances within and between families: unordered pairs within, all cross pairs between; population deviation."""
    fa, fb = F.broadcast(dim.select(F.col("code").alias("a"), F.col("family").alias("fa"))), F.broadcast(dim.select(F.col("code").alias("b"), F.col("family").alias("fb")))
    intra, inter = F.when((F.col("fa") == F.col("fb")) & (F.col("a") < F.col("b")), F.col("d")), F.when(F.col("fa") != F.col("fb"), F.col("d"))
    out = m.join(fa, "a").join(fb, "b").groupBy(F.col("fa").alias("family")).agg(F.count_distinct("a").alias("n_members"), F.avg(intra).alias("mean_intra"), F.stddev_pop(intra).alias("std_intra"), F.avg(inter).alias("mean_inter"), F.stddev_pop(inter).alias("std_inter"))
    return out.withColumn("cohesion_ratio", F.when(F.col("mean_intra") > 0, F.col("mean_inter") / F.col("mean_intra")))


def silhouettes(m: DataFrame, dim: DataFrame) -> DataFrame:
    """(a, family, s) on given distances; a group alone in its family scores 0."""
    fa, fb = F.broadcast(dim.select(F.col("code").alias("a"), F.col("family").alias("fa"))), F.broadcast(dim.select(F.col("code").alias("b"), F.col("family").alias("fb")))
    mean = m.where("a <> b").join(fa, "a").join(fb, "b").groupBy("a", "fa", "fb").agg(F.avg("d").alias("d"))
    x = mean.groupBy("a", F.col("fa").alias("family")).agg(F.max(F.when(F.col("fa") == F.col("fb"), F.col("d"))).alias("own"), F.min(F.when(F.col("fa") != F.col("fb"), F.col("d"))).alias("other"))
    return x.select("a", "family", F.coalesce((F.col("other") - F.col("own")) / F.nullif(F.greatest("own", "other"), F.lit(0.0)), F.lit(0.0)).alias("s"))


def dispersion(rows: DataFrame, label: str, dims: int) -> DataFrame:
    """One row with the Davies-Bouldin and Calinski-Harabasz indexes of labelled unit vectors."""
    u = rows.select(label, V.unit(F.col("vec")).alias("vec"))
    c = u.groupBy(label).agg(V.mean_of("vec", dims).alias("c"), F.count(F.lit(1)).alias("n"))
    every = u.agg(V.mean_of("vec", dims).alias("g"), F.count(F.lit(1)).alias("total"))
    gap = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
    spread = u.join(F.broadcast(c), label).groupBy(label).agg(F.avg(F.sqrt(gap(F.col("vec"), F.col("c")))).alias("s"), F.sum(gap(F.col("vec"), F.col("c"))).alias("w"))
    k = c.join(spread, label)
    x, y = k.select(F.col(label).alias("i"), F.col("s").alias("si"), F.col("c").alias("ci")), k.select(F.col(label).alias("j"), F.col("s").alias("sj"), F.col("c").alias("cj"))
    db = x.join(y, F.col("i") != F.col("j")).groupBy("i").agg(F.max((F.col("si") + F.col("sj")) / F.sqrt(gap(F.col("ci"), F.col("cj")))).alias("r")).agg(F.avg("r").alias("davies_bouldin"))
    ch = k.join(F.broadcast(every)).agg(((F.sum(F.col("n") * gap(F.col("c"), F.col("g"))) / (F.count(F.lit(1)) - 1)) / (F.sum("w") / (F.max("total") - F.count(F.lit(1))))).alias("calinski_harabasz"))
    return db.join(ch)  # one row each


def partition_agreement(pairs: DataFrame, l1: str, l2: str) -> DataFrame:
    """One row: adjusted Rand index, normalised mutual information (arithmetic) and V-measure of two labellings."""
    cells = pairs.groupBy(l1, l2).agg(F.count(F.lit(1)).alias("n"))
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    rows, cols = cells.groupBy(l1).agg(F.sum("n").alias("a")), cells.groupBy(l2).agg(F.sum("n").alias("b"))
    ent = lambda df, c: df.agg(F.sum(two(c)).alias(f"p_{c}"), F.sum(c).alias(f"t_{c}"), F.sum(F.col(c) * F.log(F.col(c).cast("double"))).alias(f"e_{c}"))
    one = ent(cells, "n").join(ent(rows, "a")).join(ent(cols, "b"))  # one row each
    t = F.col("t_n").cast("double")
    h = lambda c: F.log(t) - F.col(f"e_{c}") / t
    mi = h("a") + h("b") - h("n")
    expected = F.col("p_a") * F.col("p_b") / (t * (t - 1) / 2)
    ari = (F.col("p_n") - expected) / ((F.col("p_a") + F.col("p_b")) / 2 - expected)
    hom, com = mi / h("a"), mi / h("b")
    return one.select(ari.alias("ari"), (mi / ((h("a") + h("b")) / 2)).alias("nmi"), (2 * hom * com / (hom + com)).alias("v_measure"))


def within_between(rows: DataFrame, label: str, dims: int) -> DataFrame:
    """Mean cosine distance within each group and to all others, from sums of unit vectors: no pair is formed.

    The sum of all products of unit vectors of two groups is the product of the groups' sums.
    """
    u = rows.select(label, V.unit(F.col("vec")).alias("vec"))
    s = u.groupBy(label).agg(V.sum_of("vec", dims).alias("s"), F.count(F.lit(1)).alias("n"), F.count_if(V.norm(F.col("vec")) > 0).alias("nz"))
    t = u.agg(V.sum_of("vec", dims).alias("t"), F.count(F.lit(1)).alias("total"))
    x = s.join(F.broadcast(t))  # one row
    within = F.when(F.col("n") > 1, 1 - (V.dot(F.col("s"), F.col("s")) - F.col("nz")) / (F.col("n") * (F.col("n") - 1)))
    between = F.when(F.col("total") > F.col("n"), 1 - (V.dot(F.col("s"), F.col("t")) - V.dot(F.col("s"), F.col("s"))) / (F.col("n") * (F.col("total") - F.col("n"))))
    return x.select(label, "n", within.alias("within"), between.alias("between")).withColumn("separation", F.col("between") / F.col("within"))


def sentence_silhouette(rows: DataFrame, label: str, key: str, dims: int) -> DataFrame:
    """(key, label, s) with mean distances to each group from the groups' sums."""
    u = rows.select(key, label, V.unit(F.col("vec")).alias("u"))
    s = u.groupBy(F.col(label).alias("other")).agg(V.sum_of("u", dims).alias("s"), F.count(F.lit(1)).alias("n"))
    x = u.join(F.broadcast(s), F.lit(True))  # one row a group
    own = F.col(label) == F.col("other")
    product = V.dot(F.col("u"), F.col("s"))
    d = F.when(own, F.when(F.col("n") > 1, 1 - (product - V.dot(F.col("u"), F.col("u"))) / (F.col("n") - 1))).otherwise(1 - product / F.col("n"))
    best = x.withColumn("d", d).groupBy(key, label).agg(F.max(F.when(own, F.col("d"))).alias("a"), F.min(F.when(~own, F.col("d"))).alias("b"))
    return best.select(key, label, F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0)).alias("s"))


def alignment(rows: DataFrame, label: str, pos: str) -> DataFrame:
    """(a, b, similarity) for a < b: mean product of unit vectors at equal positions."""
    u = rows.select(F.col(label).alias("code"), pos, V.unit(F.col("vec")).alias("u"))
    x, y = u.withColumnsRenamed({"code": "a", "u": "ua"}), u.withColumnsRenamed({"code": "b", "u": "ub"})
    return x.join(y, pos).where("a < b").groupBy("a", "b").agg(F.avg(V.dot(F.col("ua"), F.col("ub"))).alias("similarity"))
