"""Scoring of prediction files against gold columns, and significance of differences between systems.

Predictions are a table (source, target, pos, pred), gold columns a table (target, pos, ref); a file's length is its
last position plus one. Test sets are lists of some hundred or thousand sentences, whatever the size of the corpora.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.operators import resampling as RS
from glossa.operators import translation as MT

#: Fewer sentences than this are not tested for significance.
LEAST = 5


def lengths(preds: DataFrame, gold: DataFrame, on_mismatch: str, by: list[str]) -> DataFrame:
    """(by, n): how many positions count for each file (by source and target) or set of files (by target): as many as
    the shortest side has on "truncate"; on "skip", files that differ in length from their gold column are left out."""
    if on_mismatch not in ("skip", "truncate"):
        raise ValueError("on_mismatch is skip or truncate")
    n_ref = gold.groupBy("target").agg((F.max("pos") + 1).alias("n_ref"))
    n = preds.groupBy("source", "target").agg((F.max("pos") + 1).alias("n_pred")).join(n_ref, "target")
    n = n.groupBy(*by).agg(F.min(F.least("n_pred", "n_ref")).alias("n"), F.max(F.greatest("n_pred", "n_ref")).alias("most"))
    return (n.where("n = most") if on_mismatch == "skip" else n).select(*by, "n")


def spread(pairs: DataFrame) -> DataFrame:
    """Few bytes that take long to score: dealt to all cores, however few partitions they came in."""
    return pairs.repartition(pairs.sparkSession.sparkContext.defaultParallelism, "target", "pos")


def scored_pairs(preds: DataFrame, gold: DataFrame, on_mismatch: str = "skip") -> DataFrame:
    """(source, target, pos, pred, ref) with something on both sides; targets without a gold column are left out."""
    rows = preds.join(lengths(preds, gold, on_mismatch, ["source", "target"]), ["source", "target"]).where("pos < n")
    both = rows.join(gold, ["target", "pos"]).withColumns({c: F.trim(c) for c in ("pred", "ref")})
    return spread(both.where("pred <> '' AND ref <> ''").select("source", "target", "pos", "pred", "ref"))


def score_files(preds: DataFrame, gold: DataFrame, on_mismatch: str = "skip", token_scores: DataFrame | None = None) -> DataFrame:
    """(source, target, n_sentences, chrfpp, bleu[, precision, recall, f1]), rounded to four places. A file without a
    scored pair has 0 sentences and null scores. token_scores (source, target, pos, precision, recall, f1) are means
    of greedy matches, where they are wanted."""
    pairs = scored_pairs(preds, gold, on_mismatch)
    by = ["source", "target"]
    out = lengths(preds, gold, on_mismatch, by).select(*by).join(pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_sentences")), by, "left")
    out = out.withColumn("n_sentences", F.coalesce("n_sentences", F.lit(0).cast("long")))
    for metric in MT.METRICS:
        s = MT.scores(MT.match_statistics(pairs, by, metric), by, metric)
        out = out.join(s.select(*by, F.round("score", 4).alias(metric)), by, "left")
    if token_scores is not None:
        out = out.join(token_scores.groupBy(*by).agg(*[F.round(F.avg(c), 4).alias(c) for c in ("precision", "recall", "f1")]), by, "left")
    return out


def tested(pairs: DataFrame, group: list[str], systems: list[str], metrics: list[str], n_boot: int, seed: str) -> DataFrame:
    """(group, metric, system_a.., system_b.., score_a, score_b, delta, lo, hi, p, n_sentences) for every two systems
    of a group, a < b. pairs (group, systems, pos, pred, ref) must have the same positions for all systems of a group.

    A group's resamples are the same for all its systems and a system is scored once a resample, however many others it
    is compared to. Draws stay in the tasks that make them; sums of WIDTH sentences meet.
    """
    at = pairs.select(*group, "pos").distinct().withColumn("idx", F.row_number().over(Window.partitionBy(*group).orderBy("pos")).cast("long") - 1)
    sizes = at.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST)

    def one(metric: str) -> DataFrame:
        stats = MT.match_statistics(spread(pairs), [*group, *systems, "pos"], metric)
        rows = stats.join(at, [*group, "pos"]).select(*group, "idx", *systems, "kind", F.array(*[F.col(c).cast("double") for c in ("hyp", "ref", "match")]).alias("v"))
        sums = RS.resampled_sums(rows, group, [*systems, "kind"], "v", sizes, n_boot, seed, observed=True)
        weighted = sums.select(*group, *systems, "b", "kind", *[F.col("sums")[k].cast("long").alias(c) for k, c in enumerate(("hyp", "ref", "match"))])
        s = MT.scores(weighted, [*group, *systems, "b"], metric)
        every = s.groupBy(*group, "b").agg(F.array_sort(F.collect_list(F.struct(*systems, "score"))).alias("x"))  # a score a system
        two = F.flatten(F.transform("x", lambda u, i: F.transform(F.slice(F.col("x"), i + 2, F.size("x")), lambda v: F.struct(u.alias("a"), v.alias("b")))))
        names = [f"{c}_{k}" for k in "ab" for c in [*systems, "score"]]
        met = every.select(*group, "b", F.explode(two).alias("p")).select(*group, "b", *[F.col(f"p.{n[-1]}.{n[:-2]}").alias(n) for n in names])
        return MT.paired_bootstrap(met, [*group, *[n for n in names if not n.startswith("score_")]]).withColumn("metric", F.lit(metric))

    return reduce(DataFrame.unionByName, map(one, metrics)).join(sizes.withColumnRenamed("n", "n_sentences"), group)


def significant(rows: DataFrame, by: list[str], alpha: float) -> DataFrame:
    """Adds p_bonferroni over the rows of each `by`, and whether p and p_bonferroni are below alpha."""
    most = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_k"))
    out = rows.join(most, by).withColumn("p_bonferroni", F.least(F.col("p") * F.col("_k"), F.lit(1.0))).drop("_k")
    return out.withColumn("significant_alpha", F.col("p") < alpha).withColumn("significant_bonf", F.col("p_bonferroni") < alpha)


def within_system(preds: DataFrame, gold: DataFrame, metrics: list[str], n_boot: int = 1000, seed: str = "42", on_mismatch: str = "truncate", alpha: float = 0.05) -> DataFrame:
    """Every two sources of a target compared on the sentences that all its sources translate; Bonferroni per target
    and metric. Targets with one source, or fewer than five such sentences, are left out."""
    rows = preds.join(lengths(preds, gold, on_mismatch, ["target"]), "target").where("pos < n")
    both = rows.join(gold, ["target", "pos"]).withColumns({c: F.trim(c) for c in ("pred", "ref")}).where("pred <> '' AND ref <> ''")
    sources = preds.groupBy("target").agg(F.count_distinct("source").alias("want")).where("want > 1")
    whole = both.groupBy("target", "pos").agg(F.count_distinct("source").alias("have")).join(sources, "target").where("have = want").select("target", "pos")
    pairs = both.join(whole, ["target", "pos"], "left_semi").select("target", "source", "pos", "pred", "ref")
    return significant(tested(pairs, ["target"], ["source"], metrics, n_boot, seed), ["target", "metric"], alpha)


def cross_system(systems: dict[str, DataFrame], gold: DataFrame, metrics: list[str], n_boot: int = 1000, seed: str = "42", on_mismatch: str = "truncate", alpha: float = 0.05) -> DataFrame:
    """Systems compared file by file on the sentences that all of them translate; Bonferroni per metric over files."""
    every = reduce(DataFrame.unionByName, [df.withColumn("system", F.lit(name)) for name, df in systems.items()])
    n_ref = gold.groupBy("target").agg((F.max("pos") + 1).alias("n_ref"))
    n = every.groupBy("source", "target", "system").agg((F.max("pos") + 1).alias("n_pred")).join(n_ref, "target")
    n = n.groupBy("source", "target").agg(F.min(F.least("n_pred", "n_ref")).alias("n"), F.max(F.greatest("n_pred", "n_ref")).alias("most"), F.count(F.lit(1)).alias("have")).where(F.col("have") == len(systems))
    n = (n.where("n = most") if on_mismatch == "skip" else n).select("source", "target", "n")
    both = every.join(n, ["source", "target"]).where("pos < n").join(gold, ["target", "pos"]).withColumns({c: F.trim(c) for c in ("pred", "ref")}).where("pred <> '' AND ref <> ''")
    whole = both.groupBy("source", "target", "pos").agg(F.count_distinct("system").alias("have")).where(F.col("have") == len(systems)).select("source", "target", "pos")
    pairs = both.join(whole, ["source", "target", "pos"], "left_semi").select("source", "target", "system", "pos", "pred", "ref")
    return significant(tested(pairs, ["source", "target"], ["system"], metrics, n_boot, seed), ["metric"], alpha)


def win_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, wins_a, wins_b, ties): differences that are significant after Bonferroni (before it, where there is no such
    column), and all others."""
    flag = F.col("significant_bonf" if "significant_bonf" in rows.columns else "significant_alpha")
    a, b = F.count_if(flag & (F.col("delta") > 0)), F.count_if(flag & (F.col("delta") < 0))
    return rows.groupBy(*by).agg(a.alias("wins_a"), b.alias("wins_b"), (F.count(F.lit(1)) - a - b).alias("ties"))
