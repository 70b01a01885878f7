"""Writers: square matrices, wide parallel tables, statistics with a total, cleaned corpora with their funnel."""

from __future__ import annotations

import json
import platform
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def square_matrix(m: DataFrame, codes: list) -> DataFrame:
    """A row per code and a column per code, six decimals."""
    return m.groupBy(F.col("a").alias("code")).pivot("b", codes).agg(F.format_string("%.6f", F.first("d")))


def interval_matrix(m: DataFrame, codes: list) -> DataFrame:
    """Cells `mean [lo,hi]` of a table (a, b, d, lo, hi)."""
    cell = F.format_string("%.3f [%.3f,%.3f]", F.first("d"), F.first("lo"), F.first("hi"))
    return m.groupBy(F.col("a").alias("code")).pivot("b", codes).agg(cell)


def wide_parallel(long: DataFrame, first: list[str]) -> DataFrame:
    """(pos, a column per code) up to the shortest variety; preferred codes first, the others in order."""
    sizes = long.groupBy("code").count().collect()  # a row a variety
    least = min((r["count"] for r in sizes), default=0)
    codes = [c for c in first if c in {r["code"] for r in sizes}]
    codes += sorted({r["code"] for r in sizes} - set(codes))
    return long.where(F.col("pos") < least).groupBy("pos").pivot("code", codes).agg(F.first("text"))


def parallel_splits(long: DataFrame, first: list[str], splits: tuple[str, ...] = ("dev", "devtest")) -> DataFrame:
    """(sentence_id, split, a column per code) of (code, split, pos, text): each split up to its shortest variety, split
    after split, ids counted through. Preferred codes come first, the others in order."""
    sizes = {(r["code"], r["split"]): r["n"] for r in long.groupBy("code", "split").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a variety and split
    codes = sorted({c for c, _ in sizes})
    columns = [c for c in first if c in codes] + [c for c in codes if c not in first]
    before, kept = 0, F.lit(None).cast("long")
    for s in splits:
        least = min((sizes.get((c, s), 0) for c in codes), default=0)
        kept = F.when((F.col("split") == s) & (F.col("pos") < least), F.col("pos") + before).otherwise(kept)
        before += least
    rows = long.withColumn("sentence_id", kept.cast("long")).where("sentence_id IS NOT NULL")
    return rows.groupBy("sentence_id", "split").pivot("code", columns).agg(F.first("text"))


def interval_tables(m: DataFrame, codes: list) -> dict[str, DataFrame]:
    """Of (a, b, d, lo, hi): the matrix of cells, and the ends of the intervals as matrices of their own."""
    ends = {f"_ci_{c}": square_matrix(m.select("a", "b", F.col(c).alias("d")), codes) for c in ("lo", "hi")}
    return {"": interval_matrix(m, codes)} | ends


def audit_table(forms: DataFrame, codes: list[str]) -> DataFrame:
    """(concept_en, <code>_orth.., <code>_asjp..) of (concept_en, code, orth, asjp): what each form was turned into."""
    wide = forms.groupBy("concept_en").pivot("code", codes).agg(F.first("orth").alias("orth"), F.first("asjp").alias("asjp"))
    return wide.select("concept_en", *[F.coalesce(f"{c}_{what}", F.lit("")).alias(f"{c}_{what}") for what in ("orth", "asjp") for c in codes])


def with_p_values(results: DataFrame, p_values: DataFrame | None, key: str = "model_id", columns: tuple[str, ...] = ("p_full", "p_dialect_external")) -> DataFrame:
    """results with the p-values of each model; nulls where there are none, or no table of them at all."""
    if p_values is None:
        return results.select("*", *[F.lit(None).cast("double").alias(c) for c in columns])
    there = [F.col(c) if c in p_values.columns else F.lit(None).cast("double").alias(c) for c in columns]
    return results.join(p_values.select(key, *there), key, "left")


def group_stats(long: DataFrame) -> DataFrame:
    """(code, n_sentences, n_chars) and a row for the total."""
    return long.rollup("code").agg(F.count(F.lit(1)).alias("n_sentences"), F.sum(F.length("text")).alias("n_chars")).withColumn("code", F.coalesce("code", F.lit("total")))


def cleaned_corpus(sentences: DataFrame, articles: DataFrame, path: str) -> None:
    """Sentences by variety, and per article how many are left; each write is committed as a whole."""
    sentences.write.mode("overwrite").partitionBy("code").parquet(f"{path}/sentences")
    n = sentences.groupBy("article_id").agg(F.count(F.lit(1)).alias("n_sentences"))
    articles.join(n, "article_id").write.mode("overwrite").parquet(f"{path}/articles")


def by_dataset(df: DataFrame, column: str, path: str) -> None:
    df.write.mode("overwrite").partitionBy(column).option("header", True).csv(path)


def vectors(c: DataFrame, path: str) -> None:
    """(code, vec) as parquet."""
    c.select("code", "vec").write.mode("overwrite").parquet(path)


def run_metadata(**params) -> str:
    """What a run was made with, as JSON."""
    return json.dumps({"python": sys.version.split()[0], "platform": platform.platform(), "parameters": params}, sort_keys=True, default=str)
