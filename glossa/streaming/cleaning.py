"""The stateless cleaning steps over a stream of articles. Corpus-wide steps (duplicates, frequent prefixes) need the
whole corpus and belong to batch plans; a stream only drops texts seen within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions import text


def clean_stream(articles: DataFrame, code: str, min_len: int = 30) -> DataFrame:
    """(id, pos, code, text) sentences of a streaming or static table (id, text)."""
    cleaned = articles.select("id", text.clean_article("text").alias("text")).where("text IS NOT NULL")
    rows = cleaned.select("id", F.posexplode(text.merged_sentences("text")).alias("pos", "text")).withColumn("code", F.lit(code))
    kept = rows.where(text.is_sentence("text", min_len)).withColumn("text", text.aggressive_normalise("text"))
    return kept.where(~text.rule_drop("text", "code")).select("id", "pos", "code", "text")


def distinct_stream(sentences: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """The first of equal sentences within the watermark."""
    return sentences.withWatermark(time, delay).dropDuplicatesWithinWatermark(["code", "text"])
