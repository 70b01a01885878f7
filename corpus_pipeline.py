"""The corpus pipeline: toxicity, near-duplicate removal, decontamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents. In all
of them other columns pass through whatever their names, texts of any length are taken whole, an empty table gives an
empty one, and equal rows are treated alike; what each does with nulls, ties and repeated ids stands beside it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from glossa.llm import common, decontaminate, jaccard_join, pii, piece_codec, toxicity

TOKENIZER = "piece_bpe_32k.model"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model does not grade as toxic; a tie of grades counts as toxic. Null and empty texts stay,
    as do rows without an id; repeated ids are rows of their own."""
    return toxicity.accept(docs, toxicity.fit_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the smallest id, of equal ids of the smallest text key, of
    equal rows one. Documents without words, nulls included, stay, repeated or not; a null id comes after all others."""
    return jaccard_join.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of the benchmark; a document left without a word is dropped. Overlapping passages are cut
    once. Null texts stay, and ids play no part; null items have no passages."""
    return decontaminate.cleaned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sanitised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data, and terms that disclose it, replaced by marks; of overlapping spans the first names the
    mark. Null texts stay null, rows stay rows, and ids play no part."""
    return pii.sanitised(docs)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of what they decode to: a row for each row, repeated and null
    ids included. A null text is empty and has the end id only; equal texts have equal ids."""
    return piece_codec.encode_documents(docs, public_tokenizers.path(TOKENIZER), keep_ids=True, lean=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("personal data", sanitised),
    ("piece encoding", tokenised),
]

#: Suffix-order, regression and merge-encoding stages have no SQL; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.stored(docs, "stage")
    return docs
