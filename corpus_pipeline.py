"""The corpus pipeline: stages in order, each over all that the one before it kept.

Defined cases. Documents without words are rejected by the first stage, so null, empty and blank
texts don't reach the others. Repeated rows and ties leave one row, with the smallest id. An empty
table stays empty through all stages. Extra columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vectorframe.llm import bpe, exact_dedup, mixing, quality, simhash
from vectorframe.llm.queries import RANKS
from vectorframe.llm.shared import settle, shared_dir, small_batches


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (operator 6), fitted on the labelled ones among them."""
    small_batches(spark)
    return quality.accepted(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text (operator 7)."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (operator 4)."""
    return simhash.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target weights (operator 10)."""
    return mixing.sample(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, decoded again as a check (operator 2)."""
    return bpe.encode_documents(docs, RANKS)


STAGES = [
    ("quality classifier", good),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("mixing to target weights", mixed),
    ("BPE encoding", tokens),
]

#: The classifier, the near duplicates and the encoder aren't SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; each result is written and reread as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_dir(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs, f"{folder}/{i}")
    return docs
