"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorframe.llm import bpe, exact_dedup, langid, lm, media, mixing, quality, secret_scan, simhash, token_counts
from vectorframe.llm.shared import small_batches

#: Rank file that the queries encode with; the operators take any.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_documents(spark, sf_dir))


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no images, so every document's whole text is made one, in five formats."""
    docs = _documents(spark, sf_dir)
    return media.media_tiles(docs.select("doc_id", media.text_as_image(F.col("text"), F.col("doc_id")).alias("media")))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_documents(spark, sf_dir), RANKS)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return lm.score(docs, lm.train(docs))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return langid.identify(docs, langid.train(docs))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(docs, quality.train(docs, labels))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(_documents(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_documents(spark, sf_dir), RANKS)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media": op1_media,
    "op2_bpe": op2_bpe,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_language_id": op5_language_id,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_secret_scan": op8_secret_scan,
    "op9_token_counts": op9_token_counts,
    "op10_mixing": op10_mixing,
}

SQL: dict[str, str] = {
    "op7_exact_dedup": """
        SELECT doc_id, duplicate_of FROM (
            SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS duplicate_of,
                   row_number() OVER (PARTITION BY text ORDER BY doc_id) AS copy
            FROM documents WHERE text IS NOT NULL) t
        WHERE copy > 1""",
}
