"""Training-corpus pipeline: quality, near-duplicates, benchmark leaks, secrets, tokens.

Each stage gets the documents that its predecessor kept, as written and read again, and gives a DataFrame of the same columns; the
last one adds the token columns. A document is dropped by quality (predicted 0), as a near-duplicate of one with a smaller id, or for a
benchmark passage; secrets are masked in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rasterloom.llm import bpe, decontam, near_dup, quality_rank, secret_scan
from rasterloom.llm.common import fold, table
from rasterloom.session import scratch_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the ranker, fitted on the labelled texts outside fold 0 of 5, predicts as good."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    ranker = quality_rank.fit(docs.select("doc_id", "text"), labels.filter(fold("doc_id", 5) != 0))
    return quality_rank.keep_good(docs, ranker)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class."""
    return near_dup.keep_first(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold half of a benchmark item or more."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the text; ``n_chars`` follows it."""
    masked = secret_scan.redact(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ``token_ids`` and ``n_tokens``."""
    return bpe.encode(docs).withColumn("n_tokens", F.size("token_ids").cast("bigint"))


STAGES = [
    ("quality_classifier", quality_stage),
    ("near_dup", near_dup_stage),
    ("decontamination", decontaminate_stage),
    ("secret_scans", secrets_stage),
    ("bpe", tokens_stage),
]

#: Fitted scores, alignment and merges are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
