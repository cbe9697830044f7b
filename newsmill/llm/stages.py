"""Operators as pipeline stages: (spark, docs, sf_dir) to a DataFrame with the columns of docs.

Defined cases: null and empty texts have no words, so the first stage rejects them; met by a later stage they link with
nothing, hit nothing, hold no secret and are one end token. Of rows that tie (equal doc_id, equal texts) the
near-duplicate stage keeps one, all others keep each. Null doc_ids are kept and come last among equals. Long texts are
taken whole. Empty tables stay empty. Other columns keep their values, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, ngram_join, packing, quality_rules, secret_scan
from .common import spare, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal or similar ones: the one with the smallest doc_id. Of equal rows one stays."""
    own, key, of, same = spare(docs, "own_hash", "key", "hash", "same")
    rows = docs.withColumn(own, F.xxhash64("text"))
    keep = ngram_join.representatives(docs.select("doc_id", "text")).select(F.col("doc_id").alias(key), F.col("text_hash").alias(of), F.col("same").alias(same))
    kept = rows.join(keep, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(own) == F.col(of)))
    once = kept.where(F.col(same) == 1).unionByName(kept.where(F.col(same) > 1).dropDuplicates(["doc_id", own]))
    return once.select(*(F.col(f"`{c}`") for c in docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets redacted."""
    return secret_scan.redact(docs).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training sequences."""
    return packing.pack(docs)
