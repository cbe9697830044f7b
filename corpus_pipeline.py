"""From documents to packed training sequences: STAGES run in order, each over all that the one before kept.

No stage can be expressed in SQL as a whole (tokenizer ids, trained models), so ORACLE_SQL is None and the tests hold
run() against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsmill.llm import stages
from newsmill.llm.common import table, write_and_read

STAGES = [
    ("quality_rules", stages.quality),
    ("ngram_jaccard_join", stages.near_duplicates),
    ("benchmark_decontamination", stages.decontaminated),
    ("secret_scans", stages.secrets),
    ("best_fit_packing", stages.packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is a Parquet table in the shared folder, read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_and_read(stage(spark, docs, sf_dir), name)
    return docs
