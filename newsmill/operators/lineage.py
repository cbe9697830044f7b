"""Cutting a lineage: a table in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read back from the session's checkpoint folder. An executor lost later costs nothing."""
    spark = df.sparkSession
    folder = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not folder.isDefined():
        raise RuntimeError("the session needs a checkpoint folder that the driver and all executors share")
    path = f"{folder.get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
