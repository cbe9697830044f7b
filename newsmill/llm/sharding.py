"""Operator 1: jump consistent hashing (Lamping and Veach, 2014).

A shard follows from the key and the number of shards alone: no ring or table is kept, and going from n to n + 1 shards
moves only the rows that the new shard takes.

Defined cases: a null key hashes as 0; a null text counts 0 bytes and CRC 0; repeated rows keep their number, each with
a slot of its own; ties in doc_id are ordered by CRC and size; an empty table gives an empty result; columns of the
input with the names of added ones are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import crc32, table

#: Multiplier of the generator in the published algorithm (fixed value).
JUMP = np.uint64(2862933555777941757)
SHARDS = 24
#: Rows that one task numbers; the ids are cut into as many ranges as this needs.
ROWS_EACH = 20_000


def jump_hash(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each 64-bit key, for all keys at once; expected rounds: ln(buckets)."""
    if buckets < 1:
        raise ValueError("buckets must be at least 1")
    key = keys.astype(np.int64).view(np.uint64).copy()
    out = np.zeros(len(key), np.int64)
    open_ = np.arange(len(key))
    while len(open_):
        k = key[open_] * JUMP + np.uint64(1)
        key[open_] = k
        jump = ((out[open_] + 1) * ((1 << 31) / ((k >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        on = jump < buckets
        open_ = open_[on]
        out[open_] = jump[on]
    return out


def shard_of(key: Column, shards: int) -> Column:
    """Column of the shard of a long key."""

    @F.pandas_udf(T.IntegerType())
    def jump(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.fillna(0).to_numpy(np.int64), shards).astype(np.int32))

    return jump(F.coalesce(key.cast("long"), F.lit(0).cast("long")))


def shard(df: DataFrame, key: str, shards: int = SHARDS) -> DataFrame:
    """df with its shard and the shard if there were one more. A projection: nothing is shuffled."""
    return df.withColumn("shard", shard_of(F.col(key), shards)).withColumn("grown_shard", shard_of(F.col(key), shards + 1))


def numbered(rows: DataFrame, rows_each: int = ROWS_EACH) -> DataFrame:
    """Adds slot: 0, 1, ... within each shard, by (doc_id, text_crc32, size).

    Equal rows are counted before the shuffle and numbered from their count, so that a key that holds a third of all
    rows is one row here; its copies come back in chunks. Ids are cut into ranges at quantiles; a task numbers one range of one shard and the ranges'
    sums (shards x ranges rows) give where each begins.
    """
    keys = ["shard", "grown_shard", "doc_id", "text_crc32", "size"]
    once = rows.groupBy(*keys).agg(F.count("*").alias("copies"))
    total, shards = rows.agg(F.count("*"), F.max("shard")).first()
    ranges = -(-total // (rows_each * ((shards or 0) + 1)))
    cuts = []
    if ranges > 1:
        asked = [i / ranges for i in range(1, ranges)]
        cuts = sorted(set(rows.agg(F.percentile_approx("doc_id", asked, 10 * ranges)).first()[0] or []))

    @F.pandas_udf(T.IntegerType())
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(np.int64), side="right").astype(np.int32))

    once = once.withColumn("span", range_of(F.coalesce("doc_id", F.lit(-(2**63)))) if cuts else F.lit(0))
    before = (
        once.groupBy("shard", "span").agg(F.sum("copies").alias("n"))
        .withColumn("first", F.sum("n").over(Window.partitionBy("shard").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)))
        .select("shard", "span", F.coalesce("first", F.lit(0)).alias("first"))
    )
    order = Window.partitionBy("shard", "span").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size", "grown_shard")
    placed = once.withColumn("upto", F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.join(before, ["shard", "span"])
    placed = placed.select(*keys, "copies", (F.col("first") + F.col("upto") - F.col("copies")).alias("begin"))
    slots = lambda begin, end: F.explode(F.sequence(begin, end)).alias("slot")
    few = placed.where(F.col("copies") <= rows_each).select(*keys, slots(F.col("begin"), F.col("begin") + F.col("copies") - 1))
    # a row of more copies is dealt in chunks before they become rows
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / rows_each))).alias("chunk")
    many = placed.where(F.col("copies") > rows_each).select(*keys, "begin", "copies", chunk).repartition(*keys, "chunk")
    low = F.col("begin") + F.col("chunk") * rows_each
    many = many.select(*keys, slots(low, F.least(low + rows_each, F.col("begin") + F.col("copies")) - 1))
    return few.unionByName(many)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards by the law `key`."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"), crc32(F.col("text")).alias("text_crc32"))
    out = numbered(shard(rows, "doc_id", SHARDS))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.col("grown_shard").cast("int"))
