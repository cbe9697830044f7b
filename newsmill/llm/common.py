"""What the training-data operators share: tables, the shared folder, word rules."""

from __future__ import annotations

import io
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII letters, the only ones that the word rules lower-case.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, by any path that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may go without (tests)."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="newsmill-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is there yet."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def write_and_read(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the shared folder, in a folder for each value of columns `by`. An executor
    lost later costs no recomputation."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").partitionBy(*by or []).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Deletes the files of a write_and_read() table that nothing needs any more."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = hadoop(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of df has (Spark doesn't tell cases apart); pairwise different."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else. lower() does just that on texts of ASCII alone and is many times faster there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def crc32(text: Column) -> Column:
    """Unsigned CRC-32 of a string's UTF-8 bytes; null counts as empty."""
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def sampled_texts(docs: DataFrame, texts: int, chars: int) -> list[str]:
    """About so many different texts of docs, none longer than chars: those whose hashes are below a bound.

    The bound comes from an estimate of the number of different texts, so only the sample itself reaches the driver,
    however many rows, partitions or copies there are: at most about texts * chars characters.
    """
    rows = docs.where(F.char_length("text") <= chars).select("text", F.xxhash64("text").alias("h"))
    different = rows.agg(F.approx_count_distinct("h")).first()[0]
    if not different:
        return []
    bound = -(1 << 63) + min((1 << 64) - 1, (1 << 64) * texts // different)
    found = rows.where(F.col("h") <= F.lit(bound)).groupBy("h").agg(F.min("text").alias("text"))
    return [r["text"] for r in found.orderBy("h").collect()]


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000):
    """While this is open, Python tasks get so many rows at once: for stages that hold much beside their batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def shuffles_removed(spark: SparkSession):
    """While this is open, a query's shuffle files go when it ends: for tables that are written once and then read."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def write_arrays(spark: SparkSession, name: str, arrays: dict[str, np.ndarray]) -> str:
    """A bounded set of arrays as one file in the shared folder; its URI."""
    from pyarrow import fs

    uri = new_folder(spark, name)
    files, path = fs.FileSystem.from_uri(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    held = io.BytesIO()
    np.savez(held, **arrays)
    with files.open_output_stream(path, compression=None) as out:
        out.write(held.getvalue())
    return uri


_ARRAYS: dict[str, dict[str, np.ndarray]] = {}


def read_arrays(uri: str) -> dict[str, np.ndarray]:
    """What write_arrays() wrote; a worker keeps the last it read."""
    if uri not in _ARRAYS:
        from pyarrow import fs

        _ARRAYS.clear()
        files, path = fs.FileSystem.from_uri(uri)
        with files.open_input_stream(path, compression=None) as data:
            _ARRAYS[uri] = dict(np.load(io.BytesIO(data.read())))
    return _ARRAYS[uri]
