"""Append-only event log: envelopes, appends, replay checks and orders.

One table holds all streams, partitioned by stream_name so that reading a stream prunes to its folder. A batch is
checked as a whole before anything is written, and a write is one Spark job, so it lands whole or not at all.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import fnv1a
from .numbering import numbered

SCHEMA = "record_id string, stream_name string, stream_key string, sequence long, recorded_at timestamp, schema_version string, producer_version string, payload_hash string, source_phase string, reason string, payload string, contract_version string"
CONTRACT = "persistence-contract-v1"
REQUIRED = ["record_id", "stream_name", "schema_version", "producer_version", "source_phase"]

#: Streams in the order in which records of one instant are replayed: name, prefix of record ids, key, time column (fixed
#: values).
STREAMS = {
    "ingestion-raw-payloads": ("ingestion-raw-payload", "source_id", "observed_at"),
    "ingestion-normalized-items": ("ingestion-normalized-item", "source_id", "normalized_at"),
    "ingestion-malformed-items": ("ingestion-malformed-item", "source_id", "quarantined_at"),
    "ingestion-runs": ("ingestion-run", "source_id", "finished_at"),
    "cluster-membership-events": ("cluster-membership", "cluster_id", "created_at"),
    "cluster-dedupe-decisions": ("cluster-dedupe", None, "created_at"),
    "calendar-raw-payloads": ("calendar-raw-payload", "source_id", "observed_at"),
    "calendar-snapshots": ("calendar-snapshot", "source_id", "observed_at"),
    "calendar-revisions": ("calendar-revision", "source_id", "observed_at"),
    "calendar-confirmations": ("calendar-confirmation", "source_id", "confirmed_at"),
    "calendar-malformed-records": ("calendar-malformed", "source_id", "quarantined_at"),
    "calendar-runs": ("calendar-run", "source_id", "finished_at"),
    "calendar-supersession-events": ("calendar-supersession", "source_id", "observed_at"),
    "whisper-decisions": ("whisper-decision", None, "created_at"),
    "whisper-dismissals": ("whisper-dismissal", None, "dismissed_at"),
    "whisper-interactions": ("whisper-interaction", None, "recorded_at"),
}


def to_envelope(df: DataFrame, stream: str, natural_id: Column, order: list[str], before: int = 0, reason: Column | None = None, version: str = "v1") -> DataFrame:
    """Domain rows as log records; `before` records are in the stream already. Ids count by stream name; order has no ties."""
    prefix, key, at = STREAMS[stream]
    n = F.col("_n") + before
    payload = F.to_json(F.struct(*sorted(df.columns)))
    return numbered(df, [F.col(c) for c in order], "_n").select(
        F.concat_ws(":", F.lit(prefix), n.cast("string"), natural_id).alias("record_id"), F.lit(stream).alias("stream_name"), (F.col(key) if key else F.lit(None)).cast("string").alias("stream_key"),
        F.col(at).cast("timestamp").alias("recorded_at"), F.lit(f"{prefix}-{version}").alias("schema_version"), F.lit(f"{stream}-producer-{version}").alias("producer_version"),
        F.lit(stream.partition("-")[0]).alias("source_phase"), (reason if reason is not None else F.lit(None)).cast("string").alias("reason"), payload.alias("payload"),
    )


def stream_id() -> Column:
    return F.concat_ws("::", "stream_name", "stream_key")


def sequenced(batch: DataFrame, log: DataFrame | None, order: list[str]) -> DataFrame:
    """batch and sequence: the next numbers of each (stream_name, stream_key), in the given order."""
    key = [F.col("stream_name"), F.coalesce("stream_key", F.lit(""))]
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1
    rows = batch.withColumn("sequence", n.cast("long"))
    if log is None:
        return rows
    last = log.groupBy("stream_name", F.coalesce("stream_key", F.lit("")).alias("_key")).agg((F.max("sequence") + 1).alias("next"))
    rows = rows.withColumn("_key", F.coalesce("stream_key", F.lit(""))).join(last, ["stream_name", "_key"], "left")
    return rows.withColumn("sequence", F.col("sequence") + F.coalesce("next", F.lit(0))).drop("next", "_key")


class EventLog:
    """The log in a folder. There is no method that changes or removes a record."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read_all(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def read_stream(self, name: str, key: str | None = None) -> DataFrame | None:
        log = self.read_all()
        rows = log.where(F.col("stream_name") == name) if log is not None else None
        return rows if rows is None or key is None else rows.where(F.col("stream_key") == key)

    def holds(self, batch: DataFrame) -> bool:
        """Whether every record of the batch is in the log with its payload."""
        log = self.read_all()
        hashed = batch.select("record_id", fnv1a(F.coalesce("payload", F.lit("null"))).alias("payload_hash"))
        return log is not None and hashed.join(log.select("record_id", "payload_hash"), ["record_id", "payload_hash"], "left_anti").isEmpty()

    def append(self, batch: DataFrame, order: list[str], recorded_at: str | None = None) -> None:
        """Appends all records of the batch or none: required fields, a time, and ids that are new everywhere."""
        log = self.read_all()
        rows = batch.withColumn("recorded_at", F.coalesce("recorded_at", F.lit(recorded_at).cast("timestamp")))
        missing = [F.coalesce(F.trim(c), F.lit("")) == "" for c in REQUIRED]
        bad = F.lit(False)
        for m in missing:
            bad = bad | m
        faults = rows.agg(F.count_if(bad).alias("fields"), F.count_if(F.col("recorded_at").isNull()).alias("times"), (F.count("*") - F.countDistinct("record_id")).alias("twice")).first()
        if faults["fields"] or faults["times"] or faults["twice"]:
            raise ValueError(f"rejected: {faults.asDict()}")
        if log is not None and not rows.join(log.select("record_id"), "record_id", "left_semi").isEmpty():
            raise ValueError("rejected: a record id is in the log already")
        done = sequenced(rows, log, order).withColumns({"payload_hash": fnv1a(F.coalesce("payload", F.lit("null"))), "contract_version": F.lit(CONTRACT)})
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        done.select(*columns).write.mode("append").partitionBy("stream_name").parquet(self.path)


def contiguity(log: DataFrame) -> DataFrame:
    """(stream_name, stream_key, records, gaps, duplicates) of every stream key; replay needs neither of the latter."""
    order = Window.partitionBy("stream_name", F.coalesce("stream_key", F.lit(""))).orderBy("sequence", "record_id")
    rows = log.withColumn("expected", F.row_number().over(order) - 1)
    return rows.groupBy("stream_name", "stream_key").agg(F.count("*").alias("records"), F.count_if(F.col("expected") != F.col("sequence")).alias("gaps"), (F.count("*") - F.countDistinct("record_id")).alias("duplicates"))


def replayed(log: DataFrame) -> DataFrame:
    """The log in canonical order; a gap or duplicate in any stream is an error."""
    if not contiguity(log).where("gaps > 0 or duplicates > 0").isEmpty():
        raise ValueError("the log has a gap or a duplicate record")
    return log.orderBy("stream_name", F.coalesce("stream_key", F.lit("")), "sequence")


def global_order(log: DataFrame) -> DataFrame:
    """Across streams: time, stream, sequence, id. Unknown streams come last."""
    known = F.array(*map(F.lit, STREAMS))
    place = F.array_position(known, F.col("stream_name"))
    return log.orderBy("recorded_at", F.when(place == 0, len(STREAMS) + 1).otherwise(place), "sequence", "record_id")


def payloads(log: DataFrame, stream: str, schema: str) -> DataFrame:
    """A stream's domain rows."""
    if stream not in STREAMS:
        raise ValueError(f"unknown stream: {stream}")
    return log.where(F.col("stream_name") == stream).select("sequence", "recorded_at", F.from_json("payload", schema).alias("p")).select("sequence", "recorded_at", "p.*")


def summary(log: DataFrame) -> DataFrame:
    """(stream_name, records, keys) of each stream."""
    return log.groupBy("stream_name").agg(F.count("*").alias("records"), F.countDistinct("stream_key").alias("keys"))


def latest(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last event of each key."""
    return events.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in events.columns if c not in keys]), F.struct(*order)).alias("last")).select(*keys, "last.*")


def unresolved(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent is missing."""
    return children.join(parents.select(key), key, "left_anti")
