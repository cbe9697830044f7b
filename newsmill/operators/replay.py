"""Domain replays of the event log: a domain's history as of any record, whole or from a stored snapshot on.

A history is a table of records, as the log has them. It is sound if all its streams are the domain's, no id stands twice
and each (stream, key) counts its records without a gap; one aggregation tells, without any order. A snapshot is a stored
history with the next sequence number of each (stream, key), so that a later replay checks and adds later records alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import calendar, clusters
from .event_log import SCHEMA, STREAMS, payloads, unresolved

#: Streams of each domain.
DOMAINS = {d: [s for s in STREAMS if s.startswith(p)] for d, p in (("ingestion", "ingestion-"), ("clusters", "cluster-"), ("calendar", "calendar-"), ("whispers", "whisper-"))}
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
_KEY = ["stream_name", "stream_key"]


def place() -> Column:
    """Where records of one instant stand by their stream; unknown ones come last."""
    n = F.array_position(F.array(*map(F.lit, STREAMS)), F.col("stream_name"))
    return F.when(n == 0, len(STREAMS) + 1).otherwise(n)


def position() -> Column:
    """A record's place in the order across streams."""
    return F.struct(F.col("recorded_at"), place().alias("place"), F.col("sequence"), F.col("record_id"))


def up_to(log: DataFrame, record_id: str) -> DataFrame:
    """The records up to and with one of them."""
    last = log.where(F.col("record_id") == record_id).select(position().alias("p")).select("p.*").first()
    if last is None:
        raise ValueError(f"no record {record_id}")
    at, stream, sequence, own = last
    bound = F.struct(F.lit(at).cast("timestamp").alias("recorded_at"), F.lit(stream).alias("place"), F.lit(sequence).cast("long").alias("sequence"), F.lit(own).alias("record_id"))
    return log.where((F.col("recorded_at") <= F.lit(at)) & (position() <= bound))


def faults(records: DataFrame, domain: str, begins: DataFrame | None = None) -> DataFrame:
    """(stream_name, stream_key, fault) of what keeps records from being a domain's history; begins: (stream_name,
    stream_key, next) of what came before them."""
    of_key = records.groupBy(*_KEY).agg(F.count("*").alias("n"), F.countDistinct("sequence").alias("different"), F.min("sequence").alias("low"), F.max("sequence").alias("high"))
    if begins is not None:
        next_ = begins.select(F.col("stream_name").alias("s"), F.col("stream_key").alias("k"), "next")
        of_key = of_key.join(next_, (F.col("stream_name") == F.col("s")) & F.col("stream_key").eqNullSafe(F.col("k")), "left")
    start = F.coalesce("next", F.lit(0)) if begins is not None else F.lit(0)
    gap = (F.col("low") != start) | (F.col("high") - F.col("low") + 1 != F.col("n")) | (F.col("different") != F.col("n"))
    fault = F.when(~F.col("stream_name").isin(DOMAINS[domain]), "unknown stream").when(gap, "non-contiguous sequence")
    twice = records.groupBy("record_id").agg(F.count("*").alias("n"), *(F.min(c).alias(c) for c in _KEY)).where("n > 1").select(*_KEY, F.lit("duplicate record").alias("fault")).distinct()
    return of_key.select(*_KEY, fault.alias("fault")).where("fault is not null").unionByName(twice)


def _sound(records: DataFrame, domain: str, begins: DataFrame | None = None) -> DataFrame:
    found = faults(records, domain, begins).limit(5).collect()
    if found:
        raise ValueError(f"{domain} replay: " + "; ".join(f"{r.fault} in {r.stream_name}::{r.stream_key}" for r in found))
    return records


def broken_references(history: DataFrame, domain: str) -> DataFrame:
    """(problem, id) of records that refer to none: normalized items without their payload (which a replay reports),
    corrections without an addition before, supersessions without a revision (which it rejects)."""
    if domain == "ingestion":
        raw = payloads(history, "ingestion-raw-payloads", "raw_payload_id string").select("raw_payload_id")
        lost = unresolved(payloads(history, "ingestion-normalized-items", "item_id string, raw_payload_id string"), raw, "raw_payload_id")
        return lost.select(F.lit("item without payload").alias("problem"), F.col("item_id").alias("id"))
    if domain == "clusters":
        events = payloads(history, "cluster-membership-events", "cluster_id string, item_id string, event_type string").withColumnRenamed("sequence", "seq")
        return clusters.unmatched_removals(events).select(F.lit("correction without addition").alias("problem"), F.concat_ws("::", "cluster_id", "item_id").alias("id"))
    if domain == "calendar":
        key = "source_id string, source_event_id string"
        revisions = payloads(history, "calendar-revisions", f"{key}, revision_number int")
        events = payloads(history, "calendar-supersession-events", f"{key}, superseded int, superseding int")
        return calendar.dangling(events, revisions).select(F.lit("supersession without revision").alias("problem"), F.concat_ws("::", "source_id", "source_event_id", "superseded", "superseding").alias("id"))
    return history.sparkSession.createDataFrame([], "problem string, id string")


def _referring(history: DataFrame, domain: str) -> DataFrame:
    if domain in ("clusters", "calendar"):
        lost = [r.id for r in broken_references(history, domain).limit(5).collect()]
        if lost:
            raise ValueError(f"{domain} replay: unresolved references {lost}")
    return history


def replay(log: DataFrame, domain: str, as_of: str | None = None) -> DataFrame:
    """A domain's history from its records (log), up to one of them. Any fault is an error."""
    records = log.select(*_COLUMNS)
    return _referring(_sound(up_to(records, as_of) if as_of else records, domain), domain)


def marks(history: DataFrame) -> DataFrame:
    """(stream_name, stream_key, next) after a history."""
    return history.groupBy(*_KEY).agg((F.max("sequence") + 1).alias("next"))


def store(history: DataFrame, path: str) -> None:
    """A snapshot below path, which must be new: the history, then its marks."""
    history.write.mode("errorifexists").partitionBy("stream_name").parquet(f"{path}/history")
    stored = history.sparkSession.read.schema(SCHEMA).parquet(f"{path}/history")
    marks(stored).write.mode("errorifexists").parquet(f"{path}/marks")


def resume(spark: SparkSession, path: str, log: DataFrame, domain: str, as_of: str | None = None) -> DataFrame:
    """The history of replay(), from a snapshot and the records of the log that come after it in their streams. Only these
    are checked for ids and sequence; references are checked over the whole."""
    stored = spark.read.schema(SCHEMA).parquet(f"{path}/history").select(*_COLUMNS)
    begins = spark.read.schema("stream_name string, stream_key string, next long").parquet(f"{path}/marks")
    bound = begins.select(F.col("stream_name").alias("s"), F.col("stream_key").alias("k"), "next")
    records = up_to(log.select(*_COLUMNS), as_of) if as_of else log.select(*_COLUMNS)
    later = records.join(bound, (F.col("stream_name") == F.col("s")) & F.col("stream_key").eqNullSafe(F.col("k")), "left").where(F.col("sequence") >= F.coalesce("next", F.lit(0))).select(*_COLUMNS)
    _sound(later, domain, begins)
    if not later.join(stored.select("record_id"), "record_id", "left_semi").isEmpty():
        raise ValueError(f"{domain} replay: a record of the snapshot comes again")
    return _referring(stored.unionByName(later), domain)
