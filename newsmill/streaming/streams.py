"""Structured Streaming forms: sliding counts with a watermark, stateful calendar changes and quiet windows, appends to a log."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import constants as C
from ..operators import calendar
from ..operators.event_log import EventLog

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_at_once: int = 8) -> DataFrame:
    """Parquet files of events as they arrive in a folder."""
    rows = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_at_once).option("pathGlobFilter", "events*.parquet").parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def sliding(events: DataFrame, length: str = "15 minutes", step: str = "5 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts by window and event type; late events are dropped after the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length, step), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def quiet_windows(intents: DataFrame, late: str = "1 hour") -> DataFrame:
    """Dismissals as they come: recorded, or ignored while an earlier one of the target is in force. A target's state goes
    when the watermark has passed its window."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        until = state.get[0] if state.exists else -(2**62)
        rows = []
        for r in pd.concat(list(batches)).sort_values(["at", "intent_id"]).itertuples():
            ms = r.at.value // 1_000_000
            taken = ms >= until
            until = ms + C.QUIET_MIN * 60_000 if taken else until
            rows.append((r.intent_id, key[0], "recorded" if taken else "ignored", until))
        state.update((until,))
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["intent_id", "target_id", "status", "quiet_until_ms"])

    rows = intents.withWatermark("at", late).groupBy("target_id")
    return rows.applyInPandasWithState(run, "intent_id long, target_id string, status string, quiet_until_ms long", "until long", "append", GroupStateTimeout.EventTimeTimeout)


class CalendarEvent(StatefulProcessor):
    """An event's fold: its current revision is a value, observations that the watermark hasn't reached are a list, and a
    timer at each one's time folds what is due, in order. With keep_hours, an event so long without an observation begins
    anew, and a timer drops its state."""

    def __init__(self, keep_hours: int | None = None):
        self.keep = keep_hours and keep_hours * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.current = handle.getValueState("current", "prior string, number int, last long")
        self.waiting = handle.getListState("waiting", "due long, row string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(r["observed_at"]) // 1000, json.dumps(r)) for pdf in rows for r in pdf[calendar.COLUMNS].astype(object).where(pdf[calendar.COLUMNS].notna(), None).to_dict("records")]
        self.waiting.appendList(new)
        for due in {d for d, _ in new}:
            self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((json.loads(r) for d, r in rows if d <= now), key=lambda r: r["seq"])
        prior, number, last = tuple(self.current.get()) if self.current.exists() else (None, 0, 0)
        if not due:
            if self.keep and not rows and last + self.keep <= now:
                self.current.clear()
            return
        left, out, prior = [(d, r) for d, r in rows if d > now], [], prior and json.loads(prior)
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        for row in due:
            at = int(row["observed_at"]) // 1000
            if self.keep and at >= last + self.keep:
                prior, number = None, 0
            folded, prior, number = calendar.observed(row, prior, number)
            out.append(folded)
            last = max(last, at)
        self.current.update((json.dumps(prior), number, last))
        if self.keep:
            self.handle.registerTimer(max(last + self.keep, now + 1))
        yield pd.DataFrame(out, columns=[*calendar.COLUMNS, *calendar.MADE], dtype=object)

    def close(self) -> None:
        pass


def calendar_changes(observations: DataFrame, late: str = "1 hour", keep_hours: int | None = None) -> DataFrame:
    """calendar.revisions() of a stream: a row for each observation, once the watermark has passed its time.

    Observations may arrive in any order that the watermark allows; those of one event are folded by seq, which rises
    with observed_at. Later ones than the watermark are dropped. The session needs the RocksDB state store
    (spark.sql.streaming.stateStore.providerClass).
    """
    timed = observations.withWatermark("observed_at", late).select(F.col("observed_at").alias("_at"), *(F.col(c) for c in observations.columns))
    rows = timed.select("_at", *(F.unix_micros(c).cast("string").alias(c) if c in calendar.TIMES else F.col(c) for c in calendar.COLUMNS))
    return calendar.from_text(rows.groupBy(*calendar.KEY).transformWithStateInPandas(CalendarEvent(keep_hours), calendar.FOLDED, "append", "eventTime"))


def append_stream(batches: DataFrame, log: EventLog, order: list[str], checkpoint: str):
    """Appends a stream of records to a log, a micro-batch at a time and under the log's own checks (fields, times, ids that
    are new everywhere, the next sequence numbers). A batch that any record breaks is rejected whole, and the query stops.

    A batch's number is written below the checkpoint before and after its append. A repeated batch with both marks is left
    alone; with the first alone, it has landed if its ids are in the log already, as an append lands whole or not at all.
    """

    def mark(spark: SparkSession, name: str) -> None:
        spark.range(1).write.mode("overwrite").parquet(f"{checkpoint}/marks/{name}")

    def marked(spark: SparkSession, name: str) -> bool:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/marks/{name}/_SUCCESS")
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if marked(spark, f"{number}-done"):
            return
        if not marked(spark, f"{number}-begun"):
            mark(spark, f"{number}-begun")
            log.append(batch, order)
        elif not log.holds(batch):
            log.append(batch, order)
        mark(spark, f"{number}-done")

    return batches.writeStream.foreachBatch(append).option("checkpointLocation", f"{checkpoint}/query").trigger(availableNow=True).start()


def to_log(df: DataFrame, path: str, checkpoint: str):
    """Appends a stream to a Parquet log; the checkpoint makes each record appear once."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
