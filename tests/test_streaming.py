"""Streams from files against the batch result."""

import random
import shutil
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException

from newsmill.operators import calendar, event_log
from newsmill.streaming import streams

START = datetime(2024, 1, 1)


def drained(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()


def test_sliding_counts(spark, tmp_path):
    rows = [(k, START + timedelta(minutes=k * 2), k % 5, "ab"[k % 2], float(k), "{}") for k in range(120)]
    late = [(999, START, 1, "a", 1.0, "{}")]
    for n, part in enumerate((rows[:60], rows[60:], late)):
        (tmp_path / "in").mkdir(exist_ok=True)
        pdf = pd.DataFrame(part, columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
        pdf.to_parquet(f"{tmp_path}/in/events-{n}.parquet", coerce_timestamps="us", index=False)
    source = streams.event_stream(spark, f"{tmp_path}/in", 1)
    drained(streams.sliding(source.filter("event_id < 999")), "counts", "complete")
    got = {(r.start, r.event_type): r.n for r in spark.table("counts").collect()}
    want = {}
    for _, ts, _, kind, _, _ in rows:
        for back in range(3):
            start = ts - timedelta(minutes=ts.minute % 5) - timedelta(minutes=5 * back)
            if ts < start + timedelta(minutes=15):
                want[start, kind] = want.get((start, kind), 0) + 1
    assert got == want


def test_quiet_windows(spark, tmp_path):
    rows = [(1, "t", START), (2, "t", START + timedelta(minutes=119)), (3, "t", START + timedelta(minutes=120)), (4, "u", START + timedelta(minutes=5))]
    spark.createDataFrame(rows, "intent_id long, target_id string, at timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("intent_id long, target_id string, at timestamp").parquet(f"{tmp_path}/in")
    drained(streams.quiet_windows(source), "quiet")
    assert {r.intent_id: r.status for r in spark.table("quiet").collect()} == {1: "recorded", 2: "ignored", 3: "recorded", 4: "recorded"}


def test_log_sink(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "i long, x string").write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("i long, x string").parquet(f"{tmp_path}/in")
    for _ in range(2):
        streams.to_log(source, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


OBSERVED = "source_id string, source_event_id string, seq long, observed_at timestamp, status_hint string, scheduled_for timestamp, event_name string, country string, currency string, importance_tier string, event_category string, previous string, forecast string, actual string, revised string, source_url string"


def observations(n=90):
    """Events of three keys whose time, values and status change; every revision reason occurs."""
    rng = random.Random(4)
    rows = []
    for k in range(n):
        at = START + timedelta(minutes=10 * k)
        hint = rng.choice(["scheduled"] * 6 + ["cancelled", "postponed", "completed"])
        due = None if hint == "cancelled" and k % 2 else START + timedelta(days=rng.choice([1, 1, 2]))
        rows.append(("s", f"e{k % 3}", k, at, hint, due, "name", "US", None, rng.choice(["high", "high", "low"]), "macro", "1", rng.choice(["2", "2", "3"]), rng.choice([None, None, "4"]), None, "u"))
    return rows


def test_calendar_changes(spark, tmp_path):
    """Micro-batches in which neighbours come out of order, and a restart between them, give what the batch form gives."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows, rng = observations(), random.Random(9)
    want = {tuple(r) for r in calendar.revisions(spark.createDataFrame(rows, OBSERVED)).collect()}
    assert {r[4 + 2] for r in want} >= {"first_seen", "cancelled", "postponed", "actual_added", "time_changed", "forecast_changed", "metadata_changed", "unchanged_confirmation"}
    late = [(*rows[0][:2], 10_000, START - timedelta(days=3), *rows[0][4:])]
    far = [("z", "end", 10_001 + k, START + timedelta(days=90 + k), *rows[0][4:]) for k in range(2)]
    parts = [rows[k : k + 30] for k in range(0, 90, 30)]
    for n, part in enumerate([*parts, [far[0]], late, [far[1]]]):
        part = part[:]
        for k in range(0, len(part) - 4, 5):  # within the hour that the watermark waits
            block = part[k : k + 5]
            rng.shuffle(block)
            part[k : k + 5] = block
        if n == 1:  # the last of the batch before comes late
            part = [parts[0][-1], *part]
        elif n == 0:
            part = part[:-1] if part[-1] == parts[0][-1] else [r for r in part if r != parts[0][-1]]
        spark.createDataFrame(part, OBSERVED).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    for upto in (2, 6):  # a new query goes on from the checkpoint
        glob = f"{tmp_path}/in/[0-{upto - 1}]"
        source = spark.readStream.schema(OBSERVED).option("maxFilesPerTrigger", 1).parquet(glob)
        out = streams.calendar_changes(source)
        assert out.columns == [c.split()[0] for c in calendar.OUT.split(",")]
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").where("source_id = 's'").collect()]
    assert len(got) == len(want) and set(got) == want


def test_forgotten_events(spark, tmp_path):
    """After keep_hours without an observation an event begins anew."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    first = observations(1)[0]
    times = [0, 1, 100, 101, 400, 401]
    rows = [("s" if k % 100 == 0 else "z", "e", k, START + timedelta(hours=k), *first[4:]) for k in times]
    for n, r in enumerate(rows):
        spark.createDataFrame([r], OBSERVED).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    source = spark.readStream.schema(OBSERVED).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    drained(streams.calendar_changes(source, "1 minute", 200), "kept")
    got = {r.seq: (r.action, r.revision_number) for r in spark.table("kept").where("source_id = 's'").collect()}
    assert got == {0: ("create", 1), 100: ("confirm", 1), 400: ("create", 1)}


def test_quiet_windows_forget(spark, tmp_path):
    """A target's state goes with its window, and a later dismissal is recorded."""
    rows = [(1, "t", START), (2, "t", START + timedelta(minutes=30)), (3, "u", START + timedelta(days=2)), (4, "t", START + timedelta(days=2, minutes=1)), (5, "t", START + timedelta(days=2, minutes=2))]
    for n, r in enumerate(rows):
        spark.createDataFrame([r], "intent_id long, target_id string, at timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    source = spark.readStream.schema("intent_id long, target_id string, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    drained(streams.quiet_windows(source), "forgotten")
    assert {r.intent_id: r.status for r in spark.table("forgotten").collect()} == {1: "recorded", 2: "ignored", 3: "recorded", 4: "recorded", 5: "ignored"}


RECORD = "record_id string, stream_name string, stream_key string, recorded_at timestamp, schema_version string, producer_version string, source_phase string, reason string, payload string"


def records(ids, payload="{}"):
    return [(f"r{k}", "calendar-runs", "s", START + timedelta(minutes=k), "v1", "p1", "calendar", None, payload) for k in ids]


def test_append_stream(spark, tmp_path):
    log = event_log.EventLog(spark, f"{tmp_path}/log")
    source = spark.readStream.schema(RECORD).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")

    def deliver(n, rows):
        spark.createDataFrame(rows, RECORD).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        streams.append_stream(source, log, ["recorded_at", "record_id"], f"{tmp_path}/check").awaitTermination()

    deliver(0, records(range(3)))
    deliver(1, records(range(3, 5)))
    held = lambda: [(r.record_id, r.sequence) for r in event_log.replayed(log.read_all()).collect()]
    want = [(f"r{k}", k) for k in range(5)]
    assert held() == want
    # the query's own mark of the last batch is lost: the batch comes again and is left alone
    shutil.rmtree(f"{tmp_path}/check/query/commits")
    streams.append_stream(source, log, ["recorded_at", "record_id"], f"{tmp_path}/check").awaitTermination()
    assert held() == want
    # it ended between the append and its mark: the records are there already
    shutil.rmtree(f"{tmp_path}/check/query/commits")
    shutil.rmtree(f"{tmp_path}/check/marks/1-done")
    streams.append_stream(source, log, ["recorded_at", "record_id"], f"{tmp_path}/check").awaitTermination()
    assert held() == want
    # it ended before the append
    shutil.rmtree(f"{tmp_path}/check/query/commits")
    shutil.rmtree(f"{tmp_path}/check/marks/1-done")
    shutil.rmtree(f"{tmp_path}/log")
    log.append(spark.createDataFrame(records(range(3)), RECORD), ["recorded_at", "record_id"])
    streams.append_stream(source, log, ["recorded_at", "record_id"], f"{tmp_path}/check").awaitTermination()
    assert held() == want
    # one id of a new batch is in the log: nothing of the batch lands
    with pytest.raises(StreamingQueryException, match="in the log already"):
        deliver(2, records([4, 5, 6]))
    assert held() == want
