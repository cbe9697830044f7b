"""Replays of domains: as of a record, from a snapshot on, and every fault."""

import json
from datetime import datetime, timedelta

import pytest

from newsmill.operators import replay
from newsmill.operators.event_log import SCHEMA

START = datetime(2024, 1, 1)


def record(k, stream, key, sequence, minute=None, payload=None, own=None):
    return (own or f"r{k}", stream, key, sequence, START + timedelta(minutes=k if minute is None else minute), "v1", "p1", "00", "phase", None, json.dumps(payload or {"k": k}), "c1")


def log_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


RAW, ITEM, RUNS = "ingestion-raw-payloads", "ingestion-normalized-items", "ingestion-runs"
HISTORY = [record(0, RAW, "a", 0, payload={"raw_payload_id": "p0"}), record(1, ITEM, "a", 0, 0, {"item_id": "i0", "raw_payload_id": "p0"}), record(2, RAW, "b", 0, payload={"raw_payload_id": "p1"}), record(3, RAW, "a", 1), record(4, ITEM, None, 0, 3, {"item_id": "i1", "raw_payload_id": "gone"}), record(5, RUNS, "a", 0)]


def ids(df):
    return sorted(r.record_id for r in df.select("record_id").collect())


def test_as_of_every_record(spark):
    """Records of one instant go by stream: the payload of minute 3 comes before the item."""
    log = log_of(spark, HISTORY)
    for k, upto in enumerate(["r0", "r1", "r2", "r3", "r4", "r5"]):
        assert ids(replay.replay(log, "ingestion", upto)) == [f"r{j}" for j in range(k + 1)]
    assert ids(replay.replay(log, "ingestion")) == [f"r{j}" for j in range(6)]
    with pytest.raises(ValueError, match="no record"):
        replay.replay(log, "ingestion", "nowhere")
    assert [tuple(r) for r in replay.broken_references(log, "ingestion").collect()] == [("item without payload", "i1")]


def test_snapshot_and_later_records(spark, tmp_path):
    log = log_of(spark, HISTORY)
    for k in (0, 2, 5):
        path = f"{tmp_path}/s{k}"
        replay.store(replay.replay(log, "ingestion", f"r{k}"), path)
        for upto in ("r5", None):
            got = replay.resume(spark, path, log, "ingestion", upto)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, log.collect())), k
    # only what comes later is checked: a gap, and an id of the snapshot under a new number
    with pytest.raises(ValueError, match="non-contiguous sequence in ingestion-raw-payloads::a"):
        replay.resume(spark, f"{tmp_path}/s2", log_of(spark, [record(9, RAW, "a", 2)]), "ingestion")
    with pytest.raises(ValueError, match="comes again"):
        replay.resume(spark, f"{tmp_path}/s2", log_of(spark, [record(9, RAW, "a", 1, own="r0")]), "ingestion")
    assert ids(replay.resume(spark, f"{tmp_path}/s2", log_of(spark, []), "ingestion")) == ["r0", "r1", "r2"]


@pytest.mark.parametrize(
    ("rows", "fault"),
    [
        ([record(0, "calendar-runs", "a", 0)], "unknown stream"), ([record(0, RAW, "a", 1)], "non-contiguous"), ([record(0, RAW, "a", 0), record(1, RAW, "a", 2)], "non-contiguous"),
        ([record(0, RAW, "a", 0), record(1, RAW, "a", 0)], "non-contiguous"), ([record(0, RAW, "a", 0), record(1, RAW, "b", 0, own="r0")], "duplicate record"), ([record(0, RAW, None, 0), record(1, RAW, None, 2)], "non-contiguous"),
    ],
)
def test_faults(spark, rows, fault):
    with pytest.raises(ValueError, match=fault):
        replay.replay(log_of(spark, rows), "ingestion")


def test_references(spark):
    member = lambda k, cluster, n, kind: record(k, "cluster-membership-events", cluster, n, payload={"cluster_id": cluster, "item_id": "i", "event_type": kind})
    good = [member(0, "c", 0, "added"), member(1, "c", 1, "removed_as_error")]
    assert replay.replay(log_of(spark, good), "clusters").count() == 2
    with pytest.raises(ValueError, match=r"unresolved references \['d::i'\]"):
        replay.replay(log_of(spark, [*good, member(2, "d", 0, "removed_as_error"), member(3, "d", 1, "added")]), "clusters")
    event = {"source_id": "s", "source_event_id": "e"}
    made = [record(k, "calendar-revisions", "s", k, payload=event | {"revision_number": k + 1}) for k in range(2)]
    superseded = record(2, "calendar-supersession-events", "s", 0, payload=event | {"superseded": 1, "superseding": 2})
    assert replay.replay(log_of(spark, [*made, superseded]), "calendar").count() == 3
    with pytest.raises(ValueError, match="s::e::1::2"):
        replay.replay(log_of(spark, [made[0], superseded]), "calendar")
    assert replay.replay(log_of(spark, [record(0, "whisper-decisions", None, 0)]), "whispers").count() == 1
