"""Queries of whole flows: readiness, RSS and calendar payloads, the event log, sessions and audited runs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.hashing import canonical_text
from ..operators import attempts, audit, event_log, gates, readiness, replay, summaries, whispers
from ..operators.lineage import cut
from ..sources import calendar as calendar_source
from ..sources import dataset, rss
from .inputs import now, table
from .queries import _PHRASES, _SCORES, _annotated, _checkpointed, query


def _folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share."""
    _checkpointed(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


_PROFILES = """
WITH p AS (
  SELECT c_custkey AS k, CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE c_custkey % 11 <> 0 END AS enabled, CASE c_custkey % 13 WHEN 0 THEN 'needs_review' WHEN 1 THEN 'blocked' WHEN 2 THEN 'unknown' WHEN 3 THEN NULL ELSE 'allowed' END AS legal,
         CASE c_custkey % 17 WHEN 0 THEN 'needs_review' WHEN 1 THEN 'blocked' WHEN 2 THEN NULL ELSE 'allowed' END AS tos, c_custkey % 19 <> 0 AS parses, c_custkey % 23 <> 0 AS offline, c_custkey % 31 <> 0 AS typed,
         CASE WHEN c_custkey % 37 = 0 THEN 0 ELSE 15 + c_custkey % 8 END AS most, c_custkey % 41 <> 0 AS timed,
         ['none', 'success', 'success', 'success', 'timeout', 'http_error', 'empty', 'unsupported_content_type', 'oversized', 'malformed', 'other'][CAST(c_custkey % 11 + 1 AS INT)] AS kind,
         CASE WHEN c_custkey % 2 = 0 THEN 503 ELSE 404 END AS http, c_custkey % 5 <> 0 AS right_type, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_name END AS body FROM customer),
r AS (SELECT *, CASE WHEN enabled IS NULL THEN 'source_not_enabled' WHEN NOT enabled THEN 'source_disabled' WHEN legal IN ('needs_review', 'blocked', 'unknown') THEN 'source_legal_' || legal WHEN legal IS NULL THEN 'source_missing_legal_status'
  WHEN tos IN ('needs_review', 'blocked') THEN 'tos_' || tos WHEN tos IS NULL THEN 'tos_missing' WHEN NOT parses THEN 'parser_unsupported' WHEN NOT offline THEN 'acquisition_mode_not_offline_ready' WHEN NOT typed THEN 'content_type_unsupported'
  WHEN most <= 0 THEN 'max_payload_missing' WHEN NOT timed THEN 'timeout_missing' END AS skip_reason FROM p)"""


@query(_PROFILES + """,
c AS (SELECT *, CASE WHEN skip_reason IS NOT NULL THEN NULL WHEN kind = 'success' THEN CASE WHEN body = '' THEN 'empty_payload' WHEN NOT right_type THEN 'unsupported_content_type' WHEN length(body) > most THEN 'payload_too_large' END
  WHEN kind = 'timeout' THEN 'network_timeout' WHEN kind = 'none' THEN 'transport_unavailable' WHEN kind = 'http_error' THEN 'http_status_failure' WHEN kind = 'empty' THEN 'empty_payload' WHEN kind = 'unsupported_content_type' THEN kind
  WHEN kind = 'oversized' THEN 'payload_too_large' WHEN kind = 'malformed' THEN 'malformed_payload' ELSE 'unknown_failure' END AS code FROM r),
o AS (SELECT *, CASE WHEN skip_reason IS NOT NULL THEN 'skipped' WHEN code IS NULL THEN 'fetched' WHEN code IN ('unsupported_content_type', 'payload_too_large', 'malformed_payload') THEN 'quarantined' ELSE 'failed' END AS outcome FROM c)
SELECT CAST(k AS VARCHAR) AS source_id, outcome, skip_reason, code AS failure_code, coalesce(code IN ('network_timeout', 'transport_unavailable') OR (code = 'http_status_failure' AND http >= 500), FALSE) AS retryable,
       CASE WHEN outcome = 'fetched' THEN 'recorded' WHEN code = 'malformed_payload' THEN 'quarantined' WHEN outcome = 'quarantined' THEN 'rejected' END AS payload_status,
       CASE WHEN outcome IN ('fetched', 'quarantined') THEN 'pay-run-' || k END AS payload_id, CASE WHEN outcome IN ('fetched', 'quarantined') AND (code IS NULL OR code = 'malformed_payload') THEN body END AS payload_text FROM o""")
def readiness_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as source profiles, with what an offline fetch of each gives."""
    c = table(spark, sf, "customer")
    case = lambda e: F.expr(e.replace("k %", "c_custkey %"))
    source_id = F.col("c_custkey").cast("string").alias("source_id")
    profiles = c.select(
        source_id, case("CASE WHEN k % 29 = 0 THEN NULL ELSE k % 11 <> 0 END").alias("enabled"), case("CASE k % 13 WHEN 0 THEN 'needs_review' WHEN 1 THEN 'blocked' WHEN 2 THEN 'unknown' WHEN 3 THEN NULL ELSE 'allowed' END").alias("legal_status"),
        case("CASE k % 17 WHEN 0 THEN 'needs_review' WHEN 1 THEN 'blocked' WHEN 2 THEN NULL ELSE 'allowed' END").alias("tos_status"), case("CASE WHEN k % 19 = 0 THEN 'partial' ELSE 'supported' END").alias("parser_support"),
        case("CASE WHEN k % 23 = 0 THEN 'live' ELSE 'recorded_fixture' END").alias("acquisition_mode"), case("CASE WHEN k % 31 = 0 THEN cast(array() AS array<string>) ELSE array('application/rss+xml') END").alias("allowed_content_types"),
        case("CASE WHEN k % 37 = 0 THEN 0 ELSE 15 + k % 8 END").alias("max_payload_bytes"), case("CASE WHEN k % 41 = 0 THEN NULL ELSE 1000 END").alias("timeout_ms"),
    )
    kinds = F.array(*map(F.lit, ["none", "success", "success", "success", "timeout", "http_error", "empty", "unsupported_content_type", "oversized", "malformed", "other"]))
    results = c.select(
        source_id, F.get(kinds, (F.col("c_custkey") % 11).cast("int")).alias("kind"), case("CASE WHEN k % 2 = 0 THEN 503 ELSE 404 END").alias("http_status"), case("CASE WHEN k % 5 = 0 THEN 'text/html' ELSE 'application/rss+xml' END").alias("content_type"),
        case("CASE WHEN k % 7 = 0 THEN '' ELSE c_name END").alias("payload_text"), F.lit(None).cast("long").alias("byte_length"),
    ).where("kind <> 'none'")
    return readiness.outcomes(profiles, results, "run").select("source_id", "outcome", "skip_reason", "failure_code", "retryable", "payload_status", "payload_id", "payload_text")


@query(_PROFILES + " SELECT CAST(k AS VARCHAR) AS source_id, enabled AND legal = 'allowed' AND k % 2 = 0 AS fetch_eligible, CASE WHEN legal = 'needs_review' THEN 'quarantined' WHEN NOT enabled THEN 'disabled' WHEN k % 2 = 1 THEN 'unsupported' ELSE 'eligible' END AS eligibility FROM p WHERE enabled IS NOT NULL AND legal IN ('needs_review', 'allowed')")
def calendar_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as sources, half of them calendars, at the calendar's gate."""
    rows = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("source_id"), F.expr("CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE c_custkey % 11 <> 0 END").alias("enabled"), F.expr("CASE c_custkey % 13 WHEN 0 THEN 'needs_review' WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE 'allowed' END").alias("legal_status"), F.expr("CASE WHEN c_custkey % 2 = 0 THEN 'economic_calendar_fixture' ELSE 'rss_fixture' END").alias("source_type"))
    return gates.gated(rows.where("enabled is not null and legal_status is not null"), gates.CALENDAR_TYPES).select("source_id", "fetch_eligible", "eligibility")


def _feeds(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as RSS payloads, each source's in as many as its documents need; some lack a title, a link and an id."""
    docs = table(spark, sf, "documents").select(
        F.concat_ws("-", "source", (F.col("doc_id") / 64).cast("long").cast("string")).alias("source_id"), F.expr("CASE WHEN doc_id % 23 = 0 THEN '' ELSE cast(doc_id - doc_id % 6 % 2 AS string) END").alias("article_id"),
        F.expr("CASE WHEN doc_id % 17 = 0 THEN ' ' ELSE concat('Note ', doc_id) END").alias("title"), F.col("lang").alias("text"), F.expr("CASE WHEN doc_id % 46 = 0 THEN '' ELSE concat('https://news.example.org/', doc_id) END").alias("url"),
        F.expr("CASE WHEN doc_id % 5 <> 0 THEN timestamp_millis(1704067200000 + doc_id * 60000) END").alias("published_at"),
    )
    return dataset.to_rss(docs)


_FEEDS = """
WITH d AS (SELECT doc_id, source || '-' || (doc_id // 64) AS source_id, CASE WHEN doc_id % 23 = 0 THEN '' ELSE CAST(doc_id - doc_id % 6 % 2 AS VARCHAR) END AS guid, CASE WHEN doc_id % 46 = 0 THEN '' ELSE 'https://news.example.org/' || doc_id END AS link, doc_id % 17 = 0 AS untitled,
  CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN 1704067200000 + doc_id * 60000 > 1704153600000 THEN 'future' ELSE 'valid' END AS state FROM documents),
i AS (SELECT *, coalesce(nullif(guid, ''), nullif(link, '')) AS own, CASE WHEN guid = '' AND link = '' THEN 'missing_identity' WHEN untitled THEN 'missing_title' END AS bad FROM d)"""


@query(_FEEDS + """
SELECT source_id || '::' || own AS item_id, CASE state WHEN 'valid' THEN 'known' WHEN 'future' THEN 'caveat_future' ELSE 'unknown' END AS source_event_time_status, CASE WHEN state = 'valid' THEN 'reported' ELSE 'unverified' END AS verification_tier, CASE WHEN state = 'valid' THEN 'live' ELSE 'unknown' END AS freshness_state, 'Note ' || doc_id AS title
FROM (SELECT *, row_number() OVER (PARTITION BY source_id, own ORDER BY 'Note ' || doc_id) AS n FROM i WHERE bad IS NULL) WHERE n = 1""")
def rss_normalised(spark: SparkSession, sf: str) -> DataFrame:
    """Parsed items of all feeds as external items; the first of an identity stays."""
    known = _feeds(spark, sf)
    rows = rss.normalised(rss.scanned(known, now()), known.select("source_id"), now())
    return rows.select("item_id", "source_event_time_status", "verification_tier", "freshness_state", "title")


@query(_FEEDS + """, n AS (SELECT source_id, count(DISTINCT own) FILTER (bad IS NULL) AS items, count(*) FILTER (bad IS NOT NULL) AS malformed FROM i GROUP BY source_id),
s AS (SELECT *, CAST(regexp_extract(source_id, 'src(\\d+)', 1) AS INT) AS k FROM n)
SELECT source_id, CASE k % 10 WHEN 8 THEN 'legal_status_needs_review' WHEN 9 THEN 'legal_status_disabled' END AS skip_reason, CASE WHEN k % 10 >= 8 THEN 'skipped' WHEN items = 0 THEN 'failed' WHEN malformed > 0 THEN 'partial_success' ELSE 'success' END AS status, items, malformed FROM s""")
def rss_runs(spark: SparkSession, sf: str) -> DataFrame:
    """A row for the run of each feed."""
    payloads = _feeds(spark, sf)
    n = F.regexp_extract("source_id", r"src(\d+)", 1).cast("int") % 10
    known = payloads.select("source_id", F.when(n == 8, "needs_review").when(n == 9, "disabled").otherwise("allowed").alias("legal_status"), F.lit(True).alias("enabled"), F.lit("rss_fixture").alias("source_type"))
    return rss.runs(payloads, rss.scanned(payloads, now()), known).select("source_id", "skip_reason", "status", "items", "malformed")


_CALENDARS = """
WITH e AS (
  SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'ev-' || event_id END AS given, CASE WHEN event_id % 14 = 0 THEN NULL ELSE 'key-' || event_id END AS given_key, CASE WHEN event_id % 11 = 0 THEN ' ' ELSE '<b>CPI &amp; ' || event_id || '</b>' END AS name,
         ['scheduled', 'Cancelled', 'postponed', 'COMPLETED', 'odd'][CAST(event_id % 5 + 1 AS INT)] AS status, ['high', 'Medium', 'low', 'urgent'][CAST(event_id % 4 + 1 AS INT)] AS importance,
         CASE event_id % 9 WHEN 0 THEN NULL WHEN 1 THEN 'soon' ELSE '2024-01-02T10:00:00Z' END AS due FROM events),
h AS (SELECT *, lower(status) IN ('scheduled', 'cancelled', 'postponed', 'completed') AS known, CASE WHEN due IS NULL THEN 'missing_scheduled_for' WHEN due = 'soon' THEN 'invalid_scheduled_for' END AS no_time FROM e),
q AS (SELECT *, CASE WHEN known THEN lower(status) ELSE 'scheduled' END AS hint, coalesce(given, given_key) AS own FROM h),
b AS (SELECT *, CASE WHEN own IS NULL THEN 'missing_identity' WHEN trim(name) = '' THEN 'missing_event_name' WHEN hint = 'scheduled' THEN no_time END AS bad FROM q)"""


@query(_CALENDARS + """
SELECT event_id, own AS source_event_id, CASE WHEN trim(name) <> '' THEN 'CPI & ' || event_id END AS event_name, hint AS status_hint, CASE WHEN lower(importance) = 'urgent' THEN 'unknown' ELSE lower(importance) END AS importance_tier, bad AS quarantine_reason,
       CASE WHEN bad IS NOT NULL THEN bad ELSE array_to_string(list_filter([CASE WHEN NOT known THEN 'invalid_status' END, CASE WHEN lower(importance) = 'urgent' THEN 'importance_downgraded' END, no_time], lambda x: x IS NOT NULL), ',') END AS warnings FROM b""")
def calendar_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Events as calendar payloads of one event each, scanned again."""
    e = table(spark, sf, "events")
    field = lambda sql, name: F.expr(sql).alias(name)
    event = F.struct(
        field("CASE WHEN event_id % 7 <> 0 THEN concat('ev-', event_id) END", "sourceEventId"), field("CASE WHEN event_id % 14 <> 0 THEN concat('key-', event_id) END", "canonicalEventKey"), field("CASE WHEN event_id % 11 = 0 THEN ' ' ELSE concat('<b>CPI &amp; ', event_id, '</b>') END", "eventName"),
        field("get(array('scheduled', 'Cancelled', 'postponed', 'COMPLETED', 'odd'), cast(event_id % 5 AS int))", "status"), field("get(array('high', 'Medium', 'low', 'urgent'), cast(event_id % 4 AS int))", "importance"),
        field("CASE event_id % 9 WHEN 0 THEN NULL WHEN 1 THEN 'soon' ELSE '2024-01-02T10:00:00Z' END", "scheduledFor"),
    )
    payloads = e.select(F.col("event_type").alias("source_id"), F.col("event_id").cast("string").alias("raw_payload_id"), F.to_json(F.struct(F.array(event).alias("events"))).alias("payload_text"), F.col("ts").cast("timestamp").alias("observed_at"))
    rows = calendar_source.scanned(payloads.where(calendar_source.payload_state() == "ok"))
    return rows.select(F.col("raw_payload_id").cast("long").alias("event_id"), "source_event_id", F.nullif("event_name", F.lit("")).alias("event_name"), "status_hint", "importance_tier", "quarantine_reason", F.array_join("warnings", ",").alias("warnings"))


@query("SELECT 'r' || event_id AS record_id, event_type AS stream_name, CAST(user_id AS VARCHAR) AS stream_key, CAST(row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id % 2, ts, event_id) - 1 AS BIGINT) AS sequence, event_id FROM events")
def log_append_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Events appended to a new log in two batches, checked for gaps and repeats, and read back with their payloads."""
    e = table(spark, sf, "events")
    rows = e.select(
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("record_id"), F.col("event_type").alias("stream_name"), F.col("user_id").cast("string").alias("stream_key"), F.col("ts").cast("timestamp").alias("recorded_at"), F.lit("event-v1").alias("schema_version"),
        F.lit("events-producer-v1").alias("producer_version"), F.lit("events").alias("source_phase"), F.lit(None).cast("string").alias("reason"), F.to_json(F.struct("event_id", "value")).alias("payload"), "event_id",
    )
    log = event_log.EventLog(spark, _folder(spark, "log"))
    for part in (0, 1):
        log.append(rows.where(F.col("event_id") % 2 == part), ["recorded_at", "event_id"])
    back = log.read_all()
    return event_log.replayed(back).select("record_id", "stream_name", "stream_key", "sequence", F.get_json_object("payload", "$.event_id").cast("long").alias("event_id"))


@query("""
WITH e AS (SELECT event_id, ts, 'r' || event_id AS record_id, CAST(user_id AS VARCHAR) AS stream_key, CAST(event_id % 4 + 1 AS BIGINT) AS place, ['ingestion-raw-payloads', 'ingestion-normalized-items', 'ingestion-malformed-items', 'ingestion-runs'][CAST(event_id % 4 + 1 AS INT)] AS stream_name FROM events),
s AS (SELECT *, row_number() OVER (PARTITION BY stream_name, stream_key ORDER BY ts, event_id) - 1 AS sequence FROM e),
m AS (SELECT ts, place, sequence, record_id FROM s ORDER BY abs(event_id - (SELECT max(event_id) * 2 // 3 FROM events)), event_id LIMIT 1)
SELECT s.stream_name, s.stream_key, count(*) AS records, CAST(max(s.sequence) AS BIGINT) AS last, CAST(sum(event_id) AS BIGINT) AS events FROM s, m WHERE (s.ts, s.place, s.sequence, s.record_id) <= (m.ts, m.place, m.sequence, m.record_id) GROUP BY 1, 2""")
def replay_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """Events as the ingestion streams' records: a snapshot as of one of them, stored, and resumed up to a later one."""
    _checkpointed(spark)
    e = table(spark, sf, "events")
    name = F.get(F.array(*map(F.lit, replay.DOMAINS["ingestion"])), (F.col("event_id") % 4).cast("int"))
    rows = e.select(
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("record_id"), name.alias("stream_name"), F.col("user_id").cast("string").alias("stream_key"), F.col("ts").cast("timestamp").alias("recorded_at"), F.lit("v1").alias("schema_version"),
        F.lit("p1").alias("producer_version"), F.lit("ingestion").alias("source_phase"), F.lit(None).cast("string").alias("reason"), F.to_json(F.struct("event_id")).alias("payload"), "event_id",
    )
    log = event_log.sequenced(rows, None, ["recorded_at", "event_id"]).withColumns({"payload_hash": F.lit(""), "contract_version": F.lit(event_log.CONTRACT)})
    log = cut(log.drop("event_id"))
    most = e.agg(F.max("event_id")).first()[0] or 0
    near = lambda k: e.orderBy(F.abs(F.col("event_id") - k), "event_id").select("event_id", "ts").first()
    early, late = near(most // 3), near(most * 2 // 3)
    if late is None:
        history = log
    else:
        folder = _folder(spark, "snapshot")
        replay.store(replay.replay(log, "ingestion", f"r{early[0] if early[1] < late[1] else late[0]}"), folder)
        history = replay.resume(spark, folder, log, "ingestion", f"r{late[0]}")
    rows = history.withColumn("event_id", F.get_json_object("payload", "$.event_id").cast("long"))
    return rows.groupBy("stream_name", "stream_key").agg(F.count("*").alias("records"), F.max("sequence").alias("last"), F.sum("event_id").alias("events"))


@query("""
WITH v AS (SELECT event_id, user_id, event_id % 10 = 0 AS suppressed FROM events),
d AS (SELECT event_id AS seq, user_id, epoch_ms(ts) + 7200000 > 1704153600000 AS live FROM events WHERE event_id % 40 = 1),
dt AS (SELECT user_id, min(seq) FILTER (live) AS held, bool_or(NOT live) AS expired FROM d GROUP BY user_id),
a AS (SELECT event_id AS seq, event_id - 1 AS decision, user_id, CASE WHEN event_id % 3 = 0 THEN 'seen' ELSE 'opened' END AS kind FROM events WHERE event_id % 7 = 2),
x AS (SELECT decision AS event_id, min(seq) FILTER (kind = 'seen') AS seen, min(seq) FILTER (kind = 'opened') AS opened FROM a GROUP BY 1),
y AS (SELECT user_id, min(seq) FILTER (kind = 'seen') AS seen, min(seq) FILTER (kind = 'opened') AS opened FROM a GROUP BY 1),
j AS (SELECT v.*, held, coalesce(expired, FALSE) AS expired, least(x.seen, y.seen) AS seen, least(x.opened, y.opened) AS opened FROM v LEFT JOIN dt ON v.user_id = dt.user_id LEFT JOIN x ON v.event_id = x.event_id LEFT JOIN y ON v.user_id = y.user_id)
SELECT CAST(event_id AS VARCHAR) AS decision_id, CASE WHEN suppressed THEN 'inspection' WHEN held IS NOT NULL THEN 'held' ELSE 'active' END AS placement,
  CASE WHEN suppressed THEN 'suppressed_inspection_only' WHEN held IS NOT NULL THEN 'dismissed_quiet_window' WHEN expired THEN 'expired_quiet_window' WHEN seen IS NOT NULL THEN 'seen_no_suppression' WHEN opened IS NOT NULL THEN 'open_audit_no_suppression' ELSE 'active' END AS projection_reason,
  CASE WHEN suppressed THEN NULL WHEN held IS NOT NULL THEN 'd' || held WHEN expired THEN NULL WHEN seen IS NOT NULL THEN 'a' || seen WHEN opened IS NOT NULL THEN 'a' || opened END AS record_id FROM j""")
def session_view(spark: SparkSession, sf: str) -> DataFrame:
    """Events as views, dismissals and interactions of their users' items."""
    e = table(spark, sf, "events").withColumns({"target_type": F.lit("item"), "target_id": F.col("user_id").cast("string"), "seq": F.col("event_id")})
    views = e.select(F.col("event_id").cast("string").alias("decision_id"), "target_type", "target_id", F.when(F.col("event_id") % 10 == 0, "suppress").otherwise("whisper").alias("level"))
    until = F.timestamp_millis(F.unix_millis(F.col("ts").cast("timestamp")) + 7_200_000)
    dismissals = e.where("event_id % 40 = 1").select("target_type", "target_id", F.concat(F.lit("d"), F.col("event_id").cast("string")).alias("dismissal_id"), until.alias("quiet_until"), "seq")
    kind = F.when(F.col("event_id") % 3 == 0, "mark_seen").otherwise("open_audit")
    acts = e.where("event_id % 7 = 2").select((F.col("event_id") - 1).cast("string").alias("decision_id"), "target_type", "target_id", kind.alias("interaction_type"), F.concat(F.lit("a"), F.col("event_id").cast("string")).alias("record_id"), "seq")
    return whispers.session_view(views, dismissals, acts, now()).select("decision_id", "placement", "projection_reason", "record_id")


def _runs(spark: SparkSession, sf: str, name: str, key: str, nation: str, fields: list[str]) -> DataFrame:
    """A table's rows as records of runs, a run a nation."""
    rows = table(spark, sf, name).select(F.concat(F.lit("run-"), F.col(nation).cast("string")).alias("run_id"), F.lpad(F.col(key).cast("string"), 12, "0").alias("key"), F.to_json(F.struct(*fields)).alias("payload"))
    return audit.contents({"normalized_item": rows})


@query("""
WITH RECURSIVE s AS (SELECT 'run-' || s_nationkey AS run_id, row_number() OVER (PARTITION BY s_nationkey ORDER BY lpad(CAST(s_suppkey AS VARCHAR), 12, '0')) - 1 AS k, '{"s_name":"' || s_name || '","s_nationkey":' || s_nationkey || '}' AS payload FROM supplier),
c AS (SELECT run_id, k, NULL::VARCHAR AS previous, sha256('{"payload":' || payload || ',"previousHash":null,"sequence":0,"type":"normalized_item"}') AS hash FROM s WHERE k = 0
  UNION ALL SELECT s.run_id, s.k, c.hash, sha256('{"payload":' || payload || ',"previousHash":"' || c.hash || '","sequence":' || s.k || ',"type":"normalized_item"}') FROM c JOIN s ON s.run_id = c.run_id AND s.k = c.k + 1)
SELECT run_id, CAST(k AS BIGINT) AS sequence, previous AS previous_hash, hash FROM c""")
def audit_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as audited runs, one a nation: their chains."""
    return audit.ledger(_runs(spark, sf, "supplier", "s_suppkey", "s_nationkey", ["s_nationkey", "s_name"])).select("run_id", "sequence", "previous_hash", "hash")


_DAMAGE = "CASE n % 8 WHEN 1 THEN 'audit file integrity mismatch' WHEN 2 THEN 'run semantic identity mismatch' WHEN 3 THEN 'manifest identity mismatch' WHEN 4 THEN 'audit chain is broken' WHEN 5 THEN 'audit ledger is truncated' WHEN 6 THEN 'the ledger doesn''t describe the run' END"


@query(f"SELECT DISTINCT 'run-' || n AS run_id, {_DAMAGE} AS problem FROM (SELECT c_nationkey AS n FROM customer)")
def audit_damage(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as audited runs, one a nation, six of eight damaged in different ways. Whoever damages a run makes new
    digests of its tables where that hides the damage from the first check."""
    _checkpointed(spark)
    records = cut(_runs(spark, sf, "customer", "c_custkey", "c_nationkey", ["c_name", "c_acctbal"]))
    runs = audit.sealed(records)
    kind = F.substring_index("run_id", "-", -1).cast("int") % 8
    least = records.groupBy("run_id").agg(F.min("key").alias("least"))
    first = F.col("key") == F.col("least")
    # 1: a payload; 2: a payload, then chain and digests anew; 6: a record is taken from the ledger, its digests anew
    edited = records.join(F.broadcast(least), "run_id").withColumn("payload", F.when(kind.isin(1, 2) & first, F.lit('{"c_name":"other"}')).otherwise(F.col("payload"))).withColumn("content", F.sha2("payload", 256))
    told = edited.where(~((kind == 6) & first)).drop("least")
    edited = cut(edited.drop("least"))
    chain = cut(audit.ledger(told.where(kind != 1)).unionByName(runs.chain.where(kind == 1)))
    last = chain.groupBy("run_id").agg(F.max("sequence").alias("last"))
    # 4: a link's hash before it; 5: the last link is missing; both with digests anew
    damaged = chain.join(F.broadcast(last), "run_id").where((kind != 5) | (F.col("sequence") < F.col("last"))).withColumn("previous_hash", F.when((kind == 4) & (F.col("sequence") == F.col("last")), "x").otherwise(F.col("previous_hash")))
    damaged = cut(damaged.select(*chain.columns))
    honest = audit.manifest(chain, records).where(kind.isin(0, 1, 3, 7)).withColumn("schema_version", F.when(kind == 3, "audit-manifest-v0").otherwise(F.col("schema_version")))
    renewed = audit.manifest(damaged, edited).where(kind.isin(2, 4, 5, 6))
    kept = audit.manifest(chain, edited).select("run_id", F.col("event_count").alias("whole"), F.col("final_hash").alias("end"))
    renewed = renewed.join(kept, "run_id").withColumns({"event_count": F.when(kind == 5, F.col("whole")).otherwise(F.col("event_count")), "final_hash": F.when(kind == 5, F.col("end")).otherwise(F.col("final_hash"))}).drop("whole", "end")
    return audit.problems(audit.Runs(edited, runs.documents, damaged, honest.unionByName(renewed)))


_JSONS = """SELECT doc_id, '{"z": {"b": [' || doc_id || ', {"y": null, "x": "' || lang || '"}], "a": ' || (doc_id % 2 = 0) || '}, "Z": ' || (doc_id % 1000) || CASE doc_id % 5 WHEN 0 THEN '.50' WHEN 1 THEN 'e3' WHEN 2 THEN '.0' ELSE '' END || ', "é": [[], {}, "' || source || '"], "a": -0}' AS given,
  '{"Z":' || CASE doc_id % 5 WHEN 0 THEN (doc_id % 1000) || '.5' WHEN 1 THEN CAST(doc_id % 1000 * 1000 AS VARCHAR) ELSE CAST(doc_id % 1000 AS VARCHAR) END || ',"a":0,"z":{"a":' || (doc_id % 2 = 0) || ',"b":[' || doc_id || ',{"x":"' || lang || '","y":null}]},"é":[[],{},"' || source || '"]}' AS canonical FROM documents"""


@query(f"SELECT doc_id, sha256(canonical) AS hash FROM ({_JSONS})")
def canonical_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Nested JSON of each document, its keys in no order and its numbers in other forms, hashed in canonical form."""
    number = F.expr("concat(doc_id % 1000, CASE doc_id % 5 WHEN 0 THEN '.50' WHEN 1 THEN 'e3' WHEN 2 THEN '.0' ELSE '' END)")
    given = F.concat(
        F.lit('{"z": {"b": ['), F.col("doc_id").cast("string"), F.lit(', {"y": null, "x": "'), F.col("lang"), F.lit('"}], "a": '), (F.col("doc_id") % 2 == 0).cast("string"), F.lit('}, "Z": '), number, F.lit(', "é": [[], {}, "'), F.col("source"), F.lit('"], "a": -0}'),
    )
    return table(spark, sf, "documents").select("doc_id", F.sha2(canonical_text(given), 256).alias("hash"))


@query("""
WITH a AS (SELECT event_id, event_id % 3 + 1 AS number, event_id % 31 <> 0 AS priced, CASE event_id % 13 WHEN 0 THEN 'timeout' WHEN 1 THEN 'network' END AS error, [200, 429, 503, 404, 200, 201][CAST(event_id % 6 + 1 AS INT)] AS http,
  event_id % 17 <> 0 AS fits, event_id % 19 = 0 AS refused, event_id % 23 <> 0 AS done, event_id % 29 <> 0 AS is_json FROM events)
SELECT event_id, CASE WHEN NOT priced THEN 'budget_exceeded_or_unpriced_model' WHEN error = 'timeout' THEN 'provider_timeout' WHEN error IS NOT NULL THEN 'provider_network_error' WHEN http IN (429, 503) AND number < 3 THEN 'retry'
  WHEN http > 299 THEN 'provider_http_' || http WHEN NOT fits THEN 'invalid_provider_envelope' WHEN refused THEN 'provider_refused' WHEN NOT done THEN 'provider_incomplete' WHEN NOT is_json THEN 'invalid_output_json' END AS outcome FROM a""")
def provider_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Events as attempts of a provider."""
    e = lambda sql, name: F.expr(sql).alias(name)
    rows = table(spark, sf, "events").select(
        "event_id", e("event_id % 3 + 1", "number"), e("event_id % 31 <> 0", "priced"), e("CASE event_id % 13 WHEN 0 THEN 'timeout' WHEN 1 THEN 'network' END", "error"), e("get(array(200, 429, 503, 404, 200, 201), cast(event_id % 6 AS int))", "http_status"),
        e("event_id % 17 <> 0", "envelope_ok"), e("event_id % 19 = 0", "refused"), e("CASE WHEN event_id % 23 = 0 THEN 'incomplete' ELSE 'completed' END", "envelope_status"), e("event_id % 29 <> 0", "output_json_ok"),
    )
    return rows.select("event_id", summaries.provider_outcome().alias("outcome"))


@query("""
WITH RECURSIVE r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS k, CASE WHEN event_id % 41 <> 0 THEN CAST(event_id * 7919 % 1000 + 1 AS DECIMAL(18,8)) / 1000 END AS ceiling FROM events),
w AS (SELECT CAST(0 AS BIGINT) AS k, CAST(0 AS DECIMAL(18,8)) AS used, FALSE AS reserved
  UNION ALL SELECT r.k, CAST(CASE WHEN used + ceiling <= 7.5 THEN used + ceiling ELSE used END AS DECIMAL(18,8)), coalesce(used + ceiling <= 7.5, FALSE) FROM w JOIN r ON r.k = w.k + 1)
SELECT event_id, reserved FROM w JOIN r ON w.k = r.k""")
def budget_reservations(spark: SparkSession, sf: str) -> DataFrame:
    """Events as priced requests of one budget, some without a price: first come, first served."""
    _checkpointed(spark)
    price = F.expr("CASE WHEN event_id % 41 <> 0 THEN cast(event_id * 7919 % 1000 + 1 AS decimal(18,8)) / 1000 END")
    requests = table(spark, sf, "events").select("event_id", F.col("event_id").alias("seq"), price.alias("ceiling"))
    return summaries.within_budget(requests, 7.5).select("event_id", "reserved")


#: A request's ceiling in USD, and the run's budget.
_CEILING, _RUN_BUDGET = 0.0009, 9.0


@query(f"""
WITH e AS (SELECT event_id, event_id % 9 <> 4 AS eligible, event_id % 37 <> 0 AS known, CASE event_id % 13 WHEN 0 THEN 'timeout' WHEN 1 THEN 'network' END AS error, event_id % 6 AS h, event_id % 5 AS j FROM events),
r1 AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS k FROM e WHERE eligible AND known), a1 AS (SELECT event_id FROM r1 WHERE k <= {int(_RUN_BUDGET / _CEILING + 1e-9)}),
t1 AS (SELECT e.* FROM e JOIN a1 ON e.event_id = a1.event_id), r2 AS (SELECT event_id, row_number() OVER (ORDER BY event_id) + (SELECT count(*) FROM a1) AS k FROM t1 WHERE error IS NULL AND h IN (1, 2)),
a2 AS (SELECT event_id FROM r2 WHERE k <= {int(_RUN_BUDGET / _CEILING + 1e-9)}), r3 AS (SELECT a2.event_id, row_number() OVER (ORDER BY a2.event_id) + (SELECT count(*) FROM a1) + (SELECT count(*) FROM a2) AS k FROM a2 JOIN e ON a2.event_id = e.event_id WHERE h = 2),
a3 AS (SELECT event_id FROM r3 WHERE k <= {int(_RUN_BUDGET / _CEILING + 1e-9)}),
s AS (SELECT e.*, CAST((a1.event_id IS NOT NULL) AS INT) + CAST((a2.event_id IS NOT NULL) AS INT) + CAST((a3.event_id IS NOT NULL) AS INT) AS calls,
  CASE WHEN NOT eligible THEN 'ineligible_source_time' WHEN a1.event_id IS NULL THEN 'budget_exceeded_or_unpriced_model@provider' WHEN error = 'timeout' THEN 'provider_timeout@provider' WHEN error = 'network' THEN 'provider_network_error@provider'
    WHEN h = 3 THEN 'provider_http_404@provider' WHEN h IN (1, 2) AND a2.event_id IS NULL OR h = 2 AND a3.event_id IS NULL THEN 'budget_exceeded_or_unpriced_model@provider' WHEN h = 2 THEN 'provider_http_503@provider'
    WHEN j = 1 THEN 'evidence_mismatch@claims.0.evidence.0' WHEN j = 2 THEN 'unsupported_number@headline' WHEN j = 3 THEN 'invalid_output_json@provider' END AS issue
  FROM e LEFT JOIN a1 ON e.event_id = a1.event_id LEFT JOIN a2 ON e.event_id = a2.event_id LEFT JOIN a3 ON e.event_id = a3.event_id)
SELECT event_id AS generation_id, CASE WHEN NOT eligible THEN 'skipped' WHEN issue IS NULL THEN 'accepted' ELSE 'rejected' END AS status, coalesce(issue, '') AS issues, CAST(calls AS BIGINT) AS calls,
  CASE WHEN NOT eligible THEN 0 WHEN calls = 0 OR error IS NOT NULL OR h IN (1, 2, 3) THEN NULL ELSE CAST((event_id % 100) * 40 + 160 AS BIGINT) END AS cost FROM s""")
def generation_run(spark: SparkSession, sf: str) -> DataFrame:
    """Events as generations of a run: attempts that fail, are retried or exceed the budget, and answers of all kinds.
    Cost in hundred-millionths of a dollar, of those whose every attempt tells its usage."""
    _checkpointed(spark)
    e = table(spark, sf, "events").select("event_id")
    text = F.concat(F.lit("Orders of lot "), F.col("event_id").cast("string"), F.lit(" rose in the spring."))
    requests = e.select(F.col("event_id").alias("generation_id"), F.col("event_id").alias("seq"), (F.col("event_id") % 9 != 4).alias("eligible"), F.when(F.col("event_id") % 37 != 0, F.lit(_CEILING).cast("decimal(18,8)")).alias("ceiling"))
    items = e.select(F.col("event_id").alias("generation_id"), F.lit("item").alias("item_id"), text.alias("text"))
    k = F.col("generation_id")

    def ask(rows: DataFrame) -> DataFrame:
        h, j = k % 6, k % 5
        status = F.when(h == 3, 404).when((h == 1) & (F.col("number") == 1), 429).when(h == 2, 503).otherwise(200)
        quote = F.concat(F.lit("Orders of lot "), k.cast("string"), F.when(j == 1, F.lit(" fell")).otherwise(F.lit(" rose")))
        head = F.when(j == 2, F.lit("A headline of 7.25%")).otherwise(F.lit("A headline"))
        evidence = F.array(F.struct(F.lit("item").alias("itemId"), quote.alias("quote")))
        json = F.to_json(F.struct(F.lit("summary-v1").alias("schemaVersion"), head.alias("headline"), F.array(F.struct(F.lit("Orders rose").alias("text"), evidence.alias("evidence"))).alias("claims"), F.array(F.lit("one source")).alias("uncertainty")))
        used = lambda n: F.when((status == 200) & (k % 13 > 1), n)
        return rows.select(
            "generation_id", F.when(k % 13 == 0, "timeout").when(k % 13 == 1, "network").alias("error"), status.alias("http_status"), F.lit(True).alias("envelope_ok"), F.lit(False).alias("refused"), F.lit("completed").alias("envelope_status"),
            (j != 3).alias("output_json_ok"), json.alias("json"), F.lit(summaries.MODELS[1]).alias("model"), used(k % 100).alias("tokens_in"), used(F.lit(0)).alias("tokens_cached"), used(F.lit(1)).alias("tokens_out"),
        )

    done = attempts.run(requests, ask, items, _RUN_BUDGET).generations
    return done.select("generation_id", "status", F.array_join("issues", ";").alias("issues"), "calls", (F.col("cost") * 100_000_000).cast("long").alias("cost"))


@query("""
WITH g AS (SELECT user_id, CASE user_id % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE 'skipped' END AS status, count(*) AS calls, bool_and(event_id % 9973 <> 0) AS known, sum(event_id % 100) AS cost FROM events GROUP BY user_id)
SELECT count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'skipped') AS skipped, CAST(sum(calls) AS BIGINT) AS calls, CASE WHEN bool_and(known) THEN CAST(sum(cost) AS BIGINT) END AS cost FROM g""")
def run_telemetry(spark: SparkSession, sf: str) -> DataFrame:
    """Events as attempts of their users' generations, in whole units; an unpriced one makes the run's cost unknown."""
    e = table(spark, sf, "events")
    generations = e.groupBy(F.col("user_id").alias("generation_id")).agg(F.lit(1)).select("generation_id", F.expr("CASE generation_id % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE 'skipped' END").alias("status"))
    out = summaries.telemetry(generations, e.select(F.col("user_id").alias("generation_id"), F.expr("CASE WHEN event_id % 9973 <> 0 THEN event_id % 100 END").alias("cost")))
    return out.withColumn("cost", F.col("cost").cast("long"))


#: What a candidate summary is made of, and the values that a case may give one of them: each field's bounds and one
#: beyond, counts likewise, keys that are absent or unknown, citations that lead elsewhere, numbers and wording.
_GOOD = {"head": 20, "head_tail": "", "claims": 1, "claim_size": -1, "claim_tail": "", "cites": 1, "quote_size": -1, "quote_tail": "", "id_tail": "", "notes": 0, "note_size": 30, "version": "summary-v1", "absent": "", "stray": ""}
_ODD = {
    "head": [0, 1, 160, 161], "head_tail": [" 7 of 31415926", " guaranteed  return", " guaranteed return"], "claims": [0, 4, 5], "claim_size": [0, 1, 500, 501], "cites": [0, 4, 5],
    "claim_tail": [" 31415926", " 3,141.5926%", *(f" {w} " for w in summaries.FORBIDDEN), *(w.upper() for w in summaries.FORBIDDEN[:2]), " buy, now"], "quote_size": [0, 11, 12], "quote_tail": [" \u00a7", "31415926"], "id_tail": ["0", "x" * 148, "x" * 149],
    "notes": [1, 4, 5], "note_size": [0, 300, 301], "version": ["", "summary-v2"], "absent": ["schemaVersion", "headline", "claims", "uncertainty", "text", "evidence", "itemId", "quote"], "stray": ["$", "claims", "evidence"],
}


def _cases() -> list[dict]:
    """The sound summary, and each part changed alone."""
    changed = [{**_GOOD, part: value, **({"notes": 1} if part == "note_size" else {})} for part, values in _ODD.items() for value in values]
    return [{"case_no": k, **c} for k, c in enumerate([_GOOD, *changed])]


_N_CASES = len(_cases())
_CASES_SQL = ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else "'" + v + "'" for v in c.values()) + ")" for c in _cases())
#: The last run of 20 to 200 characters of a text that needs no escape in JSON and holds no end of sentence or line.
_SENTENCE = r'(?s)^(?:.*[.!?\n])?[^.!?\n\x00-\x1F"\\]*?([^.!?\n\x00-\x1F"\\ ][^.!?\n\x00-\x1F"\\]{18,198}[^.!?\n\x00-\x1F"\\ ])'


@query(r"""
WITH c(""" + ", ".join(_cases()[0]) + ") AS (VALUES " + _CASES_SQL + r"""),
d AS (SELECT doc_id, text, doc_id % """ + str(_N_CASES) + r""" AS case_no, regexp_extract(coalesce(text, ''), '""" + _SENTENCE.replace("'", "''") + r"""', 1) AS sentence FROM documents),
p AS (
  SELECT d.doc_id, d.text, d.sentence, c.*, repeat('h', head) || head_tail AS headline, CASE WHEN claim_size < 0 THEN sentence ELSE repeat('c', claim_size) END || claim_tail AS claim, CASE WHEN quote_size < 0 THEN sentence ELSE substring(sentence, 1, quote_size) END || quote_tail AS quote
  FROM d JOIN c ON d.case_no = c.case_no),
n AS (SELECT *, regexp_extract_all(quote, '\d+(?:[.,]\d+)*(?:%|bps)?') AS proven FROM p),
v AS (
  SELECT *, version = 'summary-v1' AND absent = '' AND stray = '' AND length(headline) BETWEEN 1 AND 160 AND claims BETWEEN 1 AND 4 AND length(claim) BETWEEN 1 AND 500 AND cites BETWEEN 1 AND 4 AND length(quote) BETWEEN 12 AND 1200 AND 12 + length(id_tail) <= 160
         AND notes <= 4 AND (notes = 0 OR note_size BETWEEN 1 AND 300) AS sized,
       id_tail = '' AND contains(text, quote) AS cited,
       len(list_filter(list_concat(regexp_extract_all(claim, '\d+(?:[.,]\d+)*(?:%|bps)?'), regexp_extract_all(headline, '\d+(?:[.,]\d+)*(?:%|bps)?')), lambda x: NOT list_contains(proven, x))) = 0 AS counted,
       regexp_matches(headline || ' ' || claim, '""" + _PHRASES + r"""') AS advice
  FROM n)
SELECT doc_id, case_no, CASE WHEN sentence <> '' THEN sized AND cited AND counted AND NOT advice END AS accepted FROM v""")
def validation_cases(spark: SparkSession, sf: str) -> DataFrame:
    """A summary of each document that quotes its last sentence, sound or with one part changed; the cases take turns.
    Documents without a sentence to quote have no verdict."""
    made = spark.createDataFrame([tuple(c.values()) for c in _cases()], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in _cases()[0].items()))
    docs = table(spark, sf, "documents").select("doc_id", "text", F.regexp_extract(F.coalesce("text", F.lit("")), _SENTENCE, 1).alias("sentence"), (F.col("doc_id") % _N_CASES).cast("int").alias("case_no"))
    rows = docs.join(F.broadcast(made), "case_no").withColumn("item_id", F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    quoted = [c for c in rows.columns if c not in ("doc_id", "case_no")]
    part = lambda key, value: F.when(F.col("absent") != key, F.concat(F.lit(f'"{key}":'), value))
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    unknown = lambda level: F.when(F.col("stray") == level, F.lit('"note":null'))
    thing = lambda *parts: F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    several = lambda c, n: F.concat(F.lit("["), F.array_join(F.array_repeat(c, F.col(n)), ","), F.lit("]"))
    sized = lambda letter, n: F.expr(f"CASE WHEN {n} < 0 THEN sentence ELSE repeat('{letter}', {n}) END")
    evidence = thing(part("itemId", text(F.concat("item_id", "id_tail"))), part("quote", text(F.concat(F.expr("CASE WHEN quote_size < 0 THEN sentence ELSE substring(sentence, 1, quote_size) END"), "quote_tail"))), unknown("evidence"))
    claim = thing(part("text", text(F.concat(sized("c", "claim_size"), "claim_tail"))), part("evidence", several(evidence, "cites")), unknown("claims"))
    notes = several(text(sized("n", "note_size")), "notes")
    json = thing(part("schemaVersion", text(F.col("version"))), part("headline", text(F.concat(sized("h", "head"), "head_tail"))), part("claims", several(claim, "claims")), part("uncertainty", notes), unknown("$"))
    candidates = rows.where("sentence <> ''").select("doc_id", F.col("doc_id").alias("generation_id"), json.alias("json"))
    judged = summaries.validated(summaries.parsed(candidates), rows.select(F.col("doc_id").alias("generation_id"), *quoted))
    return rows.select("doc_id", F.col("case_no").cast("long").alias("case_no")).join(judged.withColumnRenamed("generation_id", "doc_id"), "doc_id", "left").select("doc_id", "case_no", "accepted")


@query(_SCORES + """,
k AS (SELECT s.*, CASE WHEN cluster_id IS NULL THEN 'cand-item-' || s.item_id ELSE 'cand-cluster-' || cluster_id END AS candidate_id FROM scored s WHERE s.verification_tier IN ('verified', 'reported', 'scheduled')),
f AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY ordinal) AS n FROM k)
SELECT candidate_id, CASE WHEN cluster_id IS NULL THEN 'item' ELSE 'cluster' END AS target_type, coalesce(cluster_id, item_id) AS target_id,
  CASE WHEN cluster_id IS NOT NULL AND size >= 3 OR cluster_id IS NULL AND priority_tier IN ('P0', 'P1') THEN CASE WHEN row_number() OVER (PARTITION BY cluster_id IS NOT NULL AND size >= 3 OR cluster_id IS NULL AND priority_tier IN ('P0', 'P1') ORDER BY ordinal) = 1 THEN 'whisper' ELSE 'hold' END ELSE 'glow' END AS level,
  CASE WHEN cluster_id IS NOT NULL AND size >= 3 OR cluster_id IS NULL AND priority_tier IN ('P0', 'P1') THEN CASE WHEN row_number() OVER (PARTITION BY cluster_id IS NOT NULL AND size >= 3 OR cluster_id IS NULL AND priority_tier IN ('P0', 'P1') ORDER BY ordinal) = 1 THEN NULL ELSE 'Held (cooldown_active)' END END AS held FROM f WHERE n = 1""")
def whisper_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Items and confirmed clusters as candidates of one instant without a history: one whispers, the rest hold or glow."""
    _checkpointed(spark)
    rows = _annotated(spark, sf).where(F.col("verification_tier").isin(*C.PROMOTABLE_TIERS))
    candidates = whispers.item_candidates(rows, [F.col("ordinal")]).withColumn("ordinal", F.col("_order.o0")).drop("_order")
    candidates = cut(candidates)
    history = spark.createDataFrame([], "item_id string, cluster_id string, calendar_event_id string, source_id string, priority_reason string, member_count int, calendar_signature string, created_at timestamp")
    dismissals = spark.createDataFrame([], "target_type string, target_id string, quiet_until timestamp")
    shown = whispers.decision_views(whispers.decide(candidates, history, dismissals, now()))
    return shown.select("candidate_id", "target_type", "target_id", "level", F.when(F.col("level") == "hold", F.col("message")).alias("held"))
