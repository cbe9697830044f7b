"""Whole flows on a sample-shaped dataset."""

import json
from datetime import datetime

from pyspark.sql import functions as F
from test_news import lit_now, sample_dataset

from newsmill.operators import attempts, audit, selectors, summaries, whispers
from newsmill.plans import flows, queries
from newsmill.plans.inputs import now


def test_dataset_to_audited_run(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    snapshot = flows.ingest_dataset(spark.createDataFrame([(json.dumps(sample_dataset()),)], "json string"), lit_now())
    counts = snapshot.counts.first()
    assert (counts.input, counts.ingested, counts.quarantined, counts.duplicates, counts.clusters, counts.eligible) == (11, 9, 2, 4, 5, 4)
    assert {(r.record, r.reason) for r in snapshot.quarantined.collect()} == {("r", "legal_status_needs_review"), ("x", "legal_status_disabled")}
    assert {r.reason_type for r in snapshot.decisions.collect()} <= {"canonical_url_exact", "dedupe_hash_exact"}
    generations = flows.summarise(snapshot)
    status = sorted(r.status for r in generations.collect())
    assert status.count("skipped") == 1 and len(status) == 5
    folder = audit.write_run(str(tmp_path), "run-1", flows.audit_records(snapshot, generations))
    assert audit.verify_run(spark, folder) == spark.read.parquet(f"{folder}/ledger").count() > 20


def test_input_order_changes_nothing(spark):
    doc = sample_dataset()
    back = doc | {"articles": doc["articles"][::-1], "sources": doc["sources"][::-1]}
    ids = [sorted(r.cluster_id for r in flows.ingest_dataset(spark.createDataFrame([(json.dumps(d),)], "json string"), lit_now()).clusters.collect()) for d in (doc, back)]
    assert ids[0] == ids[1]


def test_calendar_views(spark):
    at = lambda h: f"2026-05-28T{h}:00:00Z"
    event = {"sourceEventId": "e", "eventName": "CPI", "importance": "high", "scheduledFor": at(14)}
    rows = [("c", "p1", json.dumps({"events": [event]}), "2026-05-28 12:00:00"), ("c", "p2", json.dumps({"events": [event | {"scheduledFor": at(15)}]}), "2026-05-28 12:30:00"), ("c", "p3", json.dumps({"events": [event | {"scheduledFor": at(15)}]}), "2026-05-28 12:50:00"), ("d", "p4", json.dumps({"events": [event]}), "2026-05-28 12:50:00"), ("c", "p5", "{", "2026-05-28 12:55:00")]
    payloads = spark.createDataFrame(rows, "source_id string, raw_payload_id string, payload_text string, observed_at string").withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    sources = spark.createDataFrame([("c", True, "allowed", "economic_calendar_fixture"), ("d", True, "needs_review", "economic_calendar_fixture")], "source_id string, enabled boolean, legal_status string, source_type string")
    (view,) = flows.calendar_views(payloads, sources, lit_now()).collect()
    assert (view.source_id, view.revision_number, view.confirmation_state, view.minutes_until, view.promotable, len(view.history)) == ("c", 2, "fresh", 120, True, 2)


def test_whisper_history_is_all_events(spark, tmp_path):
    """Counts and repeats of the query against brute force over every event, some at the instant's edges."""
    from datetime import datetime, timedelta

    at = datetime(2024, 1, 2)
    minutes = [-9000, -61, -60, -59.9, -31, 3, 14.9, 15, 40, 59, 61, 20000]
    events = [(k, at + timedelta(minutes=m), k % 3) for k, m in enumerate(minutes)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(k, f"text {k}", "en", f"src{k % 4}") for k in range(8)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = queries._annotated(spark, str(tmp_path))
    candidates, history = queries._candidates(rows), queries._whispered(spark, str(tmp_path), rows)
    assert history.count() == len(events)
    ago = {k: abs(m) for k, m in enumerate(minutes)}
    want = {r.item_id: (sum(m < 15 for m in ago.values()), sum(m < 60 for m in ago.values()), sum(m < 60 and f"src{k % 3}" == r.source_id for k, m in ago.items()), True) for r in rows.collect()}
    got = {r.item_id: (r.last_15m, r.last_60m, r.source_60m, r.cooldown) for r in whispers.rate_state(candidates, history, now()).collect()}
    assert got and got == want
    again = {r.candidate_id for r in whispers.repeats(candidates, history).collect()}
    assert again and again == {f"cand-{i}" for i in want if int(i) % 2 == 0}
    decided = {r.candidate_id: r.reason_code for r in queries.whisper_decisions(spark, str(tmp_path)).collect()}
    assert len(decided) == len(want) and "whisper_threshold_met" not in decided.values() and "repeat_item_no_reason_change" in decided.values()


def test_region_items_of_a_hot_region(spark):
    """One region holds nearly all items; ties in time go by id, and tasks keep six rows a region before the shuffle."""
    tag = lambda kind, value: [{"tag_id": "t", "tag_type": kind, "tag_value": value, "provenance": "deterministic"}]
    rows = [(f"i{k:04d}", "title", datetime(2024, 1, 1 + k % 3), tag("macro", "FOMC minutes")) for k in range(900)] + [("x", "title", datetime(2024, 1, 1), tag("asset", "Gold")), ("y", "title", datetime(2024, 1, 9), tag("asset", "none"))]
    items = spark.createDataFrame(rows, "item_id string, title string, observed_at timestamp, tags array<struct<tag_id:string,tag_type:string,tag_value:string,provenance:string>>")
    found = selectors.region_items(items.repartition(4))
    got = {}
    for r in found.orderBy("key", "place").collect():
        got.setdefault(r.key, []).append(r.item_id)
    assert got == {"us_fed_usd": [f"i{k:04d}" for k in range(2, 20, 3)], "me_geopolitics_oil_gold": ["x"]}
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()


def test_run_of_attempts(spark):
    """Failures that are retried or not, a refusal for the budget between rounds, an unpriced model, a skipped generation."""
    spark.sparkContext.setCheckpointDir(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    text = "Orders of lot 7 rose in the spring."
    script = {"a": [200], "b": [429, 200], "c": [503, 503, 503], "d": [404], "e": ["timeout"], "f": [200], "g": [429, 200], "h": [200]}
    requests = spark.createDataFrame([(g, k, g != "f", None if g == "h" else 1.0) for k, g in enumerate(script)], "generation_id string, seq long, eligible boolean, ceiling double")
    items = spark.createDataFrame([(g, "it", text) for g in script], "generation_id string, item_id string, text string")
    summary = lambda quote: json.dumps({"schemaVersion": "summary-v1", "headline": "Orders", "claims": [{"text": "Orders rose", "evidence": [{"itemId": "it", "quote": quote}]}], "uncertainty": []})
    asked = []

    def ask(rows):
        got = [(r.generation_id, r.number) for r in rows.select("generation_id", "number").collect()]
        asked.append(sorted(g for g, _ in got))
        out = []
        for g, n in got:
            said = script[g][n - 1]
            ok = said == 200
            out.append((g, said if isinstance(said, str) else None, None if isinstance(said, str) else said, True, False, "completed", True, summary(text[:20] if g == "a" else "Orders of lot 8 fell"), summaries.MODELS[1], *([1000, 100, 10] if ok else [None] * 3)))
        return spark.createDataFrame(out, "generation_id string, error string, http_status int, envelope_ok boolean, refused boolean, envelope_status string, output_json_ok boolean, json string, model string, tokens_in long, tokens_cached long, tokens_out long")

    done = attempts.run(requests, ask, items, 8.0)
    got = {r.generation_id: (r.status, r.issues, r.calls, r.cost) for r in done.generations.collect()}
    unpriced = [f"{attempts.UNPRICED}@provider"]
    assert asked == [["a", "b", "c", "d", "e", "g"], ["b", "c"], []]  # two of eight dollars are left for three retries
    assert {g: v[:3] for g, v in got.items()} == {
        "a": ("accepted", [], 1), "b": ("rejected", ["evidence_mismatch@claims.0.evidence.0"], 2), "c": ("rejected", unpriced, 2), "d": ("rejected", ["provider_http_404@provider"], 1), "e": ("rejected", ["provider_timeout@provider"], 1),
        "f": ("skipped", ["ineligible_source_time"], 0), "g": ("rejected", unpriced, 1), "h": ("rejected", unpriced, 0),
    }
    assert float(got["a"][3]) == 0.000386 and got["f"][3] == 0 and all(got[g][3] is None for g in "bcdegh")
    assert done.attempts.count() == 8


def test_brief_reads_texts_once(spark):
    """Its sections read tables made from the documents, not the documents again."""
    brief = queries.morning_brief(spark, "/root/testdata/sf0.001")
    assert brief.count() > 0 and not [f for f in brief.inputFiles() if "documents.parquet" in f]
