"""Operators of the news domain against expected results on literal rows."""

import json
import random
from datetime import UTC, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from newsmill.functions import hashing, text, times, urls
from newsmill.operators import audit, calendar, clusters, dedupe, display, event_log, gates, lineage, priority, readiness, summaries, whispers
from newsmill.sources import calendar as calendar_source
from newsmill.sources import dataset, rss

NOW = datetime(2026, 5, 28, 13, tzinfo=UTC)


def lit_now():
    return F.lit("2026-05-28 13:00:00").cast("timestamp")


def values(spark, column, inputs, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r[1] for r in sorted(rows.select("i", column(F.col("x"))).collect())]


def test_text(spark):
    assert values(spark, text.sanitize, ["<![CDATA[<b>A</b>]]>  x", "&lt;b&gt; &amp;lt; &#8364;&#39;", None, " a \n b ", "R&amp;D &nbsp;x", "&#9999999; y", "&#00000000065;b &#123456789;"]) == ["A x", "<b> < €'", "", "a b", "R&D x", "&#9999999; y", "Ab &#123456789;"]
    assert values(spark, text.contains_html, ["a <b>", "a < b", "<![CDATA[<i>]]>", None]) == [True, False, True, False]
    assert values(spark, text.normalize_title, ['  "Fed  Holds Rates"  ', "‘X’ ,  y !", '"', "", None, "“Q”"]) == ["fed holds rates", "‘x’, y!", '"', None, None, "q"]
    assert values(spark, text.xml_escape, ["a&b<c>\"'"]) == ["a&amp;b&lt;c&gt;&quot;&apos;"]
    assert values(spark, lambda c: text.tag_content(c, "title"), ["<item><TITLE a='1'>x\ny</title></item>", "<title></title>", "none"]) == ["x\ny", "", None]
    assert values(spark, text.numbers, ["up 25bps to 5.50%, 1,200 x"]) == [["25bps", "5.50%", "1,200"]]
    assert values(spark, text.sentences, ["One. Two is. three! Four"]) == [["One.", "Two is. three!", "Four"]]
    assert values(spark, lambda c: text.forbidden(c, summaries.FORBIDDEN), ["You should BUY NOW.", "buy nowhere", "the price will rise"]) == [True, False, True]


def test_urls(spark):
    inputs = ["HTTPS://News.Example.com:443/a/b/?utm_source=x&id=1#top", "http://e.com", "http://e.com/a//", "http://e.com/a/?UTM_Medium=1", "nonsense", None, "http://www.e.com/?q", "http://e.com:8080/x"]
    assert values(spark, urls.canonical_url, inputs) == ["https://news.example.com/a/b/?id=1", "http://e.com/", "http://e.com/a", "http://e.com/a", None, None, "http://www.e.com/?q=", "http://e.com:8080/x"]


def test_hashes(spark):
    assert values(spark, hashing.fnv1a, ["", "a", "foobar", "é", "😀"]) == ["811c9dc5", "e40c292c", "bf9cf968", *(fnv(x) for x in "é😀")]
    row = spark.range(1).select(hashing.canonical_json({"b": F.lit(1), "a": F.lit('x"/é'), "c": F.lit(None).cast("string"), "d": F.lit(None).cast("string")}, optional=("d",))).first()[0]
    assert row == '{"a":"x\\"/é","b":1,"c":null}'


def fnv(s):
    h, units = 0x811C9DC5, s.encode("utf-16-be")
    for k in range(0, len(units), 2):
        h = ((h ^ int.from_bytes(units[k : k + 2], "big")) * 16777619) % 2**32
    return f"{h:08x}"


def test_times(spark):
    dates = ["Thu, 28 May 2026 12:59:00 GMT", "Thu, 28 May 2026 12:00:00 +0100", "2026-05-27T10:00:00Z", "soon", None, "", "Fri, 29 May 2026 00:00:00 GMT"]
    got = values(spark, lambda c: times.publication(c, lit_now()), dates)
    assert [r.state for r in got] == ["valid", "valid", "valid", "invalid", "missing", "missing", "future"] and got[6].at is None
    ages = [NOW - timedelta(minutes=m) for m in (-5, 0, 59, 60, 1439, 1440)]
    rows = spark.createDataFrame([(i, a.replace(tzinfo=None)) for i, a in enumerate(ages)], "i int, t timestamp")
    assert [r[1] for r in sorted(rows.select("i", times.age_label(F.col("t"), lit_now())).collect())] == ["live", "live", "59m", "1h", "23h", "1d"]


SOURCES = [("s1", "One", "primary", "allowed", True, "rss_fixture"), ("s2", "Two", "curated", "needs_review", True, "rss_fixture"), ("s3", "Three", "unknown", "disabled", False, "rss_fixture"), ("s4", "Four", "reputable", "allowed", False, "rss_fixture"), ("s5", "Five", "reputable", "allowed", True, "api")]


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame(SOURCES, "source_id string, source_name string, source_tier string, legal_status string, enabled boolean, source_type string")


def test_gates(spark, sources):
    got = {r.source_id: (r.skip_reason, r.fetch_eligible, r.eligibility) for r in gates.gated(sources).collect()}
    assert got == {"s1": (None, True, "eligible"), "s2": ("legal_status_needs_review", False, "quarantined"), "s3": ("legal_status_disabled", False, "disabled"), "s4": ("not_enabled", False, "disabled"), "s5": ("unsupported_source_type", False, "unsupported")}
    assert {r.source_id for r in gates.ingestible(sources).collect()} == {"s1", "s5"} and {r.source_id for r in gates.quarantined(sources).collect()} == {"s2", "s3"}


ITEM = "item_id string, source_id string, source_item_id string, url string, title string, dedupe_hash string, verification_tier string, freshness_state string, observed_at timestamp, source_event_time timestamp, tags array<struct<tag_id:string,tag_type:string,tag_value:string,provenance:string>>"


def item(i, source="s1", tier="verified", fresh="live", minutes=5, tags=(), url=None, hash_=None, title="T"):
    return (i, source, i, url, title, hash_ or i, tier, fresh, (NOW - timedelta(minutes=minutes)).replace(tzinfo=None), None, list(tags))


def test_priority(spark, sources):
    macro = ("m", "macro", "FOMC decision", "deterministic")
    rows = [item("a", tags=[macro]), item("b", tier="rumor"), item("c", source="s2", fresh="stale"), item("d", source="s3"), item("e", tier="unverified", minutes=800), item("f", tier="scheduled", minutes=30), item("g", tags=[("m", "macro", "cpi", "inferred")], minutes=100)]
    df = spark.createDataFrame(rows, ITEM).join(sources, "source_id").withColumn("cluster_size", F.when(F.col("item_id") == "a", 4).otherwise(1))
    got = {r.item_id: (r.priority_tier, r.urgency_label, r.priority_reason) for r in priority.prioritised(df, lit_now()).collect()}
    assert got["a"] == ("P0", "now", "source tier primary (+3); verification verified (+3); scheduled macro keyword match (+2); confirmed cluster size 4 (+2); recency 5m (+2)")
    assert got["b"] == ("P3", "background", "source tier primary (+3); verification rumor (-1); recency 5m (+2); rumor verification cap → P3")
    assert got["c"] == ("muted", "muted", "source tier curated (+1); verification verified (+3); recency 5m (+2); source needs_review — capped at P3; freshness stale (-1)")
    assert got["d"] == ("muted", "muted", "Source Three is disabled — item suppressed from priority surfaces.")
    assert got["e"][:2] == ("P3", "background") and got["f"][:2] == ("P1", "soon") and got["g"][:2] == ("P1", "soon")


def test_dedupe_and_clusters(spark):
    spark.sparkContext.setCheckpointDir(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    same = [("a", "asset", "Gold", "deterministic")]
    rows = [item("a", hash_="h1", url="http://e.com/x?utm_source=q"), item("b", source="s2", url="http://E.com/x"), item("c", hash_="h2"), item("d", source="s2", hash_="h2"), item("e", source="s3", url="http://e.com/x", hash_="h2"), item("n", title="Alone", tags=same, minutes=0), item("o", title="alone ", tags=same, minutes=360), item("p", title="alone", tags=same, minutes=721)]
    df = spark.createDataFrame(rows, ITEM)
    ids = dedupe.identities(df)
    pairs = {(r.a, r.b): r.reason_type for r in dedupe.matches(ids).collect()}
    assert pairs == {("a", "b"): "canonical_url_exact", ("a", "e"): "canonical_url_exact", ("b", "e"): "canonical_url_exact", ("c", "d"): "dedupe_hash_exact", ("c", "e"): "dedupe_hash_exact", ("d", "e"): "dedupe_hash_exact"}
    strict = {(r.a, r.b) for r in dedupe.matches(ids, strict_title=True).collect()} - set(pairs)
    assert strict == {("n", "o")}
    roots = dedupe.components(dedupe.stars(ids))
    assert dict(roots.collect()) == {x: "a" for x in "abcde"}
    events = clusters.membership_events(dedupe.keys(ids), roots)
    assert sorted(map(tuple, clusters.active_members(events).collect())) == [("ccl-a", "a"), ("ccl-a", "b"), ("ccl-a", "e"), ("ccl-c", "c"), ("ccl-c", "d")]  # clusters never merge
    fixed = clusters.corrected(events, spark.createDataFrame([("ccl-a", "b")], "cluster_id string, item_id string"))
    got = {r.cluster_id: (r.item_ids, r.status, r.member_count, r.source_count) for r in clusters.confirmed(fixed, df).collect()}
    assert got == {"ccl-a": (["a", "e"], "corrected", 2, 2), "ccl-c": (["c", "d"], "active", 2, 2)}
    assert {r.item_id for r in clusters.unmerged(df, fixed).collect()} == {"b", "n", "o", "p"}
    assert clusters.unmatched_removals(fixed).isEmpty()


def plain_fold(pairs):
    """The engine over pairs (a, b, rule), as a plain loop."""
    earlier, of, out = {}, {}, []
    for a, b, rule in pairs:
        earlier.setdefault(max(a, b), []).append((min(a, b), rule))
    for item in sorted(earlier):
        met = sorted(earlier[item])
        held = sorted({of[p] for p, _ in met if p in of})
        cluster = held[0] if held else "ccl-" + min([item, *(p for p, _ in met)])
        for prior, rule in [] if held else met:
            of[prior] = cluster
            out.append((cluster, prior, rule))
        of[item] = cluster
        out.append((cluster, item, met[0][1]))
    return out


def test_fold_over_keys_is_the_fold_over_pairs():
    import random

    for seed in range(300):
        rng = random.Random(seed)
        items = [("%02d" % k, sorted({f"{r}:{rng.randrange(5)}" for r in range(3) if rng.random() < 0.6})) for k in range(rng.randrange(2, 14))]
        pairs = [(a, b, dedupe.RULES[int(min(set(x) & set(y))[0])]) for k, (a, x) in enumerate(items) for b, y in items[k + 1 :] if set(x) & set(y)]
        assert [(c, i, r) for c, i, _, r in clusters.fold(items)] == plain_fold(pairs)


def test_components_of_a_long_path_take_few_rounds(spark, monkeypatch):
    order = [f"{k:04d}" for k in range(60)]
    random.Random(1).shuffle(order)
    tables = []
    monkeypatch.setattr(dedupe, "cut", lambda df: tables.append(df) or lineage.cut(df))
    got = dedupe.components(spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a string, b string"))
    assert {r.root for r in got.collect()} == {"0000"} and got.count() == 60
    assert len(tables) - 2 <= 8  # 32 rounds when only neighbours told each other


def test_canonical_url_computes_its_parts_once(spark):
    plan = spark.createDataFrame([("https://a.example/",)], "u string").select(urls.canonical_url(F.col("u")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") < 20


def test_one_key_of_many_items(spark):
    """Copies in great number are clustered without pairs and without a fold."""
    rows = spark.range(20_000).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("item_id"), F.lit(2).alias("rule"), F.lit("h").alias("key"))
    rows = rows.unionByName(spark.createDataFrame([("a1", 0, "x"), ("a2", 0, "x"), ("a2", 2, "y"), ("a3", 2, "y"), ("a9", 2, "z")], "item_id string, rule int, key string"))
    roots = spark.range(20_000).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("item_id"), F.lit("000000").alias("root"))
    events = clusters.membership_events(rows, roots.unionByName(spark.createDataFrame([(x, "a1") for x in ("a1", "a2", "a3")], "item_id string, root string")))
    got = {r.cluster_id: r.n for r in events.groupBy("cluster_id").agg(F.count("*").alias("n")).collect()}
    assert got == {"ccl-000000": 20_000, "ccl-a1": 3}
    assert {r.reason_type for r in events.where("cluster_id = 'ccl-000000'").collect()} == {"dedupe_hash_exact"}


def test_removed_members_stay_out(spark):
    events = spark.createDataFrame([("ccl-a", "a", "added", "r", 0), ("ccl-a", "b", "added", "r", 1)], clusters.EVENTS)
    later = spark.createDataFrame([("ccl-a", "b", "added", "r", 0), ("ccl-a", "a", "added", "r", 1), ("ccl-a", "c", "added", "r", 2)], clusters.EVENTS)
    fixed = clusters.corrected(events, spark.createDataFrame([("ccl-a", "b")], "cluster_id string, item_id string"), later)
    assert {r.item_id for r in clusters.active_members(fixed).collect()} == {"a", "c"}
    assert fixed.count() == 4  # neither b again nor a twice


def sample_dataset():
    at = "2026-05-28T12:00:00.000Z"
    src = [{"id": f"s{k}", "name": f"S {k}", "tier": "curated", "legalStatus": legal, "enabled": on} for k, (legal, on) in enumerate([("allowed", True)] * 4 + [("needs_review", True), ("disabled", False)])]
    art = []
    for k, story in enumerate(["Rates stay put. Growth was 2.5% in May.", "Oil falls", "Gold rises & shines <b>", "Jobs report"]):
        for n, s in enumerate(("s0", "s1", "s2") if k == 0 else ("s1", "s3") if k < 3 else ("s2",)):
            art.append({"id": f"a{k}-{n}", "sourceId": s, "title": story[:12], "text": story, "url": f"https://news.example.org/{k}?utm_source={s}", "publishedAt": at, "category": "macro"})
    art.append({"id": "undated", "sourceId": "s3", "title": "No date", "text": "Nothing is known.", "url": "https://news.example.org/u", "publishedAt": None, "category": "misc"})
    art += [{"id": "r", "sourceId": "s4", "title": "R", "text": "review", "url": "https://news.example.org/r", "publishedAt": at, "category": "misc"}, {"id": "x", "sourceId": "s5", "title": "X", "text": "off", "url": "https://news.example.org/x", "publishedAt": at, "category": "misc"}]
    return {"schemaVersion": "dataset-v1", "id": "sample", "description": "d", "license": "l", "synthetic": True, "observedAt": "2026-05-28T13:00:00.000Z", "sources": src, "articles": art}


def test_dataset_to_clusters(spark):
    doc = spark.createDataFrame([(json.dumps(sample_dataset()),)], "json string")
    known, articles = dataset.parsed(doc)
    payloads = dataset.to_rss(articles.join(known.where("legal_status = 'allowed' and enabled").select("source_id"), "source_id", "left_semi"))
    found = rss.scanned(payloads, lit_now())
    items = rss.normalised(found, known, lit_now())
    assert items.count() == 9 and items.where("source_event_time is null").count() == 1
    merged = items.withColumn("dedupe_hash", F.sha2(F.concat_ws("|", "excerpt", "title"), 256))
    ids = dedupe.identities(merged)
    evidence = merged.withColumns({"category": F.lit("macro"), "time_known": F.col("source_event_time").isNotNull()})
    got = dedupe.clusters(evidence, dedupe.components(dedupe.stars(ids)))
    counts = dedupe.snapshot_counts(articles, items, got).first().asDict()
    assert (counts["input"], counts["ingested"], counts["quarantined"], counts["duplicates"], counts["clusters"], counts["eligible"]) == (11, 9, 2, 4, 5, 4)
    status = {r.source_id: (r.skip_reason, r.status) for r in rss.runs(payloads, found, known).collect()}
    assert status["s4"] == ("legal_status_needs_review", "skipped") and status["s0"] == (None, "success")  # the statuses that ingestion runs carry


@pytest.mark.parametrize("change, fault", [({"extra": 1}, "unknown_key"), ({"schemaVersion": "v9"}, "schemaVersion"), ({"id": "Bad Id"}, "id"), ({"sources": []}, "no_sources"), ({"sources": [{**sample_dataset()["sources"][0], "extra": 1}]}, "unknown_key_in_sources"), ({"articles": [{**sample_dataset()["articles"][0], "extra": 1}]}, "unknown_key_in_articles"), ({"sources": sample_dataset()["sources"] * 33}, "too_many_sources"), ({"articles": sample_dataset()["articles"] * 129}, "too_many_articles")])
def test_dataset_rejects(spark, change, fault):
    doc = spark.createDataFrame([(json.dumps(sample_dataset() | change),)], "json string")
    assert fault in {r.fault for r in dataset.faults(doc).collect()}
    with pytest.raises(ValueError):
        dataset.parsed(doc)


RSS = """<rss><channel>
<item><title><![CDATA[A <b>bold</b> title]]></title><guid>g1</guid><pubDate>Thu, 28 May 2026 10:00:00 GMT</pubDate></item>
<item><title>Dup</title><guid>g1</guid></item><item><guid>g2</guid></item><item><title>No id</title></item>
<item><title>Bad date</title><link>http://e.com/3</link><pubDate>whenever</pubDate></item><item><title>Later</title><guid>g4</guid><published>Fri, 29 May 2026 10:00:00 GMT</published></item></channel></rss>"""


def test_rss(spark, sources):
    rows = spark.createDataFrame([("s1", "raw-1", RSS), ("s2", "raw-2", "<rss><item><title>x</rss>"), ("s5", "raw-3", "plain")], "source_id string, raw_payload_id string, payload_text string")
    found = rss.scanned(rows, lit_now()).orderBy("position").collect()
    assert [(r.quarantine_reason, r.duplicate, r.warnings) for r in found] == [
        (None, False, ["html_sanitized"]), (None, True, ["duplicate_guid"]), ("missing_title", False, ["missing_title"]), ("missing_identity", False, ["missing_identity"]), (None, False, ["invalid_pubdate"]), (None, False, ["future_pubdate"])
    ]
    df = rss.scanned(rows, lit_now())
    items = {r.source_item_id: r for r in rss.normalised(df, sources, lit_now()).collect()}
    assert items["g1"].title == "A bold title" and items["g1"].verification_tier == "reported" and items["g4"].source_event_time is None and items["g4"].source_event_time_status == "caveat_future"
    assert {r.malformed_item_id for r in rss.malformed(df).collect()} == {"mal-raw-1-2", "mal-raw-1-3"}
    assert {r.source_id: r.status for r in rss.runs(rows, df, sources.where("source_id in ('s1', 's5')")).collect()} == {"s1": "partial_success", "s5": "skipped"}


def test_calendar_source(spark):
    events = [{"sourceEventId": "e1", "eventName": "CPI", "importance": "HIGH", "scheduledFor": "2026-05-28T14:00:00Z", "forecast": "2%"}, {"canonicalEventKey": "k", "eventName": "Jobs", "importance": "huge", "status": "cancelled", "values": {"actual": "5"}}, {"eventName": "no id", "scheduledFor": "2026-05-28T14:00:00Z"}, {"sourceEventId": "e4", "scheduledFor": "2026-05-28T14:00:00Z"}, {"sourceEventId": "e5", "eventName": "x"}, {"sourceEventId": "e6", "eventName": "x", "scheduledFor": "never"}, {"sourceEventId": 7, "eventName": "x"}]
    rows = [("s", "p1", json.dumps({"events": events}), NOW.replace(tzinfo=None)), ("s", "p2", "{bad", NOW.replace(tzinfo=None)), ("s", "p3", '{"events": 3}', NOW.replace(tzinfo=None))]
    df = spark.createDataFrame(rows, "source_id string, raw_payload_id string, payload_text string, observed_at timestamp")
    assert [r[0] for r in df.orderBy("raw_payload_id").select(calendar_source.payload_state()).collect()] == ["ok", "malformed_json", "malformed_structure"]
    got = calendar_source.scanned(df).orderBy("position").collect()
    assert [r.quarantine_reason for r in got] == [None, None, "missing_identity", "missing_event_name", "missing_scheduled_for", "invalid_scheduled_for", "missing_identity"]
    assert (got[0].importance_tier, got[0].forecast, got[1].importance_tier, got[1].actual, got[1].status_hint, got[1].warnings) == ("high", "2%", "unknown", "5", "cancelled", ["importance_downgraded", "missing_scheduled_for"])
    assert calendar_source.malformed(calendar_source.scanned(df)).count() == 5


def observation(seq, hint="scheduled", at="2026-05-28 14:00:00", forecast="1", actual=None, importance="high"):
    return ("s", "e", seq, f"2026-05-28 0{seq}:00:00", hint, at, "CPI", "US", "USD", importance, "macro", "0", forecast, actual, None, "http://c")


def test_calendar_revisions(spark):
    rows = [observation(0), observation(1), observation(2, at="2026-05-28 15:00:00"), observation(3, at="2026-05-28 15:00:00", forecast="2"), observation(4, at="2026-05-28 15:00:00", forecast="2", importance="low"), observation(5, "cancelled", None, "2", importance="low"), observation(6, "cancelled", None, "2", importance="low"), observation(7, "postponed", None), observation(8, "postponed", None), observation(9, at=None, actual="3")]
    schema = "source_id string, source_event_id string, seq long, observed_at string, status_hint string, scheduled_for string, event_name string, country string, currency string, importance_tier string, event_category string, previous string, forecast string, actual string, revised string, source_url string"
    df = spark.createDataFrame(rows, schema).withColumns({c: F.col(c).cast("timestamp") for c in ("observed_at", "scheduled_for")})
    folded = calendar.revisions(df)
    got = [(r.change_reason, r.revision_number, r.revision_status) for r in folded.orderBy("seq").collect()]
    assert got == [("first_seen", 1, "active"), ("unchanged_confirmation", 1, "active"), ("time_changed", 2, "active"), ("forecast_changed", 3, "active"), ("metadata_changed", 4, "active"), ("cancelled", 5, "cancelled"), ("time_changed", 6, "active"), ("postponed", 7, "postponed"), ("postponed", 8, "postponed"), ("actual_added", 9, "completed")]
    made = folded.where("action = 'create'")
    applied = calendar.applied(made, calendar.supersessions(folded))
    assert [r.revision_number for r in calendar.current(applied).collect()] == [9]
    assert {r.revision_status for r in applied.where("revision_number < 5").collect()} == {"superseded"}
    assert calendar.dangling(calendar.supersessions(folded), made).isEmpty()
    assert calendar.dangling(calendar.supersessions(folded), made.where("revision_number <> 3")).count() == 2


def test_calendar_promotion(spark):
    rows = [("high", 20, 60, "active", "u"), ("high", 40, 60, "active", "u"), ("high", 70, 600, "active", "u"), ("high", 10, -1, "active", "u"), ("low", 1, 60, "cancelled", "u"), ("low", 1, None, "active", "u"), ("low", 1, 60, "active", "")]
    df = spark.createDataFrame([(k, i, (NOW - timedelta(minutes=c)).replace(tzinfo=None), (NOW + timedelta(minutes=u)).replace(tzinfo=None) if u is not None else None, s, url, "") for k, (i, c, u, s, url) in enumerate(rows)], "k int, importance_tier string, last_confirmed_at timestamp, scheduled_for timestamp, revision_status string, source_url string, source_event_id string")
    got = [(r.promotable, r.promotion_reason) for r in calendar.promotion(df, lit_now()).orderBy("k").collect()]
    assert got[0][0] and [g[1] for g in got[1:]] == ["within 2h but confirmation is aging", "confirmation is stale", "scheduledFor is in the past", "status cancelled is never high-attention", "no scheduledFor", "no evidence reference (sourceUrl or sourceEventId)"]


CANDIDATE = "candidate_id string, ordinal int, candidate_type string, item_id string, cluster_id string, calendar_event_id string, source_id string, promotable boolean, legal_status string, source_enabled boolean, forbidden_wording boolean, verification_tier string, may_promote boolean, evidence_type string, evidence_value string, priority_reason string, priority_tier string, freshness string, audit_href string, cluster_rule string, member_count int, confirmation_state string, scheduled_for timestamp, revision_status string, importance_tier string"


def candidate(k, **changes):
    row = dict(zip([c.split()[0] for c in CANDIDATE.split(", ")], [f"c{k}", k, "item", f"i{k}", None, None, "s1", True, "allowed", True, False, "verified", True, "url", "u", "why", "P0", "live", "/a", None, None, None, None, None, None], strict=True))
    return tuple((row | changes).values())


HISTORY = "item_id string, cluster_id string, calendar_event_id string, source_id string, priority_reason string, member_count int, calendar_signature string, created_at timestamp"
DISMISSAL = "target_type string, target_id string, quiet_until timestamp"


def decide(spark, candidates, history=(), dismissals=()):
    out = whispers.decide(spark.createDataFrame(candidates, CANDIDATE), spark.createDataFrame(list(history), HISTORY), spark.createDataFrame(list(dismissals), DISMISSAL), lit_now())
    return [(r.decision, r.reason_code) for r in out.orderBy("ordinal").collect()]


def past(minutes, **changes):
    row = {"item_id": None, "cluster_id": None, "calendar_event_id": None, "source_id": None, "priority_reason": None, "member_count": None, "calendar_signature": None, "created_at": (NOW - timedelta(minutes=minutes)).replace(tzinfo=None)}
    return tuple((row | changes).values())


def test_whisper_levels(spark):
    soon = (NOW + timedelta(minutes=45)).replace(tzinfo=None)
    event = {"candidate_type": "calendar_event", "item_id": None, "calendar_event_id": "e", "scheduled_for": soon, "revision_status": "active"}
    got = decide(spark, [candidate(0, priority_tier="P2"), candidate(1), candidate(2), candidate(3, promotable=False, legal_status=None, verification_tier="rumor"), candidate(4, candidate_type="cluster", cluster_id="k", cluster_rule="r", member_count=2), candidate(5, **event, confirmation_state="stale", importance_tier="high"), candidate(6, **event, confirmation_state="fresh", importance_tier="medium")])
    assert got == [("glow", "glow_threshold_met"), ("whisper", "whisper_threshold_met"), ("hold", "cooldown_active"), ("suppress", "ineligible[not_promotable,missing_source_legal_status,missing_source_proof,rumor_high_attention]"), ("glow", "glow_threshold_met"), ("hold", "stale_calendar_confirmation"), ("glow", "glow_threshold_met")]


def test_calendar_candidates(spark):
    row = ("fed", "e1", "https://c.example.org/", "high", (NOW + timedelta(minutes=30)).replace(tzinfo=None), "active", "fresh")
    views = spark.createDataFrame([row, ("fed", "e2", "", *row[3:6], "stale")], "source_id string, source_event_id string, source_url string, importance_tier string, scheduled_for timestamp, revision_status string, confirmation_state string")
    made = whispers.calendar_candidates(views, "allowed", True).withColumn("ordinal", F.when(F.col("candidate_id") == "cand-cal-fed::e1", 0).otherwise(1)).drop("_order")
    none = [spark.createDataFrame([], s) for s in (HISTORY, DISMISSAL)]
    got = {r.candidate_id: (r.target_id, r.level, r.message) for r in whispers.decision_views(whispers.decide(made, *none, lit_now())).collect()}
    assert got == {"cand-cal-fed::e1": ("fed::e1", "whisper", "Scheduled event approaching"), "cand-cal-fed::e2": ("fed::e2", "hold", "Held (stale_calendar_confirmation)")}
    assert {(r.evidence_type, r.evidence_value) for r in made.collect()} == {("url", "https://c.example.org/"), ("calendarSourceEventId", "e2")}


def test_numbering(spark):
    from newsmill.operators.numbering import numbered

    rows = spark.range(500).select((F.col("id") % 3).alias("a"), "id").repartition(7)
    got = [(r.n, r.a, r.id) for r in numbered(rows, [F.desc("a"), F.col("id")], "n").orderBy("n").collect()]
    want = sorted(((i % 3, i) for i in range(500)), key=lambda x: (-x[0], x[1]))
    assert got == [(k, *x) for k, x in enumerate(want)]


def test_prompt_identity(spark):
    got = values(spark, hashing.prompt_hash, [" one\r\ntwo\n", "one\ntwo", "one two"])
    assert got[0] == got[1] != got[2] == __import__("hashlib").sha256(b"one two").hexdigest()


def test_whisper_limits(spark):
    assert decide(spark, [candidate(0)], [past(4.99)]) == [("hold", "cooldown_active")]
    assert decide(spark, [candidate(0)], [past(5)]) == [("whisper", "whisper_threshold_met")]
    assert decide(spark, [candidate(0)], [past(6), past(14)]) == [("hold", "rate_limit_global_15m")]
    assert decide(spark, [candidate(0)], [past(6), past(15)]) == [("whisper", "whisper_threshold_met")]
    assert decide(spark, [candidate(0)], [past(m) for m in (16, 20, 30, 40, 59)]) == [("hold", "rate_limit_global_60m")]
    assert decide(spark, [candidate(0)], [past(20, source_id="s1"), past(40, source_id="s1")]) == [("hold", "rate_limit_per_source_60m")]
    assert decide(spark, [candidate(0, candidate_type="cluster", cluster_id="k", cluster_rule="r", member_count=3)], [past(110, cluster_id="k", priority_reason="other")]) == [("hold", "rate_limit_per_cluster_120m")]


def test_whisper_quiet_and_repeat(spark):
    until = lambda m: (NOW + timedelta(minutes=m)).replace(tzinfo=None)
    assert decide(spark, [candidate(0)], [], [("item", "i0", until(1))]) == [("hold", "dismissal_quiet_window")]
    assert decide(spark, [candidate(0)], [], [("item", "i0", until(0)), ("source", "s9", until(9))]) == [("whisper", "whisper_threshold_met")]
    assert decide(spark, [candidate(0)], [], [("global", "", until(9))]) == [("hold", "dismissal_quiet_window")]
    assert decide(spark, [candidate(0)], [past(300, item_id="i0", priority_reason="why")]) == [("hold", "repeat_item_no_reason_change")]
    cluster = {"candidate_type": "cluster", "cluster_id": "k", "cluster_rule": "r"}
    assert decide(spark, [candidate(0, **cluster, member_count=3)], [past(300, cluster_id="k", priority_reason="why", member_count=3)]) == [("hold", "repeat_cluster_no_growth_or_reason_change")]
    assert decide(spark, [candidate(0, **cluster, member_count=4)], [past(300, cluster_id="k", priority_reason="why", member_count=3)]) == [("whisper", "whisper_threshold_met")]


def test_interactions_and_session(spark):
    rows = [(1, "a", "dismiss", "item", "i", 0), (2, "b", "dismiss", "item", "i", 119), (3, "c", "dismiss", "item", "i", 120), (4, "d", "dismiss", "decision", "x", 1), (5, "", "dismiss", "item", "i", 1), (6, "f", "mark_seen", "item", "i", 2), (7, "g", "dismiss", "item", " ", 3), (8, "h", "wave", "item", "i", 3)]
    df = spark.createDataFrame([(*r[:5], (NOW + timedelta(minutes=r[5])).replace(tzinfo=None)) for r in rows], "seq long, intent_id string, interaction_type string, target_type string, target_id string, at timestamp")
    got = [(r.status, r.result) for r in whispers.record_interactions(df).orderBy("seq").collect()]
    assert got == [("recorded", "dismissal_recorded"), ("ignored", "already_dismissed_in_quiet_window"), ("recorded", "dismissal_recorded"), ("rejected", "undismissable_target"), ("rejected", "malformed_intent"), ("recorded", "mark_seen_recorded"), ("rejected", "missing_target"), ("rejected", "malformed_intent")]
    at = lambda m: (NOW + timedelta(minutes=m)).replace(tzinfo=None)
    views = spark.createDataFrame([("d1", "item", "i1", "whisper"), ("d2", "item", "i2", "glow"), ("d3", "item", "i3", "suppress"), ("d4", "item", "i4", "glow"), ("d5", "cluster", "i5", "glow")], "decision_id string, target_type string, target_id string, level string")
    gone = spark.createDataFrame([("w1", "item", "i1", at(5), 0), ("w2", "item", "i1", at(9), 1), ("w3", "item", "i2", at(-5), 2), ("w4", "item", "i3", at(5), 3)], "dismissal_id string, target_type string, target_id string, quiet_until timestamp, seq long")
    acts = spark.createDataFrame([("x", "item", "i4", "open_audit", "r1", 0), ("d4", "item", "zz", "mark_seen", "r2", 1), ("d5", "item", "q", "open_evidence", "r3", 2)], "decision_id string, target_type string, target_id string, interaction_type string, record_id string, seq long")
    got = {r.decision_id: (r.placement, r.projection_reason, r.record_id) for r in whispers.session_view(views, gone, acts, lit_now()).collect()}
    assert got == {"d1": ("held", "dismissed_quiet_window", "w1"), "d2": ("active", "expired_quiet_window", None), "d3": ("inspection", "suppressed_inspection_only", None), "d4": ("active", "seen_no_suppression", "r2"), "d5": ("active", "open_audit_no_suppression", "r3")}


def test_event_log(spark, tmp_path):
    log = event_log.EventLog(spark, str(tmp_path / "log"))
    row = lambda i, key, minute: (i, "calendar-runs", key, (NOW + timedelta(minutes=minute)).replace(tzinfo=None), "v1", "p1", "calendar", None, "{}")
    schema = "record_id string, stream_name string, stream_key string, recorded_at timestamp, schema_version string, producer_version string, source_phase string, reason string, payload string"
    log.append(spark.createDataFrame([row("a", "s1", 0), row("b", "s1", 1), row("c", "s2", 0)], schema), ["recorded_at", "record_id"])
    log.append(spark.createDataFrame([row("d", "s1", 2)], schema), ["recorded_at"])
    for bad in ([row("a", "s1", 5)], [row("e", "s1", 5), row("e", "s1", 6)], [row("", "s1", 5)]):
        with pytest.raises(ValueError):
            log.append(spark.createDataFrame(bad, schema), ["recorded_at"])
    got = {(r.record_id, r.stream_key, r.sequence) for r in log.read_all().collect()}
    assert got == {("a", "s1", 0), ("b", "s1", 1), ("d", "s1", 2), ("c", "s2", 0)}
    assert [r.record_id for r in event_log.replayed(log.read_all()).collect()] == ["a", "b", "d", "c"]
    assert [r.record_id for r in event_log.global_order(log.read_all()).collect()] == ["a", "c", "b", "d"]
    assert log.read_stream("calendar-runs", "s2").count() == 1
    with pytest.raises(ValueError):
        event_log.replayed(log.read_all().where("record_id <> 'b'"))
    assert not [m for m in dir(event_log.EventLog) if any(w in m for w in ("update", "delete", "remove", "overwrite"))]


def test_envelopes(spark):
    df = spark.createDataFrame([("s1", "p1", NOW.replace(tzinfo=None)), ("s2", "p2", NOW.replace(tzinfo=None))], "source_id string, raw_payload_id string, observed_at timestamp")
    got = event_log.to_envelope(df, "ingestion-raw-payloads", F.col("raw_payload_id"), ["raw_payload_id"], before=3).collect()
    assert {(r.record_id, r.stream_key) for r in got} == {("ingestion-raw-payload:3:p1", "s1"), ("ingestion-raw-payload:4:p2", "s2")}


def test_audit(spark, tmp_path):
    part = lambda n: spark.createDataFrame([(f"{k:03}", json.dumps({"k": k})) for k in range(n)], "key string, payload string")
    records = audit.contents({"snapshot": part(1), "normalized_item": part(5), "cluster": part(2)})
    chain = audit.ledger(records)
    assert chain.count() == 8 and audit.broken_links(chain).isEmpty()
    assert audit.broken_links(chain.withColumn("content", F.when(F.col("sequence") == 3, "x").otherwise(F.col("content")))).count() == 1
    assert audit.broken_links(chain.where("sequence <> 4")).count() >= 1
    folder = audit.write_run(str(tmp_path), "run-1", records)
    assert audit.verify_run(spark, folder) == 8
    for bad in ("run 1", "run-1"):
        with pytest.raises(Exception):  # noqa: B017
            audit.write_run(str(tmp_path), bad, records)
    audit.ledger(records, "run-1").where("sequence < 7").write.mode("overwrite").parquet(f"{folder}/ledger")
    with pytest.raises(ValueError, match="integrity"):
        audit.verify_run(spark, folder)
    short = audit.read_run(spark, folder)
    again = audit.manifest(short.chain, short.records).drop("event_count", "final_hash").join(short.manifest.select("run_id", "event_count", "final_hash"), "run_id")
    assert [r.problem for r in audit.problems(audit.Runs(short.records, short.documents, short.chain, again)).collect()] == ["audit ledger is truncated"]


def test_runs_without_a_table_are_named(spark):
    records = audit.contents({"generation": spark.createDataFrame([("a", "1", '{"x": 1}'), ("b", "1", "{}")], "run_id string, key string, payload string")})
    runs = audit.sealed(records)
    lost = audit.Runs(runs.records.where("run_id = 'a'"), runs.documents, runs.chain, runs.manifest.where("run_id = 'a'"))
    assert {r.run_id: r.problem for r in audit.problems(lost).collect()} == {"a": None, "b": "run semantic identity mismatch"}


def test_semantic_hash_leaves_out_what_is_incidental(spark):
    def of(payload, kind="generation"):
        return audit.semantic_hashes(audit.contents({kind: spark.createDataFrame([("r", "1", payload)], "run_id string, key string, payload string")})).first().semantic_hash

    base = of('{"status": "accepted", "n": 1.0, "telemetry": {"cost": 1}, "responseId": "a"}')
    assert base == of('{"n": 1, "telemetry": null, "status": "accepted"}') != of('{"n": 2, "status": "accepted"}')
    assert of('{"telemetry": 1}', "cluster") != of('{"telemetry": 2}', "cluster")


CANONICAL = {
    '{"b":1,"a":{"d":[1,{"z":null,"y":true}],"c":"x"}}': '{"a":{"c":"x","d":[1,{"y":true,"z":null}]},"b":1}',
    '[1.0, 1e2, 1e21, 1e20, 0.1, -0, -0.0, 12345678901234567890, 1.50, 1e-7, 0.000001, 0.0000001, 123456789.125, 1E400]': "[1,100,1e+21,100000000000000000000,0.1,0,0,12345678901234567000,1.5,1e-7,0.000001,1e-7,123456789.125,null]",
    '{"é":"a\\u001fb/\\"\\\\","e":"\\u00e9\\u0007"}': '{"e":"é\\u0007","é":"a\\u001fb/\\"\\\\"}',
    '{"\\uffff":1,"\\ud83d\\ude00":2,"Z":3,"a":4}': '{"Z":3,"a":4,"\U0001f600":2,"\uffff":1}',
    '{"a":1,"a":{"b":2}}': '{"a":{"b":2}}', ' { "a" : [ ] } ': '{"a":[]}', '"x"': '"x"', "null": "null", "[[],[{}]]": "[[],[{}]]", '"\\ud800"': '"\\ud800"', "1.0E5": "100000", "bad": None, "": None, "NaN": None,
}


def test_canonical_text(spark):
    """Both ways to a canonical text agree with it written by hand."""
    rows = spark.createDataFrame([*((k,) for k in CANONICAL), (None,)], "j string")
    got = {r.j: r.c for r in rows.select("j", hashing.canonical_text(F.col("j")).alias("c")).collect()}
    assert got == CANONICAL | {None: None}
    assert {k: hashing._plain_canonical(k) for k in CANONICAL} == CANONICAL
    deep = "[" * 60 + "]" * 60
    assert spark.createDataFrame([(deep,)], "j string").select(hashing.canonical_text(F.col("j"))).first()[0] == deep


def test_number_text():
    rng = random.Random(6)
    assert [hashing.number_text(x) for x in (0.0, -0.0, 5e-324, 1.7976931348623157e308, 1e21, 1e20, 123e-8, 1e-6, -1.5, 2.0**53, float("nan"), float("inf"))] == ["0", "0", "5e-324", "1.7976931348623157e+308", "1e+21", "100000000000000000000", "0.00000123", "0.000001", "-1.5", "9007199254740992", "null", "null"]
    assert all(float(hashing.number_text(x)) == x for x in (rng.uniform(-1, 1) * 10 ** rng.randrange(-300, 300) for _ in range(2000)))


def test_summaries(spark):
    source = "Rates rose 25bps to 5.5% today. Markets fell 2% after the call."
    items = spark.createDataFrame([(g, "it", source) for g in range(8)], "generation_id int, item_id string, text string")
    claim = lambda t, q, i="it": [(t, [(i, q)])]
    fine = "Rates rose 25bps to 5.5% today."
    rows = [(0, "Rates up 25bps", claim("Rates rose 25bps", fine), []), (1, "H", claim("x", fine, "other"), []), (2, "H", claim("x", "not in the source text"), []), (3, "H 99%", claim("up 7%", fine), []), (4, "H", claim("you should buy now", fine), []), (5, "H", claim("x", "short"), []), (6, "", claim("x", fine), []), (7, "H", [], [])]
    df = spark.createDataFrame(rows, f"generation_id int, headline string, claims {summaries.CLAIMS}, uncertainty array<string>")
    got = [(r.accepted, r.issues) for r in summaries.validated(df, items).orderBy("generation_id").collect()]
    assert got == [(True, []), (False, ["unknown_citation@claims.0.evidence.0"]), (False, ["evidence_mismatch@claims.0.evidence.0"]), (False, ["unsupported_number@claims.0.text", "unsupported_number@headline"]), (False, ["trade_action@output"]), (False, ["schema@claims"]), (False, ["schema@headline"]), (False, ["schema@claims"])]
    ready = spark.createDataFrame([(0, "it", "Title", source, True), (1, "it", "T", source, False)], "generation_id int, item_id string, title string, text string, eligible boolean")
    out = {r.generation_id: (r.status, r.issues) for r in summaries.generate(ready, summaries.extractive, items).collect()}
    assert out == {0: ("accepted", []), 1: ("skipped", ["ineligible_source_time"])}
    usd = spark.range(1).select(summaries.cost(F.lit("gpt-4.1-mini"), F.lit(1000), F.lit(200), F.lit(50)), summaries.cost(F.lit("x"), F.lit(1), F.lit(0), F.lit(1))).first()
    assert float(usd[0]) == 0.00042 and usd[1] is None
    budget = summaries.within_budget(spark.createDataFrame([(1, 0.6), (2, 0.6), (3, 0.3)], "seq long, ceiling double"), 1.0)
    assert {r.seq: r.reserved for r in budget.collect()} == {1: True, 2: False, 3: True}


def test_extracted_sentences_lose_spaces_only(spark):
    rows = spark.createDataFrame([(0, "a", "Rates at 4630", " Rates rose to 4630"), (1, "b", "Cuts", "Gold lost 100 points. Oil gained 11  \nThird one 2.")], "generation_id long, item_id string, title string, text string")
    got = {r.generation_id: [c.text for c in r.claims] for r in summaries.extractive(rows).collect()}
    assert got == {0: ["Rates rose to 4630"], 1: ["Gold lost 100 points.", "Oil gained 11  \nThird one 2."]}
    out = summaries.generate(rows.withColumn("eligible", F.lit(True)), summaries.extractive, rows)
    assert {r.generation_id: (r.status, r.issues) for r in out.collect()} == {0: ("accepted", []), 1: ("accepted", [])}
    ends = spark.createDataFrame([(0, "a", "x", "Up 10 points. Then it fell to 111")], "generation_id long, item_id string, title string, text string")
    assert [c.text for c in summaries.extractive(ends).first().claims] == ["Up 10 points.", "Then it fell to 111"]


def test_displayed_inputs_lose_spaces_only(spark):
    shown = display.priority(F.lit("P1"), F.lit("soon"), F.lit(" recency 10; size 1; of 22"), F.lit(False))
    assert spark.range(1).select(shown["inputs"]).first()[0] == ["recency 10", "size 1", "of 22"]


def test_readiness(spark):
    base = ("allowed", "allowed", "supported", "recorded_fixture", ["text/xml"], 100, 1000)
    rows = [("a", True, *base), ("b", None, *base), ("c", True, "blocked", *base[1:]), ("d", True, "allowed", None, *base[2:]), ("e", True, *base[:4], [], *base[5:]), ("f", True, *base[:5], 0, 1000), ("g", True, *base), ("h", True, *base), ("i", True, *base), ("j", True, *base)]
    df = spark.createDataFrame(rows, "source_id string, enabled boolean, legal_status string, tos_status string, parser_support string, acquisition_mode string, allowed_content_types array<string>, max_payload_bytes long, timeout_ms long")
    results = spark.createDataFrame([("a", "success", None, "text/xml", "hello", None), ("g", "success", None, "text/xml", "big", 101), ("h", "http_error", 503, None, None, None), ("i", "malformed", None, "text/xml", "<x", None)], "source_id string, kind string, http_status int, content_type string, payload_text string, byte_length long")
    got = {r.source_id: (r.outcome, r.skip_reason or r.failure_code, r.retryable, r.payload_status, r.payload_text) for r in readiness.outcomes(df, results, "r1").collect()}
    assert got["a"] == ("fetched", None, False, "recorded", "hello") and got["b"][1] == "source_not_enabled" and got["c"][1] == "source_legal_blocked" and got["d"][1] == "tos_missing" and got["e"][1] == "content_type_unsupported" and got["f"][1] == "max_payload_missing"
    assert got["g"] == ("quarantined", "payload_too_large", False, "rejected", None) and got["h"] == ("failed", "http_status_failure", True, None, None) and got["i"] == ("quarantined", "malformed_payload", False, "quarantined", "<x") and got["j"] == ("failed", "transport_unavailable", True, None, None)
    fails = spark.createDataFrame([("network_timeout", True, 1), ("network_timeout", True, 2), ("network_timeout", True, 3), ("empty_payload", True, 1), ("network_timeout", False, 1)], "failure_code string, retryable boolean, attempt int")
    plan = {(r.failure_code, r.retryable, r.attempt): (r.retry_reason, r.delay_ms) for r in readiness.retry_plan(fails, lit_now()).collect()}
    assert plan == {("network_timeout", True, 1): ("scheduled_backoff", 1000), ("network_timeout", True, 2): ("scheduled_backoff", 2000), ("network_timeout", True, 3): ("max_attempts_reached", None), ("empty_payload", True, 1): ("failure_code_not_in_policy", None), ("network_timeout", False, 1): ("failure_not_retryable", None)}


def plain_budget(rows, limit):
    left, out = Decimal(str(limit)), set()
    for seq, price in sorted(rows):
        if price is not None and price <= left:
            left -= price
            out.add(seq)
    return out


@pytest.mark.parametrize(("kind", "rounds"), [("even", 32), ("mixed", 32), ("mixed", 1), ("shrinking", 3), ("fits", 32)])
def test_budget_equals_the_walk(spark, kind, rounds):
    rng = random.Random(5)
    price = {"even": lambda k: Decimal("0.0123"), "mixed": lambda k: Decimal(rng.randrange(1, 10**8)) / 10**8, "shrinking": lambda k: Decimal(2) / 1000 if k % 2 else Decimal(999 - k // 2) / 1000, "fits": lambda k: Decimal("0.00001")}[kind]
    rows = [(k * 3, None if k % 50 == 7 else price(k)) for k in range(400)]
    spark.sparkContext.setCheckpointDir(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    got = summaries.within_budget(spark.createDataFrame(rows, "seq long, ceiling decimal(18,8)").repartition(5), 1.0, rounds)
    assert got.columns == ["seq", "ceiling", "reserved"]
    assert {r.seq for r in got.where("reserved").collect()} == plain_budget(rows, 1.0) and got.count() == 400


def test_budget_of_many_requests(spark):
    """A million requests: what is reserved sums up to the budget as the walk has it."""
    spark.sparkContext.setCheckpointDir(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    rows = spark.range(1_000_000).select(F.col("id").alias("seq"), ((F.col("id") * 7919 % 10_007 + 1) / 10_000_000).cast("decimal(18,8)").alias("ceiling"))
    want = plain_budget([(k, (Decimal(k * 7919 % 10_007 + 1) / 10_000_000).quantize(Decimal("1e-8"))) for k in range(30_000)], 10)
    got = summaries.within_budget(rows, 10.0).where("reserved")
    assert got.count() == len(plain_budget([(k, (Decimal(k * 7919 % 10_007 + 1) / 10_000_000).quantize(Decimal("1e-8"))) for k in range(1_000_000)], 10)) and got.where("seq < 30000").count() == len(want)


URLS = {
    "https://e.com": "https://e.com/", "HTTPS://E.COM/A": "https://e.com/A", "https://e.com:443/a": "https://e.com/a", "http://e.com:443/a": "http://e.com:443/a", "http://e.com:/a": "http://e.com/a", "ftp://e.com:21/a": "ftp://e.com/a",
    "https://User:Pw@E.com/a": "https://User:Pw@e.com/a", "https://e.com/a/../b": "https://e.com/b", "https://e.com/a/./b": "https://e.com/a/b", "https://e.com/..": "https://e.com/", "https://e.com/a/..": "https://e.com/", "https://e.com/a/b/..": "https://e.com/a",
    "https://e.com/../../x": "https://e.com/x", "https://e.com/a/%2E%2e/b": "https://e.com/b", "https://e.com/a/.%2E/b/%2e": "https://e.com/b", "https://e.com/a/.../b": "https://e.com/a/.../b", "https://e.com/a//b": "https://e.com/a//b", "https://e.com/a//../b": "https://e.com/a/b",
    "https://e.com/a/b/../?q=1": "https://e.com/a/?q=1", "https://e.com/a\\b\\..\\c": "https://e.com/a/c", "https://e.com/é": "https://e.com/%C3%A9", "https://e.com/a b": "https://e.com/a%20b", "https://e.com/\U0001f600": "https://e.com/%F0%9F%98%80", 'https://e.com/"<>`{}': "https://e.com/%22%3C%3E%60%7B%7D",
    "https://e.com/%c3%a9%zz": "https://e.com/%c3%a9%zz", "https://e.com/a+b|[~]": "https://e.com/a+b|[~]", "https://e.com/?q=1 2": "https://e.com/?q=1+2", "https://e.com/?q=1+2&r=%20": "https://e.com/?q=1+2&r=+", "https://e.com/?q=é": "https://e.com/?q=%C3%A9", "https://e.com/?q=%C3%A9": "https://e.com/?q=%C3%A9",
    "https://e.com/?a": "https://e.com/?a=", "https://e.com/?a=b=c": "https://e.com/?a=b%3Dc", "https://e.com/?=x": "https://e.com/?=x", "https://e.com/?&&a=1&": "https://e.com/?a=1", "https://e.com/?a=100%&b=%4": "https://e.com/?a=100%25&b=%254", "https://e.com/?a=~*-._": "https://e.com/?a=%7E*-._",
    "https://e.com/p/?UTM_Source=x&utm%5Fterm=y": "https://e.com/p", "https://e.com/p?fbclid=1&b=2#f": "https://e.com/p?b=2", "https://e.com/p///": "https://e.com/p", "https://e.com///": "https://e.com/", "  https://e.com/a\n/b\t ": "https://e.com/a/b", "https://e.com?x=1": "https://e.com/?x=1", "https://e.com#f": "https://e.com/",
    "/a/b": None, "mailto:a@b.c": None, "https://": None, "": None, "https://a b/": None,
}


def test_urls_by_the_standard(spark):
    rows = spark.createDataFrame([(k,) for k in URLS], "u string").select("u", urls.canonical_url(F.col("u")).alias("c"))
    assert {r.u: r.c for r in rows.collect()} == URLS
