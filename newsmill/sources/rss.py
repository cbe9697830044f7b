"""RSS payloads by the rules of a lenient scanner: items by pattern, bad ones quarantined, the rest normalised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import SNIPPET
from ..functions.hashing import fnv1a
from ..functions.text import contains_html, sanitize, tag_content
from ..functions.times import publication


def well_formed() -> Column:
    text = F.coalesce("payload_text", F.lit(""))
    return text.rlike(r"(?i)<rss\b|<feed\b|<channel\b") & (F.regexp_count(text, F.lit(r"(?i)<item\b")) == F.regexp_count(text, F.lit(r"(?i)</item>")))


def scanned(payloads: DataFrame, now: Column) -> DataFrame:
    """A row for each item block of payloads (source_id, raw_payload_id, payload_text) that are well formed.

    quarantine_reason is set for items without identity or title; duplicate for repeats of an identity, of which the
    first stays; neither for parsed items. warnings are codes in order.
    """
    blocks = payloads.where(well_formed()).select("source_id", "raw_payload_id", F.posexplode(F.regexp_extract_all("payload_text", F.lit(r"(?is)(<item\b.*?</item>)"), 1)).alias("position", "block"))
    b = F.col("block")
    either = lambda x, y: F.coalesce(tag_content(b, x), tag_content(b, y))
    raw = blocks.withColumns({"_title": tag_content(b, "title"), "_text": either("description", "summary"), "_date": either("pubDate", "published")})
    rows = raw.withColumns({
        "title": sanitize(F.col("_title")), "excerpt": sanitize(F.col("_text")), "guid": sanitize(tag_content(b, "guid")), "link": sanitize(tag_content(b, "link")),
        "author": sanitize(either("author", "dc:creator")), "publication": publication(F.col("_date"), now),
    })
    identity = F.coalesce(F.nullif("guid", F.lit("")), F.nullif("link", F.lit("")))
    rows = rows.withColumn("source_item_id", identity)
    rows = rows.withColumn("quarantine_reason", F.when(identity.isNull(), "missing_identity").when(F.col("title") == "", "missing_title"))
    good = F.col("quarantine_reason").isNull()
    order = Window.partitionBy("raw_payload_id", good, "source_item_id").orderBy("position")
    rows = rows.withColumn("duplicate", good & (F.row_number().over(order) > 1))
    state = F.col("publication.state")
    marks = F.array_compact(F.array(F.when(contains_html(F.col("_title")) | contains_html(F.col("_text")), "html_sanitized"), F.when(state != "valid", F.concat(state, F.lit("_pubdate")))))
    warnings = F.when(~good, F.array("quarantine_reason")).when(F.col("duplicate"), F.array(F.lit("duplicate_guid"))).otherwise(marks)
    return rows.withColumn("warnings", warnings).drop("_title", "_text", "_date")


def malformed(items: DataFrame) -> DataFrame:
    rows = items.where("quarantine_reason is not null")
    return rows.select(F.concat_ws("-", F.lit("mal"), "raw_payload_id", F.col("position").cast("string")).alias("malformed_item_id"), "source_id", "raw_payload_id", F.col("quarantine_reason").alias("reason"), F.substring("block", 1, SNIPPET).alias("raw_snippet"))


def default_tags(assets: Column, topics: Column) -> Column:
    tag = lambda kind: lambda v: F.struct(F.concat(F.lit(f"{kind}."), F.lower(v)).alias("tag_id"), F.lit(kind).alias("tag_type"), v.alias("tag_value"), F.lit("deterministic").alias("provenance"))
    return F.concat(F.transform(assets, tag("asset")), F.transform(topics, tag("topic")))


def normalised(items: DataFrame, sources: DataFrame, observed_at: Column) -> DataFrame:
    """Parsed items as external items. The hash holds the source, so it never merges across sources."""
    good = items.where("quarantine_reason is null and not duplicate")
    known = F.col("publication.state") == "valid"
    status = F.when(known, "known").when(F.col("publication.state") == "future", "caveat_future").otherwise("unknown")
    tags = default_tags(F.col("default_asset_tags"), F.col("default_topic_tags")) if "default_asset_tags" in sources.columns else F.array().cast("array<struct<tag_id:string,tag_type:string,tag_value:string,provenance:string>>")
    empty = lambda c: F.nullif(c, F.lit("")).alias(c)
    own = [c for c in ("default_asset_tags", "default_topic_tags") if c in sources.columns]
    rows = good.join(sources.select("source_id", *own), "source_id")
    return rows.select(
        F.concat_ws("::", "source_id", "source_item_id").alias("item_id"), "source_id", "source_item_id", F.col("publication.at").alias("source_event_time"), status.alias("source_event_time_status"),
        observed_at.alias("observed_at"), "title", empty("excerpt"), F.nullif("link", F.lit("")).alias("url"), empty("author"), F.lit("en").alias("language"), tags.alias("tags"),
        F.when(known, "reported").otherwise("unverified").alias("verification_tier"), F.when(known, "live").otherwise("unknown").alias("freshness_state"),
        F.concat(F.lit("h."), "source_id", F.lit("."), fnv1a(F.concat("source_item_id", F.lit("|"), "title"))).alias("dedupe_hash"), "raw_payload_id",
    )


def external_items(normal: DataFrame) -> DataFrame:
    """Normalised items as a snapshot takes them: those with a known event time, '' for a missing excerpt."""
    return normal.where("source_event_time is not null").withColumn("excerpt", F.coalesce("excerpt", F.lit("")))


def runs(payloads: DataFrame, items: DataFrame, sources: DataFrame) -> DataFrame:
    """A row for each source: its skip reason, or counts and status of its payload."""
    from ..operators.gates import skip_reason

    each = items.groupBy("source_id").agg(F.count_if(F.expr("quarantine_reason is null and not duplicate")).alias("items"), F.count_if(F.col("quarantine_reason").isNotNull()).alias("malformed"), F.sum(F.size("warnings")).alias("warnings"))
    fetched = payloads.select("source_id", well_formed().alias("ok"), F.col("payload_text").isNotNull().alias("fetched"))
    rows = sources.withColumn("skip_reason", skip_reason()).join(fetched, "source_id", "left").join(each, "source_id", "left").fillna(0, ["items", "malformed", "warnings"])
    status = F.when(F.col("skip_reason").isNotNull(), "skipped").when(~F.coalesce("ok", F.lit(False)) | (F.col("items") == 0), "failed").when(F.col("malformed") > 0, "partial_success").otherwise("success")
    return rows.select("source_id", "skip_reason", status.alias("status"), "items", "malformed", "warnings")


def fetched(sources: DataFrame, recorded: DataFrame) -> DataFrame:
    """Payloads of the sources that pass the gate, which comes before the lookup; a miss is a failed fetch."""
    from ..operators.gates import fetch_eligible

    rows = sources.where(fetch_eligible()).select("source_id").join(recorded, "source_id", "left")
    return rows.withColumn("failure_reason", F.when(F.col("payload_text").isNull(), "no recorded payload for source"))
