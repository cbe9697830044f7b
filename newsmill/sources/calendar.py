"""Calendar payloads: JSON text to observations, with quarantine event by event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import SNIPPET
from ..functions.text import sanitize

STATUSES = ["scheduled", "cancelled", "postponed", "completed"]
IMPORTANCE = ["high", "medium", "low", "unknown"]


def payload_state() -> Column:
    """ok, malformed_json or malformed_structure."""
    v = F.try_parse_json(F.col("payload_text"))
    is_array = F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.events", "variant")).startswith("ARRAY"), F.lit(False))
    return F.when(v.isNull(), "malformed_json").when(~is_array, "malformed_structure").otherwise("ok")


def _text(path: str) -> Column:
    """A field that is a string with something in it, trimmed; else null."""
    v = F.try_variant_get("event", f"$.{path}", "variant")
    value = F.trim(F.try_variant_get("event", f"$.{path}", "string"))
    return F.when((F.schema_of_variant(v) == "STRING") & (value != ""), value)


def scanned(payloads: DataFrame) -> DataFrame:
    """A row for each event of payloads (source_id, raw_payload_id, payload_text, observed_at)."""
    v = F.try_variant_get(F.try_parse_json(F.col("payload_text")), "$.events", "array<variant>")
    rows = payloads.select("source_id", "raw_payload_id", "observed_at", F.posexplode(v).alias("position", "event"))
    nested = F.schema_of_variant(F.try_variant_get("event", "$.values", "variant")).startswith("OBJECT")
    value = lambda c: F.when(F.coalesce(nested, F.lit(False)), _text(f"values.{c}")).otherwise(_text(c))
    rows = rows.withColumns({
        "given_id": _text("sourceEventId"), "given_key": _text("canonicalEventKey"), "event_name": sanitize(_text("eventName")), "raw_status": F.lower(_text("status")), "raw_importance": F.lower(_text("importance")),
        "raw_time": _text("scheduledFor"), "country": _text("country"), "currency": _text("currency"), "event_category": _text("eventCategory"), "source_url": _text("sourceUrl"), "source_timezone": _text("sourceTimezone"),
        **{c: value(c) for c in ("previous", "forecast", "actual", "revised")},
    })
    known = F.col("raw_status").isin(STATUSES)
    hint = F.when(known, F.col("raw_status")).otherwise("scheduled")
    at = F.try_to_timestamp("raw_time")
    rows = rows.withColumns({
        "status_hint": hint, "scheduled_for": at, "importance_tier": F.when(F.col("raw_importance").isin(IMPORTANCE), F.col("raw_importance")).otherwise("unknown"), "source_event_id": F.coalesce("given_id", "given_key"),
        "canonical_event_key": F.coalesce("given_key", F.concat_ws("|", F.coalesce("country", F.lit("?")), F.coalesce("currency", F.lit("?")), "event_name")),
    })
    no_time = F.when(F.col("raw_time").isNull(), "missing_scheduled_for").when(F.col("scheduled_for").isNull(), "invalid_scheduled_for")
    reason = F.when(F.col("source_event_id").isNull(), "missing_identity").when(F.col("event_name") == "", "missing_event_name").when(F.col("status_hint") == "scheduled", no_time)
    marks = F.array_compact(F.array(F.when(~known, "invalid_status"), F.when(~F.col("raw_importance").isin(IMPORTANCE), "importance_downgraded"), no_time))
    out = rows.withColumn("quarantine_reason", reason)
    return out.withColumn("warnings", F.when(F.col("quarantine_reason").isNotNull(), F.array("quarantine_reason")).otherwise(marks)).drop("given_id", "given_key", "raw_status", "raw_importance", "raw_time")


def malformed(events: DataFrame) -> DataFrame:
    rows = events.where("quarantine_reason is not null")
    return rows.select(F.concat_ws("-", F.lit("cal-mal"), "raw_payload_id", F.col("position").cast("string")).alias("malformed_id"), "source_id", F.col("quarantine_reason").alias("reason"), F.substring(F.to_json("event"), 1, SNIPPET).alias("raw_snippet"))


def observations(events: DataFrame) -> DataFrame:
    """Parsed events in the form that operators.calendar.revisions takes; seq orders payloads by time, then position."""
    good = events.where("quarantine_reason is null")
    return good.withColumn("seq", F.unix_millis("observed_at") * 100_000 + F.col("position"))
