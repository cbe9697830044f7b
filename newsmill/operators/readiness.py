"""Source readiness: eligibility, the outcome of an offline fetch, quarantine and retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.hashing import fnv1a
from .gates import readiness_reason

#: Failures that are tried again (fixed values).
RETRYABLE = ["network_timeout", "network_unavailable_simulated", "http_status_failure", "transport_unavailable"]


def decided(profiles: DataFrame) -> DataFrame:
    reason = readiness_reason()
    return profiles.withColumns({"skip_reason": reason, "status": F.when(reason.isNull(), "eligible").otherwise("skipped")})


def outcomes(profiles: DataFrame, results: DataFrame, run_id: str) -> DataFrame:
    """A row for each profile: outcome (skipped, fetched, failed, quarantined) with failure_code, retryable, payload_*.

    results: source_id, kind, http_status, content_type, payload_text, byte_length. A source without one is unavailable.
    Oversized and wrongly typed payloads keep their description and hash only, malformed ones their text too.
    """
    rows = decided(profiles).join(results, "source_id", "left").withColumn("kind", F.coalesce("kind", F.lit("unavailable")))
    text = F.coalesce("payload_text", F.lit(""))
    size = F.coalesce("byte_length", F.char_length(text)).cast("long")
    media = F.coalesce("content_type", F.lit("application/octet-stream"))
    ok = F.col("kind") == "success"
    code = (
        F.when(F.col("status") == "skipped", F.lit(None).cast("string"))
        .when(ok & (text == ""), "empty_payload").when(ok & ~F.array_contains("allowed_content_types", media), "unsupported_content_type")
        .when(ok & (size > F.col("max_payload_bytes")), "payload_too_large").when(ok, F.lit(None).cast("string"))
        .when(F.col("kind") == "timeout", "network_timeout").when(F.col("kind") == "unavailable", "transport_unavailable")
        .when(F.col("kind") == "http_error", "http_status_failure").when(F.col("kind") == "empty", "empty_payload")
        .when(F.col("kind") == "unsupported_content_type", "unsupported_content_type").when(F.col("kind") == "oversized", "payload_too_large")
        .when(F.col("kind") == "malformed", "malformed_payload").otherwise("unknown_failure")
    )
    rows = rows.withColumn("failure_code", code)
    held = F.col("failure_code").isin("unsupported_content_type", "payload_too_large", "malformed_payload")
    outcome = F.when(F.col("status") == "skipped", "skipped").when(F.col("failure_code").isNull(), "fetched").when(held, "quarantined").otherwise("failed")
    retryable = F.col("failure_code").isin("network_timeout", "transport_unavailable") | ((F.col("failure_code") == "http_status_failure") & (F.coalesce("http_status", F.lit(0)) >= 500))
    keeps = F.coalesce(F.col("failure_code") == "malformed_payload", ok & F.col("failure_code").isNull())
    size = F.when((F.col("kind") == "oversized") & F.col("byte_length").isNull(), F.col("max_payload_bytes") + 1).otherwise(size)
    has = outcome.isin("fetched", "quarantined")
    status = F.when(outcome == "fetched", "recorded").when(F.col("failure_code") == "malformed_payload", "quarantined").when(outcome == "quarantined", "rejected")
    return rows.select(
        "source_id", outcome.alias("outcome"), "skip_reason", "failure_code", F.coalesce(retryable, F.lit(False)).alias("retryable"), status.alias("payload_status"),
        F.when(has, F.concat(F.lit(f"pay-{run_id}-"), "source_id")).alias("payload_id"), F.when(has, size).alias("byte_length"),
        F.when(has, fnv1a(text)).alias("payload_hash"), F.when(has & keeps, text).alias("payload_text"),
    )


def retry_plan(failures: DataFrame, now: Column) -> DataFrame:
    """failures (failure_code, retryable, attempt) and should_retry, retry_reason, delay_ms, next_attempt_at."""
    reason = (
        F.when(~F.col("retryable"), "failure_not_retryable").when(~F.col("failure_code").isin(RETRYABLE), "failure_code_not_in_policy")
        .when(F.col("attempt") >= C.RETRY_ATTEMPTS, "max_attempts_reached").otherwise("scheduled_backoff")
    )
    again = reason == "scheduled_backoff"
    delay = F.least(F.lit(C.RETRY_CAP_MS).cast("double"), F.lit(C.RETRY_BASE_MS) * F.pow(F.lit(C.RETRY_FACTOR), F.col("attempt") - 1)).cast("long")
    at = F.timestamp_millis(F.unix_millis(now) + delay)
    return failures.withColumns({"should_retry": again, "retry_reason": reason, "delay_ms": F.when(again, delay), "next_attempt_at": F.when(again, at)})
