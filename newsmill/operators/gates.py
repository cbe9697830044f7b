"""Gates: which sources may be fetched, shown, promoted. Ordered rules; the first that applies decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import PROMOTABLE_TIERS, USABLE_PROVENANCE

RSS_TYPES = ["rss_fixture"]
CALENDAR_TYPES = ["economic_calendar_fixture"]


def skip_reason(types: list[str] = RSS_TYPES) -> Column:
    """Why a source isn't fetched; null if it is."""
    return (
        F.when(F.col("legal_status") == "needs_review", "legal_status_needs_review")
        .when(F.col("legal_status") == "disabled", "legal_status_disabled")
        .when(~F.col("enabled"), "not_enabled")
        .when(~F.col("source_type").isin(types), "unsupported_source_type")
    )


def fetch_eligible(types: list[str] = RSS_TYPES) -> Column:
    return F.col("enabled") & (F.col("legal_status") == "allowed") & F.col("source_type").isin(types)


def eligibility(types: list[str] = RSS_TYPES) -> Column:
    reason = skip_reason(types)
    return (
        F.when(reason.isNull(), "eligible").when(reason == "legal_status_needs_review", "quarantined")
        .when(reason.isin("legal_status_disabled", "not_enabled"), "disabled").otherwise("unsupported")
    )


def gated(sources: DataFrame, types: list[str] = RSS_TYPES) -> DataFrame:
    """sources and skip_reason, fetch_eligible, eligibility."""
    return sources.withColumns({"skip_reason": skip_reason(types), "fetch_eligible": fetch_eligible(types), "eligibility": eligibility(types)})


def ingestible(sources: DataFrame) -> DataFrame:
    return sources.where(F.col("enabled") & (F.col("legal_status") == "allowed"))


def quarantined(sources: DataFrame) -> DataFrame:
    """Under review or disabled; an allowed source that isn't enabled is in neither set."""
    return sources.where(F.col("legal_status").isin("needs_review", "disabled"))


def visible_items(items: DataFrame, sources: DataFrame) -> DataFrame:
    return items.join(ingestible(sources).select("source_id"), "source_id", "left_semi")


def quarantine_items(items: DataFrame, sources: DataFrame) -> DataFrame:
    return items.join(quarantined(sources).select("source_id"), "source_id", "left_semi")


def has_evidence() -> Column:
    return (F.coalesce("url", F.lit("")) != "") | (F.coalesce("source_item_id", F.lit("")) != "")


def promotable_items(items: DataFrame, sources: DataFrame) -> DataFrame:
    return visible_items(items, sources).where(has_evidence() & F.col("verification_tier").isin(PROMOTABLE_TIERS))


def usable_tags(tags: Column) -> Column:
    return F.filter(tags, lambda t: t["provenance"].isin(USABLE_PROVENANCE))


def tag_exists(tags: Column, kind: str | list[str], value=None) -> Column:
    """Any usable tag of a kind whose value passes."""
    kinds = [kind] if isinstance(kind, str) else kind
    return F.exists(tags, lambda t: t["provenance"].isin(USABLE_PROVENANCE) & t["tag_type"].isin(kinds) & (value(t["tag_value"]) if value else F.lit(True)))


def is_newsy() -> Column:
    return (F.col("verification_tier") == "scheduled") | tag_exists(F.col("tags"), ["macro", "topic"])


def is_world(tags: Column) -> Column:
    return tag_exists(tags, "region") | tag_exists(tags, "topic", lambda v: v.rlike("(?i)geopolit|risk"))


def has_asset(tags: Column, asset: str) -> Column:
    return tag_exists(tags, "asset", lambda v: F.lower(v) == asset.lower())


#: World regions in the order in which an item takes the first that fits: key, title, tag words, region words (fixed values).
REGIONS = [
    ("us_fed_usd", "United States / Fed / USD", "fed|powell|usd|fomc", "us|united-states"),
    ("eu_ecb_eur", "Europe / ECB / EUR", "ecb|euro|eur", "eu|europe"),
    ("china_demand_macro", "China / demand / macro", "china|cn|demand", "china"),
    ("me_geopolitics_oil_gold", "Middle East / geopolitics / oil / gold", "middle-east|oil|gold|geopolit", "middle-east"),
    ("global_risk_vol_equities_bonds", "Global risk / volatility / equities / bonds", "risk|vix|spx|bond|equit", None),
]


def region_key() -> Column:
    tags = usable_tags(F.col("tags"))
    out = None
    named = lambda words: lambda t: F.lower(t["tag_value"]).rlike(words) | F.lower(t["tag_id"]).rlike(words)
    placed = lambda words: lambda t: (t["tag_type"] == "region") & F.lower(t["tag_value"]).rlike(words)
    for key, _, words, places in REGIONS:
        fits = F.exists(tags, named(words))
        if places:
            fits = fits | F.exists(tags, placed(places))
        out = F.when(fits, key) if out is None else out.when(fits, key)
    return out


#: Acquisition modes that need no network.
OFFLINE_MODES = ["recorded_fixture", "manual_recording_ready"]


def readiness_reason() -> Column:
    """Why a source profile isn't ready, null if it is; the first failing check in this order decides."""
    legal, tos = F.coalesce("legal_status", F.lit("")), F.coalesce("tos_status", F.lit(""))
    positive = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    return (
        F.when(F.col("enabled").isNull(), "source_not_enabled").when(~F.col("enabled"), "source_disabled")
        .when(legal.isin("needs_review", "blocked", "unknown"), F.concat(F.lit("source_legal_"), legal))
        .when(legal != "allowed", "source_missing_legal_status")
        .when(tos.isin("needs_review", "blocked", "unknown"), F.concat(F.lit("tos_"), tos))
        .when(tos != "allowed", "tos_missing")
        .when(F.coalesce(F.col("parser_support") != "supported", F.lit(True)), "parser_unsupported")
        .when(~F.coalesce(F.col("acquisition_mode").isin(OFFLINE_MODES), F.lit(False)), "acquisition_mode_not_offline_ready")
        .when(F.coalesce(F.size("allowed_content_types"), F.lit(0)) <= 0, "content_type_unsupported")
        .when(~positive("max_payload_bytes"), "max_payload_missing")
        .when(~positive("timeout_ms"), "timeout_missing")
    )
