"""Priority of items: a score from fixed inputs, its tier, urgency and the reasons, in one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CLUSTER_RULE, MACRO_KEYWORDS
from ..functions.times import minutes_since
from .gates import tag_exists, usable_tags  # noqa: F401

TIERS = ["P0", "P1", "P2", "P3", "muted"]


def tier_score(tier: Column) -> Column:
    return F.when(tier == "primary", 3).when(tier == "reputable", 2).when(tier == "curated", 1).otherwise(0)


def verification_score(tier: Column) -> Column:
    return F.when(tier == "verified", 3).when(tier == "scheduled", 2).when(tier == "reported", 1).when(tier == "rumor", -1).otherwise(0)


def is_macro(tags: Column) -> Column:
    return tag_exists(tags, "macro", lambda v: F.lower(v).rlike("|".join(MACRO_KEYWORDS)))


def _signed(n: Column) -> Column:
    return F.concat(F.when(n >= 0, "+").otherwise(""), n.cast("string"))


def _text(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def rank(tier: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, TIERS)), tier) - 1


def prioritised(items: DataFrame, now: Column) -> DataFrame:
    """items joined to their sources (source_tier, legal_status, enabled, source_name; cluster_size) and
    priority_score, priority_tier, urgency_label, priority_reason."""
    review = F.col("legal_status") == "needs_review"
    unproven = F.col("freshness_state").isin("stale", "disconnected")
    rows = items.withColumns({
        "_tier": tier_score(F.col("source_tier")), "_ver": verification_score(F.col("verification_tier")), "_macro": is_macro(F.col("tags")),
        "_size": F.coalesce("cluster_size", F.lit(1)), "_age": minutes_since(F.col("observed_at"), now),
    })
    rows = rows.withColumns({
        "_grown": F.when(F.col("_size") >= 4, 2).when(F.col("_size") >= 2, 1).otherwise(0),
        "_recent": F.when(F.col("_age") <= 15, 2).when(F.col("_age") <= 60, 1).when((F.col("_age") >= 720) | F.col("_age").isNull(), -1).otherwise(0),
    })
    total = F.col("_tier") + F.col("_ver") + F.col("_macro").cast("int") * 2 + F.col("_grown") + F.col("_recent")
    rows = rows.withColumn("priority_score", F.when(review, F.least(total, F.lit(1))).otherwise(total) - unproven.cast("int"))
    score, verified = F.col("priority_score"), F.col("verification_tier")
    rows = rows.withColumn("_raw", F.when(score >= 7, "P0").when(score >= 5, "P1").when(score >= 3, "P2").when(score >= 1, "P3").otherwise("muted"))
    # a cap never lifts a tier
    floor = F.when(verified == "rumor", "P3").when(verified == "unverified", "P2").otherwise("P0")
    rows = rows.withColumn("_tiered", F.when(rank(F.col("_raw")) < rank(floor), floor).otherwise(F.col("_raw")))
    tier = F.col("_tiered")
    rows = rows.withColumn("_u0", F.when(verified == "scheduled", "soon").when(tier == "P0", "now").when(tier == "P1", "soon").when(tier == "P2", "today").when(tier == "P3", "background").otherwise("muted"))
    quiet = lambda u: F.when(u == "muted", "muted").otherwise("background")
    rows = rows.withColumn("_u1", F.when(verified == "rumor", quiet(F.col("_u0"))).when((verified == "unverified") & (F.col("_u0") == "now"), "soon").otherwise(F.col("_u0")))
    rows = rows.withColumn("_u2", F.when(review, quiet(F.col("_u1"))).otherwise(F.col("_u1")))
    reasons = F.concat_ws(
        "; ",
        _text("source tier ", F.col("source_tier"), " (+", F.col("_tier").cast("string"), ")"),
        _text("verification ", verified, " (", _signed(F.col("_ver")), ")"),
        F.when(F.col("_macro"), "scheduled macro keyword match (+2)"),
        F.when(F.col("_grown") > 0, _text("confirmed cluster size ", F.col("_size").cast("string"), " (+", F.col("_grown").cast("string"), ")")),
        F.when(F.col("_recent") != 0, _text("recency ", F.coalesce(F.col("_age").cast("string"), F.lit("Infinity")), "m (", _signed(F.col("_recent")), ")")),
        F.when(review, "source needs_review — capped at P3"),
        F.when(unproven, _text("freshness ", F.col("freshness_state"), " (-1)")),
        F.when(F.col("_raw") != tier, _text(verified, " verification cap → ", tier)),
        F.when(F.col("_u0") != F.col("_u1"), _text(verified, " urgency cap → ", F.col("_u1"))),
        F.when(F.col("_u1") != F.col("_u2"), _text("needs_review urgency cap → ", F.col("_u2"))),
    )
    off = (F.col("legal_status") == "disabled") | ~F.col("enabled")
    out = rows.withColumns({
        "priority_tier": F.when(off, "muted").otherwise(tier), "urgency_label": F.when(off, "muted").otherwise(F.col("_u2")),
        "priority_reason": F.when(off, _text("Source ", F.col("source_name"), " is disabled — item suppressed from priority surfaces.")).otherwise(reasons),
    })
    return out.drop("_tier", "_ver", "_macro", "_size", "_age", "_grown", "_recent", "_raw", "_tiered", "_u0", "_u1", "_u2")


def with_cluster_size(items: DataFrame, members: DataFrame) -> DataFrame:
    """items and cluster_id, cluster_size of the first confirmed cluster (by id) that holds each; size 1 without one.

    members: cluster_id, item_id, rule_version, archived, of current members only.
    """
    current = members.where((F.col("rule_version") == CLUSTER_RULE) & ~F.col("archived"))
    sizes = current.groupBy("cluster_id").agg(F.count("*").alias("cluster_size"))
    of_item = current.groupBy("item_id").agg(F.min("cluster_id").alias("cluster_id")).join(sizes, "cluster_id")
    return items.drop("cluster_id", "cluster_size").join(of_item, "item_id", "left").withColumn("cluster_size", F.coalesce("cluster_size", F.lit(1)))


def annotated(items: DataFrame, sources: DataFrame, members: DataFrame, now: Column) -> DataFrame:
    """Visible items with source, confirmed cluster and priority."""
    known = sources.select("source_id", "source_name", "source_tier", "legal_status", "enabled")
    visible = items.join(known.where(F.col("enabled") & (F.col("legal_status") == "allowed")), "source_id")
    rows = prioritised(with_cluster_size(visible, members), now)
    note = F.when(F.col("cluster_id").isNotNull(), _text("; confirmed cluster ", F.col("cluster_id"), " size ", F.col("cluster_size").cast("string"), " (", F.lit(CLUSTER_RULE), ")")).otherwise("")
    return rows.withColumn("priority_reason", F.concat("priority_reason", note))


def cluster_priority(clusters: DataFrame, items: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """Best tier over each cluster's present members, urgency from the tier alone; muted without members."""
    known = sources.select("source_id", "source_name", "source_tier", "legal_status", "enabled")
    member = clusters.select("cluster_id", F.explode(F.array_distinct("item_ids")).alias("item_id"))
    rows = member.join(items.drop("cluster_id", "cluster_size"), "item_id")
    sizes = rows.groupBy("cluster_id").agg(F.count("*").alias("cluster_size"))
    rows = prioritised(rows.join(sizes, "cluster_id").join(known, "source_id"), now)
    best = rows.groupBy("cluster_id").agg(F.min(rank(F.col("priority_tier"))).alias("best"), F.count("*").alias("members"))
    names = F.array(*map(F.lit, TIERS))
    urgency = F.array(*map(F.lit, ["now", "soon", "today", "background", "muted"]))
    out = clusters.select("cluster_id").join(best, "cluster_id", "left").withColumn("best", F.coalesce("best", F.lit(4)).cast("int"))
    return out.select("cluster_id", F.get(names, F.col("best")).alias("priority_tier"), F.get(urgency, F.col("best")).alias("urgency_label"), F.coalesce("members", F.lit(0)).cast("long").alias("members"))


def stream_order(items: DataFrame) -> DataFrame:
    """Rank first, then newest; item_id settles ties."""
    return items.orderBy(rank(F.col("priority_tier")), F.desc("observed_at"), "item_id")
