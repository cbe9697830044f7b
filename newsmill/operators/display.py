"""What a page shows of a row: structs of labels, references and caveats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _map(c: Column, pairs: dict[str, str]) -> Column:
    out = None
    for k, v in pairs.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out


def evidence(url: Column, source_item_id: Column, item_id: Column) -> Column:
    """url first, then the source's id, then our own."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    pick = lambda a, b, c: F.when(some(url), a).when(some(source_item_id), b).otherwise(c)
    return F.struct(
        pick(F.lit("Evidence"), F.lit("Source ref"), F.lit("Internal ref")).alias("label"), pick(F.lit("url"), F.lit("sourceItemId"), F.lit("itemId")).alias("type"),
        pick(url, source_item_id, item_id).alias("value"), F.when(some(url), url).alias("href"), some(url).alias("external"),
    )


def calendar_evidence(url: Column, event_id: Column) -> Column:
    some = F.coalesce(url, F.lit("")) != ""
    return F.struct(F.when(some, "Evidence").otherwise("Source ref").alias("label"), F.when(some, "url").otherwise("calendarSourceEventId").alias("type"), F.when(some, url).otherwise(event_id).alias("value"), F.when(some, url).alias("href"), some.alias("external"))


def verification(tier: Column) -> Column:
    caution = _map(tier, {"verified": "none", "scheduled": "none", "reported": "low", "unverified": "medium", "rumor": "high"})
    return F.struct(tier.alias("tier"), caution.alias("caution"), tier.isin("verified", "reported", "scheduled").alias("may_promote"))


def freshness(state: Column) -> Column:
    return F.struct(state.alias("state"), _map(state, {"delayed": "source data is delayed", "stale": "source data may be stale", "disconnected": "source disconnected", "unknown": "freshness unknown"}).alias("caveat"))


def confirmation(state: Column, scheduled_for: Column, promotable: Column) -> Column:
    caveat = _map(state, {"aging": "confirmation aging", "stale": "stale — needs confirmation; not high-attention", "unknown": "confirmation unknown"})
    return F.struct(scheduled_for.alias("scheduled_for"), state.alias("state"), caveat.alias("caveat"), promotable.alias("may_promote"))


def cluster(cluster_id: Column, members: Column, sources: Column, rule: Column, status: Column) -> Column:
    """Null for fewer than two members."""
    shown = F.struct(cluster_id.alias("cluster_id"), members.alias("members"), sources.alias("sources"), rule.alias("rule"), F.lit("confirmed by exact deterministic match").alias("why"), F.when(status == "corrected", 1).otherwise(0).alias("corrections"), F.lit("/clusters").alias("href"))
    return F.when(members >= 2, shown)


def priority(tier: Column, urgency: Column, reason: Column, clustered: Column) -> Column:
    inputs = F.filter(F.transform(F.split(reason, ";"), lambda x: F.trim(x)), lambda x: x != "")
    return F.struct(tier.alias("tier"), urgency.alias("urgency"), reason.alias("reason"), inputs.alias("inputs"), (clustered & reason.rlike("(?i)confirmed cluster")).alias("uses_cluster"))


#: Label and address of each kind of audit target.
AUDIT = {"news_item": ("audit ↗", "/newsroom/"), "cluster": ("cluster detail ↗", "/clusters"), "calendar_event": ("calendar ↗", "/calendar"), "source": ("source ↗", "/sources"), "raw_payload": ("ingestion ↗", "/ingestion")}


def audit(kind: str, id_: Column | None = None) -> Column:
    label, href = AUDIT[kind]
    at = F.concat(F.lit(href), F.coalesce(id_, F.lit(""))) if kind == "news_item" and id_ is not None else F.lit(href)
    return F.struct(F.lit(label).alias("label"), at.alias("href"), F.lit(kind).alias("kind"))


def tag_badge(tag: Column) -> Column:
    return F.concat(tag["tag_type"], F.lit(":"), tag["tag_value"])


def items(annotated: DataFrame) -> DataFrame:
    """Annotated items and evidence, verification, freshness, priority, audit."""
    c = F.col
    return annotated.withColumns({
        "evidence": evidence(c("url"), c("source_item_id"), c("item_id")), "verification": verification(c("verification_tier")), "freshness": freshness(c("freshness_state")),
        "priority": priority(c("priority_tier"), c("urgency_label"), c("priority_reason"), c("cluster_size") > 1), "audit": audit("news_item", c("item_id")),
    })
