"""Attention engine: eligibility, quiet windows, rate limits, repeats, interactions and the session view.

Against a given history every check is a join or an aggregation, and all candidates are judged in parallel. Only the
caps on whispers couple the decisions of one call: all candidates of a call share one instant, so after one whisper the
cooldown holds the rest. Hence at most the first candidate that would whisper does, and a window function finds it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as C
from ..functions.times import millis
from . import display

MINUTE = 60_000


def eligibility() -> Column:
    """All exclusions of a candidate, in order; empty if eligible.

    Candidate columns: candidate_type (item, cluster, calendar_event), promotable, legal_status, source_enabled,
    forbidden_wording, verification_tier, may_promote, evidence_type, evidence_value, priority_reason, freshness,
    audit_href, cluster_rule, member_count, confirmation_state, scheduled_for, revision_status.
    """
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    legal, on = F.col("legal_status"), F.col("source_enabled")
    tier, kind, status = F.col("verification_tier"), F.col("candidate_type"), F.col("revision_status")
    calendar, cluster = kind == "calendar_event", kind == "cluster"
    no_confirmation = F.col("confirmation_state").isNull()
    rules = [
        (~F.coalesce("promotable", F.lit(False)), "not_promotable"),
        (legal.isNull(), "missing_source_legal_status"),
        (legal.isNull(), "missing_source_proof"),
        (legal == "needs_review", "source_needs_review"),
        (legal == "disabled", "source_disabled"),
        (~legal.isin("needs_review", "disabled", "allowed"), "source_not_allowed"),
        (on.isNull(), "missing_source_enabled"),
        (on.isNull() & legal.isNotNull(), "missing_source_proof"),
        (~on, "source_disabled"),
        (F.col("forbidden_wording"), "forbidden_action_wording"),
        (tier == "rumor", "rumor_high_attention"),
        (tier == "unverified", "unverified_high_attention"),
        (~tier.isin("rumor", "unverified") & ~F.col("may_promote"), "verification_not_promotable"),
        (F.coalesce("evidence_type", F.lit("none")).isin("none") | blank("evidence_value"), "missing_evidence"),
        (blank("priority_reason"), "missing_priority_reason"),
        (F.col("freshness").isNull(), "missing_freshness"),
        (blank("audit_href"), "missing_audit_link"),
        (cluster & (blank("cluster_rule") | (F.coalesce("member_count", F.lit(0)) < C.CLUSTER_GLOW)), "unconfirmed_cluster"),
        (calendar & no_confirmation, "missing_calendar_confirmation"),
        (calendar & ~no_confirmation & F.col("scheduled_for").isNull(), "missing_scheduled_for"),
        (calendar & status.isin("cancelled", "postponed", "completed"), F.concat(status, F.lit("_not_upcoming"))),
    ]
    return F.array_compact(F.array(*(F.when(when, name) for when, name in rules)))


def natural_level(now: Column) -> Column:
    """glow or whisper, before any limit. Minutes are fractional here."""
    minutes = (millis(F.col("scheduled_for")) - millis(now)) / MINUTE
    window = F.when(F.col("importance_tier") == "high", C.CALENDAR_WINDOW_HIGH).when(F.col("importance_tier") == "medium", C.CALENDAR_WINDOW_MEDIUM).otherwise(0)
    soon = F.col("confirmation_state").isin("fresh", "aging") & (minutes >= 0) & (window > 0) & (minutes <= window)
    up = F.when(F.col("candidate_type") == "cluster", F.coalesce("member_count", F.lit(0)) >= C.CLUSTER_WHISPER).when(F.col("candidate_type") == "calendar_event", soon).otherwise(F.col("priority_tier").isin("P0", "P1"))
    return F.when(F.coalesce(up, F.lit(False)), "whisper").otherwise("glow")


def signature() -> Column:
    date = F.date_format("scheduled_for", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.concat_ws("|", F.coalesce(date, F.lit("null")), F.coalesce("confirmation_state", F.lit("none")), F.coalesce("revision_status", F.lit("none")))


def targets() -> Column:
    """What a candidate can be dismissed by: itself, its cluster, event or source, or everything."""
    pair = lambda kind, c: F.struct(F.lit(kind).alias("target_type"), c.alias("target_id"))
    named = F.array(*(pair(k, F.col(c)) for k, c in (("item", "item_id"), ("cluster", "cluster_id"), ("calendar_event", "calendar_event_id"), ("source", "source_id"))))
    return F.concat(F.filter(named, lambda t: t["target_id"].isNotNull()), F.array(pair("global", F.lit("*"))))


def quiet(candidates: DataFrame, dismissals: DataFrame, now: Column) -> DataFrame:
    """(candidate_id, quiet_targets) of candidates under a dismissal that ends after now; an equi-join by target."""
    active = dismissals.where(F.col("quiet_until") > now).select("target_type", F.when(F.col("target_type") == "global", "*").otherwise(F.col("target_id")).alias("target_id"))
    keys = candidates.select("candidate_id", F.inline(targets()))
    return keys.join(active, ["target_type", "target_id"]).groupBy("candidate_id").agg(F.array_sort(F.collect_list(F.concat_ws(":", "target_type", "target_id"))).alias("quiet_targets"))


def _within(minutes: int, now: Column) -> Column:
    return F.count_if(millis(now) - millis(F.col("created_at")) < minutes * MINUTE)


def rate_state(candidates: DataFrame, whispers: DataFrame, now: Column) -> DataFrame:
    """candidates and last_15m, last_60m, source_60m, cluster_120m, cooldown: counts over earlier whispers."""
    everywhere = whispers.agg(_within(15, now).alias("last_15m"), _within(60, now).alias("last_60m"), F.max("created_at").alias("last_whisper_at"))
    by_source = whispers.where("source_id is not null").groupBy("source_id").agg(_within(60, now).alias("source_60m"))
    by_cluster = whispers.where("cluster_id is not null").groupBy("cluster_id").agg(_within(120, now).alias("cluster_120m"))
    out = candidates.withColumn("_one", F.lit(1)).join(F.broadcast(everywhere.withColumn("_one", F.lit(1))), "_one").drop("_one")
    out = out.join(by_source, "source_id", "left").join(by_cluster, "cluster_id", "left").fillna(0, ["source_60m", "cluster_120m"])
    cold = F.coalesce(millis(now) - millis(F.col("last_whisper_at")) < C.COOLDOWN_MIN * MINUTE, F.lit(False))
    return out.withColumn("cooldown", cold)


def rate_reason() -> Column:
    return (
        F.when(F.col("cooldown"), "cooldown_active").when(F.col("last_15m") >= C.WHISPERS_PER_15_MIN, "rate_limit_global_15m")
        .when(F.col("last_60m") >= C.WHISPERS_PER_HOUR, "rate_limit_global_60m").when(F.col("source_60m") >= C.WHISPERS_PER_SOURCE_HOUR, "rate_limit_per_source_60m")
        .when(F.col("cluster_120m") >= C.WHISPERS_PER_CLUSTER_2H, "rate_limit_per_cluster_120m")
    )


def repeats(candidates: DataFrame, whispers: DataFrame) -> DataFrame:
    """(candidate_id, repeat_reason) of candidates that say nothing new."""
    subject = F.when(F.col("candidate_type") == "item", F.col("item_id")).when(F.col("candidate_type") == "cluster", F.col("cluster_id")).otherwise(F.col("calendar_event_id"))
    now = candidates.select("candidate_id", "candidate_type", subject.alias("subject"), "priority_reason", F.coalesce("member_count", F.lit(0)).alias("members"), signature().alias("signature"))
    subjects = F.array(*(F.struct(F.lit(k).alias("candidate_type"), F.col(c).alias("subject")) for k, c in (("item", "item_id"), ("cluster", "cluster_id"), ("calendar_event", "calendar_event_id"))))
    past = whispers.select(F.inline(subjects), F.col("priority_reason").alias("was"), F.coalesce("member_count", F.lit(0)).alias("had"), F.col("calendar_signature").alias("signed")).where("subject is not null")
    met = now.join(past, ["candidate_type", "subject"]).groupBy("candidate_id", "candidate_type", "members").agg(
        F.bool_or(F.col("was").eqNullSafe(F.col("priority_reason"))).alias("same"), F.max("had").alias("most"), F.bool_or(F.coalesce(F.col("signed") == F.col("signature"), F.lit(False))).alias("signed")
    )
    reason = (
        F.when((F.col("candidate_type") == "item") & F.col("same"), "repeat_item_no_reason_change")
        .when((F.col("candidate_type") == "cluster") & F.col("same") & (F.col("members") <= F.col("most")), "repeat_cluster_no_growth_or_reason_change")
        .when((F.col("candidate_type") == "calendar_event") & F.col("signed"), "repeat_calendar_no_change")
    )
    return met.select("candidate_id", reason.alias("repeat_reason")).where("repeat_reason is not null")


def _candidate(**columns: Column) -> list[Column]:
    """All candidate columns; those that aren't given are null."""
    kinds = {"member_count": "int", "scheduled_for": "timestamp", "source_enabled": "boolean", "ordinal": "long"}
    names = ["candidate_id", "ordinal", "candidate_type", "item_id", "cluster_id", "calendar_event_id", "source_id", "promotable", "legal_status", "source_enabled", "forbidden_wording", "verification_tier", "may_promote", "evidence_type", "evidence_value", "priority_reason", "priority_tier", "freshness", "audit_href", "cluster_rule", "member_count", "confirmation_state", "scheduled_for", "revision_status", "importance_tier"]
    fixed = {"promotable": F.lit(True), "forbidden_wording": F.lit(False)}
    return [(columns.get(n, fixed.get(n, F.lit(None).cast(kinds.get(n, "string"))))).alias(n) for n in names]


def item_candidates(annotated: DataFrame, order: list[Column]) -> DataFrame:
    """Candidates of annotated, promotable items; items of one confirmed cluster give one, of the first in order."""
    shown = display.items(annotated)
    clustered = F.col("cluster_id").isNotNull() & (F.col("cluster_size") >= C.CLUSTER_GLOW)
    ident = F.when(clustered, F.concat(F.lit("cand-cluster-"), "cluster_id")).otherwise(F.concat(F.lit("cand-item-"), "item_id"))
    rows = shown.withColumns({"_id": ident, "_order": F.struct(*(c.alias(f"o{k}") for k, c in enumerate(order)))})
    first = rows.groupBy("_id").agg(F.min("_order").alias("_order"))
    rows = rows.join(first, ["_id", "_order"])
    c = F.col
    return rows.select("_order", *_candidate(
        candidate_id=c("_id"), candidate_type=F.when(clustered, "cluster").otherwise("item"), item_id=F.when(~clustered, c("item_id")), cluster_id=F.when(clustered, c("cluster_id")), source_id=c("source_id"), legal_status=c("legal_status"),
        source_enabled=c("enabled"), verification_tier=c("verification_tier"), may_promote=c("verification.may_promote"), evidence_type=c("evidence.type"), evidence_value=c("evidence.value"), priority_reason=c("priority_reason"),
        priority_tier=c("priority_tier"), freshness=c("freshness_state"), audit_href=c("audit.href"), cluster_rule=F.when(clustered, F.lit(C.CLUSTER_RULE)), member_count=F.when(clustered, c("cluster_size")).cast("int"),
    ))


def calendar_candidates(views: DataFrame, legal_status: str, enabled: bool) -> DataFrame:
    """Candidates of calendar views (source_id, source_event_id, source_url, importance_tier, scheduled_for,
    revision_status, confirmation_state); legal_status and enabled prove their source."""
    ident = F.concat_ws("::", "source_id", "source_event_id")
    shown = display.calendar_evidence(F.col("source_url"), F.col("source_event_id"))
    return views.select(F.struct(ident.alias("o0")).alias("_order"), *_candidate(
        candidate_id=F.concat(F.lit("cand-cal-"), ident), candidate_type=F.lit("calendar_event"), calendar_event_id=ident, source_id=F.col("source_id"), legal_status=F.lit(legal_status), source_enabled=F.lit(enabled),
        verification_tier=F.lit("scheduled"), may_promote=F.lit(True), evidence_type=shown["type"], evidence_value=shown["value"], priority_reason=F.concat(F.lit("scheduled "), "importance_tier", F.lit("-importance event")), priority_tier=F.lit("P2"),
        freshness=F.lit("live"), audit_href=F.lit(display.AUDIT["calendar_event"][1]), confirmation_state=F.col("confirmation_state"), scheduled_for=F.col("scheduled_for"), revision_status=F.col("revision_status"), importance_tier=F.col("importance_tier"),
    ))


def message() -> Column:
    """What a decision says to the reader."""
    told = F.when(F.col("candidate_type") == "cluster", "Confirmed cluster updated").when(F.col("candidate_type") == "calendar_event", "Scheduled event approaching").otherwise("Source-backed item to review")
    name = F.when(F.col("decision") == "hold", "Held (").otherwise("Suppressed (")
    return F.when(F.col("decision").isin("glow", "whisper"), told).otherwise(F.concat(name, "reason_code", F.lit(")")))


def decision_views(decided: DataFrame) -> DataFrame:
    """Decisions as the session shows them: target_type, target_id, level, message beside the candidate's columns."""
    own = F.coalesce(F.when(F.col("candidate_type") == "cluster", F.col("cluster_id")).when(F.col("candidate_type") == "calendar_event", F.col("calendar_event_id")).otherwise(F.col("item_id")), F.col("candidate_id"))
    return decided.withColumns({"target_type": F.col("candidate_type"), "target_id": own, "level": F.col("decision"), "message": message()})


def decide(candidates: DataFrame, whispers: DataFrame, dismissals: DataFrame, now: Column) -> DataFrame:
    """candidates (ordinal: their order) and decision (suppress, hold, glow, whisper), reason_code, reason.

    The first candidate that may whisper does; the following ones of the same instant hold for its cooldown.
    """
    rows = candidates.join(quiet(candidates, dismissals, now), "candidate_id", "left").join(repeats(candidates, whispers), "candidate_id", "left")
    rows = rate_state(rows, whispers, now).withColumns({"exclusions": eligibility(), "level": natural_level(now), "limit": rate_reason()})
    stale = (F.col("candidate_type") == "calendar_event") & (F.col("confirmation_state") == "stale")
    rows = rows.withColumn("blocked", F.when(F.size("exclusions") > 0, F.concat(F.lit("ineligible["), F.array_join("exclusions", ","), F.lit("]"))).when(stale, "stale_calendar_confirmation").when(F.col("quiet_targets").isNotNull(), "dismissal_quiet_window").otherwise(F.col("repeat_reason")))
    may = F.col("blocked").isNull() & (F.col("level") == "whisper") & F.col("limit").isNull()
    first = rows.where(may).agg(F.min("ordinal").alias("first")).withColumn("_one", F.lit(1))
    rows = rows.withColumn("_one", F.lit(1)).join(F.broadcast(first), "_one").drop("_one")
    limit = F.coalesce(F.when(F.col("ordinal") > F.col("first"), "cooldown_active"), F.col("limit"))
    limited = (F.col("level") == "whisper") & limit.isNotNull()
    decision = F.when(F.size("exclusions") > 0, "suppress").when(F.col("blocked").isNotNull() | limited, "hold").otherwise(F.col("level"))
    code = F.coalesce(F.col("blocked"), F.when(limited, limit), F.concat("level", F.lit("_threshold_met")))
    out = rows.withColumns({"decision": decision, "reason_code": code}).drop("first", "blocked", "limit")
    return out.withColumn("reason", F.concat("decision", F.lit(": "), "reason_code", F.lit(f" ({C.WHISPER_RULE})")))


def sliding_counts(events: DataFrame) -> DataFrame:
    """Per event: others within the 15 and 60 minutes up to it, of its type and of its user; equal times count each other.

    Time is cut into hours, and an event also counts in the next one. So a type's or user's events are spread over as
    many groups as they span hours.
    """
    hour = 60 * 60_000_000
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    slot = F.floor(F.col("_at") / hour)
    rows = events.withColumn("_at", at)
    rows = rows.withColumn("_in", F.explode(F.array(F.struct(slot.alias("slot"), F.lit(True).alias("own")), F.struct((slot + 1).alias("slot"), F.lit(False).alias("own")))))
    span = lambda key, minutes: Window.partitionBy(key, "_in.slot").orderBy("_at").rangeBetween(-(minutes * 60_000_000 - 1), 0)
    return rows.withColumns({
        "type_15m": F.count("*").over(span("event_type", 15)) - 1, "type_60m": F.count("*").over(span("event_type", 60)) - 1,
        "user_60m": F.count("*").over(span("user_id", 60)) - 1,
    }).where("_in.own").drop("_at", "_in")


def cooldowns(events: DataFrame, keys: list[str]) -> DataFrame:
    """Per event: milliseconds since the one before under the same keys, and whether that is within the cooldown."""
    order = Window.partitionBy(*keys).orderBy("ts", "event_id")
    since = F.unix_millis(F.col("ts").cast("timestamp")) - F.unix_millis(F.lag("ts").over(order).cast("timestamp"))
    return events.withColumn("ms_since", since).withColumn("cooldown", F.coalesce(since < C.COOLDOWN_MIN * MINUTE, F.lit(False)))


INTERACTIONS = ["dismiss", "mark_seen", "open_audit", "open_evidence"]
TARGETS = ["item", "cluster", "calendar_event", "decision"]
DISMISSABLE = ["item", "cluster", "calendar_event"]


def record_interactions(intents: DataFrame) -> DataFrame:
    """intents (seq, intent_id, interaction_type, target_type, target_id, at) and status, result, quiet_until.

    A dismissal counts if none of its target is in force. Those of one target are a chain in time: an accepted one
    silences its followers for the quiet window. Each task walks its targets' sorted times once and holds one instant.
    """
    bad = F.coalesce(F.trim("intent_id"), F.lit("")) == ""
    reject = (
        F.when(bad | ~F.coalesce(F.col("interaction_type").isin(INTERACTIONS), F.lit(False)) | ~F.coalesce(F.col("target_type").isin(TARGETS), F.lit(False)), "malformed_intent")
        .when(F.coalesce(F.trim("target_id"), F.lit("")) == "", "missing_target")
        .when((F.col("interaction_type") == "dismiss") & ~F.col("target_type").isin(DISMISSABLE), "undismissable_target")
    )
    rows = intents.withColumn("reject", reject)
    valid = rows.where("reject is null and interaction_type = 'dismiss'").select("target_type", "target_id", millis(F.col("at")).alias("ms"), F.col("seq").cast("long").alias("seq"))
    length = C.QUIET_MIN * MINUTE

    def chain(batches):
        target, until = None, 0
        for batch in batches:
            taken = []
            for kind, name, ms, seq in batch.itertuples(index=False, name=None):
                if (kind, name) != target or ms >= until:
                    target, until = (kind, name), ms + length
                    taken.append(seq)
            yield pd.DataFrame({"seq": pd.Series(taken, dtype="int64")})

    ordered = valid.repartition("target_type", "target_id").sortWithinPartitions("target_type", "target_id", "ms", "seq")
    taken = ordered.mapInPandas(chain, "seq long").withColumn("taken", F.lit(True))
    rows = rows.join(taken, "seq", "left")
    dismiss = F.col("interaction_type") == "dismiss"
    status = F.when(F.col("reject").isNotNull(), "rejected").when(dismiss & F.col("taken").isNull(), "ignored").otherwise("recorded")
    result = F.coalesce(F.col("reject"), F.when(dismiss, F.when(F.col("taken").isNull(), "already_dismissed_in_quiet_window").otherwise("dismissal_recorded")), F.concat("interaction_type", F.lit("_recorded")))
    until = F.when(F.col("taken"), F.timestamp_millis(millis(F.col("at")) + length))
    return rows.withColumns({"status": status, "result": result, "quiet_until": until}).drop("reject", "taken")


def session_view(views: DataFrame, dismissals: DataFrame, interactions: DataFrame, now: Column) -> DataFrame:
    """views (decision_id, target_type, target_id, level) and placement, projection_reason, quiet_until, record_id.

    Matches are the first in log order (seq): by target or by decision, and everything for global dismissals. Each table
    is reduced to a row for its key, and global dismissals to one row, before any join.
    """
    key = ["target_type", "target_id"]
    on = F.col("quiet_until") > now
    earliest = F.min(F.when(on, F.struct("seq", "quiet_until", "dismissal_id")))
    everywhere = dismissals.where("target_type = 'global'").agg(earliest.alias("_all"), F.bool_or(~on).alias("_all_expired"))
    of_target = dismissals.where("target_type <> 'global'").groupBy(*key).agg(earliest.alias("_held"), F.bool_or(~on).alias("_expired"))
    first = lambda kinds: F.min(F.when(F.col("interaction_type").isin(kinds), F.struct("seq", "record_id")))
    acts = lambda by, name: interactions.groupBy(*by).agg(first(["mark_seen"]).alias(f"_seen_{name}"), first(["open_audit", "open_evidence"]).alias(f"_open_{name}"))
    rows = views.join(of_target, key, "left").join(acts(["decision_id"], "d"), "decision_id", "left").join(acts(key, "t"), key, "left")
    rows = rows.withColumn("_one", F.lit(1)).join(F.broadcast(everywhere.withColumn("_one", F.lit(1))), "_one").drop("_one")
    sooner = lambda a, b: F.least(F.coalesce(a, b), F.coalesce(b, a))
    rows = rows.withColumns({
        "held": sooner(F.col("_held"), F.col("_all")), "expired": F.coalesce("_expired", F.lit(False)) | F.coalesce("_all_expired", F.lit(False)),
        "seen": sooner(F.col("_seen_d"), F.col("_seen_t"))["record_id"], "opened": sooner(F.col("_open_d"), F.col("_open_t"))["record_id"],
    })
    suppressed = F.col("level") == "suppress"
    held = ~suppressed & F.col("held").isNotNull()
    expired = F.coalesce("expired", F.lit(False))
    reason = (
        F.when(suppressed, "suppressed_inspection_only").when(held, "dismissed_quiet_window").when(expired, "expired_quiet_window")
        .when(F.col("seen").isNotNull(), "seen_no_suppression").when(F.col("opened").isNotNull(), "open_audit_no_suppression").otherwise("active")
    )
    source = F.when(held, F.col("held.dismissal_id")).when(suppressed | expired, F.lit(None)).otherwise(F.coalesce("seen", "opened"))
    placement = F.when(suppressed, "inspection").when(held, "held").otherwise("active")
    return rows.select(*views.columns, placement.alias("placement"), reason.alias("projection_reason"), F.when(held, F.col("held.quiet_until")).alias("quiet_until"), source.alias("record_id"))
