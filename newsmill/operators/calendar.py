"""Economic calendar: revisions with supersession, confirmations and what may be promoted.

A revision depends on the revision before it, not on the observation before it, so the fold of an event's observations
is a state machine. Observations are dealt by (source_id, source_event_id) and sorted inside their partition; each task
walks its rows once and holds the current revision of one event, however many observations that has.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import PROXIMITY_MIN
from ..functions.times import confirmation_state, minutes_since, minutes_until

VALUES = ["previous", "forecast", "actual", "revised"]
METADATA = ["event_name", "country", "currency", "importance_tier", "event_category"]
OUT = (
    "source_id string, source_event_id string, seq long, action string, revision_number int, revision_status string, change_reason string,"
    "scheduled_for timestamp, previous_scheduled_for timestamp, supersedes int, observed_at timestamp, " + ", ".join(f"{c} string" for c in [*METADATA, *VALUES, "source_url"])
)


def decide(event: dict, prior: dict | None) -> tuple[str, str, str, object, object]:
    """(action, status, reason, scheduled for, previous time) of an observation after the current revision."""
    at, hint = event["scheduled_for"], event["status_hint"]
    if prior is None:
        return "create", "active" if hint == "scheduled" else hint, "first_seen", at, None
    before = prior["scheduled_for"]
    kept = before if at is None else at
    if hint == "cancelled" and prior["revision_status"] != "cancelled":
        return "create", "cancelled", "cancelled", kept, before
    if hint == "postponed":
        return "create", "postponed", "postponed", at, before
    if hint == "completed" or (event["actual"] is not None and event["actual"] != prior["actual"]):
        return "create", "completed", "actual_added", kept, before if at != before else None
    if at != before:
        return "create", "active", "time_changed", at, before
    for names, reason in ((VALUES, "forecast_changed"), (METADATA, "metadata_changed")):
        if any(event[c] != prior[c] for c in names):
            return "create", "active", reason, at, None
    return "confirm", prior["revision_status"], "unchanged_confirmation", before, None


#: A fold's input and what it adds; times are text of microseconds, which keeps nulls apart.
KEY, TIMES = ["source_id", "source_event_id"], ["scheduled_for", "observed_at"]
COLUMNS = [*KEY, "seq", "status_hint", *TIMES, *METADATA, *VALUES, "source_url"]
MADE = ["action", "revision_number", "revision_status", "change_reason", "previous_scheduled_for", "supersedes"]
FOLDED = ", ".join(f"{c} {'long' if c == 'seq' else 'string'}" for c in COLUMNS) + ", action string, revision_number int, revision_status string, change_reason string, previous_scheduled_for string, supersedes string"


def as_text(observations: DataFrame) -> DataFrame:
    """COLUMNS of observations."""
    return observations.select(*(F.unix_micros(c).cast("string").alias(c) if c in TIMES else F.col(c) for c in COLUMNS))


def from_text(folded: DataFrame) -> DataFrame:
    """OUT of folded rows."""
    as_time = lambda c: F.timestamp_micros(F.col(c).cast("long")).alias(c)
    named = [f.split()[0] for f in OUT.split(",")]
    return folded.select(*(as_time(c) if c in (*TIMES, "previous_scheduled_for") else F.col(c).cast("int").alias(c) if c == "supersedes" else F.col(c) for c in named))


def observed(row: dict, prior: dict | None, number: int) -> tuple[tuple, dict, int]:
    """The folded row (COLUMNS and MADE) of an observation after the current revision and its number; and what is
    current then."""
    row = dict(row)
    action, status, reason, at, before = decide(row, prior)
    row["scheduled_for"], row["revision_status"] = at, status
    replaced = str(number) if action == "create" and number else None
    if action == "create":
        prior, number = row, number + 1
    return (*(row[c] for c in COLUMNS), action, number, status, reason, before, replaced), prior, number


def revisions(observations: DataFrame) -> DataFrame:
    """OUT: a row for each observation, which either creates a revision or confirms the current one.

    observations: source_id, source_event_id, seq (order), observed_at, status_hint, scheduled_for and the columns of
    METADATA, VALUES, source_url.
    """

    def run(batches):
        event, prior, number = None, None, 0
        for batch in batches:
            out = []
            for values in zip(*(batch[c].tolist() for c in COLUMNS), strict=True):
                row = dict(zip(COLUMNS, values, strict=True))
                if (row["source_id"], row["source_event_id"]) != event:
                    event, prior, number = (row["source_id"], row["source_event_id"]), None, 0
                folded, prior, number = observed(row, prior, number)
                out.append(folded)
            yield pd.DataFrame(out, columns=[*COLUMNS, *MADE])

    return from_text(as_text(observations).repartition(*KEY).sortWithinPartitions(*KEY, "seq").mapInPandas(run, FOLDED))


def supersession_reason(change: Column) -> Column:
    """Reason of the supersession that a change makes."""
    return F.when(change.isin("cancelled", "postponed", "actual_added", "time_changed", "forecast_changed", "metadata_changed"), change).otherwise("revision_replaced")


def supersessions(folded: DataFrame) -> DataFrame:
    """(source_id, source_event_id, superseded, superseding, reason, observed_at)."""
    rows = folded.where("action = 'create' and supersedes is not null")
    return rows.select("source_id", "source_event_id", F.col("supersedes").alias("superseded"), F.col("revision_number").alias("superseding"), supersession_reason(F.col("change_reason")).alias("reason"), "observed_at")


def dangling(events: DataFrame, revisions_: DataFrame) -> DataFrame:
    """Supersessions either end of which has no revision."""
    known = revisions_.select("source_id", "source_event_id", "revision_number")
    key = ["source_id", "source_event_id"]
    lost = lambda end: events.join(known.withColumnRenamed("revision_number", end), [*key, end], "left_anti").select(*key, "superseded", "superseding")
    return lost("superseded").unionByName(lost("superseding")).distinct()


def applied(revisions_: DataFrame, events: DataFrame) -> DataFrame:
    """Revisions with superseded_by; an active one that is superseded has that status. Contradictions are an error."""
    by = events.groupBy("source_id", "source_event_id", F.col("superseded").alias("revision_number")).agg(F.min("superseding").alias("superseded_by"), F.countDistinct("superseding").alias("n"))
    by = by.withColumn("superseded_by", F.when(F.col("n") > 1, F.raise_error(F.lit("contradictory supersession events"))).otherwise(F.col("superseded_by"))).drop("n")
    out = revisions_.join(by, ["source_id", "source_event_id", "revision_number"], "left")
    gone = F.col("superseded_by").isNotNull() & (F.col("revision_status") == "active")
    return out.withColumn("revision_status", F.when(gone, "superseded").otherwise(F.col("revision_status")))


def current(applied_: DataFrame) -> DataFrame:
    return applied_.where("superseded_by is null")


def confirmed_at(revisions_: DataFrame, confirmations: DataFrame) -> DataFrame:
    """revisions and last_confirmed_at: the latest of their own observation and their confirmations."""
    key = ["source_id", "source_event_id", "revision_number"]
    last = confirmations.groupBy(*key).agg(F.max("observed_at").alias("confirmed"))
    return revisions_.join(last, key, "left").withColumn("last_confirmed_at", F.greatest("observed_at", "confirmed")).drop("confirmed")


def promotion(views: DataFrame, now: Column) -> DataFrame:
    """views (last_confirmed_at, importance_tier, scheduled_for, revision_status, source_url, source_event_id) and
    confirmation_state, confirmation_age, minutes_until, promotable, promotion_reason."""
    out = views.withColumns({
        "confirmation_state": confirmation_state(F.col("importance_tier"), F.col("last_confirmed_at"), now),
        "confirmation_age": minutes_since(F.col("last_confirmed_at"), now), "minutes_until": minutes_until(F.col("scheduled_for"), now),
    })
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    until, state = F.col("minutes_until"), F.col("confirmation_state")
    reason = (
        F.when(F.col("revision_status") != "active", F.concat(F.lit("status "), "revision_status", F.lit(" is never high-attention")))
        .when(until.isNull(), "no scheduledFor").when(until < 0, "scheduledFor is in the past")
        .when(blank("source_url") & blank("source_event_id"), "no evidence reference (sourceUrl or sourceEventId)")
        .when((until <= PROXIMITY_MIN) & (state != "fresh"), F.concat(F.lit("within 2h but confirmation is "), state))
        .when((until > PROXIMITY_MIN) & (state == "stale"), "confirmation is stale")
    )
    return out.withColumns({"promotable": reason.isNull(), "promotion_reason": F.coalesce(reason, F.lit("active + future + evidence + confirmation ok"))})


def upcoming(views: DataFrame) -> DataFrame:
    return views.where("revision_status = 'active' and scheduled_for is not null and minutes_until >= 0").orderBy("minutes_until", "source_id", "source_event_id")


def with_history(folded: DataFrame) -> DataFrame:
    """Each event's revisions as a sorted array."""
    rows = folded.where("action = 'create'")
    return rows.groupBy("source_id", "source_event_id").agg(F.array_sort(F.collect_list(F.struct("revision_number", "change_reason", "revision_status", "scheduled_for"))).alias("history"))
