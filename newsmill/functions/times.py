"""Times: every function takes the instant it is asked for; none reads a clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import CONFIRM_HIGH, CONFIRM_MEDIUM, CONFIRM_OTHER


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def minutes_since(ts: Column, now: Column) -> Column:
    """Whole minutes, never negative; null stays null (endless age)."""
    return F.greatest(F.lit(0), F.floor((millis(now) - millis(ts)) / 60000)).cast("long")


def minutes_until(ts: Column, now: Column) -> Column:
    """Whole minutes, rounded down also below zero."""
    return F.floor((millis(ts) - millis(now)) / 60000).cast("long")


def age_label(ts: Column, now: Column) -> Column:
    m = minutes_since(ts, now)
    whole = lambda n, unit: F.concat(F.floor(n).cast("string"), F.lit(unit))
    return F.when(m.isNull(), "unknown").when(m < 1, "live").when(m < 60, whole(m, "m")).when(m < 1440, whole(m / 60, "h")).otherwise(whole(m / 1440, "d"))


def until_label(minutes: Column) -> Column:
    """Half of an hour or day rounds up."""
    near = lambda n, unit: F.concat(F.lit("in "), F.floor(n + 0.5).cast("long").cast("string"), F.lit(unit))
    return F.when(minutes.isNull(), "time unknown").when(minutes < 0, "started").when(minutes < 60, near(minutes, "m")).when(minutes < 1440, near(minutes / 60, "h")).otherwise(near(minutes / 1440, "d"))


def confirmation_label(state: Column, age: Column) -> Column:
    fresh = F.when(age.isNotNull(), F.concat(F.lit("confirmed "), age.cast("string"), F.lit("m ago"))).otherwise("confirmed")
    return F.when(state == "fresh", fresh).when(state == "aging", "confirmation aging").when(state == "stale", "needs confirmation (stale)").otherwise("confirmation unknown")


def scheduled_line(name: Column, minutes: Column, state: Column, age: Column) -> Column:
    return F.concat(name, F.lit(" "), until_label(minutes), F.lit(" · "), confirmation_label(state, age))


def display_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm 'UTC'")


def publication(raw: Column, now: Column) -> Column:
    """struct(state, at) of an RSS date: missing, invalid, future or valid; only valid ones keep their time."""
    text = F.trim(raw)
    bare = F.regexp_replace(text, r"^[A-Za-z]{3,9},\s*", "")
    zone = F.regexp_replace(bare, r"\b(?:UTC|UT|Z)$", "GMT")
    at = F.coalesce(*(F.try_to_timestamp(zone, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm z", "d MMM yyyy HH:mm Z")), F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(text)))
    state = F.when(raw.isNull() | (text == ""), "missing").when(at.isNull(), "invalid").when(at > now, "future").otherwise("valid")
    return F.struct(state.alias("state"), F.when(state == "valid", at).alias("at"))


def confirmation_window(importance: Column) -> Column:
    return F.when(importance == "high", CONFIRM_HIGH).when(importance == "medium", CONFIRM_MEDIUM).otherwise(CONFIRM_OTHER)


def confirmation_state(importance: Column, confirmed_at: Column, now: Column) -> Column:
    age, window = minutes_since(confirmed_at, now), confirmation_window(importance)
    return F.when(confirmed_at.isNull(), "unknown").when(age <= window, "fresh").when(age <= 2 * window, "aging").otherwise("stale")


def rounded_ms(value: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), value), 3)
