"""Confirmed clusters: an order-dependent engine, kept parallel by running it inside each connected component.

Items that match nothing never meet, so a component is closed under the engine's rules. Rules are equalities, so the
engine's state is a fold over keys (which cluster holds a key's items), and pairs of items are never made. Components
whose items all share the same keys (copies of one text, however many) need no fold: a join and a minimum tell their
outcome. The others are folded by one task each, with a row for each item.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CLUSTER_RULE
from .dedupe import RULES
from .lineage import cut

EVENTS = "cluster_id string, item_id string, event_type string, reason_type string, seq long"


def fold(items: list[tuple[str, list[str]]]) -> list[tuple[str, str, str, str]]:
    """Membership events of one component: (cluster, item, 'added', rule), in order of arrival.

    items: (id, keys), a key begins with its rule's digit. In order of ids, an item joins the first (by id) current
    cluster of the earlier items that share a key; if none is clustered, it and all those found a new one, named after
    the smallest id. Clusters never merge. A key without a cluster has had one item at most: a second one finds or
    founds a cluster.
    """
    first: dict[str, str] = {}
    low: dict[str, str] = {}
    alone: dict[str, list[str]] = {}
    out = []

    def add(cluster: str, item: str, keys: list[str], rule: str) -> None:
        for k in keys:
            low[k] = min(low.get(k, cluster), cluster)
        out.append((cluster, item, "added", rule))

    for item, keys in sorted((i, list(k)) for i, k in items):
        rules: dict[str, str] = {}
        for k in sorted(keys):
            if k in first:
                rules.setdefault(first[k], RULES[int(k[0])])
        if rules:
            held = min((low[k] for k in keys if k in low), default=None)
            cluster = held or "ccl-" + min(item, *rules)
            if held is None:
                for prior in sorted(rules):
                    add(cluster, prior, alone.pop(prior), rules[prior])
            add(cluster, item, keys, rules[min(rules)])
        else:
            alone[item] = keys
        for k in keys:
            first.setdefault(k, item)
    return out


def membership_events(keys: DataFrame, roots: DataFrame) -> DataFrame:
    """EVENTS of all components; keys: item_id, rule, key; roots: item_id, root (its component's smallest item).

    seq orders the events of a component; in components of one set of keys all have 0, and each item just one event.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = fold(list(pdf[["item_id", "keys"]].itertuples(index=False, name=None)))
        return pd.DataFrame([(*r, k) for k, r in enumerate(rows)], columns=["cluster_id", "item_id", "event_type", "reason_type", "seq"])

    shared = keys.groupBy("rule", "key").count().where("count > 1").select("rule", "key")
    named = F.concat(F.col("rule").cast("string"), F.lit(":"), "key").alias("k")
    rows = keys.join(shared, ["rule", "key"], "left_semi").select("item_id", named).join(roots, "item_id")
    rows = cut(rows.groupBy("root", "item_id").agg(F.array_sort(F.collect_set("k")).alias("keys")))
    kind = rows.groupBy("root").agg((F.min("keys") == F.max("keys")).alias("equal"), F.min("keys").alias("all"))
    rule = F.get(F.array(*map(F.lit, RULES)), F.substring(F.get("all", F.lit(0)), 1, 1).cast("int"))
    even = rows.join(kind.where("equal"), "root").select(F.concat(F.lit("ccl-"), "root").alias("cluster_id"), "item_id", F.lit("added").alias("event_type"), rule.alias("reason_type"), F.lit(0).cast("long").alias("seq"))
    return even.unionByName(rows.join(kind.where("not equal"), "root", "left_semi").groupBy("root").applyInPandas(run, EVENTS))


def corrected(events: DataFrame, removals: DataFrame, later: DataFrame | None = None) -> DataFrame:
    """events, then removals (cluster_id, item_id), then later additions (EVENTS): what is removed can't be added again."""
    last = events.groupBy("cluster_id").agg(F.max("seq").alias("last"))
    gone = removals.select("cluster_id", "item_id").distinct()
    out = events.unionByName(gone.join(last, "cluster_id", "left").select("cluster_id", "item_id", F.lit("removed_as_error").alias("event_type"), F.lit(None).cast("string").alias("reason_type"), (F.coalesce("last", F.lit(-1)) + 1).alias("seq")))
    if later is None:
        return out
    fresh = later.join(gone, ["cluster_id", "item_id"], "left_anti").join(active_members(out), ["cluster_id", "item_id"], "left_anti")
    return out.unionByName(fresh.join(last, "cluster_id", "left").withColumn("seq", F.col("seq") + F.coalesce("last", F.lit(-1)) + 2).drop("last"))


def active_members(events: DataFrame) -> DataFrame:
    """(cluster_id, item_id) whose latest event is an addition."""
    last = events.groupBy("cluster_id", "item_id").agg(F.max_by("event_type", "seq").alias("last"))
    return last.where(F.col("last") == "added").select("cluster_id", "item_id")


def membership_reason(events: DataFrame) -> DataFrame:
    return events.where("event_type = 'added'").groupBy("cluster_id", "item_id").agg(F.max_by("reason_type", "seq").alias("reason_type"))


def confirmed(events: DataFrame, items: DataFrame) -> DataFrame:
    """Clusters with members: sorted ids, count, first and last observation, title of the earliest, status."""
    member = active_members(events).join(items.select("item_id", "source_id", "title", "observed_at"), "item_id")
    key = F.struct("observed_at", "item_id")
    out = member.groupBy("cluster_id").agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.countDistinct("item_id").alias("member_count"), F.countDistinct("source_id").alias("source_count"),
        F.min("observed_at").alias("first_observed_at"), F.max("observed_at").alias("last_observed_at"), F.min_by("title", key).alias("title"),
    )
    status = events.groupBy("cluster_id").agg(F.when(F.bool_or(F.col("event_type") == "removed_as_error"), "corrected").otherwise("active").alias("status"))
    return out.join(status, "cluster_id").withColumn("rule_version", F.lit(CLUSTER_RULE))


def members_of(found: DataFrame) -> DataFrame:
    """Rows of priority.with_cluster_size()."""
    return found.select("cluster_id", F.explode("item_ids").alias("item_id"), "rule_version", F.lit(False).alias("archived"))


def unmerged(items: DataFrame, events: DataFrame) -> DataFrame:
    return items.join(active_members(events), "item_id", "left_anti")


def unmatched_removals(events: DataFrame, order: Column | None = None) -> DataFrame:
    """Removals without an earlier addition of the same item to the same cluster."""
    added = events.where("event_type = 'added'").groupBy("cluster_id", "item_id").agg(F.min("seq").alias("first_added"))
    gone = events.where("event_type = 'removed_as_error'").join(added, ["cluster_id", "item_id"], "left")
    return gone.where(F.col("first_added").isNull() | (F.col("first_added") >= F.col("seq"))).drop("first_added")
