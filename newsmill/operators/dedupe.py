"""Exact-identity matches between items, connected components of them, and clusters.

Rules are equalities, so pairs come from one equi-join per rule and never from a cross join. For components even those
aren't needed: the items of a rule's key form a star around the smallest, a row for each item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import TITLE_WINDOW_MS
from ..functions.text import normalize_title
from ..functions.times import millis
from ..functions.urls import canonical_url
from .gates import usable_tags
from .lineage import cut

#: Rules in order of precedence.
RULES = ["source_item_id_exact", "canonical_url_exact", "dedupe_hash_exact", "normalized_title_exact_strict"]


def identities(items: DataFrame) -> DataFrame:
    """What items are compared by. asset_tags and topic_tags (topic and macro) are sorted, distinct and usable."""
    values = lambda kinds: F.array_sort(F.array_distinct(F.transform(F.filter(usable_tags(F.col("tags")), lambda t: t["tag_type"].isin(kinds)), lambda t: t["tag_value"])))
    return items.select(
        "item_id", "source_id", "source_item_id", canonical_url(F.col("url")).alias("canonical_url"), normalize_title(F.col("title")).alias("normalized_title"),
        "dedupe_hash", values(["asset"]).alias("asset_tags"), values(["topic", "macro"]).alias("topic_tags"), "observed_at", "source_event_time",
    )


def keys(ids: DataFrame) -> DataFrame:
    """(item_id, rule, key): one row for each rule that can match an item."""
    present = lambda c: F.when(c != "", c)
    rules = F.array(
        F.struct(F.lit(0).alias("rule"), F.when(present(F.col("source_item_id")).isNotNull(), F.concat_ws("\x1f", "source_id", "source_item_id")).alias("key")),
        F.struct(F.lit(1).alias("rule"), present(F.col("canonical_url")).alias("key")),
        F.struct(F.lit(2).alias("rule"), present(F.col("dedupe_hash")).alias("key")),
    )
    return ids.select("item_id", F.inline(rules)).where("key is not null")


def _title_pairs(ids: DataFrame) -> DataFrame:
    """Equal titles and tags (any) whose times are at most six hours apart; slots of the window make it an equi-join."""
    at = millis(F.coalesce("source_event_time", "observed_at"))
    rows = ids.where(F.col("normalized_title").isNotNull() & (F.size("asset_tags") + F.size("topic_tags") > 0)).withColumn("at", at)
    key = F.to_json(F.struct("normalized_title", "asset_tags", "topic_tags"))
    rows = rows.select("item_id", "at", key.alias("key"), F.floor(F.col("at") / TITLE_WINDOW_MS).alias("slot"))
    near = rows.select(F.col("item_id").alias("b"), F.col("at").alias("at_b"), "key", F.explode(F.array(F.col("slot") - 1, F.col("slot"), F.col("slot") + 1)).alias("slot"))
    pairs = rows.withColumnRenamed("item_id", "a").join(near, ["key", "slot"])
    return pairs.where((F.col("a") < F.col("b")) & (F.abs(F.col("at") - F.col("at_b")) <= TITLE_WINDOW_MS)).select("a", "b", F.lit(3).alias("rule"))


def matches(ids: DataFrame, strict_title: bool = False) -> DataFrame:
    """Every matching pair a < b with the rule that decides: the first in order of precedence.

    The square of a key's items: for datasets, whose size is bounded. links() says the same of tables of any size.
    """
    k = keys(ids)
    pairs = k.withColumnRenamed("item_id", "a").join(k.withColumnRenamed("item_id", "b"), ["rule", "key"]).where("a < b").select("a", "b", "rule")
    if strict_title:
        pairs = pairs.unionByName(_title_pairs(ids))
    names = F.array(*map(F.lit, RULES))
    return pairs.groupBy("a", "b").agg(F.min("rule").alias("rule")).select("a", "b", F.get(names, F.col("rule")).alias("reason_type"))


def _stars(ids: DataFrame) -> DataFrame:
    """(rule, a, b, members): each item of a key with the key's smallest item."""
    k = keys(ids)
    least = k.groupBy("rule", "key").agg(F.min("item_id").alias("a"), F.count("*").alias("members")).where("members > 1")
    return k.join(least, ["rule", "key"]).where("a <> item_id").select("rule", "a", F.col("item_id").alias("b"), "members")


def stars(ids: DataFrame) -> DataFrame:
    """(a, b): each item of a key with the key's smallest item; connects what matches() connects."""
    return _stars(ids).select("a", "b").distinct()


def _title_chain(ids: DataFrame) -> DataFrame:
    """(rule, a, b, members) of equal titles and tags: each item and the one before it in time, six hours apart at most.
    members counts those at most six hours before or after b, itself included."""
    at = millis(F.coalesce("source_event_time", "observed_at"))
    rows = ids.where(F.col("normalized_title").isNotNull() & (F.size("asset_tags") + F.size("topic_tags") > 0)).withColumn("at", at)
    same = Window.partitionBy("normalized_title", "asset_tags", "topic_tags").orderBy("at")
    rows = rows.select("item_id", "at", F.lag(F.struct("at", "item_id")).over(same.orderBy("at", "item_id")).alias("last"), F.count("*").over(same.rangeBetween(-TITLE_WINDOW_MS, TITLE_WINDOW_MS)).alias("members"))
    near = rows.where(F.col("at") - F.col("last.at") <= TITLE_WINDOW_MS)
    return near.select(F.lit(3).alias("rule"), F.least("last.item_id", "item_id").alias("a"), F.greatest("last.item_id", "item_id").alias("b"), "members")


def links(ids: DataFrame, strict_title: bool = False) -> DataFrame:
    """(a, b, reason_type, members) that connect all matching items, a row for each item and rule at most: with the
    smallest item of a shared key (members: how many share it), and by title with the neighbour in time."""
    rows = _stars(ids)
    if strict_title:
        rows = rows.unionByName(_title_chain(ids))
    names = F.array(*map(F.lit, RULES))
    one = rows.groupBy("a", "b").agg(F.min(F.struct("rule", "members")).alias("m"))
    return one.select("a", "b", F.get(names, F.col("m.rule")).alias("reason_type"), F.col("m.members").alias("members"))


def components(links: DataFrame, root: Column | None = None) -> DataFrame:
    """(item_id, root): the smallest item of each linked item's component.

    Minimum labels with pointer jumping; what an item learns its root learns too, so that all who point there follow. Each
    round is written to the folder that executors share.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("item_id")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = both.join(labels.withColumnRenamed("item_id", "b"), "b").groupBy(F.col("a").alias("item_id")).agg(F.min("root").alias("near"))
        step = labels.join(near, "item_id").select("item_id", "root", F.least("root", "near").alias("low"))
        hooked = step.unionByName(step.where("low < root").select(F.col("root").alias("item_id"), F.lit(None).cast("string").alias("root"), "low"))
        step = hooked.groupBy("item_id").agg(F.max("root").alias("root"), F.min("low").alias("low"))
        jump = step.join(step.select(F.col("item_id").alias("low"), F.col("low").alias("far")), "low")
        new = cut(jump.select("item_id", F.least("low", "far").alias("root"), (F.least("low", "far") != F.col("root")).alias("changed")))
        labels = new.drop("changed")
        if new.where("changed").isEmpty():
            return labels


def clusters(items: DataFrame, roots: DataFrame) -> DataFrame:
    """Clusters of evidence items (item_id, source_id, title, category, time_known, verification_tier).

    cluster_id: first 16 hex digits of the SHA-256 of the JSON array of member ids. Title and category are the first
    member's. A cluster is eligible if every member has a known time and is reported.
    """
    rows = items.join(roots, "item_id", "left").withColumn("root", F.coalesce("root", "item_id"))
    first = lambda c: F.min_by(c, "item_id").alias(c)
    out = rows.groupBy("root").agg(
        F.array_sort(F.collect_list("item_id")).alias("item_ids"), first("title"), first("category"), F.array_sort(F.collect_set("source_id")).alias("source_ids"),
        F.bool_and(F.col("time_known") & (F.col("verification_tier") == "reported")).alias("eligible"),
    )
    return out.withColumn("cluster_id", F.concat(F.lit("cluster-"), F.substring(F.sha2(F.to_json("item_ids"), 256), 1, 16)))


def snapshot_counts(articles: DataFrame, items: DataFrame, found: DataFrame) -> DataFrame:
    """One row: input, ingested, quarantined, duplicates, clusters, eligible."""
    n = articles.agg(F.count("*").alias("input"))
    m = items.agg(F.count("*").alias("ingested"))
    c = found.agg(F.count("*").alias("clusters"), F.count_if("eligible").alias("eligible"))
    one = n.withColumn("k", F.lit(1)).join(m.withColumn("k", F.lit(1)), "k").join(c.withColumn("k", F.lit(1)), "k").drop("k")
    return one.withColumns({"quarantined": F.col("input") - F.col("ingested"), "duplicates": F.col("ingested") - F.col("clusters")})
