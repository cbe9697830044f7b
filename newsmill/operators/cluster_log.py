"""Confirmed clusters delivery by delivery: new items meet the stored state of their keys, and nothing else is read again.

What the engine asks of the past is little. Of a key: its smallest item and the smallest cluster that an item with the key
is in now. Of earlier items: only those with one of the new keys that are in no cluster now, as a new item may found a
cluster with them. So a delivery joins its keys with the stored ones, links new items and loose earlier ones by shared
keys (a star a key, no pairs), and folds each component of these links by itself. Copies that enter a known cluster need
no fold: their outcome is the key's.

Removals come between deliveries. What was removed from a cluster is never added to it again, by any later delivery.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .clusters import EVENTS
from .dedupe import RULES, components
from .lineage import cut

STEPPED = f"step long, {EVENTS}"
KEYS = "step long, item_id string, rule int, key string"


def fold_delivery(new: list[tuple[str, list[str]]], loose: list[tuple[str, list[str]]], first: dict[str, str], low: dict[str, str], removed: set[tuple[str, str]]) -> list[tuple[str, str, str, str]]:
    """Events (cluster, item, 'added', rule) of new items in order of ids.

    new, loose: (id, keys), keys begin with their rule's digit; loose items came earlier and are in no cluster. first, low: a
    key's smallest earlier item, and the smallest cluster that one of its items is in. removed: (cluster, item).
    """
    first, low = dict(first), dict(low)
    alone = {i: sorted(k) for i, k in loose}
    by_key: dict[str, set[str]] = {}
    for i, keys in alone.items():
        for k in keys:
            by_key.setdefault(k, set()).add(i)
    out = []

    def add(cluster: str, item: str, keys: list[str], rule: str) -> bool:
        if (cluster, item) in removed:
            return False
        for k in keys:
            low[k] = min(low.get(k, cluster), cluster)
        out.append((cluster, item, "added", rule))
        return True

    for item, keys in sorted((i, sorted(k)) for i, k in new):
        met = {first[k]: k for k in reversed(keys) if k in first}
        stays = True
        if met:
            held = min((low[k] for k in keys if k in low), default=None)
            chosen = RULES[int(met[min(met)][0])]
            if held is None:
                prior = {i: k for k in reversed(keys) for i in by_key.get(k, ())}
                held = "ccl-" + min(item, *prior)
                for i in sorted(prior):
                    if add(held, i, alone[i], RULES[int(prior[i][0])]):
                        for k in alone.pop(i):
                            by_key[k].discard(i)
            stays = not add(held, item, keys, chosen)
        if stays:
            alone[item] = keys
            for k in keys:
                by_key.setdefault(k, set()).add(item)
        for k in keys:
            first[k] = min(first.get(k, item), item)
    return out


def current(events: DataFrame) -> DataFrame:
    """(item_id, cluster_id) of the items that are in a cluster now: an item's last event is an addition."""
    last = events.groupBy("item_id").agg(F.max_by(F.struct("event_type", "cluster_id"), F.struct("step", "seq")).alias("e"))
    return last.where("e.event_type = 'added'").select("item_id", F.col("e.cluster_id").alias("cluster_id"))


def additions(keys: DataFrame, events: DataFrame, fresh: DataFrame) -> DataFrame:
    """EVENTS of a delivery; keys (item_id, rule, key) and events (STEPPED) as stored, fresh: the new items' keys.

    seq orders the events of a component of the delivery. Items that came before are no new ones.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(r.item_id, r.fresh, list(r.keys_)) for r in pdf.rename(columns={"keys": "keys_"}).itertuples()]
        first = {k["k"]: k["first"] for _, _, keys in rows for k in keys if k["first"] is not None}
        low = {k["k"]: k["low"] for _, _, keys in rows for k in keys if k["low"] is not None}
        removed = {(c, i) for i, gone in zip(pdf["item_id"], pdf["gone"], strict=True) if gone is not None for c in gone}
        by_kind = [[(i, [k["k"] for k in keys]) for i, fresh, keys in rows if fresh == kind] for kind in (True, False)]
        found = fold_delivery(*by_kind, first, low, removed)
        return pd.DataFrame([(*e, n) for n, e in enumerate(found)], columns=[c.split()[0] for c in EVENTS.split(", ")], dtype=object)

    fresh = cut(fresh.select("item_id", "rule", "key").distinct().join(keys.select("item_id").distinct(), "item_id", "left_anti"))
    known = keys.select("item_id", "rule", "key").join(fresh.select("rule", "key").distinct(), ["rule", "key"], "left_semi").join(current(events), "item_id", "left")
    known = cut(known)
    state = known.groupBy("rule", "key").agg(F.min("item_id").alias("first"), F.min("cluster_id").alias("low"))
    nodes = fresh.withColumn("fresh", F.lit(True)).unionByName(known.where("cluster_id is null").select("item_id", "rule", "key", F.lit(False).alias("fresh")))
    several = nodes.groupBy("rule", "key").agg(F.min("item_id").alias("least"), F.count("*").alias("n"))
    nodes = nodes.join(several, ["rule", "key"]).join(state, ["rule", "key"], "left").where("n > 1 or first is not null")
    nodes = cut(nodes)
    roots = components(nodes.where("item_id <> least").select(F.col("least").alias("a"), F.col("item_id").alias("b")).distinct())
    name = F.concat(F.col("rule").cast("string"), F.lit(":"), "key")
    rows = nodes.groupBy("item_id", "fresh").agg(F.array_sort(F.collect_set(F.struct(name.alias("k"), "first", "low"))).alias("keys"))
    rows = rows.join(roots, "item_id", "left").withColumn("root", F.coalesce("root", "item_id"))
    gone = events.where("event_type = 'removed_as_error'").groupBy("item_id").agg(F.collect_set("cluster_id").alias("gone"))
    rows = cut(rows.join(gone, "item_id", "left"))
    # all new, of the same keys, none removed before: the key's cluster, or a new one
    kind = rows.groupBy("root").agg((F.min("keys") == F.max("keys")).alias("equal"), F.bool_and("fresh").alias("fresh"), F.max(F.size("gone")).alias("gone"), F.min("item_id").alias("least"), F.count("*").alias("n"), F.min("keys").alias("all"))
    lows, firsts = (F.array_min(F.transform("all", lambda k: k[c])) for c in ("low", "first"))  # noqa: B023
    kind = kind.withColumns({"low": lows, "first": firsts})
    plain = F.col("equal") & F.col("fresh") & (F.coalesce("gone", F.lit(-1)) <= 0) & F.when(F.col("first").isNull(), F.col("n") > 1).otherwise(F.col("low").isNotNull() & (F.col("least") > F.col("first")))
    kind = cut(kind.withColumn("plain", plain))
    decides = F.when(F.col("first").isNull(), F.get("all", F.lit(0))).otherwise(F.get(F.filter("all", lambda k: k["first"] == F.col("first")), F.lit(0)))
    rule = F.get(F.array(*map(F.lit, RULES)), F.substring(decides["k"], 1, 1).cast("int"))
    even = rows.join(kind.where("plain").select("root", F.coalesce("low", F.concat(F.lit("ccl-"), "root")).alias("cluster_id"), rule.alias("reason_type")), "root")
    even = even.select("cluster_id", "item_id", F.lit("added").alias("event_type"), "reason_type", F.lit(0).cast("long").alias("seq"))
    return even.unionByName(rows.join(kind.where("not plain").select("root"), "root").groupBy("root").applyInPandas(run, EVENTS))


class ClusterLog:
    """Deliveries and removals in a folder, a step each. A step counts from when its keys are written, which come last; one
    that was lost before that is written anew. Nothing that is there is changed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _done(self, step: int) -> bool:
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/keys/step={step}/_SUCCESS")
        return mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark)

    def steps(self) -> int:
        n = 0
        while self._done(n):
            n += 1
        return n

    def _read(self, table: str, schema: str) -> DataFrame:
        folders = [f"{self.path}/{table}/step={k}" for k in range(self.steps())]
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(*folders) if folders else self.spark.createDataFrame([], schema)
        return rows.select(*(c.split()[0] for c in schema.split(", ")))

    def keys(self) -> DataFrame:
        return self._read("keys", KEYS)

    def events(self) -> DataFrame:
        """STEPPED: membership events in order of (step, seq)."""
        return self._read("events", STEPPED)

    def _write(self, events: DataFrame, keys: DataFrame) -> int:
        step = self.steps()
        events.write.mode("overwrite").parquet(f"{self.path}/events/step={step}")
        keys.write.mode("overwrite").parquet(f"{self.path}/keys/step={step}")
        return step

    def add(self, fresh: DataFrame) -> int:
        """Takes the keys (item_id, rule, key) of new items; the number of the step."""
        fresh = fresh.select("item_id", F.col("rule").cast("int").alias("rule"), "key")
        keys = self.keys()
        new = fresh.join(keys.select("item_id").distinct(), "item_id", "left_anti").distinct()
        return self._write(additions(keys.drop("step"), self.events(), fresh), new)

    def remove(self, removals: DataFrame) -> int:
        """Takes (cluster_id, item_id) out as errors; the number of the step."""
        none = F.lit(None).cast("string").alias("reason_type")
        gone = removals.select("cluster_id", "item_id").distinct().select("cluster_id", "item_id", F.lit("removed_as_error").alias("event_type"), none, F.lit(0).cast("long").alias("seq"))
        return self._write(gone, self.keys().drop("step").limit(0))

    def members(self) -> DataFrame:
        """(cluster_id, item_id) of the items whose last event is an addition."""
        return current(self.events()).select("cluster_id", "item_id")
