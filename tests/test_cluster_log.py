"""Clusters by deliveries against an engine that adds one item after the other."""

import random

import pytest

from newsmill.operators import cluster_log, clusters, dedupe
from newsmill.operators.dedupe import RULES

KEY = "item_id string, rule int, key string"


class Engine:
    """Item by item, over all pairs: what the deliveries have to equal."""

    def __init__(self):
        self.known, self.events, self.removed = [], [], set()

    def cluster_of(self, item):
        last = [e for e in self.events if e[1] == item][-1:]
        return last[0][0] if last and last[0][2] == "added" else None

    def put(self, cluster, item, rule):
        if (cluster, item) not in self.removed and not [e for e in self.events if e[:2] == (cluster, item)][-1:][0:1] == [(cluster, item, "added")]:
            self.events.append((cluster, item, "added", rule))

    def add(self, item, keys):
        met = sorted((i, RULES[min(k[0] for k in keys & other)]) for i, other in self.known if keys & other)
        if met:
            found = sorted({c for c in (self.cluster_of(i) for i, _ in met) if c})
            if found:
                self.put(found[0], item, met[0][1])
            else:
                name = "ccl-" + min(item, met[0][0])
                for i, rule in met:
                    self.put(name, i, rule)
                self.put(name, item, met[0][1])
        self.known.append((item, keys))

    def remove(self, cluster, item):
        self.removed.add((cluster, item))
        self.events.append((cluster, item, "removed_as_error", None))

    def members(self):
        return {(c, i) for i, _ in self.known if (c := self.cluster_of(i))}


def keys_of(rows):
    return [(i, r, k) for i, keys in rows for r, k in keys]


@pytest.mark.parametrize("seed", range(3))
def test_deliveries_equal_the_engine(spark, tmp_path, seed):
    """Four deliveries with ids in any order, removals between, re-delivered items, hot keys."""
    rng = random.Random(seed)
    ids = [f"i{k:03d}" for k in range(160)]
    rng.shuffle(ids)
    items = {i: {(r, f"k{rng.randrange(40 if r else 25)}") for r in range(3) if rng.random() < 0.5} for i in ids}
    for i in ids[::7]:
        items[i] = {(0, "hot"), (2, "hot")}
    engine, log = Engine(), cluster_log.ClusterLog(spark, f"{tmp_path}/log")
    for n in range(4):
        part = ids[n * 40 : (n + 1) * 40]
        again = ids[: 5 * n : 3]
        log.add(spark.createDataFrame(keys_of((i, items[i]) for i in [*part, *again]), KEY).repartition(3))
        for i in sorted(part):
            engine.add(i, items[i])
        assert {tuple(r) for r in log.members().collect()} == engine.members()
        gone = rng.sample(sorted(engine.members()), min(6, len(engine.members())))
        for c, i in gone:
            engine.remove(c, i)
        log.remove(spark.createDataFrame(gone, "cluster_id string, item_id string"))
        assert {tuple(r) for r in log.members().collect()} == engine.members()
    got = {tuple(r) for r in log.events().select("cluster_id", "item_id", "event_type", "reason_type").collect()}
    assert got == set(engine.events) and log.steps() == 8


def test_deliveries_in_order_equal_the_batch_form(spark, tmp_path):
    rng = random.Random(11)
    rows = [(f"i{k:03d}", {(r, f"k{rng.randrange(50)}") for r in range(3) if rng.random() < 0.6}) for k in range(150)]
    log = cluster_log.ClusterLog(spark, f"{tmp_path}/log")
    for a in (0, 50, 100):
        log.add(spark.createDataFrame(keys_of(rows[a : a + 50]), KEY))
    keys = spark.createDataFrame(keys_of(rows), KEY)
    least = keys.groupBy("rule", "key").agg({"item_id": "min"}).withColumnRenamed("min(item_id)", "a")
    links = keys.join(least, ["rule", "key"]).where("a <> item_id").select("a", keys["item_id"].alias("b")).distinct()
    want = clusters.active_members(clusters.membership_events(keys, dedupe.components(links)))
    assert {tuple(r) for r in log.members().collect()} == {tuple(r) for r in want.select("cluster_id", "item_id").collect()}


def test_a_lost_step_is_written_anew(spark, tmp_path):
    log = cluster_log.ClusterLog(spark, f"{tmp_path}/log")
    log.add(spark.createDataFrame([("a", 0, "x"), ("b", 0, "x")], KEY))
    spark.createDataFrame([("ccl-z", "z", "added", "r", 0)], "cluster_id string, item_id string, event_type string, reason_type string, seq long").write.parquet(f"{tmp_path}/log/events/step=1")
    assert log.steps() == 1 and {tuple(r) for r in log.members().collect()} == {("ccl-a", "a"), ("ccl-a", "b")}
    log.add(spark.createDataFrame([("c", 0, "x")], KEY))
    assert {tuple(r) for r in log.members().collect()} == {("ccl-a", k) for k in "abc"}
    empty = cluster_log.ClusterLog(spark, f"{tmp_path}/empty")
    assert empty.members().count() == 0 and empty.add(spark.createDataFrame([], KEY)) == 0


def test_fold_of_a_removed_founder():
    """All priors are loose; one was removed from the cluster that the new item founds again."""
    loose = [("a", ["0:x"]), ("b", ["0:x", "1:y"])]
    got = cluster_log.fold_delivery([("c", ["0:x", "1:y"]), ("d", ["1:y"])], loose, {"0:x": "a", "1:y": "b"}, {}, {("ccl-a", "a")})
    assert got == [("ccl-a", "b", "added", RULES[0]), ("ccl-a", "c", "added", RULES[0]), ("ccl-a", "d", "added", RULES[1])]
