"""Whole flows, as compositions of operators: a dataset to clusters, clusters to checked summaries, calendar payloads to views."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import canonical_text
from ..operators import audit, calendar, dedupe, gates, summaries
from ..sources import calendar as calendar_source
from ..sources import dataset, rss


@dataclass
class Snapshot:
    """What an ingested dataset gives."""

    sources: DataFrame
    payloads: DataFrame
    items: DataFrame
    quarantined: DataFrame
    decisions: DataFrame
    clusters: DataFrame
    counts: DataFrame
    identity: DataFrame


def ingest_dataset(documents: DataFrame, now: Column) -> Snapshot:
    """A dataset document (column json): validated, gated, through RSS, deduplicated, clustered.

    Items are compared by the hash of their own text and title here, so that copies merge across sources.
    """
    sources, articles = dataset.parsed(documents)
    open_ = articles.join(gates.ingestible(sources).select("source_id"), "source_id", "left_semi")
    payloads = dataset.to_rss(open_)
    found = rss.scanned(payloads, now)
    normal = rss.normalised(found, sources, now)
    known = articles.select("source_id", F.trim("article_id").alias("source_item_id"), "text", "category", F.lit(True).alias("_known"))
    items = normal.join(known, ["source_id", "source_item_id"], "left")
    traced = F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("no article of item "), "item_id"))).otherwise(F.col("text"))
    items = items.withColumn("text", traced).drop("_known").withColumn("dedupe_hash", F.sha2(F.to_json(F.struct("text", "title")), 256))
    items = items.withColumn("time_known", F.col("source_event_time").isNotNull())
    ids = dedupe.identities(items).withColumn("normalized_title", F.lit(None).cast("string"))
    clusters = dedupe.clusters(items, dedupe.components(dedupe.stars(ids)))
    reason = sources.select("source_id", gates.skip_reason().alias("reason")).where("reason is not null")
    shut = articles.join(reason, "source_id").select("source_id", F.col("article_id").alias("record"), "reason")
    bad = rss.malformed(found).select("source_id", F.col("malformed_item_id").alias("record"), "reason")
    identity = documents.select(F.sha2(canonical_text(F.col("json")), 256).alias("sha256")).select(F.concat(F.lit("snapshot-"), F.substring("sha256", 1, 16)).alias("id"), "sha256")
    return Snapshot(sources, payloads, items, shut.unionByName(bad), dedupe.matches(ids), clusters, dedupe.snapshot_counts(articles, items, clusters), identity)


def summarise(snapshot: Snapshot, provider: summaries.Provider = summaries.extractive) -> DataFrame:
    """(generation_id, status, issues) of each cluster; a generation sees its own members only."""
    member = snapshot.clusters.select("cluster_id", "eligible", F.posexplode("item_ids").alias("place", "item_id")).join(snapshot.items.select("item_id", "title", "text"), "item_id")
    member = member.withColumn("generation_id", F.concat(F.lit("generation-"), F.substring(F.sha2("cluster_id", 256), 1, 16)))
    first = member.where("place = 0").select("generation_id", "item_id", "title", "text", "eligible")
    return summaries.generate(first, provider, member.select("generation_id", "item_id", "text"))


def audit_records(snapshot: Snapshot, generations: DataFrame) -> DataFrame:
    """A run's records in the form that audit.ledger() and audit.write_run() take."""
    part = lambda df, key: df.select(key.alias("key"), F.to_json(F.struct(*sorted(df.columns))).alias("payload"))
    return audit.contents({
        "snapshot": part(snapshot.identity, F.col("id")), "raw_payload": part(snapshot.payloads, F.col("raw_payload_id")), "normalized_item": part(snapshot.items, F.col("item_id")),
        "quarantined_item": part(snapshot.quarantined, F.concat_ws(":", "source_id", "record")), "dedupe_decision": part(snapshot.decisions, F.concat_ws(":", "a", "b")),
        "cluster": part(snapshot.clusters.drop("root"), F.col("cluster_id")), "generation": part(generations, F.col("generation_id")),
    })


def calendar_views(payloads: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """Current, confirmed views of calendar payloads (source_id, raw_payload_id, payload_text, observed_at); gated first."""
    open_ = payloads.join(sources.where(gates.fetch_eligible(gates.CALENDAR_TYPES)).select("source_id"), "source_id", "left_semi")
    good = open_.where(calendar_source.payload_state() == "ok")
    folded = calendar.revisions(calendar_source.observations(calendar_source.scanned(good)))
    made, kept = folded.where("action = 'create'"), folded.where("action = 'confirm'")
    views = calendar.confirmed_at(calendar.current(calendar.applied(made, calendar.supersessions(folded))), kept)
    return calendar.promotion(views, now).join(calendar.with_history(folded), ["source_id", "source_event_id"])
