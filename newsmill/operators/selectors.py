"""Dashboard views: pulse cells, world regions, the morning brief. Fixed cells and groups appear also when empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.times import age_label
from . import gates

#: Cell key, label and the asset it watches; news and world have predicates of their own (fixed values).
CELLS = [("gold", "Gold", "Gold"), ("dxy", "DXY", "DXY"), ("spx", "S&P", "SPX"), ("vix", "VIX", "VIX"), ("news", "News", None), ("world", "World", None)]


def _cells_of(tags: Column, newsy: Column) -> Column:
    fits = [F.when(gates.has_asset(tags, asset), key) for key, _, asset in CELLS if asset]
    return F.array_compact(F.array(*fits, F.when(newsy, "news"), F.when(gates.is_world(tags), "world")))


def pulse_cells(spark: SparkSession, promotable: DataFrame, clusters: DataFrame, now: Column) -> DataFrame:
    """Six cells: items counted, and the latest time over items and clusters with a promotable member."""
    of_item = promotable.select(F.explode(_cells_of(F.col("tags"), gates.is_newsy())).alias("key"), F.col("observed_at").alias("at"), F.lit(1).alias("item"))
    member = clusters.select("cluster_id", F.explode("item_ids").alias("item_id")).join(promotable.select("item_id"), "item_id", "left_semi").select("cluster_id").distinct()
    newsy = gates.tag_exists(F.col("tags"), ["macro", "topic"])
    of_cluster = clusters.join(member, "cluster_id", "left_semi").select(F.explode(_cells_of(F.col("tags"), newsy)).alias("key"), F.col("last_observed_at").alias("at"), F.lit(0).alias("item"))
    found = of_item.unionByName(of_cluster).groupBy("key").agg(F.sum("item").alias("n"), F.count_if(F.col("item") == 0).alias("c"), F.max("at").alias("last"))
    cells = spark.createDataFrame([(k, key, label) for k, (key, label, _) in enumerate(CELLS)], "ordinal int, key string, label string")
    out = F.broadcast(cells).join(found, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    some = F.concat("label", F.lit(": "), F.col("n").cast("string"), F.lit(" related headlines · "), age_label(F.col("last"), now))
    summary = F.when(F.col("n") > 0, some).otherwise(F.concat("label", F.lit(": no major source update · live")))
    return out.select("ordinal", "key", "label", F.col("n").alias("item_count"), F.coalesce("c", F.lit(0)).cast("long").alias("cluster_count"), F.col("last").alias("last_observed_at"), summary.alias("summary"))


def world_regions(spark: SparkSession, visible: DataFrame, clusters: DataFrame) -> DataFrame:
    """Five regions: items, sources, and clusters by the region of their first visible member."""
    keyed = visible.withColumn("key", gates.region_key())
    of_items = keyed.where("key is not null").groupBy("key").agg(F.count("*").alias("items"), F.countDistinct("source_id").alias("sources"))
    member = clusters.select("cluster_id", F.explode("item_ids").alias("item_id")).join(keyed.select("item_id", "ordinal", "key"), "item_id")
    first = member.groupBy("cluster_id").agg(F.min_by(F.struct("key"), "ordinal").alias("first")).select(F.col("first.key").alias("key"))
    of_clusters = first.where("key is not null").groupBy("key").agg(F.count("*").alias("clusters"))
    regions = spark.createDataFrame([(k, r[0], r[1]) for k, r in enumerate(gates.REGIONS)], "ordinal int, key string, title string")
    out = F.broadcast(regions).join(of_items, "key", "left").join(of_clusters, "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("ordinal", "key", "title", zero("items"), zero("sources"), zero("clusters"))


def region_items(visible: DataFrame, most: int = 6) -> DataFrame:
    """(key, place, item_id, title, observed_at): the latest items of each region, ties by id.

    Spark keeps no more than so many rows a region in each task before it shuffles them (a window group limit), so a region
    that holds most items is no larger for the task that ranks it.
    """
    keyed = visible.select(gates.region_key().alias("key"), "item_id", "title", "observed_at").where("key is not null")
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.col("observed_at").desc(), "item_id"))
    return keyed.withColumn("place", place).where(F.col("place") <= most).select("key", "place", "item_id", "title", "observed_at")


#: Sections of the brief in order (fixed values).
SECTIONS = ["Scheduled events", "Major source-backed clusters", "Relevant watched assets / topics", "Unverified / rumor / needs review (inspection only)", "Items worth attention", "Items to ignore unless they escalate"]
WATCHED = ["Gold", "DXY", "SPX", "VIX"]


def morning_brief(promotable: DataFrame, visible: DataFrame, quarantine: DataFrame, annotated: DataFrame, clusters: DataFrame, sources: DataFrame) -> DataFrame:
    """(section, heading, place, line): six sections; place keeps the order inside one."""
    names = sources.select("source_id", "source_name", "legal_status")
    name = lambda df: df.drop("source_name", "legal_status").join(names, "source_id", "left").withColumn("source_name", F.coalesce("source_name", "source_id"))
    line = F.concat(F.lit("["), "verification_tier", F.lit("] "), "source_name", F.lit(" · "), F.date_format("observed_at", "yyyy-MM-dd HH:mm"), F.lit(" — "), "title")
    tiered = F.concat(F.lit("["), "priority_tier", F.lit("] "), "source_name", F.lit(" — "), "title")
    part = lambda k, df, place, text: df.select(F.lit(k).alias("section"), place.cast("string").alias("place"), text.alias("line"))
    item = F.lpad(F.col("ordinal").cast("string"), 12, "0")
    watched = gates.tag_exists(F.col("tags"), "asset", lambda v: v.isin(WATCHED))
    low = visible.where(F.col("verification_tier").isin("unverified", "rumor")).withColumn("late", F.lit("0"))
    review = name(quarantine).where("legal_status = 'needs_review'").withColumn("late", F.lit("1"))
    shown = ["late", "ordinal", "source_name", "title", "legal_status", "verification_tier", "observed_at"]
    flagged = name(low).select(*shown).unionByName(review.select(*shown))
    size = F.lpad((F.lit(10**9) - F.col("member_count")).cast("string"), 12, "0")
    parts = [
        part(0, name(promotable.where("verification_tier = 'scheduled'")), item, line),
        part(1, clusters.where("member_count >= 2"), F.concat(size, "cluster_id"), cluster_line()),
        part(2, name(promotable.where(watched)), item, line),
        part(3, flagged, F.concat("late", item), F.concat(line, F.when(F.col("legal_status") == "needs_review", " [needs review]").otherwise(""))),
        part(4, annotated.join(promotable.select("item_id"), "item_id", "left_semi").where(F.col("priority_tier").isin("P0", "P1")), item, tiered),
        part(5, annotated.where(F.col("priority_tier").isin("P3", "muted")), item, F.concat(tiered, F.lit(" (source: "), "legal_status", F.lit(")"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("heading", F.get(F.array(*map(F.lit, SECTIONS)), F.col("section")))


def cluster_line():
    return F.concat(F.lit("Confirmed deterministic cluster: "), "cluster_id", F.lit(" · "), F.col("member_count").cast("string"), F.lit(" confirmed members ("), "rule_version", F.lit(") · "), F.col("source_count").cast("string"), F.lit(" sources"))


def timeline(items: DataFrame, sources: DataFrame, query: str, statuses: list[str]) -> DataFrame:
    """Newest first; a case-insensitive substring search over title and source."""
    rows = items.join(sources.select("source_id", "source_name"), "source_id")
    text = F.lower(F.concat("title", F.lit(" "), "source_name"))
    return rows.where(F.col("verification_tier").isin(statuses) & F.contains(text, F.lit(query.lower()))).orderBy(F.desc("observed_at"), "item_id")
