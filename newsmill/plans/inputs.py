"""Reference-shaped inputs from the driver's tables, and the same in SQL.

Every derived value is a plain expression of an id, so that both engines compute the same rows over the whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The instant that all queries ask about.
NOW = "2024-01-02 00:00:00"
NOW_MS = 1704153600000


def now():
    return F.lit(NOW).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("source_id")).distinct()
    n = F.regexp_replace("source_id", "^src", "").cast("int")
    return rows.withColumn("n", n).select(
        "source_id", F.concat(F.lit("Source "), F.col("n").cast("string")).alias("source_name"), F.expr("CASE n % 10 WHEN 8 THEN 'needs_review' WHEN 9 THEN 'disabled' ELSE 'allowed' END").alias("legal_status"),
        (F.col("n") % 10 != 9).alias("enabled"), F.expr("CASE n % 4 WHEN 0 THEN 'primary' WHEN 1 THEN 'reputable' WHEN 2 THEN 'curated' ELSE 'unknown' END").alias("source_tier"),
        F.expr("CASE WHEN n % 7 = 6 THEN 'manual' ELSE 'rss_fixture' END").alias("source_type"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as news items; verification by label, tags by id. A title is the first line; some items share a title, a
    feed's number or, but for tracking parameters, a link, so that every rule of identity meets matches and chains."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    tag = lambda kind, value: F.struct(F.concat(F.lit(f"{kind}."), F.lower(value)).alias("tag_id"), F.lit(kind).alias("tag_type"), value.alias("tag_value"), F.expr("CASE WHEN doc_id % 17 = 0 THEN 'inferred' ELSE 'deterministic' END").alias("provenance"))
    when = lambda c, t: F.when(F.expr(c), t)
    asset = F.expr("CASE doc_id % 4 WHEN 0 THEN 'Gold' WHEN 1 THEN 'DXY' WHEN 2 THEN 'SPX' ELSE 'VIX' END")
    tags = F.array_compact(F.array(when("doc_id % 3 = 0", tag("asset", asset)), when("doc_id % 5 = 0", tag("topic", F.lit("Geopolitics"))), when("doc_id % 7 = 0", tag("macro", F.lit("FOMC minutes"))), when("doc_id % 13 = 0", tag("region", F.expr("CASE WHEN doc_id % 2 = 0 THEN 'europe' ELSE 'china' END")))))
    rows = docs.select(
        "doc_id", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("item_id"), F.col("doc_id").alias("ordinal"), F.col("source").alias("source_id"), F.expr("CASE WHEN doc_id % 10 = 5 THEN concat('r', doc_id div 200) ELSE cast(doc_id AS string) END").alias("source_item_id"),
        F.expr("CASE WHEN doc_id % 8 = 1 THEN concat('Market note ', doc_id div 800) ELSE substring_index(text, '\\n', 1) END").alias("title"), F.col("text").alias("excerpt"),
        F.expr("CASE WHEN doc_id % 9 = 4 THEN concat('https://News.example.org/p/', doc_id div 27, '/?utm_source=feed&gclid=', doc_id) END").alias("url"),
        F.expr("timestamp_millis(1704067200000 + doc_id * 60000)").alias("observed_at"), F.lit(None).cast("timestamp").alias("source_event_time"),
        F.expr("CASE WHEN doc_id % 11 = 0 THEN 'stale' ELSE 'live' END").alias("freshness_state"), F.sha2("text", 256).alias("dedupe_hash"), tags.alias("tags"), "lang",
    )
    tier = F.expr("CASE WHEN toxic = 1 THEN 'rumor' WHEN quality = 1 THEN 'verified' WHEN quality = 0 THEN 'unverified' WHEN doc_id % 6 = 0 THEN 'scheduled' ELSE 'reported' END")
    # labels come last: a join that shuffles then carries no text for those who drop it
    return rows.join(labels, "doc_id", "left").select("item_id", "ordinal", "source_id", "source_item_id", "title", "excerpt", "url", "observed_at", "source_event_time", tier.alias("verification_tier"), "freshness_state", "dedupe_hash", "tags", "lang")


def clusters_sql(name: str, base: str) -> str:
    """CTEs over a relation of items: name_p (matching pairs and the deciding rule), name_root (components of linked items)
    and name_c (item_id, cluster_id): the engine's order-dependent fold, item by item inside each component."""
    return f"""
{name}_k AS (SELECT item_id, 0 AS rule, source_id || chr(31) || source_item_id AS key FROM {base} UNION ALL SELECT item_id, 1, canonical FROM {base} WHERE canonical IS NOT NULL UNION ALL SELECT item_id, 2, dedupe_hash FROM {base} WHERE dedupe_hash IS NOT NULL),
{name}_p AS (SELECT x.item_id AS a, y.item_id AS b, min(x.rule) AS rule FROM {name}_k x JOIN {name}_k y ON x.rule = y.rule AND x.key = y.key AND x.item_id < y.item_id GROUP BY 1, 2),
{name}_e AS (SELECT a, b FROM {name}_p UNION ALL SELECT b, a FROM {name}_p),
{name}_r AS (SELECT DISTINCT a AS item_id, a AS m FROM {name}_e UNION SELECT r.item_id, e.b FROM {name}_r r JOIN {name}_e e ON r.m = e.a),
{name}_root AS (SELECT item_id, min(m) AS root FROM {name}_r GROUP BY item_id),
{name}_n AS (SELECT b AS item_id, list(a ORDER BY a) AS pri FROM {name}_p GROUP BY b),
{name}_s AS (SELECT n.item_id, pri, root, row_number() OVER (PARTITION BY root ORDER BY n.item_id) AS k FROM {name}_n n JOIN {name}_root r ON n.item_id = r.item_id),
{name}_f AS (
  SELECT DISTINCT root, CAST(0 AS BIGINT) AS k, MAP([]::VARCHAR[], []::VARCHAR[]) AS held FROM {name}_s
  UNION ALL
  SELECT root, k, CASE WHEN c IS NULL THEN map_concat(held, MAP(list_append(pri, item_id), list_transform(list_append(pri, item_id), lambda x: 'ccl-' || pri[1]))) ELSE map_concat(held, MAP([item_id], [c])) END
  FROM (SELECT f.root, s.k, s.item_id, s.pri, f.held, list_min(list_filter(list_transform(s.pri, lambda x: f.held[x]), lambda y: y IS NOT NULL)) AS c FROM {name}_f f JOIN {name}_s s ON f.root = s.root AND s.k = f.k + 1)),
{name}_c AS (SELECT e.key AS item_id, e.value AS cluster_id FROM (SELECT unnest(map_entries(arg_max(held, k))) AS e FROM {name}_f GROUP BY root))"""


ITEMS_SQL = """
sources AS (
  SELECT source_id, 'Source ' || n AS source_name, CASE n % 10 WHEN 8 THEN 'needs_review' WHEN 9 THEN 'disabled' ELSE 'allowed' END AS legal_status, n % 10 <> 9 AS enabled,
         CASE n % 4 WHEN 0 THEN 'primary' WHEN 1 THEN 'reputable' WHEN 2 THEN 'curated' ELSE 'unknown' END AS source_tier, CASE WHEN n % 7 = 6 THEN 'manual' ELSE 'rss_fixture' END AS source_type
  FROM (SELECT DISTINCT source AS source_id, CAST(replace(source, 'src', '') AS INT) AS n FROM documents)),
items AS (
  SELECT lpad(CAST(d.doc_id AS VARCHAR), 12, '0') AS item_id, d.doc_id AS ordinal, source AS source_id, CASE WHEN d.doc_id % 8 = 1 THEN 'Market note ' || (d.doc_id // 800) ELSE string_split(text, chr(10))[1] END AS title, text, sha256(text) AS dedupe_hash,
         CASE WHEN d.doc_id % 10 = 5 THEN 'r' || (d.doc_id // 200) ELSE CAST(d.doc_id AS VARCHAR) END AS source_item_id, CASE WHEN d.doc_id % 9 = 4 THEN 'https://news.example.org/p/' || (d.doc_id // 27) END AS canonical,
         1704067200000 + d.doc_id * 60000 AS observed_ms,
         CASE WHEN toxic = 1 THEN 'rumor' WHEN quality = 1 THEN 'verified' WHEN quality = 0 THEN 'unverified' WHEN d.doc_id % 6 = 0 THEN 'scheduled' ELSE 'reported' END AS verification_tier,
         CASE WHEN d.doc_id % 11 = 0 THEN 'stale' ELSE 'live' END AS freshness_state, d.doc_id % 17 <> 0 AS usable,
         CASE WHEN d.doc_id % 3 = 0 THEN CASE d.doc_id % 4 WHEN 0 THEN 'Gold' WHEN 1 THEN 'DXY' WHEN 2 THEN 'SPX' ELSE 'VIX' END END AS asset,
         d.doc_id % 5 = 0 AS topic, d.doc_id % 7 = 0 AS macro, d.doc_id % 13 = 0 AS region, d.doc_id % 26 = 13 AS china
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
visible AS (SELECT items.* FROM items JOIN sources ON items.source_id = sources.source_id WHERE enabled AND legal_status = 'allowed'),
promotable AS (SELECT * FROM visible WHERE verification_tier IN ('verified', 'reported', 'scheduled'))"""

#: ITEMS_SQL with the clusters of all visible items: ccl (item_id, cluster_id, size).
CLUSTERS_SQL = ITEMS_SQL + "," + clusters_sql("v", "visible") + """,
ccl AS (
  SELECT i.item_id, coalesce(v_c.cluster_id, 'ccl-' || i.item_id) AS cluster_id, count(*) OVER (PARTITION BY coalesce(v_c.cluster_id, 'ccl-' || i.item_id)) AS size FROM visible i LEFT JOIN v_c ON i.item_id = v_c.item_id)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as calendar observations: an event is a user and type, its time and values move with the rows."""
    e = table(spark, sf_dir, "events")
    value = lambda c: F.expr(c).cast("string")
    return e.select(
        F.col("event_type").alias("source_id"), F.col("user_id").cast("string").alias("source_event_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("observed_at"),
        F.expr("CASE WHEN event_id % 23 = 0 THEN 'cancelled' WHEN event_id % 29 = 0 THEN 'postponed' WHEN event_id % 31 = 0 THEN 'completed' ELSE 'scheduled' END").alias("status_hint"),
        F.expr("timestamp_millis(1704153600000 + (event_id % 3) * 3600000 - (user_id % 2) * 60000)").alias("scheduled_for"), F.lit("event").alias("event_name"), F.lit("US").alias("country"), F.lit("USD").alias("currency"),
        F.expr("CASE event_id % 2 WHEN 0 THEN 'high' ELSE 'medium' END").alias("importance_tier"), F.lit("macro").alias("event_category"), value("user_id % 5").alias("previous"), value("event_id % 2").alias("forecast"),
        F.expr("CASE WHEN event_id % 19 = 0 THEN cast(event_id % 3 AS string) END").alias("actual"), F.lit(None).cast("string").alias("revised"), F.lit("https://calendar.example.org/").alias("source_url"),
    )
