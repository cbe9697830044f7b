"""Queries over the driver's tables: each applies operators to whole tables. SQL holds what DuckDB can compute too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, text, times, urls
from ..operators import audit, calendar, clusters, dedupe, display, event_log, gates, numbering, priority, readiness, selectors, summaries, whispers
from ..operators.lineage import cut
from ..sources import rss
from .inputs import CLUSTERS_SQL, ITEMS_SQL, NOW_MS, clusters_sql, items, now, observations, sources, table

SQL: dict[str, str] = {}
QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql if sql.lstrip().upper().startswith(("SELECT", "WITH")) else f"WITH RECURSIVE {sql}"
        return f

    return add


def _checkpointed(spark: SparkSession) -> None:
    """Iterative queries need a checkpoint folder: the session's, or a local one in a local session without (tests)."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        import tempfile

        folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="newsmill-"))


@query(ITEMS_SQL + """
SELECT source_id, CASE WHEN legal_status = 'needs_review' THEN 'legal_status_needs_review' WHEN legal_status = 'disabled' THEN 'legal_status_disabled' WHEN NOT enabled THEN 'not_enabled' WHEN source_type <> 'rss_fixture' THEN 'unsupported_source_type' END AS skip_reason,
       enabled AND legal_status = 'allowed' AND source_type = 'rss_fixture' AS fetch_eligible,
       CASE WHEN legal_status = 'needs_review' THEN 'quarantined' WHEN legal_status = 'disabled' OR NOT enabled THEN 'disabled' WHEN source_type <> 'rss_fixture' THEN 'unsupported' ELSE 'eligible' END AS eligibility
FROM sources""")
def source_gate(spark: SparkSession, sf: str) -> DataFrame:
    return gates.gated(sources(spark, sf)).select("source_id", "skip_reason", "fetch_eligible", "eligibility")


@query(ITEMS_SQL + " SELECT item_id, source_id FROM visible")
def ingested_items(spark: SparkSession, sf: str) -> DataFrame:
    return gates.visible_items(items(spark, sf), sources(spark, sf)).select("item_id", "source_id")


@query(ITEMS_SQL + " SELECT item_id, items.source_id FROM items JOIN sources ON items.source_id = sources.source_id WHERE legal_status IN ('needs_review', 'disabled')")
def quarantined_items(spark: SparkSession, sf: str) -> DataFrame:
    return gates.quarantine_items(items(spark, sf), sources(spark, sf)).select("item_id", "source_id")


@query(ITEMS_SQL + " SELECT item_id, verification_tier FROM promotable")
def promotable_items(spark: SparkSession, sf: str) -> DataFrame:
    return gates.promotable_items(items(spark, sf), sources(spark, sf)).select("item_id", "verification_tier")


_STARS = """, least AS (SELECT rule, key, min(item_id) AS a, count(*) AS members FROM v_k GROUP BY 1, 2 HAVING count(*) > 1),
star AS (SELECT l.a, k.item_id AS b, l.rule, members FROM least l JOIN v_k k ON l.rule = k.rule AND l.key = k.key WHERE k.item_id <> l.a)"""
_NAMED = "['source_item_id_exact', 'canonical_url_exact', 'dedupe_hash_exact', 'normalized_title_exact_strict'][min(rule) + 1] AS reason_type"


@query(ITEMS_SQL + "," + clusters_sql("v", "visible") + _STARS + f" SELECT a, b, {_NAMED}, arg_min(members, rule) AS members FROM star GROUP BY a, b")
def dedupe_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Links of exact identity: each item with the smallest one of a shared key."""
    return dedupe.links(dedupe.identities(gates.visible_items(items(spark, sf), sources(spark, sf))))


@query(ITEMS_SQL + "," + clusters_sql("v", "visible") + _STARS + f""", ids AS (
  SELECT item_id, observed_ms, trim(regexp_replace(regexp_replace(lower(regexp_replace(title, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), '[\\s\\p{{Z}}]+', ' ', 'g'), ' +([,.;:!?])', '\\1', 'g')) AS t,
         CASE WHEN usable THEN coalesce(asset, '') ELSE '' END AS asset, usable AND topic AS topic, usable AND macro AS macro FROM visible),
chain AS (
  SELECT lag(item_id) OVER (PARTITION BY t, asset, topic, macro ORDER BY observed_ms, item_id) AS last, lag(observed_ms) OVER (PARTITION BY t, asset, topic, macro ORDER BY observed_ms, item_id) AS before, item_id, observed_ms,
         count(*) OVER (PARTITION BY t, asset, topic, macro ORDER BY observed_ms RANGE BETWEEN 21600000 PRECEDING AND 21600000 FOLLOWING) AS members
  FROM ids WHERE t <> '' AND (asset <> '' OR topic OR macro)),
every AS (SELECT * FROM star UNION ALL SELECT least(last, item_id), greatest(last, item_id), 3, members FROM chain WHERE observed_ms - before <= 21600000)
SELECT a, b, {_NAMED}, arg_min(members, rule) AS members FROM every GROUP BY a, b""")
def strict_title_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The same, and neighbours in time of equal titles and tags."""
    return dedupe.links(dedupe.identities(gates.visible_items(items(spark, sf), sources(spark, sf))), strict_title=True)


@query(CLUSTERS_SQL + " SELECT item_id, root FROM v_root")
def connected_components(spark: SparkSession, sf: str) -> DataFrame:
    _checkpointed(spark)
    return dedupe.components(dedupe.stars(dedupe.identities(gates.visible_items(items(spark, sf), sources(spark, sf)))))


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    rows = gates.visible_items(items(spark, sf), sources(spark, sf))
    return rows.withColumns({"category": F.col("lang"), "time_known": F.col("ordinal") % 10 != 3})


@query(CLUSTERS_SQL + """
SELECT 'cluster-' || substring(sha256('["' || string_agg(i.item_id, '","' ORDER BY i.item_id) || '"]'), 1, 16) AS cluster_id, min(i.item_id) AS first_item, count(*) AS members, count(DISTINCT source_id) AS source_count,
       bool_and(ordinal % 10 <> 3 AND verification_tier = 'reported') AS eligible
FROM visible i LEFT JOIN v_root ON i.item_id = v_root.item_id GROUP BY coalesce(root, i.item_id)""")
def evidence_clusters(spark: SparkSession, sf: str) -> DataFrame:
    _checkpointed(spark)
    rows = _evidence(spark, sf)
    found = dedupe.clusters(rows, dedupe.components(dedupe.stars(dedupe.identities(rows))))
    return found.select("cluster_id", F.element_at("item_ids", 1).alias("first_item"), F.size("item_ids").cast("long").alias("members"), F.size("source_ids").cast("long").alias("source_count"), "eligible")


@query(CLUSTERS_SQL + """, c AS (SELECT coalesce(root, i.item_id) AS root, bool_and(ordinal % 10 <> 3 AND verification_tier = 'reported') AS eligible FROM visible i LEFT JOIN v_root ON i.item_id = v_root.item_id GROUP BY 1)
SELECT (SELECT count(*) FROM items) AS input, (SELECT count(*) FROM visible) AS ingested, (SELECT count(*) FROM items) - (SELECT count(*) FROM visible) AS quarantined,
       (SELECT count(*) FROM visible) - (SELECT count(*) FROM c) AS duplicates, (SELECT count(*) FROM c) AS clusters, (SELECT count(*) FROM c WHERE eligible) AS eligible""")
def snapshot_counts(spark: SparkSession, sf: str) -> DataFrame:
    _checkpointed(spark)
    rows = _evidence(spark, sf)
    found = dedupe.clusters(rows, dedupe.components(dedupe.stars(dedupe.identities(rows))))
    return dedupe.snapshot_counts(items(spark, sf), rows, found).select("input", "ingested", "quarantined", "duplicates", "clusters", "eligible")


def _prepared(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Items without their texts, and sources: computed once, as tables that all uses read."""
    _checkpointed(spark)
    return cut(items(spark, sf).drop("excerpt")), cut(sources(spark, sf))


def _identified(rows: DataFrame) -> DataFrame:
    """What dedupe.keys() asks for; canonical URLs are costly and computed once."""
    return cut(dedupe.identities(rows).select("item_id", "source_id", "source_item_id", "canonical_url", "dedupe_hash"))


def _clustered(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    ids = _identified(rows) if ids is None else ids
    return clusters.confirmed(cut(clusters.membership_events(dedupe.keys(ids), dedupe.components(dedupe.stars(ids)))), rows)


@query(CLUSTERS_SQL + """
SELECT cluster_id, count(*) AS member_count, count(DISTINCT v.source_id) AS source_count, epoch_ms(min(observed_ms)) AS first_observed_at, epoch_ms(max(observed_ms)) AS last_observed_at, 'active' AS status
FROM ccl JOIN visible v ON ccl.item_id = v.item_id WHERE size > 1 GROUP BY cluster_id""")
def confirmed_clusters(spark: SparkSession, sf: str) -> DataFrame:
    out = _clustered(gates.visible_items(*_prepared(spark, sf)))
    return out.select("cluster_id", "member_count", "source_count", F.col("first_observed_at").cast("timestamp_ntz").alias("first_observed_at"), F.col("last_observed_at").cast("timestamp_ntz").alias("last_observed_at"), "status")


def _judged(rows: DataFrame, known: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    return priority.annotated(rows, known, clusters.members_of(_clustered(gates.visible_items(rows, known), ids)), now())


def _annotated(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(*_prepared(spark, sf))


_SCORES = CLUSTERS_SQL + """, s1 AS (
  SELECT v.*, s.source_name, s.source_tier, CASE WHEN ccl.size > 1 THEN ccl.cluster_id END AS cluster_id, ccl.size,
         CASE source_tier WHEN 'primary' THEN 3 WHEN 'reputable' THEN 2 WHEN 'curated' THEN 1 ELSE 0 END AS tier_n,
         CASE verification_tier WHEN 'verified' THEN 3 WHEN 'scheduled' THEN 2 WHEN 'reported' THEN 1 WHEN 'rumor' THEN -1 ELSE 0 END AS ver_n,
         CASE WHEN usable AND macro THEN 2 ELSE 0 END AS macro_n, CASE WHEN ccl.size >= 4 THEN 2 WHEN ccl.size >= 2 THEN 1 ELSE 0 END AS grown_n,
         greatest(0, (1704153600000 - observed_ms) // 60000) AS age
  FROM visible v JOIN sources s ON v.source_id = s.source_id JOIN ccl ON v.item_id = ccl.item_id),
s2 AS (SELECT *, CASE WHEN age <= 15 THEN 2 WHEN age <= 60 THEN 1 WHEN age >= 720 THEN -1 ELSE 0 END AS recent_n, CASE WHEN freshness_state = 'stale' THEN 1 ELSE 0 END AS stale_n FROM s1),
s3 AS (SELECT *, tier_n + ver_n + macro_n + grown_n + recent_n - stale_n AS score FROM s2),
s4 AS (SELECT *, CASE WHEN score >= 7 THEN 0 WHEN score >= 5 THEN 1 WHEN score >= 3 THEN 2 WHEN score >= 1 THEN 3 ELSE 4 END AS raw FROM s3),
s5 AS (SELECT *, greatest(raw, CASE verification_tier WHEN 'rumor' THEN 3 WHEN 'unverified' THEN 2 ELSE 0 END) AS tier FROM s4),
s6 AS (SELECT *, ['P0', 'P1', 'P2', 'P3', 'muted'][CAST(tier + 1 AS INT)] AS priority_tier, CASE WHEN verification_tier = 'scheduled' THEN 'soon' ELSE ['now', 'soon', 'today', 'background', 'muted'][CAST(tier + 1 AS INT)] END AS u0 FROM s5),
s7 AS (SELECT *, CASE WHEN verification_tier = 'rumor' AND u0 <> 'muted' THEN 'background' WHEN verification_tier = 'unverified' AND u0 = 'now' THEN 'soon' ELSE u0 END AS urgency_label FROM s6),
scored AS (SELECT *, concat_ws('; ', 'source tier ' || source_tier || ' (+' || tier_n || ')', 'verification ' || verification_tier || ' (' || CASE WHEN ver_n >= 0 THEN '+' ELSE '' END || ver_n || ')',
    CASE WHEN macro_n > 0 THEN 'scheduled macro keyword match (+2)' END, CASE WHEN grown_n > 0 THEN 'confirmed cluster size ' || size || ' (+' || grown_n || ')' END,
    CASE WHEN recent_n <> 0 THEN 'recency ' || age || 'm (' || CASE WHEN recent_n >= 0 THEN '+' ELSE '' END || recent_n || ')' END, CASE WHEN stale_n = 1 THEN 'freshness stale (-1)' END,
    CASE WHEN raw <> tier THEN verification_tier || ' verification cap → ' || priority_tier END, CASE WHEN u0 <> urgency_label THEN verification_tier || ' urgency cap → ' || urgency_label END)
    || CASE WHEN cluster_id IS NOT NULL THEN '; confirmed cluster ' || cluster_id || ' size ' || size || ' (cluster-rule-v1)' ELSE '' END AS priority_reason FROM s7)"""


@query(_SCORES + " SELECT item_id, priority_tier, urgency_label, priority_reason FROM scored")
def priority_score(spark: SparkSession, sf: str) -> DataFrame:
    return _annotated(spark, sf).select("item_id", "priority_tier", "urgency_label", "priority_reason")


@query(_SCORES + " SELECT item_id, priority_tier, CAST(row_number() OVER (PARTITION BY priority_tier ORDER BY observed_ms DESC, item_id) AS BIGINT) AS place FROM scored")
def priority_stream_order(spark: SparkSession, sf: str) -> DataFrame:
    """Places within a tier, from the place in the whole order."""
    _checkpointed(spark)
    order = [priority.rank(F.col("priority_tier")), F.desc("observed_at"), F.col("item_id")]
    rows = numbering.numbered(_annotated(spark, sf).select("item_id", "priority_tier", "observed_at"), order, "n")
    first = rows.groupBy("priority_tier").agg(F.min("n").alias("first"))  # a row a tier
    return rows.join(F.broadcast(first), "priority_tier").select("item_id", "priority_tier", (F.col("n") - F.col("first") + 1).alias("place"))


def _legacy(spark: SparkSession, sf: str) -> DataFrame:
    """Stories of ten neighbouring items, as clusters that came with a snapshot."""
    rows = items(spark, sf).withColumn("story", F.floor(F.col("ordinal") / 10))
    out = rows.groupBy("story").agg(F.array_sort(F.collect_list("item_id")).alias("item_ids"), F.max("observed_at").alias("last_observed_at"), F.min_by("tags", "item_id").alias("tags"))
    return out.withColumn("cluster_id", F.concat(F.lit("story-"), F.col("story").cast("string")))


@query(ITEMS_SQL + """, member AS (
  SELECT i.ordinal // 10 AS story, i.source_id, i.verification_tier, i.usable, i.macro, i.freshness_state, i.observed_ms, count(*) OVER (PARTITION BY i.ordinal // 10) AS size FROM items i),
sc AS (
  SELECT story, legal_status, enabled, verification_tier,
    CASE source_tier WHEN 'primary' THEN 3 WHEN 'reputable' THEN 2 WHEN 'curated' THEN 1 ELSE 0 END + CASE verification_tier WHEN 'verified' THEN 3 WHEN 'scheduled' THEN 2 WHEN 'reported' THEN 1 WHEN 'rumor' THEN -1 ELSE 0 END
    + CASE WHEN usable AND macro THEN 2 ELSE 0 END + CASE WHEN size >= 4 THEN 2 WHEN size >= 2 THEN 1 ELSE 0 END
    + CASE WHEN greatest(0, (1704153600000 - observed_ms) // 60000) <= 15 THEN 2 WHEN greatest(0, (1704153600000 - observed_ms) // 60000) <= 60 THEN 1 WHEN (1704153600000 - observed_ms) // 60000 >= 720 THEN -1 ELSE 0 END AS total,
    CASE WHEN freshness_state = 'stale' THEN 1 ELSE 0 END AS stale_n
  FROM member JOIN sources ON member.source_id = sources.source_id),
t AS (SELECT story, CASE WHEN legal_status = 'disabled' OR NOT enabled THEN -99 ELSE CASE WHEN legal_status = 'needs_review' THEN least(total, 1) ELSE total END - stale_n END AS score, verification_tier FROM sc),
r AS (SELECT story, CASE WHEN score = -99 THEN 4 ELSE greatest(CASE WHEN score >= 7 THEN 0 WHEN score >= 5 THEN 1 WHEN score >= 3 THEN 2 WHEN score >= 1 THEN 3 ELSE 4 END, CASE verification_tier WHEN 'rumor' THEN 3 WHEN 'unverified' THEN 2 ELSE 0 END) END AS rk FROM t)
SELECT 'story-' || story AS cluster_id, ['P0', 'P1', 'P2', 'P3', 'muted'][CAST(min(rk) + 1 AS INT)] AS priority_tier, ['now', 'soon', 'today', 'background', 'muted'][CAST(min(rk) + 1 AS INT)] AS urgency_label, count(*) AS members FROM r GROUP BY story""")
def cluster_priority(spark: SparkSession, sf: str) -> DataFrame:
    return priority.cluster_priority(_legacy(spark, sf), items(spark, sf), sources(spark, sf), now())


@query(ITEMS_SQL + """, cells(ordinal, key, label) AS (VALUES (0, 'gold', 'Gold'), (1, 'dxy', 'DXY'), (2, 'spx', 'S&P'), (3, 'vix', 'VIX'), (4, 'news', 'News'), (5, 'world', 'World')),
pc AS (SELECT DISTINCT ordinal // 10 AS story FROM promotable),
story AS (SELECT i.ordinal // 10 AS story, max(observed_ms) AS ms, arg_min(usable, item_id) AS usable, arg_min(coalesce(asset, ''), item_id) AS asset, arg_min(topic, item_id) AS topic, arg_min(macro, item_id) AS macro, arg_min(region, item_id) AS region FROM items i GROUP BY 1),
hits AS (
  SELECT c.key, 1 AS item, p.observed_ms AS ms FROM promotable p JOIN cells c ON CASE c.key WHEN 'news' THEN verification_tier = 'scheduled' OR (usable AND (macro OR topic)) WHEN 'world' THEN usable AND (region OR topic) ELSE usable AND lower(asset) = CASE c.key WHEN 'gold' THEN 'gold' ELSE c.key END END
  UNION ALL
  SELECT c.key, 0, s.ms FROM story s JOIN pc ON s.story = pc.story JOIN cells c ON s.usable AND CASE c.key WHEN 'news' THEN macro OR topic WHEN 'world' THEN region OR topic ELSE lower(s.asset) = c.key END),
agg AS (SELECT key, sum(item) AS n, count(*) FILTER (item = 0) AS c, max(ms) AS ms FROM hits GROUP BY key)
SELECT cells.ordinal, cells.key, label, CAST(coalesce(n, 0) AS BIGINT) AS item_count, CAST(coalesce(c, 0) AS BIGINT) AS cluster_count,
  CASE WHEN coalesce(n, 0) > 0 THEN label || ': ' || CAST(n AS BIGINT) || ' related headlines · ' || CASE WHEN m < 1 THEN 'live' WHEN m < 60 THEN m || 'm' WHEN m < 1440 THEN (m // 60) || 'h' ELSE (m // 1440) || 'd' END ELSE label || ': no major source update · live' END AS summary
FROM cells LEFT JOIN (SELECT *, greatest(0, (1704153600000 - ms) // 60000) AS m FROM agg) a ON cells.key = a.key""")
def pulse_cells(spark: SparkSession, sf: str) -> DataFrame:
    promotable = gates.promotable_items(items(spark, sf), sources(spark, sf))
    return selectors.pulse_cells(spark, promotable, _legacy(spark, sf), now()).drop("last_observed_at")


@query(ITEMS_SQL + """, regions(ordinal, key, title) AS (VALUES (0, 'us_fed_usd', 'United States / Fed / USD'), (1, 'eu_ecb_eur', 'Europe / ECB / EUR'), (2, 'china_demand_macro', 'China / demand / macro'), (3, 'me_geopolitics_oil_gold', 'Middle East / geopolitics / oil / gold'), (4, 'global_risk_vol_equities_bonds', 'Global risk / volatility / equities / bonds')),
k AS (SELECT *, CASE WHEN NOT usable THEN NULL WHEN macro THEN 'us_fed_usd' WHEN region AND NOT china THEN 'eu_ecb_eur' WHEN china THEN 'china_demand_macro' WHEN topic OR asset = 'Gold' THEN 'me_geopolitics_oil_gold' WHEN asset IN ('VIX', 'SPX') THEN 'global_risk_vol_equities_bonds' END AS key FROM visible),
i AS (SELECT key, count(*) AS n, count(DISTINCT source_id) AS s FROM k WHERE key IS NOT NULL GROUP BY key),
f AS (SELECT key, row_number() OVER (PARTITION BY ordinal // 10 ORDER BY ordinal) AS rn FROM k),
c AS (SELECT key, count(*) AS n FROM f WHERE rn = 1 AND key IS NOT NULL GROUP BY key)
SELECT regions.ordinal, regions.key, title, coalesce(i.n, 0) AS items, coalesce(s, 0) AS sources, coalesce(c.n, 0) AS clusters FROM regions LEFT JOIN i ON regions.key = i.key LEFT JOIN c ON regions.key = c.key""")
def world_regions(spark: SparkSession, sf: str) -> DataFrame:
    return selectors.world_regions(spark, gates.visible_items(items(spark, sf), sources(spark, sf)), _legacy(spark, sf))


@query(ITEMS_SQL + """,
k AS (SELECT *, CASE WHEN NOT usable THEN NULL WHEN macro THEN 'us_fed_usd' WHEN region AND NOT china THEN 'eu_ecb_eur' WHEN china THEN 'china_demand_macro' WHEN topic OR asset = 'Gold' THEN 'me_geopolitics_oil_gold' WHEN asset IN ('VIX', 'SPX') THEN 'global_risk_vol_equities_bonds' END AS key FROM visible),
r AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY observed_ms DESC, item_id) AS place, item_id, title FROM k WHERE key IS NOT NULL)
SELECT key, CAST(place AS INT) AS place, item_id, title FROM r WHERE place <= 6""")
def region_items(spark: SparkSession, sf: str) -> DataFrame:
    """The six latest items of each region."""
    return selectors.region_items(gates.visible_items(items(spark, sf), sources(spark, sf))).select("key", "place", "item_id", "title")


_LINE = "'[' || verification_tier || '] ' || source_name || ' · ' || strftime(epoch_ms(observed_ms), '%Y-%m-%d %H:%M') || ' — ' || title"


@query(_SCORES + "," + clusters_sql("p", "promotable") + f""", pccl AS (SELECT p_c.cluster_id AS cid, count(*) AS n, count(DISTINCT source_id) AS s FROM p_c JOIN promotable ON p_c.item_id = promotable.item_id GROUP BY 1)
SELECT 0 AS section, 'Scheduled events' AS heading, {_LINE} AS line FROM promotable p JOIN sources s ON p.source_id = s.source_id WHERE verification_tier = 'scheduled'
UNION ALL SELECT 1, 'Major source-backed clusters', 'Confirmed deterministic cluster: ' || cid || ' · ' || n || ' confirmed members (cluster-rule-v1) · ' || s || ' sources' FROM pccl
UNION ALL SELECT 2, 'Relevant watched assets / topics', {_LINE} FROM promotable p JOIN sources s ON p.source_id = s.source_id WHERE usable AND asset IS NOT NULL
UNION ALL SELECT 3, 'Unverified / rumor / needs review (inspection only)', {_LINE} FROM visible v JOIN sources s ON v.source_id = s.source_id WHERE verification_tier IN ('unverified', 'rumor')
UNION ALL SELECT 3, 'Unverified / rumor / needs review (inspection only)', {_LINE} || ' [needs review]' FROM items i JOIN sources s ON i.source_id = s.source_id WHERE legal_status = 'needs_review'
UNION ALL SELECT 4, 'Items worth attention', '[' || priority_tier || '] ' || source_name || ' — ' || title FROM scored WHERE priority_tier IN ('P0', 'P1') AND verification_tier IN ('verified', 'reported', 'scheduled')
UNION ALL SELECT 5, 'Items to ignore unless they escalate', '[' || priority_tier || '] ' || source_name || ' — ' || title || ' (source: allowed)' FROM scored WHERE priority_tier IN ('P3', 'muted')""")
def morning_brief(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters here are those of promotable items, unlike the annotation's."""
    all_items, known = _prepared(spark, sf)
    visible, promotable = gates.visible_items(all_items, known), gates.promotable_items(all_items, known)
    ids = _identified(visible)
    annotated = cut(_judged(all_items, known, ids).select("item_id", "ordinal", "source_name", "title", "legal_status", "priority_tier"))
    found = _clustered(promotable, cut(ids.join(promotable.select("item_id"), "item_id", "left_semi")))
    return selectors.morning_brief(promotable, visible, gates.quarantine_items(all_items, known), annotated, found, known).select("section", "heading", "line")


@query(ITEMS_SQL + " SELECT item_id, source_name FROM items JOIN sources ON items.source_id = sources.source_id WHERE verification_tier IN ('verified', 'reported') AND contains(lower(title || ' ' || source_name), 'the')")
def timeline_search(spark: SparkSession, sf: str) -> DataFrame:
    return selectors.timeline(items(spark, sf), sources(spark, sf), "The", ["verified", "reported"]).select("item_id", "source_name")


@query(r"""
WITH p AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#\s]+)([^?#]*)(?:\?([^#]*))?', 1)) AS scheme, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#\s]+)([^?#]*)(?:\?([^#]*))?', 2)) AS host,
  regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#\s]+)([^?#]*)(?:\?([^#]*))?', 3) AS path, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#\s]+)([^?#]*)(?:\?([^#]*))?', 4) AS q FROM pages),
k AS (SELECT *, array_to_string(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT list_contains(['utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'fbclid', 'gclid'], lower(string_split(x, '=')[1]))), '&') AS kept FROM p)
SELECT page_id, scheme || '://' || host || CASE WHEN path = '' THEN '/' WHEN kept = '' AND length(path) > 1 THEN CASE WHEN rtrim(path, '/') = '' THEN '/' ELSE rtrim(path, '/') END ELSE path END || CASE WHEN kept = '' THEN '' ELSE '?' || kept END AS canonical FROM k""")
def canonical_url(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical"))


@query(r"""
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<!\[CDATA\[(.*?)\]\]>', '\1', 'gs'), '</?[^>]*>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&#39;', ''''), '&nbsp;', ' '), '[\s\p{Z}]+', ' ', 'g')) AS plain,
       regexp_matches(html, '</?[a-zA-Z][^>]*>') AS has_html FROM pages""")
def sanitize_html(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", text.sanitize(F.col("html")).alias("plain"), text.contains_html(F.col("html")).alias("has_html"))


@query(r"""
SELECT doc_id, nullif(trim(regexp_replace(regexp_replace(lower(regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), '[\s\p{Z}]+', ' ', 'g'), ' +([,.;:!?])', '\1', 'g')), '') AS title FROM documents""")
def normalize_title(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.normalize_title(F.col("text")).alias("title"))


@query("""
SELECT p_partkey, lower(lpad(printf('%x', list_reduce(list_prepend(2166136261::UBIGINT, list_transform(string_split(p_name || ' é' || p_partkey, ''), lambda x: unicode(x)::UBIGINT)), lambda h, c: ((xor(h, c) * 16777619) % 4294967296)::UBIGINT)), 8, '0')) AS hash FROM part""")
def fnv_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", hashing.fnv1a(F.concat("p_name", F.lit(" é"), F.col("p_partkey").cast("string"))).alias("hash"))


@query(r"SELECT doc_id, array_to_string(regexp_extract_all(text, '\d+(?:[.,]\d+)*(?:%|bps)?'), '|') AS numbers FROM documents")
def numeric_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(text.numbers(F.col("text")), "|").alias("numbers"))


_PHRASES = r"(?i)\b(" + "|".join(summaries.FORBIDDEN) + r")\b"


@query(f"SELECT conv_id, turn, regexp_matches(text, '{_PHRASES}') AS forbidden FROM conversations")
def forbidden_phrase(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", text.forbidden(F.col("text"), summaries.FORBIDDEN).alias("forbidden"))


@query("""
WITH e AS (SELECT event_id, event_type, user_id, epoch_us(ts) AS us FROM events)
SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY us RANGE BETWEEN 899999999 PRECEDING AND CURRENT ROW) - 1 AS type_15m, count(*) OVER (PARTITION BY event_type ORDER BY us RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) - 1 AS type_60m,
       count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) - 1 AS user_60m FROM e""")
def rate_limit_counts(spark: SparkSession, sf: str) -> DataFrame:
    return whispers.sliding_counts(table(spark, sf, "events")).select("event_id", "type_15m", "type_60m", "user_60m")


@query("""
SELECT event_id, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER w AS ms_since, coalesce(epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER w < 300000, FALSE) AS cooldown FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def cooldown_spacing(spark: SparkSession, sf: str) -> DataFrame:
    return whispers.cooldowns(table(spark, sf, "events"), ["user_id"]).select("event_id", "ms_since", "cooldown")


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS sequence FROM events")
def stream_sequence(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumns({"stream_name": F.col("event_type"), "stream_key": F.col("user_id").cast("string")})
    return event_log.sequenced(e, None, ["ts", "event_id"]).select("event_id", "sequence")


def _log(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("record_id"), F.col("event_type").alias("stream_name"), F.col("user_id").cast("string").alias("stream_key"), "ts", "event_id")
    return event_log.sequenced(e, None, ["ts", "event_id"])


@query("""
WITH s AS (SELECT event_type, user_id, event_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) - 1 AS sequence FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY sequence) - 1 AS expected FROM s WHERE event_id % 50 <> 0)
SELECT event_type AS stream_name, CAST(user_id AS VARCHAR) AS stream_key, count(*) AS records, count(*) FILTER (expected <> sequence) AS gaps, count(*) - count(DISTINCT event_id) AS duplicates FROM k GROUP BY 1, 2""")
def stream_contiguity(spark: SparkSession, sf: str) -> DataFrame:
    """A log that has lost every fiftieth record, as a case for the check."""
    return event_log.contiguity(_log(spark, sf).where("event_id % 50 <> 0"))


@query("SELECT user_id, arg_max(event_type, struct_pack(t := ts, e := event_id)) AS event_type, arg_max(event_id, struct_pack(t := ts, e := event_id)) AS event_id FROM events GROUP BY user_id")
def latest_state(spark: SparkSession, sf: str) -> DataFrame:
    return event_log.latest(table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def lineage_gaps(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return event_log.unresolved(table(spark, sf, "orders").select("o_orderkey"), lines, "o_orderkey")


#: Each event's rows one after the other; the columns p_* are the current revision's.
_REVISIONS = """
WITH RECURSIVE e AS (
  SELECT event_type, user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS k,
         CASE WHEN event_id % 23 = 0 THEN 'cancelled' WHEN event_id % 29 = 0 THEN 'postponed' WHEN event_id % 31 = 0 THEN 'completed' ELSE 'scheduled' END AS hint,
         1704153600000 + (event_id % 3) * 3600000 - (user_id % 2) * 60000 AS at_ms, event_id % 2 AS forecast, CASE WHEN event_id % 19 = 0 THEN event_id % 3 END AS actual FROM events),
r AS (
  SELECT event_type, user_id, event_id, us, k, 'create' AS action, 1 AS number, CASE hint WHEN 'scheduled' THEN 'active' ELSE hint END AS status, 'first_seen' AS reason, NULL::INT AS supersedes,
         at_ms AS p_at, CASE hint WHEN 'scheduled' THEN 'active' ELSE hint END AS p_status, forecast AS p_forecast, actual AS p_actual FROM e WHERE k = 1
  UNION ALL
  SELECT event_type, user_id, event_id, us, k, CASE WHEN made THEN 'create' ELSE 'confirm' END, CASE WHEN made THEN number + 1 ELSE number END, status, reason, CASE WHEN made THEN number END,
         CASE WHEN made THEN at_ms ELSE p_at END, CASE WHEN made THEN status ELSE p_status END, CASE WHEN made THEN forecast ELSE p_forecast END, CASE WHEN made THEN actual ELSE p_actual END
  FROM (SELECT *, reason <> 'unchanged_confirmation' AS made, CASE reason WHEN 'cancelled' THEN 'cancelled' WHEN 'postponed' THEN 'postponed' WHEN 'actual_added' THEN 'completed' WHEN 'unchanged_confirmation' THEN p_status ELSE 'active' END AS status
    FROM (SELECT e.*, r.number, r.p_at, r.p_status, r.p_forecast, r.p_actual,
            CASE WHEN e.hint = 'cancelled' AND r.p_status <> 'cancelled' THEN 'cancelled' WHEN e.hint = 'postponed' THEN 'postponed'
                 WHEN e.hint = 'completed' OR (e.actual IS NOT NULL AND e.actual IS DISTINCT FROM r.p_actual) THEN 'actual_added' WHEN e.at_ms <> r.p_at THEN 'time_changed'
                 WHEN e.forecast <> r.p_forecast OR e.actual IS DISTINCT FROM r.p_actual THEN 'forecast_changed' ELSE 'unchanged_confirmation' END AS reason
          FROM r JOIN e ON r.event_type = e.event_type AND r.user_id = e.user_id AND e.k = r.k + 1)))"""


@query(_REVISIONS + " SELECT event_type AS source_id, CAST(user_id AS VARCHAR) AS source_event_id, event_id AS seq, action, CAST(number AS INT) AS revision_number, status AS revision_status, reason AS change_reason, supersedes FROM r")
def calendar_revisions(spark: SparkSession, sf: str) -> DataFrame:
    """A state machine over each event's observations."""
    return calendar.revisions(observations(spark, sf)).select("source_id", "source_event_id", "seq", "action", "revision_number", "revision_status", "change_reason", "supersedes")


@query(_REVISIONS + """,
c AS (SELECT event_type, user_id, number, arg_min(status, k) AS status, arg_min(p_at, k) AS at_ms, arg_min(event_id, k) AS made_by, max(us) AS us FROM r GROUP BY 1, 2, 3),
l AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY number DESC) AS rn, greatest(0, (1704153600000 - us // 1000) // 60000) AS age, CASE made_by % 2 WHEN 0 THEN 30 ELSE 60 END AS w, CAST(floor((at_ms - 1704153600000) / 60000) AS BIGINT) AS until FROM c),
v AS (SELECT *, CASE WHEN age <= w THEN 'fresh' WHEN age <= 2 * w THEN 'aging' ELSE 'stale' END AS state FROM l WHERE rn = 1),
p AS (SELECT *, CASE WHEN status <> 'active' THEN 'status ' || status || ' is never high-attention' WHEN until < 0 THEN 'scheduledFor is in the past' WHEN until <= 120 AND state <> 'fresh' THEN 'within 2h but confirmation is ' || state WHEN until > 120 AND state = 'stale' THEN 'confirmation is stale' END AS why FROM v)
SELECT event_type AS source_id, CAST(user_id AS VARCHAR) AS source_event_id, CAST(number AS INT) AS revision_number, status AS revision_status, state AS confirmation_state, until AS minutes_until, why IS NULL AS promotable,
       coalesce(why, 'active + future + evidence + confirmation ok') AS promotion_reason FROM p""")
def current_revisions(spark: SparkSession, sf: str) -> DataFrame:
    _checkpointed(spark)
    folded = cut(calendar.revisions(observations(spark, sf)))
    made, kept = folded.where("action = 'create'"), folded.where("action = 'confirm'")
    views = calendar.confirmed_at(calendar.current(calendar.applied(made, calendar.supersessions(folded))), kept)
    return calendar.promotion(views, now()).select("source_id", "source_event_id", "revision_number", "revision_status", "confirmation_state", "minutes_until", "promotable", "promotion_reason")


@query("""
WITH c AS (SELECT event_id, CASE event_id % 2 WHEN 0 THEN 30 ELSE 60 END AS w, greatest(0, (1704153600000 - epoch_ms(ts)) // 60000) AS age FROM events)
SELECT event_id, CASE WHEN age <= w THEN 'fresh' WHEN age <= 2 * w THEN 'aging' ELSE 'stale' END AS state FROM c""")
def confirmation_state(spark: SparkSession, sf: str) -> DataFrame:
    importance = F.when(F.col("event_id") % 2 == 0, "high").otherwise("medium")
    return table(spark, sf, "events").select("event_id", times.confirmation_state(importance, F.col("ts"), now()).alias("state"))


@query("""
WITH f AS (SELECT event_id, event_id % 5 + 1 AS attempt, event_id % 4 <> 3 AS retryable, ['network_timeout', 'http_status_failure', 'empty_payload'][CAST(event_id % 3 + 1 AS INT)] AS code FROM events),
r AS (SELECT *, CASE WHEN NOT retryable THEN 'failure_not_retryable' WHEN code = 'empty_payload' THEN 'failure_code_not_in_policy' WHEN attempt >= 3 THEN 'max_attempts_reached' ELSE 'scheduled_backoff' END AS retry_reason FROM f)
SELECT event_id, retry_reason, CASE WHEN retry_reason = 'scheduled_backoff' THEN CAST(least(30000, 1000 * pow(2, attempt - 1)) AS BIGINT) END AS delay_ms FROM r""")
def retry_plan(spark: SparkSession, sf: str) -> DataFrame:
    codes = F.array(*map(F.lit, ["network_timeout", "http_status_failure", "empty_payload"]))
    rows = table(spark, sf, "events").select("event_id", (F.col("event_id") % 5 + 1).alias("attempt"), (F.col("event_id") % 4 != 3).alias("retryable"), F.get(codes, (F.col("event_id") % 3).cast("int")).alias("failure_code"))
    return readiness.retry_plan(rows, now()).select("event_id", "retry_reason", "delay_ms")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE CAST(round(((CAST(o_orderkey % 9000 AS DECIMAL(18, 0)) - o_orderkey % 100) * 0.4 + CAST(o_orderkey % 100 AS DECIMAL(18, 0)) * 0.1 + CAST(o_orderkey % 700 AS DECIMAL(18, 0)) * 1.6) / 1000000, 8) AS DOUBLE) END AS usd FROM orders""")
def provider_cost(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    model = F.when(key % 3 == 2, "other").otherwise(summaries.MODELS[0])
    return table(spark, sf, "orders").select("o_orderkey", summaries.cost(model, key % 9000, key % 100, key % 700).cast("double").alias("usd"))


@query("""
WITH d AS (SELECT event_id, user_id, event_type, ts, ts + INTERVAL 120 MINUTE AS until FROM events WHERE event_type = (SELECT min(event_type) FROM events)),
a AS (SELECT user_id, count(*) AS n FROM d WHERE epoch_ms(until) > (SELECT max(epoch_ms(ts)) FROM events) GROUP BY user_id)
SELECT e.event_id, CAST(coalesce(a.n, 0) AS BIGINT) AS dismissals FROM events e LEFT JOIN a ON e.user_id = a.user_id""")
def quiet_window_hold(spark: SparkSession, sf: str) -> DataFrame:
    """Events as candidates of their users; the first event type's rows dismiss their user for two hours."""
    e = table(spark, sf, "events")
    kind, last = e.agg(F.min("event_type"), F.max(F.unix_millis(F.col("ts").cast("timestamp")))).first()
    missing = F.lit(None).cast("string")
    candidates = e.select(F.col("event_id").alias("candidate_id"), missing.alias("item_id"), missing.alias("cluster_id"), missing.alias("calendar_event_id"), F.col("user_id").cast("string").alias("source_id"))
    dismissals = e.where(F.col("event_type") == kind).select(F.lit("source").alias("target_type"), F.col("user_id").cast("string").alias("target_id"), F.timestamp_millis(F.unix_millis(F.col("ts").cast("timestamp")) + 7_200_000).alias("quiet_until"))
    held = whispers.quiet(candidates, dismissals, F.timestamp_millis(F.lit(last)))
    out = candidates.join(held, "candidate_id", "left")
    return out.select(F.col("candidate_id").alias("event_id"), F.coalesce(F.size("quiet_targets"), F.lit(0)).cast("long").alias("dismissals"))


def _candidates(rows: DataFrame) -> DataFrame:
    """Annotated items as candidates of one instant."""
    missing = F.lit(None).cast("string")
    return rows.select(
        F.concat(F.lit("cand-"), "item_id").alias("candidate_id"), "ordinal", F.lit("item").alias("candidate_type"), "item_id", missing.alias("cluster_id"), missing.alias("calendar_event_id"), "source_id",
        F.col("verification_tier").isin("verified", "reported", "scheduled").alias("promotable"), "legal_status", F.col("enabled").alias("source_enabled"), F.lit(False).alias("forbidden_wording"), "verification_tier",
        F.col("verification_tier").isin("verified", "reported", "scheduled").alias("may_promote"), F.lit("source_item_id").alias("evidence_type"), F.col("source_item_id").alias("evidence_value"), "priority_reason", "priority_tier",
        F.col("freshness_state").alias("freshness"), F.concat(F.lit("/audit/"), "item_id").alias("audit_href"), missing.alias("cluster_rule"), F.lit(None).cast("int").alias("member_count"), missing.alias("confirmation_state"),
        F.lit(None).cast("timestamp").alias("scheduled_for"), missing.alias("revision_status"), missing.alias("importance_tier"),
    )


def _whispered(spark: SparkSession, sf: str, rows: DataFrame) -> DataFrame:
    """All events as earlier whispers of the item of their number, as long before now as they lie from it on either side.

    Every other one had the item's present reason; the others, and those of no item, had none.
    """
    missing = F.lit(None).cast("string")
    ms = F.lit(NOW_MS) - F.abs(F.lit(NOW_MS) - F.unix_millis(F.col("ts").cast("timestamp")))
    e = table(spark, sf, "events").select(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("item_id"), missing.alias("cluster_id"), missing.alias("calendar_event_id"), F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("source_id"), F.lit(None).cast("int").alias("member_count"), missing.alias("calendar_signature"), F.timestamp_millis(ms).alias("created_at"))
    return e.join(rows.where(F.col("ordinal") % 2 == 0).select("item_id", "priority_reason"), "item_id", "left")


@query(_SCORES + """,
past AS (SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS item_id, 'src' || (user_id % 20) AS source_id, abs(1704153600000 - epoch_ms(ts)) AS ago FROM events),
every AS (SELECT count(*) FILTER (ago < 900000) AS last_15m, count(*) FILTER (ago < 3600000) AS last_60m, min(ago) AS latest FROM past),
per_source AS (SELECT source_id, count(*) FILTER (ago < 3600000) AS n FROM past GROUP BY source_id),
c AS (
  SELECT s.item_id, s.ordinal, CASE WHEN s.priority_tier IN ('P0', 'P1') THEN 'whisper' ELSE 'glow' END AS level,
    CASE s.verification_tier WHEN 'rumor' THEN 'ineligible[not_promotable,rumor_high_attention]' WHEN 'unverified' THEN 'ineligible[not_promotable,unverified_high_attention]' END AS excluded,
    CASE WHEN s.source_id = 'src1' THEN 'dismissal_quiet_window' WHEN s.ordinal % 2 = 0 AND s.item_id IN (SELECT item_id FROM past) THEN 'repeat_item_no_reason_change' END AS held,
    CASE WHEN e.latest < 300000 THEN 'cooldown_active' WHEN e.last_15m >= 2 THEN 'rate_limit_global_15m' WHEN e.last_60m >= 5 THEN 'rate_limit_global_60m' WHEN coalesce(p.n, 0) >= 2 THEN 'rate_limit_per_source_60m' END AS limited
  FROM scored s CROSS JOIN every e LEFT JOIN per_source p ON s.source_id = p.source_id),
f AS (SELECT min(ordinal) AS first FROM c WHERE coalesce(excluded, held, limited) IS NULL AND level = 'whisper'),
d AS (SELECT item_id, excluded, coalesce(excluded, held) AS blocked, level, CASE WHEN level = 'whisper' THEN CASE WHEN ordinal > first THEN 'cooldown_active' ELSE limited END END AS cap FROM c CROSS JOIN f),
o AS (SELECT item_id, CASE WHEN excluded IS NOT NULL THEN 'suppress' WHEN coalesce(blocked, cap) IS NOT NULL THEN 'hold' ELSE level END AS decision, coalesce(blocked, cap, level || '_threshold_met') AS code FROM d)
SELECT 'cand-' || item_id AS candidate_id, decision, code AS reason_code, decision || ': ' || code || ' (whisper-rule-v1)' AS reason FROM o""")
def whisper_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Annotated items as candidates of one instant, against a history made of all events."""
    _checkpointed(spark)
    rows = cut(_annotated(spark, sf))  # read many times, and its plan is long
    dismissals = spark.createDataFrame([("source", "src1", "2024-01-02 01:00:00")], "target_type string, target_id string, quiet_until string").withColumn("quiet_until", F.col("quiet_until").cast("timestamp"))
    return whispers.decide(_candidates(rows), _whispered(spark, sf, rows), dismissals, now()).select("candidate_id", "decision", "reason_code", "reason")


@query("""
WITH RECURSIVE e AS (SELECT event_id, user_id, event_id % 4 AS kind, epoch_ms(ts) AS ms FROM events),
d AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS k FROM e WHERE kind = 0),
r AS (SELECT user_id, event_id, k, ms + 7200000 AS until, TRUE AS taken FROM d WHERE k = 1 UNION ALL SELECT d.user_id, d.event_id, d.k, CASE WHEN d.ms >= r.until THEN d.ms + 7200000 ELSE r.until END, d.ms >= r.until FROM r JOIN d ON r.user_id = d.user_id AND d.k = r.k + 1)
SELECT e.event_id AS seq, ['dismiss', 'mark_seen', 'open_audit', 'open_evidence'][CAST(kind + 1 AS INT)] AS interaction_type, CAST(e.user_id AS VARCHAR) AS target_id, CASE WHEN kind = 0 AND NOT taken THEN 'ignored' ELSE 'recorded' END AS status,
       CASE WHEN kind > 0 THEN ['', 'mark_seen_recorded', 'open_audit_recorded', 'open_evidence_recorded'][CAST(kind + 1 AS INT)] WHEN taken THEN 'dismissal_recorded' ELSE 'already_dismissed_in_quiet_window' END AS result
FROM e LEFT JOIN r ON e.event_id = r.event_id""")
def interaction_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events as interactions with their users' items."""
    kinds = F.array(*map(F.lit, whispers.INTERACTIONS))
    e = table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("intent_id"), F.get(kinds, (F.col("event_id") % 4).cast("int")).alias("interaction_type"), F.lit("item").alias("target_type"), F.col("user_id").cast("string").alias("target_id"), F.col("ts").cast("timestamp").alias("at"))
    return whispers.record_interactions(e).select("seq", "interaction_type", "target_id", "status", "result")


@query("SELECT 'run-' || c_nationkey AS run_id, CAST(k AS BIGINT) AS sequence FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS k FROM customer) WHERE c_custkey % 97 = 5 OR k = 0")
def audit_chain_verify(spark: SparkSession, sf: str) -> DataFrame:
    """Chains, one a nation, in which some records were changed after the fact, and the first ones' predecessors made up."""
    rows = table(spark, sf, "customer").select(F.concat(F.lit("run-"), F.col("c_nationkey").cast("string")).alias("run_id"), F.lpad(F.col("c_custkey").cast("string"), 12, "0").alias("key"), F.to_json(F.struct("c_name", "c_nationkey")).alias("payload"))
    chain = audit.ledger(audit.contents({"normalized_item": rows}))
    changed = chain.withColumn("payload", F.when(F.col("key").cast("long") % 97 == 5, F.lit("{}")).otherwise(F.col("payload")))
    return audit.broken_links(changed.withColumn("previous_hash", F.when(F.col("sequence") == 0, "x").otherwise(F.col("previous_hash")))).select("run_id", "sequence")


@query(ITEMS_SQL + r""",
s AS (SELECT ordinal, title, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')[1:2] AS claims FROM items WHERE ordinal % 10 <> 3),
w AS (SELECT *, NOT coalesce(length(title) BETWEEN 1 AND 160, FALSE) AS bad_head, len(claims) = 0 OR len(list_filter(claims, lambda x: length(x) NOT BETWEEN 12 AND 500)) > 0 AS bad_claims,
             list_filter(regexp_extract_all(title, '\d+(?:[.,]\d+)*(?:%|bps)?'), lambda x: NOT list_contains(regexp_extract_all(array_to_string(claims, chr(1)), '\d+(?:[.,]\d+)*(?:%|bps)?'), x)) AS loose FROM s),
i AS (SELECT ordinal, CASE WHEN bad_head OR bad_claims THEN array_to_string(list_filter([CASE WHEN bad_claims THEN 'schema@claims' END, CASE WHEN bad_head THEN 'schema@headline' END], lambda x: x IS NOT NULL), ';')
        ELSE array_to_string(list_filter([CASE WHEN regexp_matches(title || ' ' || array_to_string(claims, ' '), '""" + _PHRASES + r"""') THEN 'trade_action@output' END, CASE WHEN len(loose) > 0 THEN 'unsupported_number@headline' END], lambda x: x IS NOT NULL), ';') END AS issues FROM w)
SELECT ordinal AS generation_id, CASE WHEN issues = '' THEN 'accepted' ELSE 'rejected' END AS status, issues FROM i UNION ALL SELECT ordinal, 'skipped', 'ineligible_source_time' FROM items WHERE ordinal % 10 = 3""")
def summary_generation(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a cluster of one: extractive summaries, checked against their source."""
    rows = items(spark, sf).withColumns({"generation_id": F.col("ordinal"), "text": F.col("excerpt"), "eligible": F.col("ordinal") % 10 != 3})
    return summaries.generate(rows.select("generation_id", "item_id", "title", "text", "eligible"), summaries.extractive, rows.select("generation_id", "item_id", "text")).select("generation_id", "status", F.array_join("issues", ";").alias("issues"))


@query(r"""
WITH t AS (SELECT doc_id, string_split(text, chr(10))[1] AS title, text FROM documents),
d AS (SELECT doc_id, replace(replace(replace(replace(replace(replace(title, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', chr(39)), '&#39;', chr(39)), '&nbsp;', ' ') AS title,
             replace(replace(replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', chr(39)), '&#39;', chr(39)), '&nbsp;', ' ') AS text FROM t)
SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS source_item_id, CASE WHEN trim(regexp_replace(title, '[\s\p{Z}]+', ' ', 'g')) = '' THEN 'missing_title' END AS quarantine_reason, FALSE AS duplicate,
       CASE WHEN 1704067200000 + doc_id * 60000 > 1704153600000 THEN 'future' ELSE 'valid' END AS date_state, CAST(length(trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g'))) AS INT) AS chars FROM d""")
def rss_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as RSS payloads by source and hash, scanned again."""
    from ..sources import dataset

    docs = table(spark, sf, "documents").select(F.concat_ws("-", "source", F.pmod(F.col("doc_id"), F.lit(64)).cast("string")).alias("source_id"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("article_id"), F.get(F.split("text", "\\n"), F.lit(0)).alias("title"), "text", F.concat(F.lit("https://news.example.org/"), F.col("doc_id").cast("string")).alias("url"), F.expr("timestamp_millis(1704067200000 + doc_id * 60000)").alias("published_at"))
    found = rss.scanned(dataset.to_rss(docs), now())
    return found.select("source_item_id", "quarantine_reason", "duplicate", F.col("publication.state").alias("date_state"), F.char_length("excerpt").alias("chars"))


@query(_SCORES + """
SELECT item_id, CASE WHEN canonical IS NULL THEN 'Source ref' ELSE 'Evidence' END AS evidence_label, CASE WHEN canonical IS NULL THEN source_item_id ELSE replace(canonical, '//news', '//News') || '/?utm_source=feed&gclid=' || ordinal END AS evidence_value, CASE verification_tier WHEN 'reported' THEN 'low' WHEN 'unverified' THEN 'medium' WHEN 'rumor' THEN 'high' ELSE 'none' END AS caution,
  CASE freshness_state WHEN 'stale' THEN 'source data may be stale' END AS caveat, len(string_split(priority_reason, ';')) AS inputs, cluster_id IS NOT NULL AS uses_cluster, '/newsroom/' || item_id AS href FROM scored""")
def item_display(spark: SparkSession, sf: str) -> DataFrame:
    rows = display.items(_annotated(spark, sf))
    return rows.select("item_id", F.col("evidence.label").alias("evidence_label"), F.col("evidence.value").alias("evidence_value"), F.col("verification.caution").alias("caution"), F.col("freshness.caveat").alias("caveat"), F.size("priority.inputs").cast("long").alias("inputs"), F.col("priority.uses_cluster").alias("uses_cluster"), F.col("audit.href").alias("href"))


@query("""
WITH e AS (SELECT event_id, epoch_ms(ts) AS ms FROM events), m AS (SELECT event_id, CAST(floor((ms - 1704153600000) / 60000) AS BIGINT) AS u, greatest(0, (1704153600000 - ms) // 60000) AS age FROM e)
SELECT event_id, 'event ' || CASE WHEN u < 0 THEN 'started' WHEN u < 60 THEN 'in ' || u || 'm' WHEN u < 1440 THEN 'in ' || CAST(floor(u / 60 + 0.5) AS BIGINT) || 'h' ELSE 'in ' || CAST(floor(u / 1440 + 0.5) AS BIGINT) || 'd' END || ' · ' ||
  CASE WHEN age <= 30 THEN 'confirmed ' || age || 'm ago' WHEN age <= 60 THEN 'confirmation aging' ELSE 'needs confirmation (stale)' END AS line FROM m""")
def scheduled_lines(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    state = times.confirmation_state(F.lit("high"), ts, now())
    return table(spark, sf, "events").select("event_id", times.scheduled_line(F.lit("event"), times.minutes_until(ts, now()), state, times.minutes_since(ts, now())).alias("line"))


@query("""
SELECT event_type AS stage, count(*) AS runs, round(greatest(0.01, sum(value) / max(sum(value)) OVER ()), 6) AS share FROM events GROUP BY event_type""")
def stage_share(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.stage_share(table(spark, sf, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("duration")))


@query("SELECT user_id, CASE WHEN bool_and(event_id % 97 <> 0) THEN sum(event_id % 1000) END AS tokens FROM events GROUP BY user_id")
def token_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Usage of all attempts of a user, null if any attempt has none."""
    used = F.when(F.col("event_id") % 97 != 0, F.col("event_id") % 1000)
    return table(spark, sf, "events").groupBy("user_id").agg(summaries.all_or_null(used).cast("decimal(38,0)").alias("tokens"))


@query("SELECT o_orderpriority AS stream, count(*) AS records, count(DISTINCT o_custkey) AS keys FROM orders GROUP BY o_orderpriority")
def log_summary(spark: SparkSession, sf: str) -> DataFrame:
    return event_log.summary(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("stream_name"), F.col("o_custkey").cast("string").alias("stream_key"))).withColumnRenamed("stream_name", "stream")


@query(r"""
WITH b AS (SELECT item_id, text FROM benchmark)
SELECT doc_id, item_id FROM documents JOIN b ON contains(documents.text, b.text)""")
def evidence_span(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that quote a benchmark item exactly. A shared eight-word run makes it an equi-join; contains() decides."""
    return summaries.quoted(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark").select("item_id", F.col("text").alias("quote")))
