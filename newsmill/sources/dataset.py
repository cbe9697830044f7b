"""News datasets: one JSON document of sources and articles, strictly checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import xml_escape

MAX_BYTES, MAX_SOURCES, MAX_ARTICLES = 1_000_000, 32, 128
SCHEMA = (
    "schemaVersion string, id string, description string, license string, synthetic boolean, observedAt string,"
    "sources array<struct<id:string,name:string,tier:string,legalStatus:string,enabled:boolean>>,"
    "articles array<struct<id:string,sourceId:string,title:string,text:string,url:string,publishedAt:string,category:string>>"
)
_ALLOWED = {
    "$": ["schemaVersion", "id", "description", "license", "synthetic", "observedAt", "sources", "articles"],
    "sources": ["id", "name", "tier", "legalStatus", "enabled"],
    "articles": ["id", "sourceId", "title", "text", "url", "publishedAt", "category"],
}


def faults(documents: DataFrame) -> DataFrame:
    """(path, fault) of every rule that a dataset document (column json) breaks; one rejects the whole document."""
    doc = documents.select("json", F.from_json("json", SCHEMA).alias("d"))
    unknown = lambda j, part: F.array_except(F.json_object_keys(j), F.array(*map(F.lit, _ALLOWED[part])))
    keys = lambda j: unknown(j, "$")
    none = F.array().cast("array<string>")

    def strange(part: str) -> Column:
        """Whether an entry of the part has a key that the schema doesn't know."""
        entries = F.coalesce(F.from_json(F.get_json_object("json", f"$.{part}"), "array<string>"), none)
        return F.exists(entries, lambda e: F.size(unknown(e, part)) > 0)

    ident = lambda c, n: ~F.coalesce(c.rlike(f"^[a-z0-9-]{{1,{n}}}$"), F.lit(False))
    size = lambda c, n: ~F.coalesce(F.char_length(c).between(1, n), F.lit(False))
    instant = lambda c: c.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d(:\d\d(\.\d+)?)?Z$")
    whole = F.array_compact(F.array(
        F.when(F.octet_length("json") > MAX_BYTES, "size"), F.when(F.col("d.schemaVersion").isNull() | (F.col("d.schemaVersion") != "dataset-v1"), "schemaVersion"),
        F.when(F.size(keys(F.col("json"))) > 0, "unknown_key"), F.when(ident(F.col("d.id"), 80), "id"), F.when(~F.coalesce(instant(F.col("d.observedAt")), F.lit(False)), "observedAt"),
        F.when(F.coalesce(F.size("d.sources"), F.lit(0)) < 1, "no_sources"), F.when(F.coalesce(F.size("d.articles"), F.lit(0)) < 1, "no_articles"),
        F.when(F.size("d.sources") > MAX_SOURCES, "too_many_sources"), F.when(F.size("d.articles") > MAX_ARTICLES, "too_many_articles"),
        *(F.when(strange(part), f"unknown_key_in_{part}") for part in ("sources", "articles")),
    ))
    top = doc.select(F.lit("$").alias("path"), F.explode(whole).alias("fault"))
    source = doc.select(F.explode("d.sources").alias("s"))
    of_source = source.select(F.concat(F.lit("sources."), F.coalesce("s.id", F.lit("?"))).alias("path"), F.explode(F.array_compact(F.array(F.when(ident(F.col("s.id"), 64), "id"), F.when(size(F.col("s.name"), 240), "name"), F.when(F.col("s.enabled").isNull(), "enabled")))).alias("fault"))
    article = doc.select(F.explode("d.articles").alias("a"))
    wrong = F.array_compact(F.array(
        F.when(ident(F.col("a.id"), 80), "id"), F.when(size(F.col("a.title"), 240), "title"), F.when(size(F.col("a.text"), 6000), "text"),
        F.when(~F.coalesce(F.col("a.url").rlike("^https://[^/\\s]+"), F.lit(False)), "url"), F.when(F.col("a.publishedAt").isNotNull() & ~instant(F.col("a.publishedAt")), "publishedAt"),
    ))
    of_article = article.select(F.concat(F.lit("articles."), F.coalesce("a.id", F.lit("?"))).alias("path"), F.explode(wrong).alias("fault"))
    twice = source.groupBy("s.id").count().where("count > 1").select(F.concat(F.lit("sources."), "id").alias("path"), F.lit("duplicate").alias("fault"))
    again = article.groupBy("a.sourceId", "a.id").count().where("count > 1").select(F.concat(F.lit("articles."), "id").alias("path"), F.lit("duplicate").alias("fault"))
    orphan = article.join(source.select(F.col("s.id").alias("sid")), F.col("a.sourceId") == F.col("sid"), "left_anti").select(F.concat(F.lit("articles."), "a.id").alias("path"), F.lit("unknown_source").alias("fault"))
    out = top
    for part in (of_source, of_article, twice, again, orphan):
        out = out.unionByName(part)
    return out


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(sources, articles) of a dataset document; any fault is an error."""
    documents = spark.read.option("wholetext", True).text(path).select(F.col("value").alias("json"))
    return parsed(documents)


def parsed(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    bad = [f"{r.path}: {r.fault}" for r in faults(documents).orderBy("path", "fault").limit(20).collect()]
    if bad:
        raise ValueError("; ".join(bad))
    doc = documents.select(F.from_json("json", SCHEMA).alias("d"))
    source = doc.select(F.inline("d.sources")).select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("tier").alias("source_tier"), F.col("legalStatus").alias("legal_status"), "enabled", F.lit("rss_fixture").alias("source_type"))
    article = doc.select(F.col("d.observedAt").cast("timestamp").alias("observed_at"), F.inline("d.articles"))
    article = article.select("observed_at", F.col("id").alias("article_id"), F.col("sourceId").alias("source_id"), "title", "text", "url", F.col("publishedAt").cast("timestamp").alias("published_at"), "category")
    return source, article


def to_rss(articles: DataFrame) -> DataFrame:
    """(source_id, raw_payload_id, payload_text): one RSS text a source, items by article id; times lose milliseconds."""
    date = F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    body = F.concat(tag("guid", xml_escape(F.col("article_id"))), tag("title", xml_escape(F.col("title"))), tag("description", xml_escape(F.col("text"))), tag("link", xml_escape(F.col("url"))), F.when(F.col("published_at").isNotNull(), tag("pubDate", date)).otherwise(""))
    rows = articles.select("source_id", F.struct("article_id", tag("item", body).alias("xml")).alias("i"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("i")), lambda i: i["xml"]), "")
    payload = F.concat(F.lit("<rss><channel>"), F.col("text"), F.lit("</channel></rss>"))
    return rows.groupBy("source_id").agg(text.alias("text")).select("source_id", F.concat(F.lit("raw-"), "source_id").alias("raw_payload_id"), payload.alias("payload_text"))
