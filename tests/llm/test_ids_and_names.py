"""Ids keep every digit beside null ones, and helper columns meet no column of the input."""

import random

import pytest
from pyspark.sql import functions as F

from newsmill.llm import common, decontamination, packing, queries, sharding, stages, url_filters, warc
from newsmill.llm.wordcache import vocabulary

IDS = [(1 << 60) + 1, None, (1 << 60) + 3, 7]
ITEM = "one two three four five six seven eight nine ten eleven"


def text(k):
    rng = random.Random(k)
    return " ".join(f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice('aeiou')}" for _ in range(60)) + f" nr{k}"


def ids_of(df, column="doc_id"):
    return sorted({r[0] for r in df.select(column).collect()}, key=str)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """One file and so one batch: longs beside a null."""
    top = str(tmp_path_factory.mktemp("ids"))
    rows = [(i, text(k), [1.0 * k, 2.0, 1.0 * k * k]) for k, i in enumerate(IDS)]
    spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").coalesce(1).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, v) for i, _, v in rows], "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{top}/embeddings.parquet")
    html = "x" * 200
    pages = [(i, "http://a.com/", html if k != 1 else "short") for k, i in enumerate(IDS)] + [((1 << 60) + 5, "http://b.com/", "y" * 100), ((1 << 60) + 7, None, "y" * 100)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{top}/pages.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top


@pytest.mark.parametrize("name", [q for q in queries.QUERIES if q not in ("op2_url_filters", "op10_warc", "op11_whitening")])
def test_ids_of_documents(spark, folder, name):
    assert ids_of(queries.QUERIES[name](spark, folder)) == sorted(IDS, key=str)


def test_ids_of_pages_and_vectors(spark, folder):
    assert ids_of(queries.QUERIES["op11_whitening"](spark, folder), "vec_id") == sorted(IDS, key=str)
    got = {r.page_id: (r.record_type, r.refers_to) for r in queries.QUERIES["op10_warc"](spark, folder).collect()}
    low, high = 1 << 60, (1 << 60) + 5
    assert got == {None: ("response", None), 7: ("response", None), low + 1: ("revisit", 7), low + 3: ("revisit", 7), high: ("response", None), high + 2: ("revisit", high)}


def test_ids_of_components(spark, folder):
    got = {r.doc_id: r.component_id for r in queries.QUERIES["op3_ngram_join"](spark, folder).collect()}
    assert got == {i: i for i in IDS}


def test_slots_beside_null_ids(spark):
    rows = spark.createDataFrame([(i, 0, 0, 1, 9) for i in [None, *((1 << 60) + k for k in range(300))]], "doc_id long, shard int, grown_shard int, text_crc32 long, size long")
    assert sorted(r.slot for r in sharding.numbered(rows.coalesce(1), 20).collect()) == list(range(301))


def test_stages_lose_no_row(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for stage in (stages.quality, stages.near_duplicates, stages.decontaminated, stages.secrets, stages.packed):
        assert ids_of(stage(spark, docs, folder)) == sorted(IDS, key=str), stage.__name__


HELPERS = ["_hash", "_id", "_of", "_same", "_key", "_hit_key", "_n_hit", "_items", "own_hash", "key", "hash", "same", "own_key", "hit_key", "hits", "ids", "first", "best", "page", "digest", "x", "content", "span", "row"]


def test_helper_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", *(F.concat(F.lit(h), F.col("doc_id").cast("string")).alias(h) for h in HELPERS))
    want = sorted(map(tuple, docs.collect()), key=str)
    for stage in (stages.quality, stages.near_duplicates, stages.decontaminated, stages.secrets):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and sorted(map(tuple, out.collect()), key=str) == want, stage.__name__
    assert stages.packed(spark, docs, folder).count() == 4
    found = decontamination.find(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))
    assert sorted(map(tuple, found.select(*docs.columns).collect()), key=str) == want


def test_helper_columns_of_pages(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html", *(F.lit(h).alias(h) for h in HELPERS))
    out = warc.decide(pages)
    assert out.columns == [*pages.columns, "payload_bytes", "payload_digest", "record_type", "refers_to"] and out.where(" and ".join(f"`{h}` = '{h}'" for h in HELPERS)).count() == 6
    for most in (url_filters.INLINE_RULES, 0):
        out = url_filters.judge(pages, url_filters.RULES, inline_rules=most)
        assert out.columns == [*pages.columns, "host", "path", "rule", "verdict"] and out.where("best = 'best' and first = 'first'").count() == 6


def test_spare_names(spark):
    assert common.spare(spark.createDataFrame([(1, 2, 3)], "A int, _a int, b int"), "a", "b", "c", "C") == ["__a", "_b", "c", "_C"]


def test_one_row_two_hundred_thousand_times(spark):
    """Its copies are dealt to several tasks, by sharding and by packing."""
    hot = spark.range(200_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("one two").alias("text"))
    rows = hot.select("doc_id", F.lit(3).alias("shard"), F.lit(3).alias("grown_shard"), F.lit(1).cast("long").alias("text_crc32"), F.lit(9).cast("long").alias("size"))
    found = sharding.numbered(rows).withColumn("task", F.spark_partition_id())
    assert found.agg(F.countDistinct("slot"), F.min("slot"), F.max("slot")).first()[:] == (200_000, 0, 199_999)
    packed = packing.pack(hot)
    assert packed.agg(F.count("*"), F.countDistinct("sequence_id", "offset")).first()[:] == (200_000, 200_000)
    lengths = packing.pieces(hot.limit(1000).repartition(3), vocabulary(packing.TOKENIZER))
    numbers = packing.numbered(lengths, {3: 1000}, 50)
    assert sorted(r.number for r in numbers.collect()) == list(range(1000))
