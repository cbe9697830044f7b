"""Operator 4 [native]: benchmark decontamination by winnowing (Schleimer, Wilkerson and Aiken, 2003).

Of the hashes of all GRAM-word grams, the smallest in every SPAN consecutive ones is kept, in documents and benchmark
items alike. Two texts that share GRAM + SPAN - 1 words in a row, which is WINDOW, then share a kept hash. The kept
hashes are joined; around each hit the windows of WINDOW words that hold it are compared word by word, which extends
hits to whole shared passages and drops chance hits. Items shorter than a window are compared whole, at every position.

Fingerprints live inside the row of their document until the join, which is a broadcast of the benchmark's fingerprints:
no text is shuffled, only hits are. A benchmark of more than BLOCK_ITEMS items is taken in blocks of so many.

Defined cases: null texts have no words; texts and items without words hit nothing; repeated documents each get their
row; repeated items count once by item_id; null item_ids are not counted as items; an empty benchmark or table is fine;
find() replaces columns of its own result's names and keeps all others.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, spare, table

WINDOW, GRAM = 10, 5
SPAN = WINDOW - GRAM + 1
#: Items whose fingerprints and windows are broadcast at once, and the words that the items of a block have at most.
BLOCK_ITEMS, BLOCK_WORDS = 20_000, 2_000_000

_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), _BREAK, -1), "")


def grams_of(words: Column) -> Column:
    """Hash of the words i to i + GRAM - 1, for each i."""
    at = lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(GRAM)))
    return F.when(F.size(words) >= GRAM, F.transform(F.sequence(F.lit(0), F.size(words) - GRAM), at)).otherwise(F.array().cast("array<bigint>"))


def winnowed(grams: Column) -> Column:
    """Where the smallest hashes of SPAN consecutive ones stand, ties included: (at, print)."""
    least = lambda i: F.least(*(F.get(grams, i + k) for k in range(SPAN)))
    is_least = lambda low, i: reduce(or_, (F.get(low, i - k) == F.get(grams, i) for k in range(SPAN)))  # noqa: E731  null beyond an end
    kept = lambda low: F.filter(F.sequence(F.lit(0), F.size(grams) - 1), lambda i: is_least(low, i))
    at = let(F.transform(F.sequence(F.lit(0), F.size(grams) - SPAN), least), kept)
    none = F.array().cast("array<struct<at:int,print:bigint>>")
    return F.when(F.size(grams) >= SPAN, F.transform(at, lambda i: F.struct(i.alias("at"), F.get(grams, i).alias("print")))).otherwise(none)


def fingerprinted(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, words and one row for each kept hash (print) and its place (at)."""
    facts = lambda w: F.struct(w.alias("words"), let(grams_of(w), winnowed).alias("prints"))
    rows = df.select(*keys, let(words_of(F.col(text)), facts).alias("of"))
    rows = rows.select(*keys, F.col("of.words").alias("words"), F.explode("of.prints").alias("kept"))
    return rows.select(*keys, "words", F.col("kept.at").alias("at"), F.col("kept.print").alias("print"))


def window_text(words: Column, start: Column, size: int) -> Column:
    """Words start to start + size - 1 as one string; a word holds no space."""
    return F.array_join(F.slice(words, start + 1, size), " ")


def _hits_of_block(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """key, start, size, item_id of every window of a block's items in docs (key, text)."""
    words = items.select("item_id", words_of(F.col("text")).alias("words"))
    long = words.where(F.size("words") >= window)
    windows = long.select("item_id", "words", F.explode(F.sequence(F.lit(0), F.size("words") - window)).alias("start"))
    windows = windows.select(window_text(F.col("words"), F.col("start"), window).alias("window"), "item_id").distinct()
    prints = fingerprinted(items, ["item_id"]).select("print").distinct()
    met = fingerprinted(docs, ["key"]).join(F.broadcast(prints), "print")
    starts = F.sequence(F.greatest(F.col("at") - SPAN + 1, F.lit(0)), F.least(F.col("at"), F.size("words") - window))
    held = met.select("key", "words", F.explode(starts).alias("start")).select("key", "start", window_text(F.col("words"), F.col("start"), window).alias("window"))
    hits = held.join(F.broadcast(windows), "window").select("key", "start", F.lit(window).alias("size"), "item_id")
    short = words.where((F.size("words") > 0) & (F.size("words") < window))
    sizes = sorted(r[0] for r in short.select(F.size("words")).distinct().collect())  # below window, so few
    if sizes:
        whole = short.select(F.array_join("words", " ").alias("window"), "item_id").distinct()
        places = lambda size: F.when(F.size("words") >= size, F.transform(F.sequence(F.lit(0), F.size("words") - size), lambda i: F.struct(i.alias("start"), size.alias("size")))).otherwise(F.array().cast("array<struct<start:int,size:int>>"))
        at = docs.select("key", words_of(F.col("text")).alias("words")).where(F.size("words") >= sizes[0])
        at = at.select("key", "words", F.explode(F.flatten(F.array(*(places(F.lit(n)) for n in sizes)))).alias("at"))
        at = at.select("key", "at.start", "at.size", F.array_join(F.slice("words", F.col("at.start") + 1, F.col("at.size")), " ").alias("window"))
        hits = hits.unionByName(at.join(F.broadcast(whole), "window").select("key", "start", "size", "item_id"))
    return hits


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """key, n_hit, items of the documents that any item hits; the benchmark is taken in blocks of a checked size."""
    n_items, n_words = items.agg(F.count("*"), F.sum(F.regexp_count("text", F.lit(_WORD_ANY_CASE)))).first()
    blocks = max(1, -(-n_items // BLOCK_ITEMS), -(-(n_words or 0) // BLOCK_WORDS))
    found = None
    for b in range(blocks):
        block = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        part = _hits_of_block(docs, block, window)
        found = part if found is None else found.unionByName(part)
    by_doc = found.groupBy("key").agg(F.collect_set(F.struct("start", "size")).alias("runs"), F.collect_set("item_id").alias("items"))
    covered = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["start"] + r["size"] - 1))))
    return by_doc.select("key", F.size(covered).cast("long").alias("n_hit"), "items")


def _key() -> Column:
    return F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.xxhash64("text").alias("h"))


def find(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs and n_words, n_hit, items (ids), contaminated (in place of columns of these names); a row for each of docs."""
    found = hits(docs.select(_key().alias("key"), "text"), items.select("item_id", "text"))
    own, key, n_hit, ids = spare(docs, "own_key", "hit_key", "hits", "ids")
    found = found.select(F.col("key").alias(key), F.col("n_hit").alias(n_hit), F.col("items").alias(ids))
    n_words = F.coalesce(F.regexp_count("text", F.lit(_WORD_ANY_CASE)), F.lit(0)).cast("long")  # before the join, which then needs no text
    rows = docs.drop("n_words", "n_hit", "items", "contaminated").withColumns({"n_words": n_words, own: _key()})
    out = rows.join(found, F.col(own) == F.col(key), "left")
    out = out.withColumn("n_hit", F.coalesce(n_hit, F.lit(0)).cast("long")).withColumn("items", F.col(ids)).withColumn("contaminated", F.col("n_hit") > 0)
    return out.drop(own, key, n_hit, ids)


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that no item hits, with all their columns."""
    found = hits(docs.select(_key().alias("key"), "text"), items.select("item_id", "text"))
    own, key = spare(docs, "own_key", "hit_key")
    return docs.withColumn(own, _key()).join(found.select(F.col("key").alias(key)), F.col(own) == F.col(key), "left_anti").drop(own)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the whole benchmark."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = find(docs, table(spark, sf_dir, "benchmark"))
    ids = F.coalesce(F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ","), F.lit(""))
    return out.select("doc_id", "n_words", "n_hit", F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), "contaminated")


OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS size, array_to_string(words[i:i + least(10, len(words)) - 1], ' ') AS win
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 8, 2))) AS i FROM b WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT doc_id, i, size, array_to_string(words[i:i + size - 1], ' ') AS win
  FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM w JOIN sizes ON len(words) >= size)),
h AS (SELECT doc_id, i, dw.size, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM h) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN pos ON w.doc_id = pos.doc_id LEFT JOIN its ON w.doc_id = its.doc_id
"""
