"""Operator 9: token counts with a digest cache.

The cache is a table (content digest, tokenizer digest, n_tokens) in a folder. Documents meet it by both digests; only
the distinct contents that it lacks are encoded, once each, and appended. The digest is of a normal form of the content,
which has to keep the count: it makes null the empty text and leaves every other character, since a byte-level tokenizer
counts each byte (folding case, white space or composed characters changes counts, as the tests show). So neither a copy nor a later run encodes a
text again, and another tokenizer version never meets the counts of this one.

The texts of the misses are grouped by digest, with copies dropped inside each input task before anything is shuffled;
the counts come back by a join on the digest, which adaptive execution splits where one text holds many of the rows.

Defined cases: null text counts as empty (0 bytes, 0 tokens); special strings inside texts are what the tokenizers
library makes of them by default; repeated rows stay; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, table
from .wordcache import ChunkCounts, of_worker, slices, vocabulary

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
#: The query's first append takes the texts of one hash in so many; the second all others.
FIRST_PART = 16
CACHE_SCHEMA = "digest binary, tokenizer binary, n_tokens long"


def version(path: str) -> bytes:
    """Digest of the tokenizer's file: any change of it is another version."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).digest()


def normal_form(text: Column) -> Column:
    """The content that is digested: texts of one form have one number of tokens."""
    return F.coalesce(text, F.lit(""))


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(normal_form(text), 256))


def _encoder(path: str):
    def encode(batches):
        counts = of_worker(ChunkCounts, path)
        for batch in batches:
            texts = batch["text"].tolist()
            n = [x for a, b in slices(texts) for x in counts.texts(texts[a:b])]
            yield pd.DataFrame({"digest": batch["digest"], "n_tokens": n})

    return encode


def cached(spark: SparkSession, cache: str, tokenizer: bytes) -> DataFrame | None:
    """What the cache holds for this tokenizer version; None before anything is appended."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == F.lit(tokenizer)).select("digest", "n_tokens")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def fill(docs: DataFrame, cache: str, path: str) -> None:
    """Encodes the distinct texts that the cache lacks and appends their counts."""
    tokenizer = version(path)
    rows = docs.select(normal_form(F.col("text")).alias("text"), digest_of(F.col("text")).alias("digest"))
    have = cached(docs.sparkSession, cache, tokenizer)
    if have is not None:
        rows = rows.join(have, "digest", "left_anti")
    misses = rows.groupBy("digest").agg(F.first("text").alias("text"))
    found = misses.mapInPandas(_encoder(path), "digest binary, n_tokens long")
    found.select("digest", F.lit(tokenizer).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)


def count_tokens(docs: DataFrame, cache: str, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs (doc_id, text)."""
    path = path or vocabulary(TOKENIZER)
    fill(docs, cache, path)
    counts = cached(docs.sparkSession, cache, version(path)).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    rows = docs.select("doc_id", n_bytes, digest_of(F.col("text")).alias("digest"))
    return rows.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by byte_bpe_50k. The cache is new for each call and filled in two appends: the texts of one hash in
    FIRST_PART, as an earlier delivery would have, then all that the whole table still lacks."""
    docs, cache, path = table(spark, sf_dir, "documents").select("doc_id", "text"), new_folder(spark, "token-cache"), vocabulary(TOKENIZER)
    fill(docs.where(F.pmod(F.xxhash64("text"), F.lit(FIRST_PART)) == 0), cache, path)
    return count_tokens(docs, cache, path)
