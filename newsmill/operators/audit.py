"""Run artifacts and their hash-chained ledger, for any number of runs at once.

A link's hash covers its record, payload included, and the hash before it, so a chain is made in order: by one pass over
a run's sorted records that holds one hash. Runs are bounded by the datasets they come from; a table of many is walked
run by run, side by side. Checking needs no order: each link meets the one before it by its number.

A run's tables are its records, its document (run_id, semantic_hash), its chain and its manifest. Digests of whole tables
add up the hashes of their rows, so that they need no order either.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import canonical_text, without_keys

MANIFEST = "audit-manifest-v1"
#: What a generation holds beside its meaning.
INCIDENTAL = ["telemetry", "responseId"]
KINDS = ["snapshot", "raw_payload", "normalized_item", "quarantined_item", "dedupe_decision", "cluster", "generation"]
RUN_ID = re.compile(r"[a-zA-Z0-9-]{1,100}")


def link(sequence: int, kind: str, payload: str, previous: str | None) -> str:
    """Hash of a link: canonical JSON of its fields (keys sorted); payload is canonical JSON already."""
    before = "null" if previous is None else f'"{previous}"'
    return hashlib.sha256(f'{{"payload":{payload},"previousHash":{before},"sequence":{sequence},"type":{json.dumps(kind)}}}'.encode()).hexdigest()


def contents(parts: dict[str, DataFrame]) -> DataFrame:
    """(kind, ordinal, key, payload, content) of a run's records, and run_id if the parts have it; each part has key and
    payload (JSON of any form: it is made canonical)."""
    out = None
    for kind, df in parts.items():
        of_run = ["run_id"] if "run_id" in df.columns else []
        rows = df.select(*of_run, "key", canonical_text(F.col("payload")).alias("payload"))
        rows = rows.select(*of_run, F.lit(KINDS.index(kind)).alias("ordinal"), F.lit(kind).alias("kind"), F.col("key").cast("string").alias("key"), "payload", F.sha2("payload", 256).alias("content"))
        out = rows if out is None else out.unionByName(rows)
    return out


def ledger(records: DataFrame, run_id: str = "run") -> DataFrame:
    """(run_id, sequence, kind, key, content, payload, previous_hash, hash) in order of (ordinal, key)."""
    schema = "run_id string, sequence long, kind string, key string, content string, payload string, previous_hash string, hash string"

    def chain(batches):
        run, k, previous = None, 0, None
        for batch in batches:
            out = []
            for name, kind, key, content, payload in batch[["run_id", "kind", "key", "content", "payload"]].itertuples(index=False, name=None):
                if name != run:
                    run, k, previous = name, 0, None
                own = link(k, kind, payload, previous)
                out.append((name, k, kind, key, content, payload, previous, own))
                k, previous = k + 1, own
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    rows = records.withColumn("run_id", F.lit(run_id)) if "run_id" not in records.columns else records
    rows = rows.select("run_id", "ordinal", "kind", "key", "content", "payload").repartition("run_id").sortWithinPartitions("run_id", "ordinal", "key", "content")
    return rows.mapInPandas(chain, schema)


def broken_links(chain: DataFrame) -> DataFrame:
    """Links that stand twice, or whose predecessor, own hash or payload's hash is wrong; no rows means an intact chain."""
    quote = lambda c: F.when(F.col(c).isNull(), "null").otherwise(F.concat(F.lit('"'), c, F.lit('"')))
    text = F.concat(F.lit('{"payload":'), F.col("payload"), F.lit(',"previousHash":'), quote("previous_hash"), F.lit(',"sequence":'), F.col("sequence").cast("string"), F.lit(',"type":'), quote("kind"), F.lit("}"))
    before = chain.groupBy("run_id", (F.col("sequence") + 1).alias("sequence")).agg(F.min("hash").alias("before"), F.count("*").alias("times"))
    rows = chain.withColumn("own", F.sha2(text, 256)).join(before, ["run_id", "sequence"], "left")
    wrong = (F.sha2("payload", 256) != F.col("content")) | (F.col("own") != F.col("hash")) | ~F.col("previous_hash").eqNullSafe(F.col("before")) | (F.coalesce("times", F.lit(1)) > 1) | (F.col("times").isNull() != (F.col("sequence") == 0))
    return rows.where(wrong).select("run_id", "sequence")


def table_digest(*columns: str) -> Column:
    """Digest of a group's rows in any order: the sums of each 32 bits of their SHA-256, hashed with their number."""
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    limbs = [F.sum(F.conv(F.substring(row, 8 * k + 1, 8), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(8)]
    return F.sha2(F.concat_ws(",", F.count("*").cast("string"), *limbs), 256)


def semantic_hashes(records: DataFrame) -> DataFrame:
    """(run_id, semantic_hash): identity of what a run found, without what its generations cost and who answered."""
    meant = F.when(F.col("kind") == "generation", canonical_text(without_keys(F.col("payload"), INCIDENTAL))).otherwise(F.col("payload"))
    return records.withColumn("meant", meant).groupBy("run_id").agg(table_digest("ordinal", "key", "meant").alias("semantic_hash"))


def manifest(chain: DataFrame, records: DataFrame) -> DataFrame:
    """(run_id, schema_version, named, event_count, final_hash, ledger_digest, records_digest) of each run."""
    links = chain.groupBy("run_id").agg(F.count("*").alias("event_count"), F.max_by("hash", "sequence").alias("final_hash"), table_digest(*chain.columns).alias("ledger_digest"))
    told = records.groupBy("run_id").agg(table_digest("ordinal", "kind", "key", "payload").alias("records_digest"))
    return links.join(told, "run_id").select("run_id", F.lit(MANIFEST).alias("schema_version"), F.col("run_id").alias("named"), "event_count", "final_hash", "ledger_digest", "records_digest")


@dataclass
class Runs:
    """Tables of runs: records (contents() and run_id), documents, chain, manifest."""

    records: DataFrame
    documents: DataFrame
    chain: DataFrame
    manifest: DataFrame


def sealed(records: DataFrame) -> Runs:
    """Runs of records with run_id."""
    chain = ledger(records)
    return Runs(records, semantic_hashes(records), chain, manifest(chain, records))


def problems(runs: Runs) -> DataFrame:
    """(run_id, problem) of every run that any table names: what is wrong first, in the order in which a reader finds out, or null.

    The ledger is made again from the records; after the earlier checks, chains that end in one hash are the same.
    """
    now = manifest(runs.chain, runs.records).select("run_id", F.struct("event_count", "final_hash").alias("end"), F.struct("ledger_digest", "records_digest").alias("files"))
    then = runs.manifest.select("run_id", "schema_version", "named", F.struct("event_count", "final_hash").alias("known_end"), F.struct("ledger_digest", "records_digest").alias("known_files"))
    meant = semantic_hashes(runs.records).withColumnRenamed("semantic_hash", "meant")
    broken = broken_links(runs.chain).select("run_id").distinct().withColumn("broken", F.lit(True))
    again = ledger(runs.records).groupBy("run_id").agg(F.max_by("hash", "sequence").alias("again"))
    rows = then.join(now, "run_id", "full").join(runs.documents, "run_id", "full")
    for other in (meant, broken, again):
        rows = rows.join(other, "run_id", "left")
    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    return rows.select(
        "run_id",
        F.when(differs("files", "known_files"), "audit file integrity mismatch").when(differs("meant", "semantic_hash"), "run semantic identity mismatch")
        .when(~F.col("schema_version").eqNullSafe(F.lit(MANIFEST)) | differs("named", "run_id"), "manifest identity mismatch").when(F.col("broken"), "audit chain is broken")
        .when(differs("end", "known_end"), "audit ledger is truncated").when(differs("again", "end.final_hash"), "the ledger doesn't describe the run").alias("problem"),
    )


def write_run(root: str, run_id: str, records: DataFrame) -> str:
    """The tables of a run below root/run_id, which must be new."""
    if not RUN_ID.fullmatch(run_id):
        raise ValueError("invalid run id")
    folder, spark = f"{root}/{run_id}", records.sparkSession
    records.withColumn("run_id", F.lit(run_id)).write.mode("errorifexists").json(f"{folder}/records")
    records = _records(spark, folder)
    ledger(records).write.mode("errorifexists").parquet(f"{folder}/ledger")
    semantic_hashes(records).write.mode("errorifexists").json(f"{folder}/run")
    manifest(spark.read.parquet(f"{folder}/ledger"), records).write.mode("errorifexists").json(f"{folder}/manifest")
    return folder


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("run_id string, ordinal int, kind string, key string, payload string, content string").json(f"{folder}/records")


def read_run(spark: SparkSession, folder: str) -> Runs:
    schema = "run_id string, schema_version string, named string, event_count long, final_hash string, ledger_digest string, records_digest string"
    return Runs(_records(spark, folder), spark.read.schema("run_id string, semantic_hash string").json(f"{folder}/run"), spark.read.parquet(f"{folder}/ledger"), spark.read.schema(schema).json(f"{folder}/manifest"))


def verify_run(spark: SparkSession, folder: str) -> int:
    """The number of links of an intact run; an error names what is wrong otherwise."""
    runs = read_run(spark, folder)
    for problem in [r["problem"] for r in problems(runs).collect()]:
        if problem:
            raise ValueError(problem)
    return runs.chain.count()
