"""Operator 10: WARC archives, and a normaliser for monolithic gzip ones.

`write` makes archives that are one gzip stream each, as careless crawlers do: nothing inside can be reached without
inflating all before it. `normalise` inflates such a stream once, rewrites every record as a gzip member of its own and
writes a sidecar index (page, offset, length). `read` goes by the index: Spark splits its lines, and a task inflates
just its records.

Every archive is written by one task under a name of its partition, first beside its place and then moved there; a task
that runs again after a lost executor writes the same bytes. Files go through pyarrow's file systems, so the shared
folder may be on any store that those reach.

Of records with equal payloads of at least MIN_REVISIT bytes, the one with the smallest page_id is a response and the
others revisit it. The hot payload's rows meet as (page_id, digest) only, in a join that adaptive execution splits.
Up to FEW_REVISITS revisits are broadcast to the tasks that read the pages; more meet the pages in a shuffled join.

Defined cases: null html is an empty payload; null urls leave out their header; equal rows (page_id and payload) are
all responses if they come first; null page_ids come first in order; an empty table gives an empty result; extra
columns stay in what is decided, those named like an added one are replaced, and archives leave both out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, spare, table, write_and_read

MIN_REVISIT = 100
FEW_REVISITS = 200_000
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_EPOCH = "1970-01-01T00:00:00Z"
INDEX = "archive string, page_id long, offset long, length long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _urn(page_id) -> str:
    return f"<urn:newsmill:page:{'' if page_id is None else page_id}>"


def _page(urn: str):
    number = urn.strip("<>").rpartition(":")[2]
    return int(number) if number else None


def record(page_id, url, payload: bytes, digest: str, revisit_of=None, revisit: bool = False) -> bytes:
    """One WARC record; a revisit has the HTTP head alone."""
    head = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": _urn(page_id), "WARC-Date": _EPOCH}
    if url:
        head["WARC-Target-URI"] = url.replace("\r", "%0D").replace("\n", "%0A")
    head |= {"WARC-Payload-Digest": f"sha256:{digest}", "WARC-Payload-Length": str(len(payload))}
    if revisit:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": _urn(revisit_of)}
    block = _HTTP + (b"" if revisit else payload)
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record: {first[:40]!r}")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def records_of(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(head, whole record) of a plain WARC stream that comes in chunks; holds one record at a time."""
    held = b""
    chunks = iter(chunks)
    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            more = next(chunks, None)
            if more is None:
                if held:
                    raise ValueError("the archive ends inside a record")
                return
            held += more
        head = parse_head(held[:end])
        size = end + 4 + int(head["content-length"]) + 4
        parts, have = [held], len(held)
        while have < size:
            more = next(chunks, None)
            if more is None:
                raise ValueError("the archive ends inside a record")
            parts.append(more)
            have += len(more)
        held = b"".join(parts)
        yield head, held[:size]
        held = held[size:]


def inflated(stream, read_bytes: int = 1 << 20) -> Iterator[bytes]:
    """The content of a gzip file in one pass, of one member or of several."""
    gz = zlib.decompressobj(31)
    while data := stream.read(read_bytes):
        while data:
            if out := gz.decompress(data):
                yield out
            data = gz.unused_data
            if gz.eof:
                gz = zlib.decompressobj(31)
            else:
                data = b""
    if out := gz.flush():
        yield out


def member(data: bytes) -> bytes:
    """A gzip member without a time stamp: equal data give equal bytes."""
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress(data) + gz.flush()


def decide(pages: DataFrame) -> DataFrame:
    """pages and payload_bytes, payload_digest, record_type, refers_to."""
    text = F.coalesce("html", F.lit(""))
    page, digest, first_page = spare(pages, "page", "digest", "first")
    rows = pages.drop("record_type", "refers_to").withColumns({"payload_bytes": F.octet_length(text).cast("long"), "payload_digest": F.sha2(text, 256)})
    ids = rows.groupBy("page_id", "payload_digest").agg(F.max("payload_bytes").alias("n"))
    first = ids.where(F.col("n") >= MIN_REVISIT).groupBy("payload_digest").agg(F.min_by("page_id", F.struct(F.col("page_id").isNotNull(), "page_id")).alias("first"), F.count("*").alias("pages")).where("pages > 1")
    later = ids.join(first, "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias(page), F.col("payload_digest").alias(digest), F.col("first").alias(first_page))
    later = write_and_read(later, "revisits")
    if later.count() <= FEW_REVISITS:
        later = F.broadcast(later)
    same = F.col("page_id").eqNullSafe(F.col(page)) & (F.col("payload_digest") == F.col(digest))
    out = rows.join(later, same, "left")
    return out.withColumns({"record_type": F.when(F.col(digest).isNotNull(), "revisit").otherwise("response"), "refers_to": F.col(first_page)}).drop(page, digest, first_page)


def write(pages: DataFrame, folder: str) -> list[str]:
    """Monolithic archives of decided pages (page_id, url, html, ...) below folder, one a task; their URIs."""

    def archive(batches):
        files, top = _files(folder)
        context = TaskContext.get()
        name, own = f"part-{context.partitionId():06d}.warc.gz", f".attempt-{context.taskAttemptId()}"
        files.create_dir(top, recursive=True)
        gz, n = zlib.compressobj(6, zlib.DEFLATED, 31), 0
        out = None
        for batch in batches:
            for r in batch.itertuples():
                out = out or files.open_output_stream(f"{top}/{name}{own}", compression=None)
                out.write(gz.compress(record(r.page_id, r.url, (r.html or "").encode("utf-8", "surrogatepass"), r.payload_digest, r.refers_to, r.record_type == "revisit")))
                n += 1
        if out:
            out.write(gz.flush())
            out.close()
            files.move(f"{top}/{name}{own}", f"{top}/{name}")
            yield pd.DataFrame({"archive": [f"{folder}/{name}"], "records": [n]})

    as_text = lambda c: F.col(c).cast("string").alias(c)  # noqa: E731  pandas would make doubles of longs beside a null
    rows = pages.select(as_text("page_id"), "url", "html", "payload_digest", "record_type", as_text("refers_to"))
    return sorted(r[0] for r in rows.mapInPandas(archive, "archive string, records long").collect())


def normalise(spark: SparkSession, archives: list[str], folder: str) -> None:
    """Each monolithic archive as one of single members below folder, with its index beside it (*.idx)."""

    def rewrite(batches):
        files, top = _files(folder)
        files.create_dir(top, recursive=True)
        for batch in batches:
            for uri in batch["archive"]:
                source, path = _files(uri)
                name = path.rpartition("/")[2]
                own = f"{top}/.{name}.{TaskContext.get().taskAttemptId()}"
                at, lines = 0, []
                with source.open_input_stream(path, compression=None) as stream, files.open_output_stream(own, compression=None) as out:
                    for head, whole in records_of(inflated(stream)):
                        out.write(data := member(whole))
                        page = _page(head["warc-record-id"])
                        lines.append(f"{folder}/{name}\t{'' if page is None else page}\t{at}\t{len(data)}\n")
                        at += len(data)
                with files.open_output_stream(own + ".idx", compression=None) as out:
                    out.write("".join(lines).encode())
                files.move(own, f"{top}/{name}")
                files.move(own + ".idx", f"{top}/{name}.idx")
                yield pd.DataFrame({"archive": [uri], "records": [len(lines)]})

    todo = spark.createDataFrame([(a,) for a in archives], "archive string").repartition(max(1, len(archives)))
    todo.mapInPandas(rewrite, "archive string, records long").collect()


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """RECORDS of the normalised archives below folder, by their indexes; payloads: whether they leave the task, once
    their digests are checked there."""

    def fetch(batches):
        for batch in batches:
            rows = []
            for uri, entries in batch.groupby("archive", sort=False):
                files, path = _files(uri)
                with files.open_input_file(path) as f:
                    for at, size in zip(entries["offset"], entries["length"], strict=True):
                        head, whole = next(records_of(iter([zlib.decompress(f.read_at(int(size), int(at)), 31)])))
                        digest = head["warc-payload-digest"].partition(":")[2]
                        response = head["warc-type"] == "response"
                        payload = whole.partition(b"\r\n\r\n")[2][len(_HTTP) : -4] if response else None
                        if response and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{uri} at {at}: the payload doesn't have its digest")
                        rows.append((_page(head["warc-record-id"]), int(head["warc-payload-length"]), digest, head["warc-type"], None if response else _page(head["warc-refers-to"]), payload if payloads else None))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in RECORDS.split(", ")], dtype=object)

    return spark.read.schema(INDEX).csv(f"{folder}/*.idx", sep="\t").mapInPandas(fetch, RECORDS)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, normalised and read back."""
    folder = new_folder(spark, "warc")
    archives = write(decide(table(spark, sf_dir, "pages")), f"{folder}/monolithic")
    if not archives:
        return spark.createDataFrame([], RECORDS).drop("payload")
    normalise(spark, archives, f"{folder}/members")
    return read(spark, f"{folder}/members", payloads=False).drop("payload")


OP10_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, n AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest
"""
