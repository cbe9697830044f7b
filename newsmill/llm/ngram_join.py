"""Operator 3: n-gram Jaccard join as a blocked product of the document by n-gram incidence matrix with its transpose.

The incidence matrix (documents x distinct word shingles) is made in blocks: a unit of some thousand documents by a
range of shingle hashes, packed as arrays. Per column range, one task counts in how many documents each column stands.
Columns with one document never count in a product; they drop out, and the rest returns to its unit.

Size-derived bounds then say which columns of a document matter. Two sets link if their overlap is at least THRESHOLD
of their union, so it is at least THRESHOLD of either set; ordered from rare to frequent columns, they must share one of
the first n - ceil(THRESHOLD n) + 1. Only these are indexed, and mostly they are columns with one document.

The documents of an indexed column form a list. Links are sought in two steps, and lose nothing:

1. the row of a list's first document is multiplied with the rows of the others (as many overlaps as list entries, not
   their square), in blocks of some BLOCK rows;
2. in the lists whose documents aren't all connected by then, every pair across components is compared. In short lists
   a document's row is multiplied with its partners' rows likewise; long ones are multiplied block by block inside
   tasks, which return only links that connect something new.

Equal sets are one node throughout. A shingle's identity is a hash of 48 bits and its column range (54 bits or more).

Defined cases: null or empty texts have no shingles and link with nothing (component: themselves); fewer than WORDS
words are one shingle; repeated rows link as equal sets; doc_ids are longs, and null ones are ignored in the smallest
id; an empty table gives an empty result; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remove, table, write_and_read
from .components import components
from .wordcache import slices

WORDS = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Characters and documents of a unit, and the shingles of a column range.
UNIT_CHARS, UNIT_DOCS, RANGE_SHINGLES = 3_000_000, 4096, 1_500_000
#: Longer lists are multiplied in blocks of BLOCK documents.
SHORT_LIST, BLOCK = 64, 2048
_COLUMNS = 4096

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(48)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text. bytes.split() and bytes.lower() follow the word rule exactly."""
    split = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    sizes = np.array([len(w) for w in split])
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, (w for ws in split for w in ws)), np.uint64, int(sizes.sum()))
    ends = np.cumsum(sizes)
    n = max(0, len(ids) - words + 1)
    h = np.zeros(n, np.uint64)
    for k in range(words):
        h = _mixed(h * _MULTIPLIER + ids[k : n + k])
    out = []
    for size, end in zip(sizes, ends, strict=True):
        if size >= words:
            out.append(np.unique(h[end - size : end - words + 1]))
        elif size:
            one = np.array([size], np.uint64)
            for w in ids[end - size : end]:
                one = _mixed(one * _MULTIPLIER + w)
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _packed(low: np.ndarray) -> bytes:
    return low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _numbers(n: np.ndarray) -> bytes:
    """Counts in 16 bits each, or in 32 where one needs them (a text of more than 65,535 shingles in one range)."""
    wide = bool(n.max(initial=0) > 65535)
    return bytes([wide]) + n.astype("<u4" if wide else "<u2").tobytes()


def _numbers_of(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4" if data[0] else "<u2", offset=1)


_BLOCKS = "unit long, range int, columns binary, rows binary, facts binary"
_BACK = "unit long, columns binary, rows binary, counts binary, facts binary"
_SETS = "doc_id long, text_hash long, n_shingles long, digest binary, columns binary, first array<long>"


def _incidence(ranges: int, words: int):
    """Documents to blocks of the incidence matrix; a unit's facts about its documents travel with one of its blocks."""

    def blocks(batches):
        unit = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = ["" if t is None else t for t in batch["text"]]
            ids = [None if i is None else int(i) for i in batch["doc_id"]]
            hashes = batch["text_hash"].tolist()
            for a, b in slices(texts, UNIT_CHARS):
                for c in range(a, b, UNIT_DOCS):
                    d = min(b, c + UNIT_DOCS)
                    yield of_unit(unit, ids[c:d], hashes[c:d], shingle_sets(texts[c:d], words))
                    unit += 1

    def of_unit(unit: int, ids: list, hashes: list, sets: list[np.ndarray]) -> pd.DataFrame:
        digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        first: dict = {}
        for k, d in enumerate(digests):
            first.setdefault(d, k)
        own = [k for d, k in first.items() if d is not None]
        keys = np.concatenate([sets[k] for k in own]) if own else np.zeros(0, np.uint64)
        rows = np.repeat(np.arange(len(own)), [len(sets[k]) for k in own])
        at = (((keys >> _LOW) * np.uint64(ranges)) >> np.uint64(16)).astype(np.int64)
        each = np.bincount(at * len(own) + rows, minlength=ranges * len(own)).reshape(ranges, len(own))
        sizes = each.sum(1, dtype=np.int64)
        low = (keys & np.uint64((1 << 48) - 1))[np.argsort(at, kind="stable")]  # by range, then document
        facts = pickle.dumps((ids, hashes, [len(s) for s in sets], digests, own))
        out = [(unit, r, _packed(low[end - n : end]), _numbers(each[r]), None) for r, (n, end) in enumerate(zip(sizes, np.cumsum(sizes), strict=True)) if n]
        out.append((unit, unit % ranges, None, None, facts))
        return pd.DataFrame(out, columns=["unit", "range", "columns", "rows", "facts"])

    return blocks


def _count_columns(block: pd.DataFrame) -> pd.DataFrame:
    """A column range: the columns that stand in several documents go back to their units with their counts."""
    out = [(u, None, None, None, f) for u, f in zip(block["unit"], block["facts"], strict=True) if f is not None]
    block = block[block["facts"].isna()]
    if len(block):
        parts = [_unpacked(c) for c in block["columns"]]
        low = np.concatenate(parts)
        of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        each = [_numbers_of(r) for r in block["rows"]]
        rows = np.concatenate([np.repeat(np.arange(len(e), dtype="<u2"), e) for e in each])
        order = np.argsort(low, kind="stable")
        low, of, rows = low[order], of[order], rows[order]
        starts = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        counts = np.diff(np.r_[starts, len(low)])
        counts = np.repeat(counts, counts)
        more = counts > 1
        low, of, rows, counts = low[more], of[more], rows[more], np.minimum(counts[more], 65535).astype("<u2")
        column = low | (np.uint64(block["range"].iloc[0]) << _LOW)
        order = np.argsort(of, kind="stable")
        edges = np.searchsorted(of[order], np.arange(len(parts) + 1))
        for unit, x, y in zip(block["unit"], edges, edges[1:], strict=False):
            if y > x:
                k = order[x:y]
                out.append((unit, column[k].astype("<u8").tobytes(), rows[k].tobytes(), counts[k].tobytes(), None))
    return pd.DataFrame(out, columns=["unit", "columns", "rows", "counts", "facts"])


def _bounded(percent: int):
    """A unit's documents: size, digest, and where any column is indexed, those and all columns that count."""

    def sets(unit: pd.DataFrame) -> pd.DataFrame:
        ids, hashes, sizes, digests, own = pickle.loads(unit["facts"].dropna().iloc[0])
        parts = unit[unit["facts"].isna()]
        column, row, count = (np.frombuffer(b"".join(parts[c]), t) for c, t in (("columns", "<u8"), ("rows", "<u2"), ("counts", "<u2")))
        order = np.lexsort((column, count, row))
        column, row = column[order], row[order]
        edges = np.searchsorted(row, np.arange(len(own) + 1))
        place = {k: r for r, k in enumerate(own)}
        out = []
        for k, (i, h, n, digest) in enumerate(zip(ids, hashes, sizes, digests, strict=True)):
            r = place.get(k)
            mine = column[edges[r] : edges[r + 1]] if r is not None else column[:0]
            indexed = (n - -(-percent * n // 100) + 1) - (n - len(mine))  # columns with one document come first
            if len(mine) and indexed > 0:
                out.append((i, h, n, digest, np.sort(mine).tobytes(), mine[:indexed].astype(np.int64)))
            else:
                out.append((i, h, n, digest, None, None))
        return pd.DataFrame(out, columns=["doc_id", "text_hash", "n_shingles", "digest", "columns", "first"], dtype=object)

    return sets


def column_ranges(docs: DataFrame) -> int:
    """So many column ranges that one has about RANGE_SHINGLES entries (a word takes some six bytes)."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(1 << 15, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // (6 * RANGE_SHINGLES))))


def document_sets(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """_SETS of every row of docs (doc_id, text): a table in the shared folder."""
    ids = F.col("doc_id").cast("long").cast("string").alias("doc_id")  # as text: pandas would make doubles of longs beside a null
    blocks = docs.select(ids, "text", F.xxhash64("text").alias("text_hash")).mapInPandas(_incidence(column_ranges(docs), words), _BLOCKS)
    back = blocks.groupBy("range").applyInPandas(_count_columns, _BACK)
    return write_and_read(back.groupBy("unit").applyInPandas(_bounded(percent), _SETS), "sets")


def _sizes_fit(a, b, percent: int):
    return (F.least(a, b) * 100) >= (F.greatest(a, b) * percent)


def _row_product(percent: int):
    """A row of the matrix times a block of other rows: the row's document is `a`, the block's are the others.

    Both are sparse (sorted columns). The entries of the block that meet one of the row's columns are found by one search
    and counted by document, which is the product; overlaps below the bound that the sizes give are discarded.
    """

    def links(block: pd.DataFrame) -> pd.DataFrame:
        mine = block["digest"] == block["a"]
        row, others = block[mine].iloc[0], block[~mine].drop_duplicates("digest")
        columns = np.frombuffer(row["columns"], "<u8")
        sets = [np.frombuffer(c, "<u8") for c in others["columns"]]
        entries, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(columns, entries), len(columns) - 1)
        both = np.bincount(of[columns[at] == entries], minlength=len(sets))
        n = others["n_shingles"].to_numpy(np.int64) + int(row["n_shingles"])
        found = others["digest"][both * 100 >= (n - both) * percent]
        return pd.DataFrame({"a": [row["a"]] * len(found), "b": found.tolist()}, dtype=object)

    return links


def _linked(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that link: rows a of the incidence matrix times blocks of their partners' rows. Partners
    whose sizes alone rule a link out don't come into a block."""
    pairs = write_and_read(pairs, "pairs")
    size = nodes.select(F.col("digest").alias("a"), F.col("n_shingles").alias("na"))
    met = pairs.join(size, "a").join(nodes.select(F.col("digest").alias("b"), "n_shingles", "columns"), "b").where(_sizes_fit(F.col("na"), F.col("n_shingles"), percent))
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block")
    others = met.join(blocks, "a").select("a", block, F.col("b").alias("digest"), "n_shingles", "columns")
    rows = blocks.select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).join(nodes.withColumn("a", F.col("digest")).select("a", "digest", "n_shingles", "columns"), "a")
    return others.unionByName(rows).groupBy("a", "block").applyInPandas(_guarded(_row_product(percent)), "a binary, b binary")


def _guarded(links):
    """links() of the blocks that have others beside their row."""
    return lambda block: links(block) if (block["digest"] != block["a"]).any() else pd.DataFrame({"a": [], "b": []}, dtype=object)


def _product(percent: int):
    """Links between components within a pair of blocks of a list, as many as connect something new."""

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("digest").reset_index(drop=True)
        label = pd.factorize(pdf["label"])[0]
        found = []
        if label.max(initial=0) > 0:
            sets = [np.frombuffer(c, "<u8") for c in pdf["columns"]]
            size = pdf["n_shingles"].to_numpy(np.int64)
            row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            _, column, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            keep = many[column] > 1
            row, column = row[keep], np.unique(column[keep], return_inverse=True)[1]
            order = np.argsort(column, kind="stable")
            row, column = row[order], column[order]
            largest = np.bincount(label).argmax()
            minor = np.flatnonzero(label != largest)
            place = np.full(len(sets), -1)
            place[minor] = np.arange(len(minor))
            both = np.zeros((len(minor), len(sets)), np.float32)
            for c in range(0, int(column.max(initial=-1)) + 1, _COLUMNS):
                a, b = np.searchsorted(column, [c, c + _COLUMNS])
                chunk = np.zeros((len(sets), _COLUMNS), np.float32)
                chunk[row[a:b], column[a:b] - c] = 1
                both += chunk[minor] @ chunk.T
            union = size[minor][:, None] + size[None, :] - both
            i, j = np.nonzero((both * 100 >= union * percent) & (label[minor][:, None] != label[None, :]))
            parent = list(range(int(label.max()) + 1))

            def top(k: int) -> int:
                while parent[k] != k:
                    parent[k] = parent[parent[k]]
                    k = parent[k]
                return k

            for x, y in zip(minor[i], j, strict=True):
                p, q = top(label[x]), top(label[y])
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    found.append((pdf["digest"][x], pdf["digest"][y]))
        return pd.DataFrame(found, columns=["a", "b"])

    return links


def _of_long_lists(rows: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Links of long lists (key, many, digest, label): each pair of blocks is a group of two blocks' documents."""
    blocks = F.ceil(F.col("many") / BLOCK).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", "digest", "label", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    rows = rows.join(nodes.select("digest", "n_shingles", "columns"), "digest")
    return rows.groupBy("key", "i", "j").applyInPandas(_product(percent), "a binary, b binary")


def component_of_sets(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(digest, label) of every distinct set that links with another: label is the smallest digest of its component."""
    nodes = write_and_read(sets.where("columns is not null").dropDuplicates(["digest"]), "nodes")
    entries = nodes.select(F.explode("first").alias("key"), "digest", "n_shingles")
    # lists of the same documents are one list
    lists = entries.groupBy("key").agg(F.count("*").alias("many"), F.min("digest").alias("pivot"), F.bit_xor(F.xxhash64("digest")).alias("x"), F.bit_xor(F.xxhash64("digest", F.lit(1))).alias("y"))
    lists = lists.where("many > 1").groupBy("many", "pivot", "x", "y").agg(F.min("key").alias("key")).select("key", "many", "pivot")
    members = write_and_read(entries.join(lists, "key"), "lists")
    stars = members.where("digest <> pivot").select(F.col("pivot").alias("a"), F.col("digest").alias("b")).distinct()
    links = write_and_read(_linked(stars, nodes, percent), "links")
    labels = components(links)
    labelled = members.join(labels.withColumnRenamed("node", "digest"), "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    labelled = write_and_read(labelled.select("key", "many", "digest", "n_shingles", "label"), "labelled")
    open_ = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    rows = labelled.join(open_, "key", "left_semi")
    short = rows.where(F.col("many") <= SHORT_LIST)
    x = short.select("key", F.col("digest").alias("a"), F.col("label").alias("la"), F.col("n_shingles").alias("na"))
    y = short.select("key", F.col("digest").alias("b"), F.col("label").alias("lb"), F.col("n_shingles").alias("nb"))
    across = x.join(y, "key").where((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & _sizes_fit(F.col("na"), F.col("nb"), percent))
    more = _linked(across.select("a", "b").distinct(), nodes, percent)
    more = more.unionByName(_of_long_lists(rows.where(F.col("many") > SHORT_LIST), nodes, percent))
    more = write_and_read(more, "links")
    out = labels if more.isEmpty() else components(links.unionByName(more))
    for done in (nodes, members, labelled, links, more):
        remove(done)
    return out.select(F.col("node").alias("digest"), "label")


def join_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text)."""
    sets = document_sets(docs, words, percent)
    labels = component_of_sets(sets, percent)
    known = sets.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("low")).join(labels, "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    least = known.groupBy("label").agg(F.min("low").alias("component_id"))
    of_set = known.join(least, "label").select("digest", "component_id")
    out = sets.select("doc_id", "n_shingles", "digest").join(of_set, "digest", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_hash, same) of the rows of docs that stay when one row of each component does: the one with the
    smallest doc_id, then text hash. Rows without words stay all. same: how many equal rows there are of it.
    """
    sets = document_sets(docs, words, percent)
    labels = component_of_sets(sets, percent)
    some = sets.where("digest is not null").groupBy("digest", "doc_id", "text_hash").agg(F.count("*").alias("same")).join(labels, "digest", "left")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    least = some.groupBy(F.coalesce("label", "digest").alias("label")).agg(F.min_by(F.struct("doc_id", "text_hash", "same"), order).alias("row")).select("row.*")
    none = sets.where("digest is null").select("doc_id", "text_hash", F.lit(1).cast("long").alias("same")).distinct()
    return least.unionByName(none)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by 5-word shingles at 0.75."""
    return join_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * o >= 75 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.m = e.a)
SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(m) AS component_id FROM r LEFT JOIN n ON r.doc_id = n.doc_id GROUP BY r.doc_id
"""
