"""Operator 13: importance resampling towards a target distribution (after Xie et al., 2023), by a dictionary of features.

A document's features are its runs of 1 to 3 words, with repeats. Their strings are counted over all documents and all
target texts; each distinct string is hashed once, into one of BUCKETS buckets; a bucket's gain is the logarithm of how
much likelier it is among the target's features. The gains come back to the documents' features by their strings.

The dictionary is never on the driver and never a row a string:

1. Tasks cut the texts into units of some UNIT_PARTS * PART_WORDS words (a long text has several parts, which overlap by two
   words, and each feature belongs to the part it begins in) and number a unit's words. The numbered units are a table.
2. A unit counts its distinct features, which leave packed, a block for each range of the hashes of a feature's first two
   words: the block's words, and for each such pair the words that follow it. The ranges are shuffled in ROUNDS rounds.
3. A range's blocks meet in one task, which numbers their words anew, counts each string over all units, hashes it, and
   sends the buckets of a unit's strings back to the unit, in the order of its block.
4. Buckets are added up by Spark; the gains (BUCKETS numbers) go to all tasks.
5. A unit's numbers give its documents' feature counts again, now joined with the gains.

A word or passage that stands in very many documents is one string of each unit, and a frequent word's strings spread
over the ranges with the words beside it. Ranges follow 16 bits of each word's hash; strings are compared as words.

Drawing takes the documents in order of score, numbered in sorted ranges side by side. Ties in score go to the smaller
doc_id; of equal rows any goes first.

Defined cases: null and empty texts have no features (weight 0); doc_ids are longs, and null ones come last in ties and
draw by the hash of an empty id; repeated rows are documents each; without target texts gains follow from t = T = 0;
empty tables give empty results; other columns than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import math
import pickle
from collections import defaultdict
from functools import reduce
from itertools import count
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, UPPER, remove, shuffles_removed, table, write_and_read

BUCKETS, LONGEST = 10_000, 3
MIN_WORDS, PERCENT, SEED = 20, 5, 42
#: Words of a part; parts' worth of words in a unit; and its different words, so that three numbers fit in 63 bits.
PART_WORDS, UNIT_PARTS, UNIT_VOCABULARY = 1_000_000, 2, (1 << 21) - 8
SLICE_BYTES = 4_000_000
#: UTF-8 bytes of text whose features a range takes, about; and the most ranges there are.
RANGE_BYTES, MOST_RANGES = 16_000_000, 1 << 15
#: Rounds in which the ranges are shuffled, a part of them each: more take less disk at a time, and sort each unit so often.
ROUNDS = 2
#: Pairs of words whose strings are counted at once.
PAIRS_AT_ONCE = 300_000

#: Bytes to bytes: A-Z lower-cased, those outside words to spaces. Bytes above 127 are parts of words.
_TABLE = bytearray(b" " * 128 + bytes(range(128, 256)))
for _c in "0123456789" + LOWER:
    _TABLE[ord(_c)] = ord(_c)
for _u, _l in zip(UPPER, LOWER, strict=True):
    _TABLE[ord(_u)] = ord(_l)

#: The unit of a target's blocks, and of a range's sums.
_TARGET = -1
_UNITS = "unit long, words binary, ids binary, parts binary"
_BLOCKS = "unit long, range int, words binary, columns array<binary>"
_BACK = "unit long, range int, buckets binary, sums binary"
_WEIGHTS = "row long, doc_id long, n_words long, n_features long, weight long, whole boolean"


def words_of(text: str):
    """A text's words, in lists of some SLICE_BYTES bytes."""
    data = text.encode("utf-8", "surrogatepass").translate(_TABLE)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + SLICE_BYTES)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def packed(a: np.ndarray) -> bytes:
    """Whole numbers from 0 on in as few bytes each as the largest needs, byte by byte, compressed."""
    width = next(w for w in (1, 2, 4, 8) if int(a.max(initial=0)) < 1 << (8 * w))
    planes = a.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()
    return bytes([width]) + len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    width, size = data[0], int.from_bytes(data[1:9], "little")
    planes = np.frombuffer(pa.decompress(data[9:], size, "zstd"), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64)


def packed_words(words: list[bytes]) -> bytes:
    text = b" ".join(words)
    return len(text).to_bytes(8, "little") + pa.Codec("zstd", 6).compress(text, asbytes=True)


def unpacked_words(data: bytes) -> list[bytes]:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True).split()


def steps(a: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Differences inside groups that rise and begin at starts."""
    out = np.diff(a, prepend=0)
    out[starts] = a[starts]
    return out


def summed(d: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What steps() was given."""
    c = np.cumsum(d)
    return c - np.repeat(c[starts] - d[starts], sizes)


def starts_of(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


class Unit:
    """Parts of documents whose words are numbered from 1; 0 is no word."""

    def __init__(self):
        self.number = defaultdict(count(1).__next__)
        self.parts: list[tuple] = []  # (row, doc_id, first of its document, last of it, words that begin features, words)
        self.ids: list[np.ndarray] = []
        self.size = 0

    def take(self, words: list[bytes], own: int, row: int, doc_id, first: bool, last: bool) -> None:
        """words: `own` ones, and up to LONGEST - 1 that follow them in the document."""
        self.parts.append((row, doc_id, first, last, own, len(words)))
        self.ids.append(np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def row(self, number: int) -> pa.RecordBatch:
        """A row of _UNITS."""
        values = (number, packed_words(list(self.number)), packed(np.concatenate([np.zeros(0, np.int32), *self.ids])), pickle.dumps(self.parts))
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int64(), *[pa.binary()] * 3), strict=True)], names=["unit", "words", "ids", "parts"])


def feature_keys(ids: np.ndarray, parts: list[tuple], vocabulary: int):
    """Yields, for features of 1, 2 and 3 words, a key each (three word numbers in 63 bits) and the part it belongs to."""
    sizes, own = np.array([p[5] for p in parts], np.int64), np.array([p[4] for p in parts], np.int64)
    of = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
    place = np.arange(len(ids), dtype=np.int32) - np.repeat((np.cumsum(sizes) - sizes).astype(np.int32), sizes)
    left = np.where(place < own.astype(np.int32)[of], sizes.astype(np.int32)[of] - place, 0)
    del place
    base = vocabulary + 1
    for n in range(1, LONGEST + 1):
        at = np.flatnonzero(left >= n)
        key = ids[at] * base**2
        for k in range(1, n):
            key += ids[at + k] * base ** (2 - k)
        yield key, of[at]


def sorted_keys(ids: np.ndarray, parts: list[tuple], vocabulary: int) -> np.ndarray:
    """All feature keys in order."""
    out, end = np.empty(LONGEST * len(ids), np.int64), 0
    for keys, _ in feature_keys(ids, parts, vocabulary):
        out[end : end + len(keys)] = keys
        end += len(keys)
    out = out[:end]
    out.sort()
    return out


def _zero_byte() -> np.ndarray:
    """What a CRC-32 becomes by one more zero byte, for each value of each of its four bytes."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> 1) ^ np.uint32(0xEDB88320), x >> 1)
    out = np.arange(256, dtype=np.uint32)[None] << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    return x[out & 255] ^ (out >> 8)


def _applied(step: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return step[0][crc & 255] ^ step[1][(crc >> 8) & 255] ^ step[2][(crc >> 16) & 255] ^ step[3][crc >> 24]


_ZEROS = [_zero_byte()]


def joined(first: np.ndarray, second: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of two strings' concatenation from their own and the second's number of bytes."""
    out, k = first.copy(), 0
    while (sizes >> k).any():
        if k == len(_ZEROS):  # twice as many zero bytes
            _ZEROS.append(_applied(_ZEROS[-1], _ZEROS[-1]))
        at = np.flatnonzero((sizes >> k) & 1)
        out[at] = _applied(_ZEROS[k], out[at])
        k += 1
    return out ^ second


def word_hashes(words: list[bytes]) -> np.ndarray:
    """16 bits of each word's hash, after those of no word."""
    return np.fromiter((0, *(h & 0xFFFF for h in map(xxhash.xxh3_64_intdigest, words))), np.uint64, len(words) + 1)


def ranges_of(first: np.ndarray, second: np.ndarray, hashes: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each pair of words by their hashes."""
    h = np.zeros(len(first), np.uint64)
    for n in (first, second):
        h = (h ^ (hashes[n] + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.uint16)


def changes(keys: np.ndarray) -> np.ndarray:
    """True where a sorted key differs from the one before it."""
    return np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)


def dealt(keys: np.ndarray, hashes: np.ndarray, ranges: int):
    """Of sorted distinct keys: pairs (first, second, how many strings begin with it, range) and the order of the
    strings, by range and then as they are."""
    base = len(hashes) + 1
    new = changes(keys // base)
    first, second = np.divmod(keys[new] // base, base)
    sizes = np.diff(np.r_[np.flatnonzero(new), len(keys)])
    where = ranges_of(first, second, hashes, ranges)
    return first, second, sizes, where, np.argsort(np.repeat(where, sizes), kind="stable")


def unit_blocks(words: list[bytes], ids: np.ndarray, parts: list[tuple], ranges: int, low: int, high: int):
    """(range, words, columns) of a unit's blocks for the ranges from low to high - 1."""
    hashes = word_hashes(words)
    base = len(hashes) + 1
    keys = sorted_keys(ids, parts, len(hashes))
    new = np.flatnonzero(changes(keys))
    keys, times = keys[new], np.diff(np.r_[new, len(keys)]).astype(np.int32)
    del new
    first, second, sizes, where, order = dealt(keys, hashes, ranges)
    third, times = (keys % base).astype(np.int32)[order], times[order]
    del keys, order
    pairs = np.argsort(where, kind="stable")
    first, second, sizes = first[pairs], second[pairs], sizes[pairs]
    edges = np.searchsorted(where[pairs], np.arange(ranges + 1))
    ends = np.r_[0, np.cumsum(sizes)][edges]
    names, renumbered = np.array([b"", *words], object), np.zeros(len(hashes), np.int32)
    for r in (low + np.flatnonzero(np.diff(edges[low : high + 1]))).tolist():
        a, z = slice(edges[r], edges[r + 1]), slice(ends[r], ends[r + 1])
        every = np.concatenate([np.zeros(1, np.int64), first[a], second[a], third[z]])
        used = np.unique(every) if 8 * len(every) < len(names) else np.flatnonzero(np.bincount(every, minlength=len(names)))
        renumbered[used] = np.arange(len(used))
        one, two, three = renumbered[first[a]], renumbered[second[a]], renumbered[third[z]]
        # a pair's first string is the pair itself, so its third number, 0, goes without saying
        follow = np.delete(steps(three, starts_of(sizes[a])), starts_of(sizes[a]))
        columns = (np.diff(one, prepend=0), steps(two, np.flatnonzero(changes(one))), sizes[a] - 1, follow, times[z])
        yield r, packed_words(names[used[1:]].tolist()), list(map(packed, columns))


def parts_of(text: str, most: int):
    """(words, how many of them begin features, is it the first, is it the last) of a text's parts."""
    held, first = [], True
    for more in words_of(text):
        held += more
        while len(held) >= most + LONGEST:
            yield held[: most + LONGEST - 1], most, first, False
            held, first = held[most:], False
    yield held, len(held), first, True


def units(docs: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """_UNITS of docs (doc_id, text)."""

    def run(batches):
        number = row = TaskContext.get().partitionId() << 32
        unit = Unit()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for words, own, first, last in parts_of(text.as_py() or "", part_words):
                    if unit.size and (unit.size + len(words) > UNIT_PARTS * part_words or len(unit.number) + len(words) > UNIT_VOCABULARY):
                        yield unit.row(number)
                        unit, number = Unit(), number + 1
                    unit.take(words, own, row, doc_id, first, last)
                row += 1
        if unit.parts:
            yield unit.row(number)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _UNITS)


def blocks(rows: DataFrame, ranges: int, low: int, high: int) -> DataFrame:
    """_BLOCKS of _UNITS for the ranges from low to high - 1."""

    def run(batches):
        for batch in batches:
            for number, words, ids, parts in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                out = list(unit_blocks(unpacked_words(words), unpacked(ids), pickle.loads(parts), ranges, low, high))
                for k in range(0, len(out), 64):
                    r, w, c = zip(*out[k : k + 64], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([number] * len(r), pa.int64()), pa.array(r, pa.int32()), pa.array(w, pa.binary()), pa.array(c, pa.list_(pa.binary()))], names=["unit", "range", "words", "columns"])

    return rows.mapInArrow(run, _BLOCKS)


def dictionary(block: pd.DataFrame) -> pd.DataFrame:
    """A range of the dictionary: its strings are counted and hashed, and the buckets go back to the units."""
    number = defaultdict(count(1).__next__)
    held: list[list[np.ndarray]] = [[], [], [], [], []]
    for text, columns in zip(block["words"], block["columns"], strict=True):
        words = unpacked_words(text)
        place = np.fromiter((0, *map(number.__getitem__, words)), np.int64, len(words) + 1)
        one, two, more, follow, times = map(unpacked, columns)
        sizes = more + 1
        three = np.insert(follow, starts_of(more), 0)
        one = np.cumsum(one)
        groups = np.flatnonzero(changes(one))
        two = summed(two, groups, np.diff(np.r_[groups, len(one)]))
        three = summed(three, starts_of(sizes), sizes)
        for h, v in zip(held, (place[one], place[two], sizes, place[three].astype(np.int32), times.astype(np.int32)), strict=True):
            h.append(v)
    each = [len(h) for h in held[3]]
    first, second, sizes, third, times = map(np.concatenate, held)
    del held
    base = len(number) + 1
    pairs, pair = np.unique(first * base + second, return_inverse=True)
    del first, second
    # the CRC of "a b c" goes on from that of "a b", so each distinct string is hashed once
    sizes_of = np.fromiter((0, *map(len, number)), np.int64, base)
    plain = np.fromiter((0, *map(crc32, number)), np.uint32, base)
    after_space = np.where(sizes_of > 0, joined(np.full(base, crc32(b" "), np.uint32), plain, sizes_of), 0).astype(np.uint32)
    spaced = sizes_of + (sizes_of > 0)
    a, b = np.divmod(pairs, base)
    of_pair = joined(plain[a], after_space[b], spaced[b])
    of_string = np.repeat(pair.astype(np.int32), sizes)
    target = np.repeat((block["unit"] == _TARGET).to_numpy(), each)
    bucket, counts = np.empty(len(third), np.uint16), np.zeros((2, BUCKETS), np.int64)
    for low in range(0, len(pairs), PAIRS_AT_ONCE):
        at = np.flatnonzero((of_string >= low) & (of_string < low + PAIRS_AT_ONCE))
        strings, which = np.unique(of_string[at].astype(np.int64) * base + third[at], return_inverse=True)
        a, b = np.divmod(strings, base)
        hashed = (joined(of_pair[a], after_space[b], spaced[b]) % np.uint32(BUCKETS)).astype(np.uint16)
        for row, mine in enumerate((~target[at], target[at])):
            of_each = np.bincount(which[mine], times[at][mine], len(strings))
            counts[row] += np.bincount(hashed, of_each, BUCKETS).astype(np.int64)
        bucket[at] = hashed[which]
    out, end = [(_TARGET, 0, None, counts.astype("<i8").tobytes())], 0
    for unit, r, size in zip(block["unit"], block["range"], each, strict=True):
        if unit != _TARGET:
            out.append((unit, r, packed(bucket[end : end + size]), None))
        end += size
    return pd.DataFrame(out, columns=["unit", "range", "buckets", "sums"])


def bucket_counts(sums: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features in each bucket among the documents, and among the target's texts; BUCKETS rows come back."""

    def add(batches):
        total = np.zeros(2 * BUCKETS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_py(), "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(total[:BUCKETS]), pa.array(total[BUCKETS:])], names=["bucket", "s", "t"])

    out = np.zeros((2, BUCKETS), np.int64)
    for k, s, t in sums.mapInArrow(add, "bucket long, s long, t long").groupBy("bucket").agg(F.sum("s"), F.sum("t")).collect():
        out[:, k] = s, t
    return out[0], out[1]


def gains(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a document's weight."""
    of_all, of_target = int(s.sum()) + BUCKETS, int(t.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((int(b) + 1) * of_all / ((int(a) + 1) * of_target))) for a, b in zip(s, t, strict=True)], np.int64)


def _weigh(gain: np.ndarray, ranges: int):
    """A unit's row and its buckets to _WEIGHTS."""

    def weights(rows: pd.DataFrame) -> pd.DataFrame:
        words, ids, parts = rows.loc[rows["ids"].notna(), ["words", "ids", "parts"]].iloc[0]
        hashes, parts = word_hashes(unpacked_words(words)), pickle.loads(parts)
        ids = unpacked(ids)
        own = sorted_keys(ids, parts, len(hashes))
        own = own[changes(own)]
        back = rows[rows["buckets"].notna()].sort_values("range")
        of_key = np.zeros(len(own), np.int32)
        of_key[dealt(own, hashes, ranges)[-1]] = gain[np.concatenate([np.zeros(0, np.int64), *map(unpacked, back["buckets"])])]
        weight, n = np.zeros(len(parts)), np.zeros(len(parts), np.int64)
        for keys, owner in feature_keys(ids, parts, len(hashes)):
            order = np.argsort(keys)  # sorted ones are found faster
            weight += np.bincount(owner[order], of_key[np.searchsorted(own, keys[order])], len(parts))
            n += np.bincount(owner, minlength=len(parts))
        weight = weight.astype(np.int64)
        out = [(row, doc_id, begin, n[k], weight[k], first and last) for k, (row, doc_id, first, last, begin, _) in enumerate(parts)]
        return pd.DataFrame(out, columns=["row", "doc_id", "n_words", "n_features", "weight", "whole"], dtype=object)

    return weights


def weights(docs: DataFrame, target: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight) of each row of docs (doc_id, text): a table in the shared folder.
    target: text."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(MOST_RANGES, max(1, -(-size // RANGE_BYTES)))
    own = write_and_read(units(docs, part_words), "units")
    theirs = write_and_read(units(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), part_words), "units")
    with shuffles_removed(docs.sparkSession):
        parts = []
        for k in range(ROUNDS):
            mine = ranges, k * ranges // ROUNDS, (k + 1) * ranges // ROUNDS
            both = blocks(own, *mine).unionByName(blocks(theirs, *mine).withColumn("unit", F.lit(_TARGET).cast("long")))
            parts.append(write_and_read(both.groupBy("range").applyInPandas(dictionary, _BACK), "buckets"))
        back = reduce(DataFrame.unionByName, parts)
        gain = gains(*bucket_counts(back.where("sums is not null").select("sums")))
        rows = own.unionByName(back.where(F.col("unit") != _TARGET).select("unit", "range", "buckets"), allowMissingColumns=True)
        found = write_and_read(rows.groupBy("unit").applyInPandas(_weigh(gain, ranges), _WEIGHTS), "weights")
    for done in (own, theirs, *parts):
        remove(done)
    several = found.where("not whole").groupBy("row").agg(F.first("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")))
    return found.where("whole").drop("whole").unionByName(several)


def noise(doc_id) -> F.Column:
    """Gumbel noise of a doc_id in thousandths."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def drawn(rows: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """rows (row, doc_id, n_words, n_features, weight) with score, and rank where drawn."""
    rows = rows.withColumns({"score": F.col("weight") + noise(F.col("doc_id")), "fit": F.col("n_words") >= min_words})
    order = [F.col("fit").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    ranged = write_and_read(rows.repartitionByRange(*order).withColumn("span", F.spark_partition_id()), "ranked")
    total = ranged.agg(F.count_if("fit")).first()[0]
    before = F.sum("count").over(Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranged.groupBy("span").count().select("span", F.coalesce(before, F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("span").orderBy(*order)) + F.col("start")
    out = ranged.join(F.broadcast(starts), "span").withColumn("place", place.cast("long"))
    return out.select("doc_id", "n_features", "weight", "score", F.when(F.col("place") <= percent * total // 100, F.col("place")).alias("rank"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents towards the benchmark's texts: a twentieth of those of 20 words or more is drawn."""
    return drawn(weights(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")))
