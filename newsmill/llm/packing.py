"""Operator 7: best-fit packing by linear grouping (after Fernandez de la Vega and Lueker, 1981).

The tables are packed by their histogram. There are at most `capacity` different lengths, so the number of pieces of
each length says all that matters, however many documents there are:

1. long pieces are rounded up within groups of equal cardinality, which leaves GROUPS sizes;
2. the configurations of these few sizes are optimised by linear programming (column generation with a knapsack);
3. actual lengths take the places of the rounded ones;
4. the pieces left over and the short ones go by best fit into the fullest sequence that has room.

The plan is a list of classes of equal sequences (how many, and which lengths they hold). Its size depends on the
number of lengths and groups, not on the data. A piece then finds its place from its length and its number among the
pieces of that length, which Spark counts in ranges of ids.

Defined cases: a null or empty text is the end id alone; a document longer than a sequence is cut, others stay whole;
repeated rows are separate documents; doc_ids are longs, and null ones stay; an empty table gives an empty result;
columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, write_and_read
from .wordcache import WordIds, of_worker, slices, vocabulary

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048
END_ID = 0
#: Sizes after rounding, and the shares of a sequence above which a piece may count as long: the best plan is taken.
#: Rounding wastes less the fewer pieces are long; short ones go by best fit with their actual lengths.
GROUPS, LONG_SHARES = 40, (0.3, 0.4, 0.5)
#: Pieces of one length that one task numbers.
ROWS_EACH = 50_000
#: Characters whose words a task counts and encodes together: the more, the fewer words are looked up again.
CHARS_AT_ONCE = 6_000_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: A document's number, which tells equal rows apart.
_ROW = "row long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Token pieces of all documents, and each document's number (row); no shuffle."""

    def cut(batches):
        coder = of_worker(WordIds, path)
        end = np.array([end_id], "<u4").tobytes()
        step, row = 4 * capacity, TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = ["" if t is None else t for t in batch["text"]]
            keys = [None if i is None else int(i) for i in batch["doc_id"]]
            for a, b in slices(texts, CHARS_AT_ONCE):
                rows = []
                for key, ids in zip(keys[a:b], coder.texts(texts[a:b]), strict=True):
                    row += 1
                    ids += end
                    for k, at in enumerate(range(0, len(ids), step)):
                        part = ids[at : at + step]
                        rows.append((key, k, at // 4, len(part) // 4, zlib.crc32(part), row))
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "row"], dtype=object)

    ids = F.col("doc_id").cast("long").cast("string").alias("doc_id")  # as text: pandas would make doubles of longs beside a null
    return docs.select(ids, "text").mapInPandas(cut, f"{PIECES}, {_ROW}")


@dataclass
class Class:
    """`count` sequences that hold pieces of the same lengths."""

    count: int
    lengths: tuple[int, ...]
    room: int


def _patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often: the cutting-stock linear program by column generation (Gilmore and Gomory)."""
    k = len(sizes)
    base = np.diag((capacity // sizes).astype(float))
    amount = demand / np.diag(base)
    for _ in range(rounds):
        price = np.linalg.solve(base.T, np.ones(k))
        best = np.zeros(capacity + 1)
        took = np.full(capacity + 1, -1)
        for room in range(int(sizes.min()), capacity + 1):
            fit = np.flatnonzero(sizes <= room)
            value = best[room - sizes[fit]] + price[fit]
            at = int(value.argmax())
            best[room], took[room] = (value[at], fit[at]) if value[at] > best[room - 1] + 1e-12 else (best[room - 1], -1)
        if best[capacity] <= 1 + 1e-7:
            break
        new, room = np.zeros(k), capacity
        while room > 0:
            if took[room] < 0:
                room -= 1
            else:
                new[took[room]] += 1
                room -= sizes[took[room]]
        change = np.linalg.solve(base, new)
        if not (change > 1e-9).any():
            break
        ratio = np.where(change > 1e-9, amount / np.where(change > 1e-9, change, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        amount = np.maximum(amount - step * change, 0)
        base[:, out], amount[out] = new, step
    return [(base[:, j].astype(int), float(amount[j])) for j in range(k)]


def _grouped(hist: dict[int, int], groups: int) -> list[list[list[int]]]:
    """Runs [length, count] of long pieces, longest first, in groups of equal cardinality."""
    each = -(-sum(hist.values()) // groups)
    out, room = [[]], each
    for length in sorted(hist, reverse=True):
        left = hist[length]
        while left:
            if not room:
                out.append([])
                room = each
            n = min(left, room)
            out[-1].append([length, n])
            left, room = left - n, room - n
    return [g for g in out if g]


def _take(runs: list[list[int]], n: int) -> list[tuple[int, int]]:
    """The first n pieces of a group, as runs; they are gone from it."""
    out = []
    while n and runs:
        length, have = runs[0]
        used = min(n, have)
        out.append((length, used))
        n -= used
        if used == have:
            runs.pop(0)
        else:
            runs[0][1] -= used
    return out


def _configure(long: dict[int, int], capacity: int, groups: int) -> tuple[list[Class], dict[int, int]]:
    """Sequences of long pieces, and the long pieces that whole numbers of configurations leave over."""
    parts = _grouped(long, groups)
    sizes = np.array([g[0][0] for g in parts])
    demand = np.array([sum(n for _, n in g) for g in parts], float)
    out = []
    for pattern, often in _patterns(sizes, demand, capacity):
        places = [g for g in range(len(parts)) for _ in range(pattern[g])]
        left = int(often + 1e-9)
        for g in set(places):
            left = min(left, sum(n for _, n in parts[g]) // int(pattern[g]))
        if not left or not places:
            continue
        columns = [_take(parts[g], left) for g in places]
        while left:  # where all columns keep their length, the sequences are alike
            n = min(c[0][1] for c in columns)
            lengths = tuple(c[0][0] for c in columns)
            out.append(Class(n, lengths, capacity - sum(lengths)))
            left -= n
            for c in columns:
                if c[0][1] == n:
                    c.pop(0)
                else:
                    c[0] = (c[0][0], c[0][1] - n)
    rest: dict[int, int] = {}
    for g in parts:
        for length, n in g:
            rest[length] = rest.get(length, 0) + n
    return out, rest


def _best_fit(classes: list[Class], rest: dict[int, int], capacity: int) -> list[Class]:
    """Pieces, longest first, into the sequences with the least room that suffices, or new ones."""
    by_room: dict[int, list[Class]] = {}
    for c in classes:
        by_room.setdefault(c.room, []).append(c)
    for length in sorted(rest, reverse=True):
        left = rest[length]
        while left:
            room = min((r for r in by_room if r >= length), default=None)
            if room is None:
                each = capacity // length
                full, more = divmod(left, each)
                for n, k in ((full, each), (1 if more else 0, more)):
                    if n:
                        by_room.setdefault(capacity - k * length, []).append(Class(n, (length,) * k, capacity - k * length))
                break
            c = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
            each = min(room // length, left)
            n = min(c.count, left // each)
            if n < c.count:
                by_room.setdefault(room, []).append(Class(c.count - n, c.lengths, room))
            by_room.setdefault(room - each * length, []).append(Class(n, c.lengths + (length,) * each, room - each * length))
            left -= n * each
    return [c for room in sorted(by_room) for c in by_room[room]]


def plan(hist: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, shares: tuple[float, ...] = LONG_SHARES) -> list[Class]:
    """The packing of a histogram of lengths (1 to capacity): the one with the fewest sequences over the shares."""
    full = [Class(hist[capacity], (capacity,), 0)] if hist.get(capacity) else []
    plans = []
    for share in shares:
        long = {k: n for k, n in hist.items() if capacity * share < k < capacity and n}
        rest = {k: n for k, n in hist.items() if k <= capacity * share and n}
        classes: list[Class] = []
        if long:
            classes, over = _configure(long, capacity, groups)
            rest |= over
        plans.append(_best_fit(classes, rest, capacity))
    return full + min(plans, key=lambda p: sum(c.count for c in p))


def _places(classes: list[Class]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go: runs of places, by length and number among its pieces."""
    rows, base, met = [], 0, {}
    for c in classes:
        offset = 0
        for length in c.lengths:
            rows.append((length, met.get(length, 0), base, offset))
            met[length] = met.get(length, 0) + c.count
            offset += length
        base += c.count
    a = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"key": (a[:, 0] << 48) + a[:, 1], "number": a[:, 1], "base": a[:, 2], "offset": a[:, 3]}


def numbered(rows: DataFrame, hist: dict[int, int], rows_each: int = ROWS_EACH) -> DataFrame:
    """rows with `number`: 0, 1, ... among the rows of a length. A task numbers one bucket of one length; equal rows are
    dealt apart by their own numbers."""
    buckets = -(-max(hist.values(), default=1) // rows_each)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("row", "piece"), F.lit(buckets)))
    first = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begin = rows.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(first), F.lit(0)).alias("begin"))
    order = Window.partitionBy("length", "bucket").orderBy("row", "piece")
    out = rows.withColumn("nth", F.row_number().over(order)).join(begin, ["length", "bucket"])
    return out.withColumn("number", F.col("begin") + F.col("nth") - 1).drop("bucket", "nth", "begin")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, groups: int = GROUPS) -> DataFrame:
    """A row for each piece of docs (doc_id, text) with its sequence and its offset there."""
    rows = write_and_read(pieces(docs, path or vocabulary(TOKENIZER), capacity, end_id), "pieces")
    hist = {int(k): int(n) for k, n in rows.groupBy("length").count().collect()}
    places = _places(plan(hist, capacity, groups))

    def place(batches):
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            at = np.searchsorted(places["key"], (length << 48) + number, side="right") - 1
            found = [pa.array(places["base"][at] + number - places["number"][at]), pa.array(places["offset"][at])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *found], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    out = numbered(rows, hist).select("doc_id", "piece", "start", "length", "ids_crc32", "number")
    return out.mapInArrow(place, f"{PIECES}, sequence_id long, offset long")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"))
