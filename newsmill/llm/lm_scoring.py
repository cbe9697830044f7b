"""Operator 5: language-model scoring with a causal self-attention model on subword ids, in numpy.

A text is its words (A-Z lower-cased), each after one space, as ids of a public byte-level tokenizer, then END. The
model reads windows of WINDOW ids. Each position attends to itself and those before it, with a learned weight for the
distance; what it gathers, its own embedding and that of the position before it go through a hidden layer to a softmax
over CLASSES classes of ids. One component is counted, not learned: which MEMBER of a class follows which id, from all
pairs in the training texts (a softmax over all ids, for each of some 400 million ids a GB, is out of reach in numpy).
Frequent ids have a bucket of their own, the others share HASHED ones by corpus frequency; p(next id) sums to one.

In scoring, windows overlap by WINDOW - STRIDE: every prediction is made once, in the first window that holds it, and then
has at least so many positions before it (unless the text begins there). In training they lie side by side. Attention is masked and batched over windows.

What is learned, and from what (all training texts, whole):
- counts of words, ids and pairs of buckets: by Spark aggregation;
- all other parameters: rounds of local training in Spark tasks. Round r takes the texts of slice r (hashes in
  SLICES[r] to SLICES[r + 1]), each prediction once; tasks begin with the same parameters, and Spark averages
  what they come to in two levels, by windows (an embedding: by how often its bucket was met). Slices grow, since
  averaging matters most in the beginning. Nothing is fitted on the driver.

Base scores need each word's count, and words are too many to broadcast. The FREQUENT most frequent words go to the
tasks (a fixed bound); the others leave as (row, word hash, number) and meet their counts in a join.

Defined cases: null text is empty, which is the end token alone; a null doc_id counts as the empty string in the fold
rule; repeated rows are scored each; an empty table, or one without training texts, scores by uniform ids (c = N = V = 0);
other columns than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, read_arrays, small_batches, table, write_and_read, write_arrays
from .wordcache import ByteIds, coded, gathered, of_worker, slices, vocabulary

TOKENIZER = "byte_bpe_multi_50k.tiktoken"
#: Ids of the tokenizer's file, and two more: begin and end of a text.
N_IDS, BEGIN, END = 50258, 50256, 50257
WINDOW, STRIDE = 16, 12
#: Ids beyond the most frequent ones share HASHED buckets; buckets are dealt into CLASSES of MEMBERS each.
BUCKETS, HASHED, CLASSES = 2048, 256, 32
MEMBERS = BUCKETS // CLASSES
WIDTH, HEAD, HIDDEN = 16, 8, 24
RATE, FIRST_SQUARE, PRIOR = 0.2, 1.0, 2.0
#: Bounds of the rounds' slices among 64 hash values.
SLICES = (0, 1, 2, 4, 8, 16, 32, 64)
#: Windows of a step in training, and of a batch in scoring; and ids whose windows are there at once.
STEP, BATCH, AT_ONCE = 512, 1024, 200_000
#: Windows of a batch or step whose arrays are there at once: they stay in a core's cache, and in memory that the process
#: keeps (larger ones are fetched from the system, page by page, and given back in every step).
BLOCK = 128
#: Words whose counts every task holds, at most.
FREQUENT = 400_000
#: Characters whose words are encoded together, and bytes whose words are counted together.
CHARS_AT_ONCE, CHARS_COUNTED = 4_000_000, 8_000_000
FOLDS, HELD_OUT = 7, 2

#: Added to the exponents of attention: none to positions behind.
_CAUSAL = np.where(np.tril(np.ones((WINDOW, WINDOW), bool)), 0, -np.inf).astype(np.float32)
_BACK = np.maximum(np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None], 0)
#: Where each bucket's embedding stands among all.
_PLACES = np.arange(BUCKETS * WIDTH).reshape(BUCKETS, WIDTH)


def classes(n: np.ndarray, frequency: np.ndarray) -> np.ndarray:
    """Buckets in an order whose runs of MEMBERS are the classes: halved, and halved again, along the direction in
    which the buckets that stand before them differ most."""
    profile = np.sqrt(n / np.maximum(n.sum(0), 1e-9)).T.astype(np.float32)
    basis = np.random.default_rng(1).normal(size=(BUCKETS, 12)).astype(np.float32)
    for _ in range(4):
        basis = np.linalg.qr(profile.T @ (profile @ basis))[0]
    low, groups = profile @ basis, [np.arange(BUCKETS)]
    while len(groups) < CLASSES:
        halves = []
        for g in groups:
            weight = frequency[g] + 1e-9
            apart = (low[g] - np.average(low[g], axis=0, weights=weight)) * np.sqrt(weight)[:, None]
            along = low[g] @ np.linalg.svd(apart, full_matrices=False)[2][0]
            halves += np.split(g[np.argsort(along, kind="stable")], 2)
        groups = halves
    return np.concatenate(groups)


def buckets_of(ids: np.ndarray) -> np.ndarray:
    """The bucket of each id by its frequency rank."""
    rank = np.empty(len(ids), np.int64)
    rank[np.argsort(-ids, kind="stable")] = np.arange(len(ids))
    own = BUCKETS - HASHED
    return np.where(rank < own, rank, own + rank % HASHED)


class Model:
    """Parameters p; the bucket of each id and its share of it; after[a, b]: p(b | its class, a before it), as counted."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, seed: int = 0):
        """ids: how often each id stands in the training texts; n[a, b]: how often bucket b follows bucket a there."""
        smooth = ids + 0.1
        bucket = buckets_of(ids)
        mass = np.bincount(bucket, smooth, BUCKETS)
        order = classes(n, mass / mass.sum())
        place = np.empty(BUCKETS, np.int64)
        place[order] = np.arange(BUCKETS)
        self.bucket = place[bucket]
        mass = mass[order]
        self.within = (smooth / mass[self.bucket]).astype(np.float32)
        frequency = mass / mass.sum()
        of_class = frequency.reshape(CLASSES, MEMBERS).sum(1)
        after = (n[order][:, order]).reshape(BUCKETS, CLASSES, MEMBERS) + PRIOR * (frequency.reshape(CLASSES, MEMBERS) / of_class[:, None]).astype(np.float32)
        self.after = (after / after.sum(2, keepdims=True)).reshape(BUCKETS, BUCKETS).astype(np.float32)
        rng = np.random.default_rng(seed)

        def noise(deviation: float, *shape: int) -> np.ndarray:
            return rng.normal(0, deviation, shape).astype(np.float32)

        self.p = {
            "embed": noise(0.5, BUCKETS, WIDTH),
            "qkv": noise(0.2, WIDTH, 3 * HEAD),
            "near": np.zeros((1, WINDOW), np.float32),
            "mix": noise(0.15, 2 * WIDTH + HEAD + 1, HIDDEN),
            "class": noise(0.05, HIDDEN, CLASSES),
        }
        # the last hidden unit is 1, so classes begin with their corpus frequencies
        self.p["class"][-1] = np.log(of_class)

    def arrays(self) -> dict[str, np.ndarray]:
        return {"p_" + k: v for k, v in self.p.items()} | {k: getattr(self, k) for k in ("bucket", "within", "after")}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray]) -> Model:
        """A model from its arrays; its parameters may change."""
        new = cls.__new__(cls)
        new.p = {k[2:]: v.copy() for k, v in arrays.items() if k.startswith("p_")}
        new.bucket, new.within, new.after = (arrays[k] for k in ("bucket", "within", "after"))
        return new

    def tables(self) -> dict:
        """What depends on a bucket alone, by bucket: query, key, value and a one; its part of the hidden units' input (doubled,
        since tanh(x) = 1 - 2 / (exp(2x) + 1)) where it stands itself, and where it stands before; none stands before a window."""
        p = self.p
        qkv = np.ones((BUCKETS, 3 * HEAD + 1), np.float32)
        np.matmul(p["embed"], p["qkv"], out=qkv[:, :-1])
        q, k = (np.square(qkv[:, : 2 * HEAD]) @ np.repeat(np.eye(2, dtype=np.float32), HEAD, 0)).max(0)
        before = np.zeros((BUCKETS + 1, HIDDEN), np.float32)
        np.matmul(p["embed"], 2 * p["mix"][WIDTH : 2 * WIDTH], out=before[:-1])
        return {
            "qkv": qkv,
            "own": p["embed"] @ (2 * p["mix"][:WIDTH]) + 2 * p["mix"][-1],
            "before": before,
            "near": p["near"][0][_BACK] + _CAUSAL,
            # exponents beyond 30 are cut; where none can be, nothing is compared
            "cut": np.sqrt(q * k) + p["near"].max() > 30,
            "cut_class": np.abs(p["class"]).sum(0).max() > 30,
        }

    def forward(self, b: np.ndarray, t: np.ndarray, skip: int, tables: dict):
        """For windows of buckets and the targets from position skip on: p(class of target), and what a step needs."""
        p, (n, size) = self.p, b.shape
        qkv = tables["qkv"].take(b, axis=0)
        e = np.matmul(qkv[:, skip:, :HEAD], qkv[..., HEAD : 2 * HEAD].transpose(0, 2, 1))
        e += tables["near"][skip:size, :size]
        if tables["cut"]:
            np.minimum(e, 30, out=e)
        np.exp(e, out=e)
        out = np.matmul(e, qkv[..., 2 * HEAD :])
        weight = out[..., HEAD:]
        out = out[..., :HEAD] / weight
        h = out.reshape(-1, HEAD) @ (2 * p["mix"][2 * WIDTH : -1])
        before = np.full((n, size - skip), BUCKETS, b.dtype)
        before[:, 0 if skip else 1 :] = b[:, skip - 1 if skip else 0 : -1]
        h += tables["own"].take(b[:, skip:].ravel(), axis=0)
        h += tables["before"].take(before.ravel(), axis=0)
        with np.errstate(over="ignore"):
            np.exp(h, out=h)
        h += 1
        np.divide(-2, h, out=h)
        h += 1
        h[:, -1] = 1
        c = h @ p["class"]
        if tables["cut_class"]:
            np.minimum(c, 30, out=c)
        np.exp(c, out=c)
        total = c @ np.ones(CLASSES, np.float32)
        at = t.ravel() // MEMBERS
        at += np.arange(0, c.size, CLASSES)
        return c.ravel().take(at) / total, qkv, e, weight, out, h, c, total, at

    def probability(self, windows: np.ndarray, targets: np.ndarray, skip: int = 0, tables: dict | None = None) -> np.ndarray:
        """p(target | the ids up to there) for windows of ids, from position skip on; targets are ids too."""
        tables, parts = tables or self.tables(), []
        for k in range(0, len(windows), BLOCK):
            target = targets[k : k + BLOCK, skip:]
            b, t = self.bucket.take(windows[k : k + BLOCK]), self.bucket.take(target)
            parts.append(self.forward(b, t, skip, tables)[0].reshape(t.shape) * self.after[b[:, skip:], t] * self.within.take(target))
        return np.concatenate(parts)

    def learn(self, windows: np.ndarray, targets: np.ndarray, on: np.ndarray, squares: dict, skip: int = 0) -> None:
        """One step of Adagrad on windows, from position skip on; on says which predictions count."""
        b, t, tables = self.bucket.take(windows), self.bucket.take(targets[:, skip:]), self.tables()
        dx, grads = np.empty((*b.shape, WIDTH), np.float32), {}
        for k in range(0, len(b), BLOCK):
            some = slice(k, k + BLOCK)
            for name, d in self.gradients(b[some], t[some], on[some, skip:].ravel().astype(np.float32), skip, tables, dx[some]).items():
                grads[name] = grads[name] + d if name in grads else d
        grads["embed"] = np.bincount(_PLACES.take(b.ravel(), axis=0).ravel(), dx.ravel(), BUCKETS * WIDTH)
        squares["met"] += np.bincount(b.ravel(), minlength=BUCKETS)
        for name, d in grads.items():
            d = d.reshape(self.p[name].shape).astype(np.float32)
            squares[name] += d * d
            self.p[name] += RATE * d / np.sqrt(squares[name])

    def gradients(self, b: np.ndarray, t: np.ndarray, on: np.ndarray, skip: int, tables: dict, dx: np.ndarray) -> dict[str, np.ndarray]:
        """Of the log likelihood of the targets that count; dx takes those of the embeddings where they stand."""
        p, (n, size) = self.p, b.shape
        _, qkv, e, weight, out, h, c, total, at = self.forward(b, t, skip, tables)
        e /= weight
        c *= (-on / total)[:, None]
        c.reshape(-1)[at] += on
        dh = c @ p["class"].T
        d_class = h.T @ c
        np.square(h, out=h)
        np.subtract(1, h, out=h)
        dh *= h
        # d: what an embedding's products meet, side by side: hidden units of its own position, query, key, value, and hidden
        # units of the next position
        d, hidden = np.empty((n, size, 2 * HIDDEN + 3 * HEAD), np.float32), dh.reshape(n, size - skip, HIDDEN)
        d[:, skip:, :HIDDEN] = hidden
        d[:, :skip] = 0
        d[:, -1, -HIDDEN:] = 0
        d[:, max(skip - 1, 0) : -1, -HIDDEN:] = hidden[:, 0 if skip else 1 :]
        # beside the gradient of out, a column that meets the ones beside the values
        d_out = np.empty((n, size - skip, HEAD + 1), np.float32)
        np.matmul(dh, p["mix"][2 * WIDTH : -1].T, out=d_out.reshape(-1, HEAD + 1)[:, :-1])
        np.negative(np.einsum("nij,nij->ni", d_out[..., :-1], out), out=d_out[..., -1])
        ds = np.matmul(d_out, qkv[..., 2 * HEAD :].transpose(0, 2, 1))
        ds *= e
        query, key, value = (d[..., k : k + HEAD] for k in range(HIDDEN, HIDDEN + 3 * HEAD, HEAD))
        np.matmul(ds, qkv[..., HEAD : 2 * HEAD], out=query[:, skip:])
        np.matmul(ds.transpose(0, 2, 1), qkv[:, skip:, :HEAD], out=key)
        np.matmul(e.transpose(0, 2, 1), d_out[..., :-1], out=value)
        d = d.reshape(n * size, -1)
        mix = p["mix"]
        np.matmul(d, np.concatenate([mix[:WIDTH], p["qkv"], mix[WIDTH : 2 * WIDTH]], 1).T, out=dx.reshape(-1, WIDTH))
        own, of_qkv, before = np.split(p["embed"].take(b.ravel(), axis=0).T @ d, [HIDDEN, HIDDEN + 3 * HEAD], axis=1)
        return {
            "qkv": of_qkv,
            "near": np.bincount(_BACK[skip:size, :size].ravel(), ds.sum(0).ravel(), WINDOW),
            "mix": np.concatenate([own, before, out.reshape(-1, HEAD).T @ dh, np.ones((1, len(dh)), np.float32) @ dh]),
            "class": d_class,
        }


def first_squares(p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k: np.full(v.shape, FIRST_SQUARE, np.float32) for k, v in p.items()}


def in_windows(sequences: list[np.ndarray], stride: int = STRIDE):
    """Windows of inputs, their targets, the predictions that count there, and the sequence of each window.

    A sequence begins with BEGIN and ends with END; each id after the first is predicted, once.
    """
    sizes = np.array([len(s) - 1 for s in sequences])
    flat = np.concatenate([*sequences, np.zeros(WINDOW, np.int64)])
    starts = np.r_[0, np.cumsum(sizes + 1)[:-1]]
    n = 1 + np.maximum(0, -(-(sizes - WINDOW) // stride))
    of = np.repeat(np.arange(len(sequences)), n)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    at = starts[of] + nth * stride
    windows, targets = (sliding_window_view(x, WINDOW)[at] for x in (flat[:-1], flat[1:]))
    on = np.array([np.arange(WINDOW) >= WINDOW - stride, np.ones(WINDOW, bool)])[(nth == 0).astype(int)]
    # a sequence's last window may reach beyond it: its last prediction stands there again, and doesn't count
    last = np.cumsum(n) - 1
    left = (sizes - nth[last] * stride)[:, None]
    inside = at[last][:, None] + np.minimum(np.arange(WINDOW), left - 1)
    windows[last], targets[last] = flat[inside], flat[inside + 1]
    on[last] &= np.arange(WINDOW) < left
    return windows, targets, on, of


def steps_of(of: np.ndarray):
    """Batches of windows with the position from which they count: 0 for the first of a sequence."""
    first = np.r_[True, of[1:] != of[:-1]]
    for part, skip in ((np.flatnonzero(first), 0), (np.flatnonzero(~first), WINDOW - STRIDE)):
        for c in range(0, len(part), BATCH):
            yield part[c : c + BATCH], skip


def sequence(ids: bytes) -> np.ndarray:
    return np.concatenate([[BEGIN], np.frombuffer(ids, "<u2").astype(np.int32), [END]])


def parts_of(packed: list[bytes]):
    """Pieces of a batch of about AT_ONCE ids, no text cut."""
    for a, z in slices(packed, 2 * AT_ONCE):
        yield a, [sequence(x) for x in packed[a:z]]


def log10_of(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 p of each sequence."""
    windows, targets, on, of = in_windows(sequences)
    out, tables = np.zeros(len(sequences)), model.tables()
    for k, skip in steps_of(of):
        p = model.probability(windows[k], targets[k], skip, tables)
        np.log(np.maximum(p, 1e-30, out=p), out=p)
        p *= on[k, skip:]
        out += np.bincount(of[k], p @ np.ones(p.shape[1], np.float32), len(out))
    return out / math.log(10)


def learn_from(model: Model, sequences: list[np.ndarray], squares: dict) -> int:
    """Training over every prediction of the sequences, once, in windows side by side; the number of windows."""
    windows, targets, on, _ = in_windows(sequences, WINDOW)
    for c in range(0, len(windows), STEP):
        k = slice(c, c + STEP)
        model.learn(windows[k], targets[k], on[k], squares)
    return len(windows)


def hashed_word(word: bytes | str) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def word_counts(training: DataFrame) -> DataFrame:
    """(word, n) of all words of the training texts; counted inside tasks before they are shuffled."""

    def count(batches):
        for batch in batches:
            texts = batch.column(0)
            part = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // CHARS_COUNTED
            cuts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(texts)], strict=True):
                words = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(a, b - a))).flatten()
                found = pc.value_counts(words.filter(pc.not_equal(words, "")))
                yield pa.RecordBatch.from_arrays([found.field(0).cast(pa.binary()), found.field(1)], names=["word", "n"])

    return training.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def least_frequent(words: DataFrame, most: int = FREQUENT) -> int:
    """A count that at most so many words have or exceed, and nearly so many: a histogram of some thousand bins at most
    (64 to each doubling) comes back. Words of one bin are held all or none."""
    above, least = 0, 1 << 62
    bins = words.groupBy(F.floor(F.log2("n") * 64).alias("bin")).agg(F.count("*").alias("types"), F.min("n").alias("least"))
    for _, types, n in sorted(map(tuple, bins.collect()), reverse=True):
        above += types
        if above > most:
            break
        least = n
    return least


_HELD: dict[str, dict[str, float]] = {}


def frequent_words(folder: str) -> dict[str, float]:
    """The logarithms in a bounded table, read once by each worker from the shared folder."""
    if folder not in _HELD:
        import pyarrow.dataset as ds
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(folder)
        rows = ds.dataset(path, filesystem=files, format="parquet").to_table()
        _HELD.clear()
        _HELD[folder] = dict(zip(rows["word"].cast(pa.string()).to_numpy().tolist(), rows["log"].to_numpy().tolist(), strict=True))
    return _HELD[folder]


_ENCODED = "row long, doc_id string, held_out boolean, round int, n_tokens long, n_known long, base double, rare array<long>, times array<int>, ids binary"


def encoded_texts(texts: list[str], frequent: dict[str, float], coder: ByteIds) -> pd.DataFrame:
    """Columns n_tokens to ids of _ENCODED: each different word is looked up once, all else goes by the words' numbers."""
    codes, begins, words = coded(pc.ascii_lower(pa.array(texts, pa.string())))
    ids, id_begins = gathered(codes, begins, coder.known.of(words, coder.each), np.dtype("<u2"))
    logs = np.fromiter(map(frequent.get, words, repeat(math.nan)), float, len(words))
    hashes = np.zeros(len(words), np.int64)
    for k in np.flatnonzero(np.isnan(logs)).tolist():
        hashes[k] = hashed_word(words[k])
    n = len(texts)
    of, logs = np.repeat(np.arange(n), np.diff(begins)), logs[codes]
    rare = np.isnan(logs)
    met, times = np.unique(of[rare] * len(words) + codes[rare], return_counts=True)
    hashes = hashes[met % max(len(words), 1)]
    cuts = np.searchsorted(met, np.arange(n + 1) * len(words)).tolist()
    lists = [[x[a:b] for a, b in zip(cuts, cuts[1:], strict=False)] for x in (hashes, times)]
    id_begins = id_begins.tolist()
    return pd.DataFrame({
        "n_tokens": np.diff(begins) + 1,
        "n_known": np.diff(begins) - np.bincount(of[rare], minlength=n),
        "base": np.bincount(of, np.where(rare, 0, logs), n),
        "rare": pd.Series(lists[0], dtype=object),
        "times": pd.Series(lists[1], dtype=object),
        "ids": pd.Series([ids[a:b].tobytes() for a, b in zip(id_begins, id_begins[1:], strict=False)], dtype=object),
    })


def encoded(docs: DataFrame, frequent_at: str, path: str) -> DataFrame:
    """Every row's ids, and its base score as far as the frequent words go; the others' hashes and numbers."""

    def encode(batches):
        frequent, coder = frequent_words(frequent_at), of_worker(ByteIds, path)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in slices(texts, CHARS_AT_ONCE):
                out = encoded_texts(texts[a:b], frequent, coder)
                out.insert(0, "row", range(row, row + b - a))
                row += b - a
                yield pd.concat([batch[["doc_id", "held_out", "round"]].iloc[a:b].reset_index(drop=True), out], axis=1)

    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(SLICES[-1]))
    part = sum((part >= low).cast("int") for low in SLICES[1:-1]).alias("round")
    ids = F.col("doc_id").cast("string").alias("doc_id")  # as text: pandas would make doubles of longs beside a null
    return docs.select(ids, "text", "held_out", part).mapInPandas(encode, _ENCODED)


def id_counts(training: DataFrame) -> np.ndarray:
    """How often each id is a target in the training sequences (ids binary); at most N_IDS rows come back."""

    def count(batches):
        n = np.zeros(N_IDS, np.int64)
        for batch in batches:
            n += np.bincount(np.frombuffer(b"".join(batch["ids"]), "<u2"), minlength=N_IDS)
            n[END] += len(batch)
        at = np.flatnonzero(n)
        yield pd.DataFrame({"id": at, "n": n[at]})

    out = np.zeros(N_IDS, np.int64)
    for i, n in training.select("ids").mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n")).collect():
        out[i] = n
    return out


def pair_counts(training: DataFrame, bucket: np.ndarray) -> np.ndarray:
    """n[a, b]: how often bucket b follows bucket a; summed by Spark, packed to at most BUCKETS rows to come back."""

    def count(batches):
        n = np.zeros(BUCKETS * BUCKETS, np.int64)
        for batch in batches:
            for _, sequences in parts_of(batch["ids"].tolist()):
                flat = bucket[np.concatenate(sequences)]
                ends = np.cumsum([len(s) for s in sequences])[:-1]
                np.add.at(n, np.delete(flat[:-1] * BUCKETS + flat[1:], ends - 1), 1)  # none from one text to the next
        at = np.flatnonzero(n)
        yield pd.DataFrame({"a": at // BUCKETS, "b": at % BUCKETS, "n": n[at]})

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"a": rows["a"].iloc[:1], "b": [rows["b"].to_numpy("<u4").tobytes()], "n": [rows["n"].to_numpy("<f4").tobytes()]})

    sums = training.select("ids").mapInPandas(count, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    out = np.zeros((BUCKETS, BUCKETS), np.float32)
    for r in sums.groupBy("a").applyInPandas(pack, "a long, b binary, n binary").collect():
        out[r["a"], np.frombuffer(r["b"], "<u4")] = np.frombuffer(r["n"], "<f4")
    return out


def train(training: DataFrame) -> Model:
    """The model of the training sequences (round, ids)."""
    spark = training.sparkSession
    ids = id_counts(training)
    model = Model(ids, pair_counts(training, buckets_of(ids)))
    squares = first_squares(model.p)
    for k in range(len(SLICES) - 1):
        one_round(spark, model, squares, training.where(F.col("round") == k).select("ids"))
    return model


def one_round(spark: SparkSession, model: Model, squares: dict, part: DataFrame) -> None:
    """Tasks train on their texts from the same start; parameters and their squares become the averages."""
    start = write_arrays(spark, "model", model.arrays() | {"s_" + k: v for k, v in squares.items()})

    def local(batches):
        own, windows = None, 0
        for batch in batches:
            if own is None:
                arrays = read_arrays(start)
                own = Model.of(arrays)
                held = {k[2:]: v.copy() for k, v in arrays.items() if k.startswith("s_")} | {"met": np.zeros(BUCKETS)}
            for _, sequences in parts_of(batch["ids"].tolist()):
                windows += learn_from(own, sequences, held)
        if windows:
            met = held.pop("met").astype("<f4")
            rows = []
            for name, v in (own.p | {"s_" + k: v for k, v in held.items()}).items():
                weight = met[:, None] if name in ("embed", "s_embed") else np.float32(windows)
                rows.append((name, TaskContext.get().partitionId() % 64, np.asarray(weight, "<f4").tobytes(), (v * weight).astype("<f4").tobytes()))
            yield pd.DataFrame(rows, columns=["name", "part", "weight", "total"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        weight, total = (sum(np.frombuffer(x, "<f4").astype(np.float64) for x in rows[c]).astype("<f4").tobytes() for c in ("weight", "total"))
        return pd.DataFrame({"name": rows["name"].iloc[:1], "part": [0], "weight": [weight], "total": [total]})

    schema = "name string, part int, weight binary, total binary"
    sums = part.mapInPandas(local, schema).groupBy("name", "part").applyInPandas(add, schema).groupBy("name").applyInPandas(add, schema)
    for r in sums.collect():
        weight, total = np.frombuffer(r["weight"], "<f4"), np.frombuffer(r["total"], "<f4")
        at, name = (squares, r["name"][2:]) if r["name"].startswith("s_") else (model.p, r["name"])
        weight = weight.reshape(-1, *[1] * (at[name].ndim - 1))
        at[name] = np.where(weight > 0, total.reshape(at[name].shape) / np.maximum(weight, 1e-30), at[name]).astype(np.float32)


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """rows (row, ids and others) with their model scores in place of ids."""
    model_at = write_arrays(rows.sparkSession, "model", model.arrays())
    others = [c for c in rows.columns if c != "ids"]

    def score(batches):
        model = Model.of(read_arrays(model_at))
        for batch in batches:
            out = batch[others].copy()
            out["score"] = np.concatenate([np.zeros(0), *(log10_of(model, s) for _, s in parts_of(batch["ids"].tolist()))])
            yield out

    return rows.mapInPandas(score, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("ids").schema) + ", score double")


def score_texts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Contract columns of every row of docs (doc_id, text)."""
    spark, path = docs.sparkSession, path or vocabulary(TOKENIZER)
    fold = F.pmod(F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")), F.lit(FOLDS))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (fold == HELD_OUT).alias("held_out"))
    training = docs.where(~F.col("held_out"))
    words = write_and_read(word_counts(training), "words")
    ends = training.count()
    types, total = words.agg(F.count("*"), F.sum("n")).first()
    n_train, n_types = (total or 0) + ends, types + bool(ends)
    frequent = new_folder(spark, "frequent-words")
    words.where(F.col("n") >= least_frequent(words)).select("word", F.log10(F.col("n") + 1).alias("log")).repartition(1).write.parquet(frequent)
    with small_batches(spark):
        texts = write_and_read(encoded(docs, frequent, path), "encoded", ["round"])
        model = train(texts.where(~F.col("held_out")))
        rows = write_and_read(scored(texts.drop("round", "rare", "times"), model), "scored")

    @F.pandas_udf("long")
    def hashed(w: pd.Series) -> pd.Series:
        return w.map(hashed_word)

    known = words.select(hashed("word").alias("rare"), F.log10(F.col("n") + 1).alias("log"))
    met = texts.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("rare"), F.col("r.times").alias("times"))
    met = met.join(known, "rare").groupBy("row").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.col("log")).alias("more"))
    base = F.col("base") + F.coalesce("more", F.lit(0.0)) + math.log10(ends + 1) - F.col("n_tokens") * math.log10(n_train + n_types + 1)
    n_known = F.col("n_known") + F.coalesce("more_known", F.lit(0)) + int(ends > 0)
    return rows.join(met, "row", "left").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "held_out", "n_tokens", n_known.cast("long").alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; learned from those outside the held-out fold."""
    return score_texts(table(spark, sf_dir, "documents"))
