"""Operator 11: whitening of embeddings by a two-pass covariance.

A vector's entries become whole numbers x = floor(64 c) + 1000000. The fit list has each distinct x vector once.

1. First pass: exact whole sums S of each dimension and the number n of vectors, so the mean S / n is exact.
2. Second pass: each task centres its vectors before it multiplies them (NumPy GEMM) and keeps one d x d matrix;
   treeAggregate adds the matrices in levels, so the driver gets a few, however many tasks there are.
3. LAPACK's symmetric eigh on the driver, and the projection (d x components doubles) as a broadcast variable. Both are
   bounded by the dimension, not by the rows.
4. A third pass over the fit list takes the whitened vectors' own covariance, which should be the identity.

Centring takes the whole part of the mean off first, in whole numbers, and its fraction last: nothing cancels.

Defined cases: rows whose vector is null or holds a null or non-finite entry are dropped, and so are those of another
length than most rows have (of lengths as common, the greater stays); entries beyond LIMIT / 64 count as that; equal
vectors of many rows count once in the fit and are whitened each; null keys stay; directions without variance (an
eigenvalue below FLAT of the largest) are no components, so one vector alone, or empty vectors, have none; an empty
table gives an empty result; a deviation that no long holds is null; extra columns stay, and those named like an added
one are replaced.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import spare, table, write_and_read

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
LIMIT = float(1 << 42)
FLAT = 1e-12
#: Levels of the merges: the driver gets about the DEPTH-th root of the number of tasks.
DEPTH = 3


@dataclass
class Whitening:
    """n, whole part and remainder of S / n, and by component: projection (d x k), eigenvalue, share of the trace."""

    n: int = 0
    whole: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    projection: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    explained: np.ndarray = field(default_factory=lambda: np.zeros(0))
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.left / max(self.n, 1)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 of each row, exact; None beyond a long."""
        y = x - self.whole
        most = self.n * (int(np.abs(y).max(initial=0)) + 1)
        if most * most * max(1, x.shape[1]) < 1 << 63:
            z = self.n * y - self.left
            return (z * z).sum(1).tolist()
        out = [sum((self.n * a - b) ** 2 for a, b in zip(r, self.left.tolist(), strict=True)) for r in y.tolist()]
        return [v if v < 1 << 63 else None for v in out]


def whole_entries(vector: Column) -> Column:
    """x of a vector without null or non-finite entries, null for others."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != F.lit(float("inf"))))
    bounded = lambda c: F.greatest(F.least(c.cast("double") * SCALE, F.lit(LIMIT)), F.lit(-LIMIT))
    return F.when(fine, F.transform(vector, lambda c: (F.floor(bounded(c)) + SHIFT).cast("long")))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), size)


def merged(rows: DataFrame, start, step, add):
    """Over all Arrow batches of rows: step(state, batch) inside a task from start, add(state, state) across tasks; None
    without tasks that met a batch."""

    def partial(batches):
        state = None
        for batch in batches:
            state = step(start() if state is None else state, batch)
        if state is not None:
            yield pa.record_batch([pa.array([pickle.dumps(state)], pa.binary())], ["state"])

    def both(a, b):
        return b if a is None else a if b is None else add(a, b)

    states = rows.mapInArrow(partial, "state binary").rdd.map(lambda r: pickle.loads(r[0]))
    return states.treeAggregate(None, both, both, DEPTH)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening:
    """The whitening of a table of distinct vectors (x array<long>, all of one length): three passes over it."""
    first = vectors.select(F.size("x")).first()
    size = first[0] if first else 0
    if not size:
        return Whitening(vectors.count() if first else 0)

    def sums(state, batch):
        n, s = state
        part = _matrix(batch.column(0), size)
        return n + len(part), s + part.sum(0).astype(object)  # a batch's sums fit in longs; their sums needn't

    n, s = merged(vectors, lambda: (0, np.zeros(size, object)), sums, lambda a, b: (a[0] + b[0], a[1] + b[1]))
    out = Whitening(n, np.array([int(v) // n for v in s], np.int64), np.array([int(v) % n for v in s], np.int64))

    def outer(state, batch):
        c = out.centred(_matrix(batch.column(0), size))
        return state + c.T @ c

    covariance = merged(vectors, lambda: np.zeros((size, size)), outer, np.add) / n
    values, directions = np.linalg.eigh(covariance)
    order = [k for k in np.argsort(-values, kind="stable")[:components] if values[k] > FLAT * max(values.max(), 0) and values[k] > 0]
    out.values, out.explained = values[order], values[order] / np.trace(covariance)
    out.projection = directions[:, order] / np.sqrt(values[order])

    def whitened(state, batch):
        w = out.centred(_matrix(batch.column(0), size)) @ out.projection
        return state + w.T @ w

    if order:
        got = merged(vectors, lambda: np.zeros((len(order), len(order))), whitened, np.add) / n
        out.identity_error = float(np.abs(got - np.eye(len(order))).max())
    return out


def whiten(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, Whitening]:
    """df's rows that have a vector, with deviation long and whitened array<double>; and the whitening itself."""
    spark = df.sparkSession
    x, = spare(df, "x")
    rows = df.withColumn(x, whole_entries(F.col(vector))).where(F.col(x).isNotNull())
    common = rows.groupBy(F.size(x).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = common["size"] if common else 0
    rows = rows.where(F.size(x) == size)
    found = fit(write_and_read(rows.select(F.col(x).alias("x")).distinct(), "fit"), components)
    shared = spark.sparkContext.broadcast(found)
    keep = [c for c in df.columns if c.lower() not in ("deviation", "whitened")]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])

    def project(batches):
        own = shared.value
        k = own.projection.shape[1]
        for batch in batches:
            at = batch.num_columns - 1
            m = _matrix(batch.column(at), size)
            w = own.centred(m) @ own.projection if k else np.zeros((len(m), 0))
            lists = pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * k, pa.array(w.ravel()))
            columns = [*batch.columns[:at], pa.array(own.deviations(m), pa.int64()), lists]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:at], "deviation", "whitened"])

    return rows.select(*(F.col(f"`{c}`") for c in keep), x).mapInArrow(project, schema), found


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings by their first 16 components, a row each."""
    rows, found = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    shares = F.array(*map(F.lit, found.explained.tolist())).cast("array<double>")
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(found.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(found.identity_error).alias("identity_error"),
    )
