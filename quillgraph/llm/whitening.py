"""Operator 12, embedding whitening by a two-pass covariance.

  length   the vectors' length is the most frequent one (of equally frequent ones the larger);
  sums     x = floor(SCALE * c) + OFFSET; tasks add x exactly, treeAggregate merges, so mean and centring start from whole numbers;
  second   tasks subtract the mean and add Y^T Y (GEMM), one matrix of length ** 2 for each task; treeAggregate merges on the executors;
  eigen    LAPACK's symmetric solver on the driver, components by falling eigenvalue, each with its largest entry positive;
  audit    a third pass takes the covariance of the whitened vectors themselves, against the identity;
  project  the matrix is broadcast (length times components, checked against MOST_MB), rows are projected where they are.
The driver and the broadcast hold matrices whose size comes from the vectors' length, never from their number. No vector is shuffled.

Edge cases: vectors that are null, hold null or non-finite components, are of another length, or hold a component too large for a long
(SCALE * |c| over 2 ** 62) are dropped; repeated rows and null ids are vectors like others; components without variance (eigenvalue at
most length * epsilon of the largest) can't be whitened and are left out, so equal vectors, or a single one, give no rows; a deviation
that does not fit in a long is null; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import ship
from .grid import lengths, whole_rows

COMPONENTS, SCALE, OFFSET = 32, 64, 1_000_000
MOST, LONG = 1 << 62, (1 << 63) - 1
#: Of a matrix that is broadcast.
MOST_MB = 256
#: Rows that one product takes.
ROWS = 4096


def _added(a, b):
    """Partial results are tuples of numbers and arrays; None has nothing yet."""
    if a is None or b is None:
        return b if a is None else a
    return tuple(x + y for x, y in zip(a, b, strict=True))


def _read(a, row):
    return _added(a, pickle.loads(bytes(row[0])))


def gathered(source: DataFrame, partial, depth: int = 3):
    """The sum of what `partial` (of the vectors of a batch) gives, by task, then by tree; None without vectors."""

    def task(batches):
        total = None
        for batch in batches:
            total = _added(total, partial(batch.column("v")))
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": [pickle.dumps(total)]}, schema=pa.schema([("part", pa.binary())]))

    return source.select("v").mapInArrow(task, "part binary").rdd.treeAggregate(None, _read, _added, depth)


def vector_length(source: DataFrame) -> int:
    """The most frequent length of usable vectors; 0 if there is none."""

    def counts(batches):
        for batch in batches:
            size = lengths(batch.column("v"))
            for d in np.unique(size[size > 0]).tolist():
                yield pa.RecordBatch.from_pydict({"d": [d], "n": [len(whole_rows(batch.column("v"), d, SCALE, MOST)[0])]}, schema=pa.schema([("d", pa.int64()), ("n", pa.int64())]))

    best = source.select("v").mapInArrow(counts, "d long, n long").groupBy("d").agg(F.sum("n").alias("n")).where("n > 0").orderBy(F.desc("n"), F.desc("d")).first()
    return best["d"] if best else 0


def exact_sum(x: np.ndarray) -> np.ndarray:
    """Sums of the columns as Python's whole numbers; the halves of a long can't overflow in a batch."""
    return (x >> 32).sum(axis=0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)


class Centre:
    """The exact mean: S = n * floor + rest, entry by entry."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.floor = np.array([s // n for s in sums], dtype=np.int64)
        self.rest = np.array([s % n for s in sums], dtype=object)
        self.part = np.array([float(r / n) if isinstance(r, float) else r / n for r in self.rest], dtype=np.float64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.floor).astype(np.float64) - self.part

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n * x - S) ** 2, exact; None over a long."""
        y = x - self.floor
        most = self.n * (int(np.abs(y).max(initial=0)) + 1)
        if x.shape[1] * most * most <= LONG:
            return ((y * self.n - self.rest.astype(np.int64)) ** 2).sum(axis=1).tolist()
        near = ((y.astype(np.float64) - self.part) ** 2).sum(axis=1) * float(self.n) ** 2
        out: list[int | None] = [None] * len(x)
        for i in np.flatnonzero(near < 1.01 * LONG).tolist():
            exact = sum((int(v) * self.n - r) ** 2 for v, r in zip(y[i], self.rest, strict=True))
            out[i] = exact if exact <= LONG else None
        return out


def apply(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every usable vector and component."""
    spark = vectors.sparkSession
    ship(spark)
    source = vectors.select(F.col(f"`{id}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    id_type = source.schema["id"].dataType
    schema = f"id {id_type.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    none = spark.createDataFrame([], schema).withColumnRenamed("id", id)
    d = vector_length(source)
    if not d:
        return none
    if d * components * 8 > MOST_MB << 20 or d * d * 8 > MOST_MB << 20:
        raise ValueError(f"matrices of {d} rows are over {MOST_MB} MB")
    rows = lambda v: whole_rows(v, d, SCALE, MOST)[1] + OFFSET

    def add(v):
        x = rows(v)
        return (len(x), exact_sum(x)) if len(x) else None

    n, sums = gathered(source, add)
    centre = spark.sparkContext.broadcast(Centre(n, sums.tolist()))

    def outer(v):
        x, total = rows(v), np.zeros((d, d))
        for at in range(0, len(x), ROWS):
            y = centre.value.centred(x[at : at + ROWS])
            total += y.T @ y
        return (total,)

    covariance = gathered(source, outer)[0] / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")
    values, axes = values[order], axes[:, order]
    k = int(min(components, (values > max(values[0], 0) * d * np.finfo(float).eps).sum()))
    if not k:
        return none
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)
    whiten = spark.sparkContext.broadcast(axes[:, :k] / np.sqrt(values[:k]))
    explained = values[:k] / np.trace(covariance)

    def again(v):
        x, total, z_sum = rows(v), np.zeros((k, k)), np.zeros(k)
        for at in range(0, len(x), ROWS):
            z = centre.value.centred(x[at : at + ROWS]) @ whiten.value
            total, z_sum = total + z.T @ z, z_sum + z.sum(axis=0)
        return total, z_sum

    # rows are centred exactly before they are projected, so this mean is a rounding error; it is taken off too
    total, z_sum = gathered(source, again)
    identity_error = float(np.abs(total / n - np.outer(z_sum / n, z_sum / n) - np.eye(k)).max())

    def project(batches):
        for batch in batches:
            at, x = whole_rows(batch.column("v"), d, SCALE, MOST)
            for low in range(0, len(at), ROWS):
                here, part = at[low : low + ROWS], x[low : low + ROWS] + OFFSET
                m = len(here)
                z = centre.value.centred(part) @ whiten.value
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").take(pa.array(here)).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, dtype=np.int64)),
                    pa.array(centre.value.deviation(part), pa.int64()).take(each), pa.array(z.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, identity_error)),
                ], names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return source.mapInArrow(project, schema).withColumnRenamed("id", id)
