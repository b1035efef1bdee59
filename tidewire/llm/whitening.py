"""Whitening of vectors by Chan's merging.

An entry c becomes the whole number floor(64 c) + 1000000; the fit list is each distinct whole vector once, so a vector
with a third of all rows counts once. Each partition works out count, exact sums and the scatter about its own mean;
summaries of two partitions merge by Chan's formula in a treeReduce, the means' difference taken from the exact
sums. The driver has the covariance of one small matrix and its eigenvectors. A second pass over the fit list
merges the whitened vectors' covariance in the same way and compares it with the identity. Then every row is projected
where it lies.

Vectors that are null, empty, or hold null or non-finite entries take no part, nor do those of another
dimension than the commonest (of equally common ones, the smallest). Entries beyond 2^46 are held there. Components
with an eigenvalue under 1e-12 of the largest cannot be whitened and are left out, so a table of one distinct vector
gives no rows, as an empty one does. Repeated rows and rows with a null or repeated vec_id are rows of their own. A
deviation beyond 64 bits is null. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.common import Stored, ship, sliced, table

COMPONENTS, SCALE, SHIFT = 16, 64, 1_000_000
#: Entries are held within this bound, so that sums of 2^17 of them fit 64 bits.
BOUND = 2.0**46
#: An eigenvalue below this share of the largest has no direction to whiten.
FLAT = 1e-12


class Summary(NamedTuple):
    """Of whole or whitened vectors: count, sums (of whole vectors exact), scatter about the mean."""

    n: int
    sums: np.ndarray
    scatter: np.ndarray


def summary(x: np.ndarray) -> Summary:
    """Of the rows of x; sums of whole numbers are Python's, so they never overflow."""
    n = len(x)
    sums = x.sum(0)
    sums = sums.astype(object) if x.dtype.kind == "i" else sums
    centred = x - (sums / max(n, 1)).astype(float)
    return Summary(n, sums, centred.T @ centred)


def merged(a: Summary | None, b: Summary | None) -> Summary | None:
    """Chan's pairwise formula."""
    if a is None or b is None:
        return b if a is None else a
    n = a.n + b.n
    delta = ((b.sums * a.n - a.sums * b.n) / (a.n * b.n)).astype(float)
    return Summary(n, a.sums + b.sums, a.scatter + b.scatter + np.outer(delta, delta) * (a.n * b.n / n))


@dataclass(frozen=True)
class Whitening:
    """The fit list's count, exact sums, eigenvalues in falling order with their unit vectors as columns, and the variance of all dimensions."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    total: float

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Projections of whole vectors less the exact mean, each over its component's standard deviation."""
        low = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return ((x - low) - rest) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sums over the dimensions of (n x - S)^2, exact; None beyond 64 bits."""
        low = np.array([s // self.n for s in self.sums], np.int64)
        rest = [s % self.n for s in self.sums]
        most = max(1, int(np.abs(x - low).max(initial=0)) + 1) * self.n
        if most * most * x.shape[1] < 2**63:
            off = (x - low) * self.n - np.array(rest, np.int64)
            return (off * off).sum(1).tolist()
        exact = [sum((int(v) * self.n - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in x - low]
        return [d if d < 2**63 else None for d in exact]


def _sound(vector: Column) -> Column:
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def whole(vectors: DataFrame) -> DataFrame:
    """vec_id and x, the whole numbers of each sound vector of the commonest dimension."""
    sound = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where(_sound(F.col("v")))
    common = sound.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    held = F.transform("v", lambda c: F.floor(F.least(F.greatest(c * SCALE, F.lit(-BOUND)), F.lit(BOUND))) + F.lit(SHIFT).cast("long"))
    return sound.where(F.size("v") == (common.size if common else 0)).select("vec_id", held.alias("x"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _merged_over(fit: DataFrame, shape) -> Summary | None:
    """The summary of shape(x) over all partitions: one for each, merged in a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        whole = None
        for batch in batches:
            if batch.num_rows:
                whole = merged(whole, summary(shape(_matrix(batch.column(0)))))
        yield pa.RecordBatch.from_pydict({"part": pa.array([pickle.dumps(whole)], pa.binary())})

    def opened(row) -> Summary | None:
        import pickle

        return pickle.loads(row.part)

    parts = fit.mapInArrow(run, "part binary").rdd.map(opened)
    return parts.treeReduce(merged) if parts.getNumPartitions() else None


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """fit: a column x of distinct whole vectors. None if nothing can be whitened."""
    ship(fit.sparkSession)
    s = _merged_over(fit, lambda x: x)
    if s is None:
        return None
    values, vectors = np.linalg.eigh(s.scatter / s.n)
    order = [k for k in np.argsort(-values, kind="stable")[:components] if values[k] > FLAT * values.max()]
    return Whitening(s.n, s.sums, values[order], vectors[:, order], float(np.trace(s.scatter) / s.n)) if order and values.max() > 0 else None


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest entry of the whitened fit list's covariance less the identity."""
    s = _merged_over(fit, model.whitened)
    return float(np.abs(s.scatter / s.n - np.eye(len(model.values))).max())


FORM = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each sound vector of vectors (vec_id, embedding) and component."""
    spark = ship(vectors.sparkSession)
    rows = whole(vectors)
    fit = Stored(rows.select("x").distinct())
    try:
        model = fit_whitening(fit.rows, components)
        error = identity_error(fit.rows, model) if model else None
    finally:
        fit.drop()
    if model is None:
        return spark.createDataFrame([], FORM)
    share, k = model.values / model.total, len(model.values)
    known = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = known.value
        for batch in sliced(batches, 4096):
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            each = np.repeat(np.arange(len(x)), k)
            deviations = pa.array(model.deviation(x), pa.int64())
            columns = [batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), model.n)), deviations.take(pa.array(each))]
            columns += [pa.array(model.whitened(x).ravel()), pa.array(np.tile(share, len(x))), pa.array(np.full(len(each), error))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select(F.col("vec_id").cast("long"), "x").mapInArrow(run, FORM)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
