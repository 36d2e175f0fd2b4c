"""Whitening of embeddings by moments that partitions compute and Chan's formula merges.

Entries c become integers x = floor(1024 c) + 100000. Each partition sums its count, its integer
totals, its mean and the scatter about that mean; pairs of partitions are merged up a tree
(`treeReduce`), so that the driver gets one matrix of dimension by dimension, whatever the number of
rows. It takes the eigenvectors of the covariance; a second pass whitens all rows with them and
measures, by moments of the same kind, how far the covariance of the result is from the identity.
Moments are taken of x - 100000, which has the same scatter and the same deviations but fewer bits.

Defined results: vectors that are null, empty or hold null or non-finite entries take no part, nor do
those with entries of 2^52 or more in size (x would not be a long) or of another length than most
vectors have (of equally frequent lengths, the smallest counts). Components whose variance is under
RANK of the largest cannot be told from rounding and have no rows, so that a single vector, or equal
ones, give none. Null and repeated vec_ids and repeated rows are rows of their own. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import table

COMPONENTS = 8
SCALE = 1024
#: Least variance of a component, as a part of the largest one.
RANK = 1e-11


@dataclass
class Moments:
    """Count, integer totals (None of whitened values), mean and centred scatter of some rows."""

    n: int
    total: list[int] | None
    mean: np.ndarray
    scatter: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray) -> Moments:
        values = rows.astype(np.float64)
        mean = values.mean(axis=0)
        centred = values - mean
        off = centred.mean(axis=0)  # what rounding left in the mean
        scatter = centred.T @ centred - len(rows) * np.outer(off, off)
        return cls(len(rows), exact_sums(rows) if rows.dtype == np.int64 else None, mean + off, scatter)

    def merged(self, other: Moments) -> Moments:
        n = self.n + other.n
        step = other.mean - self.mean
        total = None if self.total is None else [a + b for a, b in zip(self.total, other.total, strict=True)]
        scatter = self.scatter + other.scatter + np.outer(step, step) * (self.n * (other.n / n))
        return Moments(n, total, self.mean + step * (other.n / n), scatter)


def exact_sums(rows: np.ndarray) -> list[int]:
    """Sums of the columns of integers, as integers without a bound."""
    largest = max(abs(int(rows.max())), abs(int(rows.min())))
    if largest * len(rows) < 1 << 62:
        return rows.sum(axis=0).tolist()
    return rows.astype(object).sum(axis=0).tolist()


def squared_deviations(rows: np.ndarray, n: int, total: list[int]) -> list[int]:
    """Sum over dimensions of (n x - S)^2 of each row, exactly."""
    largest = n * max(abs(int(rows.max())), abs(int(rows.min()))) + max(map(abs, total))
    if largest * largest * rows.shape[1] < 1 << 62:
        away = rows * np.int64(n) - np.array(total, np.int64)
        return (away * away).sum(axis=1).tolist()
    away = rows.astype(object) * n - np.array(total, object)
    return (away * away).sum(axis=1).tolist()


@dataclass
class Whitening:
    """Mean and axes that whiten, of the rows that they were fitted to."""

    n: int
    total: list[int]
    axes: np.ndarray  # a column for each component, over the root of its variance
    explained: np.ndarray

    @classmethod
    def of(cls, m: Moments, components: int) -> Whitening:
        covariance = m.scatter / m.n
        values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
        order = [i for i in np.argsort(values)[::-1][:components] if values[i] > max(RANK * values[-1], 0.0)]
        return cls(m.n, m.total, vectors[:, order] / np.sqrt(values[order]), values[order] / np.trace(covariance) if order else np.empty(0))

    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.total])

    def apply(self, rows: np.ndarray) -> np.ndarray:
        return (rows - self.mean()) @ self.axes


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): the rows that take part."""
    rows = vectors.where("embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(1 << 52)))
    rows = rows.where(F.coalesce(fine, F.lit(False)) & (F.size("v") > 0))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (sizes["d"] if sizes else 0))


def integers(batch: pa.RecordBatch) -> np.ndarray:
    """floor(SCALE c) of the vectors of a batch, a row each."""
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
    return np.floor(flat * SCALE).astype(np.int64).reshape(batch.num_rows, -1)


def moments(rows: DataFrame, values) -> Moments | None:
    """Moments of `values(batch)` over all batches of `rows`, merged up a tree; None if there are no rows."""

    def partial(batches):
        mine = None
        for batch in batches:
            if batch.num_rows:
                here = Moments.of(values(batch))
                mine = here if mine is None else mine.merged(here)
        if mine is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(mine)], pa.binary())], names=["m"])

    parts = rows.mapInArrow(partial, "m binary").rdd.map(lambda r: pickle.loads(r["m"]))
    if rows.isEmpty():
        return None
    return parts.treeReduce(lambda a, b: a.merged(b), 3 if parts.getNumPartitions() > 4096 else 2)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation (exact), whitened, explained and identity_error of each vector and component."""
    rows = usable(vectors)
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    fitted = moments(rows, integers)
    w = Whitening.of(fitted, components) if fitted else None
    if w is None or not w.axes.shape[1]:
        return vectors.sparkSession.createDataFrame([], schema)
    k = w.axes.shape[1]
    again = moments(rows, lambda batch: w.apply(integers(batch)))
    error = float(np.abs(again.scatter / again.n - np.eye(k)).max())

    def out(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = integers(batch)
            each = pa.array(np.repeat(np.arange(len(x)), k))
            away = pa.array([Decimal(d) for d in squared_deviations(x, w.n, w.total)], pa.decimal128(38, 0))
            columns = [
                batch.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, w.n)),
                away.take(each), pa.array(w.apply(x).ravel()), pa.array(np.tile(w.explained, len(x))), pa.array(np.full(len(x) * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(out, schema)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deviation as a long (null where a long cannot hold it) and, exact at any size, as a decimal."""
    out = whiten(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "component", "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained", "identity_error", F.col("deviation").alias("deviation_decimal"))
