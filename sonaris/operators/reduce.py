"""Principal components from mergeable moments.

One pass sums, in every task, the count, the sum and the product matrix of its rows around a shared
shift; the driver adds those few matrices, takes the eigenvectors of the covariance and returns a result
whose reduced table is a lazy second pass.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonaris.sources.files import save_arrays

TARGET, MAX_DIM = 128, 8192


@dataclass
class Reduction:
    """What a reduction gives: the lazy reduced table (key, reduced array<float>) and driver-side arrays."""

    reduced: DataFrame
    mean: np.ndarray
    covariance: np.ndarray
    eigenvalues: np.ndarray
    eigenvectors: np.ndarray
    projection: np.ndarray
    explained_variance_ratio: np.ndarray
    cumulative_variance: np.ndarray
    n: int
    d: int
    k: int
    settings: dict = field(default_factory=dict)

    def save(self, folder: str) -> list[str]:
        """The reduced table as Parquet and the arrays as .npy files."""
        self.reduced.write.mode("overwrite").parquet(f"{folder}/reduced.parquet")
        return save_arrays(folder, {name: getattr(self, name) for name in ("mean", "covariance", "eigenvalues", "projection", "explained_variance_ratio")})


def _rows(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 0))
    if column.null_count or len(set(np.asarray(column.value_lengths()).tolist())) != 1:
        raise ValueError("vectors must have one length and not be null")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def moments(df: DataFrame, *, vector: str = "embedding") -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, scatter around the mean). Partial results are merged by Chan's formula, task by task
    in Spark's tree, so the driver sees the square root of the number of tasks."""
    schema = "part int, n long, mean binary, scatter binary"

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            x = _rows(b.column("v"))
            if len(x):
                mean = x.mean(0)
                total = merge_moments(total, (len(x), mean, (x - mean).T @ (x - mean)))
        if total is not None:
            yield _packed(TaskContext.get().partitionId(), total)

    def many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for t in _unpacked(b):
                total = merge_moments(total, t)
        if total is not None:
            yield _packed(0, total)

    first = df.select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(one, schema)
    width = max(1, int(np.ceil(np.sqrt(df.sparkSession.sparkContext.defaultParallelism))))
    total = None
    for t in _unpacked(first.repartition(width).mapInArrow(many, schema).toArrow()):
        total = merge_moments(total, t)
    if total is None:
        raise ValueError("no rows")
    return total


def merge_moments(a, b):
    """The moments of two disjoint sets of rows together."""
    if a is None:
        return b
    if b is None:
        return a
    n = a[0] + b[0]
    delta = b[1] - a[1]
    return n, a[1] + delta * (b[0] / n), a[2] + b[2] + np.outer(delta, delta) * (a[0] * b[0] / n)


def _packed(part: int, t) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([int(part)], pa.int32()), pa.array([t[0]], pa.int64()), pa.array([t[1].tobytes()], pa.binary()), pa.array([t[2].tobytes()], pa.binary())], ["part", "n", "mean", "scatter"])


def _unpacked(b) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for n, mean, scatter in zip(b.column("n").to_pylist(), b.column("mean").to_pylist(), b.column("scatter").to_pylist()):
        m = np.frombuffer(mean, np.float64)
        yield n, m, np.frombuffer(scatter, np.float64).reshape(len(m), len(m))


def approximate_scatter(df: DataFrame, batch: int, *, key: str, vector: str = "embedding") -> tuple[int, np.ndarray, np.ndarray]:
    """Scatters of batches of rows in order of the key added without the term for their means' distance:
    smaller than the exact one, and dependent on the batches."""
    ranked = df.select(key, F.col(vector).cast("array<double>").alias("v")).repartitionByRange(key).sortWithinPartitions(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                x = _rows(b.column("v").slice(at, batch))
                mean = x.mean(0)
                yield _packed(0, (len(x), mean, (x - mean).T @ (x - mean)))

    n, total, scatter = 0, 0.0, 0.0
    for m, mean, s in _unpacked(ranked.mapInArrow(run, "part int, n long, mean binary, scatter binary").toArrow()):
        n, total, scatter = n + m, total + m * mean, scatter + s
    return n, total / n, scatter


def pca(df: DataFrame, target_dim: int = TARGET, *, key: str = "vec_id", vector: str = "embedding", exact_covariance: bool = True, batch_size: int = 512_000, save_dir: str | None = None) -> Reduction:
    """Rows projected on the target_dim directions of most variance. Signs of components, and the order
    of equal eigenvalues, are as the eigensolver gives them."""
    n, mean, scatter = moments(df, vector=vector) if exact_covariance else approximate_scatter(df, batch_size, key=key, vector=vector)
    d = len(mean)
    if n < 2:
        raise ValueError("at least two rows are needed")
    if not 1 <= target_dim <= d:
        raise ValueError(f"target_dim must be 1 to {d}")
    if d > MAX_DIM:
        raise ValueError(f"covariances of more than {MAX_DIM} dimensions don't belong on the driver")
    if target_dim > min(n - 1, d):
        warnings.warn("target_dim exceeds the rank that the rows can have", RuntimeWarning, stacklevel=2)
    covariance = scatter / (n - 1)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    if not np.isfinite(values).all() or values.sum() <= 0:
        raise ValueError("the rows have no finite variance")
    ratio = values / values.sum()
    w = vectors[:, :target_dim].astype(np.float32)
    out = Reduction(project(df, mean, w, key=key, vector=vector), mean, covariance, values, vectors, w, ratio[:target_dim], np.cumsum(ratio)[:target_dim], n, d, target_dim, {"exact_covariance": exact_covariance})
    if save_dir:
        out.save(save_dir)
    return out


def project(df: DataFrame, mean: np.ndarray, w: np.ndarray, *, key: str, vector: str) -> DataFrame:
    """(key, reduced array<float>): (x - mean) W in single precision. mean and W are d x k at most."""
    shared = df.sparkSession.sparkContext.broadcast((mean.astype(np.float32), w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, matrix = shared.value
        for b in batches:
            if b.num_rows:
                y = (_rows(b.column("v")).astype(np.float32) - m) @ matrix
                yield pa.RecordBatch.from_arrays([b.column("key"), pa.FixedSizeListArray.from_arrays(pa.array(y.reshape(-1)), y.shape[1]).cast(pa.list_(pa.float32()))], ["key", "reduced"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, f"key {kind}, reduced array<float>").withColumnRenamed("key", key)


def variance_checkpoints(k: int) -> list[int]:
    """The powers of two below k, and k."""
    out, p = [], 1
    while p < k:
        out.append(p)
        p *= 2
    return [*out, k]


def components_for(cumulative: np.ndarray, shares: tuple[float, ...] = (0.90, 0.95, 0.99)) -> dict[float, int]:
    """How many components reach each share of the variance, all of them if none does."""
    return {s: min(int(np.searchsorted(cumulative, s)) + 1, len(cumulative)) for s in shares}


def covariance_native(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(i, j, cov) for i <= j by aggregation in Spark: for few dimensions and SQL comparison."""
    size = F.size(vector)
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.transform(F.sequence(i, size - 1), lambda j: F.struct(
        i.alias("i"), j.alias("j"), F.get(F.col(vector), i).cast("double").alias("x"), F.get(F.col(vector), j).cast("double").alias("y")))))
    return df.select(F.explode(pairs).alias("p")).select("p.*").groupBy("i", "j").agg(F.covar_samp("x", "y").alias("cov"))
