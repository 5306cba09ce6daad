"""Incremental forms of the mergeable operators, for Structured Streaming.

Top-k lists and moments merge associatively, so each micro-batch is folded into a stored state, which is
written under its batch's number: a batch that is run again writes the same state again.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonaris.operators.reduce import merge_moments, moments
from sonaris.operators.search import similarity_topk


class _States:
    """Numbered states below a path. A batch reads the last state before its own, so a new process goes on where
    another ended and a batch that is run again gives the same; the last two are kept."""

    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")

    def _fs(self, spark: SparkSession):
        at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at, at.getFileSystem(spark._jsc.hadoopConfiguration())

    def written(self, spark: SparkSession) -> list[int]:
        """The batches whose state is whole, in order."""
        at, fs = self._fs(spark)
        names = [f.getPath() for f in fs.listStatus(at)] if fs.exists(at) else []
        whole = [p.getName() for p in names if p.getName().startswith("batch=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(name.split("=")[1]) for name in whole)

    def before(self, spark: SparkSession, batch_id: int) -> DataFrame | None:
        """The last state of an earlier batch."""
        found = [b for b in self.written(spark) if b < batch_id]
        return self.read(spark, found[-1]) if found else None

    def read(self, spark: SparkSession, batch_id: int | None = None) -> DataFrame:
        """The state after a batch, the last one by default."""
        return spark.read.parquet(f"{self.path}/batch={self.written(spark)[-1] if batch_id is None else batch_id}")

    def write(self, df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        df.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        _, fs = self._fs(spark)
        for old in [b for b in self.written(spark) if b < batch_id][:-1]:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch={old}"), True)


class IncrementalTopK:
    """The k nearest corpus rows of fixed queries, as the corpus streams in; use as foreachBatch."""

    def __init__(self, queries: DataFrame, path: str, *, k: int = 16, **options) -> None:
        self.queries, self.states, self.k, self.options = queries, _States(path), k, options

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        found = similarity_topk(self.queries, batch, k=self.k, **self.options)
        before = self.states.before(batch.sparkSession, batch_id)
        if before is not None:
            found = found.unionByName(before)
        order = Window.partitionBy("query_id").orderBy(F.desc("sim"), "corpus_id")
        self.states.write(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= self.k), batch_id)

    def result(self, spark: SparkSession, batch_id: int | None = None) -> DataFrame:
        """The state after a batch (one of the last two), or after the last."""
        return self.states.read(spark, batch_id)


class IncrementalMoments:
    """Count, mean and scatter of streamed vectors, stored below a path; use as foreachBatch."""

    def __init__(self, path: str, *, vector: str = "embedding") -> None:
        self.states, self.vector = _States(path), vector

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = _moments(self.states.before(spark, batch_id))
        n, mean, scatter = merge_moments(before, None if batch.isEmpty() else moments(batch, vector=self.vector)) or (0, np.zeros(0), np.zeros(0))
        row = [(int(n), [float(x) for x in mean], [float(x) for x in np.ravel(scatter)])]
        self.states.write(spark.createDataFrame(row, "n long, mean array<double>, scatter array<double>").coalesce(1), batch_id)

    def covariance(self, spark: SparkSession) -> np.ndarray:
        """The covariance of all batches so far."""
        n, _, scatter = _moments(self.states.read(spark))
        return scatter / (n - 1)


def _moments(state: DataFrame | None) -> tuple[int, np.ndarray, np.ndarray] | None:
    row = state.first() if state is not None else None
    if row is None or not row.n:
        return None
    return row.n, np.array(row.mean), np.array(row.scatter).reshape(len(row.mean), -1)


def windowed_notes(events: DataFrame, *, time: str = "ts", late: str = "10 minutes", window: str = "5 minutes", key: str = "event_type", value: str = "value") -> DataFrame:
    """Counts and sums of timed events by window and kind, for batch and streaming input alike."""
    timed = events.withColumn(time, F.col(time).cast("timestamp"))  # watermarks need a zone
    return (timed.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
            .select(F.col("window.start").alias("window_start"), key, "n", "total"))
