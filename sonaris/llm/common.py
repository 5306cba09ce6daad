"""Small helpers that the training-data operators share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where results are materialised when a local session names no shared folder (tests).
LOCAL_CHECKPOINTS = "/tmp/checkpoints/sonaris"
#: Tables of this process that have not been discarded.
_tables: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, read from the session. Where it is unset, a local session gets a folder for
    tests and any other raises: executors would write to folders of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (found or LOCAL_CHECKPOINTS).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which clean() deletes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _tables.add(path)
    return path


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: it cuts the lineage and every
    later use reads the same rows, also after an executor is lost."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in frames:
        _delete(df.sparkSession, df.scratch)


def clean(spark: SparkSession) -> None:
    """Delete all tables and files that this process has put in the shared folder; results of operators that
    haven't been written or collected can't be read afterwards."""
    for path in list(_tables):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _tables.discard(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame) -> DataFrame:
    """The same columns under new identities, so that two frames of one origin can meet."""
    return df.select(*[F.col(f"`{c}`").alias(c) for c in df.columns])
