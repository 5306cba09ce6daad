"""Session set-up: how this package reaches the executors, and the settings that it expects."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


#: Rows of an Arrow batch: texts may be long, and a batch is held in the JVM and in the worker.
ARROW_ROWS = 2000
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, and send them smaller
    batches than the default. On a cluster whose executors lack that folder, pass the package with
    --py-files instead."""
    if spark.conf.get(_ARROW_ROWS, "10000") == "10000":
        spark.conf.set(_ARROW_ROWS, str(ARROW_ROWS))
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH", "")]))
    return spark


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the benchmark."""
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("sonaris")
             .config("spark.sql.shuffle.partitions", str(partitions))
             .config("spark.driver.memory", memory)
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false")
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)
