"""Arithmetic on sampled sound: rows (key..., pos, value) with value in -1..1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonaris.operators.events import DEFAULT_TEMPO, absolute_times


def normalize_audio(df: DataFrame, *, key: list[str], value: str = "value", method: str = "peak", level_db: float = -1.0, channel: str | None = None, eps: float = 1e-9, out: str = "normalized") -> DataFrame:
    """Brings the peak or the root mean square of each key (and channel, if given) to a level; clips at 1."""
    by = [*key, channel] if channel else key
    measure: dict[str, Column] = {"peak": F.max(F.abs(value)), "rms": F.sqrt(F.avg(F.col(value) * F.col(value)))}
    if method not in measure:
        raise ValueError(f"unknown method {method!r}")
    sizes = df.groupBy(*by).agg(measure[method].alias("__size"))
    gain = F.pow(F.lit(10.0), F.lit(level_db / 20)) / F.greatest("__size", F.lit(eps))
    return df.join(sizes, by).withColumn(out, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(value) * gain))).drop("__size")


def trim_silence(df: DataFrame, *, key: list[str], pos: str = "pos", value: str = "value", threshold: float = 0.1) -> DataFrame:
    """Drops what follows the last sample above threshold times the deviation of the absolute samples."""
    level = df.groupBy(*key).agg((F.stddev_pop(F.abs(value)) * threshold).alias("__level"))
    rows = df.join(level, key)
    last = rows.where(F.abs(value) > F.col("__level")).groupBy(*key).agg(F.max(pos).alias("__last"))
    return rows.join(last, key).where(F.col(pos) <= F.col("__last")).drop("__level", "__last")


def to_int16(df: DataFrame, *, key: list[str], value: str = "value", out: str = "sample") -> DataFrame:
    """Samples scaled so that the peak of each key is 32767; silence stays silent."""
    peak = df.groupBy(*key).agg(F.max(F.abs(value)).alias("__peak"))
    scaled = F.when(F.col("__peak") > 0, F.col(value) / F.col("__peak") * 32767).otherwise(0.0)
    return df.join(peak, key).withColumn(out, scaled.cast("int")).drop("__peak")


def merged_events(opus: DataFrame) -> DataFrame:
    """All events of a file in one line by absolute time; of one time by track and order."""
    rows = absolute_times(opus)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("file_id").orderBy("time", "track", "seq")) - 1)


def sample_schedule(opus: DataFrame, *, rate: int = 16000, ticks: str = "ticks") -> DataFrame:
    """merged_events with tempo, wait (samples before the event, cut to whole numbers) and sample (their sum)."""
    rows = merged_events(opus)
    line = Window.partitionBy("file_id").orderBy("place")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    tempo = F.coalesce(F.last(F.when(F.col("event") == "set_tempo", F.col("a")), ignorenulls=True).over(before), F.lit(DEFAULT_TEMPO))
    gap = F.col("time") - F.lag("time", 1, 0).over(line)
    rows = rows.withColumn("tempo", tempo).withColumn("wait", (gap * F.col("tempo") / F.col(ticks) / 1e6 * rate).cast("long"))
    return rows.withColumn("sample", F.sum("wait").over(line.rowsBetween(Window.unboundedPreceding, 0)))
