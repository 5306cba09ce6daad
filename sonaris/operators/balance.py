"""Class balance of labelled sequences, weights, losses and run-time estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonaris.functions.logits import log_softmax


def balanced_sequences(df: DataFrame, *, tokens: str = "tokens", types: str = "token_types", tol: float = 0.1, target: float = 0.5, min_len: int = 1, max_len: int | None = None) -> DataFrame:
    """Rows whose share of type 1 is within tol of the target and whose length is in bounds, with that
    share in single precision. Lengths of tokens and types that differ raise."""
    n = F.size(types)
    check = F.when(F.size(tokens) != n, F.raise_error(F.lit("tokens and token_types differ in length"))).otherwise(True)
    share = (F.aggregate(types, F.lit(0.0), lambda s, t: s + t) / F.nullif(n, F.lit(0))).cast("float")
    rows = df.where(check.cast("boolean")).withColumn("share", share)
    rows = rows.where((n >= max(1, min_len)) & (F.abs(F.col("share") - target) <= tol + 1e-7))
    return rows.where(n <= max_len) if max_len is not None else rows


def share_stats(df: DataFrame, share: str = "share") -> DataFrame:
    """Mean, population deviation, smallest and largest share of the rows kept."""
    x = F.col(share).cast("double")
    return df.agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), F.count(x).alias("n"))


def class_counts(df: DataFrame, labels: str, num_labels: int, pad: int | None = None) -> DataFrame:
    """(label, n) for labels 0 .. num_labels - 1 of an array column, zeros included; pads don't count."""
    rows = df.select(F.explode(labels).alias("label"))
    rows = rows.where(F.col("label") != pad) if pad is not None else rows
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(num_labels).select(F.col("id").cast("int").alias("label"))
    return every.join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def class_weights(counts: DataFrame, *, smoothing: float = 0.0, power: float = 1.0, max_ratio: float = 50.0) -> DataFrame:
    """(label, n, weight): (1 / n + smoothing) ** power over the smallest such, max_ratio at most; counts of
    0 stand for 1. counts has a row for each class."""
    raw = F.pow(1 / F.greatest(F.col("n"), F.lit(1)) + smoothing, F.lit(power))
    least = counts.agg(F.min(raw).alias("__least"))
    return counts.crossJoin(F.broadcast(least)).withColumn("weight", F.least(raw / F.col("__least"), F.lit(max_ratio))).drop("__least")


def focal_loss(df: DataFrame, *, logits: str = "logits", target: str = "target", valid: str | None = None, gamma: float = 2.0, alpha: dict[int, float] | None = None) -> DataFrame:
    """One row, loss: the mean of (1 - p) ** gamma * -log p * alpha over valid rows."""
    rows = df.where(F.col(valid)) if valid else df
    nll = -F.get(log_softmax(logits), F.col(target))
    table = F.create_map(*[F.lit(v) for pair in (alpha or {}).items() for v in pair]) if alpha else None
    weight: Column = F.coalesce(F.element_at(table, F.col(target)), F.lit(1.0)) if alpha else F.lit(1.0)
    return rows.select(nll.alias("nll"), weight.alias("w")).agg(F.avg(F.pow(1 - F.exp(-F.col("nll")), F.lit(gamma)) * F.col("nll") * F.col("w")).alias("loss"))


def contrastive_loss(sims: DataFrame, *, row: str = "i", col: str = "j", sim: str = "sim", scale: float = 1.0, batch: list[str] | None = None) -> DataFrame:
    """One row (of each batch): the mean cross entropy of the diagonal over rows, over columns, and half their sum.
    sims holds every pair of a batch."""
    batch = batch or []
    x = F.col(sim) * scale
    rows = sims.withColumn("__x", x)
    for name, by in (("rows", row), ("columns", col)):
        w = Window.partitionBy(*batch, by)
        rows = rows.withColumn(f"__top_{name}", F.max("__x").over(w))
        rows = rows.withColumn(f"loss_{name}", F.col(f"__top_{name}") + F.log(F.sum(F.exp(F.col("__x") - F.col(f"__top_{name}"))).over(w)) - F.col("__x"))
    return rows.where(F.col(row) == F.col(col)).groupBy(*batch).agg(F.avg("loss_rows").alias("loss_rows"), F.avg("loss_columns").alias("loss_columns"), ((F.avg("loss_rows") + F.avg("loss_columns")) / 2).alias("loss"))


def contrastive_metrics(sims: DataFrame, *, row: str = "i", col: str = "j", sim: str = "sim", batch: list[str] | None = None, top: int = 5) -> DataFrame:
    """One row (of each batch): recall_at_1, recall_at_top, mrr (0 beyond the top) and macro f1 of the best match, each
    the mean of both directions. The diagonal holds the pairs; of equal similarities the smaller number comes first. What
    has no pair in its batch can be predicted but isn't counted itself."""
    batch = batch or []
    both = []
    for by, other in ((row, col), (col, row)):
        order = Window.partitionBy(*batch, by).orderBy(F.desc(sim), other)
        ranked = sims.select(*batch, F.col(by).alias("__by"), F.col(other).alias("__other"), F.row_number().over(order).alias("__rank"))
        own = F.col("__by") == F.col("__other")
        # of a class with one true row: 2 hits / (1 + times predicted), which is 0 without a hit
        classes = ranked.groupBy(*batch, "__other").agg(F.min(F.when(own, F.col("__rank"))).alias("rank"), F.count(F.when(F.col("__rank") == 1, 1)).alias("predicted")).where("rank IS NOT NULL")
        hit = (F.col("rank") == 1).cast("double")
        both.append(classes.select(*batch, hit.alias("r1"), (F.col("rank") <= top).cast("double").alias("rt"), F.when(F.col("rank") <= top, 1 / F.col("rank")).otherwise(0.0).alias("rr"), (2 * hit / (1 + F.col("predicted"))).alias("f")))
    return both[0].unionByName(both[1]).groupBy(*batch).agg(F.avg("r1").alias("recall_at_1"), F.avg("rt").alias("recall_at_top"), F.avg("rr").alias("mrr"), F.avg("f").alias("f1"))


def eta(df: DataFrame, *, start: str = "start", steps: str = "steps", done: str = "done", seconds: str = "seconds_per_step", zone: str = "UTC", price: str | None = None) -> DataFrame:
    """df with seconds_left, hours, minutes, seconds, ends (in the zone) and, with a price an hour, cost."""
    left = (F.greatest(F.col(steps) - F.col(done), F.lit(0)) * F.col(seconds)).cast("double")
    rows = df.withColumn("seconds_left", left)
    whole = F.floor("seconds_left")
    rows = (rows.withColumn("hours", F.floor(whole / 3600)).withColumn("minutes", F.floor(F.pmod(whole, F.lit(3600)) / 60)).withColumn("seconds", F.pmod(whole, F.lit(60)))
            .withColumn("ends", F.from_utc_timestamp((F.col(start).cast("double") + F.col("seconds_left")).cast("timestamp"), zone)))
    return rows.withColumn("cost", F.col("seconds_left") / 3600 * F.col(price)) if price else rows
