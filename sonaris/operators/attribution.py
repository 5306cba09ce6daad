"""Which tokens matter: attention, occlusion, prediction and pair scores, and their fusion.

Model outputs come as tables; scores are (seq_id, pos, signal, score) with valid telling pads apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonaris.functions.logits import log_softmax
from sonaris.operators.search import topk_valid

#: Default weights of the fused signals, and of the pair scores added to them (fixed values).
WEIGHTS = {"integrated": 1.0, "occlusion": 1.0, "prediction": 0.7, "attention": 0.3}
SYNERGY = 0.2


def attention_received(att: DataFrame, *, seq: str = "seq_id") -> DataFrame:
    """(seq, pos, score) of attention rows (seq, layer, head, i, j, w): what each token receives, summed over heads
    and queries, averaged over layers."""
    layers = att.groupBy(seq).agg(F.countDistinct("layer").alias("__layers"))
    sums = att.groupBy(seq, F.col("j").alias("pos")).agg(F.sum("w").alias("s"))
    return sums.join(layers, seq).select(seq, "pos", (F.col("s") / F.col("__layers")).alias("score"))


def attention_rollout(att: DataFrame, layers: int, *, seq: str = "seq_id") -> DataFrame:
    """(seq, pos, score): column sums of the product over layers of 0.5 * mean attention + 0.5 * identity."""
    mean = att.groupBy(seq, "layer", "i", "j").agg(F.avg("w").alias("w"))
    size = att.select(seq, F.col("i").alias("n")).union(att.select(seq, "j")).distinct()
    product = size.select(seq, F.col("n").alias("i"), F.col("n").alias("j"), F.lit(1.0).alias("w"))
    for layer in range(layers):
        own = mean.where(F.col("layer") == layer).select(seq, F.col("i").alias("r"), F.col("j").alias("m"), (F.col("w") * 0.5).alias("a"))
        own = own.unionByName(size.select(seq, F.col("n").alias("r"), F.col("n").alias("m"), F.lit(0.5).alias("a")))
        product = own.join(product.withColumnRenamed("i", "m"), [seq, "m"]).groupBy(seq, F.col("r").alias("i"), "j").agg(F.sum(F.col("a") * F.col("w")).alias("w"))
    return product.groupBy(seq, F.col("j").alias("pos")).agg(F.sum("w").alias("score"))


def occluded_variants(df: DataFrame, *, seq: str = "seq_id", tokens: str = "tokens", mask_id: int = 718, pairs: bool = False) -> DataFrame:
    """(seq, a[, b], tokens): each sequence once for every position (or pair a < b) replaced by the mask."""
    rows = df.select(seq, F.col(tokens).alias("tokens"), F.posexplode(tokens).alias("a", "__t")).drop("__t")
    if not pairs:
        return rows.withColumn("tokens", F.transform("tokens", lambda t, i: F.when(i == F.col("a"), F.lit(mask_id)).otherwise(t)))
    rows = rows.where(F.col("a") + 1 < F.size("tokens")).withColumn("b", F.explode(F.sequence(F.col("a") + 1, F.size("tokens") - 1)))
    return rows.withColumn("tokens", F.transform("tokens", lambda t, i: F.when((i == F.col("a")) | (i == F.col("b")), F.lit(mask_id)).otherwise(t)))


def occlusion_scores(base: DataFrame, occluded: DataFrame, *, seq: str = "seq_id", by: list[str] | None = None) -> DataFrame:
    """(seq, by..., score): mean squared difference of pooled vectors (column embedding) with and without positions."""
    by = by or ["a"]
    both = occluded.join(base.select(seq, F.col("embedding").alias("__base")), seq)
    diff = F.aggregate(F.zip_with(F.col("embedding").cast("array<double>"), F.col("__base").cast("array<double>"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return both.select(seq, *by, (diff / F.size("embedding")).alias("score"))


def prediction_scores(df: DataFrame, *, seq: str = "seq_id", pos: str = "a", token: str = "token", logits: str = "logits") -> DataFrame:
    """(seq, pos, score): cross entropy of the true token at its own masked position."""
    return df.select(seq, F.col(pos).alias("pos"), (-F.get(log_softmax(logits), F.col(token))).alias("score"))


def pair_synergy(single: DataFrame, pairs: DataFrame, *, seq: str = "seq_id") -> DataFrame:
    """(seq, pos, score): the mean over a token's pairs of max(0, pair - a - b). single (seq, a, score), pairs
    (seq, a, b, score)."""
    one = lambda name: single.select(seq, F.col("a").alias(name), F.col("score").alias(f"s_{name}"))
    rows = pairs.join(one("a"), [seq, "a"]).join(one("b"), [seq, "b"]).withColumn("extra", F.greatest(F.lit(0.0), F.col("score") - F.col("s_a") - F.col("s_b")))
    ends = rows.select(seq, F.explode(F.array("a", "b")).alias("pos"), "extra")
    return ends.groupBy(seq, "pos").agg(F.avg("extra").alias("score"))


def minmax(df: DataFrame, *, group: list[str], score: str = "score", valid: str | None = None, out: str = "scaled") -> DataFrame:
    """Scores of each group on 0..1, over valid positions only; others get 0. Equal scores give 0."""
    x = F.when(F.col(valid), F.col(score)) if valid else F.col(score)
    w = Window.partitionBy(*group)
    low, high = F.min(x).over(w), F.max(x).over(w)
    return df.withColumn(out, F.coalesce((x - low) / F.greatest(high - low, F.lit(1e-8)), F.lit(0.0)))


def borda(df: DataFrame, *, group: list[str], pos: str = "pos", score: str = "score", valid: str | None = None, out: str = "points") -> DataFrame:
    """Points by rank: the worst valid position gets 0, the best one less than their number; pads get 0."""
    ok = F.col(valid) if valid else F.lit(True)
    w = Window.partitionBy(*group, ok).orderBy(F.col(score), F.desc(pos))
    return df.withColumn(out, F.when(ok, F.row_number().over(w) - 1).otherwise(0))


def fuse(scores: DataFrame, *, seq: str = "seq_id", weights: dict[str, float] | None = None, how: str = "both", synergy: DataFrame | None = None) -> DataFrame:
    """(seq, pos, fused) of (seq, pos, signal, score[, valid]): the weighted mean of Borda points over their largest
    (rank), of scaled scores (score), or half of each (both); plus 0.2 of the scaled pair scores if given."""
    if how not in ("rank", "score", "both"):
        raise ValueError(f"unknown fusion {how!r}")
    weights = weights or WEIGHTS
    rows = scores if "valid" in scores.columns else scores.withColumn("valid", F.lit(True))
    group = [seq, "signal"]
    rows = borda(minmax(rows, group=group, valid="valid"), group=group, valid="valid")
    most = F.greatest(F.max("points").over(Window.partitionBy(*group)), F.lit(1))
    rows = rows.withColumn("ranked", F.col("points") / most)
    share = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for pair in weights.items() for v in pair]), F.col("signal")), F.lit(0.0))
    value = {"rank": F.col("ranked"), "score": F.col("scaled"), "both": (F.col("ranked") + F.col("scaled")) / 2}[how]
    out = rows.where("valid").withColumn("__w", share).groupBy(seq, "pos").agg((F.sum(value * F.col("__w")) / F.sum("__w")).alias("fused"))
    if synergy is None:
        return out
    extra = minmax(synergy, group=[seq]).select(seq, "pos", F.col("scaled").alias("__s"))
    return out.join(extra, [seq, "pos"], "left").select(seq, "pos", (F.col("fused") + SYNERGY * F.coalesce("__s", F.lit(0.0))).alias("fused"))


#: Attribution methods that tables can express; those that need gradients come from a model.
METHODS: dict[str, Callable[..., DataFrame]] = {"attention": attention_received, "rollout": attention_rollout, "occlusion": occlusion_scores, "prediction": prediction_scores, "fused": fuse}


def principal_tokens(method: str, *args, top: int = 10, seq: str = "seq_id", **options) -> DataFrame:
    """The top positions of each sequence by a method of METHODS."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; one of {sorted(METHODS)}")
    scores = METHODS[method](*args, seq=seq, **options)
    score = "fused" if method == "fused" else "score"
    position = "pos" if "pos" in scores.columns else "a"
    return topk_valid(scores.withColumn("__ok", F.lit(True)), top, group=seq, position=position, score=score, valid="__ok")
