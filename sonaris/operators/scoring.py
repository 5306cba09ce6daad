"""Scores of sequences under a model's logits, masked prediction and generation metrics.

Logits come in long form (seq_id, pos, token, logits array<double>): the distribution that a model gives
after reading up to pos.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonaris.functions.logits import argmax, display_probability, entropy, softmax
from sonaris.functions.vectors import cosine
from sonaris.operators.pooling import embed_sequences
from sonaris.operators.tokens import MASK, char_tokens, uniform

LEAST_PROB = 1e-45


def position_scores(df: DataFrame, *, seq: str = "seq_id", pos: str = "pos", token: str = "token", logits: str = "logits", pad_id: int | None = None, eos_id: int | None = None) -> DataFrame:
    """(seq, pos, target, prob, log_prob, top_token, top_prob, hit): how likely each next token was. Pads and
    everything after the first end token are left out; sequences of one token have no row."""
    order = Window.partitionBy(seq).orderBy(pos)
    rows = df.withColumn("target", F.lead(token).over(order))
    if eos_id is not None:
        ended = F.max((F.col(token) == eos_id).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("__ended", F.coalesce(ended, F.lit(0))).where("__ended = 0")
    rows = rows.where(F.col("target").isNotNull())
    if pad_id is not None:
        rows = rows.where(F.col("target") != pad_id)
    rows = rows.withColumn("__p", softmax(logits)).withColumn("prob", F.greatest(F.get("__p", F.col("target")), F.lit(LEAST_PROB)))
    rows = rows.withColumn("top_token", argmax(F.col("__p"))).withColumn("top_prob", F.array_max("__p"))
    return rows.select(seq, pos, "target", "prob", F.log("prob").alias("log_prob"), "top_token", "top_prob", (F.col("top_token") == F.col("target")).alias("hit"))


def sequence_metrics(scored: DataFrame, *, seq: str = "seq_id") -> DataFrame:
    """(seq, n, total_log_prob, avg_log_prob, avg_log_prob_bits, avg_log10_prob, geometric_mean_prob, perplexity,
    total_prob text, accuracy)."""
    rows = scored.groupBy(seq).agg(F.count(F.lit(1)).alias("n"), F.sum("log_prob").alias("total_log_prob"), F.avg(F.col("hit").cast("double")).alias("accuracy"))
    mean = F.col("total_log_prob") / F.col("n")
    return rows.select(seq, "n", "total_log_prob", mean.alias("avg_log_prob"), (mean / F.log(F.lit(2.0))).alias("avg_log_prob_bits"), (mean / F.log(F.lit(10.0))).alias("avg_log10_prob"),
                       F.exp(mean).alias("geometric_mean_prob"), F.exp(-mean).alias("perplexity"), display_probability(F.exp("total_log_prob"), F.col("total_log_prob")).alias("total_prob"), "accuracy")


def accuracy(df: DataFrame, *, logits: str = "logits", label: str = "label", ignore: int = -100) -> DataFrame:
    """One row, accuracy: how often the largest logit is the label's."""
    return df.where(F.col(label) != ignore).agg(F.avg((argmax(logits) == F.col(label)).cast("double")).alias("accuracy"))


def binary_predictions(df: DataFrame, *, logit: str = "logit", threshold: float = 0.5) -> DataFrame:
    """df with prob and pred (prob >= threshold)."""
    return df.withColumn("prob", 1 / (1 + F.exp(-F.col(logit)))).withColumn("pred", (F.col("prob") >= threshold).cast("int"))


def classify_sequences(df: DataFrame, factory: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]], *, key: str = "seq_id", tokens: str = "tokens", threshold: float = 0.5,
                       max_len: int = 1024, pad_id: int = 18818, batch_size: int = 8) -> DataFrame:
    """(key, logit, prob, pred): factory makes a model of (tokens, mask) to one logit a sequence. Tokens beyond max_len
    aren't shown to it; an empty sequence is shown as pads."""

    def one_column() -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        model = factory()
        return lambda ids, mask: np.asarray(model(ids, mask), np.float64).reshape(len(ids), 1)

    rows = embed_sequences(df, one_column, key=key, tokens=tokens, max_len=max_len, pad_id=pad_id, batch_size=batch_size)
    return binary_predictions(rows.select(key, F.get("embedding", 0).cast("double").alias("logit")), threshold=threshold)


def generation_metrics(df: DataFrame, *, seq: str = "batch", step: str = "step", token: str = "token", logits: str = "logits", hidden: str | None = None, top: int = 2) -> DataFrame:
    """(seq, step, metric, value) of the raw distributions: entropy, next_token_prob, top_k_gap (largest less the
    top-th) and, with hidden vectors, hidden_cos_sim to the step before (null at first)."""
    rows = df.withColumn("__p", softmax(logits))
    ordered = F.sort_array("__p", asc=False)
    values = [("entropy", entropy(F.col("__p"), is_prob=True)), ("next_token_prob", F.get("__p", F.col(token))), ("top_k_gap", F.get(ordered, 0) - F.get(ordered, top - 1))]
    if hidden:
        before = F.lag(hidden).over(Window.partitionBy(seq).orderBy(step))
        rows = rows.withColumn("__before", before)
        values.append(("hidden_cos_sim", F.when(F.col("__before").isNotNull(), cosine(hidden, "__before"))))
    rows = rows.select(seq, step, *[v.alias(n) for n, v in values])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n, _ in values]))
    return rows.select(seq, step, pairs.alias("x")).select(seq, step, "x.metric", "x.value")


def _number(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def analyze_metrics(df: DataFrame, *, seq: str = "batch", step: str = "step", outlier_std: float = 2.0, limits: dict[str, tuple[float | None, float | None]] | None = None) -> DataFrame:
    """df (seq, step, metric, value) with each metric's mean and sample deviation (NaN and null left out), z and
    anomaly: below or above for a value beyond its metric's limits, else outlier for |z| > outlier_std."""
    v = _number(F.col("value"))
    stats = df.groupBy("metric").agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"))
    rows = df.join(F.broadcast(stats), "metric")  # one row for each metric's name
    low = high = F.lit(None).cast("double")
    for name, (lo, hi) in (limits or {}).items():
        low = F.when(F.col("metric") == name, F.lit(lo).cast("double")).otherwise(low)
        high = F.when(F.col("metric") == name, F.lit(hi).cast("double")).otherwise(high)
    z = F.when(F.col("std") > 0, (v - F.col("mean")) / F.col("std"))
    kind = F.when(v < low, "below").when(v > high, "above").when(F.abs(F.col("z")) > outlier_std, "outlier")
    return rows.withColumn("z", z).withColumn("anomaly", kind).select(seq, step, "metric", "value", "mean", "std", "z", "anomaly")


def metric_summary(df: DataFrame, *, step: str = "step") -> DataFrame:
    """(metric, mean, min, max, std, first_half, second_half, drift_percent): halves by the steps' means."""
    v = _number(F.col("value"))
    basic = df.groupBy("metric").agg(F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_samp(v).alias("std"))
    steps = df.groupBy("metric", step).agg(F.avg(v).alias("m"))
    steps = steps.withColumn("half", F.floor((F.row_number().over(Window.partitionBy("metric").orderBy(step)) - 1) * 2 / F.count(F.lit(1)).over(Window.partitionBy("metric"))))
    halves = steps.groupBy("metric").agg(F.avg(F.when(F.col("half") == 0, F.col("m"))).alias("first_half"), F.avg(F.when(F.col("half") == 1, F.col("m"))).alias("second_half"))
    drift = F.when(F.abs("first_half") > 0, (F.col("second_half") - F.col("first_half")) / F.abs("first_half") * 100)
    return basic.join(halves, "metric").withColumn("drift_percent", drift)


def grouped_issues(analyzed: DataFrame, *, seq: str = "batch", step: str = "step", density: float = 0.15) -> DataFrame:
    """(seq, n_steps, n_flagged, density, dense, issues array<struct<step, metrics>>) of analyzed metrics."""
    flagged = analyzed.where("anomaly IS NOT NULL").groupBy(seq, step).agg(F.sort_array(F.collect_list(F.concat_ws(":", "metric", "anomaly"))).alias("metrics"))
    issues = flagged.groupBy(seq).agg(F.count(F.lit(1)).alias("n_flagged"), F.sort_array(F.collect_list(F.struct(step, "metrics"))).alias("issues"))
    rows = analyzed.groupBy(seq).agg(F.countDistinct(step).alias("n_steps")).join(issues, seq, "left")
    rows = rows.withColumn("n_flagged", F.coalesce("n_flagged", F.lit(0))).withColumn("density", F.col("n_flagged") / F.col("n_steps"))
    return rows.withColumn("dense", F.col("density") > density)


def mask_after_end(df: DataFrame, eos_id: int, pad_id: int, *, tokens: str = "tokens") -> DataFrame:
    """Tokens after the first end token become pads."""
    at = F.array_position(F.col(tokens), F.lit(eos_id))
    return df.withColumn(tokens, F.when(at > 0, F.transform(tokens, lambda t, i: F.when(i >= at, F.lit(pad_id)).otherwise(t))).otherwise(F.col(tokens)))


def corrupt(df: DataFrame, *, key: str = "seq_id", tokens: str = "tokens", prob: float = 0.15, mask_id: int = MASK, vocab: int = 718, seed: int = 0) -> DataFrame:
    """df with corrupted and chosen array<boolean>: of the chosen tokens 80 % become the mask, 10 % a random token,
    10 % stay."""
    u = lambda kind, i: uniform(F.lit(seed), F.col(key), F.lit(kind), i)
    chosen = F.transform(tokens, lambda t, i: u("choose", i) < prob)
    rows = df.withColumn("chosen", chosen)
    new = lambda t, i: F.when(u("how", i) < 0.8, F.lit(mask_id)).when(u("how", i) < 0.9, F.floor(u("token", i) * vocab).cast("int")).otherwise(t)
    return rows.withColumn("corrupted", F.transform(tokens, lambda t, i: F.when(F.get("chosen", i), new(t, i)).otherwise(t)))


def predict_masked(df: DataFrame, factory: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]], *, key: str = "seq_id", tokens: str = "corrupted", original: str = "tokens", chosen: str = "chosen",
                   iterations: int = 5, top: int = 5, pad_id: int = 719, temperature: float = 1.0, batch_size: int = 32) -> DataFrame:
    """(key, position, original_id, predicted_id, log_likelihood, prob, entropy, margin, top array<struct<id, prob>>) of
    every chosen position. factory makes a model of (tokens, mask) to logits (rows, length, vocabulary). Each pass commits
    the most confident max(1, remaining // passes left) positions of a sequence and shows them to the next."""
    fields = "position int, original_id int, predicted_id int, log_likelihood double, prob double, entropy double, margin double, top array<struct<id:int,prob:double>>"
    names = [f.split(" ")[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        kind = None
        for whole in batches:
            kind = whole.schema.field("key").type
            for at in range(0, whole.num_rows, batch_size):
                b = whole.slice(at, batch_size).to_pylist()
                width = max((len(r["t"] or []) for r in b), default=0)
                ids = np.full((len(b), width), pad_id, np.int64)
                todo = np.zeros((len(b), width), bool)
                for i, r in enumerate(b):
                    ids[i, : len(r["t"] or [])] = r["t"] or []
                    todo[i, : len(r["c"] or [])] = r["c"] or []
                mask = ids != pad_id
                todo &= mask
                rows = []
                for step in range(iterations):
                    if not todo.any():
                        break
                    x = np.asarray(model(ids, mask), np.float64) / temperature
                    x = x - x.max(-1, keepdims=True)
                    p = np.exp(x)
                    p /= p.sum(-1, keepdims=True)
                    best = p.max(-1)
                    for i in range(len(b)):
                        left = np.flatnonzero(todo[i])
                        if not len(left):
                            continue
                        n = len(left) if step == iterations - 1 else max(1, len(left) // (iterations - step))
                        for j in left[np.lexsort((left, -best[i, left]))[:n]]:
                            order = np.argsort(-p[i, j], kind="stable")[: max(top, 2)]
                            true = b[i]["o"][j]
                            rows.append((b[i]["key"], int(j), int(true), int(order[0]), float(np.log(max(p[i, j, true], LEAST_PROB))) if true < p.shape[-1] else None, float(p[i, j, order[0]]),
                                         float(-(p[i, j] * np.log(np.maximum(p[i, j], 1e-300))).sum()), float(p[i, j, order[0]] - p[i, j, order[1]]) if len(order) > 1 else 1.0,
                                         [{"id": int(t), "prob": float(p[i, j, t])} for t in order[:top]]))
                            ids[i, j], todo[i, j] = order[0], False
                types = [kind, pa.int32(), pa.int32(), pa.int32(), *[pa.float64()] * 4, pa.list_(pa.struct([("id", pa.int32()), ("prob", pa.float64())]))]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["key", *names])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(tokens).alias("t"), F.col(original).alias("o"), F.col(chosen).alias("c"))
    return rows.mapInArrow(run, f"key {kind}, {fields}").withColumnRenamed("key", key)


#: Ids beyond the characters, in the vocabulary of character models.
CHAR_MASK, CHAR_PAD, CHAR_VOCAB = 128, 129, 130


def predict_masked_text(df: DataFrame, factory: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]], *, key: str = "doc_id", text: str = "text", prob: float | None = None, positions: list[int] | None = None,
                        top: int = 5, max_len: int = 2048, seed: int = 0, batch_size: int = 32) -> DataFrame:
    """(key, original_text, masked_text, predictions array<struct<position, original_char, predicted_char,
    topk array<struct<char, prob>>>>) of the first max_len ASCII characters, in one pass. Either the given positions
    become the mask, or each is chosen with probability prob and corrupted as corrupt() does. A text without a masked
    character has no predictions."""
    if (prob is None) == (positions is None):
        raise ValueError("give either prob or positions")
    rows = char_tokens(df.select(key, text), text=text, max_len=max_len)
    if positions is not None:
        rows = rows.withColumn("chosen", F.transform("tokens", lambda t, i: i.isin(*positions)))
        rows = rows.withColumn("corrupted", F.transform("tokens", lambda t, i: F.when(F.get("chosen", i), F.lit(CHAR_MASK)).otherwise(t)))
    else:
        rows = corrupt(rows, key=key, prob=prob, mask_id=CHAR_MASK, vocab=CHAR_VOCAB - 1, seed=seed)
    found = predict_masked(rows, factory, key=key, iterations=1, top=top, pad_id=CHAR_PAD, batch_size=batch_size)
    shown = F.struct("position", _char("original_id").alias("original_char"), _char("predicted_id").alias("predicted_char"), F.transform("top", lambda x: F.struct(_char(x["id"]).alias("char"), x["prob"].alias("prob"))).alias("topk"))
    found = found.groupBy(F.col(key).alias("__key")).agg(F.sort_array(F.collect_list(shown)).alias("predictions"))  # max_len bounds a group
    spell = lambda ids: F.array_join(F.transform(ids, _char), "")
    rows = rows.select(key, spell("tokens").alias("original_text"), spell("corrupted").alias("masked_text"))
    return rows.join(found, F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key").withColumn("predictions", F.coalesce("predictions", F.array().cast(found.schema["predictions"].dataType)))


def _char(token: Column | str) -> Column:
    t = F.col(token) if isinstance(token, str) else token
    return F.when(t < CHAR_MASK, F.char(t)).when(t == CHAR_MASK, F.lit("[M]")).when(t == CHAR_PAD, F.lit("[P]")).otherwise(F.concat(F.lit("["), t.cast("string"), F.lit("]")))


def prediction_report(df: DataFrame, predictions: DataFrame, *, key: str = "seq_id", original: str = "tokens", corrupted: str = "corrupted") -> DataFrame:
    """(key, original, masked, predicted, reconstructed) as texts of ids; only masked places are shown as predicted."""
    found = predictions.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("position", "predicted_id"))).alias("p"))
    rows = df.join(found, key, "left").withColumn("p", F.coalesce("p", F.create_map().cast("map<int,int>")))
    text = lambda x: F.concat_ws(" ", F.transform(x, lambda t: t.cast("string")))
    filled = F.transform(corrupted, lambda t, i: F.coalesce(F.element_at("p", i), t))
    shown = F.transform(corrupted, lambda t, i: F.coalesce(F.element_at("p", i).cast("string"), F.lit("_")))
    return rows.select(key, text(F.col(original)).alias("original"), text(F.col(corrupted)).alias("masked"), F.concat_ws(" ", shown).alias("predicted"), text(filled).alias("reconstructed"))


def decode_tokens_text(df: DataFrame, vocabulary: DataFrame, *, token: str = "token") -> DataFrame:
    """df with the text of each token from a dimension table (token, text); unknown ones as their number."""
    return df.join(vocabulary.select(F.col("token").alias(token), F.col("text").alias("token_text")), token, "left").withColumn("token_text", F.coalesce("token_text", F.col(token).cast("string")))
