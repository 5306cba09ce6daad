"""Padding, masking and pooling of per-token vectors.

A sequence is one row: tokens array<int>, vecs array<array<double>> and mask array<boolean> of one
length. All pooling is native; `embed_sequences` runs a model over padded batches in Python workers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonaris.functions.vectors import LEAST_NORM, add, scale

PAD, MASK = 719, 718
#: Least divisor of the mean and of the weighted means, which differ.
MEAN_EPS, WEIGHT_EPS = 1e-9, 1e-6

Weights = list[tuple[int, int, float]]


def pad_and_mask(df: DataFrame, *, tokens: str = "tokens", pad_id: int = PAD, max_len: int | None = None, batch: list[str] | None = None, right: bool = False) -> DataFrame:
    """df with padded array<int> and mask array<boolean>, as long as the longest sequence of the batch
    (of the table without batch), max_len at most. right=True pads on the left."""
    size = F.size(F.coalesce(F.col(tokens), F.array().cast("array<int>")))
    longest = df.groupBy(*(batch or [])).agg(F.max(size).alias("__longest"))
    rows = df.join(longest, batch) if batch else df.crossJoin(F.broadcast(longest))  # one row
    target = F.least(F.col("__longest"), F.lit(max_len)) if max_len is not None else F.col("__longest")
    own = F.slice(F.coalesce(F.col(tokens), F.array().cast("array<int>")), F.lit(1), target)
    rest = target - F.size(own)
    parts = [own.cast("array<int>"), F.array_repeat(F.lit(pad_id), rest)]
    marks = [F.array_repeat(F.lit(True), F.size(own)), F.array_repeat(F.lit(False), rest)]
    if right:
        parts, marks = parts[::-1], marks[::-1]
    return rows.withColumn("padded", F.concat(*parts)).withColumn("mask", F.concat(*marks)).drop("__longest")


def gather_sequences(df: DataFrame, *, seq: str = "seq_id", pos: str = "pos", token: str = "token", vec: str = "vec", valid: str = "valid") -> DataFrame:
    """Long form (seq, pos, token, vec, valid) to one row a sequence: tokens, vecs, mask."""
    items = F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(token).alias("t"), F.col(vec).cast("array<double>").alias("v"), F.col(valid).alias("m"))))
    rows = df.groupBy(seq).agg(items.alias("items"))
    pick = lambda name: F.transform("items", lambda x: x[name])
    return rows.select(seq, pick("t").cast("array<int>").alias("tokens"), pick("v").alias("vecs"), pick("m").alias("mask"))


def normalize_weights(weights) -> Weights | None:
    """{(start, end): weight}, three weights of [0,128) [128,256) [256,384), or None."""
    if weights is None:
        return None
    if isinstance(weights, dict):
        return [(int(a), int(b), float(w)) for (a, b), w in weights.items()]
    if isinstance(weights, (tuple, list)) and len(weights) == 3 and not isinstance(weights[0], (tuple, list)):
        return [(128 * i, 128 * (i + 1), float(w)) for i, w in enumerate(weights)]
    raise TypeError("weights must be a dict of (start, end), three numbers or None")


def token_weight(token: Column, weights: Weights) -> Column:
    """1 outside all ranges; a later range overrides, unless its weight is exactly 1."""
    w = F.lit(1.0)
    for start, end, value in weights:
        if value != 1.0:
            w = F.when((token >= start) & (token < end), F.lit(value)).otherwise(w)
    return w


def _weighted(items: Column, width: Column, weight: Callable[[Column], Column], least: float) -> Column:
    """Sum of weighted vectors over the sum of weights. items: array<struct<t, v, m>>."""
    zero = F.struct(F.array_repeat(F.lit(0.0), width).alias("v"), F.lit(0.0).alias("w"))

    def step(acc: Column, x: Column) -> Column:
        w = F.when(x["m"], weight(x)).otherwise(F.lit(0.0))
        return F.struct(F.when(w != 0, add(acc["v"], scale(x["v"], w))).otherwise(acc["v"]).alias("v"), (acc["w"] + w).alias("w"))

    return F.aggregate(items, zero, step, lambda acc: scale(acc["v"], 1 / F.greatest(acc["w"], F.lit(least))))


def _items(tokens: str, vecs: str, mask: str) -> Column:
    v = F.col(vecs).cast("array<array<double>>")
    return F.transform(v, lambda x, i: F.struct(F.get(F.col(tokens), i).alias("t"), x.alias("v"), F.coalesce(F.get(F.col(mask), i), F.lit(False)).alias("m")))


def _width(vecs: str, dim: int | None) -> Column:
    return F.lit(dim) if dim is not None else F.coalesce(F.array_max(F.transform(F.col(vecs), lambda x: F.size(x))), F.lit(0))


def mean_pool(df: DataFrame, *, tokens: str = "tokens", vecs: str = "vecs", mask: str = "mask", out: str = "pooled", dim: int | None = None, eps: float = MEAN_EPS) -> DataFrame:
    """The mean of the vectors under the mask; zeros where there is none."""
    return df.withColumn(out, _weighted(_items(tokens, vecs, mask), _width(vecs, dim), lambda x: F.lit(1.0), eps))


def weighted_mean_pool(df: DataFrame, weights=None, *, tokens: str = "tokens", vecs: str = "vecs", mask: str = "mask", out: str = "pooled", dim: int | None = None) -> DataFrame:
    """The mean weighted by the range of each token; plain for weights None."""
    ranges = normalize_weights(weights)
    if ranges is None:
        return mean_pool(df, tokens=tokens, vecs=vecs, mask=mask, out=out, dim=dim)
    return df.withColumn(out, _weighted(_items(tokens, vecs, mask), _width(vecs, dim), lambda x: token_weight(x["t"], ranges), WEIGHT_EPS))


def aggregated_pool(df: DataFrame, weights, *, concat: bool = True, tokens: str = "tokens", vecs: str = "vecs", mask: str = "mask", out: str = "pooled", dim: int | None = None) -> DataFrame:
    """One mean for each range, in order of its start, times its weight; tokens of no range are left
    out. Side by side, or one array each with concat=False."""
    ranges = sorted(normalize_weights(weights) or [])
    if not ranges:
        raise ValueError("aggregated pooling needs ranges")
    items, width = _items(tokens, vecs, mask), _width(vecs, dim)
    means = []
    for start, end, value in ranges:
        own = F.filter(items, lambda x: (x["t"] >= start) & (x["t"] < end))  # noqa: B023
        means.append(scale(_weighted(own, width, lambda x: F.lit(1.0), WEIGHT_EPS), F.lit(value)))
    return df.withColumn(out, F.concat(*means) if concat else F.array(*means))


def pool(df: DataFrame, how: str = "mean", weights=None, *, vecs: str = "vecs", out: str = "pooled", **options) -> DataFrame:
    """mean, weighted_mean, weighted_mean_aggregated (or _stacked); rows that already hold one vector
    each (array of numbers) pass through."""
    if not df.schema[vecs].dataType.simpleString().startswith("array<array"):
        return df.withColumn(out, F.col(vecs).cast("array<double>"))
    if how == "mean":
        return mean_pool(df, vecs=vecs, out=out, **options)
    if how == "weighted_mean":
        return weighted_mean_pool(df, weights, vecs=vecs, out=out, **options)
    if how in ("weighted_mean_aggregated", "weighted_mean_aggregated_stacked"):
        return aggregated_pool(df, weights, concat=not how.endswith("stacked"), vecs=vecs, out=out, **options)
    raise ValueError(f"unknown pooling {how!r}")


def effective_token_ids(token_ids: list[int] | None, weights: dict[int, float] | None) -> list[int] | None:
    """The ids to pool: the ids, the weights' ids, or what both have (the ids, if that is nothing)."""
    if token_ids is None:
        return sorted(weights) if weights else None
    both = [t for t in token_ids if weights and t in weights]
    return both or list(token_ids)


def selected_mean_pool(df: DataFrame, token_ids: list[int] | None = None, weights: dict[int, float] | None = None, *, tokens: str = "tokens", vecs: str = "vecs", mask: str = "mask", out: str = "pooled", dim: int | None = None) -> DataFrame:
    """The (weighted) mean over the given tokens; over all under the mask where none occurs."""
    ids = effective_token_ids(token_ids, weights)
    if ids is None:
        return mean_pool(df, tokens=tokens, vecs=vecs, mask=mask, out=out, dim=dim)
    items, width = _items(tokens, vecs, mask), _width(vecs, dim)
    own = F.filter(items, lambda x: x["m"] & x["t"].isin(*ids))
    table = F.create_map(*[F.lit(v) for pair in (weights or {}).items() for v in pair]) if weights else None
    weight = (lambda x: F.coalesce(F.element_at(table, x["t"]), F.lit(1.0))) if weights else (lambda x: F.lit(1.0))
    return df.withColumn(out, F.when(F.size(own) > 0, _weighted(own, width, weight, MEAN_EPS)).otherwise(_weighted(items, width, lambda x: F.lit(1.0), MEAN_EPS)))


def concat_pool(df: DataFrame, token_ids: list[int], max_tokens: int, weights: dict[int, float] | None = None, *, dim: int, tokens: str = "tokens", vecs: str = "vecs", mask: str = "mask", out: str = "pooled") -> DataFrame:
    """The vectors of the first max_tokens given tokens side by side, by falling weight (ties by place)
    if weights are given and there are more; zeros fill up."""
    found = F.filter(_items(tokens, vecs, mask), lambda x: x["m"] & x["t"].isin(*token_ids))
    table = F.create_map(*[F.lit(v) for pair in (weights or {}).items() for v in pair]) if weights else None
    rank = (lambda x: -F.coalesce(F.element_at(table, x["t"]), F.lit(1.0))) if weights else (lambda x: F.lit(0.0))
    ordered = F.array_sort(F.transform(found, lambda x, i: F.struct(rank(x).alias("r"), i.alias("i"), x["v"].alias("v"))))
    placed = F.when(F.size(found) > max_tokens, F.transform(ordered, lambda x: x["v"])).otherwise(F.transform(found, lambda x: x["v"]))
    flat = F.flatten(F.slice(placed, 1, max_tokens))
    return df.withColumn(out, F.concat(flat, F.array_repeat(F.lit(0.0), F.lit(max_tokens * dim) - F.size(flat))))


def most_matching_tokens(df: DataFrame, token_ids: list[int], max_len: int, *, tokens: str = "tokens") -> DataFrame:
    """One row, n: the largest number of the given tokens within max_len of any sequence."""
    return df.agg(F.coalesce(F.max(F.size(F.filter(F.slice(tokens, 1, max_len), lambda t: t.isin(*token_ids)))), F.lit(0)).alias("n"))


class HashEmbedder:
    """A deterministic stand-in for a model: each token's vector comes from its id, plus its place."""

    def __init__(self, dim: int = 16, seed: int = 0) -> None:
        self.dim, self.seed = dim, seed

    def __call__(self, tokens: np.ndarray, mask: np.ndarray) -> np.ndarray:
        steps = np.arange(1, self.dim + 1)
        place = np.arange(tokens.shape[1])[None, :, None]
        return np.sin((tokens[..., None] + 1 + self.seed) * steps * 0.37) + 0.1 * np.cos(place * steps * 0.11)


def numpy_pool(vecs: np.ndarray, mask: np.ndarray, tokens: np.ndarray, how: str, weights) -> np.ndarray:
    """The same pooling over a padded batch (rows, length, width)."""
    m = mask.astype(np.float64)
    ranges = normalize_weights(weights)
    if how == "mean" or (how == "weighted_mean" and ranges is None):
        return (vecs * m[..., None]).sum(1) / np.maximum(m.sum(1), MEAN_EPS)[:, None]
    if how == "weighted_mean":
        w = np.ones(tokens.shape)
        for start, end, value in ranges:
            if value != 1.0:
                w[(tokens >= start) & (tokens < end)] = value
        w = w * m
        return (vecs * w[..., None]).sum(1) / np.maximum(w.sum(1), WEIGHT_EPS)[:, None]
    if how == "weighted_mean_aggregated":
        parts = []
        for start, end, value in sorted(ranges):
            own = m * ((tokens >= start) & (tokens < end))
            parts.append(value * (vecs * own[..., None]).sum(1) / np.maximum(own.sum(1), WEIGHT_EPS)[:, None])
        return np.concatenate(parts, 1)
    raise ValueError(f"unknown pooling {how!r}")


def embed_sequences(df: DataFrame, factory: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]], *, key: str = "seq_id", tokens: str = "tokens", how: str = "mean", weights=None,
                    max_len: int = 3072, pad_id: int = PAD, batch_size: int = 64, l2: bool = False, partitions: int | None = None, layer: int | None = None) -> DataFrame:
    """(key, embedding array<float>): factory makes, once a worker, a model of (tokens, mask) to
    (rows, length, width) vectors, or (rows, width) if it pools itself. With layer the model is also given layer=
    and answers with that layer's hidden states; if it has none there (None), its token_embeddings(tokens) are pooled. Sequences of like lengths share
    a batch, so little is padded; with partitions they are also dealt by length."""
    rows = df.select(F.col(key).alias("key"), F.slice(F.col(tokens).cast("array<int>"), 1, max_len).alias("tokens"), F.least(F.size(tokens), F.lit(max_len)).alias("n"))
    rows = (rows.repartitionByRange(partitions, "n", "key") if partitions else rows).sortWithinPartitions("n", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for whole in batches:
            for at in range(0, whole.num_rows, batch_size):
                b = whole.slice(at, batch_size)
                lists = [x or [] for x in b.column("tokens").to_pylist()]
                width = max(map(len, lists))
                ids = np.full((len(lists), width), pad_id, np.int64)
                for i, x in enumerate(lists):
                    ids[i, : len(x)] = x
                mask = np.arange(width)[None, :] < np.array([len(x) for x in lists])[:, None]
                states = model(ids, mask) if layer is None else model(ids, mask, layer=layer)
                vecs = np.asarray(model.token_embeddings(ids) if states is None else states, np.float64)
                pooled = vecs if vecs.ndim == 2 else numpy_pool(vecs, mask, ids, how, weights)
                if l2:
                    pooled = pooled / np.maximum(np.linalg.norm(pooled, axis=1, keepdims=True), LEAST_NORM)
                yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(list(pooled.astype(np.float32)), pa.list_(pa.float32()))], ["key", "embedding"])

    kind = df.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, embedding array<float>").withColumnRenamed("key", key)
