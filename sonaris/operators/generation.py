"""Autoregressive generation and infilling with a model hook, in Arrow batches.

A factory makes, once a worker, a model of (tokens, mask) to logits (rows, length, vocabulary): the logits at a
place are those of the token after it. Every sequence draws from a generator of its own, seeded by seed and key,
so results depend neither on batches nor on partitions, and a lost task gives the same rows again.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonaris.operators.pooling import PAD

Model = Callable[[np.ndarray, np.ndarray], np.ndarray]


def adjusted(logits: np.ndarray, recent: np.ndarray, *, temperature: float = 1.0, bias: dict[int, float] | None = None, forbidden: list[int] | None = None, penalty: float = 1.0,
             min_p: float = 0.0, top_k: int | None = None) -> np.ndarray:
    """One row of logits under a repetition penalty on the recent tokens, additive biases, forbidden ids (-inf), the
    temperature (0: left as it is) and the filters min_p (share of the best probability) and top_k."""
    x = np.array(logits, np.float64)
    if penalty != 1.0 and len(recent):
        seen = np.unique(recent[(recent >= 0) & (recent < len(x))])
        x[seen] = np.where(x[seen] > 0, x[seen] / penalty, x[seen] * penalty)
    for token, value in (bias or {}).items():
        x[token] += value
    x[list(forbidden or [])] = -np.inf
    if temperature > 0:
        x = x / temperature
    if top_k is not None and top_k < len(x):
        x[np.argsort(-x, kind="stable")[max(top_k, 1):]] = -np.inf
    if min_p > 0 and np.isfinite(x.max()):
        x[x < x.max() + np.log(min_p)] = -np.inf
    return x


def _draw(x: np.ndarray, temperature: float, rng: np.random.Generator) -> tuple[int, float]:
    """A token and its log probability; the best one (the first of equals) at temperature 0."""
    if not np.isfinite(x.max()):
        raise ValueError("every token is forbidden")
    log_p = x - x.max()
    log_p -= np.log(np.exp(log_p).sum())
    token = int(np.argmax(x if temperature <= 0 else log_p + rng.gumbel(size=len(x))))
    return token, float(log_p[token])


def generate(df: DataFrame, factory: Callable[[], Model], *, key: str = "seq_id", prompt: str = "tokens", steps: int = 32, infill: int | None = None, eos_id: int | None = None, pad_id: int = PAD,
             temperature: float = 1.0, window: int = 256, seed: int = 0, batch_size: int = 32, **options) -> DataFrame:
    """(key, tokens array<int>, log_probs array<double>): prompts continued by up to steps tokens, which end with the
    first eos_id. With infill (an id), instead each place of the prompt that holds it is drawn from what stands before
    it, other places stay, and nothing is appended; a hole in the first place is shown to the model as a pad.
    log_probs belong to the drawn tokens, in order. A null or empty prompt without infill starts from one pad, which
    isn't returned. options: those of adjusted(); the penalty looks at the last window tokens."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for whole in batches:
            for at in range(0, whole.num_rows, batch_size):
                b = whole.slice(at, batch_size)
                rngs = [np.random.default_rng([seed, zlib.crc32(str(k).encode())]) for k in b.column("key").to_pylist()]
                given = [list(x or []) for x in b.column("tokens").to_pylist()]
                fill = _fill if infill is not None else _continue
                tokens, probs = fill(model, given, rngs, steps if infill is None else infill, eos_id, pad_id, temperature, window, options)
                yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(tokens, pa.list_(pa.int32())), pa.array(probs, pa.list_(pa.float64()))], ["key", "tokens", "log_probs"])

    rows = df.select(F.col(key).alias("key"), F.col(prompt).cast("array<int>").alias("tokens"))
    return rows.mapInArrow(run, f"key {kind}, tokens array<int>, log_probs array<double>").withColumnRenamed("key", key)


def _padded(lists: list[list[int]], pad_id: int) -> tuple[np.ndarray, np.ndarray]:
    width = max(map(len, lists))
    ids = np.full((len(lists), width), pad_id, np.int64)
    mask = np.zeros(ids.shape, bool)
    for i, x in enumerate(lists):
        ids[i, : len(x)], mask[i, : len(x)] = x, True
    return ids, mask


def _continue(model: Model, given, rngs, steps, eos_id, pad_id, temperature, window, options):
    shown = [x or [pad_id] for x in given]
    starts = [len(x) for x in shown]
    probs: list[list[float]] = [[] for _ in shown]
    live = list(range(len(shown)))
    for _ in range(steps):
        if not live:
            break
        logits = np.asarray(model(*_padded([shown[i] for i in live], pad_id)))
        going = []
        for row, i in enumerate(live):
            x = adjusted(logits[row, len(shown[i]) - 1], np.array(shown[i][-window:]), temperature=temperature, **options)
            token, p = _draw(x, temperature, rngs[i])
            shown[i] = [*shown[i], token]
            probs[i].append(p)
            if token != eos_id:
                going.append(i)
        live = going
    return [x if g else x[s:] for x, g, s in zip(shown, given, starts)], probs


def _fill(model: Model, given, rngs, hole, eos_id, pad_id, temperature, window, options):
    shown = [list(x) for x in given]
    holes = [[j for j, t in enumerate(x) if t == hole] for x in given]
    probs: list[list[float]] = [[] for _ in shown]
    for turn in range(max(map(len, holes), default=0)):
        live = [i for i, own in enumerate(holes) if turn < len(own)]
        places = [holes[i][turn] for i in live]
        before = [shown[i][:j] or [pad_id] for i, j in zip(live, places)]
        logits = np.asarray(model(*_padded(before, pad_id)))
        for row, (i, j) in enumerate(zip(live, places)):
            x = adjusted(logits[row, len(before[row]) - 1], np.array(before[row][-window:]), temperature=temperature, **options)
            shown[i][j], p = _draw(x, temperature, rngs[i])
            probs[i].append(p)
    return shown, probs
