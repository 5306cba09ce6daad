"""Column builders over arrays of logits or probabilities (array<double>)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sonaris.functions.vectors import doubles, let

NEVER = float("-inf")


def softmax(logits: Column | str) -> Column:
    """Stable softmax; entries of -inf get probability 0."""
    x = doubles(logits)
    exps = let(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top)))
    return let(exps, lambda e: let(F.aggregate(e, F.lit(0.0), lambda s, v: s + v), lambda total: F.transform(e, lambda v: v / total)))


def log_softmax(logits: Column | str) -> Column:
    x = doubles(logits)
    total = let(F.array_max(x), lambda top: top + F.log(F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp(v - top))))
    return let(total, lambda t: F.transform(x, lambda v: v - t))


def entropy(values: Column | str, is_prob: bool = False, eps: float = 1e-20) -> Column:
    """-sum p log p, in nats; zero probabilities add nothing."""
    p = doubles(values) if is_prob else softmax(values)
    return -F.aggregate(p, F.lit(0.0), lambda s, v: s + F.when(v > 0, v * F.log(F.greatest(v, F.lit(eps)))).otherwise(0.0))


def _kept(x: Column, keep: Callable[[Column, Column], Column]) -> Column:
    return F.transform(x, lambda v, i: F.when(keep(v, i), v).otherwise(F.lit(NEVER)))


def _only(x: Column, indexes: Column) -> Column:
    return let(indexes, lambda own: _kept(x, lambda v, i: F.array_contains(own, i)))


def _order(x: Column) -> Column:
    """(index, value) by falling value, ties by index."""
    pairs = F.transform(x, lambda v, i: F.struct((-v).alias("down"), i.alias("i")))
    return F.array_sort(pairs)


def top_k(logits: Column | str, frac: float = 0.1, k: int | None = None) -> Column:
    """Keeps the k largest, or ceil(frac * size) of them."""
    x = doubles(logits)
    n = F.lit(k) if k is not None else F.ceil(F.size(x) * F.lit(frac)).cast("int")
    return _only(x, F.transform(F.slice(_order(x), F.lit(1), F.least(n, F.size(x))), lambda e: e["i"]))


def top_p(logits: Column | str, thres: float = 0.9) -> Column:
    """Keeps the largest until their sum first exceeds thres, that one included."""
    x = doubles(logits)
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<int>").alias("keep"))
    run = F.aggregate(_order(softmax(x)), start, lambda acc, e: F.struct(
        (acc["sum"] - e["down"]).alias("sum"),
        F.when(acc["sum"] <= thres, F.array_append(acc["keep"], e["i"])).otherwise(acc["keep"]).alias("keep")))
    return _only(x, run["keep"])


def _probable(x: Column, limit: Callable[[Column], Column]) -> Column:
    """Keeps what is at least as probable as the limit made of the largest probability."""
    return let(softmax(x), lambda p: let(limit(F.array_max(p)), lambda least: F.zip_with(x, p, lambda v, q: F.when(q >= least, v).otherwise(F.lit(NEVER)))))


def top_a(logits: Column | str, power: float = 2.0, ratio: float = 0.02) -> Column:
    """Keeps probabilities of at least ratio times the largest to a power."""
    return _probable(doubles(logits), lambda top: F.lit(ratio) * F.pow(top, F.lit(power)))


def min_p(logits: Column | str, min_p: float = 0.1) -> Column:
    """Keeps probabilities of at least min_p times the largest."""
    return _probable(doubles(logits), lambda top: F.lit(min_p) * top)


#: Sampling filters by name.
FILTERS: dict[str, Callable[..., Column]] = {"top_p": top_p, "top_k": top_k, "top_a": top_a, "min_p": min_p}


def filter_logits(name: str, logits: Column | str, **options) -> Column:
    if name not in FILTERS:
        raise ValueError(f"unknown filter {name!r}; one of {sorted(FILTERS)}")
    return FILTERS[name](logits, **options)


def contrastive(expert: Column | str, amateur: Column | str, alpha: float = 0.1, beta: float = 0.5) -> Column:
    """(1 + beta) * expert - beta * amateur, where the expert is within log(alpha) of its own best."""
    e, a = doubles(expert), doubles(amateur)
    return let(F.log(F.lit(alpha)) + F.array_max(e), lambda limit: F.zip_with(e, a, lambda x, y: F.when(x < limit, F.lit(NEVER)).otherwise((1 + beta) * x - beta * y)))


def bias_logits(logits: Column | str, bias: dict[int, float], forbidden: list[int] | None = None, temperature: float = 1.0) -> Column:
    """Adds a bias to some tokens, rules out forbidden ones, divides by the temperature."""
    shift = F.create_map(*[F.lit(v) for pair in bias.items() for v in pair]) if bias else None
    add = (lambda i: F.coalesce(F.element_at(shift, i), F.lit(0.0))) if bias else (lambda i: F.lit(0.0))
    out = F.transform(doubles(logits), lambda v, i: (v + add(i)) / temperature)
    return _kept(out, lambda v, i: ~i.isin(*forbidden)) if forbidden else out


def repetition_penalty(logits: Column | str, recent: Column | str, penalty: float = 1.2) -> Column:
    """Divides positive and multiplies negative logits of the recent tokens by the penalty."""
    seen = F.col(recent) if isinstance(recent, str) else recent
    return F.transform(doubles(logits), lambda v, i: F.when(F.array_contains(seen, i), F.when(v > 0, v / penalty).otherwise(v * penalty)).otherwise(v))


def sigmoid(x: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return 1 / (1 + F.exp(-x))


def argmax(values: Column | str) -> Column:
    """Index of the largest, the first of equals."""
    x = doubles(values)
    return F.array_position(x, F.array_max(x)).cast("int") - 1


def display_probability(p: Column, log_p: Column) -> Column:
    """The number, or ~10^x where it underflows to zero."""
    return F.when(p == 0, F.format_string("~10^%d", F.round(log_p / F.log(F.lit(10.0))).cast("long"))).otherwise(F.format_string("%.6e", p))
