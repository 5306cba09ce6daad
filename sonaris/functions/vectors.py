"""Column builders over arrays of numbers. All arithmetic is in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Norms below this count as this, so a zero vector stays zero and is never NaN.
LEAST_NORM = 1e-12


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once. Within a lambda an outer expression would be evaluated for
    every element; a lambda's variable isn't."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column | str) -> Column:
    """The vector over its length."""
    return let(F.greatest(norm(v), F.lit(LEAST_NORM)), lambda n: F.transform(doubles(v), lambda x: x / n))


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(LEAST_NORM)) * F.greatest(norm(b), F.lit(LEAST_NORM)))


def half_precision(v: Column | str) -> Column:
    """Components rounded to 11 significant bits, half to even, as a half-precision store keeps them
    (normal range); kept in single precision."""
    def one(x: Column) -> Column:
        size = F.abs(x)
        exponent = F.when(size == 0, F.lit(0.0)).otherwise(F.greatest(F.floor(F.log2(size)), F.lit(-14.0)))
        step = F.pow(F.lit(2.0), exponent - 10)
        rounded = F.rint(x / step) * step
        return F.when(F.abs(rounded) > 65504.0, F.signum(x) * float("inf")).otherwise(rounded).cast("float")

    return F.transform(doubles(v), one)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def scale(v: Column, by: Column | float) -> Column:
    return F.transform(v, lambda x: x * by)


def zeros(n: int | Column) -> Column:
    return F.array_repeat(F.lit(0.0), n)
