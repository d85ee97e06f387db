"""Vector arithmetic on array columns, summed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added to a norm before dividing by it.
EPSILON = 1e-9


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(doubles(v), lambda x: x * x)))


def normalized(v: Column) -> Column:
    size = norm(v) + EPSILON
    return F.transform(doubles(v), lambda x: x / size)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def cross_entropy(logits: Column, target: Column) -> Column:
    """Loss of a 0-based target under logits, by shifted exponentials."""
    top = F.array_max(logits)
    total = _sum(F.transform(logits, lambda x: F.exp(x - top)))
    return F.log(total) - (F.element_at(logits, target + 1) - top)
