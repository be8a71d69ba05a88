"""Vector functions on array columns, in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DISTANCES = ("cosine", "dot", "l2-squared", "manhattan", "hamming")


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Scaled to length one; the zero vector stays."""
    length = norm(a)
    return F.when(length == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / length))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where a vector is zero."""
    length = norm(a) * norm(b)
    return F.when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / length)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(distance("l2-squared", a, b))


def distance(kind: str, a: Column, b: Column) -> Column:
    """Smaller is nearer: 1 - cosine, -dot, sum of squares, sum of absolute values, unequal components."""
    if kind == "cosine":
        return 1 - cosine(a, b)
    if kind == "dot":
        return -dot(a, b)
    terms = {
        "l2-squared": lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")),
        "manhattan": lambda x, y: F.abs(x.cast("double") - y.cast("double")),
        "hamming": lambda x, y: F.when(x != y, F.lit(1.0)).otherwise(F.lit(0.0)),
    }
    return _sum(F.zip_with(a, b, terms[kind]))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def last_softmax(logits: Column) -> Column:
    """One logit: its sigmoid; several: the softmax share of the last."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return F.when(F.size(logits) == 1, sigmoid(F.get(logits, F.lit(0)))).otherwise(F.exp(F.element_at(logits, -1) - top) / total)
