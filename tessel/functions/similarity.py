"""Similarity of vectors on the scale from 0 to 1, null unless both have the same length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """(1 + cos) / 2; null for a vector of zeros."""
    score = F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))
    return F.when(F.size(a) == F.size(b), (1 + score) / 2)


def euclidean(a: Column, b: Column) -> Column:
    """1 / (1 + squared distance)."""
    d2 = _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))
    return F.when(F.size(a) == F.size(b), 1 / (1 + d2))


def canonical_text(*properties: tuple[str, Column]) -> Column:
    """``name: value`` of the properties that are there, a line each, in order of their names: what an embedding is made of."""
    return F.concat_ws("\n", *[F.when(c.isNotNull(), F.concat(F.lit(f"{n}: "), c.cast("string"))) for n, c in sorted(properties, key=lambda p: p[0])])


def value_hash(text: Column) -> Column:
    """Tells whether the text behind an embedding has changed."""
    return F.sha2(text, 256)


def mean_pool(vectors: Column) -> Column:
    """The element-wise mean of an array of vectors of one length; null for an empty array."""
    n = F.size(vectors)
    first = F.transform(F.get(vectors, F.lit(0)), lambda x: F.lit(0.0))
    total = F.aggregate(vectors, first, lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y.cast("double")))
    return F.when(n > 0, F.transform(total, lambda x: x / n))
