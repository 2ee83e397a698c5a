"""Vectors as array columns: similarity, norms and a deterministic text embedding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_double(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of unequal length or without a length."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size).otherwise(0.0)


def unit(a: Column) -> Column:
    """The vector divided by its norm, so that cosines are dot products; zeros stay."""
    n = norm(a)
    return F.transform(_double(a), lambda x: F.when(n > 0, x / n).otherwise(0.0))


def letter_frequencies(text: Column) -> Column:
    """26 shares of a to z among the letters of a text; zeros without any."""
    lower = F.lower(text)
    size = F.char_length(lower)
    counts = F.array(*((size - F.char_length(F.replace(lower, F.lit(chr(97 + i)), F.lit("")))).cast("double") for i in range(26)))
    # one-element arrays: counts and total are then computed once, not for each share
    summed = F.transform(F.array(counts), lambda v: F.struct(v.alias("v"), F.aggregate(v, F.lit(0.0), lambda a, x: a + x).alias("n")))
    shares = F.transform(summed, lambda s: F.transform(s["v"], lambda c: F.when(s["n"] > 0, c / s["n"]).otherwise(0.0)))
    return F.element_at(shares, 1)


def hyperplanes(dimensions: int, bits: int, seed: int = 1) -> list[list[float]]:
    import numpy as np

    return np.random.default_rng(seed).normal(size=(bits, dimensions)).round(6).tolist()


def signature(v: Column, planes: list[list[float]]) -> Column:
    """One bit for the side of each hyperplane on which v lies: a bucket for approximate search."""
    return sum((F.shiftleft(F.when(dot(v, F.array(*(F.lit(x) for x in p))) >= 0, 1).otherwise(0).cast("long"), i) for i, p in enumerate(planes)), F.lit(0).cast("long"))
