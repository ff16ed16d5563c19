"""Expressions over levels, pitch and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-9


def rms(x: Column) -> Column:
    """Root mean square, as an aggregate."""
    return F.sqrt(F.avg(x * x))


def db(level: Column) -> Column:
    """Decibels of a level, with a floor of 1e-9."""
    return F.lit(20.0) * F.log10(F.greatest(level, F.lit(FLOOR)))


def semitones(hz: Column, ref: float = 100.0) -> Column:
    return F.lit(12.0) * F.log2(F.greatest(hz, F.lit(1e-6)) / F.lit(ref))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column, eps: float = 0.0) -> Column:
    """The vector divided by its length (plus ``eps``)."""
    return F.transform(a, lambda x: x.cast("double") / (norm(a) + F.lit(eps)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def downmix(channels: Column) -> Column:
    """Mean of the channels; ``channels`` is an array of equally long sample arrays."""
    n = F.size(channels)
    first = F.element_at(channels, 1)
    return F.transform(first, lambda x, i: F.aggregate(channels, F.lit(0.0), lambda s, c: s + F.get(c, i)) / n)
