"""Confidence values: floats in [0, 1]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def f32(value) -> Column:
    """A literal or column as FLOAT, so that arithmetic stays in single precision."""
    return (value if isinstance(value, Column) else F.lit(float(value))).cast("float")


NONE, CERTAIN = 0.0, 1.0


def confidence(value) -> Column:
    """Clamped to [0, 1]; NaN stays NaN."""
    v = f32(value)
    return F.when(F.isnan(v), v).otherwise(F.least(F.greatest(v, f32(0)), f32(1)))


def combine(a, b) -> Column:
    """Independent evidence: a + b - a b."""
    a, b = f32(a), f32(b)
    return confidence(a + b - a * b)


def combine_all(values: Column, start=NONE) -> Column:
    """The fold of an array of confidences, in order."""
    return F.aggregate(values, f32(start), lambda acc, v: combine(acc, v))


def decay(value, factor) -> Column:
    return confidence(f32(value) * confidence(factor))


def is_confident(value, threshold) -> Column:
    return f32(value) >= f32(threshold)


def percent_text(value) -> Column:
    """Rounded half to even after a product in single precision, as ``42%``."""
    return F.concat(F.bround((f32(value) * f32(100)).cast("double"), 0).cast("long").cast("string"), F.lit("%"))
