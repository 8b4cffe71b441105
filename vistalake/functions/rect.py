"""Rectangles as structs of longs: x, y, w, h."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vistalake.functions.confidence import f32

MOST = 4294967295


def rect(x, y, w, h) -> Column:
    return F.struct(*((v if isinstance(v, Column) else F.lit(v)).cast("long").alias(n) for n, v in zip("xywh", (x, y, w, h))))


def x2(r: Column) -> Column:
    """The last column inside (the first, if the width is 0)."""
    return F.least(r["x"] + F.greatest(r["w"] - 1, F.lit(0)), F.lit(MOST))


def y2(r: Column) -> Column:
    return F.least(r["y"] + F.greatest(r["h"] - 1, F.lit(0)), F.lit(MOST))


def area(r: Column) -> Column:
    return F.least(r["w"] * r["h"], F.lit(MOST))


def center(r: Column) -> Column:
    half = lambda at, size: (f32(at) + f32(size) * f32(0.5)).cast("float")
    return F.struct(half(r["x"], r["w"]).alias("x"), half(r["y"], r["h"]).alias("y"))


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """How many whole numbers two inclusive intervals share."""
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0) + 1, F.lit(0))


def clipped(x: Column, y: Column, region: tuple[int, int, int, int]) -> Column:
    """Pixels inside a region, as plain range filters that reach the scan."""
    rx, ry, rw, rh = region
    return (x >= rx) & (x < rx + rw) & (y >= ry) & (y < ry + rh)
