"""Colour predicates over pixel columns, in single precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from vistalake.functions.confidence import f32

#: A test of a pixel: red, green, blue, alpha columns in, boolean column out. Catalyst sees through it.
Predicate = Callable[[Column, Column, Column, Column], Column]


def _over(a: Column, b: Column) -> Column:
    """Float division: the double quotient of two floats, rounded once more, is the float quotient."""
    return F.try_divide(a, b).cast("float")


def hsv(r: Column, g: Column, b: Column) -> Column:
    """Hue in [0, 360), saturation and value in [0, 1]."""
    # Comparisons are on whole numbers, and only the red sector can go below 0: the tree stays small, since a filter
    # evaluates each mention of it anew.
    unit = lambda c: _over(f32(c), f32(255))
    top, delta = unit(F.greatest(r, g, b)), unit(F.greatest(r, g, b)) - unit(F.least(r, g, b))
    from_red = f32(60) * _over(unit(g) - unit(b), delta)
    hue = (
        F.when((r == g) & (g == b), f32(0))
        .when((r >= g) & (r >= b), F.when(g >= b, from_red).otherwise(from_red + f32(360)))
        .when(g >= b, f32(60) * (_over(unit(b) - unit(r), delta) + f32(2)))
        .otherwise(f32(60) * (_over(unit(r) - unit(g), delta) + f32(4)))
    )
    return F.struct(hue.alias("h"), F.when(top == f32(0), f32(0)).otherwise(_over(delta, top)).alias("s"), top.alias("v"))


def hue_in_range(h: Column, low: float, high: float) -> Column:
    """Inclusive; a range with ``low > high`` goes through 0."""
    above, below = h >= f32(low), h <= f32(high)
    return above & below if low <= high else above | below


def color_pixel(hue_range: tuple[float, float], min_s: float, min_v: float) -> Predicate:
    """Opaque enough (alpha at least half) and within the colour range; the cheap tests first."""

    def test(r, g, b, a):
        c = hsv(r, g, b)
        return (a >= 128) & (c["v"] >= f32(min_v)) & (c["s"] >= f32(min_s)) & hue_in_range(c["h"], *hue_range)

    return test


def alpha_is_high(a: Column) -> Column:
    return a >= 115


def text_pixel(r: Column, g: Column, b: Column, a: Column) -> Column:
    """Bright, pale pixels, as text on a dark screen has them."""
    luma = f32(0.299) * f32(r) + f32(0.587) * f32(g) + f32(0.114) * f32(b)
    c = hsv(r, g, b)
    return alpha_is_high(a) & (luma >= f32(90)) & (c["s"] <= f32(0.55)) & (c["v"] >= f32(0.45))


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Integer luma."""
    return F.floor((r * 299 + g * 587 + b * 114) / 1000).cast("int")


def similar(r: Column, g: Column, b: Column, reference: Column, tolerance: int) -> Column:
    """All channels within ``tolerance`` of the reference's."""
    near = [F.abs(c.cast("int") - reference.getField(n).cast("int")) <= tolerance for c, n in ((r, "r"), (g, "g"), (b, "b"))]
    return near[0] & near[1] & near[2]


def bucket(r: Column, g: Column, b: Column, step: int) -> Column:
    """RGB divided by ``step``, whole numbers."""
    if step < 1:
        raise ValueError("step must be at least 1")
    return F.struct(*(F.floor(c / step).cast("int").alias(n) for c, n in ((r, "r"), (g, "g"), (b, "b"))))
