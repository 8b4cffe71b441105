"""Debug overlays: outlines and text as pixel rows, laid over a frame's pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def outline(rects: DataFrame, thickness: int, keys=("frame_id",)) -> DataFrame:
    """``keys, x, y`` of the pixels of each rectangle's inset outline; needs ``x, y, w, h, width, height``.

    Each stroke is a sequence of its own, so work follows the outline, not the area. A height of 0 still strokes the
    top row, a thickness of 0 nothing.
    """
    keep = list(keys)
    if thickness < 1:
        return rects.where("false").select(*keep, "x", "y")
    c = {n: F.col(n).cast("long") for n in ("x", "y", "w", "h", "width", "height")}
    inset = rects.select(*keep, *(v.alias(n) for n, v in c.items()), F.explode(F.sequence(F.lit(0), F.lit(thickness - 1))).alias("t"))
    # Saturating arithmetic: an inset past the start stays at 0.
    low = lambda at, size: F.greatest(F.col(at) + F.greatest(F.col(size) - 1, F.lit(0)) - F.col("t"), F.lit(0))
    span = lambda at, size, limit: F.when(F.least(F.col(at) + F.col(size), F.col(limit)) > F.col(at), F.sequence(F.col(at), F.least(F.col(at) + F.col(size), F.col(limit)) - 1))
    across = inset.select(*keep, "width", "height", F.explode(span("x", "w", "width")).alias("px"), F.array(F.col("y") + F.col("t"), low("y", "h")).alias("ys"))
    down = inset.select(*keep, "width", "height", F.explode(span("y", "h", "height")).alias("py"), F.array(F.col("x") + F.col("t"), low("x", "w")).alias("xs"))
    a = across.select(*keep, "width", "height", F.col("px").alias("x"), F.explode("ys").alias("y"))
    d = down.select(*keep, "width", "height", F.explode("xs").alias("x"), F.col("py").alias("y"))
    return a.unionByName(d).where((F.col("x") < F.col("width")) & (F.col("y") < F.col("height"))).select(*keep, "x", "y").distinct()


def overlay(pixels: DataFrame, plotted: DataFrame, colour: tuple[int, int, int, int], keys=("frame_id",)) -> DataFrame:
    """The pixels with those in ``plotted`` (``keys, x, y``) overwritten; no blending."""
    marks = plotted.select(*keys, F.col("x").cast("long").alias("_x"), F.col("y").cast("long").alias("_y")).distinct().withColumn("_hit", F.lit(True))
    joined = pixels.withColumn("_x", F.col("x").cast("long")).withColumn("_y", F.col("y").cast("long")).join(marks, [*keys, "_x", "_y"], "left")
    paint = dict(zip("rgba", colour))
    return joined.select(*(F.when(F.col("_hit"), F.lit(paint[c])).otherwise(F.col(c)).cast(pixels.schema[c].dataType).alias(c) if c in paint else F.col(c) for c in pixels.columns))
