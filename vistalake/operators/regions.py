"""Regions of a frame: bars, panels, text blocks, dominant colours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistalake.functions import color
from vistalake.functions.rect import area, clipped, rect
from vistalake.operators.runs import group_runs, row_runs

Region = tuple[int, int, int, int]
MIN_TEXT_PIXELS, TEXT_BLOCK_PADDING = 6, 2


def largest(rects: DataFrame, keys=("frame_id",)) -> DataFrame:
    """The largest rectangle of each key; of equals the one that was completed last. One aggregation, no sort."""
    best = F.max_by(F.struct("x", "y", "w", "h"), F.struct(area(F.struct("x", "y", "w", "h")), "ord"))
    return rects.groupBy(*keys).agg(best.alias("r")).select(*keys, "r.x", "r.y", "r.w", "r.h")


def find_horizontal_region(pixels: DataFrame, region: Region, min_width: int, min_height: int, predicate: color.Predicate, keys=("frame_id",)) -> DataFrame:
    """The largest rectangle of matching runs in a region, for frames that have one."""
    return largest(group_runs(row_runs(pixels, predicate, min_width, region, keys), min_height, 2, keys), keys)


def find_color_bar(pixels: DataFrame, region: Region, hue: tuple[float, float], min_s: float, min_v: float, keys=("frame_id",)) -> DataFrame:
    return find_horizontal_region(pixels, region, max(region[2] // 20, 8), 2, color.color_pixel(hue, min_s, min_v), keys)


def find_color_regions(pixels: DataFrame, region: Region, hue: tuple[float, float], min_s: float, min_v: float, keys=("frame_id",)) -> DataFrame:
    """All rectangles of the colour of at least 20 by 4, in order of completion (``ord``)."""
    runs = row_runs(pixels, color.color_pixel(hue, min_s, min_v), 20, region, keys)
    return group_runs(runs, 4, 2, keys).where("w >= 20 AND h >= 4")


def find_text_block(pixels: DataFrame, region: Region, keys=("frame_id",)) -> DataFrame:
    """The padded box around text-like pixels; frames with fewer than six have none. Padding isn't clipped."""
    pad = TEXT_BLOCK_PADDING
    found = pixels.where(clipped(F.col("x"), F.col("y"), region) & color.text_pixel(*(F.col(c) for c in "rgba")))
    box = found.groupBy(*keys).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("n"))
    shape = rect(F.greatest(F.col("x0") - pad, F.lit(0)), F.greatest(F.col("y0") - pad, F.lit(0)), F.col("x1") - F.col("x0") + 1 + 2 * pad, F.col("y1") - F.col("y0") + 1 + 2 * pad)
    return box.where(F.col("n") >= MIN_TEXT_PIXELS).select(*keys, shape.alias("r")).select(*keys, "r.x", "r.y", "r.w", "r.h")


def find_text_block_in_regions(pixels: DataFrame, regions: list[Region], keys=("frame_id",)) -> DataFrame:
    """The box of the first region, in list order, that has one: one scan, a region number on each pixel inside."""
    pad = TEXT_BLOCK_PADDING
    inside = F.array_compact(F.array(*(F.when(clipped(F.col("x"), F.col("y"), r), F.lit(i)) for i, r in enumerate(regions))))
    hits = pixels.where(color.text_pixel(*(F.col(c) for c in "rgba"))).select(*keys, "x", "y", F.explode(inside).alias("region_no"))
    box = hits.groupBy(*keys, "region_no").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_TEXT_PIXELS)
    shape = rect(F.greatest(F.col("x0") - pad, F.lit(0)), F.greatest(F.col("y0") - pad, F.lit(0)), F.col("x1") - F.col("x0") + 1 + 2 * pad, F.col("y1") - F.col("y0") + 1 + 2 * pad)
    first = box.groupBy(*keys).agg(F.min_by(shape, "region_no").alias("r"), F.min("region_no").alias("region_no"))
    return first.select(*keys, "region_no", "r.x", "r.y", "r.w", "r.h")


def dominant_color_bucket(pixels: DataFrame, region: Region, step: int, keys=("frame_id",)) -> DataFrame:
    """The most frequent colour bucket among opaque pixels; of equals the smallest (r, g, b)."""
    inside = pixels.where(clipped(F.col("x"), F.col("y"), region) & (F.col("a") >= 200))
    counts = inside.groupBy(*keys, color.bucket(F.col("r"), F.col("g"), F.col("b"), step).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("n"), -F.col("bucket.r"), -F.col("bucket.g"), -F.col("bucket.b"))
    return counts.groupBy(*keys).agg(F.max_by("bucket", order).alias("bucket"), F.max("n").alias("n")).select(*keys, F.col("bucket.r").alias("bucket_r"), F.col("bucket.g").alias("bucket_g"), F.col("bucket.b").alias("bucket_b"), "n")


def find_uniform_color_panel(pixels: DataFrame, region: Region, buckets: DataFrame, step: int, keys=("frame_id",)) -> DataFrame:
    """The largest rectangle of pixels in the frame's bucket (``bucket_r, bucket_g, bucket_b`` of ``buckets``)."""
    wanted = buckets.select(*keys, "bucket_r", "bucket_g", "bucket_b")
    # One small row for each frame; Spark broadcasts it if it is small enough, else both sides are dealt by frame.
    own = pixels.where(clipped(F.col("x"), F.col("y"), region) & (F.col("a") >= 200)).join(wanted, list(keys))
    same = (F.floor(F.col("r") / step) == F.col("bucket_r")) & (F.floor(F.col("g") / step) == F.col("bucket_g")) & (F.floor(F.col("b") / step) == F.col("bucket_b"))
    runs = row_runs(own.where(same), lambda r, g, b, a: F.lit(True), 20, None, keys)
    return largest(group_runs(runs, 12, 2, keys), keys)


def is_blank(pixels: DataFrame, keys=("frame_id",), samples: int = 512) -> DataFrame:
    """``keys, is_blank``: whether about 512 pixels at even distances all have one colour; empty frames are blank.

    Needs ``width`` and ``height`` columns on the pixels.
    """
    stride = F.greatest(F.floor(F.col("width") * F.col("height") / samples).cast("long"), F.lit(1))
    probed = pixels.where((F.col("y") * F.col("width") + F.col("x")) % stride == 0)
    colour = F.struct("r", "g", "b")
    return probed.groupBy(*keys).agg((F.min(colour) == F.max(colour)).alias("is_blank"))
