"""Whether text in a region is sharp enough to be read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistalake.functions.color import luminance
from vistalake.functions.confidence import f32
from vistalake.functions.rect import clipped

NOISE_STEP, HARD_STEP, MIN_EDGES, LEGIBLE_SHARPNESS = 18, 70, 24, 0.35
SHARP, BLURRED, NO_TEXT = "Sharp", "Blurred", "NoText"


def assess_text_quality(pixels: DataFrame, region: tuple[int, int, int, int], keys=("frame_id",)) -> DataFrame:
    """``keys, sharpness, edge_samples, legibility``: the share of hard steps among brightness steps along rows.

    The region is cut first, so its last column has no right neighbour.
    """
    inside = pixels.where(clipped(F.col("x"), F.col("y"), region)).select(*keys, "x", "y", luminance(F.col("r"), F.col("g"), F.col("b")).alias("luma"))
    steps = inside.withColumn("step", F.abs(F.expr(f"lead(luma) OVER (PARTITION BY {', '.join(keys)}, y ORDER BY x)") - F.col("luma")))
    counts = steps.groupBy(*keys).agg(F.count_if(F.col("step") >= NOISE_STEP).alias("edge_samples"), F.count_if(F.col("step") >= HARD_STEP).alias("hard"))
    enough = F.col("edge_samples") >= MIN_EDGES
    sharpness = F.when(enough, F.try_divide(f32(F.col("hard")), f32(F.col("edge_samples"))).cast("float")).otherwise(f32(0))
    return counts.withColumn("sharpness", sharpness).select(
        *keys, "sharpness", "edge_samples", F.when(~enough, NO_TEXT).when(F.col("sharpness") >= f32(LEGIBLE_SHARPNESS), SHARP).otherwise(BLURRED).alias("legibility")
    )


def is_legible(legibility):
    return legibility == SHARP
