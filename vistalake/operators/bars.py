"""How full a bar is: the share of its track that has the fill's colour, with the empty colour learned per bar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vistalake.functions.color import Predicate, similar
from vistalake.functions.confidence import f32

BOUNDARY_TOLERANCE, GROOVE_TOLERANCE = 3, 38


def _median(channel: str, test: str, keys: list[str]) -> Column:
    """The upper median of a channel among the key's rows that pass; it holds one count for each value."""
    ordered = f"WITHIN GROUP (ORDER BY CASE WHEN {test} THEN {channel} END DESC)"
    return F.expr(f"percentile_disc(0.5) {ordered} OVER (PARTITION BY {', '.join(keys)})").cast("int")


def core_rows(bars: DataFrame) -> DataFrame:
    """Adds ``row0, row1``: the bar's middle rows, without a quarter at each side; at least one row."""
    quarter = F.floor(F.col("h") / 4)
    start = F.least(F.col("y") + quarter, F.greatest(F.col("height") - 1, F.lit(0)))
    end = F.least(F.col("y") + F.col("h") - quarter, F.col("height"))
    return bars.withColumn("row0", start.cast("long")).withColumn("row1", F.when(end <= start, F.least(start + 1, F.col("height"))).otherwise(end).cast("long"))


def measure_bar_fill(pixels: DataFrame, bars: DataFrame, is_filled: Predicate, keys=("frame_id",)) -> DataFrame:
    """``keys, fill, failure_reason`` of every bar: percent (float), or null and why.

    ``bars`` has one row for each key: the fill's ``x, y, w, h``, the searched ``sx, sw`` and the frame's ``width,
    height``. Pixels and bars are read once and meet once, by key; only the bar's core and the row outside are kept.
    The empty colour and the colour outside are windows over these, and the walk to both sides is a window over columns.
    """
    keys = list(keys)
    right = F.least(F.col("sx") + F.col("sw"), F.col("width").cast("long"))
    usable = (F.col("w") > 0) & (F.col("h") > 0) & (F.col("y") < F.col("height")) & (F.col("x") >= F.col("sx")) & (F.col("x") < F.col("width"))
    known = core_rows(bars.select(*keys, *(F.col(c).cast("long").alias(c) for c in ("x", "y", "w", "h", "sx", "sw", "width", "height")))).withColumns({"right": right, "usable": usable})
    known = known.select(*(F.col(k).alias(f"bar_{k}") for k in keys), *(F.col(c).alias(f"bar_{c}") for c in ("x", "y", "w", "sx", "right", "row0", "row1", "width", "usable")))

    # Two walks: to the left from the fill's first column, and to the right from the one behind it.
    walked = ((F.col("x") >= F.col("bar_sx")) | (F.col("x") > F.col("bar_x"))) & ((F.col("x") < F.col("bar_right")) | (F.col("x") <= F.col("bar_x")))
    in_core = (F.col("y") >= F.col("bar_row0")) & (F.col("y") < F.col("bar_row1")) & walked
    outer = (F.col("y") == F.col("bar_y") - 3) & (F.col("x") >= F.col("bar_x")) & (F.col("x") < F.least(F.col("bar_x") + F.col("bar_w"), F.col("bar_width")))
    # Spark takes pixels that a generator draws for as few bytes as the rows they come from, and would broadcast them. The
    # hint makes the bars, one row for each key, the hashed side in every partition. A bar without pixels keeps one row.
    met = F.col("bar_usable") & (in_core | outer)
    for k in keys:
        met = met & (F.col(k) == F.col(f"bar_{k}"))
    joined = pixels.select(*keys, "x", "y", *"rgba").join(known.hint("shuffle_hash"), met, "right")
    joined = joined.drop(*keys).withColumnsRenamed({f"bar_{k}": k for k in keys}).withColumns({"in_core": in_core, "outer": outer, "is_filled": is_filled(*(F.col(c) for c in "rgba"))})

    first = F.col("bar_x") + F.col("bar_w") + 2
    sample = F.col("in_core") & (F.col("x") >= first) & (F.col("x") < F.least(first + 6, F.col("bar_right"))) & (F.col("a") >= 128) & ~F.col("is_filled")
    learned = joined.withColumn("sample", sample)
    learned = learned.withColumns({f"{test}_{c}": _median(c, test, keys) for test in ("sample", "outer") for c in "rgb"})
    groove, outside = (F.struct(*(F.col(f"{test}_{c}").alias(c) for c in "rgb")) for test in ("sample", "outer"))
    is_outside = F.coalesce(similar(*(F.col(f"sample_{c}") for c in "rgb"), outside, GROOVE_TOLERANCE), F.lit(False))
    empty = ~is_outside & F.coalesce(similar(F.col("r"), F.col("g"), F.col("b"), groove, GROOVE_TOLERANCE), F.lit(False))

    # Rows outside the core count in no column; they, and bars without pixels, go to a column null.
    columns = learned.groupBy(*keys, "bar_usable", "bar_x", "bar_row0", "bar_row1", F.when(F.col("in_core"), F.col("x")).alias("x")).agg(
        F.count_if(F.col("is_filled")).alias("n_filled"), F.count_if(~F.col("is_filled") & empty).alias("n_empty")
    )
    rows = F.col("bar_row1") - F.col("bar_row0")
    kind = F.when(F.col("x").isNull(), None).when(2 * F.col("n_filled") > rows, F.lit("F")).when(2 * F.col("n_empty") > rows, F.lit("E"))
    side = F.when(F.col("x") <= F.col("bar_x"), F.lit(0)).when(F.col("x") > F.col("bar_x"), F.lit(1))
    step = F.abs(F.col("x") - F.col("bar_x"))
    classed = columns.select(*keys, "bar_usable", side.alias("side"), step.alias("step"), kind.alias("kind"))
    walk = f"PARTITION BY {', '.join(keys)}, side ORDER BY step"
    # A fourth unclear column in a row ends the walk; fewer are credited to the next clear column.
    classed = classed.withColumn("stop", F.expr(f"count_if(kind IS NULL) OVER ({walk} ROWS BETWEEN {BOUNDARY_TOLERANCE} PRECEDING AND CURRENT ROW) = {BOUNDARY_TOLERANCE + 1}"))
    classed = classed.withColumn("kind", F.expr(f"CASE WHEN NOT max(stop) OVER ({walk}) THEN kind END"))
    credited = classed.withColumn("kind", F.expr(f"first_value(kind) IGNORE NULLS OVER ({walk} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"))
    totals = credited.groupBy(*keys, "bar_usable").agg(F.count_if(F.col("kind") == "F").alias("filled"), F.count("kind").alias("track"))
    ratio = (f32(F.col("filled")) / f32(F.nullif(F.col("track"), F.lit(0)))).cast("float") * f32(100)
    fill = F.when(F.col("track") > 0, F.least(F.greatest(ratio, f32(0)), f32(100)))
    reason = F.when(~F.col("bar_usable"), "bar has no usable area").when(fill.isNull(), "no track found")
    return totals.select(*keys, fill.alias("fill"), reason.alias("failure_reason"))
