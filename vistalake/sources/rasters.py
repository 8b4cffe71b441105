"""Deterministic rasters drawn from the driver's tables, with integer and IEEE-double arithmetic only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vistalake.operators.packed import packed_frames

GAUGE_WIDTH, GAUGE_HEIGHT = 96, 32
TRACK_X, TRACK_Y, TRACK_W, TRACK_H = 8, 20, 64, 8
BACKGROUND, FILL = (28, 30, 34), (210, 40, 40)
GROOVES = ((70, 70, 78), (210, 210, 210), (16, 16, 16))
MOTION_WIDTH, MOTION_HEIGHT, MOTION_FRAMES, SQUARE = 64, 24, 6, 8


def fill_px(suppkey: Column, acctbal: Column) -> Column:
    """Filled columns of a supplier's gauge."""
    level = F.floor((acctbal + 1000) / 11000 * TRACK_W)
    return F.when(suppkey % 10 == 0, F.lit(TRACK_W)).otherwise(F.least(F.greatest(level, F.lit(0)), F.lit(TRACK_W))).cast("int")


def _places(rows: DataFrame, width: Column | int, height: int) -> DataFrame:
    """A row for each pixel of each row's frame: generated in place, without a join."""
    w = width if isinstance(width, Column) else F.lit(width)
    cells = rows.withColumn("width", w.cast("int")).withColumn("height", F.lit(height)).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("width") * height - 1)))
    return cells.withColumn("x", (F.col("i") % F.col("width")).cast("int")).withColumn("y", F.floor(F.col("i") / F.col("width")).cast("int")).drop("i")


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """Narrow rows dealt by frame before they grow to pixels: later groupings by frame then need no exchange.

    The session's number of partitions is given, since by their size now they would be merged into one.
    """
    session = rows.sparkSession
    return rows.repartition(max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism), key)


def _drawn(cells: DataFrame, keys: list[str], r: Column, g: Column, b: Column) -> DataFrame:
    """The pixel columns as a generator's output: predicates then read them instead of drawing them again."""
    pixel = F.struct("x", "y", r.alias("r"), g.alias("g"), b.alias("b"), F.lit(255).alias("a"), "width", "height")
    return cells.select(*keys, F.inline(F.array(pixel)))


def gauges(supplier: DataFrame) -> DataFrame:
    """Pixels of one gauge frame for each supplier."""
    base = supplier.select(F.col("s_suppkey").alias("frame_id"), fill_px(F.col("s_suppkey"), F.col("s_acctbal")).alias("fill_px"))
    cells = _places(_dealt(base, "frame_id"), GAUGE_WIDTH, GAUGE_HEIGHT)
    on_track = F.col("x").between(TRACK_X, TRACK_X + TRACK_W - 1) & F.col("y").between(TRACK_Y, TRACK_Y + TRACK_H - 1)
    groove = lambda c: F.when(F.col("frame_id") % 3 == 0, GROOVES[0][c]).when(F.col("frame_id") % 3 == 1, GROOVES[1][c]).otherwise(GROOVES[2][c])
    shade = lambda c: F.when(~on_track, BACKGROUND[c]).when(F.col("x") < TRACK_X + F.col("fill_px"), FILL[c]).otherwise(groove(c)).cast("int")
    return _drawn(cells, ["frame_id"], shade(0), shade(1), shade(2))


def _canvas(width: int, height: int, colour: tuple[int, int, int]) -> np.ndarray:
    return np.tile(np.array([*colour, 255], dtype=np.uint8), (height, width, 1))


def gauge_image(frame_id: int, fill: int) -> np.ndarray:
    image = _canvas(GAUGE_WIDTH, GAUGE_HEIGHT, BACKGROUND)
    track = image[TRACK_Y : TRACK_Y + TRACK_H, TRACK_X : TRACK_X + TRACK_W, :3]
    track[:] = GROOVES[frame_id % 3]
    track[:, :fill] = FILL
    return image


def gauge_frames(supplier: DataFrame) -> DataFrame:
    """The gauges as packed frames."""
    rows = supplier.select(F.col("s_suppkey").cast("long").alias("frame_id"), fill_px(F.col("s_suppkey"), F.col("s_acctbal")).alias("fill_px"))
    return packed_frames(rows, gauge_image, ["frame_id", "fill_px"], ["frame_id"])


def step_of(suppkey: Column) -> Column:
    return F.when(suppkey % 7 == 0, 0).otherwise(suppkey % 5 + 4).cast("int")


def motion_sequences(supplier: DataFrame) -> DataFrame:
    """Pixels of six frames for each supplier: a bright square that moves; some streams change size once."""
    t = supplier.select(F.col("s_suppkey").alias("stream_id"), step_of(F.col("s_suppkey")).alias("step"), F.explode(F.sequence(F.lit(0), F.lit(MOTION_FRAMES - 1))).alias("frame_no"))
    t = _dealt(t, "stream_id")
    width = F.when((F.col("stream_id") % 11 == 5) & (F.col("frame_no") == 3), MOTION_WIDTH - 1).otherwise(MOTION_WIDTH)
    cells = _places(t, width, MOTION_HEIGHT)
    left = 4 + F.col("frame_no") * F.col("step")
    bright = (F.col("x") >= left) & (F.col("x") < left + SQUARE) & F.col("y").between(8, 8 + SQUARE - 1)
    v = F.when(bright, 230).otherwise(20)
    return _drawn(cells, ["stream_id", "frame_no"], v, v, v)


def motion_image(stream_id: int, frame_no: int, step: int) -> np.ndarray:
    image = _canvas(MOTION_WIDTH - (stream_id % 11 == 5 and frame_no == 3), MOTION_HEIGHT, (20, 20, 20))
    left = 4 + frame_no * step
    image[8 : 8 + SQUARE, left : left + SQUARE, :3] = 230
    return image


def motion_frames(supplier: DataFrame) -> DataFrame:
    """The moving squares as packed frames."""
    key = F.col("s_suppkey").cast("long")
    rows = supplier.select(key.alias("stream_id"), step_of(F.col("s_suppkey")).alias("step"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(MOTION_FRAMES - 1).cast("long"))).alias("frame_no"))
    return packed_frames(rows, motion_image, ["stream_id", "frame_no", "step"], ["stream_id", "frame_no"])


def event_detections(events: DataFrame) -> DataFrame:
    """Detections from events: a stream for each user, a frame for each day, in order of the event's id."""
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    k = F.get_json_object("props", "$.k").try_cast("double")
    return events.select(
        F.col("user_id").alias("stream_id"), day.cast("long").alias("frame_no"), F.col("event_id").alias("ord"),
        F.col("value").cast("float").alias("cx"), F.coalesce(k, F.lit(0.0)).cast("float").alias("cy"), F.lit(4.0).cast("float").alias("w"), F.lit(4.0).cast("float").alias("h"),
    )


def tsv_lines(lineitem: DataFrame) -> DataFrame:
    """One line of a recogniser's table for each line item; some are blank, short or have bad numbers."""
    number = F.col("l_linenumber")
    y = F.when(number == 3, F.concat(F.lit("-"), F.col("l_suppkey").cast("string"))).when(number == 4, F.lit("5.5")).otherwise(F.col("l_suppkey").cast("string"))
    word = F.when(number == 5, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("l_returnflag"), F.col("l_linestatus"), F.lit(" ")))
    line = F.concat_ws("\t", *(F.lit(v) for v in ("5", "1", "1", "1", "1")), number.cast("string"), F.col("l_partkey").cast("string"), y, number.cast("string"), F.col("l_quantity").cast("int").cast("string"), F.lit("91.5"))
    return lineitem.select("l_orderkey", "l_linenumber", F.when(number == 6, line).otherwise(F.concat(line, F.lit("\t"), word)).alias("line"))
