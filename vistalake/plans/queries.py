"""The engine's named queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vistalake import model
from vistalake.functions import color, confidence, glyphs, rect, text, timing
from vistalake.operators import bars, drawing, motion, packed, quality, regions, runs, tracking
from vistalake.plans.more_queries import MORE
from vistalake.sources import rasters

WHOLE = (0, 0, rasters.GAUGE_WIDTH, rasters.GAUGE_HEIGHT)
RED, MIN_S, MIN_V = (340.0, 30.0), 0.35, 0.30


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters.gauges(_table(spark, sf_dir, "supplier"))


def _double(c, digits: int = 4):
    return F.round(c.cast("double"), digits)


def _longs(df: DataFrame, *names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]


def confidence_fold(spark, sf_dir):
    """Combined and decayed confidence of each label."""
    both = confidence.combine_all(F.array(confidence.f32(F.col("quality")) * confidence.f32(0.6), confidence.f32(F.col("toxic")) * confidence.f32(0.3)))
    held = confidence.decay(both, 0.9)
    return _table(spark, sf_dir, "labels").select("doc_id", _double(held, 5).alias("confidence"), confidence.is_confident(held, 0.5).alias("is_confident"))


def _colours(spark, sf_dir):
    key = F.col("c_custkey")
    return _table(spark, sf_dir, "customer").select(
        "c_custkey", (key * 7 % 256).cast("int").alias("r"), (key * 13 % 256).cast("int").alias("g"), (key * 29 % 256).cast("int").alias("b"), (key * 3 % 256).cast("int").alias("a")
    )


def hsv_convert(spark, sf_dir):
    """Hue, saturation and value of a colour for each customer."""
    c = color.hsv(F.col("r"), F.col("g"), F.col("b"))
    return _colours(spark, sf_dir).select("c_custkey", *(_double(c[n], 3).alias(n) for n in "hsv"))


def pixel_tests(spark, sf_dir):
    """The colour and text tests of a pixel for each customer."""
    p = [F.col(c) for c in "rgba"]
    return _colours(spark, sf_dir).select("c_custkey", color.color_pixel(RED, MIN_S, MIN_V)(*p).alias("is_red"), color.text_pixel(*p).alias("is_text"), color.luminance(*p[:3]).cast("long").alias("luma"))


def color_pixel_count(spark, sf_dir):
    """Red pixels of each gauge frame."""
    test = color.color_pixel(RED, MIN_S, MIN_V)(*(F.col(c) for c in "rgba"))
    return _gauges(spark, sf_dir).groupBy("frame_id").agg(F.count_if(test).alias("n"))


def text_pixel_count(spark, sf_dir):
    """Text-like pixels of each gauge frame."""
    return _gauges(spark, sf_dir).groupBy("frame_id").agg(F.count_if(color.text_pixel(*(F.col(c) for c in "rgba"))).alias("n"))


def row_runs(spark, sf_dir):
    """Red runs of at least eight pixels."""
    found = runs.row_runs(_gauges(spark, sf_dir), color.color_pixel(RED, MIN_S, MIN_V), 8)
    return found.select("frame_id", *_longs(found, "y", "x0", "x1"))


def region_rects(spark, sf_dir):
    """Rectangles of red runs, with area, centre and last column and row."""
    grouped = runs.group_runs(runs.row_runs(_gauges(spark, sf_dir), color.color_pixel(RED, MIN_S, MIN_V), 4), 2, 2)
    r = F.struct("x", "y", "w", "h")
    return grouped.select("frame_id", "x", "y", "w", "h", rect.area(r).alias("area"), rect.x2(r).alias("x2"), rect.y2(r).alias("y2"), _double(rect.center(r)["x"]).alias("cx"), _double(rect.center(r)["y"]).alias("cy"))


def color_bar(spark, sf_dir):
    """The red bar of each gauge frame that shows one."""
    return regions.find_color_bar(_gauges(spark, sf_dir), WHOLE, RED, MIN_S, MIN_V)


def color_regions(spark, sf_dir):
    """All large red rectangles."""
    return regions.find_color_regions(_gauges(spark, sf_dir), WHOLE, RED, MIN_S, MIN_V)


def bar_fill(spark, sf_dir):
    """The reading of every gauge as a detection: found bar, learned groove, walked track; one pass over its frame."""
    at = F.lit(0).cast("long")
    read = packed.measure_bars(rasters.gauge_frames(_table(spark, sf_dir, "supplier")), WHOLE, RED, MIN_S, MIN_V)
    d = F.when(F.col("fill").isNotNull(), model.found(F.col("fill"), F.lit(0.9), "bar", at=at)).otherwise(model.missing("float", "bar", F.col("failure_reason"), at=at))
    read = read.select("frame_id", d.alias("d"))
    return read.select("frame_id", _double(F.col("d.value")).alias("fill"), _double(F.col("d.confidence")).alias("confidence"), F.col("d.source").alias("source"), F.col("d.reliability").alias("reliability"), F.col("d.failure_reason").alias("failure_reason"), model.is_present(F.col("d")).alias("is_present"))


def pixel_bar_fill(spark, sf_dir):
    """The fill of every gauge's bar by the column operators, for tables of pixels."""
    pixels = _gauges(spark, sf_dir)
    found = regions.find_color_bar(pixels, WHOLE, RED, MIN_S, MIN_V)
    wanted = found.withColumns({"sx": F.lit(0), "sw": F.lit(rasters.GAUGE_WIDTH), "width": F.lit(rasters.GAUGE_WIDTH), "height": F.lit(rasters.GAUGE_HEIGHT)})
    return bars.measure_bar_fill(pixels, wanted, color.color_pixel(RED, MIN_S, MIN_V)).select("frame_id", _double(F.col("fill")).alias("fill"), "failure_reason")


def text_block(spark, sf_dir):
    """The padded box of text-like pixels."""
    return regions.find_text_block(_gauges(spark, sf_dir), WHOLE)


def text_block_in_regions(spark, sf_dir):
    """The box of the first of three regions that has text-like pixels."""
    return regions.find_text_block_in_regions(_gauges(spark, sf_dir), [(0, 0, 96, 20), (0, 0, 40, 32), (40, 0, 56, 32)]).withColumn("region_no", F.col("region_no").cast("long"))


def dominant_bucket(spark, sf_dir):
    """The most frequent colour bucket of each frame's bar area."""
    found = regions.dominant_color_bucket(_gauges(spark, sf_dir), (8, 20, 64, 8), 10)
    return found.select("frame_id", *_longs(found, "bucket_r", "bucket_g", "bucket_b", "n"))


def uniform_panel(spark, sf_dir):
    """The largest rectangle in the frame's dominant colour."""
    pixels = _gauges(spark, sf_dir)
    return regions.find_uniform_color_panel(pixels, WHOLE, regions.dominant_color_bucket(pixels, WHOLE, 10), 10)


def blank_frame(spark, sf_dir):
    """Whether a frame shows one colour only, by sampled pixels; each gauge, and its empty top."""
    pixels = _gauges(spark, sf_dir)
    top = pixels.where("y < 16").withColumn("height", F.lit(16))
    both = pixels.withColumn("part", F.lit("whole")).unionByName(top.withColumn("part", F.lit("top")))
    return regions.is_blank(both, ("frame_id", "part"))


def text_quality(spark, sf_dir):
    """Sharpness of each gauge frame."""
    found = quality.assess_text_quality(_gauges(spark, sf_dir), WHOLE)
    return found.select("frame_id", _double(F.col("sharpness")).alias("sharpness"), "edge_samples", "legibility", quality.is_legible(F.col("legibility")).alias("is_legible"))


def _moving(spark, sf_dir):
    return rasters.motion_frames(_table(spark, sf_dir, "supplier"))


def motion_mask_stats(spark, sf_dir):
    """How much of each frame moved."""
    return packed.motion_of(_moving(spark, sf_dir)).select("stream_id", "frame_no", "status", "moved_pixels", _double(F.col("changed_fraction"), 6).alias("changed_fraction"))


def motion_blobs(spark, sf_dir):
    """Moved rectangles of each frame."""
    return packed.motion_of(_moving(spark, sf_dir)).select("stream_id", "frame_no", F.inline("rects"))


def pixel_motion_blobs(spark, sf_dir):
    """Moved rectangles of each frame by the column operators, for tables of pixels."""
    found = motion.extract_blobs(motion.motion_mask(rasters.motion_sequences(_table(spark, sf_dir, "supplier"))))
    return found.select("stream_id", F.col("frame_no").cast("long").alias("frame_no"), "x", "y", "w", "h")


def motion_detect(spark, sf_dir):
    """Motion detections of each frame, with tracked identities, the boxes and velocities of the first and last blob."""
    found = packed.detect_motion_frames(_moving(spark, sf_dir))
    first, last = F.get("blobs", 0), F.get("blobs", F.size("blobs") - 1)
    box = [blob["bounds"][c].alias(f"{name}_{c}") for name, blob in (("first", first), ("last", last)) for c in "xywh"]
    speed = [_double(blob["velocity"]["x"]).alias(f"{name}_vx") for name, blob in (("first", first), ("last", last))]
    return found.select(
        "stream_id", "frame_no", F.size("blobs").cast("long").alias("n_blobs"), first["id"].alias("first_id"), last["id"].alias("last_id"), *box, *speed, first["is_predicted"].alias("first_predicted"), first["age_frames"].alias("first_age"),
        _double(F.col("confidence")).alias("confidence"), "source", "reliability", "failure_reason", F.col("tracked_blobs").cast("long").alias("tracked_blobs"), _double(F.col("changed_fraction"), 6).alias("changed_fraction"),
    )


def tracks(spark, sf_dir):
    """Tracks of the events taken as detections, after each frame."""
    found = tracking.track_objects(rasters.event_detections(_table(spark, sf_dir, "events")))
    t = F.col("track")
    return found.select("stream_id", "frame_no", t["id"].alias("track_id"), _double(t["position"]["x"]).alias("x"), _double(t["position"]["y"]).alias("y"), t["age_frames"].alias("age_frames"), t["missed_frames"].alias("missed_frames"), tracking.is_predicted(t).alias("is_predicted"), _double(t["confidence"]).alias("confidence"))


def normalize_text(spark, sf_dir):
    """Every turn's text on one line."""
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", text.normalize_text(F.concat(F.lit(" ‘a’–\r\n\n\t"), F.col("text"), F.lit(" b  "))).alias("line"))


def ocr_tsv_words(spark, sf_dir):
    """The words of recogniser lines that can be used."""
    words = rasters.tsv_lines(_table(spark, sf_dir, "lineitem")).select("l_orderkey", "l_linenumber", F.inline(F.array_compact(F.array(text.tsv_word(F.col("line"))))))
    return words


def text_width(spark, sf_dir):
    """Pixel widths and heights of part names at three scales."""
    sizes = [c for s in (1, 2, 3) for c in (glyphs.text_width(F.col("p_name"), s).alias(f"width_{s}"), F.lit(glyphs.text_height(s)).cast("long").alias(f"height_{s}"))]
    return _table(spark, sf_dir, "part").select("p_partkey", *sizes)


def glyph_pixels(spark, sf_dir):
    """How many pixels each part name plots, and their extent."""
    drawn = glyphs.plotted_pixels(_table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", F.lit(3), F.lit(5), 2)
    return drawn.groupBy("p_partkey").agg(F.count(F.lit(1)).alias("n"), F.min("px").alias("px0"), F.max("px").alias("px1"), F.min("py").alias("py0"), F.max("py").alias("py1"))


def overlay_rect(spark, sf_dir):
    """Gauge frames with an outline drawn over them: changed pixels and the sum of red."""
    key = F.col("s_suppkey")
    rects = _table(spark, sf_dir, "supplier").select(key.alias("frame_id"), (key % 90).alias("x"), (key % 30).alias("y"), F.lit(10).alias("w"), F.lit(6).alias("h"), F.lit(rasters.GAUGE_WIDTH).alias("width"), F.lit(rasters.GAUGE_HEIGHT).alias("height"))
    drawn = drawing.overlay(_gauges(spark, sf_dir), drawing.outline(rects, 1), (1, 2, 3, 255))
    return drawn.groupBy("frame_id").agg(F.count_if((F.col("r") == 1) & (F.col("g") == 2)).alias("n_drawn"), F.count(F.lit(1)).alias("n"))


def moving_average(spark, sf_dir):
    """Moving average of each user's values over five events."""
    over = Window.partitionBy("user_id").orderBy("event_id")
    return _table(spark, sf_dir, "events").select("event_id", F.round(timing.moving_average(F.col("value"), 5, over), 6).alias("average"))


def fps(spark, sf_dir):
    """Frames per second if each event's value were a frame time in milliseconds."""
    over = Window.partitionBy("user_id").orderBy("event_id")
    return _table(spark, sf_dir, "events").select("event_id", F.round(timing.fps(F.col("value") / 1000, 4, over), 4).alias("fps"))


QUERIES = {
    f.__name__: f
    for f in (
        confidence_fold, hsv_convert, pixel_tests, color_pixel_count, text_pixel_count, row_runs, region_rects, color_bar, color_regions, bar_fill, pixel_bar_fill, text_block, text_block_in_regions,
        dominant_bucket, uniform_panel, blank_frame, text_quality, motion_mask_stats, motion_blobs, pixel_motion_blobs, motion_detect, tracks, normalize_text, ocr_tsv_words, text_width, glyph_pixels,
        overlay_rect, moving_average, fps, *MORE,
    )
}
