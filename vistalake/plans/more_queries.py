"""Queries about detections, shapes of runs, tracks of known paths, text recognition and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistalake import model
from vistalake.functions import confidence, rect
from vistalake.operators import ocr, packed, runs, tracking
from vistalake.sources import frames as sources
from vistalake.sources import rasters


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _double(c, digits: int = 4):
    return F.round(c.cast("double"), digits)


def detection_report(spark, sf_dir):
    """Detections of label quality: percent text, mapped value, default time, and order by value."""
    d = F.when(F.col("quality") == 1, model.found(F.col("doc_id"), F.lit(0.3) + F.col("toxic") * 0.125, "labels")).otherwise(model.missing("long", "labels", "low quality"))
    rows = _table(spark, sf_dir, "labels").select("doc_id", d.alias("d"))
    doubled = model.map_value(F.col("d"), lambda v: v * 2)
    return rows.select(
        "doc_id", confidence.percent_text(F.col("d.confidence")).alias("percent"), doubled["value"].alias("doubled"), doubled["failure_reason"].alias("failure_reason"),
        (F.col("d.timestamp_ms") > 1_600_000_000_000).alias("is_recent"), model.as_ref(F.col("d"))["value"].eqNullSafe(F.col("d.value")).alias("same_value"),
        (F.col("d.confidence") > confidence.f32(0.35)).alias("over"),
    )


def interval_overlaps(spark, sf_dir):
    """How many whole numbers two intervals of each customer share."""
    k = F.col("c_custkey")
    return _table(spark, sf_dir, "customer").select("c_custkey", rect.overlap(k % 13, k % 13 + k % 7, k % 11, k % 11 + k % 5).alias("shared"))


#: Runs (pattern, y, x0, x1) whose rectangles are known: neighbours, a split, a merge, gaps of the whole frame.
SHAPES = [
    *(("neighbours", y, *x) for y in range(10, 20) for x in ((5, 24), (40, 59))),
    *(("split", y, 10, 39) for y in (0, 1, 2, 3, 5, 6, 7)), ("split", 4, 10, 23), ("split", 4, 26, 39),
    ("merge", 0, 10, 29), ("merge", 1, 5, 20),
    ("global gap", 0, 0, 9), ("global gap", 0, 30, 39), ("global gap", 1, 30, 39), ("global gap", 2, 0, 9), ("global gap", 2, 30, 39),
    ("bridged", 0, 0, 9), ("bridged", 3, 0, 9), ("parted", 0, 0, 9), ("parted", 4, 0, 9),
]
#: Least height and greatest gap that the patterns are grouped by.
GROUPED = {(4, 1): ("neighbours", "split"), (1, 1): ("merge",), (1, 2): ("global gap", "bridged", "parted")}


def run_shapes(spark, sf_dir):
    """Rectangles of runs that split, merge and have gaps, moved about for each supplier."""
    key = F.col("s_suppkey").cast("long")
    shapes = F.array(*(F.struct(F.lit(name).alias("pattern"), *(F.lit(v).cast("long").alias(c) for c, v in zip(("y", "x0", "x1"), run))) for name, *run in SHAPES))
    each = _table(spark, sf_dir, "supplier").select(key.alias("frame_id"), F.inline(shapes))
    moved = each.select("frame_id", "pattern", (F.col("y") + F.col("frame_id") % 5).alias("y"), *((F.col(c) + F.col("frame_id") % 7).alias(c) for c in ("x0", "x1")))
    parts = [runs.group_runs(moved.where(F.col("pattern").isin(*names)), height, gap, ("frame_id", "pattern")) for (height, gap), names in GROUPED.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def track_paths(spark, sf_dir):
    """Tracks of objects with known paths: steady, lost and found, lost for good, at equal distances, at the limit."""
    k = F.col("stream_id") % 5 + 1
    point = lambda t, ord_, x, y: F.struct(F.lit(t).cast("long").alias("frame_no"), F.lit(ord_).cast("long").alias("ord"), x.cast("float").alias("cx"), F.lit(y).cast("float").alias("cy"))
    steady = [point(t, 0, 10 + k * t, 20) for t in (0, 1, 2, 5, 6, 7)]
    at = lambda x: F.lit(x) + k * 0
    others = [point(0, 1, at(500), 100), point(1, 1, at(490), 100), point(1, 2, at(510), 100), point(2, 1, at(480), 100), point(2, 2, at(540), 100), point(1, 3, at(200), 52), point(2, 3, at(200), 54)]
    nobody = [point(t, 0, F.lit(None), 0) for t in (3, 4)]
    rows = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("stream_id"))
    seen = rows.select("stream_id", F.inline(F.array(*steady, *others, *nobody))).withColumns({"w": F.lit(6.0).cast("float"), "h": F.lit(4.0).cast("float")})
    t = F.col("track")
    return tracking.track_objects(seen, 30.0, 2).select(
        "stream_id", "frame_no", t["id"].alias("track_id"), *(_double(t[p][c]).alias(n) for p, c, n in (("position", "x", "x"), ("position", "y", "y"), ("velocity", "x", "vx"), ("velocity", "y", "vy"))),
        _double(t["width"]).alias("w"), _double(t["height"]).alias("h"), t["missed_frames"].alias("missed_frames"), t["age_frames"].alias("age_frames"), tracking.frame_index(t).alias("frame_index"), tracking.is_predicted(t).alias("is_predicted"), _double(t["confidence"]).alias("confidence"),
        _double(tracking.distance(t["position"], F.struct(F.lit(10.0).alias("x"), F.lit(20.0).alias("y")))).alias("from_start"),
    )


def ocr_commands(spark, sf_dir):
    """The recogniser's command line for each nation's settings."""
    key = F.col("n_nationkey")
    allowed = F.when(key % 3 != 0, F.concat(F.lit("0123456789"), F.substring("n_name", 1, 2)))
    return _table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(ocr.command(F.concat(F.lit("img"), key.cast("string"), F.lit(".png")), key % 14, allowed), " ").alias("command"))


def measuring_engine(image, config):
    """Stands in for a recogniser: what it gets is prepared, written as a PNG and read again; its words tell the size."""
    with ocr.temp_image(ocr.png(ocr.preprocess(image))) as path, open(path, "rb") as f:
        head = f.read(24)
    width, height = (int.from_bytes(head[k : k + 4], "big") for k in (16, 20))
    row = lambda n, text: "\t".join(["5", "1", "1", "1", "1", str(n), str(n), "2", str(width), str(height), "91", text])
    return "\n".join(["level\tand so on", row(3, f"w{width}"), row(4, "  "), row(5, f" h{height}–{config.psm} ")])


def ocr_readings(spark, sf_dir):
    """What a stand-in recogniser reads in two regions of each gauge, one of them outside the frame."""
    shown = rasters.gauge_frames(_table(spark, sf_dir, "supplier"))
    parts = [ocr.ocr_region(shown, region, engine=measuring_engine).withColumn("part", F.lit(name)) for name, region in (("track", (8, 20, 64, 8)), ("edge", (90, 10, 64, 40)), ("outside", (96, 0, 5, 5)))]
    word = F.get("ocr.words", F.size("ocr.words") - 1)
    own = F.get(ocr.scaled_words(F.col("ocr.words"), F.col("ocr_scale")), 0)
    columns = ["frame_id", "part", F.col("ocr.text").alias("text"), F.col("ocr.available").alias("available"), F.when(F.col("ocr").isNotNull(), F.size("ocr.words")).cast("long").alias("n_words"), *(word[c].alias(f"last_{c}") for c in "xywh"), own["w"].alias("own_w"), own["h"].alias("own_h")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select(*columns)


def ocr_engines(spark, sf_dir):
    """Which recognisers this machine has."""
    found = [("program", ocr.is_ocr_available()), ("system", ocr.native_engine_available()), ("system reads", ocr.recognize_native(rasters.gauge_image(0, 8)) is not None), ("system engine", ocr.native_engine() is not None)]
    return spark.createDataFrame(found, "engine string, available boolean")


def swizzled_pixels(spark, sf_dir):
    """A colour of each customer as a frame of one pixel in the system recogniser's channel order."""
    import numpy as np

    key = F.col("c_custkey").cast("long")
    rows = _table(spark, sf_dir, "customer").select(key.alias("frame_id"), *((key * k % 256).cast("int").alias(c) for c, k in zip("rgba", (7, 13, 29, 3))))
    shown = packed.packed_frames(rows, lambda *v: np.array([[v]], dtype=np.uint8), ["r", "g", "b", "a"], ["frame_id"])
    return packed.per_frame(shown, lambda image: [tuple(ocr.swizzle(image)[0, 0].tolist())], "c0 long, c1 long, c2 long, c3 long")


def windows(spark, sf_dir):
    """Titles of the windows that could be captured: none where capture isn't possible."""
    captured = sources.capture_window(spark, "part").select("title")
    return sources.list_windows(spark).unionByName(captured)


def title_search(spark, sf_dir):
    """Part names that a search for a window's title would find."""
    names = _table(spark, sf_dir, "part").withColumn("title", F.initcap("p_name"))
    return names.select("p_partkey", *(sources.title_matches(F.col("title"), q).alias(f"has_{n}") for n, q in enumerate(("A", "re", "xyzzy", ""))))


def image_files(spark, sf_dir):
    """A PNG file for each nation, and one that can't be read, with what each shows."""
    nations = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("frame_id"), (F.col("n_nationkey") * 2).cast("int").alias("fill"))
    shown = packed.packed_frames(nations, rasters.gauge_image, ["frame_id", "fill"], ["frame_id"])
    path = sources.write_images(shown, [("broken", b"not an image")])
    found = sources.read_images(spark, path)
    name = F.regexp_extract("frame_id", r"([^/]+)\.png$", 1)
    good = packed.dominant_buckets(found.where("failure_reason IS NULL"), (8, 20, 64, 8), 10).select(F.col("frame_id").alias("f"), "bucket_r", "n")
    return found.join(good, F.col("frame_id") == F.col("f"), "left").select(name.alias("name"), "width", "height", "failure_reason", "bucket_r", "n")


MORE = (detection_report, interval_overlaps, run_shapes, track_paths, ocr_commands, ocr_readings, ocr_engines, swizzled_pixels, windows, title_search, image_files)
