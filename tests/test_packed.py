"""Packed-frame operators against the column operators on random frames, and against known frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from vistalake import model
from vistalake.functions import color
from vistalake.functions.arrays import color_mask, hsv_arrays
from vistalake.operators import bars, motion, ocr, packed, quality, regions
from vistalake.sources import frames as sources

import rasters as R

RED = ((340.0, 30.0), 0.35, 0.30)


def packed_rows(spark, images):
    rows = [(i, m.shape[1], m.shape[0], bytearray(m.tobytes())) for i, m in enumerate(images)]
    return spark.createDataFrame(rows, "frame_id long, width int, height int, data binary")


def noisy(rng, width=60, height=24):
    """Blocks of a few colours, some of them see-through: runs that split, merge, have gaps and tie."""
    colours = np.array([(230, 30, 30, 255), (230, 30, 30, 100), (16, 16, 16, 255), (120, 180, 90, 255), (225, 60, 20, 255)], dtype=np.uint8)
    image = colours[rng.integers(0, 5, (height // 2, width // 6))].repeat(2, 0).repeat(6, 1)
    image[4:8, 5:40] = colours[0]
    return np.ascontiguousarray(image)


def rows_of(df, *columns):
    return sorted(tuple(None if v is None else round(v, 4) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect())


def test_hsv_of_arrays_equals_columns(spark):
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (1, 400, 4), dtype=np.uint8)
    image[0, :20, 1:3] = image[0, :20, :1]  # greys
    h, s, v = hsv_arrays(image)
    rows = spark.createDataFrame([(i, *map(int, p[:3])) for i, p in enumerate(image[0])], "i int, r int, g int, b int").select("i", color.hsv(F.col("r"), F.col("g"), F.col("b")).alias("c")).orderBy("i").collect()
    assert np.allclose([tuple(r.c) for r in rows], np.stack([h[0], s[0], v[0]], 1), atol=1e-6)


def test_packed_operators_equal_column_operators(spark):
    rng = np.random.default_rng(5)
    images = [noisy(rng) for _ in range(12)]
    px, frames = R.pixels(spark, *images), packed_rows(spark, images)
    whole, xywh = (0, 0, 60, 24), ("frame_id", "x", "y", "w", "h")
    for region in (whole, (6, 3, 40, 15)):
        found = regions.find_color_bar(px, region, *RED)
        assert rows_of(packed.find_color_bars(frames, region, *RED), *xywh) == rows_of(found, *xywh)
        buckets = regions.dominant_color_bucket(px, region, 10)
        names = ("frame_id", "bucket_r", "bucket_g", "bucket_b", "n")
        assert rows_of(packed.dominant_buckets(frames, region, 10), *names) == rows_of(buckets, *names)
        assert rows_of(packed.uniform_panels(frames, region, 10), *xywh) == rows_of(regions.find_uniform_color_panel(px, region, buckets, 10), *xywh)
        names = ("frame_id", "sharpness", "edge_samples", "legibility")
        assert rows_of(packed.assess_frames(frames, region), *names) == rows_of(quality.assess_text_quality(px, region), *names)
    found = regions.find_color_bar(px, whole, *RED)
    wanted = found.withColumns({"sx": F.lit(0), "sw": F.lit(60), "width": F.lit(60), "height": F.lit(24)})
    got = packed.measure_bars(frames, whole, *RED).where("failure_reason IS NULL OR failure_reason <> 'no bar found'")
    assert rows_of(got, "frame_id", "fill", "failure_reason") == rows_of(bars.measure_bar_fill(px, wanted, color.color_pixel(*RED)), "frame_id", "fill", "failure_reason")


def test_packed_motion_equals_column_motion(spark):
    rng = np.random.default_rng(6)
    images = {k: [noisy(rng) for _ in range(4)] + [noisy(rng, 48)] for k in ("a", "b")}
    rows = [(k, i, m.shape[1], m.shape[0], bytearray(m.tobytes())) for k, some in images.items() for i, m in enumerate(some)]
    frames = spark.createDataFrame(rows, "stream_id string, frame_no long, width int, height int, data binary")
    px = R.streams(spark, **images)
    shown = lambda df: [(r.stream_id, r.frame_no, r.blobs, round(r.confidence, 5), r.reliability, r.failure_reason, round(r.changed_fraction, 5), r.tracked_blobs) for r in df.orderBy("stream_id", "frame_no").collect()]
    assert shown(packed.detect_motion_frames(frames)) == shown(motion.detect_motion(px))
    names = ("stream_id", "frame_no", "status", "moved_pixels", "changed_fraction")
    assert rows_of(packed.motion_of(frames), *names) == rows_of(motion.motion_stats(px), *names)


@pytest.mark.parametrize(("x", "ratio"), [(100, 0.25), (100, 0.5), (20, 0.75), (150, 1.0)])
def test_bar_fill_of_known_bars(x, ratio):
    image = R.frame(400, 40, (120, 180, 90))
    R.box(image, x, 14, 200, 8, (16, 16, 16))
    R.box(image, x, 14, int(200 * ratio), 8, (230, 30, 30))
    test = color_mask(*RED)
    bar = packed.color_bar(image, (0, 0, 400, 40), test)
    assert packed.bar_fill(image, bar, (0, 400), test) == (100 * ratio, None)


def test_bar_fill_without_a_track():
    image = R.box(R.frame(120, 30, (120, 180, 90)), 40, 10, 10, 6, (10, 10, 10))
    test = color_mask(*RED)
    assert packed.bar_fill(image, (40, 10, 10, 6), (0, 120), test) == (None, "no track found")
    assert packed.bar_fill(image, (40, 40, 10, 6), (0, 120), test)[1] == packed.bar_fill(image, (5, 5, 4, 4), (10, 50), test)[1] == "bar has no usable area"


def test_each_query_reads_its_source_once(spark):
    frames = packed_rows(spark, [R.frame(20, 10, (0, 0, 0))])
    plan = packed.measure_bars(frames, (0, 0, 20, 10), *RED)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan
    stream = frames.selectExpr("frame_id AS stream_id", "frame_id AS frame_no", "width", "height", "data")
    plan = packed.detect_motion_frames(stream)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_command_columns_equal_the_list(spark):
    rows = [(3, None), (11, "0123456789"), (6, "")]
    got = spark.createDataFrame(rows, "psm int, allowed string").select(ocr.command(F.lit("x.png"), F.col("psm"), F.col("allowed")).alias("c")).collect()
    assert [r.c for r in got] == [ocr.tesseract_args("x.png", ocr.OcrConfig(p, w)) for p, w in rows]


def test_unreadable_images_have_a_reason(spark, tmp_path):
    (tmp_path / "bad.png").write_bytes(b"nothing")
    (tmp_path / "good.png").write_bytes(sources.png_rgba(np.array([[[1, 2, 3, 9], [4, 5, 6, 255]]], dtype=np.uint8)))
    rows = {r.frame_id.rsplit("/", 1)[1]: r for r in sources.read_images(spark, str(tmp_path)).collect()}
    assert rows["bad.png"].failure_reason == sources.UNREADABLE and rows["bad.png"].data is None
    assert bytes(rows["good.png"].data) == bytes([1, 2, 3, 9, 4, 5, 6, 255]) and rows["good.png"].failure_reason is None


def test_detections_as_references(spark):
    d = model.found(F.lit(2), F.lit(0.5), "t", at=F.lit(1))
    row = spark.range(1).select((model.as_ref(d) == d).alias("same"), F.greatest(d, model.found(F.lit(3), F.lit(0.1), "t", at=F.lit(1)))["value"].alias("top")).first()
    assert row.same and row.top == 3
