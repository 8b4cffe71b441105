import numpy as np
import pytest
from pyspark.sql import functions as F
from vistalake.operators import motion, ocr, tracking
from vistalake.sources import frames as sources
from vistalake.streaming.motion_stream import detect_motion_stream, track_objects_stream

import rasters as R


def square(x, y=30, size=10, frame=(80, 80)):
    return R.box(R.frame(*frame, (20, 20, 20)), x, y, size, size, (230, 230, 230))


def detections(spark, **streams):
    rows = motion.detect_motion(R.streams(spark, **streams)).orderBy("stream_id", "frame_no").collect()
    out = {}
    for r in rows:
        out.setdefault(r.stream_id, []).append(r)
    return out


def test_motion_detector(spark):
    got = detections(
        spark, moves=[square(10), square(20), square(30)], stops=[square(10), square(25), square(25)], still=[square(10), square(10)], resized=[R.frame(64, 64, (0, 0, 0)), R.frame(32, 32, (0, 0, 0))]
    )
    a, b, c = got["moves"]
    assert a.blobs is None and a.failure_reason == motion.WARMING_UP and a.reliability == "Unreliable" and a.changed_fraction == 0
    assert [tuple(x.bounds) for x in b.blobs] == [(10, 30, 20, 10)] and b.confidence == pytest.approx(0.3) and b.blobs[0].id == 1
    assert [tuple(x.bounds) for x in c.blobs] == [(20, 30, 20, 10)] and c.blobs[0].velocity.x == 10 and c.confidence == pytest.approx(0.542275) and c.blobs[0].id == 1
    _, b, c = got["stops"]
    assert len(b.blobs) == 2 and b.reliability == "Heuristic"
    assert all(x.is_predicted for x in c.blobs) and c.confidence == pytest.approx(0.18) and c.reliability == "Predicted"
    assert got["still"][1].blobs == [] and got["still"][1].confidence == pytest.approx(0.6) and got["still"][1].failure_reason == motion.STILL
    assert got["resized"][1].failure_reason == motion.RESIZED and got["resized"][1].blobs is None


def test_ids_stay_and_corroborate(spark):
    rows = detections(spark, s=[R.box(R.frame(200, 60, (28, 30, 34)), x, 10, 40, 40, (230, 230, 230)) for x in (100, 115, 130, 145, 160)])["s"]
    assert all(sorted(b.id for b in r.blobs) == [1, 2] for r in rows[1:])
    assert [r.confidence for r in rows[1:]] == pytest.approx([0.3, 0.542275, 0.698966, 0.800307], abs=1e-5)
    assert [r.reliability for r in rows[1:]] == ["Heuristic"] * 3 + ["Corroborated"]


def test_mask_at_the_threshold(spark):
    # A grey step of exactly 28 counts, as single precision has it.
    px = R.streams(spark, s=[R.frame(4, 4, (100, 100, 100)), R.frame(4, 4, (128, 128, 128)), R.frame(4, 4, (155, 155, 155))])
    stats = motion.motion_stats(px).orderBy("frame_no").collect()
    assert [r.moved_pixels for r in stats] == [0, 16, 0]
    before, now = R.frame(4, 4, (100, 100, 100)), R.frame(4, 4, (128, 128, 128))
    assert motion.packed_mask(before, now, 28).all()


def tracker_frames(max_distance, grace, frames):
    t = tracking.Tracker(max_distance, grace)
    out = []
    for f in frames:
        t.update(f)
        out.append([(x["id"], x["missed"] > 0) for x in t.rows()])
    return out


def test_tracker():
    assert tracker_frames(15, 3, [[(10, 10, 4, 4)], [(12, 11, 4, 4)]]) == [[(1, False)], [(1, False)]]
    assert tracker_frames(15, 2, [[(10, 10, 4, 4)], [], [(11, 10, 4, 4)]]) == [[(1, False)], [(1, True)], [(1, False)]]
    assert tracker_frames(15, 1, [[(10, 10, 4, 4)], [], []]) == [[(1, False)], [(1, True)], []]
    assert tracker_frames(5, 1, [[(0, 0, 1, 1)], [(5, 0, 1, 1)], [(99, 0, 1, 1)]])[1] == [(1, False)]  # inclusive
    assert tracker_frames(15, 3, [[(0, 0, 1, 1)], [(3, 0, 1, 1), (-3, 0, 1, 1)]])[1] == [(1, False), (2, False)]  # first of equals


def test_tracker_state_round_trip():
    a = tracking.Tracker(20, 2)
    a.update([(1.3, 2.7, 4, 4), (30, 30, 2, 2)])
    a.update([(2.1, 2.9, 4, 4)])
    b = tracking.Tracker.from_json(a.to_json(), 20, 2)
    a.update([(2.9, 3.1, 4, 4)])
    b.update([(2.9, 3.1, 4, 4)])
    assert a.rows() == b.rows() and len(a) == 2


def test_tracks_over_dataframe(spark):
    rows = [("s", 0, 0, 10.0, 10.0, 4.0, 4.0), ("s", 1, 0, None, None, None, None), ("s", 2, 0, 11.0, 10.0, 4.0, 4.0), ("t", 0, 0, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "stream_id string, frame_no long, ord long, cx float, cy float, w float, h float")
    got = [(r.stream_id, r.frame_no, r.track.id, r.track.missed_frames) for r in tracking.track_objects(df, 15, 2).orderBy("stream_id", "frame_no").collect()]
    assert got == [("s", 0, 1, 0), ("s", 1, 1, 1), ("s", 2, 1, 0), ("t", 0, 1, 0)]


def packed(spark, images, stream="s"):
    rows = [(stream, i, m.shape[1], m.shape[0], bytearray(m.tobytes())) for i, m in enumerate(images)]
    return spark.createDataFrame(rows, "stream_id string, frame_no long, width int, height int, data binary")


def run_stream(spark, make, batches, schema, tmp_path, name):
    source = str(tmp_path / "in")
    stream = make(spark.readStream.schema(schema).parquet(source)).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        for b in batches:
            b.coalesce(1).write.mode("append").parquet(source)
            stream.processAllAvailable()
    finally:
        stream.stop()
    return spark.table(name)


def test_streaming_motion_equals_batch(spark, tmp_path):
    images = [square(10), square(20), square(30), square(30), R.frame(40, 40, (0, 0, 0))]
    whole = packed(spark, images)
    (tmp_path / "in").mkdir()
    parts = [whole.where("frame_no < 2"), whole.where("frame_no BETWEEN 1 AND 2"), whole.where("frame_no > 2")]  # frame 1 comes twice
    got = run_stream(spark, detect_motion_stream, parts, whole.schema, tmp_path, "motion_out").orderBy("frame_no").collect()
    want = detections(spark, s=images)["s"]
    assert [(r.frame_no, r.reliability, r.failure_reason, r.blobs) for r in got] == [(r.frame_no, r.reliability, r.failure_reason, r.blobs) for r in want]
    assert [r.confidence for r in got] == pytest.approx([r.confidence for r in want])


def test_streaming_tracks(spark, tmp_path):
    df = spark.createDataFrame([("s", i, 0, 10.0 + i, 10.0, 4.0, 4.0) for i in range(3)], "stream_id string, frame_no long, ord long, cx float, cy float, w float, h float")
    (tmp_path / "in").mkdir()
    got = run_stream(spark, track_objects_stream, [df.where("frame_no < 1"), df.where("frame_no >= 1")], df.schema, tmp_path, "tracks_out").orderBy("frame_no").collect()
    assert [(r.frame_no, r.track.id, r.track.age_frames) for r in got] == [(0, 1, 1), (1, 1, 2), (2, 1, 3)]


def test_ocr_arguments_and_cleanup(tmp_path):
    args = ocr.tesseract_args("x.png", ocr.OcrConfig(11, "0123456789"))
    assert args[:2] == ["x.png", "stdout"] and args[-1] == "tsv" and "tessedit_char_whitelist=0123456789" in args and args.index("--psm") < args.index("tsv")
    with ocr.temp_image(b"x") as path:
        assert open(path, "rb").read() == b"x"
    assert not __import__("os").path.exists(path)
    assert [ocr.upscale_factor(h) for h in (0, 1, 10, 24, 47, 48)] == [1, 8, 5, 2, 2, 1]
    assert ocr.preprocess(square(10)[:20]).shape == (60, 240) and ocr.crop(square(1), 70, 70, 50, 50).shape == (10, 10, 4) and ocr.crop(square(1), 80, 0, 5, 5) is None


def test_ocr_region_with_and_without_an_engine(spark):
    df = packed(spark, [square(10)]).withColumnRenamed("stream_id", "frame_id")
    assert ocr.ocr_region(df, (0, 0, 20, 10), engine=lambda image, config: None).first().ocr is None
    tsv = "head\n5\t1\t1\t1\t1\t1\t3\t4\t5\t6\t90\tHi\n5\t1\t1\t1\t1\t2\t9\t4\t5\t6\t90\tyou’re"
    row = ocr.ocr_region(df, (0, 0, 20, 10), engine=lambda image, config: tsv).first()
    assert row.ocr.text == "Hi you're" and row.ocr.available and [w.x for w in row.ocr.words] == [3, 9] and row.ocr_scale == 5
    assert not ocr.native_engine_available() and ocr.recognize_native(square(1)) is None
    assert (ocr.swizzle(np.array([[[1, 2, 3, 9]]], dtype=np.uint8)) == [[[3, 2, 1, 255]]]).all()


def test_image_source_and_pixels(spark, tmp_path):
    grey = np.arange(12, dtype=np.uint8).reshape(3, 4) * 10
    (tmp_path / "a.png").write_bytes(ocr.png(grey))
    frames = sources.read_images(spark, str(tmp_path))
    px = sources.to_pixels(frames).orderBy("y", "x").collect()
    assert [(r.r, r.g, r.b, r.a) for r in px] == [(v, v, v, 255) for v in grey.ravel().tolist()]
    assert sources.to_pixels(frames, (1, 1, 2, 1)).count() == 2
    sources.write_pixels(sources.to_pixels(frames), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 12


def test_windows_are_absent_here(spark):
    assert sources.list_windows(spark).count() == 0 and sources.capture_window(spark, "x").count() == 0
    df = spark.createDataFrame([("My App",), ("other",), ("",)], "t string")
    assert [r.t for r in df.where(sources.title_matches(F.col("t"), "my a")).collect()] == ["My App"]
