import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from vistalake import model
from vistalake.functions import color, confidence, glyphs, rect, text, timing


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_confidence(spark):
    r = one(
        spark, confidence.confidence(1.5), confidence.confidence(-0.2), confidence.combine(0.5, 0.5), confidence.combine(1, 0.3), confidence.combine(0, 0.3),
        confidence.decay(0.5, 2.0), confidence.is_confident(0.5, 0.5), confidence.percent_text(0.42), confidence.confidence(F.lit(float("nan"))),
        confidence.combine_all(F.array(F.lit(0.3), F.lit(0.35))),
    )
    assert r[:7] == pytest.approx((1, 0, 0.75, 1, 0.3, 0.5, True)) and r[7] == "42%" and math.isnan(r[8]) and r[9] == pytest.approx(0.545)


def test_detections(spark):
    found = model.found(F.lit(3), F.lit(2.0), "t", at=F.lit(5))
    missing = model.missing("int", "t", "too dark", at=F.lit(5))
    r = one(spark, found.alias("f"), missing.alias("m"), model.is_present(found), model.is_present(missing), model.map_value(found, lambda v: v * 2).alias("d"), model.map_value(missing, lambda v: v * 2).alias("n"))
    assert r.f.value == 3 and r.f.confidence == 1 and r.f.failure_reason is None and r.f.reliability == model.HEURISTIC
    assert r.m.value is None and r.m.confidence == 0 and r.m.reliability == model.UNRELIABLE and r.m.failure_reason == "too dark"
    assert r[2] and not r[3] and r.d.value == 6 and r.d.timestamp_ms == 5 and r.n.value is None


def test_empty_array_is_present(spark):
    assert one(spark, model.is_present(model.found(F.array().cast("array<int>"), F.lit(0.6), "t")))[0]


@pytest.mark.parametrize("rgb,want", [((255, 0, 0), (0, 1, 1)), ((0, 255, 0), (120, 1, 1)), ((0, 0, 255), (240, 1, 1)), ((255, 255, 0), (60, 1, 1)), ((128, 128, 128), (0, 0, 128 / 255)), ((0, 0, 0), (0, 0, 0))])
def test_hsv(spark, rgb, want):
    assert tuple(one(spark, color.hsv(*map(F.lit, rgb)))[0]) == pytest.approx(want, abs=1e-5)


def test_hue_ranges_and_alpha(spark):
    h = lambda v: F.lit(float(v)).cast("float")
    assert tuple(one(spark, *(color.hue_in_range(h(a), 340, 30) for a in (350, 10, 180)), color.hue_in_range(h(180), 100, 200))) == (True, True, False, True)
    red = color.color_pixel((340, 30), 0.35, 0.3)
    assert tuple(one(spark, *(red(F.lit(220), F.lit(20), F.lit(20), F.lit(a)) for a in (10, 127, 128, 255)))) == (False, False, True, True)
    assert tuple(one(spark, *(color.text_pixel(F.lit(v), F.lit(v), F.lit(v), F.lit(a)) for v, a in ((230, 255), (60, 255), (230, 114))))) == (True, False, False)


def test_rect(spark):
    r = rect.rect(5, 6, 10, 0)
    got = one(spark, rect.x2(r), rect.y2(r), rect.area(r), rect.center(r), rect.overlap(F.lit(0), F.lit(4), F.lit(3), F.lit(9)), rect.overlap(F.lit(0), F.lit(2), F.lit(3), F.lit(9)), rect.area(rect.rect(0, 0, 1 << 20, 1 << 20)))
    assert got[:3] == (14, 6, 0) and tuple(got[3]) == (10.0, 6.0) and got[4:] == (2, 0, 4294967295)


def test_normalize_text(spark):
    cases = {"  a\r\n\n b ": "a b", "‘x’ – y — z": "'x' - y - z", "": "", "   \n ": "", "a　\n　b": "a b"}
    rows = spark.createDataFrame(list(cases.items()), "t string, want string").select("want", text.normalize_text(F.col("t")).alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_tsv(spark):
    line = lambda *xs, word="w": "\t".join(["5", "1", "1", "1", "1", "1", *map(str, xs), "90", word])
    body = [line(1, 2, 3, 4), line(1, -2, 3, 4), line(1, "5.5", 3, 4), line(1, " 5", 3, 4), line("+7", 0, 4294967295, 4), line(1, 2, 4294967296, 4), line(1, 2, 3, 4, word="  "), "a\tb"]
    got = one(spark, text.tsv_words(F.lit("\n".join(["header", *body]))))[0]
    assert [tuple(w) for w in got] == [("w", 1, 2, 3, 4), ("w", 7, 0, 4294967295, 4)]


def test_moving_average_and_fps(spark):
    df = spark.createDataFrame([(i, 0.1) for i in range(3)], "i int, v double")
    over = Window.orderBy("i")
    got = df.select(timing.moving_average(F.col("v"), 3, over).alias("m"), timing.fps(F.col("v"), 3, over).alias("f")).collect()
    assert [r.m for r in got] == pytest.approx([0.1 / 3, 0.2 / 3, 0.1]) and got[2].f == pytest.approx(10)
    with pytest.raises(ValueError):
        timing.moving_average(F.col("v"), 0, over)


def test_glyphs(spark):
    texts = spark.createDataFrame([("",), ("A",), ("AB",), ("a",), (" ",), ("☃",), ("ı",), ("W",)], "t string").withColumn("k", F.col("t"))
    widths = {r.k: r.w for r in texts.select("k", glyphs.text_width(F.col("t"), 1).alias("w")).collect()}
    assert (widths[""], widths["A"], widths["AB"], widths["☃"]) == (0, 5, 11, 5)
    counts = lambda s: {r.k: r.n for r in glyphs.plotted_pixels(texts, "t", F.lit(0), F.lit(0), s).groupBy("k").agg(F.count("*").alias("n")).collect()}
    once, twice = counts(1), counts(2)
    assert " " not in once and "☃" not in once and "ı" not in once and once["A"] == once["a"] and twice["A"] == 4 * once["A"]
    w = glyphs.plotted_pixels(texts.where("t = 'W'"), "t", F.lit(-2), F.lit(3), 1).agg(F.min("px"), F.max("px"), F.min("py"), F.max("py")).first()
    assert w[0] >= -2 and w[1] <= 2 and w[2] >= 3 and w[3] <= 9
