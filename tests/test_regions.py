import numpy as np
import pytest
from pyspark.sql import functions as F
from vistalake.functions.arrays import color_mask
from vistalake.functions.color import color_pixel
from vistalake.operators import bars, drawing, packed, quality, regions, runs
from vistalake.operators.motion import fold_runs
from vistalake.sources import rasters

import rasters as R

RED = color_pixel((340, 30), 0.35, 0.3)


def bar(x=100, w=200, ratio=0.5, rows=(14, 8), size=(400, 40), groove=(16, 16, 16), fill=(230, 30, 30), back=(120, 180, 90)):
    image = R.box(R.frame(*size, back), x, rows[0], w, rows[1], groove)
    return R.box(image, x, rows[0], int(w * ratio), rows[1], fill)


def read(spark, images, predicate=RED, fills=None):
    px = R.pixels(spark, *images)
    h, w = images[0].shape[:2]
    found = regions.find_horizontal_region(px, (0, 0, w, h), 4, 2, predicate) if fills is None else spark.createDataFrame(fills, "frame_id long, x long, y long, w long, h long")
    wanted = found.withColumns({"sx": F.lit(0), "sw": F.lit(w), "width": F.lit(w), "height": F.lit(h)})
    return {r.frame_id: (r.fill, r.failure_reason) for r in bars.measure_bar_fill(px, wanted, predicate).collect()}


def test_bar_fill_ratios_positions_and_edges(spark):
    shapes = [bar(ratio=0.25), bar(ratio=0.5), bar(ratio=0.75), bar(ratio=1), bar(20, 80), bar(150, 240), bar(0, 120), bar(280, 120)]
    got = read(spark, shapes)
    assert [got[i][0] for i in range(len(shapes))] == pytest.approx([25, 50, 75, 100, 50, 50, 50, 50])


def test_bar_fill_with_a_light_groove(spark):
    yellow = color_pixel((40, 80), 0.25, 0.25)
    assert read(spark, [bar(ratio=0.375, groove=(210, 210, 210), fill=(225, 225, 40), back=(25, 25, 28))], yellow)[0][0] == pytest.approx(37.5)


def test_bar_fill_gives_reasons(spark):
    plain = R.frame(120, 30, (120, 180, 90))
    got = read(spark, [plain, plain, plain], fills=[(0, 40, 10, 10, 6), (1, 40, 10, 0, 6), (2, 40, 30, 5, 5)])
    assert got == {0: (None, "no track found"), 1: (None, "bar has no usable area"), 2: (None, "bar has no usable area")}


def test_bar_with_a_groove_like_its_surroundings_reads_full(spark):
    image = R.box(R.box(R.frame(300, 40, (30, 30, 35)), 40, 14, 220, 10, (16, 16, 16)), 40, 14, 132, 10, (210, 40, 40))
    assert read(spark, [image])[0][0] == 100


def test_bar_fill_never_broadcasts_drawn_pixels(spark):
    rows = spark.createDataFrame([(i, 300.0 * i) for i in range(30)], "s_suppkey long, s_acctbal double")
    px = rasters.gauges(rows)
    wanted = regions.find_color_bar(px, (0, 0, 96, 32), (340, 30), 0.35, 0.3).withColumns({"sx": F.lit(0), "sw": F.lit(96), "width": F.lit(96), "height": F.lit(32)})
    got = bars.measure_bar_fill(px, wanted, RED)
    assert got.where("fill IS NOT NULL").count() == wanted.count() > 0
    assert got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # Once to find the bars and once to measure them.
    assert "Broadcast" not in plan and plan.count("Generate inline") == 2


def test_bar_fill_learns_the_upper_median(spark):
    # An even number of samples behind the fill, half of each colour: the higher one is the groove.
    image = bar(x=20, w=60, size=(120, 40), groove=(16, 16, 16))
    image[14:22, 50:80, :3] = 16
    image[14:22, 50:80:2, :3] = 90
    want = packed.bar_fill(image, (20, 14, 30, 8), (0, 120), color_mask((340, 30), 0.35, 0.3))
    assert read(spark, [image], fills=[(0, 20, 14, 30, 8)])[0] == want


def test_bar_without_pixels_has_a_reason(spark):
    got = read(spark, [bar()], fills=[(0, 100, 14, 100, 8), (7, 100, 14, 100, 8), (8, 100, 14, 0, 8)])
    assert got == {0: (50, None), 7: (None, "no track found"), 8: (None, "bar has no usable area")}


def test_row_runs(spark):
    image = R.box(R.frame(40, 4, (0, 0, 0)), 5, 1, 15, 1, (230, 20, 20))
    R.box(image, 25, 1, 4, 1, (230, 20, 20))
    assert [tuple(r) for r in runs.row_runs(R.pixels(spark, image), RED, 10, (0, 0, 40, 4)).collect()] == [(0, 1, 5, 19)]


def rows(*spans):
    return sorted(spans)


@pytest.mark.parametrize(
    "given,min_height,gap,want",
    [
        ([(y, a, b) for y in range(10, 20) for a, b in ((5, 24), (40, 59))], 4, 1, [[5, 10, 20, 10], [40, 10, 20, 10]]),
        ([(y, 10, 39) for y in (0, 1, 2, 3, 5, 6, 7)] + [(4, 10, 23), (4, 26, 39)], 4, 1, [[10, 0, 30, 8]]),
        ([(0, 10, 29), (1, 5, 20)], 1, 1, [[5, 0, 20, 2]]),  # the right edge follows the left one
        ([(0, 0, 9), (0, 30, 39), (1, 30, 39), (2, 0, 9), (2, 30, 39)], 1, 2, [[0, 0, 10, 1], [0, 2, 10, 1], [30, 0, 10, 3]]),
        ([(0, 0, 9), (3, 0, 9)], 1, 2, [[0, 0, 10, 4]]),
        ([(0, 0, 9), (4, 0, 9)], 1, 2, [[0, 0, 10, 1], [0, 4, 10, 1]]),
        ([(0, 0, 9), (1, 0, 40)], 1, 1, [[0, 0, 10, 1], [0, 1, 41, 1]]),  # less than a third is shared
        ([], 1, 1, []),
    ],
)
def test_grouping(spark, given, min_height, gap, want):
    given = sorted(given)
    folded = fold_runs(given, min_height, gap)
    assert sorted(folded) == sorted(want)
    df = spark.createDataFrame([(7, *g) for g in given], "frame_id long, y long, x0 long, x1 long")
    got = runs.group_runs(df, min_height, gap).orderBy("ord").collect()
    assert [[r.x, r.y, r.w, r.h] for r in got] == folded and [r.ord for r in got] == list(range(len(folded)))


def test_largest_takes_the_last_of_equals(spark):
    df = spark.createDataFrame([(1, 0, 0, 0, 4, 4), (1, 1, 9, 9, 4, 4), (1, 2, 20, 0, 2, 2)], "frame_id long, ord long, x long, y long, w long, h long")
    assert tuple(regions.largest(df).first())[1:] == (9, 9, 4, 4)


def screen(ratio):
    image = R.frame(200, 100, (28, 30, 34))
    R.box(image, 20, 70, 150, 10, (70, 70, 78))
    R.box(image, 20, 70, int(150 * ratio), 10, (210, 40, 40))
    return R.box(image, 100, 20, 40, 20, (230, 230, 230))


def test_color_bar_regions_and_text_block(spark):
    px = R.pixels(spark, screen(0.4), screen(0.75))
    assert sorted(tuple(r) for r in regions.find_color_bar(px, (0, 60, 200, 40), (340, 30), 0.35, 0.3).collect()) == [(0, 20, 70, 60, 10), (1, 20, 70, 112, 10)]
    assert regions.find_color_regions(px, (0, 0, 200, 100), (340, 30), 0.35, 0.3).count() == 2
    assert tuple(regions.find_text_block(px, (0, 0, 200, 60)).orderBy("frame_id").first()) == (0, 98, 18, 44, 24)
    assert tuple(regions.find_text_block_in_regions(px, [(0, 0, 50, 50), (90, 0, 80, 30), (0, 0, 200, 100)]).orderBy("frame_id").first()) == (0, 1, 98, 18, 44, 14)
    assert regions.find_text_block(px, (0, 0, 50, 20)).count() == 0


def test_text_block_padding_saturates_at_zero(spark):
    px = R.pixels(spark, R.box(R.frame(20, 20, (0, 0, 0)), 0, 0, 4, 4, (230, 230, 230)))
    assert tuple(regions.find_text_block(px, (0, 0, 20, 20)).first())[1:] == (0, 0, 8, 8)


def test_dominant_bucket_and_panel(spark):
    image = R.box(R.frame(80, 60, (30, 30, 35)), 5, 5, 70, 50, (70, 74, 80))
    px = R.pixels(spark, image)
    found = regions.dominant_color_bucket(px, (0, 0, 80, 60), 10)
    assert tuple(found.first()) == (0, 7, 7, 8, 3500)
    assert tuple(regions.find_uniform_color_panel(px, (0, 0, 80, 60), found, 10).first())[1:] == (5, 5, 70, 50)
    tie = np.concatenate([R.frame(4, 2, (200, 0, 0)), R.frame(4, 2, (10, 0, 0))])
    assert tuple(regions.dominant_color_bucket(R.pixels(spark, tie), (0, 0, 4, 4), 10).first())[1:4] == (1, 0, 0)
    with pytest.raises(ValueError):
        regions.dominant_color_bucket(px, (0, 0, 8, 8), 0)


def test_blank_frames(spark):
    got = regions.is_blank(R.pixels(spark, R.frame(40, 30, (9, 9, 9)), R.box(R.frame(40, 30, (9, 9, 9)), 3, 3, 20, 20, (9, 9, 10)))).collect()
    assert {r.frame_id: r.is_blank for r in got} == {0: True, 1: False}


def test_text_quality(spark):
    stripes, ramp = R.frame(80, 20, (10, 10, 10)), R.frame(80, 20, (10, 10, 10))
    for x in range(80):
        if x // 3 % 2:
            stripes[4:16, x, :3] = 240
        ramp[4:16, x, :3] = (40, 85, 130, 175, 220, 175, 130, 85)[x % 8]
    flat = R.frame(60, 20, (30, 30, 30))
    got = {r.frame_id: r for r in quality.assess_text_quality(R.pixels(spark, stripes, ramp, flat), (0, 0, 500, 500)).collect()}
    assert (got[0].sharpness, got[0].edge_samples, got[0].legibility) == (1.0, 312, "Sharp")
    assert (got[1].sharpness, got[1].edge_samples, got[1].legibility) == (0.0, 948, "Blurred")
    assert (got[2].sharpness, got[2].legibility) == (0.0, "NoText")


def outline_of(spark, x, y, w, h, width, height, thickness):
    df = spark.createDataFrame([(0, x, y, w, h, width, height)], "frame_id long, x long, y long, w long, h long, width long, height long")
    return {(r.x, r.y) for r in drawing.outline(df, thickness).collect()}


def drawn(x, y, w, h, width, height, thickness):
    out = set()
    for t in range(thickness):
        top, bottom = y + t, max(y + max(h - 1, 0) - t, 0)
        left, right = x + t, max(x + max(w - 1, 0) - t, 0)
        out |= {(px, v) for px in range(x, min(x + w, width)) for v in (top, bottom) if v < height}
        out |= {(v, py) for py in range(y, min(y + h, height)) for v in (left, right) if v < width}
    return out


@pytest.mark.parametrize("case", [(15, 15, 10, 10, 20, 20, 1), (2, 2, 5, 5, 20, 20, 1), (2, 2, 9, 9, 20, 20, 3), (3, 3, 4, 0, 20, 20, 1), (1, 1, 3, 3, 20, 20, 0), (0, 0, 2, 2, 20, 20, 3)])
def test_outline(spark, case):
    assert outline_of(spark, *case) == drawn(*case)


def test_overlay(spark):
    px = R.pixels(spark, R.frame(20, 20, (0, 0, 0)))
    marks = spark.createDataFrame([(0, 2, 2), (0, 2, 2), (0, 99, 2)], "frame_id long, x long, y long")
    out = drawing.overlay(px, marks, (255, 0, 0, 255))
    assert out.count() == 400 and [(r.x, r.y) for r in out.where("r = 255").collect()] == [(2, 2)] and out.columns == px.columns
