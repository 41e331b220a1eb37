"""Rasters in blocks against the same operators on pixels and against plain arrays."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orograph.operators import blocks, resample, surface

SIZES = [(1, 37, 23), (2, 5, 64), (3, 1, 1), (4, 40, 1)]


@pytest.fixture(scope="module")
def rasters(spark):
    """Pixel tables of several sizes; raster 2 has holes."""
    rng = random.Random(3)
    rows = [(k, x, y, rng.uniform(-50, 900)) for k, w, h in SIZES for x in range(w) for y in range(h) if k != 2 or rng.random() < 0.8]
    return spark.createDataFrame(rows, "k int, x long, y long, z double").repartition(3).persist()


def as_dict(df, value="z"):
    return {(r.k, r.x, r.y): r[value] for r in df.collect()}


def frames(spark, dst_w, dst_h):
    return spark.createDataFrame([(k, k, 0, 0, w, h, dst_w, dst_h) for k, w, h in SIZES], "k int, s int, left long, top long, src_w long, src_h long, dst_w long, dst_h long")


def close(a, b):
    assert a.keys() == b.keys()
    for key in a:
        assert a[key] == pytest.approx(b[key], abs=1e-9), key


def test_blocks_and_pixels_round_trip(rasters):
    for side in (256, 7):
        cut = blocks.blocks_of(rasters, ["k"], ("z",), side)
        assert as_dict(blocks.pixels_of(cut, ["k"])) == as_dict(rasters)
        assert all(r.w <= side and r.h <= side and len(r.v) == r.w * r.h for r in cut.collect())
    both = rasters.withColumn("q", -F.col("z"))
    back = blocks.pixels_of(blocks.blocks_of(both, ["k"], ("z", "q"), 9), ["k"], ("z", "q"))
    assert back.filter("z <> -q").count() == 0 and back.count() == rasters.count()


@pytest.mark.parametrize("side, target", [(256, 256), (8, 5)])
@pytest.mark.parametrize("how", ["bilinear", "nearest", "lanczos2", "lanczos3"])
def test_resizes_equal_those_of_pixels(spark, rasters, how, side, target):
    cut = blocks.blocks_of(rasters.withColumnRenamed("k", "s"), ["s"], ("z",), side)
    got = as_dict(blocks.pixels_of(blocks.resampled(cut, frames(spark, 17, 31), ["s"], ["k"], how, block=target, cell=side), ["k"]))
    sized = rasters.join(spark.createDataFrame(SIZES, "k int, sw int, sh int"), "k")
    if how == "bilinear":
        want = resample.resample_bilinear(sized, ["k"], "sw", "sh", 17, 31)
    elif how == "nearest":
        want = resample.resample_nearest(sized, ["k"], "sw", "sh", 17, 31, ("z",))
    else:
        want = resample.resample_lanczos(sized, ["k"], "sw", "sh", 17, 31, int(how[-1]), "z")
    close(got, as_dict(want))


def test_nearest_without_a_shuffle_equals_the_gathered_one(spark, rasters):
    sized = blocks.blocks_of(rasters, ["k"], ("z",), 8).join(spark.createDataFrame(SIZES, "k int, sw int, sh int"), "k")
    for dw, dh in ((17, 31), (1, 5), (90, 3)):
        got = blocks.resampled_nearest(sized, ["k"], "sw", "sh", dw, dh)
        want = resample.resample_nearest(rasters.join(spark.createDataFrame(SIZES, "k int, sw int, sh int"), "k"), ["k"], "sw", "sh", dw, dh, ("z",))
        assert as_dict(blocks.pixels_of(got, ["k"])) == as_dict(want)
    stored = spark.createDataFrame([(1, 0, 0, 2, 1, [1.0, 2.0])], f"k int, {blocks.RASTER}")
    assert "Exchange" not in blocks.resampled_nearest(stored, ["k"], 9, 9, 3, 3)._jdf.queryExecution().executedPlan().toString()


def test_slopes_equal_those_of_pixels_with_one_exchange(spark, rasters):
    want = as_dict(surface.slope_grid(rasters, ["k"]), "slope")
    for side in (256, 8, 3):
        cut = blocks.blocks_of(rasters, ["k"], ("z",), side)
        close(as_dict(blocks.pixels_of(blocks.slopes(cut, ["k"], side), ["k"])), want)
        crop = blocks.resampled(cut.withColumnRenamed("k", "s"), frames(spark, 1, 1), ["s"], ["k"], "slope", block=5, cell=side)
        close(as_dict(blocks.pixels_of(crop, ["k"])), want)
    stored = spark.createDataFrame([(1, 0, 0, 2, 1, [1.0, 2.0])], f"k int, {blocks.RASTER}")
    assert blocks.slopes(stored, ["k"])._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_windows_clips_and_fills(spark, rasters):
    cut = blocks.blocks_of(rasters.filter("k = 1").withColumnRenamed("k", "s"), ["s"], ("z",), 10)
    held = as_dict(rasters.filter("k = 1"))
    frame = spark.createDataFrame([(9, 1, -4, 3, 20, 40, 2, 5, 12, 15), (8, 77, 0, 0, 2, 2, 0, 0, 2, 2)], "k int, s int, left long, top long, src_w long, src_h long, clip_left long, clip_top long, clip_right long, clip_bottom long")
    got = as_dict(blocks.pixels_of(blocks.resampled(cut, frame, ["s"], ["k"], "copy", fill=-1.0, block=16, cell=10), ["k"]))
    want = {(9, x, y): held[1, x - 4, y + 3] if 2 <= x - 4 < 12 and 5 <= y + 3 < 15 else -1.0 for x in range(20) for y in range(40)}
    assert got == want | {(8, x, y): -1.0 for x in range(2) for y in range(2)}
    holes = blocks.pixels_of(blocks.resampled(cut, frame.filter("k = 9"), ["s"], ["k"], "copy", block=16, cell=10), ["k"])
    assert as_dict(holes) == {k: v for k, v in want.items() if v != -1.0}


def test_bands_share_weights(spark):
    rng = np.random.default_rng(4)
    image = rng.integers(0, 256, (3, 30, 26)).astype(float)
    rows = [(1, 0, 0, 26, 30, image.ravel().tolist())]
    cut = spark.createDataFrame(rows, f"s int, {blocks.RASTER}")
    frame = spark.createDataFrame([(5, 1, 0, 0, 26, 30, 11, 40), (6, 1, 0, 0, 26, 30, 26, 30), (7, 1, 0, 0, 26, 30, 60, 61)], "k int, s int, left long, top long, src_w long, src_h long, dst_w long, dst_h long")
    got = blocks.pixels_of(blocks.resampled(cut, frame, ["s"], ["k"], "imagery", bands=3, block=20), ["k"], ("r", "g", "b")).collect()
    by = {(p.k, p.x, p.y): (p.r, p.g, p.b) for p in got}
    assert all(by[6, x, y] == tuple(image[:, y, x]) for x in range(26) for y in range(30))
    assert all(by[7, x, y] == tuple(image[:, int(y / 60 * 29 + 0.5), int(x / 59 * 25 + 0.5)]) for x in range(60) for y in range(61))
    single = spark.createDataFrame([(1, x, y, float(image[1, y, x])) for x in range(26) for y in range(30)], "k int, x long, y long, z double")
    want = as_dict(resample.resample_imagery(single, ["k"], 26, 30, 11, 40, "z"))
    close({(1, x, y): v[1] for (k, x, y), v in by.items() if k == 5}, want)


def test_stats_and_levels_equal_those_of_pixels(spark):
    nan = float("nan")
    rows = [(1, x, y, v) for (x, y), v in zip([(x, y) for x in range(4) for y in range(3)], [1.5, nan, 3.0, -2.0, None, 7.25, float("-inf"), 0.0, 1.0, 2.0, 3.0, 4.0])] + [(2, 0, 0, nan), (3, 5, 5, 2.0)]
    pixels = spark.createDataFrame(rows, "k int, x long, y long, z double")
    cut = blocks.blocks_of(pixels.filter("k <> 3"), ["k"], ("z",), 2)
    want = {r.k: r for r in surface.elevation_stats(pixels.filter("k <> 3"), ["k"]).collect()}
    assert {r.k: r for r in blocks.stats(cut, ["k"]).select(*list(want.values())[0].__fields__).collect()} == want
    levels = blocks.pixels_of(blocks.quantized(cut, ["k"]).withColumn("v", F.col("q").cast("array<double>")), ["k"], ("q",), absent=True)
    got, wanted = as_dict(levels, "q"), as_dict(surface.quantize_heights(pixels.filter("k <> 3"), ["k"]), "q")
    assert all(got[key] == value for key, value in wanted.items())
