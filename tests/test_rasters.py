"""Raster operators against plain loops on small fixtures."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orograph.operators import blocks, grids, mosaic, resample, surface
from orograph.plans import rasters
from orograph.sources import catalogs, r16


def raster(spark, tiles):
    rows = [(t, x, y, float(a[y, x])) for t, a in tiles.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "tile int, x bigint, y bigint, z double")


def as_dict(df, value):
    return {(r["tile"], r["x"], r["y"]): r[value] for r in df.collect()}


def noise(seed, h, w):
    return np.random.default_rng(seed).uniform(-500, 9000, (h, w))


def slope_loop(a):
    h, w = a.shape
    out = np.zeros_like(a)
    for y in range(h):
        for x in range(w):
            l, r, u, d = max(0, x - 1), min(w - 1, x + 1), max(0, y - 1), min(h - 1, y + 1)
            gx = (a[y, r] - a[y, l]) / (r - l) if r > l else 0.0
            gy = (a[d, x] - a[u, x]) / (d - u) if d > u else 0.0
            out[y, x] = math.degrees(math.atan(math.hypot(gx, gy)))
    return out


@pytest.mark.parametrize("block", [2, 3, 256])
def test_slope_does_not_depend_on_the_blocks(spark, block):
    tiles = {1: noise(1, 7, 9), 2: noise(2, 1, 5), 3: noise(3, 6, 1), 4: noise(4, 1, 1)}
    got = as_dict(surface.slope_grid(raster(spark, tiles), ["tile"], block=block), "slope")
    assert len(got) == sum(a.size for a in tiles.values())
    for t, a in tiles.items():
        want = slope_loop(a)
        for y in range(a.shape[0]):
            for x in range(a.shape[1]):
                assert got[t, x, y] == pytest.approx(want[y, x], abs=1e-9)


def test_slope_beside_holes(spark):
    a = noise(11, 3, 5)
    df = raster(spark, {1: a}).filter("NOT (x = 2 AND y = 1)")
    got = as_dict(surface.slope_grid(df, ["tile"]), "slope")
    gx, gy = a[1, 1] - a[1, 0], (a[2, 1] - a[0, 1]) / 2
    assert len(got) == 14 and got[1, 1, 1] == pytest.approx(math.degrees(math.atan(math.hypot(gx, gy))))
    full = as_dict(surface.slope_grid(raster(spark, {1: a}), ["tile"]), "slope")
    assert full == as_dict(surface.slope_grid(raster(spark, {1: a}), ["tile"]), "slope")


def test_slope_groups_stay_small_for_one_large_tile(spark):
    pixels = spark.range(40000).select(F.lit(1).alias("tile"), (F.col("id") % 200).alias("x"), F.floor(F.col("id") / 200).alias("y"), F.rand(1).alias("z"))
    cut = surface.halo_blocks(pixels, 32)
    assert cut.groupBy("tile", "_bx", "_by").count().agg(F.max("count")).collect()[0][0] <= 34 * 34
    assert cut.filter("_own").count() == 40000


@pytest.mark.parametrize("size", [(2, 2), (5, 13), (31, 4), (7, 9)])
def test_bilinear(spark, size):
    dw, dh = size
    tiles = {1: noise(5, 7, 9), 2: noise(6, 7, 9)}
    got = as_dict(resample.resample_bilinear(raster(spark, tiles), ["tile"], 9, 7, dw, dh), "z")
    assert len(got) == 2 * dw * dh
    for t, a in tiles.items():
        for y in range(dh):
            for x in range(dw):
                sx, sy = x * (8 / (dw - 1)), y * (6 / (dh - 1))
                x0, y0 = math.floor(sx), math.floor(sy)
                x1, y1, fx, fy = min(x0 + 1, 8), min(y0 + 1, 6), sx - x0, sy - y0
                want = (a[y0, x0] * (1 - fx) + a[y0, x1] * fx) * (1 - fy) + (a[y1, x0] * (1 - fx) + a[y1, x1] * fx) * fy
                assert got[t, x, y] == pytest.approx(want, abs=1e-9)
    if size == (7, 9):
        assert got[1, 6, 8] == tiles[1][6, 8]


def test_bilinear_keeps_nan_and_single_rows(spark):
    a = noise(7, 1, 4)
    a[0, 1] = np.nan
    got = as_dict(resample.resample_bilinear(raster(spark, {1: a}), ["tile"], 4, 1, 4, 3), "z")
    assert len(got) == 12
    # With factor 0 a NaN neighbour still makes the result NaN.
    assert math.isnan(got[1, 0, 0]) and math.isnan(got[1, 1, 2]) and got[1, 3, 1] == a[0, 3]


def test_bilinear_rejects_one_pixel(spark):
    with pytest.raises(ValueError):
        resample.resample_bilinear(raster(spark, {1: noise(1, 2, 2)}), ["tile"], 2, 2, 1, 5)


@pytest.mark.parametrize("size", [(1, 1), (3, 20), (9, 7), (40, 2), (1, 6)])
def test_nearest(spark, size):
    dw, dh = size
    a = noise(8, 7, 9)
    got = as_dict(resample.resample_nearest(raster(spark, {1: a}), ["tile"], 9, 7, dw, dh, ("z",)), "z")
    assert len(got) == dw * dh
    for (_, x, y), v in got.items():
        sx = 0 if dw == 1 else min(8, math.floor(x / (dw - 1) * 8 + 0.5))
        sy = 0 if dh == 1 else min(6, math.floor(y / (dh - 1) * 6 + 0.5))
        assert v == a[sy, sx]


def test_lanczos_shuffles_pixels_and_not_their_taps(spark):
    a = noise(12, 3 * resample.LINES, 40)
    out = resample.resample_lanczos(raster(spark, {1: a}), ["tile"], 40, 3 * resample.LINES, 9, 7, 2, "z")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("REPARTITION_BY_NUM") == 2

    def weights(n_src, n_dst):
        d = ((np.arange(n_dst)[:, None] + 0.5) * n_src / n_dst - 0.5 - np.arange(n_src)[None, :]) / max(n_src / n_dst, 1.0)
        w = np.where(np.abs(d) < 2, np.sinc(d) * np.sinc(d / 2), 0.0)
        return w / w.sum(1, keepdims=True)

    want, got = weights(3 * resample.LINES, 7) @ a @ weights(40, 9).T, as_dict(out, "z")
    assert len(got) == 63 and all(v == pytest.approx(want[y, x], abs=1e-6) for (_, x, y), v in got.items())


def test_lanczos_keeps_constants_and_size_columns(spark):
    df = raster(spark, {1: np.full((12, 9), 40.0)}).withColumn("w", F.lit(9)).withColumn("h", F.lit(12))
    got = as_dict(resample.resample_lanczos(df, ["tile"], "w", "h", 4, 5, 3, "z"), "z")
    assert len(got) == 20 and all(v == pytest.approx(40.0) for v in got.values())


def test_stats_without_values(spark):
    a = np.array([[np.nan, -np.inf]])
    got = surface.elevation_stats(raster(spark, {1: a, 2: np.array([[5.0, np.nan]])}), ["tile"]).orderBy("tile").collect()
    assert [tuple(r) for r in got] == [(1, 0.0, 0.0, True, 0.0), (2, 5.0, 5.0, True, 0.0)]


def test_crop_outside_reads_zero(spark):
    a = noise(9, 6, 8)
    windows = [(1, -2, -1, 5, 4), (2, 6, 4, 6, 5), (3, 20, 20, 2, 2), (4, -3, 2, 20, 2)]
    frame = spark.createDataFrame([(i, 1, l, t, w, h, 8, 6) for i, l, t, w, h in windows],
                                  "win int, tile int, left bigint, top bigint, width bigint, height bigint, mosaic_w int, mosaic_h int")
    out = mosaic.crop_mercator(raster(spark, {1: a}), frame, ["tile"], ["win"], {"z": 0.0}).collect()
    assert len(out) == sum(w * h for *_, w, h in windows)
    got = {(r["win"], r["x"], r["y"]): r["z"] for r in out}
    for i, l, t, w, h in windows:
        for y in range(h):
            for x in range(w):
                inside = 0 <= l + x < 8 and 0 <= t + y < 6
                assert got[i, x, y] == (a[t + y, l + x] if inside else 0.0)


def test_marks_take_the_room_of_the_pixels(spark):
    """No bitmap of a fixed size per raster; pixels that carry their size are not joined with the sizes."""
    sizes = spark.range(50).selectExpr("id AS k", "13 AS width", "11 AS height")
    rows = [(k, i % 13, i // 13, 1, 13, 11) for k in range(49) for i in range(143) if (i * 7 + k) % 10]
    pixels = spark.createDataFrame(rows, "k long, x long, y long, v int, _w int, _h int")
    for given in (pixels, pixels.drop("_w", "_h")):
        out = grids.fill_holes(given, sizes, ["k"], {"v": 0})
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "bitmap" not in plan and "SortAggregate" not in plan and ("Join" in plan) == ("_w" not in given.columns)
        got = sorted(tuple(r) for r in out.collect())
        assert got == sorted((k, i % 13, i // 13, 1 if k < 49 and (i * 7 + k) % 10 else 0) for k in range(50) for i in range(143))


def test_crops_hold_a_block_and_not_its_windows(spark):
    windows = spark.range(30).selectExpr("id AS win", "1 AS tile", "id AS left", "id AS top", "9L AS width", "7L AS height")
    plan = mosaic.crop_windows(raster(spark, {1: noise(10, 40, 50)}), windows, ["tile"], ["win"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_window_blocks_do_not_change_a_crop(spark):
    a = noise(10, 40, 50)
    frame = spark.createDataFrame([(i, 1, i * 3, i * 2, 9 + i, 7) for i in range(10)], "win int, tile int, left bigint, top bigint, width bigint, height bigint")
    counts = [sorted((r["win"], r["x"], r["y"], r["z"]) for r in mosaic.crop_windows(raster(spark, {1: a}), frame, ["tile"], ["win"], b).collect()) for b in (4, 32, 500)]
    assert counts[0] == counts[1] == counts[2] and len(counts[0]) == sum((9 + i) * 7 for i in range(10))


def test_empty_mercator_window_is_an_error(spark):
    box = spark.createDataFrame([(10.0, 5.0, 10.0, 6.0, 3, 4, 3)], "west double, south double, east double, north double, z int, min_x bigint, min_y bigint")
    with pytest.raises(Exception, match="crop window is empty"):
        mosaic.mercator_window(box, "z", "min_x", "min_y").collect()


def test_boxes_that_reach_a_pole_end_on_the_web_grid(spark):
    rows = [("grid", -80.0, -90.0), ("beyond", -89.5, -90.0), ("north", 90.0, 80.0), ("both", 90.0, -90.0), ("inside", -80.0, -80.5), ("near", -89.0, -89.5), ("unknown", -80.0, None)]
    boxes = spark.createDataFrame([(n, 10.0, s, 11.0, t, 7) for n, t, s in rows], "name string, west double, south double, east double, north double, z int")
    ranged = boxes.withColumns(catalogs.tile_range("z"))
    got = {r["name"]: r for r in mosaic.mercator_window(ranged, "z", "min_x", "min_y").collect()}

    def row(lat):
        phi = lat * math.pi / 180.0
        return (1.0 - math.log(math.tan(phi) + 1.0 / math.cos(phi)) / math.pi) / 2.0 * 128

    assert (got["grid"]["min_y"], got["grid"]["max_y"]) == (math.floor(row(-80.0)), 127)
    assert got["grid"]["top"] + got["grid"]["height"] == (128 - got["grid"]["min_y"]) * 256
    assert got["beyond"]["min_y"] == math.floor(row(-89.5)) > 127 and got["beyond"]["max_y"] - got["beyond"]["min_y"] in (0, 1)
    assert got["beyond"]["top"] + got["beyond"]["height"] == (got["beyond"]["max_y"] + 1 - got["beyond"]["min_y"]) * 256 and got["beyond"]["height"] >= 128
    assert (got["north"]["min_y"], got["north"]["top"], got["north"]["height"]) == (0, 0, math.floor(row(80.0) * 256 + 0.5))
    assert (got["both"]["min_y"], got["both"]["max_y"], got["both"]["height"]) == (0, 127, 128 * 256)
    for name, north, south in (("inside", -80.0, -80.5), ("near", -89.0, -89.5)):
        assert (got[name]["min_y"], got[name]["max_y"]) == (math.floor(row(north)), math.floor(row(south)))
        assert got[name]["height"] == math.floor((row(south) - row(north)) * 256 + 0.5)
    assert got["unknown"]["max_y"] is None and got["unknown"]["height"] is None
    # each gives a raster, whose missing tiles read as 0
    source = rasters.web_tiles(spark.createDataFrame([], "z int, tile_x int, tile_y int, x0 bigint, y0 bigint, w int, h int, v array<double>"), 16, 7)
    frames = source.frames(boxes.drop("z").filter("name IN ('grid', 'beyond', 'north')"), 4, 4)
    full = blocks.resampled(source.blocks, frames, source.keys, ["name"], "bilinear", fill=0.0)
    assert sorted((r["name"], r["v"]) for r in full.collect()) == [(n, [0.0] * 16) for n in ("beyond", "grid", "north")]


def test_missing_tiles_are_filled(spark):
    cat = spark.createDataFrame([(1, c, r, 0, 0) for r in range(2) for c in range(3)], "m int, tile_x int, tile_y int, min_x int, min_y int")
    have = spark.createDataFrame([(1, 1, 1, x, y, 7.0) for x in range(4) for y in range(4)], "m int, tile_x int, tile_y int, x bigint, y bigint, z double")
    out = mosaic.mosaic_tiles(have, cat, ["m"], 4, 4, {"z": 0.0}).collect()
    assert len(out) == 6 * 16
    assert sum(r["z"] for r in out) == 16 * 7 and {(r["x"], r["y"]) for r in out if r["z"]} == {(x, y) for x in range(4, 8) for y in range(4, 8)}


def test_chunks_cover_the_output(spark):
    rng = random.Random(3)
    jobs = [(i, rng.randint(64, 16384), rng.randint(64, 16384), rng.randint(100, 100000), rng.randint(100, 50000), 0.0, 0.0, 3.0, 3.0) for i in range(200)]
    df = grids.chunk_plan(spark.createDataFrame(jobs, "job int, out_w bigint, out_h bigint, src_w bigint, src_h bigint, west double, south double, east double, north double"))
    per = df.groupBy("job").agg(
        F.sum(F.col("width") * F.col("height")).alias("area"), F.first("out_w").alias("w"), F.first("out_h").alias("h"),
        F.max(F.col("src_w") / F.col("chunk_cols") * F.col("src_h") / F.col("chunk_rows")).alias("px"),
    ).collect()
    assert len(per) == 200 and all(r["area"] == r["w"] * r["h"] and r["px"] < grids.CHUNK_PIXEL_LIMIT for r in per)


def test_split_parts_cover_the_box(spark):
    rng = random.Random(4)
    boxes = [(i, -50.0, -20.0, -50.0 + rng.uniform(0.01, 10), -20.0 + rng.uniform(0.01, 10)) for i in range(300)]
    df = grids.split_bounds(spark.createDataFrame(boxes, "box int, west double, south double, east double, north double"))
    area = (F.col("east") - F.col("west")) * (F.col("north") - F.col("south"))
    per = {r["box"]: r for r in df.groupBy("box").agg(F.sum(area).alias("a"), F.max(area).alias("m"), F.max("east").alias("e"), F.max("north").alias("n")).collect()}
    for i, w, s, e, n in boxes:
        assert per[i]["a"] == pytest.approx((e - w) * (n - s)) and per[i]["m"] <= 0.25 + 1e-9 and (per[i]["e"], per[i]["n"]) == (e, n)


def test_grids_are_listed_by_many_tasks(spark):
    df = spark.createDataFrame([(1, 300, 200), (2, 0, 5), (3, 2, 1)], "k int, w int, h int")
    out = grids.explode_grid(df, grids.int_range(F.lit(0), F.col("w") - 1), grids.int_range(F.lit(0), F.col("h") - 1))
    want = [(1, x, y) for x in range(300) for y in range(200)] + [(3, 0, 0), (3, 1, 0)]
    assert sorted((r["k"], r["x"], r["y"]) for r in out.collect()) == want
    assert out.filter("k = 1").select(F.spark_partition_id()).distinct().count() > 1


def test_rasters_with_holes_are_filled(spark):
    sizes = spark.createDataFrame([(1, 4, 3), (2, 2, 2), (3, 1, 1)], "k int, width int, height int")
    rows = [(1, x, y, 7) for x in range(4) for y in range(3) if (x, y) not in ((0, 0), (2, 1))] + [(2, x, y, 5) for x in range(2) for y in range(2)]
    out = grids.fill_holes(spark.createDataFrame(rows, "k int, x bigint, y bigint, v int"), sizes, ["k"], {"v": 0}).collect()
    assert len(out) == 12 + 4 + 1 and {(r["k"], r["x"], r["y"]) for r in out if r["v"] == 0} == {(1, 0, 0), (1, 2, 1), (3, 0, 0)}


def test_landcover_tiles_end_before_the_next(spark):
    box = spark.createDataFrame([(1, -3.0, 48.0, 0.0, 51.0), (2, -3.5, 47.9, 0.1, 48.0)], "b int, west double, south double, east double, north double")
    got = {(r["b"], r["tile_name"]) for r in catalogs.landcover_tile_catalog(box).collect()}
    assert got == {(1, "N48W003"), (2, "N45W006"), (2, "N45W003"), (2, "N45E000")}


def test_r16_files(spark, tmp_path):
    a = np.arange(300 * 300).reshape(300, 300) % 60000
    (tmp_path / "a.r16").write_bytes(a.astype("<u2").tobytes())
    df = r16.read_r16(spark, str(tmp_path))
    assert df.count() == 90000 and df.filter((F.col("y") * 300 + F.col("x")) % 60000 != F.col("q")).count() == 0
    packed = r16.pack_r16(df, ["path"], 300, 300).orderBy("band").collect()
    assert [r["start"] for r in packed] == [0, 256 * 300] and b"".join(bytes(r["content"]) for r in packed) == a.astype("<u2").tobytes()


def test_holes_beside_repeats_and_pixels_outside_are_filled(spark):
    """Surplus rows do not hide a hole, a null key is a key, and large rasters are looked at part by part."""
    from orograph.operators import grids

    rows = [(None if k else "a", x, y, 1.0) for k in (0, 1) for x in range(4) for y in range(4) if (x, y) != (1, 1)]
    rows += [("a", 0, 0, 1.0), (None, 9, 9, 1.0), (None, -1, 0, 1.0), ("unknown", 0, 0, 1.0)]
    pixels = spark.createDataFrame(rows, "k string, x long, y long, z double").repartition(3)
    sizes = spark.createDataFrame([("a", 4, 4), (None, 4, 4), (None, 4, 4), ("empty", 2, 1)], "k string, width int, height int")
    got = sorted(map(tuple, grids.fill_holes(pixels, sizes, ["k"], {"z": 0.0}).collect()), key=repr)
    assert got == sorted(rows + [("a", 1, 1, 0.0), (None, 1, 1, 0.0), ("empty", 0, 0, 0.0), ("empty", 1, 0, 0.0)], key=repr)
    wide = spark.range(300 * 300).filter("id NOT IN (0, 7, 32767, 32768, 89999)").selectExpr("'w' AS k", "id % 300 AS x", "id div 300 AS y", "1.0D AS z")
    full = grids.fill_holes(wide, spark.createDataFrame([("w", 300, 300)], "k string, width int, height int"), ["k"], {"z": 0.0})
    assert sorted(r.y * 300 + r.x for r in full.filter("z = 0").collect()) == [0, 7, 32767, 32768, 89999] and full.count() == 90000


def test_a_blob_read_by_byte_ranges(spark, tmp_path):
    from orograph.sources import r16

    heights = (np.arange(37 * 500) * 7919 % 65536).astype("<u2")
    (tmp_path / "h.r16").write_bytes(heights.tobytes())
    got = r16.read_r16_file(spark, str(tmp_path / "h.r16"), 37, split_bytes=4000)
    assert got.rdd.getNumPartitions() >= 9
    assert {(r.x, r.y): r.q for r in got.collect()} == {(i % 37, i // 37): int(v) for i, v in enumerate(heights)}
    (tmp_path / "cut.r16").write_bytes(heights.tobytes()[:-3])
    with pytest.raises(Exception):
        r16.read_r16_file(spark, str(tmp_path / "cut.r16"), 37).count()
