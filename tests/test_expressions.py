"""Literal cases and properties of the column expressions."""

import math

import pytest
from pyspark.sql import functions as F

from orograph.functions import features as ft
from orograph.functions import geo, heights, names, numbers, rng, sql


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_rounding_sends_halves_up(spark):
    got = values(spark, [(-2.5,), (2.5,), (-2.51,), (0.49,)], "v double", numbers.round_half_up("v"))
    assert [g[0] for g in got] == [-2, 3, -3, 0]


@pytest.mark.parametrize("text, want", [
    ("12", 12.0), (" 7.5 ", 7.5), (".5", 0.5), ("5.", 5.0), ("1e3", 1000.0), ("-4", -4.0), ("", None), (None, None), ("abc", None),
    ("5 m", None), ("1d", None), ("5f", None), ("NaN", None), ("Infinity", None), ("1e999", None), ("0x1A", 26.0), ("  ", 0.0), ("1,5", None),
])
def test_numbers_from_text(spark, text, want):
    assert values(spark, [(text,)], "t string", numbers.parse_number("t")) == [(want,)]


def test_leading_integer(spark):
    got = values(spark, [("2;3",), ("-1",), ("x",), (None,), (" +4 ",), ("1.9",)], "t string", numbers.leading_integer("t"))
    assert [g[0] for g in got] == [2, -1, 0, 0, 4, 1]


def mulberry(seed, count):
    """The generator written as a loop."""
    out, s, m = [], seed & 0xFFFFFFFF, 0xFFFFFFFF
    for _ in range(count):
        s = (s + 0x6D2B79F5) & m
        t = ((s ^ (s >> 15)) * (s | 1)) & m
        t = ((t + (((t ^ (t >> 7)) * (t | 61)) & m)) & m) ^ t
        out.append((t ^ (t >> 14)) / 4294967296)
    return out


def test_draws_equal_the_loop(spark):
    for seed in (42, 0, -7, 2**31 - 1):
        got = [r[0] for r in spark.range(500).select("id", rng.draw(seed, "id").alias("d")).orderBy("id").select("d").collect()]
        assert got == mulberry(seed, 500)
        stepped = rng.with_draw(spark.range(500), seed, "id", "d").orderBy("id").collect()
        assert [r["d"] for r in stepped] == got
        assert rng.draw_array(seed, spark.range(500).toPandas()["id"].to_numpy()).tolist() == got
    assert mulberry(42, 3) == [0.6011037519201636, 0.44829055899754167, 0.8524657934904099]


def test_draws_far_out_do_not_overflow(spark):
    big = 6_000_000_000
    got = spark.range(big, big + 3).select(rng.draw(1, "id").alias("d")).collect()
    assert all(0 <= r["d"] < 1 for r in got)


def test_tile_math_round_trip(spark):
    rows = [(float(lon), float(lat), z) for lon in range(-175, 180, 37) for lat in range(-80, 85, 23) for z in (1, 7, 15)]
    df = spark.createDataFrame(rows, "lon double, lat double, z int").withColumn("x", geo.lng_to_tile_x("lon", "z")).withColumn("y", geo.lat_to_tile_y("lat", "z"))
    inside = (
        (geo.tile_x_to_lng("x", "z") <= F.col("lon") + 1e-9) & (geo.tile_x_to_lng(F.col("x") + 1, "z") > F.col("lon") - 1e-9)
        & (geo.tile_y_to_lat("y", "z") >= F.col("lat") - 1e-9) & (geo.tile_y_to_lat(F.col("y") + 1, "z") < F.col("lat") + 1e-9)
    )
    assert df.filter(~inside).count() == 0
    top = spark.range(1).select(geo.tile_y_to_lat(F.lit(0), F.lit(3))).collect()[0][0]
    assert abs(top - 85.0511287798066) < 1e-9


def test_zoom_at_exact_powers(spark):
    rows = [(360.0 * size / (256 * 2.0**z), size, z) for z in range(1, 15) for size in (256, 1024)]
    df = spark.createDataFrame(rows, "span double, size int, z int")
    got = df.select("z", geo.choose_zoom(F.lit(0.0), F.lit(0.0), F.col("span"), F.col("span"), "size", F.lit(15)).alias("g")).collect()
    assert all(r["g"] == r["z"] for r in got)
    assert values(spark, [(0.05, 0.0)], "a double, b double", geo.choose_zoom("b", "b", "a", "a", F.lit(1024), F.lit(15))) == [(15,)]
    assert values(spark, [(1.0, 0.0)], "a double, b double", geo.choose_zoom("a", "a", "b", "b", F.lit(1024), F.lit(15))) == [(10,)]


def test_pixels_outside_are_clamped(spark):
    x, y = geo.geo_to_pixel("lat", "lon", F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0), 10, 10)
    got = values(spark, [(2.0, -1.0), (-5.0, 3.0), (0.5, 0.5)], "lat double, lon double", x, y)
    assert got == [(0, 0), (9, 9), (5, 5)]
    x, y = geo.geo_to_pixel("lat", "lon", F.lit(1.0), F.lit(2.0), F.lit(1.0), F.lit(2.0), 11, 11)
    assert values(spark, [(0.0, 0.0)], "lat double, lon double", x, y) == [(5, 5)]


def test_quantised_heights(spark):
    rows = [(0.0,), (10.0,), (5.0,), (float("nan"),), (float("-inf"),), (None,)]
    got = values(spark, rows, "z double", heights.quantize_u16("z", F.lit(0.0), F.lit(10.0)))
    assert [g[0] for g in got] == [0, 65535, 32768, 0, 0, 0]
    assert values(spark, [(3.0,)], "z double", heights.quantize_u16("z", F.lit(3.0), F.lit(0.0))) == [(0,)]
    got = values(spark, [(-2.5,), (1e9,), (-1e9,), (float("nan"),)], "z double", heights.quantize_i16("z"))
    assert [g[0] for g in got] == [-2, 32767, -32768, 0]


def test_mask_values(spark):
    def u8(v, lo, hi):
        return values(spark, [(v, lo, hi)], "v double, lo double, hi double", heights.normalize_mask_u8("v", "lo", "hi"), heights.preview_u8("v", "lo", "hi"))[0]

    assert u8(7.0, 7.0, 7.0) == (255, 255)
    assert u8(0.0, 0.0, 0.0) == (0, 0)
    assert u8(3.6, 0.0, 200.0)[0] == 4
    assert u8(50.0, -50.0, 150.0) == (128, 128)
    assert u8(float("nan"), -50.0, 150.0) == (0, 0)
    assert u8(float("nan"), None, None) == (0, 0)


@pytest.mark.parametrize("height, levels, want", [
    ("12.5", "4", (12.5, 4)), ("12.5", "3.5", (12.5, 4)), ("abc", "5", (15.0, 5)), ("5000", None, (10.0, 3)), (None, "250", (10.0, 3)), ("0.1", None, (0.1, 1)), ("1", "0", (1.0, 1)),
])
def test_building_height_and_floors(spark, height, levels, want):
    got = values(spark, [(height, levels)], "h string, l string", ft.building_height("h", "l", F.lit(10.0)), ft.building_floors("h", "l", F.lit(10.0)))
    assert got == [want]


@pytest.mark.parametrize("width, lanes, highway, want", [
    ("7.25", "2", "motorway", 7.25), ("0.1", "2", "motorway", 7.0), (None, "1.5", "motorway", 12.0), ("99", None, "bridleway", 4.0), (None, "-1", "path", 2.0), (None, None, None, 4.0),
])
def test_road_width(spark, width, lanes, highway, want):
    assert values(spark, [(width, lanes, highway)], "w string, l string, h string", ft.road_width("w", "l", "h")) == [(want,)]


def test_bridges_and_levels(spark):
    got = values(spark, [(2, "no"), (0, "yes"), (-1, "viaduct"), (0, None)], "l bigint, b string", ft.bridge_offset("l", "b"))
    assert [g[0] for g in got] == [10.0, 5.0, 5.0, 0.0]
    got = values(spark, [("2",), ("-1",), ("1.5",), ("201",), (None,)], "m string", ft.min_level("m"))
    assert [g[0] for g in got] == [2, 0, 0, 0, 0]


def test_paths_and_names(spark):
    row, column = names.path_tile_coords("p")
    paths = ["tile_2_3/h.png", "a\\tile_4_5\\h.tif", "x/tile_7_8_heightmap.png", "none.png", None]
    got = values(spark, [(p,) for p in paths], "p string", row, column)
    assert got == [(2, 3), (4, 5), (7, 8), (None, None), (None, None)]
    got = values(spark, [(48, 2), (-3, -120), (5, 7)], "a bigint, o bigint", names.hemisphere_name("a", "o"), names.hemisphere_name("a", "o", ""))
    assert got == [("N48_00_E002", "N48E002"), ("S03_00_W120", "S03W120"), ("N05_00_E007", "N05E007")]
    with pytest.raises(Exception, match="unknown height format"):
        values(spark, [("bmp",)], "f string", names.height_extension("f"))


def test_search_needs_three_characters(spark):
    got = values(spark, [("ab ",), ("\tabc\n",), ("  ",), ("abcd",)], "q string", names.search_trigger("q"))
    assert [g[0] for g in got] == [False, True, False, True]


def test_sql_functions_equal_the_columns(spark):
    assert "quantize_u16" in sql.register(spark)
    df = spark.createDataFrame([(12.3, -33.9, 9, "5.5", "2;3", 130, 7, 9), (-170.0, 71.0, 3, "x", None, 0, 255, 1)],
                               "lng double, lat double, z int, t string, l string, r int, g int, b int")
    pairs = {
        "lng_to_pixel_x(lng, z)": geo.lng_to_pixel_x("lng", "z"), "lat_to_pixel_y(lat, z)": geo.lat_to_pixel_y("lat", "z"),
        "lng_to_tile_x(lng, z)": geo.lng_to_tile_x("lng", "z"), "lat_to_tile_y(lat, z)": geo.lat_to_tile_y("lat", "z"),
        "tile_y_to_lat(3, z)": geo.tile_y_to_lat(F.lit(3), "z"), "parse_number(t)": numbers.parse_number("t"),
        "leading_integer(l)": numbers.leading_integer("l"), "decode_terrarium(r, g, b)": heights.decode_terrarium("r", "g", "b"),
        "decode_terrain_rgb(r, g, b)": heights.decode_terrain_rgb("r", "g", "b"), "quantize_i16(lng)": heights.quantize_i16("lng"),
        "bridge_offset(leading_integer(l), 'yes')": ft.bridge_offset(numbers.leading_integer("l"), F.lit("yes")),
        "redact_url('a?KEY=1&monkey=2')": names.redact_url(F.lit("a?KEY=1&monkey=2")),
    }
    for text, column in pairs.items():
        for a, b in df.select(F.expr(text), column).collect():
            assert a == b or math.isclose(a, b, rel_tol=1e-12), text
