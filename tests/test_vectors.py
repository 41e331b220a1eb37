"""Feature operators against plain loops."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from orograph.operators import masks, placement, vectors
from orograph.sources import osm, shapes

GEOM = "array<struct<lat: double, lon: double>>"
SCHEMA = f"tile int, type string, id bigint, geometry {GEOM}, tags map<string,string>, west double, south double, east double, north double"


def feature(i, points, tags=None, tile=1, kind="way"):
    return (tile, kind, i, [(float(lat), float(lon)) for lon, lat in points], tags or {}, 0.0, 0.0, 1.0, 1.0)


def to_px(lon, lat, w, h):
    def one(v, n):
        return math.floor(max(0.0, min(n - 1, v * (n - 1))) + 0.5)
    return one(lon, w), one(1 - lat, h)


def fill_loop(polygons, w, h):
    out = set()
    for poly in polygons:
        if len(poly) < 3:
            continue
        pts = [to_px(lon, lat, w, h) for lon, lat in poly]
        for y in range(h):
            xs = []
            for (x1, y1), (x2, y2) in zip(pts, pts[1:] + pts[:1]):
                if min(y1, y2) <= y < max(y1, y2):
                    xs.append(x1 + (y - y1) / (y2 - y1) * (x2 - x1))
            xs.sort()
            for a, b in zip(xs[::2], xs[1::2]):
                out |= {(x, y) for x in range(max(0, math.floor(a + 0.5)), min(w - 1, math.floor(b + 0.5)) + 1)}
    return out


def line_loop(lines, w, h, width):
    out, r = set(), (width - 1) / 2
    disc = [(i, j) for i in range(-6, 7) for j in range(-6, 7) if i * i + j * j <= r * r]
    for line in lines:
        pts = [to_px(lon, lat, w, h) for lon, lat in line]
        for (x, y), (x2, y2) in zip(pts, pts[1:]):
            dx, dy, sx, sy = abs(x2 - x), abs(y2 - y), (1 if x < x2 else -1), (1 if y < y2 else -1)
            err = dx - dy
            while True:
                out |= {(x + i, y + j) for i, j in disc if 0 <= x + i < w and 0 <= y + j < h}
                if (x, y) == (x2, y2):
                    break
                twice = 2 * err
                if twice > -dy:
                    err, x = err - dy, x + sx
                if twice < dx:
                    err, y = err + dx, y + sy
    return out


def random_lines(seed, n, low=-0.3, high=1.3):
    rng = random.Random(seed)
    return [[(rng.uniform(low, high), rng.uniform(low, high)) for _ in range(rng.randint(1, 9))] for _ in range(n)]


def painted(df):
    rows = df.collect()
    assert len(rows) == len({(r["tile"], r["x"], r["y"]) for r in rows}) and {r["v"] for r in rows} <= {255}
    return {(r["x"], r["y"]) for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_polygons_equal_the_loop(spark, seed):
    polygons = random_lines(seed, 60)
    df = spark.createDataFrame([feature(i, p) for i, p in enumerate(polygons)], SCHEMA)
    assert painted(vectors.rasterize_polygons(df, ["tile"], ["id"], 40, 31)) == fill_loop(polygons, 40, 31)


@pytest.mark.parametrize("width", [1, 2, 3, 4, 7, 10])
def test_lines_equal_the_loop(spark, width):
    lines = random_lines(width, 30)
    df = spark.createDataFrame([feature(i, p) for i, p in enumerate(lines)], SCHEMA)
    want = line_loop([line for line in lines if len(line) > 1], 50, 37, width)
    assert painted(vectors.rasterize_lines(df, ["tile"], 50, 37, width)) == want


@pytest.mark.parametrize("width", [1, 6])
def test_lines_over_several_bands_are_walked_band_by_band(spark, width):
    """Steep, flat, level and upright lines over bands; segments are shuffled once, not their spans."""
    lines = random_lines(width + 20, 20) + [[(0.0, 0.5), (1.0, 0.5)], [(0.5, 0.0), (0.5, 1.0)], [(0.0, 0.49), (1.0, 0.53)], [(1.0, 0.0), (0.97, 1.0)], [(0.3, 0.3), (0.3, 0.3)]]
    df = spark.createDataFrame([feature(i, p) for i, p in enumerate(lines)], SCHEMA)
    out = vectors.rasterize_lines(df, ["tile"], 60, 5 * vectors.BAND_ROWS + 3, width)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan
    assert painted(out) == line_loop([line for line in lines if len(line) > 1], 60, 5 * vectors.BAND_ROWS + 3, width)


def test_steps_of_a_band_are_few(spark):
    rows = [(0, 0, 400, 90), (400, 90, 0, 0), (7, 300, 0, 0), (0, 33, 500, 33), (0, 0, 499, 500)]
    segments = spark.createDataFrame(rows, "x1 bigint, y1 bigint, x2 bigint, y2 bigint")
    every = {tuple(r) for r in vectors.bresenham_steps(segments).select("x1", "y1", "x2", "y2", "cx", "cy").collect()}
    near = [tuple(r) for r in vectors.bresenham_steps(segments, F.lit(32), F.lit(63)).select("x1", "y1", "x2", "y2", "cx", "cy").collect()]
    wanted = {r for r in every if 32 <= r[5] <= 63}
    assert wanted <= set(near) <= every and len(near) == len(set(near)) <= len(wanted) + 12 * len(rows)


def test_no_features_no_pixels(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert vectors.rasterize_polygons(df, ["tile"], ["id"], 8, 8).count() == 0
    assert vectors.rasterize_lines(df, ["tile"], 8, 8).count() == 0


def test_merged_spans_are_bounded_for_a_crowded_row(spark):
    spans = spark.range(20000).select(F.lit(1).alias("tile"), F.lit(0).cast("bigint").alias("y"), (F.col("id") % 90).alias("x_from"),
                                      (F.col("id") % 90 + F.col("id") % 7).alias("x_to"))
    merged = vectors.merge_spans(spans, ["tile"]).collect()
    cells = [x for r in merged for x in range(r["x_from"], r["x_to"] + 1)]
    assert len(merged) <= 90 and sorted(cells) == list(range(96))


def test_regions_equal_all_pairs(spark):
    rng = random.Random(7)
    lines = [[(x := rng.uniform(-5, 5), y := rng.uniform(-5, 5)), (x + rng.choice([0.0, 0.1, 4.0]), y + rng.choice([0.0, 0.2, 3.0]))] for _ in range(300)]
    regions = [(i, w := rng.uniform(-5, 5), s := rng.uniform(-5, 5), w + rng.uniform(0, 3), s + rng.uniform(0, 3)) for i in range(80)]
    f = spark.createDataFrame([feature(i, p) for i, p in enumerate(lines)], SCHEMA).drop(*vectors.BOUNDS)
    r = spark.createDataFrame(regions, "region int, west double, south double, east double, north double")
    want = {(i, k) for i, ((x1, y1), (x2, y2)) in enumerate(lines) for k, w, s, e, n in regions if x1 <= e and x2 >= w and y1 <= n and y2 >= s}
    rows = [(x["id"], x["region"]) for x in vectors.features_to_regions(f, r, ["region"]).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_region_candidates_stay_near_the_pairs(spark):
    """1 km tiles in one city: what shares a cell is a small multiple of what meets, and no geometry is joined."""
    step = 1 / 111.32
    r = spark.range(2500).select("id", ((F.col("id") % 50) * step).alias("west"), (F.floor(F.col("id") / 50) * step).alias("south"))
    r = r.select(F.col("id").alias("region"), "west", "south", (F.col("west") + step).alias("east"), (F.col("south") + step).alias("north"))
    x, y = F.pmod(F.col("id") * 7919, F.lit(50000)) / 1000 * step, F.pmod(F.col("id") * 104729, F.lit(50000)) / 1000 * step
    f = spark.range(3000).select(F.lit("way").alias("type"), "id", x.alias("f_west"), y.alias("f_south")).select("*", (F.col("f_west") + step / 20).alias("f_east"), (F.col("f_south") + step / 20).alias("f_north"))
    own = vectors._level("west", "south", "east", "north")
    level = r.select(own).distinct().collect()[0][0]
    a = vectors._cells(f, F.array(F.lit(level)), "f_west", "f_south", "f_east", "f_north")
    b = vectors._cells(r, F.array(F.lit(level)), "west", "south", "east", "north")
    candidates = a.join(b, ["_lv", "_cx", "_cy"]).count()
    assert candidates <= 12 * vectors.region_pairs(f, r, ["region"]).count()


def test_first_copy_wins(spark):
    rows = [("way", 1, 2, 0, "c"), ("way", 1, 0, 5, "b"), ("way", 1, 0, 4, "a"), ("relation", 1, 9, 9, "d")]
    df = spark.createDataFrame(rows, "type string, id bigint, region_idx bigint, pos bigint, name string")
    got = {(r["type"], r["id"]): r["name"] for r in vectors.dedupe_features(df, ["region_idx", "pos"]).collect()}
    assert got == {("way", 1): "a", ("relation", 1): "d"}


def test_osm_response(spark, tmp_path):
    doc = {"elements": [
        {"type": "way", "id": 1, "geometry": [{"lat": 1.5, "lon": 2}], "tags": {"highway": "path"}},
        {"type": "way", "id": 2, "geometry": []}, {"type": "way", "id": 3}, {"type": "node", "id": 4, "geometry": [{"lat": 0, "lon": 0}]},
        {"type": "relation", "id": 5, "members": [{"type": "way", "geometry": [{"lat": 1, "lon": 1}]}, {"type": "node"}, {"type": "way", "geometry": [{"lat": 2, "lon": 2}]}],
         "geometry": [{"lat": 3, "lon": 3}]},
        {"type": "relation", "id": 6, "geometry": [{"lat": 4, "lon": 4}]}, {"type": "relation", "id": 7, "members": []},
    ]}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "b.json").write_text("{}")
    got = {r["id"]: r for r in osm.read_osm_features(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 5, 6} and got[1]["tags"] == {"highway": "path"} and got[6]["tags"] == {}
    assert [p["lat"] for p in got[5]["geometry"]] == [1, 2, 3]
    assert osm.with_hot_tags(osm.read_osm_features(spark, str(tmp_path))).filter("tag_highway = 'path'").count() == 1


def test_tag_filters(spark):
    cases = [({"highway": "x"}, "way", {"roads"}), ({"highway": "x"}, "relation", set()), ({"natural": "water"}, "relation", {"water"}),
             ({"waterway": "river"}, "relation", set()), ({"landuse": "forest"}, "relation", {"vegetation"}), ({"landuse": "grass"}, "relation", set()),
             ({"leisure": "park"}, "way", {"vegetation"}), ({"building": "yes"}, "relation", {"buildings"}), ({"landuse": "reservoir", "building": "x"}, "way", {"water", "buildings"})]
    df = spark.createDataFrame([feature(i, [(0, 0)], t, kind=k) for i, (t, k, _) in enumerate(cases)], SCHEMA)
    for kind in ("roads", "water", "vegetation", "buildings"):
        assert {r["id"] for r in df.filter(vectors.tag_filter(kind)).collect()} == {i for i, (_, _, s) in enumerate(cases) if kind in s}


def test_waterway_lines(spark):
    df = spark.createDataFrame([feature(1, [(0.1, 0.1), (0.9, 0.1), (0.9, 0.9)], {"waterway": "river"})], SCHEMA)
    filled = masks.feature_mask(df, "water", ["tile"], ["id"], 50, 50).count()
    lined = masks.feature_mask(df, "water", ["tile"], ["id"], 50, 50, waterway_as="line").count()
    assert filled > 2 * lined > 0


def test_road_ribbon(spark):
    roads = [(1, [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0)], 4.0), (2, [(1.0, 1.0), (1.0, 1.0)], 0.0), (3, [(0.0, 0.0)], 2.0)]
    df = spark.createDataFrame(roads, "id int, points array<struct<x: double, z: double>>, width double")
    got = {(r["id"], r["pos"]): (r["left_x"], r["left_z"], r["right_x"], r["right_z"]) for r in placement.road_ribbon_edges(df).collect()}
    s = math.sqrt(2)
    assert set(got) == {(1, 0), (1, 1), (1, 2), (2, 0), (2, 1)}
    assert got[1, 0] == (0.0, 2.0, 0.0, -2.0) and got[1, 1] == pytest.approx((10 - s, s, 10 + s, -s)) and got[1, 2] == (8.0, 10.0, 12.0, 10.0)
    assert got[2, 0] == (1.0, 4.0, 1.0, -2.0)


def test_buildings_and_roads_survive_json(spark):
    ring = [(0, 0), (0.1, 0), (0.1, 0.1), (0, 0.1)]
    df = spark.createDataFrame([feature(1, ring, {"building": "yes", "roof:shape": "gabled", "height": "9"}), feature(2, ring[:3], {"building": "yes"}),
                                feature(3, ring[:2], {"highway": "path", "layer": "1"})], SCHEMA)
    b = placement.extract_buildings(df.filter(vectors.tag_filter("buildings")), F.lit(10.0))
    row = json.loads(b.select(F.to_json(F.struct("footprint", "height", "floors", "min_level", "roof_shape", "tags"))).collect()[0][0])
    assert b.count() == 1 and row["height"] == 9.0 and row["floors"] == 3 and row["roof_shape"] == "gabled" and row["min_level"] == 0
    r = placement.extract_roads(df.filter(vectors.tag_filter("roads"))).collect()[0]
    assert (r["width"], r["surface"], r["bridge"], r["layer"]) == (2.0, "", None, 1)


def test_masks_are_cleared_only_beside_water(spark):
    def mask(rows):
        return spark.createDataFrame(rows, "tile int, x bigint, y bigint, v int")
    veg = mask([(t, x, 0, 200) for t in (1, 2, 3) for x in range(6)])
    water, road = mask([(1, 0, 0, 255), (2, 0, 0, 255)]), mask([(t, 1, 0, 255) for t in (1, 2, 3)])
    tiles = lambda *t: spark.createDataFrame([(i,) for i in t], "tile int")
    left = masks.subtract_masks(veg, water, road, ["tile"], tiles(1, 2), tiles(1, 3))
    got = {t: {r["x"] for r in left.collect() if r["tile"] == t} for t in (1, 2, 3)}
    assert got == {1: {2, 3, 4, 5}, 2: {1, 2, 3, 4, 5}, 3: {0, 1, 2, 3, 4, 5}}
    counts = {r["tile"]: (r["water_cleared"], r["road_cleared"]) for r in masks.mask_clear_counts(veg, water, road, ["tile"], tiles(1, 2)).collect()}
    assert counts == {1: (1, 1), 2: (1, 1)}


def test_shapes(spark):
    rows = [(1, 3, 0, 1, 1.0, 1.0), (1, 3, 0, 0, 0.0, 0.0), (1, 3, 1, 0, 5.0, 5.0), (2, 5, 1, 0, 2.0, 2.0), (2, 5, 0, 0, 1.0, 1.0), (2, 5, 0, 1, 1.5, 1.0), (3, 0, 0, 0, 0.0, 0.0)]
    rows += [(4, 1, 0, 0, 7.0, 8.0), (4, 1, 0, 1, 9.0, 8.0)] + [(5, 3, 0, i, float(i), 0.0) for i in range(7)]
    df = spark.createDataFrame(rows, "shape int, shape_type int, ring bigint, ord int, x double, y double")
    got = {(r["shape"], r["part"], r["ring"], r["piece"]): r["points"] for r in shapes.shape_rings_to_features(df, ["shape"], piece=3).collect()}
    assert got == {
        (1, 0, 0, 0): [[0, 0], [1, 1]], (2, 0, 0, 0): [[1, 1], [1.5, 1]], (2, 0, 1, 0): [[2, 2]], (4, 0, 0, 0): [[7, 8]], (4, 1, 0, 0): [[9, 8]],
        **{(5, 0, 0, k): [[float(i), 0.0] for i in range(3 * k, min(7, 3 * k + 3))] for k in range(3)},
    }


def test_a_document_cut_over_many_tasks_gives_the_same_features(spark, tmp_path):
    """Braces and quotes inside of texts, facts beside the list, one-line and indented documents, broken ones."""
    import json
    import random

    from orograph.sources import osm

    rng = random.Random(12)

    def element(i):
        points = [{"lat": rng.uniform(-80, 80), "lon": rng.uniform(-170, 170)} for _ in range(rng.choice([0, 1, 5, 30]))]
        tags = {rng.choice(["highway", "name", "no{te", 'qu"ote']): rng.choice(["path", "a } b", "{", "}}", 'he said "}"', "back\\slash", "\\\"}", "ü😀"]) for _ in range(rng.choice([0, 1, 3]))}
        if i % 5 == 0:
            return {"type": "relation", "id": i, "members": [{"type": "way", "geometry": points}, {"type": "node"}], "tags": tags}
        return {"type": "way", "id": i, "geometry": points, **({"tags": tags} if tags else {})}

    docs = {
        "a.json": json.dumps({"version": 0.6, "osm3s": {"copyright": "none"}, "elements": [element(i) for i in range(200)]}),
        "b.json": json.dumps({"elements": [element(i) for i in range(1000, 1050)]}, indent=2, ensure_ascii=False) + "\n",
        "c.json": '{"elements": []}', "d.json": json.dumps({"elements": [element(7)]}),
    }
    whole = json.dumps({"elements": [element(i) for i in range(2000, 2040)]})
    docs |= {"e.json": whole[:len(whole) * 2 // 3], "f.json": "", "g.json": whole[:whole.rindex('"type"') + 9]}
    for name, text in docs.items():
        (tmp_path / name).write_text(text)
    rows = spark.createDataFrame([(n, t) for n, t in docs.items() if n in "a.json b.json c.json d.json"], "name string, body string")
    want = sorted((r.name, r.type, r.id, r.geometry, r.tags) for r in osm.parse_osm_json(rows).collect())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 60
        features, files = osm.read_osm_parts(spark, str(tmp_path))
        got = [(r.file.rsplit("/", 1)[1], r.type, r.id, r.geometry, r.tags, r.pos) for r in features.collect()]
        report = {r.file.rsplit("/", 1)[1]: (r.elements, r.reason) for r in files.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert sorted(r[:5] for r in got if r[0] in "a.json b.json c.json d.json") == want
    assert all(pos == (i if i < 1000 else i - 1000) for name, _, i, _, _, pos in got if name in "a.json b.json")
    assert {k: report[k] for k in ("a.json", "b.json", "c.json", "d.json")} == {"a.json": (200, None), "b.json": (50, None), "c.json": (0, None), "d.json": (1, None)}
    assert "f.json" not in report
    assert 20 < report["e.json"][0] < 40 and report["e.json"][1].startswith("ends ") and report["g.json"][0] == 39 and report["g.json"][1].startswith("ends ")
    whole_ids = [e["id"] for e in json.loads(whole)["elements"]]
    assert [r[2] for r in sorted(got, key=lambda r: r[5]) if r[0] == "g.json"] == [i for i, e in zip(whole_ids[:39], json.loads(whole)["elements"]) if e.get("geometry") or any(m.get("geometry") for m in e.get("members", []))]


def test_broken_responses_are_named(spark, tmp_path):
    import pytest as _pytest

    from orograph.sources import osm

    rows = [("ok", '{"elements": []}'), ("cut", '{"elements": [{"type": "way"'), ("none", None), ("list", "[1]"), ("other", '{"remark": "busy"}'), ("text", "<html>")]
    got = {r.name: r.reason for r in osm.response_errors(spark.createDataFrame(rows, "name string, body string")).collect()}
    assert set(got) == {"cut", "none", "list", "other", "text"} and got["none"] == "no response" and got["other"] == "no list of elements" and got["cut"].startswith("broken JSON of 28")
    (tmp_path / "x.json").write_text(rows[1][1])
    with _pytest.raises(Exception, match="no feature response"):
        osm.read_osm_features(spark, str(tmp_path)).collect()


def test_a_crowded_cell_is_cut_to_leaves(spark):
    """A city gives the same pairs in small parts, also where many features lie on one spot or on the seams."""
    import random

    rng = random.Random(31)
    boxes = [(i, x := rng.choice([0.5, 0.25, rng.random()]), y := rng.choice([0.5, rng.random()]), x + rng.choice([0, 0.001, 0.01]), y + rng.choice([0, 0.002])) for i in range(600)]
    areas = [(k, a / 3, b / 3, (a + 1) / 3, (b + 1) / 3) for k, (a, b) in enumerate((a, b) for a in range(3) for b in range(3))] + [(99, 0.0, 0.0, 1.0, 1.0), (98, 0.49, 0.49, 0.51, 0.51)]
    f = spark.createDataFrame(boxes, "id int, f_west double, f_south double, f_east double, f_north double")
    r = spark.createDataFrame(areas, "region int, west double, south double, east double, north double")
    want = {(i, k) for i, w, s, e, n in boxes for k, rw, rs, re_, rn in areas if w <= re_ and e >= rw and s <= rn and n >= rs}
    for crowd in (1 << 16, 40, 3):
        pairs = [(p.id, p.region) for p in vectors.region_pairs(f, r, ["region"], crowd).collect()]
        assert len(pairs) == len(set(pairs)) and set(pairs) == want
    cells = vectors._cells(f, F.array(F.lit(0)), "f_west", "f_south", "f_east", "f_north")
    crowded = cells.groupBy("_lv", "_cx", "_cy").count().select("_lv", "_cx", "_cy", F.lit(3).alias("_cut"))
    leaves = vectors._leaves(cells, crowded, "f_west", "f_south", "f_east", "f_north").groupBy("_cx", "_cy", "_sx", "_sy").count()
    assert leaves.agg(F.max("count")).first()[0] < 300 and leaves.count() > 30


def test_pairs_of_features_and_regions_are_not_shuffled(spark):
    f = spark.createDataFrame([("way", i, [(i / 10, i / 10), (i / 10 + 0.3, i / 10 + 0.2)]) for i in range(50)], f"type string, id bigint, geometry {GEOM}")
    r = spark.range(9).selectExpr("id AS region", "CAST(id AS DOUBLE) AS west", "0D AS south", "id + 1D AS east", "5D AS north")
    plan = vectors.features_to_regions(f, r, ["region"])._jdf.queryExecution().executedPlan().toString()
    pairing = [line for line in plan.split("Subquery")[0].splitlines() if "Exchange" in line or "Join" in line]
    assert "Join" in pairing[0]


@pytest.mark.parametrize("listed", [1, 4, 64])
def test_first_regions_are_those_that_dedupe_leaves(spark, listed):
    rng = random.Random(7)
    rows = [("way", i, [(y, x), (y + rng.random(), x + rng.random())]) for i in range(80) for x, y in [(rng.uniform(0, 5), rng.uniform(0, 3))]]
    f = spark.createDataFrame(rows, f"type string, id bigint, geometry {GEOM}")
    parts = [(box, 4 * row + col, col + box / 3, row * 0.5, col + 1 + box / 3, row * 0.5 + 0.5) for box in range(3) for row in range(4) for col in range(4)]
    r = spark.createDataFrame(parts, "box int, idx bigint, west double, south double, east double, north double")
    want = vectors.dedupe_features(vectors.features_to_regions(f, r, ["box", "idx"]), ["idx"], ("box", "type", "id"))
    got = vectors.features_to_first_regions(f, r, ["box"], "idx", listed)
    fields = ["box", "id", "idx", "west", "south", "east", "north", "geometry"]
    assert sorted(map(tuple, got.select(*fields).collect())) == sorted(map(tuple, want.select(*fields).collect()))


def test_earlier_regions_are_looked_through_once_and_last(spark):
    """Lists of regions are no part of the pairs that are looked at, which are many more than those that meet."""
    f = spark.createDataFrame([("way", i, [(i / 10, i / 10), (i / 10 + 0.3, i / 10 + 0.2)]) for i in range(50)], f"type string, id bigint, geometry {GEOM}")
    r = spark.range(9).selectExpr("0 AS box", "id AS idx", "CAST(id % 3 AS DOUBLE) AS west", "CAST(id DIV 3 AS DOUBLE) AS south", "id % 3 + 1D AS east", "id DIV 3 + 1D AS north")
    out = vectors.features_to_first_regions(f, r, ["box"], "idx").select("box", "id", "idx")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    pairing = [line for line in plan.splitlines() if "Join Inner" in line and "_sx" in line]
    assert pairing and all("filter(" not in line and line.count("exists(") == 1 and line.index("f_west") < line.index("exists(") for line in pairing)
    assert not any("exists(" in line for line in plan.splitlines() if "Join" not in line)


def test_first_regions_of_regions_that_come_twice(spark):
    f = spark.createDataFrame([("way", 1, [(0.5, 0.5), (0.6, 1.5)]), ("way", 2, [(0.5, 2.5), (0.5, 2.6)])], f"type string, id bigint, geometry {GEOM}")
    parts = [(k, 2.0 * k % 3, 0.0, 2.0 * k % 3 + 1.0, 1.0) for k in (0, 1, 2, 2, 1)] + [(3, 0.0, 0.0, 3.0, 1.0), (4, None, 0.0, 3.0, 1.0)]
    r = spark.createDataFrame(parts, "idx bigint, west double, south double, east double, north double").selectExpr("7 AS box", "*")
    for listed in (1, 2, 64):
        got = vectors.features_to_first_regions(f, r, ["box"], "idx", listed).select("box", "id", "idx").collect()
        assert sorted(map(tuple, got)) == [(7, 1, 0), (7, 2, 1)]


def test_text_of_responses_is_shuffled_once(spark, tmp_path):
    """Only elements over the end of a split are sent a second time, so what is shuffled is near the size of the files."""
    import json

    from orograph.sources import osm

    for k in range(3):
        elements = [{"type": "way", "id": i, "geometry": [{"lat": i / 7, "lon": i / 3}] * 4, "tags": {"highway": "path"}} for i in range(k, 300, 3)]
        (tmp_path / f"{k}.json").write_text(json.dumps({"elements": elements}))
    features, _ = osm.read_osm_parts(spark, str(tmp_path))
    rows = features.select("type", "id", "geometry", "tags")
    assert sorted(r.id for r in rows.collect()) == list(range(300))
    plan = rows._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [line for line in plan if "Join Inner" in line]
    # pieces meet the facts of their split and nothing else, so what follows needs no other shuffle
    assert joins and all("file#" in line and "split#" in line for line in joins)
    # elements over the end of a split are looked for in files of several splits only
    regrouped = [i for i, line in enumerate(plan) if "Aggregate [file#" in line and "pos#" in line and "split#" not in line.split("]")[0]]
    assert regrouped and all(any("n_splits#" in line and "> 1" in line for line in plan[i:]) for i in regrouped)
