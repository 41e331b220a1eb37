"""Feature, rasterisation, road and building queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from orograph.functions import features as ft
from orograph.functions.heights import vegetation_intensity
from orograph.operators import grids, masks, placement, vectors
from orograph.session import shared_folder
from orograph.sources import gazetteer, osm, shapes

from .base import K, KIND_SQL, SIDE, boxes, deal, features, fx, line_cte, polygon_cte, q6, query, r6, recursive, table, with_ctes
from .rasters import SPLIT
from .scalars import BRIDGE_SQL, FLOORS_SQL, HEIGHT_SQL, INTENSITY, LAYER_SQL, MINLEVEL_SQL, ROOF_SQL, WIDTH_SQL

FEAT = ("tags", "feat", "ring", "ring_px")
SHEET = ["sheet"]


@query("line_segments", with_ctes("ring") + f"""SELECT a.sheet, a.fid AS id, CAST(a.ord AS INTEGER) AS seg, {q6('a.lat')} AS lat1, {q6('a.lon')} AS lon1,
  {q6('b.lat')} AS lat2, {q6('b.lon')} AS lon2 FROM ring a JOIN ring b ON a.fid = b.fid AND b.ord = a.ord + 1""")
def _(spark, sf):
    out = vectors.line_segments(features(spark, sf).select("sheet", "id", "geometry"))
    return out.select("sheet", "id", "seg", *[r6(c).alias(c) for c in ("lat1", "lon1", "lat2", "lon2")])


@query("scanline_spans", with_ctes(*FEAT, **polygon_cte("po", "true")) + "SELECT sheet, fid AS id, y, x_from, x_to FROM po_sp WHERE x_from <= x_to")
def _(spark, sf):
    shaped = features(spark, sf).select("sheet", "id", *vectors.BOUNDS, "geometry")
    edges = vectors.pixel_segments(vectors.line_segments(shaped, close=True), SIDE, SIDE)
    return vectors.scanline_spans(vectors.scanline_crossings(edges), ["sheet", "id"], SIDE)


@query("rasterize_polygons", with_ctes(*FEAT, **polygon_cte("po", KIND_SQL["buildings"])) + "SELECT sheet, x, y, 255 AS v FROM po")
def _(spark, sf):
    part = features(spark, sf).filter(vectors.tag_filter("buildings"))
    return vectors.rasterize_polygons(part, SHEET, ["id"], SIDE, SIDE)


@query("rasterize_lines", recursive(with_ctes(*FEAT, **line_cte("li", KIND_SQL["roads"], "1e0"))) + "SELECT sheet, x, y, 255 AS v FROM li")
def _(spark, sf):
    return vectors.rasterize_lines(features(spark, sf).filter(vectors.tag_filter("roads")), SHEET, SIDE, SIDE, 3)


@query("union_mask_pixels", recursive(with_ctes(*FEAT, **polygon_cte("po", KIND_SQL["water"]), **line_cte("li", KIND_SQL["roads"], "0.5e0")))
       + "SELECT sheet, x, y FROM po UNION SELECT sheet, x, y FROM li")
def _(spark, sf):
    f = features(spark, sf)
    water = vectors.rasterize_polygons(f.filter(vectors.tag_filter("water")), SHEET, ["id"], SIDE, SIDE)
    roads = vectors.rasterize_lines(f.filter(vectors.tag_filter("roads")), SHEET, SIDE, SIDE, 2)
    return vectors.union_mask_pixels([water, roads], SHEET)


@query("feature_extent", with_ctes("ring") + f"""SELECT sheet, {q6('min(lon)')} AS min_x, {q6('max(lon)')} AS max_x, {q6('min(lat)')} AS min_y, {q6('max(lat)')} AS max_y
  FROM ring GROUP BY sheet""")
def _(spark, sf):
    out = vectors.feature_extent(features(spark, sf), SHEET)
    return out.select("sheet", *[r6(c).alias(c) for c in ("min_x", "max_x", "min_y", "max_y")])


RECORDS = ["user_id AS file_id", "event_id", "CAST(CASE event_id % 8 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 5 WHEN 3 THEN 1 WHEN 4 THEN 8 WHEN 5 THEN 31 ELSE 5 END AS INT) AS shape_type"]


@query("unsupported_shape_counts", f"WITH r AS (SELECT {', '.join(RECORDS)} FROM events), " + """c AS (SELECT file_id, shape_type, count(*) AS n FROM r WHERE shape_type NOT IN (0, 1, 3, 5) GROUP BY ALL)
  SELECT *, CAST(sum(n) OVER w AS BIGINT) AS total_skipped, (SELECT string_agg(CAST(d.shape_type AS VARCHAR), ', ' ORDER BY d.shape_type) FROM c d WHERE d.file_id = c.file_id) AS types FROM c
  WINDOW w AS (PARTITION BY file_id)""")
def _(spark, sf):
    return vectors.unsupported_shape_counts(table(spark, sf, "events").selectExpr(*RECORDS), ["file_id"])


# Response documents of 500 features; relations carry their geometry in two members.
OSM_SQL = with_ctes("tags", "feat", "ring") + f"""SELECT f.type, f.fid AS id, CAST(r.ord AS INTEGER) AS ord, {q6('r.lat')} AS lat, {q6('r.lon')} AS lon,
  coalesce(f.highway, '') AS highway FROM ring r JOIN feat f USING (fid)"""


def responses(spark, sf):
    g = F.col("geometry")
    empty = F.lit(None).cast(osm._POINTS)
    relation = F.col("type") == "relation"
    member = [F.struct(F.lit("way").alias("type"), p.alias("geometry")) for p in (F.slice(g, 1, 2), empty, F.slice(g, 3, 1))]
    element = F.struct(
        "type", "id", F.when(relation, F.slice(g, 4, 1)).otherwise(g).alias("geometry"), F.when(relation, F.array(*member)).alias("members"),
        F.when(F.size("tags") > 0, F.col("tags")).alias("tags"),
    )
    node = F.struct(F.lit("node").alias("type"), F.lit(1).cast("bigint").alias("id"), empty.alias("geometry"),
                    F.lit(None).cast(f"array<struct<type: string, geometry: {osm._POINTS}>>").alias("members"), F.lit(None).cast("map<string,string>").alias("tags"))
    docs = features(spark, sf).groupBy(F.floor(F.col("id") / 500).alias("doc")).agg(F.collect_list(element).alias("e"))
    return docs.select("doc", F.to_json(F.struct(F.concat(F.array(node), F.col("e")).alias("elements"))).alias("body"))


def listed_points(parsed):
    points = parsed.select("type", "id", F.coalesce(ft.tag("tags", "highway"), F.lit("")).alias("highway"), F.posexplode("geometry").alias("ord", "p"))
    return points.select("type", "id", "ord", r6("p.lat").alias("lat"), r6("p.lon").alias("lon"), "highway")


@query("read_osm_features", OSM_SQL)
def _(spark, sf):
    return listed_points(osm.parse_osm_json(responses(spark, sf)))


@query("read_osm_parts", OSM_SQL)
def _(spark, sf):
    """The same documents as files, cut at braces and parsed by many tasks."""
    path = f"{shared_folder(spark)}/responses/{uuid.uuid4().hex}"
    responses(spark, sf).repartition("doc").write.partitionBy("doc").text(path)
    return listed_points(osm.read_osm_parts(spark, path)[0])


PLACES = [f"{K} AS query_id", f"{K} * 3 AS place_id", "c_name AS display_name", f"CONCAT(CAST(({K} % 170) / 4 AS VARCHAR(20)), CASE WHEN {K} % 5 = 0 THEN ' N' ELSE '' END) AS lat",
          f"CASE WHEN {K} % 7 = 0 THEN 'east' ELSE CAST(({K} % 350) / 8 AS VARCHAR(20)) END AS lon", f"CAST(({K} % 170) / 4 - 1 AS VARCHAR(20)) AS b0",
          f"CAST(({K} % 170) / 4 + 1 AS VARCHAR(20)) AS b1"]


@query("read_gazetteer", f"WITH p AS (SELECT {', '.join(PLACES)} FROM customer) " + """SELECT query_id, place_id, display_name,
  TRY_CAST(regexp_extract(lat, '^([-+]?[0-9.]+)', 1) AS DOUBLE) AS latitude, TRY_CAST(lon AS DOUBLE) AS longitude,
  TRY_CAST(b0 AS DOUBLE) AS south, TRY_CAST(b1 AS DOUBLE) AS north FROM p""")
def _(spark, sf):
    p = table(spark, sf, "customer").selectExpr(*PLACES)
    doc = F.struct("place_id", "display_name", "lat", "lon", F.lit("city").alias("type"), F.lit("place").alias("class"), F.array("b0", "b1", "b0", "b1").alias("boundingbox"))
    rows = gazetteer.parse_gazetteer(p.select("query_id", F.to_json(doc).alias("body")))
    return rows.select("query_id", "place_id", "display_name", "latitude", "longitude", F.get("bounding_box", F.lit(0)).alias("south"), F.get("bounding_box", F.lit(1)).alias("north"))


@query("top_suggestions", """SELECT c_nationkey, c_custkey, CAST(rn AS INTEGER) AS rank FROM (SELECT c_nationkey, c_custkey,
  row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn <= 5""")
def _(spark, sf):
    out = gazetteer.top_suggestions(table(spark, sf, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")])
    return out.select("c_nationkey", "c_custkey", "rank")


# Shapes: lines of 1 to 4 points per ring, polygons, and a null shape.

RING_TYPE = "CASE {k} % 4 WHEN 0 THEN 3 WHEN 1 THEN 5 WHEN 2 THEN 1 ELSE 0 END"
SHAPE_PIECE = 2


@query("shape_rings_to_features", with_ctes("ring", v=f"""SELECT fid, {RING_TYPE.format(k='fid')} AS shape_type, CASE WHEN ord = 3 THEN 1 ELSE 0 END AS ring,
    CASE WHEN ord = 3 THEN 0 ELSE ord END AS o, CAST(round(lon * 255) AS BIGINT) AS x FROM ring""",
    s="SELECT *, count(*) OVER (PARTITION BY fid, ring) AS n FROM v",
    f=f"""SELECT fid, shape_type, CASE shape_type WHEN 5 THEN 0 WHEN 1 THEN o ELSE ring END AS part, CASE WHEN shape_type = 3 THEN 0 ELSE ring END AS rg,
      CASE WHEN shape_type = 1 THEN 0 ELSE (o - o % {SHAPE_PIECE}) // {SHAPE_PIECE} END AS piece, o, x FROM s WHERE shape_type IN (1, 5) OR (shape_type = 3 AND n >= 2)""")
       + """SELECT fid AS id, shape_type, CAST(part AS BIGINT) AS part, CAST(rg AS BIGINT) AS ring, CAST(piece AS BIGINT) AS piece, string_agg(CAST(x AS VARCHAR), ',' ORDER BY o) AS xs
  FROM f GROUP BY ALL""")
def _(spark, sf):
    kind = F.when(F.col("id") % 4 == 0, F.lit(3)).when(F.col("id") % 4 == 1, F.lit(5)).when(F.col("id") % 4 == 2, F.lit(1)).otherwise(F.lit(0)).alias("shape_type")
    listed = features(spark, sf).select("id", kind, F.posexplode("geometry").alias("at", "p"))
    last = F.col("at") == 3
    v = listed.select(
        "id", "shape_type", F.when(last, 1).otherwise(0).alias("ring"), F.when(last, 0).otherwise(F.col("at")).alias("ord"), F.col("p.lon").alias("x"), F.col("p.lat").alias("y"),
    )
    out = shapes.shape_rings_to_features(v, ["id"], SHAPE_PIECE)
    xs = F.array_join(F.transform("points", lambda p: F.round(p[0] * 255).cast("bigint").cast("string")), ",")
    return out.select("id", "shape_type", "part", "ring", "piece", xs.alias("xs"))


# Short lines all over the world, and the boxes they may meet.
WORLD = {"wf": "SELECT point_id AS id, lon, lat, lon + (point_id % 13) / 20e0 AS lon2, lat + (point_id % 7) / 10e0 AS lat2 FROM points"}


def world(spark, sf):
    p = deal(fx(spark, sf, "points"), "point_id")
    far = F.struct((F.col("lat") + F.col("point_id") % 7 / 10).alias("lat"), (F.col("lon") + F.col("point_id") % 13 / 20).alias("lon"))
    return p.select(F.lit("way").alias("type"), F.col("point_id").alias("id"), F.array(F.struct("lat", "lon"), far).alias("geometry"), F.col("zoom").alias("tag"))


MEETS = "f.lon <= r.east AND f.lon2 >= r.west AND f.lat <= r.north AND f.lat2 >= r.south"


@query("features_to_regions", with_ctes("points", "boxes", "valid_boxes", **WORLD) + f"SELECT f.id, r.box_id FROM wf f JOIN valid_boxes r ON {MEETS}")
def _(spark, sf):
    return vectors.features_to_regions(world(spark, sf), boxes(spark, sf), ["box_id"]).select("id", "box_id")


def regioned(spark, sf):
    regions = grids.split_bounds(boxes(spark, sf)).select("box_id", "region_idx", *vectors.BOUNDS)
    return vectors.features_to_regions(world(spark, sf), regions, ["box_id", "region_idx"]).withColumn("pos", F.col("id"))


REGIONED = {**SPLIT, **WORLD, "fr": f"SELECT f.id, r.box_id, r.region_idx FROM wf f JOIN parts r ON {MEETS}"}
REC = "WITH RECURSIVE " + with_ctes("points", "boxes", "valid_boxes", **REGIONED)[5:]


@query("union_regions", REC + "SELECT box_id, region_idx, id FROM fr")
def _(spark, sf):
    both = regioned(spark, sf).select("box_id", "region_idx", "id")
    return vectors.union_regions([both.filter("region_idx % 2 = 0"), both.filter("region_idx % 2 = 1")])


@query("dedupe_features", REC + "SELECT box_id, id, min(region_idx) AS region_idx FROM fr GROUP BY ALL")
def _(spark, sf):
    regions = grids.split_bounds(boxes(spark, sf)).select("box_id", "region_idx", *vectors.BOUNDS)
    return vectors.features_to_first_regions(world(spark, sf), regions, ["box_id"], "region_idx").select("box_id", "id", "region_idx")


@query("feature_counts", with_ctes("tags", "feat") + " UNION ALL ".join(
    f"SELECT sheet, '{k}' AS kind, count(*) AS feature_count FROM feat WHERE {w} GROUP BY sheet" for k, w in KIND_SQL.items()))
def _(spark, sf):
    f = features(spark, sf)
    kinds = F.filter(F.array(*[F.when(vectors.tag_filter(k), F.lit(k)) for k in KIND_SQL]), lambda k: k.isNotNull())
    return vectors.feature_counts(f.select("sheet", F.explode(kinds).alias("kind")), ["sheet", "kind"])


@query("extract_buildings", with_ctes("tags", "feat") + f"""SELECT fid AS id, 4 AS n_points, {HEIGHT_SQL} AS height, {FLOORS_SQL} AS floors, {MINLEVEL_SQL} AS min_level, {ROOF_SQL} AS roof_shape
  FROM feat WHERE {KIND_SQL['buildings']}""")
def _(spark, sf):
    out = placement.extract_buildings(features(spark, sf).filter(vectors.tag_filter("buildings")), F.lit(10.0))
    return out.select("id", F.size("footprint").alias("n_points"), "height", "floors", "min_level", "roof_shape")


@query("extract_roads", with_ctes("tags", "feat") + f"""SELECT fid AS id, {WIDTH_SQL} AS width, coalesce(surface, '') AS surface, highway, bridge, {LAYER_SQL} AS layer
  FROM feat WHERE {KIND_SQL['roads']}""")
def _(spark, sf):
    out = placement.extract_roads(features(spark, sf).filter(vectors.tag_filter("roads")))
    return out.select("id", "width", "surface", "highway", "bridge", "layer")


# Local metres of the vertices of a sheet of 4000 by 3000 m, and its neighbours in the ring.
LOCAL = {"lo": "SELECT sheet, fid, ord, lon * 4000e0 - 2000e0 AS x, lat * 3000e0 - 1500e0 AS z FROM ring"}
RIBBON = {
    "nb": "SELECT *, coalesce(lag(x) OVER w, x) AS bx, coalesce(lag(z) OVER w, z) AS bz, coalesce(lead(x) OVER w, x) AS ax, coalesce(lead(z) OVER w, z) AS az FROM lo WINDOW w AS (PARTITION BY fid ORDER BY ord)",
    "un": "SELECT *, sqrt((ax - bx) * (ax - bx) + (az - bz) * (az - bz)) AS len FROM nb",
    "dir": "SELECT *, CASE WHEN len < 1e-10 THEN 1e0 ELSE (ax - bx) / len END AS ux, CASE WHEN len < 1e-10 THEN 0e0 ELSE (az - bz) / len END AS uz FROM un",
    "rb": f"""SELECT d.*, f.highway, {LAYER_SQL} AS layer, {BRIDGE_SQL} AS rise, coalesce(nullif({WIDTH_SQL}, 0), 6) / 2 AS half
      FROM dir d JOIN feat f USING (fid) WHERE {KIND_SQL['roads']}""",
}


def placed(spark, sf, extract, kind):
    f = features(spark, sf).filter(vectors.tag_filter(kind))
    sheet = F.col("sheet")
    return extract(f).withColumns({
        "width_m": F.lit(4000.0), "height_m": F.lit(3000.0), "offset_x": sheet * 4000.0, "offset_z": sheet * 100.0,
        "elev_min": sheet * 10.0, "elev_max": sheet * 10.0 + 120.0,
    })


@query("footprint_centroid", with_ctes("tags", "feat", "ring", **LOCAL) + f"""SELECT fid AS id, {q6('avg(x)')} AS cx, {q6('avg(z)')} AS cz FROM lo JOIN feat USING (fid)
  WHERE {KIND_SQL['buildings']} GROUP BY fid""")
def _(spark, sf):
    b = placed(spark, sf, lambda f: placement.extract_buildings(f, F.lit(10.0)), "buildings")
    b = b.withColumn("points", placement.local_points("footprint"))
    cx, cz = placement.footprint_centroid("points")
    return b.select("id", r6(cx).alias("cx"), r6(cz).alias("cz"))


@query("building_footprints_local", with_ctes("tags", "feat", "ring", **LOCAL, ce="SELECT fid, avg(x) AS cx, avg(z) AS cz FROM lo GROUP BY fid") + f"""SELECT fid AS id, CAST(ord AS INTEGER) AS pos,
  {q6('x + l.sheet * 4000e0')} AS x, {q6('z + l.sheet * 100e0')} AS z,
  {q6(f'''(l.sheet * 10e0 + 120e0 * ((greatest(0e0, least(1e0, (cx + 2000e0) / 4000e0)) + greatest(0e0, least(1e0, (cz + 1500e0) / 3000e0))) / 2e0)) * 1.5e0
    + {MINLEVEL_SQL} * 3e0 + {HEIGHT_SQL}''')} AS base_y FROM lo l JOIN feat f USING (fid) JOIN ce USING (fid) WHERE {KIND_SQL['buildings']}""")
def _(spark, sf):
    b = placed(spark, sf, lambda f: placement.extract_buildings(f, F.lit(10.0)), "buildings")
    return placement.building_footprints_local(b).select("id", "pos", *[r6(c).alias(c) for c in ("x", "z", "base_y")])


@query("road_ribbon_edges", with_ctes("tags", "feat", "ring", **LOCAL, **RIBBON) + f"""SELECT fid AS id, CAST(ord AS INTEGER) AS pos, {q6('x - uz * half')} AS left_x,
  {q6('z + ux * half')} AS left_z, {q6('x + uz * half')} AS right_x, {q6('z - ux * half')} AS right_z FROM rb""")
def _(spark, sf):
    r = placed(spark, sf, placement.extract_roads, "roads")
    r = r.select("id", "width", placement.local_points("centerline").alias("points"))
    out = placement.road_ribbon_edges(r)
    return out.select("id", "pos", *[r6(c).alias(c) for c in ("left_x", "left_z", "right_x", "right_z")])


@query("road_ribbons", with_ctes("tags", "feat", "ring", **LOCAL, **RIBBON) + f"""SELECT fid AS id, CAST(ord AS INTEGER) AS pos, {q6('x - uz * half + sheet * 4000e0')} AS left_x,
  {q6('z - ux * half + sheet * 100e0')} AS right_z, {q6('(sheet * 10e0 + sheet * 10e0 + 120e0) / 2e0 * 1.5e0 + 0.1e0 + rise')} AS y,
  CASE highway WHEN 'motorway' THEN 0.15e0 WHEN 'primary' THEN 0.25e0 WHEN 'secondary' THEN 0.25e0 ELSE 0.35e0 END AS red FROM rb""")
def _(spark, sf):
    out = placement.road_ribbons(placed(spark, sf, placement.extract_roads, "roads"))
    return out.select("id", "pos", *[r6(c).alias(c) for c in ("left_x", "right_z", "y")], "red")


# --- masks ----------------------------------------------------------------------------------

# Vegetation, water and road pixels on a common grid, from the land-cover pixels.
COVER = {
    "veg": f"SELECT tile_row, tile_col, x, y, {INTENSITY} AS v FROM landcover WHERE {INTENSITY} > 0",
    "wat": "SELECT tile_row, tile_col, x, y FROM landcover WHERE (x * 3 + y) % 5 = 0",
    "roa": "SELECT tile_row, tile_col, x, y FROM landcover WHERE x = y OR x + y = 49",
    "hasw": "SELECT DISTINCT tile_row, tile_col FROM landcover WHERE (tile_row + tile_col) % 3 <> 1",
    "hasr": "SELECT DISTINCT tile_row, tile_col FROM landcover WHERE tile_row % 2 = 0",
}
TK = ["tile_row", "tile_col"]


def cover_masks(spark, sf):
    c = fx(spark, sf, "landcover").select(*TK, "x", "y", vegetation_intensity("cls").alias("v"))
    def painted(cond):
        return c.filter(cond).withColumn("v", F.lit(255))
    tiles = c.select(*TK).distinct()
    return (c.filter("v > 0"), painted("(x * 3 + y) % 5 = 0"), painted("x = y OR x + y = 49"),
            tiles.filter("(tile_row + tile_col) % 3 <> 1"), tiles.filter("tile_row % 2 = 0"))


@query("subtract_masks", with_ctes("landcover", **COVER) + """SELECT v.* FROM veg v WHERE NOT (EXISTS (SELECT 1 FROM hasw h WHERE h.tile_row = v.tile_row AND h.tile_col = v.tile_col)
  AND (EXISTS (SELECT 1 FROM wat w WHERE w.tile_row = v.tile_row AND w.tile_col = v.tile_col AND w.x = v.x AND w.y = v.y)
    OR (EXISTS (SELECT 1 FROM hasr h WHERE h.tile_row = v.tile_row AND h.tile_col = v.tile_col)
      AND EXISTS (SELECT 1 FROM roa w WHERE w.tile_row = v.tile_row AND w.tile_col = v.tile_col AND w.x = v.x AND w.y = v.y))))""")
def _(spark, sf):
    veg, water, road, water_tiles, road_tiles = cover_masks(spark, sf)
    return masks.subtract_masks(veg, water, road, TK, water_tiles, road_tiles)


@query("mask_clear_counts", with_ctes("landcover", **COVER) + """SELECT h.tile_row, h.tile_col,
  (SELECT count(*) FROM wat w WHERE w.tile_row = h.tile_row AND w.tile_col = h.tile_col) AS water_cleared,
  (SELECT count(*) FROM roa w WHERE w.tile_row = h.tile_row AND w.tile_col = h.tile_col) AS road_cleared FROM hasw h""")
def _(spark, sf):
    veg, water, road, water_tiles, _ = cover_masks(spark, sf)
    return masks.mask_clear_counts(veg, water, road, TK, water_tiles)


SAT = {"sat": f"SELECT tile_row * 2 + tile_col AS sheet, x, y, {INTENSITY} AS v FROM landcover"}


@query("vegetation_source_fallback", with_ctes("landcover", *FEAT, **SAT, **polygon_cte("po", KIND_SQL["vegetation"])) + """SELECT sheet, x, y, v, 'satellite' AS origin FROM sat
  UNION ALL SELECT sheet, x, y, 255, 'features' FROM po WHERE sheet NOT IN (SELECT sheet FROM sat)""")
def _(spark, sf):
    sat = fx(spark, sf, "landcover").select((F.col("tile_row") * 2 + F.col("tile_col")).alias("sheet"), "x", "y", vegetation_intensity("cls").alias("v"))
    drawn = masks.feature_mask(features(spark, sf), "vegetation", SHEET, ["id"], SIDE, SIDE)
    return masks.vegetation_with_fallback(sat, drawn, sat, SHEET)
