"""Catalogs, mosaics, crops, resampling and surface operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from orograph.functions import geo, heights
from orograph.operators import grids, masks, mosaic, resample, surface
from orograph.sources import catalogs, r16

from .base import GX, GY, K, TILE, boxes, deal, div, fx, q6, query, r6, table, with_ctes
from .scalars import INTENSITY, zoom_sql

TILE_KEYS = ["tile_row", "tile_col"]
SIDES = ("west", "south", "east", "north")


def world_y(side):
    return f"((1e0 - ln(tan(radians({side})) + 1e0 / cos(radians({side}))) / pi()) / 2e0)"


RANGE_SQL = f"""SELECT *, CAST(floor((west + 180e0) / 360e0 * pow(2e0, z)) AS BIGINT) AS min_x, CAST(floor((east + 180e0) / 360e0 * pow(2e0, z)) AS BIGINT) AS max_x,
  CAST(floor({world_y('north')} * pow(2e0, z)) AS BIGINT) AS min_y, CAST(floor({world_y('south')} * pow(2e0, z)) AS BIGINT) AS max_y FROM zb"""
CATALOG = {
    "zb": f"SELECT *, CAST({zoom_sql(512, 15)} AS INTEGER) AS z FROM valid_boxes",
    "rg": RANGE_SQL,
    "tx": "SELECT *, unnest(range(min_x, max_x + 1)) AS tile_x FROM rg",
    "cat": "SELECT *, unnest(range(min_y, max_y + 1)) AS tile_y FROM tx",
}


def catalog(spark, sf):
    return catalogs.tile_catalog(boxes(spark, sf), geo.choose_zoom(*SIDES, F.lit(512), geo.ELEVATION_MAX_ZOOM))


@query("tile_catalog", with_ctes("boxes", "valid_boxes", **CATALOG) + "SELECT box_id, z, tile_x, tile_y FROM cat")
def _(spark, sf):
    return catalog(spark, sf).select("box_id", "z", "tile_x", "tile_y")


def name_sql(lat, lon, gap):
    return (f"CASE WHEN {lat} >= 0 THEN 'N' ELSE 'S' END || lpad(CAST(abs({lat}) AS VARCHAR), 2, '0') || '{gap}' || "
            f"CASE WHEN {lon} >= 0 THEN 'E' ELSE 'W' END || lpad(CAST(abs({lon}) AS VARCHAR), 3, '0')")


@query("degree_tile_catalog", with_ctes("boxes", "valid_boxes", a="SELECT *, unnest(range(CAST(floor(west) AS BIGINT), CAST(floor(east) AS BIGINT) + 1)) AS tile_lon FROM valid_boxes",
       b="SELECT *, unnest(range(CAST(floor(south) AS BIGINT), CAST(floor(north) AS BIGINT) + 1)) AS tile_lat FROM a")
       + f"SELECT box_id, tile_lat, tile_lon, {name_sql('tile_lat', 'tile_lon', '_00_')} AS tile_name FROM b")
def _(spark, sf):
    return catalogs.degree_tile_catalog(boxes(spark, sf)).select("box_id", "tile_lat", "tile_lon", "tile_name")


COVER = {
    "ca": "SELECT *, unnest(range(CAST(floor(west / 3) * 3 AS BIGINT), CAST(ceil(east / 3) * 3 AS BIGINT), 3)) AS tile_lon FROM valid_boxes",
    "cb": "SELECT *, unnest(range(CAST(floor(south / 3) * 3 AS BIGINT), CAST(ceil(north / 3) * 3 AS BIGINT), 3)) AS tile_lat FROM ca",
}


@query("landcover_tile_catalog", with_ctes("boxes", "valid_boxes", **COVER)
       + f"SELECT box_id, tile_lat, tile_lon, {name_sql('tile_lat', 'tile_lon', '')} AS tile_name FROM cb")
def _(spark, sf):
    return catalogs.landcover_tile_catalog(boxes(spark, sf)).select("box_id", "tile_lat", "tile_lon", "tile_name")


@query("mosaic_extent", with_ctes("boxes", "valid_boxes", **COVER) + """SELECT box_id, min(tile_lon) AS west, min(tile_lat) AS south, max(tile_lon) + 3 AS east,
  max(tile_lat) + 3 AS north, CAST(floor((max(tile_lon) + 3 - min(tile_lon)) * 12000e0 + 0.5e0) AS BIGINT) AS mosaic_w,
  CAST(floor((max(tile_lat) + 3 - min(tile_lat)) * 12000e0 + 0.5e0) AS BIGINT) AS mosaic_h FROM cb GROUP BY box_id""")
def _(spark, sf):
    tiles = catalogs.landcover_tile_catalog(boxes(spark, sf)).select("box_id", "tile_lat", "tile_lon")
    return mosaic.mosaic_extent(tiles, ["box_id"], 36000)


# Expected values, written out from the format and not from the library.
REGISTRY = """(VALUES ('aws-terrarium', 'AWS Terrain Tiles (Terrarium)', 'Mapzen / AWS', NULL, false), ('mapzen', 'Mapzen Terrain Tiles', 'Mapzen', NULL, false),
  ('mapbox-terrain-rgb', 'Mapbox Terrain RGB', 'Mapbox', NULL, true), ('opentopo-srtmgl1', 'SRTM GL1 (30m)', 'NASA / OpenTopography', 'SRTMGL1', true),
  ('opentopo-srtmgl3', 'SRTM GL3 (90m)', 'NASA / OpenTopography', 'SRTMGL3', true), ('opentopo-aw3d30', 'ALOS World 3D (30m)', 'JAXA / OpenTopography', 'AW3D30', true),
  ('opentopo-cop30', 'Copernicus GLO-30', 'ESA / OpenTopography', 'COP30', true), ('opentopo-nasadem', 'NASADEM (30m)', 'NASA / OpenTopography', 'NASADEM', true),
  ('opentopo-usgs10m', 'USGS 3DEP (10m)', 'USGS / OpenTopography', 'USGS10m', true), ('nasa-earthdata', 'Copernicus GLO-30 (30m) via AWS', 'ESA / Copernicus', NULL, false)
) r(source_id, name, attribution, dataset, needs_key)"""


@query("source_registry", with_ctes("boxes") + f"""SELECT box_id, dem_source, name, attribution, CAST(dataset AS VARCHAR) AS dataset, needs_key,
  CASE WHEN source_id IS NULL THEN 'unknown source: ' || dem_source END AS source_error FROM boxes LEFT JOIN {REGISTRY} ON dem_source = source_id""")
def _(spark, sf):
    return catalogs.describe_sources(fx(spark, sf, "boxes").select("box_id", "dem_source"), "dem_source", "elevation")


@query("tile_request_manifest", with_ctes("boxes", "valid_boxes", **CATALOG) + """SELECT box_id, tile_x, tile_y,
  CASE imagery_source WHEN 'arcgis' THEN 'https://server.arcgisonline.com/ArcGIS/rest/services/World_Imagery/MapServer/tile/' || z || '/' || tile_y || '/' || tile_x
    WHEN 'mapbox' THEN 'https://api.mapbox.com/v4/mapbox.satellite/' || z || '/' || tile_x || '/' || tile_y || '@2x.png?access_token=k+' || box_id || '%26'
    ELSE 'https://api.maptiler.com/tiles/satellite/' || z || '/' || tile_x || '/' || tile_y || '.jpg?key=k+' || box_id || '%26' END AS image_url,
  CASE WHEN dem_source IN ('aws-terrarium', 'mapzen') THEN 'https://s3.amazonaws.com/elevation-tiles-prod/terrarium/' || z || '/' || tile_x || '/' || tile_y || '.png'
    WHEN dem_source = 'mapbox-terrain-rgb' THEN 'https://api.mapbox.com/v4/mapbox.terrain-rgb/' || z || '/' || tile_x || '/' || tile_y || '@2x.pngraw?access_token=k+' || box_id || '%26'
    END AS height_url FROM cat""")
def _(spark, sf):
    images = catalogs.tile_request_manifest(catalog(spark, sf), "imagery_source", "imagery", "api_key").withColumnRenamed("url", "image_url")
    return catalogs.tile_request_manifest(images, "dem_source", "elevation", "api_key").select(
        "box_id", "tile_x", "tile_y", "image_url", F.col("url").alias("height_url")
    )


@query("other_request_manifest", with_ctes("boxes", "valid_boxes", **COVER, k="SELECT * FROM cb") + f"""SELECT box_id, tile_lat, tile_lon,
  'https://copernicus-dem-30m.s3.eu-central-1.amazonaws.com/Copernicus_DSM_COG_10_' || n || '_00_DEM/Copernicus_DSM_COG_10_' || n || '_00_DEM.tif' AS degree_url,
  'https://esa-worldcover.s3.eu-central-1.amazonaws.com/v200/2021/map/ESA_WorldCover_10m_2021_v200_' || m || '_Map.tif' AS cover_url,
  split_part(box, '&south', 1) AS box_start FROM (SELECT *, {name_sql('tile_lat', 'tile_lon', '_00_')} AS n, {name_sql('tile_lat', 'tile_lon', '')} AS m,
  'https://portal.opentopography.org/API/globaldem?demtype=' || upper(dem_source) || '&south' AS box FROM k)""")
def _(spark, sf):
    cover = catalogs.landcover_tile_catalog(boxes(spark, sf))
    degree = catalogs.hemisphere_name("tile_lat", "tile_lon")
    return cover.select(
        "box_id", "tile_lat", "tile_lon", catalogs.degree_tile_url(degree).alias("degree_url"), catalogs.landcover_tile_url("tile_name").alias("cover_url"),
        F.split_part(catalogs.box_url(F.upper("dem_source"), "api_key"), F.lit("&south"), F.lit(1)).alias("box_start"),
    )


# Tiles whose download failed, and single pixels that are absent.
FAILED = "(tile_row * 3 + tile_col) % 4 = 0"
MISSING = f"({FAILED} OR (x * 7 + y) % 11 = 0)"


@query("fetch_outcome_fill", with_ctes("dem", cat="SELECT DISTINCT tile_row, tile_col FROM dem") + f"""SELECT tile_row, tile_col, x, y, coalesce(z, 0e0) AS z, z IS NOT NULL AS fetched
  FROM (SELECT c.tile_row, c.tile_col, x.x, y.y FROM cat c, range({TILE}) x(x), range({TILE}) y(y)) s
  LEFT JOIN (SELECT * FROM dem WHERE NOT {MISSING}) d USING (tile_row, tile_col, x, y)""")
def _(spark, sf):
    dem = fx(spark, sf, "dem")
    got = dem.filter(f"NOT ({MISSING})").select(*TILE_KEYS, "x", "y", "z")
    return catalogs.fetch_outcome_fill(dem.select(*TILE_KEYS), got, TILE_KEYS, TILE, TILE, {"z": 0.0})


RGBA = [f"{div(GY, TILE)} AS tile_row", f"{div(GX, TILE)} AS tile_col", f"({GX}) % {TILE} AS x", f"({GY}) % {TILE} AS y",
        "CAST(128 + event_id % 4 AS INT) AS r", "CAST((event_id * 7) % 256 AS INT) AS g", "CAST((event_id * 13) % 256 AS INT) AS b", "CAST(200 AS INT) AS a"]


@query("fetch_outcome_fill_imagery", f"WITH img AS (SELECT {', '.join(RGBA)} FROM events)" + f""", cat AS (SELECT DISTINCT tile_row, tile_col FROM img)
  SELECT tile_row, tile_col, x, y, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b, coalesce(a, 255) AS a, a IS NOT NULL AS fetched
  FROM (SELECT c.tile_row, c.tile_col, x.x, y.y FROM cat c, range({TILE}) x(x), range({TILE}) y(y)) s
  LEFT JOIN (SELECT * FROM img WHERE NOT {MISSING}) d USING (tile_row, tile_col, x, y)""")
def _(spark, sf):
    img = table(spark, sf, "events").selectExpr(*RGBA)
    return catalogs.fetch_outcome_fill(img.select(*TILE_KEYS), img.filter(f"NOT ({MISSING})"), TILE_KEYS, TILE, TILE, {"r": 0, "g": 0, "b": 0, "a": 255})


@query("fetch_outcome_counts", with_ctes("dem") + f"""SELECT tile_row, count(*) FILTER (WHERE NOT {FAILED}) AS n_success, count(*) FILTER (WHERE {FAILED}) AS n_failed
  FROM (SELECT DISTINCT tile_row, tile_col FROM dem) GROUP BY tile_row""")
def _(spark, sf):
    tiles = fx(spark, sf, "dem").select(*TILE_KEYS).distinct().withColumn("success", F.expr(f"NOT ({FAILED})"))
    return catalogs.fetch_counts(tiles, ["tile_row"])


# Ten rows of tiles make one mosaic.
MOSAIC = div("tile_row", 10)


def mosaic_inputs(spark, sf, value):
    dem = fx(spark, sf, "dem" if value == "z" else "landcover").withColumn("mosaic", F.expr(MOSAIC))
    cat = dem.select("mosaic", *TILE_KEYS).distinct()
    corner = cat.groupBy("mosaic").agg(F.min("tile_col").alias("min_x"), F.min("tile_row").alias("min_y"))
    return dem, cat.join(corner, "mosaic")


@query("mosaic_tiles", with_ctes("dem") + f"""SELECT {MOSAIC} AS mosaic, tile_col * {TILE} + x AS x, tile_row * {TILE} + y - ({MOSAIC}) * 500 AS y,
  CASE WHEN z IS NULL OR {MISSING} THEN 0e0 ELSE z END AS z
  FROM (SELECT c.tile_row, c.tile_col, a.x, b.y FROM (SELECT DISTINCT tile_row, tile_col FROM dem) c, range({TILE}) a(x), range({TILE}) b(y)) s LEFT JOIN dem USING (tile_row, tile_col, x, y)""")
def _(spark, sf):
    dem, cat = mosaic_inputs(spark, sf, "z")
    got = dem.filter(f"NOT ({MISSING})").select("mosaic", *TILE_KEYS, "x", "y", "z")
    return mosaic.mosaic_tiles(got, cat, ["mosaic"], TILE, TILE, {"z": 0.0}, "tile_col", "tile_row")


@query("mosaic_overlaps", with_ctes("dem") + "SELECT tile_row, gx - gx % 3 AS x, y, arg_max(z, gx) AS z FROM dem GROUP BY ALL")
def _(spark, sf):
    return mosaic.last_written(fx(spark, sf, "dem").withColumn("x", F.col("gx") - F.col("gx") % 3), ["tile_row"], "z", "gx")


# One mosaic of 100 x 100 pixels per hundred rows.
HUNDRED = {
    "mz": "SELECT CAST((gy - gy % 100) / 100 AS BIGINT) AS mosaic, gx AS x, gy % 100 AS y, z FROM dem",
    "mb": "SELECT *, box_id % (SELECT max(mosaic) + 1 FROM mz) AS mosaic FROM valid_boxes",
}


def hundred(spark, sf, name="dem", value="z"):
    return deal(fx(spark, sf, name), "gx", "gy").select(F.floor(F.col("gy") / 100).alias("mosaic"), F.col("gx").alias("x"), (F.col("gy") % 100).alias("y"), value)


def on_mosaics(spark, sf, frame):
    pixels = hundred(spark, sf)
    return pixels, frame.withColumn("mosaic", F.col("box_id") % pixels.agg(F.max("mosaic") + 1).scalar())


@query("crop_mercator", with_ctes(
    "boxes", "valid_boxes", "dem", zb=f"SELECT *, CAST({zoom_sql(4, 15)} AS INTEGER) AS z FROM valid_boxes", rg=RANGE_SQL, mz=HUNDRED["mz"],
    win=f"""SELECT box_id, box_id % (SELECT max(mosaic) + 1 FROM mz) AS mosaic,
      CAST(floor((west + 180e0) / 360e0 * pow(2e0, z) * 256e0 - min_x * 256e0 + 0.5e0) AS BIGINT) AS l,
      CAST(floor({world_y('north')} * pow(2e0, z) * 256e0 - min_y * 256e0 + 0.5e0) AS BIGINT) AS t,
      CAST(floor(abs((east - west) / 360e0 * pow(2e0, z) * 256e0) + 0.5e0) AS BIGINT) AS w,
      CAST(floor(abs({world_y('south')} - {world_y('north')}) * pow(2e0, z) * 256e0 + 0.5e0) AS BIGINT) AS h FROM rg""",
    wx="SELECT *, unnest(range(0, w)) AS x FROM win", wxy="SELECT *, unnest(range(0, h)) AS y FROM wx",
) + "SELECT s.box_id, s.x, s.y, coalesce(z, 0e0) AS z FROM wxy s LEFT JOIN mz m ON m.mosaic = s.mosaic AND m.x = s.l + s.x AND m.y = s.t + s.y")
def _(spark, sf):
    frame = boxes(spark, sf).withColumn("z", geo.choose_zoom(*SIDES, F.lit(4), 15).cast("int")).withColumns(catalogs.tile_range("z"))
    windows = mosaic.mercator_window(frame, "z", "min_x", "min_y").select("box_id", "left", "top", "width", "height")
    pixels, windows = on_mosaics(spark, sf, windows)
    windows = windows.withColumn("mosaic_w", F.lit(100)).withColumn("mosaic_h", F.lit(100))
    return mosaic.crop_mercator(pixels, windows, ["mosaic"], ["box_id"], {"z": 0.0})


SMALL = [f"{K} AS box_id", f"({K} % 80) / 100 + 3 / 1000 AS west", f"({K} % 80 + 1 + {K} % 15) / 100 + 3 / 1000 AS east",
         f"({K} % 70) / 100 + 4 / 1000 AS south", f"({K} % 70 + 2 + {K} % 11) / 100 + 4 / 1000 AS north"]
SMALL_SQL = f"SELECT {', '.join(SMALL)} FROM customer"


@query("crop_georef", with_ctes("dem", mz=HUNDRED["mz"], sb=SMALL_SQL, win="""SELECT box_id, box_id % (SELECT max(mosaic) + 1 FROM mz) AS mosaic,
    greatest(0, floor((west - 0e0) / 0.01e0)) AS x0, least(99, ceil((east - 0e0) / 0.01e0) - 1) AS x1,
    greatest(0, floor((1e0 - north) / 0.01e0)) AS y0, least(99, ceil((1e0 - south) / 0.01e0) - 1) AS y1 FROM sb""")
       + """SELECT box_id, CAST(x - x0 AS BIGINT) AS x, CAST(y - y0 AS BIGINT) AS y, z FROM win JOIN mz ON mz.mosaic = win.mosaic
  AND x BETWEEN x0 AND greatest(x0, x1) AND y BETWEEN y0 AND greatest(y0, y1)""")
def _(spark, sf):
    small = table(spark, sf, "customer").selectExpr(*SMALL)
    windows = mosaic.georef_window(small, F.lit(100), F.lit(100), F.lit(0.0), F.lit(1.0), F.lit(0.01), F.lit(0.01))
    pixels, windows = on_mosaics(spark, sf, windows)
    return mosaic.crop_windows(pixels, windows, ["mosaic"], ["box_id"]).select("box_id", "x", "y", "z")


DW, DH = 64, 37


def bilinear_cte(name, source, keys, sw, sh, dw, dh):
    """Neighbours looked up one by one on a full target grid."""
    k = ", ".join(keys)
    return {
        f"{name}_t": f"""SELECT {k}, t.x, u.y, t.x * ({sw - 1}e0 / {dw - 1}e0) AS sx, u.y * ({sh - 1}e0 / {dh - 1}e0) AS sy
            FROM (SELECT DISTINCT {k} FROM {source}), range({dw}) t(x), range({dh}) u(y)""",
        f"{name}_n": f"""SELECT *, CAST(floor(sx) AS BIGINT) AS x0, CAST(floor(sy) AS BIGINT) AS y0, least(CAST(floor(sx) AS BIGINT) + 1, {sw - 1}) AS x1,
            least(CAST(floor(sy) AS BIGINT) + 1, {sh - 1}) AS y1, sx - floor(sx) AS fx, sy - floor(sy) AS fy FROM {name}_t""",
        name: f"""SELECT {', '.join('n.' + c for c in keys)}, n.x, n.y,
            (coalesce(a.z, 0) * (1e0 - fx) + coalesce(b.z, 0) * fx) * (1e0 - fy) + (coalesce(c.z, 0) * (1e0 - fx) + coalesce(d.z, 0) * fx) * fy AS z
            FROM {name}_n n """ + " ".join(
                f"LEFT JOIN {source} {t} ON {' AND '.join(f'{t}.{c} = n.{c}' for c in keys)} AND {t}.x = n.{px} AND {t}.y = n.{py}"
                for t, px, py in (("a", "x0", "y0"), ("b", "x1", "y0"), ("c", "x0", "y1"), ("d", "x1", "y1"))),
    }


@query("resample_bilinear", with_ctes("dem", **bilinear_cte("bl", "dem", TILE_KEYS, TILE, TILE, DW, DH)) + f"SELECT tile_row, tile_col, x, y, {q6('z')} AS z FROM bl")
def _(spark, sf):
    out = resample.resample_bilinear(deal(fx(spark, sf, "dem"), "gx", "gy"), TILE_KEYS, TILE, TILE, DW, DH)
    return out.select(*TILE_KEYS, "x", "y", r6("z").alias("z"))


def nearest_sql(source, keys, sw, sh, dw, dh, value):
    return f"""SELECT {', '.join('s.' + c for c in keys)}, t.x, u.y, s.{value} FROM range({dw}) t(x), range({dh}) u(y), {source} s
      WHERE s.x = least({sw - 1}, CAST(floor(t.x / {dw - 1}e0 * {sw - 1} + 0.5e0) AS BIGINT)) AND s.y = least({sh - 1}, CAST(floor(u.y / {dh - 1}e0 * {sh - 1} + 0.5e0) AS BIGINT))"""


@query("resample_nearest", with_ctes("landcover") + nearest_sql("landcover", TILE_KEYS, TILE, TILE, 31, 77, "cls"))
def _(spark, sf):
    return resample.resample_nearest(deal(fx(spark, sf, "landcover"), "gx", "gy"), TILE_KEYS, TILE, TILE, 31, 77, ("cls",))


def lanczos_cte(name, source, keys, sw, sh, dw, dh, a):
    """Two passes over a table of taps per target position; sizes may be columns of the source."""
    k = ", ".join(keys)

    def taps(axis, n_src, n_dst):
        s = f"({n_src} / {n_dst}e0)"
        d = f"((t.p + 0.5e0) * {s} - 0.5e0 - {axis}) / greatest({s}, 1e0)"
        return d, f"CASE WHEN {d} = 0 THEN 1e0 ELSE {a}e0 * sin(pi() * ({d})) * sin(pi() * ({d}) / {a}e0) / ((pi() * ({d})) * (pi() * ({d}))) END"

    dx, wx = taps("x", sw, dw)
    dy, wy = taps("y", sh, dh)
    size = "".join(f", {c}" for c in (sw, sh) if isinstance(c, str))
    return {
        f"{name}_h": f"SELECT {k}{size}, t.p AS x, y, sum(({wx}) * v) / sum({wx}) AS v FROM {source}, range({dw}) t(p) WHERE abs({dx}) < {a} GROUP BY {k}{size}, t.p, y",
        name: f"SELECT {k}, x, t.p AS y, sum(({wy}) * v) / sum({wy}) AS v FROM {name}_h, range({dh}) t(p) WHERE abs({dy}) < {a} GROUP BY {k}{size}, x, t.p",
    }


@query("resample_lanczos", with_ctes("landcover", g=f"SELECT tile_row, tile_col, x, y, {INTENSITY} AS v FROM landcover",
       **lanczos_cte("lz", "g", TILE_KEYS, TILE, TILE, 20, 33, 3)) + f"SELECT tile_row, tile_col, x, y, {q6('v')} AS v FROM lz")
def _(spark, sf):
    graded = deal(fx(spark, sf, "landcover"), "gx", "gy").select(*TILE_KEYS, "x", "y", heights.vegetation_intensity("cls").alias("v"))
    return resample.resample_imagery(graded, TILE_KEYS, TILE, TILE, 20, 33).select(*TILE_KEYS, "x", "y", r6("v").alias("v"))


def slope_cte(name, source, keys):
    k = ", ".join(keys)

    def side(fn, axis):
        return f"{fn}(z) OVER (PARTITION BY {k}, {'y' if axis == 'x' else 'x'} ORDER BY {axis})"

    def grad(axis):
        b, a = side("lag", axis), side("lead", axis)
        n = f"(CASE WHEN {b} IS NULL THEN 0 ELSE 1 END + CASE WHEN {a} IS NULL THEN 0 ELSE 1 END)"
        return f"CASE WHEN {n} = 0 THEN 0e0 ELSE (coalesce({a}, z) - coalesce({b}, z)) / {n} END"

    return {
        f"{name}_g": f"SELECT {k}, x, y, {grad('x')} AS dx, {grad('y')} AS dy FROM {source}",
        name: f"SELECT {k}, x, y, degrees(atan(sqrt(dx * dx + dy * dy))) AS slope FROM {name}_g",
    }


@query("slope_grid", with_ctes("dem", **slope_cte("sl", "dem", TILE_KEYS)) + f"SELECT tile_row, tile_col, x, y, {q6('slope')} AS slope FROM sl")
def _(spark, sf):
    return surface.slope_grid(fx(spark, sf, "dem"), TILE_KEYS).select(*TILE_KEYS, "x", "y", r6("slope").alias("slope"))


@query("cliff_mask", with_ctes("dem", **slope_cte("sl", "dem", TILE_KEYS), m="SELECT tile_row, tile_col, x, y, CASE WHEN slope >= 80 THEN 255 ELSE 0 END AS v FROM sl")
       + nearest_sql("m", TILE_KEYS, TILE, TILE, 40, 40, "v"))
def _(spark, sf):
    return surface.cliff_mask(fx(spark, sf, "dem"), TILE_KEYS, TILE, TILE, 80.0, 40)


STATS = {"st": """SELECT tile_row, tile_col, coalesce(min(z_nan) FILTER (WHERE NOT isnan(z_nan)), 0e0) AS z_min,
  coalesce(max(z_nan) FILTER (WHERE NOT isnan(z_nan)), 0e0) AS z_max, bool_or(isnan(z_nan)) AS has_nodata FROM dem GROUP BY ALL"""}


@query("elevation_stats", with_ctes("dem", **STATS) + f"""SELECT tile_row, tile_col, z_min, z_max, has_nodata, {q6('z_max - z_min')} AS z_range,
  {q6('floor(z_min * 100e0 + 0.5e0) / 100e0')} AS shown_min FROM st""")
def _(spark, sf):
    out = surface.elevation_stats(fx(spark, sf, "dem"), TILE_KEYS, "z_nan")
    return out.withColumn("z_range", r6("z_range")).withColumn("shown_min", r6(surface.display_elevation("z_min")))


QUANT = {"qt": """SELECT d.tile_row, d.tile_col, x, y, CAST(greatest(0e0, least(65535e0, floor((CASE WHEN isnan(z_nan) THEN z_min ELSE z_nan END - z_min)
  / (CASE WHEN z_max - z_min = 0 THEN 1e0 ELSE z_max - z_min END) * 65535e0 + 0.5e0))) AS INTEGER) AS q FROM dem d JOIN st USING (tile_row, tile_col)"""}


@query("quantize_u16", with_ctes("dem", **STATS, **QUANT) + "SELECT * FROM qt")
def _(spark, sf):
    return surface.quantize_heights(fx(spark, sf, "dem"), TILE_KEYS, "z_nan").select(*TILE_KEYS, "x", "y", "q")


# Rows of kinds: measured heights, whole numbers, one constant, nothing finite.
BAND = ["event_id % 5 AS band", "event_id",
        "CASE event_id % 5 WHEN 0 THEN value WHEN 1 THEN CAST(event_id % 200 AS DOUBLE) WHEN 2 THEN CAST(7 AS DOUBLE) WHEN 3 THEN CAST('NaN' AS DOUBLE) "
        "ELSE CASE WHEN event_id % 11 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value * 3 - 50 END END AS v"]
BAND_SQL = {"b": f"SELECT {', '.join(BAND)} FROM events",
            "r": "SELECT band, min(v) FILTER (WHERE isfinite(v)) AS lo, max(v) FILTER (WHERE isfinite(v)) AS hi FROM b GROUP BY band"}


@query("normalize_mask_u8", with_ctes(**BAND_SQL) + """SELECT event_id, band, CAST(CASE WHEN lo IS NULL THEN 0 WHEN lo = hi THEN CASE WHEN lo > 0 THEN 255 ELSE 0 END
  WHEN lo >= 0 AND hi <= 255 AND lo = floor(lo) AND hi = floor(hi) THEN floor(greatest(0e0, least(255e0, v)) + 0.5e0)
  ELSE floor(greatest(0e0, least(255e0, CASE WHEN isfinite(v) THEN (v - lo) / (hi - lo) * 255e0 ELSE 0e0 END)) + 0.5e0) END AS INTEGER) AS u8 FROM b JOIN r USING (band)""")
def _(spark, sf):
    return surface.normalize_masks(table(spark, sf, "events").selectExpr(*BAND), ["band"]).select("event_id", "band", "u8")


@query("preview_u8", with_ctes(**BAND_SQL) + """SELECT event_id, band, CAST(floor(greatest(0e0, least(255e0, CASE WHEN NOT isfinite(v) THEN 0e0
  WHEN lo = hi THEN v * 255e0 ELSE (v - lo) / (hi - lo) * 255e0 END)) + 0.5e0) AS INTEGER) AS u8 FROM b JOIN r USING (band)""")
def _(spark, sf):
    return surface.preview_bands(table(spark, sf, "events").selectExpr(*BAND), ["band"]).select("event_id", "band", "u8")


# Tiles with scattered holes, in bands of 20 rows.
PACKED_ROWS = 20
HOLES = f"""SELECT t.*, p.x, p.y, CASE WHEN (p.x * 7 + p.y) % 11 = 0 THEN 0 ELSE coalesce(q, 0) END AS q, CAST((p.y - p.y % {PACKED_ROWS}) // {PACKED_ROWS} AS BIGINT) AS band
  FROM (SELECT DISTINCT tile_row, tile_col FROM qt) t CROSS JOIN (SELECT x, y FROM range({TILE}) a(x), range({TILE}) b(y)) p LEFT JOIN qt USING (tile_row, tile_col, x, y)"""


def holed(spark, sf):
    q = surface.quantize_heights(fx(spark, sf, "dem"), TILE_KEYS, "z_nan")
    return q.filter("(x * 7 + y) % 11 <> 0")


@query("pack_r16", with_ctes("dem", **STATS, **QUANT, hz=HOLES) + f"""SELECT tile_row, tile_col, band, band * {PACKED_ROWS * TILE} AS start, CAST(count(*) AS BIGINT) AS n_pixels,
  md5(unhex(string_agg(printf('%02x%02x', q & 255, q >> 8), '' ORDER BY y, x))) AS digest FROM hz GROUP BY ALL""")
def _(spark, sf):
    bands = r16.pack_r16(holed(spark, sf), TILE_KEYS, TILE, TILE, band_rows=PACKED_ROWS)
    return bands.select(*TILE_KEYS, "band", "start", "n_pixels", F.md5("content").alias("digest"))


@query("unpack_r16", with_ctes("dem", **STATS, **QUANT, hz=HOLES) + "SELECT tile_row, tile_col, x, y, q FROM hz")
def _(spark, sf):
    bands = r16.pack_r16(holed(spark, sf), TILE_KEYS, TILE, TILE, band_rows=PACKED_ROWS)
    return r16.unpack_bands(bands, TILE_KEYS, TILE)


# --- grids ----------------------------------------------------------------------------------

KM = 50
GRID = {
    "gs": f"""SELECT *, CAST(greatest(1, ceil((north - south) / ({KM} / 111.32e0))) AS BIGINT) AS rows,
      CAST(greatest(1, ceil((east - west) / ({KM} / (111.32e0 * cos((north + south) / 2e0 * pi() / 180e0))))) AS BIGINT) AS cols FROM valid_boxes""",
    "gr": "SELECT *, unnest(range(0, rows)) AS \"row\" FROM gs",
    "gc": "SELECT *, unnest(range(0, cols)) AS col FROM gr",
    "grid": """SELECT box_id, "row", col, rows, cols, west + col * ((east - west) / cols) AS west, south + "row" * ((north - south) / rows) AS south,
      CASE WHEN col = cols - 1 THEN east ELSE west + (col + 1) * ((east - west) / cols) END AS east,
      CASE WHEN "row" = rows - 1 THEN north ELSE south + ("row" + 1) * ((north - south) / rows) END AS north FROM gc""",
}


def grid(spark, sf):
    return grids.tile_grid(boxes(spark, sf), F.lit(KM)).select("box_id", "row", "col", "rows", "cols", *SIDES, "center_lng", "center_lat")


BOX_OUT = ", ".join(f"{q6(s)} AS {s}" for s in SIDES)


@query("tile_grid", with_ctes("boxes", "valid_boxes", **GRID) + f"""SELECT box_id, "row", col, rows, cols, {BOX_OUT},
  {q6('(west + east) / 2')} AS center_lng, {q6('(south + north) / 2')} AS center_lat FROM grid""")
def _(spark, sf):
    g = grid(spark, sf)
    return g.select("box_id", "row", "col", "rows", "cols", *[r6(c).alias(c) for c in (*SIDES, "center_lng", "center_lat")])


SPLIT = {
    "s0": "SELECT *, (north - south) * (east - west) AS area, north - south AS lat_span, east - west AS lon_span FROM valid_boxes",
    "s1": """SELECT *, CASE WHEN area <= 0.25e0 THEN 1 ELSE greatest(1, CAST(floor(sqrt(ceil(area / 0.25e0) * (lat_span / lon_span)) + 0.5e0) AS BIGINT)) END AS a,
      CASE WHEN area <= 0.25e0 THEN 1 ELSE greatest(1, CAST(floor(sqrt(ceil(area / 0.25e0) / (lat_span / lon_span)) + 0.5e0) AS BIGINT)) END AS b FROM s0""",
    "s2": """SELECT * FROM s1 UNION ALL SELECT * REPLACE (CASE WHEN lat_span / a >= lon_span / b THEN a + 1 ELSE a END AS a,
      CASE WHEN lat_span / a >= lon_span / b THEN b ELSE b + 1 END AS b) FROM s2 WHERE area > 0.25e0 AND (lat_span / a) * (lon_span / b) > 0.25e0""",
    "s3": "SELECT * FROM s2 WHERE area <= 0.25e0 OR (lat_span / a) * (lon_span / b) <= 0.25e0",
    "s4": "SELECT *, unnest(range(0, a)) AS i FROM s3",
    "s5": "SELECT *, unnest(range(0, b)) AS j FROM s4",
    "parts": """SELECT box_id, CAST(i * b + j AS BIGINT) AS region_idx, west + j * (lon_span / b) AS west, south + i * (lat_span / a) AS south,
      CASE WHEN j = b - 1 THEN east ELSE west + (j + 1) * (lon_span / b) END AS east, CASE WHEN i = a - 1 THEN north ELSE south + (i + 1) * (lat_span / a) END AS north FROM s5""",
}


@query("split_bounds", "WITH RECURSIVE " + with_ctes("boxes", "valid_boxes", **SPLIT)[5:] + f"SELECT box_id, region_idx, {BOX_OUT} FROM parts")
def _(spark, sf):
    return grids.split_bounds(boxes(spark, sf)).select("box_id", "region_idx", *[r6(s).alias(s) for s in SIDES])


@query("generation_plan", with_ctes("boxes", "valid_boxes", s="""SELECT *, CAST(least(4, greatest(1, ceil((north - south) * 2))) AS BIGINT) AS nr,
  CAST(least(4, greatest(1, ceil((east - west) * 2))) AS BIGINT) AS nc FROM valid_boxes""", a="SELECT *, unnest(range(0, nr)) AS r FROM s",
  b="SELECT *, unnest(range(0, nc)) AS c FROM a") + f"""SELECT box_id, r AS "row", c AS col, {q6('west + c / nc * (east - west)')} AS west,
  {q6('west + (c + 1) / nc * (east - west)')} AS east, {q6('south + r / nr * (north - south)')} AS south, {q6('south + (r + 1) / nr * (north - south)')} AS north,
  12 AS zoom, nr * nc * 256 AS memory_mb, nr * nc * 45 AS duration_sec FROM b""")
def _(spark, sf):
    return grids.generation_plan(boxes(spark, sf)).select(
        "box_id", "row", "col", *[r6(s).alias(s) for s in SIDES], "zoom", "memory_mb", "duration_sec"
    )


JOBS = [f"{K} AS job_id", f"64 + ({K} * 13) % 16320 AS out_w", f"64 + ({K} * 29) % 16320 AS out_h", f"100 + ({K} * 97) % 99900 AS src_w",
        f"100 + ({K} * 61) % 49900 AS src_h", f"CAST({K} % 100 AS DOUBLE) AS west", f"CAST({K} % 50 AS DOUBLE) AS south",
        f"CAST({K} % 100 + 3 AS DOUBLE) AS east", f"CAST({K} % 50 + 3 AS DOUBLE) AS north"]
LIMIT = "(268435456 * 0.9e0)"
CHUNKS = {
    "c0": f"SELECT {', '.join(JOBS)} FROM customer",
    "c1": f"""SELECT *, CASE WHEN src_w * src_h < {LIMIT} THEN 1 ELSE greatest(1, CAST(floor(sqrt(ceil(src_w * src_h / {LIMIT}) * (src_w / src_h)) + 0.5e0) AS BIGINT)) END AS nc,
      CASE WHEN src_w * src_h < {LIMIT} THEN 1 ELSE greatest(1, CAST(floor(sqrt(ceil(src_w * src_h / {LIMIT}) / (src_w / src_h)) + 0.5e0) AS BIGINT)) END AS nr FROM c0""",
    "c2": f"""SELECT * FROM c1 UNION ALL SELECT * REPLACE (CASE WHEN src_w / nc >= src_h / nr THEN nc + 1 ELSE nc END AS nc,
      CASE WHEN src_w / nc >= src_h / nr THEN nr ELSE nr + 1 END AS nr) FROM c2 WHERE (src_w / nc) * (src_h / nr) >= {LIMIT}""",
    "c3": f"SELECT * FROM c2 WHERE (src_w / nc) * (src_h / nr) < {LIMIT}",
    "c4": "SELECT *, unnest(range(0, nr)) AS r FROM c3",
    "c5": "SELECT *, unnest(range(0, nc)) AS c, out_w // nc AS cw, out_h // nr AS ch FROM c4",
}


@query("chunk_plan", "WITH RECURSIVE " + with_ctes(**CHUNKS)[5:] + f"""SELECT job_id, r AS chunk_row, c AS chunk_col, CAST(c * cw AS BIGINT) AS out_x, CAST(r * ch AS BIGINT) AS out_y,
  CAST(CASE WHEN c = nc - 1 THEN out_w - c * cw ELSE cw END AS BIGINT) AS width, CAST(CASE WHEN r = nr - 1 THEN out_h - r * ch ELSE ch END AS BIGINT) AS height,
  {q6('west + c / nc * (east - west)')} AS west, {q6('west + (c + 1) / nc * (east - west)')} AS east,
  {q6('north - r / nr * (north - south)')} AS north, {q6('north - (r + 1) / nr * (north - south)')} AS south FROM c5""")
def _(spark, sf):
    jobs = table(spark, sf, "customer").selectExpr(*JOBS)
    return grids.chunk_plan(jobs).select(
        "job_id", "chunk_row", "chunk_col", "out_x", "out_y", "width", "height", *[r6(s).alias(s) for s in SIDES]
    )


@query("reassemble_chunks", with_ctes("dem", c="SELECT DISTINCT tile_row, tile_col FROM dem") + f"""SELECT {MOSAIC} AS mosaic, c.tile_col * {TILE} + x.x AS x,
  c.tile_row * {TILE} - ({MOSAIC}) * 500 + y.y AS y, CASE WHEN {FAILED} THEN 0e0 ELSE d.z END AS z FROM c JOIN range({TILE}) x(x) ON true JOIN range({TILE}) y(y) ON true
  JOIN dem d ON d.tile_row = c.tile_row AND d.tile_col = c.tile_col AND d.x = x.x AND d.y = y.y WHERE c.tile_col * {TILE} + x.x < 90""".replace("tile_row * 3 + tile_col", "c.tile_row * 3 + c.tile_col").replace(MOSAIC, MOSAIC.replace("tile_row", "c.tile_row")))
def _(spark, sf):
    dem, cat = mosaic_inputs(spark, sf, "z")
    chunk_id = F.concat_ws("_", *TILE_KEYS).alias("chunk_id")
    chunks = cat.select("mosaic", chunk_id, (F.col("tile_col") * TILE).alias("out_x"), ((F.col("tile_row") - F.col("min_y")) * TILE).alias("out_y"),
                        F.lit(TILE).alias("width"), F.lit(TILE).alias("height"))
    got = dem.filter(f"NOT ({FAILED})").select("mosaic", chunk_id, "x", "y", "z")
    return mosaic.reassemble_chunks(got, chunks, ["mosaic"], F.lit(90), F.lit(500), {"z": 0.0})


COVER_BOX = [f"{K} AS box_id", f"({K} % 220) / 100 AS west", f"({K} % 220 + 10 + {K} % 60) / 100 AS east", f"({K} % 190) / 100 AS south", f"({K} % 190 + 20 + {K} % 70) / 100 AS north"]


@query("vegetation_mask", with_ctes("landcover", mz=f"SELECT CAST((gy - gy % 100) / 100 AS BIGINT) AS mosaic, gx, gy % 100 AS my, {INTENSITY} AS v FROM landcover",
    sb=f"SELECT {', '.join(COVER_BOX)} FROM customer",
    win="""SELECT box_id, box_id % (SELECT max(mosaic) + 1 FROM mz) AS mosaic, greatest(0, floor(west / 3 * 100)) AS x0, least(100, ceil(east / 3 * 100)) AS x1,
      greatest(0, floor((3 - north) / 3 * 100)) AS y0, least(100, ceil((3 - south) / 3 * 100)) AS y1 FROM sb""",
    cut="""SELECT box_id, greatest(1, x1 - x0) AS cw, greatest(1, y1 - y0) AS ch, gx - x0 AS x, my - y0 AS y, v FROM win JOIN mz ON mz.mosaic = win.mosaic
      AND gx >= x0 AND gx < greatest(x1, x0 + 1) AND my >= y0 AND my < greatest(y1, y0 + 1)""",
    **lanczos_cte("lz", "cut", ["box_id"], "cw", "ch", 8, 8, 2)) + f"SELECT box_id, x, y, {q6('v')} AS v FROM lz")
def _(spark, sf):
    cover = hundred(spark, sf, "landcover", "cls")
    windows = mosaic.landcover_window(table(spark, sf, "customer").selectExpr(*COVER_BOX), F.lit(0.0), F.lit(0.0), F.lit(3.0), F.lit(3.0), F.lit(100), F.lit(100))
    windows = windows.withColumn("mosaic", F.col("box_id") % cover.agg(F.max("mosaic") + 1).scalar())
    return masks.vegetation_mask(cover, windows, ["mosaic"], ["box_id"], 8, 8).select("box_id", "x", "y", r6("raw").alias("v"))
