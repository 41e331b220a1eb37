"""An export from downloaded tiles: bytes, decoded, cut, resized, masked and counted."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from orograph.functions import geo
from orograph.operators import blocks, masks
from orograph.plans import rasters, terrain
from orograph.session import shuffled
from orograph.sources import catalogs, images

from .base import KIND_SQL, features, line_cte, polygon_cte, q6, query, r6, recursive, table, with_ctes
from .packaging import PACKAGE, on_tiles, stages
from .rasters import RANGE_SQL, lanczos_cte, slope_cte
from .scalars import zoom_sql
from .shapes import FEAT

SETTINGS = terrain.PackageSettings(tile_km=55.66, resolution=32, albedo_resolution=48, height_format="r16", cliff_threshold=89.7, waterway_as="polygon")
R, A, COVER_PX = SETTINGS.resolution, SETTINGS.albedo_size, 90
SIDES = ("west", "south", "east", "north")
#: Number of areas, beside two for ten thousand events each.
AREAS = "2 + CAST(count(*) / 10000 AS BIGINT)"


def areas(spark, sf):
    """Boxes of one degree from 10 degrees north to the south; every other one is narrower, so its rasters have another size."""
    n = table(spark, sf, "events").agg(F.floor(F.count(F.lit(1)) / 10000) + 2).scalar()
    rows = spark.range(1).select(F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("area_id"))
    return rows.select("area_id", F.lit(0.0).alias("west"), (9.0 - F.col("area_id")).alias("south"), F.when(F.col("area_id") % 2 == 0, 1.0).otherwise(0.6).alias("east"), (10.0 - F.col("area_id")).alias("north"))


def line_values(spark, sf):
    """A number for every event: the base of one row of pixels."""
    return table(spark, sf, "events").select(F.col("event_id").alias("e"), ((F.col("event_id") * 37 + F.floor(F.col("value"))) % 256).alias("b"))


BASE_SQL = "(event_id * 37 + CAST(floor(value) AS BIGINT)) % 256"


def files(spark, sf, tiles, keys, side, pixel_bytes, broken):
    """Bytes of raw tiles: each row of pixels is made from the number of one event. ``broken`` ones are cut, ``tiles`` without a file have none."""
    n = table(spark, sf, "events").agg(F.count(F.lit(1))).scalar()
    a, b = keys[-2:]
    lines = tiles.select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(side - 1).cast("bigint"))).alias("line"))
    lines = lines.withColumn("e", (F.abs(F.col(a) * 31 + F.col(b) * 17) + F.col("line")) % n)
    held = lines.join(shuffled(line_values(spark, sf)), "e").groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "b"))), lambda s: s["b"]).alias("bases"), F.expr(f"first({broken})").alias("cut"))

    @F.pandas_udf("binary")
    def packed(bases: pd.Series, cut: pd.Series) -> pd.Series:
        return pd.Series([pixel_bytes(b)[:-5 if c else None] for b, c in zip(bases, cut)])

    return held.select(*keys, packed("bases", "cut").alias("content"))


def rgb(red, green, blue):
    """Bytes of an image whose bands are functions of a row's number (down) and the column (across)."""
    import numpy as np

    def make(bases):
        b, x = np.asarray(bases)[:, None], np.arange(len(bases))[None, :]
        return np.stack([np.broadcast_to(f(b, x), (len(bases),) * 2) for f in (red, green, blue)], -1).astype(np.uint8).tobytes()

    return make


def classes(bases):
    import numpy as np

    return np.array([10, 20, 30, 40, 50, 60, 80], np.uint8)[(np.asarray(bases)[:, None] + np.arange(len(bases))[None, :]) % 7].tobytes()


HEIGHT_RGB = rgb(lambda b, x: 128 + (b + x) % 4, lambda b, x: (b * 7 + x) % 256, lambda b, x: x * 3 % 256)
PHOTO_RGB = rgb(lambda b, x: (b + x) % 256, lambda b, x: (b * 3 + x * 5) % 256, lambda b, x: (b * 5 + x * 7) % 256)
WEB, COVER = ["z", "tile_x", "tile_y"], ["tile_lon", "tile_lat"]
#: Tiles whose file is broken, and a land-cover tile that does not exist.
BROKEN, NO_COVER = "(tile_x + tile_y) % 3 = 0", "tile_lat = 6"


def decoded(spark, sf, package_tiles):
    """Decoded elevation, imagery and land-cover tiles of an export."""
    def web(size, zoom_cap, maker, processor):
        wanted = catalogs.tile_catalog(package_tiles, geo.choose_zoom(*SIDES, F.lit(size), zoom_cap)).select(*WEB).distinct()
        return images.decode_tiles(files(spark, sf, wanted, WEB, 256, maker, BROKEN), WEB, processor)

    heights = web(R, geo.ELEVATION_MAX_ZOOM, HEIGHT_RGB, images.elevation_image(images.raw_image(3)))
    photos = web(A, geo.IMAGERY_MAX_ZOOM, PHOTO_RGB, images.raw_image(3))
    wanted = catalogs.landcover_tile_catalog(package_tiles).select(*COVER).distinct().filter(f"NOT ({NO_COVER})")
    return heights, photos, images.decode_tiles(files(spark, sf, wanted, COVER, COVER_PX, classes, "false"), COVER, images.raw_image(1))


def package(spark, sf):
    store = stages(spark)
    boxes = areas(spark, sf)
    plain = terrain.TerrainPackage(boxes, "area_id", None, None, None, SETTINGS)
    heights, photos, cover = (store.keep(n, d) for n, d in zip(("elevation_tiles", "imagery_tiles", "landcover_tiles"), decoded(spark, sf, plain.tiles)))
    n = boxes.agg(F.count(F.lit(1))).scalar()
    moved = features(spark, sf).withColumn("_up", F.lit(9.0) - F.col("sheet") % n)
    moved = moved.withColumn("geometry", F.transform("geometry", lambda p: F.struct((p["lat"] + F.col("_up")).alias("lat"), p["lon"].alias("lon"))))
    return terrain.TerrainPackage(
        boxes, "area_id", rasters.web_tiles(heights, R, geo.ELEVATION_MAX_ZOOM), rasters.landcover_tiles(cover, COVER_PX), store.keep("given_features", moved.select("type", "id", "geometry", "tags")), SETTINGS,
        rasters.web_tiles(photos, A, geo.IMAGERY_MAX_ZOOM, 3), store,
    )


def window_ctes(name, size, cap):
    """Window of every tile in pixels of the whole web grid, and the grid of its pixels with the row number of each."""
    range_sql = RANGE_SQL.replace("FROM zb", f"FROM {name}_z")
    from .rasters import world_y

    return {
        f"{name}_z": f"SELECT *, CAST({zoom_sql(size, cap)} AS INTEGER) AS z FROM ts",
        f"{name}_g": range_sql,
        f"{name}_w": f"""SELECT *, CAST(floor((west + 180e0) / 360e0 * pow(2e0, z) * 256e0 - min_x * 256e0 + 0.5e0) AS BIGINT) + min_x * 256 AS l,
          CAST(floor({world_y('north')} * pow(2e0, z) * 256e0 - min_y * 256e0 + 0.5e0) AS BIGINT) + min_y * 256 AS t,
          CAST(floor(abs((east - west) / 360e0 * pow(2e0, z) * 256e0) + 0.5e0) AS BIGINT) AS cw,
          CAST(floor(abs({world_y('south')} - {world_y('north')}) * pow(2e0, z) * 256e0 + 0.5e0) AS BIGINT) AS ch FROM {name}_g""",
        f"{name}_x": f"SELECT *, unnest(range(0, cw)) AS x FROM {name}_w",
        f"{name}_y": f"SELECT *, unnest(range(0, ch)) AS y FROM {name}_x",
        f"{name}_t": f"SELECT sheet, cw, ch, x, y, (l + x) // 256 AS tile_x, (t + y) // 256 AS tile_y, (l + x) % 256 AS px, (t + y) % 256 AS py, min_x, max_x, min_y, max_y FROM {name}_y",
        f"{name}_e": f"SELECT *, {EVENT_SQL} AS e FROM {name}_t, total",
        f"{name}_p": f"""SELECT p.sheet, cw, ch, x, y, px, b, tile_x BETWEEN min_x AND max_x AND tile_y BETWEEN min_y AND max_y AND NOT ({BROKEN}) AS seen
          FROM {name}_e p JOIN lines USING (e)""",
    }


EVENT_SQL = "(abs(tile_x * 31 + tile_y * 17) + py) % total.n"
BANDS = (("r", "(b + px) % 256"), ("g", "(b * 3 + px * 5) % 256"), ("b", "(b * 5 + px * 7) % 256"))
COVER_WINDOW = f"""SELECT *, greatest(0, CAST(floor((west - fw) / (fe - fw) * mw) AS BIGINT)) AS x0, least(mw, CAST(ceil((east - fw) / (fe - fw) * mw) AS BIGINT)) AS x1,
  greatest(0, CAST(floor((fn - north) / (fn - fs) * mh) AS BIGINT)) AS y0, least(mh, CAST(ceil((fn - south) / (fn - fs) * mh) AS BIGINT)) AS y1 FROM cov_m"""
EXPORT = {
    "total": "SELECT CAST(count(*) AS BIGINT) AS n FROM events",
    "lines": f"SELECT event_id AS e, {BASE_SQL} AS b FROM events",
    "ar": f"SELECT area_id, 0e0 AS west, 9e0 - area_id AS south, CASE WHEN area_id % 2 = 0 THEN 1e0 ELSE 0.6e0 END AS east, 10e0 - area_id AS north FROM range(0, (SELECT {AREAS} FROM events)) t(area_id)",
    **{k: PACKAGE[k] for k in ("tg", "th", "ti", "ts")},
    **window_ctes("hw", R, 15),
    "cut": "SELECT DISTINCT sheet, cw, ch, x, y, CASE WHEN seen THEN (128 + (b + px) % 4) * 256e0 + (b * 7 + px) % 256 + (px * 3 % 256) / 256e0 - 32768e0 ELSE 0e0 END AS z FROM hw_p",
    "win": "SELECT sheet, cw, ch FROM hw_w",
    **{k: PACKAGE[k] for k in ("tt", "tn", "hz", "sta", "qua")},
    **slope_cte("sl", "cut", ["sheet"]), "clm": PACKAGE["clm"], "cln": PACKAGE["cln"].replace("slope >= 80", "slope >= 89.7e0"),
    **window_ctes("iw", A, 19),
    **{f"im_{n}": f"SELECT sheet, cw, ch, x, y, CASE WHEN seen THEN {e} ELSE 0 END AS v FROM iw_p" for n, e in BANDS},
    **{k: v for n, _ in BANDS for k, v in lanczos_cte(f"al_{n}", f"im_{n}", ["sheet"], "cw", "ch", A, A, 3).items()},
    "cov_m": "SELECT *, floor(west / 3) * 3 AS fw, ceil(east / 3) * 3 AS fe, floor(south / 3) * 3 AS fs, ceil(north / 3) * 3 AS fn, CAST(floor((ceil(east / 3) * 3 - floor(west / 3) * 3) * 30e0 + 0.5e0) AS BIGINT) AS mw, "
             "CAST(floor((ceil(north / 3) * 3 - floor(south / 3) * 3) * 30e0 + 0.5e0) AS BIGINT) AS mh FROM ts",
    "cov_w": COVER_WINDOW,
    "cov_x": "SELECT *, greatest(1, x1 - x0) AS cw, greatest(1, y1 - y0) AS ch, unnest(range(0, greatest(1, x1 - x0))) AS x FROM cov_w",
    "cov_y": "SELECT *, unnest(range(0, ch)) AS y FROM cov_x",
    "cov_t": f"""SELECT sheet, cw, ch, x, y, CAST(fw AS BIGINT) + (x0 + x) // {COVER_PX} * 3 AS tile_lon, CAST(fn AS BIGINT) - 3 - (y0 + y) // {COVER_PX} * 3 AS tile_lat,
      (x0 + x) % {COVER_PX} AS px, (y0 + y) % {COVER_PX} AS py FROM cov_y""",
    "cover": f"""SELECT sheet, cw, ch, x, y, CASE WHEN {NO_COVER} THEN 0 ELSE CASE (b + px) % 7 WHEN 0 THEN 255 WHEN 1 THEN 200 WHEN 2 THEN 150 WHEN 3 THEN 100 ELSE 0 END END AS v, NOT ({NO_COVER}) AS there
      FROM (SELECT *, (abs(tile_lon * 31 + tile_lat * 17) + py) % total.n AS e FROM cov_t, total) JOIN lines USING (e)""",
    # A tile of the grid that touches the box counts as land cover, also beyond the pixels that are read.
    "covered": f"SELECT DISTINCT sheet FROM (SELECT sheet, unnest(range(CAST(floor(south / 3) * 3 AS BIGINT), CAST(ceil(north / 3) * 3 AS BIGINT), 3)) AS tile_lat FROM ts) WHERE NOT ({NO_COVER})",
    **lanczos_cte("veg", "cover", ["sheet"], "cw", "ch", R, R, 2),
    **{k: PACKAGE[k].replace("(SELECT max(area_id) + 1 FROM el)", "(SELECT count(*) FROM ar)") for k in ("world", "bb", "ft", "tpx")},
    **on_tiles(polygon_cte("pw", KIND_SQL["water"])), **on_tiles(polygon_cte("pb", KIND_SQL["buildings"])), **on_tiles(polygon_cte("pg", KIND_SQL["vegetation"])),
    **on_tiles(line_cte("pr", KIND_SQL["roads"], "1e0")),
    "grown": "SELECT sheet, x, y, floor(greatest(0e0, least(255e0, v)) + 0.5e0) AS v FROM veg JOIN covered USING (sheet) UNION ALL SELECT sheet, x, y, 255 FROM pg WHERE sheet NOT IN (SELECT sheet FROM covered)",
    "vgn": """SELECT sheet, count(*) AS n FROM grown v WHERE v >= 128 AND NOT EXISTS (SELECT 1 FROM pw w WHERE w.sheet = v.sheet AND w.x = v.x AND w.y = v.y)
      AND NOT EXISTS (SELECT 1 FROM pr w WHERE w.sheet = v.sheet AND w.x = v.x AND w.y = v.y) GROUP BY sheet""",
    "fc": PACKAGE["fc"],
}


def per_tile(name):
    return f"coalesce((SELECT count(*) FROM {name} p WHERE p.sheet = t.sheet), 0)"


def band_sum(name):
    return f"CAST((SELECT sum(floor(greatest(0e0, least(255e0, v)) + 0.5e0)) FROM al_{name} p WHERE p.sheet = t.sheet) AS BIGINT)"


@query("export_from_tiles", recursive(with_ctes(*FEAT, **EXPORT)) + f"""SELECT area_id, r AS "row", c AS col, {q6('z_min')} AS z_min, {q6('z_max')} AS z_max, n_pixels, level_sum,
  {per_tile('pr')} AS road_px, {per_tile('pw')} AS water_px, coalesce((SELECT n FROM vgn p WHERE p.sheet = t.sheet), 0) AS vegetation_px, {per_tile('pb')} AS building_px,
  coalesce((SELECT n FROM cln p WHERE p.sheet = t.sheet), 0) AS cliff_px, {band_sum('r')} AS r_sum, {band_sum('g')} AS g_sum, {band_sum('b')} AS b_sum,
  coalesce(n_buildings, 0) AS n_buildings, coalesce(n_roads, 0) AS n_roads FROM ts t JOIN sta USING (sheet) JOIN qua USING (sheet) LEFT JOIN fc USING (sheet)""")
def _(spark, sf):
    out = terrain.package_report(package(spark, sf), "area_id", SETTINGS)
    return out.select(
        "area_id", "row", "col", r6("z_min").alias("z_min"), r6("z_max").alias("z_max"), "n_pixels", "level_sum", *[f"{k}_px" for k, *_ in masks.MASK_KINDS],
        "r_sum", "g_sum", "b_sum", "n_buildings", "n_roads",
    )


@query("decode_tiles", with_ctes(**{k: EXPORT[k] for k in ("total", "lines", "ar", "tg", "th", "ti", "ts", "iw_z", "iw_g")}) + f"""SELECT z, tile_x, tile_y, NOT ({BROKEN}) AS success,
  CASE WHEN {BROKEN} THEN 'ValueError: 196603 bytes are no square of 3 bands' END AS error, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN {BROKEN} THEN 0 ELSE (b * 3 + px * 5) % 256 * ((py * 256 + px) % 1009) END) AS BIGINT) AS green
  FROM (SELECT *, unnest(range(0, 256)) AS px, {EVENT_SQL} AS e FROM total, (SELECT *, unnest(range(0, 256)) AS py FROM (SELECT DISTINCT z, tile_x, tile_y FROM
    (SELECT *, unnest(range(min_y, max_y + 1)) AS tile_y FROM (SELECT *, unnest(range(min_x, max_x + 1)) AS tile_x FROM iw_g)))))
  JOIN lines USING (e) GROUP BY ALL""")
def _(spark, sf):
    """Every requested tile with its pixels, black where its file is broken, and the reason."""
    tiles = terrain.TerrainPackage(areas(spark, sf), "area_id", None, None, None, SETTINGS).tiles
    wanted = catalogs.tile_catalog(tiles, geo.choose_zoom(*SIDES, F.lit(A), geo.IMAGERY_MAX_ZOOM)).select(*WEB).distinct()
    found = images.decode_tiles(files(spark, sf, wanted, WEB, 256, PHOTO_RGB, BROKEN), WEB, images.raw_image(3))
    outcome = images.tile_outcomes(wanted, found, WEB)
    frames = wanted.select(*WEB, *[F.lit(v).cast("bigint").alias(n) for n, v in (("left", 0), ("top", 0), ("src_w", 256), ("src_h", 256), ("dst_w", 256), ("dst_h", 256))])
    full = blocks.resampled(found.filter("error IS NULL"), frames, WEB, WEB, "copy", 3, 0.0)
    size = F.col("w") * F.col("h")
    weighed = F.transform(F.slice("v", size + 1, size), lambda v, i: v * (i % 1009))
    green = F.aggregate(weighed, F.lit(0.0), lambda a, v: a + v).cast("bigint")
    sums = full.groupBy(*WEB).agg(F.sum(size.cast("bigint")).alias("n"), F.sum(green).alias("green"))
    return outcome.join(sums, WEB)
