"""Registry of queries and the tables they are run on.

The given tables hold no coordinates, so boxes, points, rasters and features are derived from
their keys and values by integer arithmetic. A derivation that both engines can read is written
once, as a list of SQL expressions over one table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SIDE = 256          # raster side of a feature sheet
TILE = 50           # raster side of an elevation tile
SHEET_FEATURES = 1000


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def r6(c) -> Column:
    """Six decimals, never a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def q6(expr: str) -> str:
    return f"(round({expr}, 6) + 0e0)"


def div(a: str, b: int) -> str:
    return f"CAST((({a}) - ({a}) % {b}) / {b} AS BIGINT)"


def pick(key: str, values: list[str | None], modulus: int | None = None) -> str:
    """CASE over ``key % modulus``; remainders that are not listed give NULL."""
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None)
    return f"CASE {key} % {modulus or len(values)} {arms} ELSE NULL END"


GX, GY = "event_id % 100", div("event_id", 100)
K = "c_custkey"
WEST, SOUTH = f"CAST(-170 + ({K} * 7) % 330 AS DOUBLE)", f"CAST(-60 + ({K} * 11) % 110 AS DOUBLE)"
P = "p_partkey"

# name -> (table, expressions) readable by both engines
SHARED: dict[str, tuple[str, list[str]]] = {
    "dem": ("events", [
        f"{div(GY, TILE)} AS tile_row", f"{div(GX, TILE)} AS tile_col", f"({GX}) % {TILE} AS x", f"({GY}) % {TILE} AS y",
        f"{GX} AS gx", f"{GY} AS gy", "value AS z",
        "CASE WHEN event_id % 97 = 0 THEN CAST('NaN' AS DOUBLE) ELSE value END AS z_nan",
    ]),
    "dem_rgb": ("events", [
        f"{GX} AS x", f"{GY} AS y", "128 + event_id % 4 AS r", "(event_id * 7) % 256 AS g", "(event_id * 13) % 256 AS b",
        "255 AS a", f"{pick('event_id', ['aws-terrarium', 'mapbox-terrain-rgb', 'mapzen'])} AS source",
    ]),
    "landcover": ("events", [
        f"{div(GY, TILE)} AS tile_row", f"{div(GX, TILE)} AS tile_col", f"({GX}) % {TILE} AS x", f"({GY}) % {TILE} AS y",
        f"{GX} AS gx", f"{GY} AS gy",
        "CAST(CASE event_id % 7 WHEN 0 THEN 10 WHEN 1 THEN 20 WHEN 2 THEN 30 WHEN 3 THEN 40 WHEN 4 THEN 50 WHEN 5 THEN 60 ELSE 80 END AS INT) AS cls",
    ]),
    "boxes": ("customer", [
        f"{K} AS box_id", f"{WEST} AS west", f"{SOUTH} AS south",
        f"CASE WHEN {K} % 29 = 0 THEN {WEST} - 1 ELSE {WEST} + (1 + {K} % 40) / 20 END AS east",
        f"{SOUTH} + (1 + ({K} * 3) % 30) / 20 AS north",
        f"{pick(K, ['aws-terrarium', 'mapzen', 'mapbox-terrain-rgb', 'opentopo-srtmgl1', 'opentopo-srtmgl3', 'opentopo-aw3d30', 'opentopo-cop30', 'opentopo-nasadem', 'opentopo-usgs10m', 'nasa-earthdata', 'lost-source'])} AS dem_source",
        f"{pick(K, ['arcgis', 'mapbox', 'maptiler'])} AS imagery_source",
        f"CONCAT('k ', CAST({K} AS VARCHAR(20)), '&') AS api_key",
        f"{pick(K, ['png', 'r16', 'float32', 'geotiff', 'dem'])} AS height_format",
        f"{pick(K, ['png', 'geotiff'])} AS image_format",
        f"{pick(K, ['unigine', 'unreal', 'blender', 'generic', 'babylon', 'other'])} AS preset",
        f"{pick(K, ['city', 'town', 'village', 'address', 'landmark', 'river'])} AS place_type",
        f"CAST({K} % 21 AS INT) AS asked_zoom",
        f"{pick(K, ['point', 'area'])} AS raster_type",
    ]),
    "points": ("events", [
        "event_id AS point_id", "-180 + ((event_id * 7919) % 36000) / 100 AS lon", "-80 + ((event_id * 10473) % 16000) / 100 AS lat",
        "CAST(5 + event_id % 10 AS INT) AS zoom",
    ]),
    "tags": ("part", [
        f"{P} AS id",
        f"CASE {P} % 6 WHEN 0 THEN CAST(p_size AS VARCHAR(20)) WHEN 1 THEN '12.5' WHEN 2 THEN 'abc' WHEN 3 THEN '' WHEN 4 THEN '5000' ELSE NULL END AS height",
        f"CASE {P} % 5 WHEN 0 THEN CAST({P} % 12 AS VARCHAR(20)) WHEN 1 THEN '3.5' WHEN 2 THEN '250' WHEN 3 THEN '4' ELSE NULL END AS levels",
        f"{pick(P, ['7.25', '0.1', '5 m', None])} AS width",
        f"{pick(P, ['2', '1.5', None])} AS lanes",
        f"{pick(P, ['motorway', 'primary', 'residential', 'footway', 'track', 'service', None])} AS highway",
        f"{pick(P, ['1', '-1', '2;3', 'x'], 8)} AS layer",
        f"{pick(P, ['yes', 'viaduct', 'no'], 9)} AS bridge",
        f"{pick(P, ['flat', 'gabled', 'dome'], 11)} AS roof_shape",
        f"{pick(P, ['2', '-1', '1.5'], 13)} AS min_level",
        f"{pick(P, ['asphalt', None, 'gravel'])} AS surface",
        f"{pick(P, ['yes', None, None, 'house'], 4)} AS building",
        f"{pick(P, ['water', 'wood', None, None, None])} AS natural_kind",
        f"{pick(P, ['forest', 'grass', 'reservoir', None, None, None, None])} AS landuse",
        f"{pick(P, ['park'], 6)} AS leisure",
        f"{pick(P, ['river'], 9)} AS waterway",
    ]),
    "progress": ("events", [
        "user_id AS job_id", "event_id", "ts", "value AS progress",
        "CASE event_type WHEN 'signup' THEN 'planning' WHEN 'view' THEN 'downloading' WHEN 'click' THEN 'processing' "
        "WHEN 'purchase' THEN 'complete' ELSE 'error' END AS state",
    ]),
    "typed": ("events", [
        "user_id", "event_id", "ts",
        "CASE WHEN event_id % 5 = 0 THEN CONCAT(' ', CAST(event_id % 10 AS VARCHAR(20)), ' ') "
        "ELSE CONCAT(event_type, CAST(event_id % 10 AS VARCHAR(20)), ' ') END AS q",
    ]),
    "urls": ("pages", ["page_id", "CONCAT(url, '?API_Key=abc', CAST(page_id AS VARCHAR(20)), '&KEY=k1&Access_Token=t', CAST(page_id AS VARCHAR(20)), '&monkey=2') AS url"]),
}
TAG_NAMES = {
    "height": "height", "levels": "building:levels", "width": "width", "lanes": "lanes", "highway": "highway", "layer": "layer",
    "bridge": "bridge", "roof_shape": "roof:shape", "min_level": "building:min_level", "surface": "surface",
    "building": "building", "natural_kind": "natural", "landuse": "landuse", "leisure": "leisure", "waterway": "waterway",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def deal(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by key, for operators that multiply rows before their first shuffle."""
    return df.repartition(*keys)


def fx(spark: SparkSession, sf: str, name: str) -> DataFrame:
    source, exprs = SHARED[name]
    return table(spark, sf, source).selectExpr(*exprs)


def boxes(spark, sf) -> DataFrame:
    """Boxes with valid bounds."""
    return deal(fx(spark, sf, "boxes").filter("west < east"), "box_id")


def features(spark, sf) -> DataFrame:
    """Diamonds on sheets of 1000: sheet, type, id, geometry, tags and the box 0..1 of a sheet."""
    part = fx(spark, sf, "tags")
    pairs = [x for column, name in TAG_NAMES.items() for x in (F.lit(name), F.col(column))]
    tagged = part.select(
        F.col("id").alias("part_id"), F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()).alias("tags")
    )
    total = table(spark, sf, "part").agg(F.count(F.lit(1))).scalar()
    # Both sides are shuffled, whatever Spark takes them for: tags of many parts are no table for the driver.
    keys = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % total).alias("part_id"))
    k = F.col("o_orderkey")

    def spot(dx, dy):
        px, py = (k * 37) % SIDE + dx, (k * 91) % SIDE + dy
        return F.struct((F.lit(1) - py / (SIDE - 1)).alias("lat"), (px / (SIDE - 1)).alias("lon"))

    r, rv = k % 7 + 2, k % 5 + 2
    zero, one, nil = F.lit(0), F.lit(1.0), F.lit(0.0)
    return keys.join(tagged.hint("merge"), "part_id").select(
        F.floor(k / SHEET_FEATURES).alias("sheet"), F.when(k % 10 == 0, F.lit("relation")).otherwise(F.lit("way")).alias("type"),
        k.alias("id"), F.array(spot(-r, zero), spot(zero, -rv), spot(r, zero), spot(zero, rv)).alias("geometry"), "tags",
        nil.alias("west"), nil.alias("south"), one.alias("east"), one.alias("north"),
    )


OK_ = "o_orderkey"
CTES: dict[str, str] = {name: f"SELECT {', '.join(e)} FROM {t}" for name, (t, e) in SHARED.items()}
CTES["valid_boxes"] = "SELECT * FROM boxes WHERE west < east"
CTES["feat"] = f"""
SELECT {div(OK_, SHEET_FEATURES)} AS sheet, CASE WHEN {OK_} % 10 = 0 THEN 'relation' ELSE 'way' END AS type, {OK_} AS fid, t.*
FROM orders JOIN tags t ON t.id = {OK_} % (SELECT count(*) FROM part)"""
CTES["ring"] = f"""
SELECT {div(OK_, SHEET_FEATURES)} AS sheet, {OK_} AS fid, v.ord,
       (({OK_} * 37) % {SIDE} + v.sx * ({OK_} % 7 + 2)) / {SIDE - 1} AS lon,
       1 - (({OK_} * 91) % {SIDE} + v.sy * ({OK_} % 5 + 2)) / {SIDE - 1} AS lat
FROM orders, (VALUES (0, -1, 0), (1, 0, -1), (2, 1, 0), (3, 0, 1)) v(ord, sx, sy)"""
CTES["ring_px"] = f"""
SELECT sheet, fid, ord,
       CAST(floor(greatest(0e0, least({SIDE - 1}e0, lon * {SIDE - 1}e0)) + 0.5e0) AS BIGINT) AS x,
       CAST(floor(greatest(0e0, least({SIDE - 1}e0, (1e0 - lat) * {SIDE - 1}e0)) + 0.5e0) AS BIGINT) AS y
FROM ring"""
KIND_SQL = {
    "roads": "type = 'way' AND highway IS NOT NULL",
    "water": "(type = 'way' AND (coalesce(natural_kind, '') = 'water' OR waterway IS NOT NULL OR coalesce(landuse, '') = 'reservoir')) "
             "OR (type = 'relation' AND coalesce(natural_kind, '') = 'water')",
    "vegetation": "(type = 'way' AND (coalesce(landuse, '') IN ('forest', 'grass') OR coalesce(natural_kind, '') = 'wood' OR coalesce(leisure, '') = 'park')) "
                  "OR (type = 'relation' AND coalesce(landuse, '') = 'forest')",
    "buildings": "building IS NOT NULL",
}


def with_ctes(*names: str, **extra: str) -> str:
    """WITH clause of the named derivations, in the given order, then of ``extra`` ones."""
    parts = [f"{n} AS ({CTES[n]})" for n in names] + [f"{n} AS ({s})" for n, s in extra.items()]
    return "WITH " + ",\n".join(parts) + "\n"


def polygon_cte(name: str, where: str) -> dict[str, str]:
    """Even-odd fill of the rings whose feature meets ``where``: pixels (sheet, x, y)."""
    return {
        f"{name}_e": f"""SELECT a.sheet, a.fid, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM ring_px a
            JOIN ring_px b ON a.fid = b.fid AND b.ord = (a.ord + 1) % 4 JOIN feat f ON f.fid = a.fid WHERE {where}""",
        f"{name}_y": f"SELECT *, unnest(range(least(y1, y2), greatest(y1, y2))) AS y FROM {name}_e WHERE y1 <> y2",
        f"{name}_c": f"SELECT sheet, fid, y, x1 + (y - y1) / (y2 - y1) * (x2 - x1) AS cx FROM {name}_y",
        f"{name}_s": f"""SELECT sheet, fid, y, cx, row_number() OVER w AS rn, lead(cx) OVER w AS nx FROM {name}_c
            WINDOW w AS (PARTITION BY sheet, fid, y ORDER BY cx)""",
        f"{name}_sp": f"""SELECT sheet, fid, y, CAST(greatest(0, floor(cx + 0.5e0)) AS BIGINT) AS x_from,
            CAST(least({SIDE - 1}, floor(nx + 0.5e0)) AS BIGINT) AS x_to FROM {name}_s WHERE rn % 2 = 1 AND nx IS NOT NULL""",
        name: f"SELECT DISTINCT sheet, unnest(range(x_from, x_to + 1)) AS x, y FROM {name}_sp",
    }


def line_cte(name: str, where: str, radius: str) -> dict[str, str]:
    """Thick lines along the open rings: an explicit stepping walk and a table of disc offsets."""
    return {
        f"{name}_g": f"""SELECT a.sheet, a.fid, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2,
            abs(b.x - a.x) AS dx, abs(b.y - a.y) AS dy, sign(b.x - a.x) AS sx, sign(b.y - a.y) AS sy FROM ring_px a
            JOIN ring_px b ON a.fid = b.fid AND b.ord = a.ord + 1 JOIN feat f ON f.fid = a.fid WHERE {where}""",
        f"{name}_w": f"""SELECT sheet, fid, x1 AS cx, y1 AS cy, x2, y2, dx, dy, sx, sy, dx - dy AS err FROM {name}_g
            UNION ALL SELECT sheet, fid,
              CASE WHEN 2 * err > -dy THEN cx + sx ELSE cx END, CASE WHEN 2 * err < dx THEN cy + sy ELSE cy END, x2, y2, dx, dy, sx, sy,
              err - CASE WHEN 2 * err > -dy THEN dy ELSE 0 END + CASE WHEN 2 * err < dx THEN dx ELSE 0 END
            FROM {name}_w WHERE NOT (cx = x2 AND cy = y2)""",
        name: f"""SELECT DISTINCT sheet, cx + ox AS x, cy + oy AS y FROM {name}_w,
            (SELECT unnest(range(-5, 6)) AS ox) a, (SELECT unnest(range(-5, 6)) AS oy) b
            WHERE ox * ox + oy * oy <= ({radius}) * ({radius}) AND cx + ox BETWEEN 0 AND {SIDE - 1} AND cy + oy BETWEEN 0 AND {SIDE - 1}""",
    }


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)
