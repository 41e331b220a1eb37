"""Column expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from orograph.functions import features as ft
from orograph.functions import geo, heights, names
from orograph.functions.numbers import parse_number
from orograph.functions.rng import draw
from orograph.operators import checks, masks, presets, vectors
from orograph.sources import gazetteer

from .base import K, KIND_SQL, features, fx, pick, q6, query, r6, table, with_ctes

SIDES = ("west", "south", "east", "north")
WORLD_Y = "((1e0 - ln(tan(radians(lat)) + 1e0 / cos(radians(lat))) / pi()) / 2e0)"


@query("lng_to_pixel_x", with_ctes("points") + f"SELECT point_id, zoom, {q6('(lon + 180e0) / 360e0 * pow(2e0, zoom) * 256e0')} AS px FROM points")
def _(spark, sf):
    return fx(spark, sf, "points").select("point_id", "zoom", r6(geo.lng_to_pixel_x("lon", "zoom")).alias("px"))


@query("lat_to_pixel_y", with_ctes("points") + f"SELECT point_id, zoom, {q6(WORLD_Y + ' * pow(2e0, zoom) * 256e0')} AS py FROM points")
def _(spark, sf):
    return fx(spark, sf, "points").select("point_id", "zoom", r6(geo.lat_to_pixel_y("lat", "zoom")).alias("py"))


@query("lng_to_tile_x", with_ctes("points") + "SELECT point_id, zoom, CAST(floor((lon + 180e0) / 360e0 * pow(2e0, zoom)) AS BIGINT) AS tile_x FROM points")
def _(spark, sf):
    return fx(spark, sf, "points").select("point_id", "zoom", geo.lng_to_tile_x("lon", "zoom").alias("tile_x"))


@query("lat_to_tile_y", with_ctes("points") + f"SELECT point_id, zoom, CAST(floor({WORLD_Y} * pow(2e0, zoom)) AS BIGINT) AS tile_y FROM points")
def _(spark, sf):
    return fx(spark, sf, "points").select("point_id", "zoom", geo.lat_to_tile_y("lat", "zoom").alias("tile_y"))


@query("tile_x_to_lng", with_ctes("points") + f"SELECT point_id, {q6('(point_id % 1000) / pow(2e0, zoom) * 360e0 - 180e0')} AS lng FROM points")
def _(spark, sf):
    return fx(spark, sf, "points").select("point_id", r6(geo.tile_x_to_lng(F.col("point_id") % 1000, "zoom")).alias("lng"))


@query("tile_y_to_lat", with_ctes("points") + """SELECT point_id,
  (round(degrees(atan((exp(n) - exp(-n)) / 2e0)), 6) + 0e0) AS lat
  FROM (SELECT point_id, pi() - 2e0 * pi() * (point_id % 32) / pow(2e0, zoom) AS n FROM points)""")
def _(spark, sf):
    return fx(spark, sf, "points").select("point_id", r6(geo.tile_y_to_lat(F.col("point_id") % 32, "zoom")).alias("lat"))


@query("choose_zoom", with_ctes("boxes") + """, need AS (SELECT box_id, s, CASE WHEN least(east - west, north - south) <= 0 THEN NULL
    ELSE s * 360e0 / (least(east - west, north - south) * 256e0) END AS v FROM boxes, (VALUES (256), (1024), (4096)) t(s))
  SELECT box_id, s AS target_size,
    CAST(CASE WHEN v IS NULL THEN 10 ELSE least(15, greatest(1, (SELECT min(z) FROM range(-20, 60) r(z) WHERE pow(2e0, z) >= v))) END AS BIGINT) AS dem_zoom,
    CAST(CASE WHEN v IS NULL THEN 10 ELSE least(19, greatest(1, (SELECT min(z) FROM range(-20, 60) r(z) WHERE pow(2e0, z) >= v))) END AS BIGINT) AS img_zoom
  FROM need""")
def _(spark, sf):
    sized = fx(spark, sf, "boxes").select("*", F.explode(F.array(*[F.lit(s) for s in (256, 1024, 4096)])).alias("target_size"))
    return sized.select(
        "box_id", "target_size", geo.choose_zoom(*SIDES, "target_size", geo.ELEVATION_MAX_ZOOM).alias("dem_zoom"),
        geo.choose_zoom(*SIDES, "target_size", geo.IMAGERY_MAX_ZOOM).alias("img_zoom"),
    )


SIZE_SQL = """SELECT *, greatest(1e0, (east - west) * (111320e0 * cos(radians((north + south) * 0.5e0)))) AS width_m,
  greatest(1e0, (north - south) * 111320e0) AS height_m FROM boxes"""


@query("tile_size_meters", with_ctes("boxes", s=SIZE_SQL) + f"""SELECT box_id, {q6('width_m')} AS width_m, {q6('height_m')} AS height_m,
  {q6('greatest(width_m, height_m)')} AS chunk_m FROM s""")
def _(spark, sf):
    return fx(spark, sf, "boxes").select("box_id", *[r6(c).alias(n) for n, c in geo.tile_size_meters(*SIDES).items()])


# A raster size that makes the widths and heights of a box differ from point to point.
LOCAL = {
    "lp": "SELECT p.point_id, b.*, b.west + (p.point_id % 130 - 15) / 100e0 * (b.east - b.west) AS plon, "
          "b.south + (p.point_id % 170 - 35) / 100e0 * (b.north - b.south) AS plat "
          "FROM points p JOIN boxes b ON b.box_id = p.point_id % (SELECT count(*) FROM customer)",
}


def local_points(spark, sf):
    n = table(spark, sf, "customer").agg(F.count(F.lit(1))).scalar()
    p = fx(spark, sf, "points").select("point_id", (F.col("point_id") % n).alias("box_id"))
    return p.join(fx(spark, sf, "boxes"), "box_id").withColumn(
        "plon", F.col("west") + (F.col("point_id") % 130 - 15) / 100 * (F.col("east") - F.col("west"))
    ).withColumn("plat", F.col("south") + (F.col("point_id") % 170 - 35) / 100 * (F.col("north") - F.col("south")))


@query("geo_to_pixel", with_ctes("points", "boxes", **LOCAL) + """SELECT point_id,
  CAST(floor(greatest(0e0, least(1023e0, CASE WHEN east = west THEN 0.5e0 ELSE (plon - west) / (east - west) END * 1023e0)) + 0.5e0) AS BIGINT) AS px,
  CAST(floor(greatest(0e0, least(511e0, CASE WHEN north = south THEN 0.5e0 ELSE (north - plat) / (north - south) END * 511e0)) + 0.5e0) AS BIGINT) AS py FROM lp""")
def _(spark, sf):
    x, y = geo.geo_to_pixel("plat", "plon", *SIDES, 1024, 512)
    return local_points(spark, sf).select("point_id", x.alias("px"), y.alias("py"))


@query("geo_to_local", with_ctes("points", "boxes", **LOCAL) + f"""SELECT point_id,
  {q6('(plon - west) / (east - west) * 4000e0 - 2000e0')} AS lx, {q6('(plat - south) / (north - south) * 3000e0 - 1500e0')} AS lz FROM lp""")
def _(spark, sf):
    x, z = geo.geo_to_local("plat", "plon", *SIDES, F.lit(4000.0), F.lit(3000.0))
    return local_points(spark, sf).select("point_id", r6(x).alias("lx"), r6(z).alias("lz"))


@query("affine_georef", with_ctes("boxes") + f"""SELECT box_id,
  {q6("(east - west) / (1024 - CASE WHEN raster_type = 'point' THEN 1 ELSE 0 END)")} AS pixel_width,
  {q6("(south - north) / (512 - CASE WHEN raster_type = 'point' THEN 1 ELSE 0 END)")} AS pixel_height,
  {q6('west')} AS tie_lon, {q6('north')} AS tie_lat FROM boxes""")
def _(spark, sf):
    return fx(spark, sf, "boxes").select("box_id", *[r6(c).alias(n) for n, c in geo.affine_georef(*SIDES, 1024, 512, "raster_type").items()])


TERRARIUM, RGB = "r * 256e0 + g + b / 256e0 - 32768e0", "-10000e0 + (r * 65536e0 + g * 256e0 + b) * 0.1e0"


@query("decode_terrarium", with_ctes("dem_rgb") + f"SELECT x, y, {q6(TERRARIUM)} AS z FROM dem_rgb")
def _(spark, sf):
    return fx(spark, sf, "dem_rgb").select("x", "y", r6(heights.decode_terrarium("r", "g", "b")).alias("z"))


@query("decode_terrain_rgb", with_ctes("dem_rgb") + f"SELECT x, y, {q6(RGB)} AS z FROM dem_rgb")
def _(spark, sf):
    return fx(spark, sf, "dem_rgb").select("x", "y", r6(heights.decode_terrain_rgb("r", "g", "b")).alias("z"))


@query("decode_dem", with_ctes("dem_rgb") + f"SELECT x, y, source, CASE WHEN source = 'mapbox-terrain-rgb' THEN {q6(RGB)} ELSE {q6(TERRARIUM)} END AS z FROM dem_rgb")
def _(spark, sf):
    return fx(spark, sf, "dem_rgb").select("x", "y", "source", r6(heights.decode_elevation("source", "r", "g", "b")).alias("z"))


@query("drop_alpha", with_ctes("dem_rgb") + "SELECT x, y, r, g, b FROM dem_rgb")
def _(spark, sf):
    return fx(spark, sf, "dem_rgb").drop("source").drop("a")


INTENSITY = "CASE cls WHEN 10 THEN 255 WHEN 20 THEN 200 WHEN 30 THEN 150 WHEN 40 THEN 100 ELSE 0 END"


@query("vegetation_intensity", with_ctes("landcover") + f"SELECT gx, gy, {INTENSITY} AS v FROM landcover")
def _(spark, sf):
    return fx(spark, sf, "landcover").select("gx", "gy", heights.vegetation_intensity("cls").alias("v"))


@query("threshold_mask", with_ctes("dem", "landcover") + f"""SELECT d.gx, d.gy, CASE WHEN z >= 45 THEN 255 ELSE 0 END AS steep,
  ({INTENSITY}) >= 128 AS vegetated FROM dem d JOIN landcover l ON d.gx = l.gx AND d.gy = l.gy""")
def _(spark, sf):
    cover = fx(spark, sf, "landcover").select("gx", "gy", (heights.threshold_mask(heights.vegetation_intensity("cls"), F.lit(128)) > 0).alias("vegetated"))
    return fx(spark, sf, "dem").select("gx", "gy", heights.threshold_mask("z", F.lit(45)).alias("steep")).join(cover, ["gx", "gy"])


@query("nodata_to_zero", with_ctes("dem") + """SELECT gx, gy, CASE WHEN tile_col = 0 AND z = 1.63e0 THEN 0e0 ELSE z END AS z FROM dem""")
def _(spark, sf):
    nodata = F.when(F.col("tile_col") == 0, F.lit(1.63))
    return fx(spark, sf, "dem").withColumn("nodata", nodata).select("gx", "gy", heights.nodata_to_zero("z", "nodata").alias("z"))


@query("quantize_i16", with_ctes("dem") + "SELECT gx, gy, CAST(CASE WHEN isnan(z_nan) THEN 0 ELSE floor(greatest(-32768e0, least(32767e0, z_nan * 100 - 200)) + 0.5e0) END AS INTEGER) AS q FROM dem")
def _(spark, sf):
    return fx(spark, sf, "dem").select("gx", "gy", heights.quantize_i16(F.col("z_nan") * 100 - 200).alias("q"))


@query("float_heights", with_ctes("dem") + "SELECT gx, gy, CASE WHEN isnan(z_nan) THEN 0e0 ELSE z_nan END AS h FROM dem")
def _(spark, sf):
    return fx(spark, sf, "dem").select("gx", "gy", heights.float_height("z_nan").alias("h"))


@query("tile_file_names", with_ctes("boxes") + """SELECT box_id,
  'tile_' || box_id % 7 || '_' || box_id % 5 || '_heightmap.' || CASE height_format WHEN 'png' THEN 'png' WHEN 'r16' THEN 'r16' ELSE 'tif' END AS heightmap,
  'tile_' || box_id % 7 || '_' || box_id % 5 || '_albedo.' || CASE image_format WHEN 'png' THEN 'png' ELSE 'tif' END AS albedo,
  CASE height_format WHEN 'float32' THEN 'Float32 GeoTIFF' WHEN 'geotiff' THEN 'UInt16 GeoTIFF (normalized)' WHEN 'dem' THEN 'DEM (Int16 GeoTIFF)'
    WHEN 'r16' THEN 'R16 (Raw 16-bit)' ELSE 'PNG (16-bit grayscale)' END AS format_label FROM boxes""")
def _(spark, sf):
    out = names.tile_file_names(F.col("box_id") % 7, F.col("box_id") % 5, "height_format", "image_format")
    return fx(spark, sf, "boxes").select("box_id", *[c.alias(n) for n, c in out.items()])


@query("redact_url", with_ctes("urls") + r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, 'API_Key=[^&]+', 'API_Key=****', 'gi'),
  'access_token=[^&]+', 'access_token=****', 'gi'), '\bkey=[^&]+', 'key=****', 'gi') AS url FROM urls""")
def _(spark, sf):
    return fx(spark, sf, "urls").select("page_id", names.redact_url("url").alias("url"))


# Paths of three kinds, from the page table.
PATHS = ["page_id", "CONCAT(CASE page_id % 4 WHEN 0 THEN CONCAT('pkg/tile_', CAST(page_id % 9 AS VARCHAR(20)), '_', CAST(page_id % 11 AS VARCHAR(20)), '/h') "
         "WHEN 1 THEN CONCAT('tile_', CAST(page_id AS VARCHAR(20)), '_3_heightmap') WHEN 2 THEN 'pkg/none' ELSE 'x/tile_1_2/tile_4_5_h' END, "
         + pick("page_id", [".png", ".TIF", ".tiff", ".R16", ".jpg"]) + ") AS path"]


@query("path_tile_coords", f"""WITH p AS (SELECT {', '.join(PATHS)} FROM pages) SELECT page_id,
  CAST(CASE page_id % 4 WHEN 0 THEN page_id % 9 WHEN 1 THEN page_id WHEN 2 THEN NULL ELSE 1 END AS BIGINT) AS tile_row,
  CAST(CASE page_id % 4 WHEN 0 THEN page_id % 11 WHEN 1 THEN 3 WHEN 2 THEN NULL ELSE 2 END AS BIGINT) AS tile_col,
  CASE WHEN lower(path) LIKE '%.tif' OR lower(path) LIKE '%.tiff' THEN 'tif' WHEN lower(path) LIKE '%.r16' THEN 'r16' ELSE 'png' END AS format FROM p""")
def _(spark, sf):
    row, column = names.path_tile_coords("path")
    return table(spark, sf, "pages").selectExpr(*PATHS).select(
        "page_id", row.alias("tile_row"), column.alias("tile_col"), names.height_format_of("path").alias("format")
    )


@query("search_trigger", with_ctes("typed") + "SELECT event_id, trim(q) AS q FROM typed WHERE length(trim(q)) >= 3")
def _(spark, sf):
    return fx(spark, sf, "typed").filter(names.search_trigger("q")).select("event_id", names.trimmed("q").alias("q"))


NUM = r"'^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$'"


def num(c):
    return f"CASE WHEN regexp_matches({c}, {NUM}) THEN TRY_CAST(trim({c}) AS DOUBLE) END"


@query("parse_numeric_tag", with_ctes("tags") + f"SELECT id, {num('height')} AS height_n, {num('levels')} AS levels_n, {num('width')} AS width_n FROM tags")
def _(spark, sf):
    return fx(spark, sf, "tags").select("id", *[parse_number(c).alias(f"{c}_n") for c in ("height", "levels", "width")])


LEVELS_OK = f"CASE WHEN ({num('levels')}) BETWEEN 1 AND 200 AND ({num('levels')}) = floor({num('levels')}) THEN {num('levels')} END"
HEIGHT_OK = f"CASE WHEN ({num('height')}) BETWEEN 0.1e0 AND 1000 THEN {num('height')} END"
HEIGHT_SQL = f"coalesce({HEIGHT_OK}, ({LEVELS_OK}) * 3e0, 10e0)"
FLOORS_SQL = f"CAST(coalesce({LEVELS_OK}, greatest(1, floor({HEIGHT_SQL} / 3e0 + 0.5e0))) AS BIGINT)"
MINLEVEL_SQL = f"CAST(coalesce(CASE WHEN ({num('min_level')}) BETWEEN 0 AND 200 AND ({num('min_level')}) = floor({num('min_level')}) THEN {num('min_level')} END, 0) AS BIGINT)"
ROOF_SQL = "CASE WHEN roof_shape IN ('flat', 'gabled', 'hipped', 'pyramidal') THEN roof_shape END"
CLASS_WIDTH = ("CASE highway WHEN 'motorway' THEN 12e0 WHEN 'trunk' THEN 10e0 WHEN 'primary' THEN 8e0 WHEN 'secondary' THEN 7e0 WHEN 'tertiary' THEN 6e0 "
               "WHEN 'residential' THEN 5e0 WHEN 'service' THEN 3.5e0 WHEN 'footway' THEN 2e0 WHEN 'path' THEN 2e0 WHEN 'cycleway' THEN 2e0 ELSE 4e0 END")
WIDTH_SQL = (f"coalesce(CASE WHEN ({num('width')}) BETWEEN 0.5e0 AND 50 THEN {num('width')} END, "
             f"CASE WHEN ({num('lanes')}) > 0 AND ({num('lanes')}) = floor({num('lanes')}) THEN ({num('lanes')}) * 3.5e0 END, {CLASS_WIDTH})")
LAYER_SQL = r"coalesce(TRY_CAST(regexp_extract(layer, '^\s*([+-]?[0-9]+)', 1) AS BIGINT), 0)"
BRIDGE_SQL = f"CASE WHEN {LAYER_SQL} > 0 THEN {LAYER_SQL} * 5e0 WHEN coalesce(bridge, '') IN ('yes', 'viaduct') THEN 5e0 ELSE 0e0 END"


@query("building_height_floors", with_ctes("tags") + f"SELECT id, {HEIGHT_SQL} AS height_m, {FLOORS_SQL} AS floors FROM tags")
def _(spark, sf):
    return fx(spark, sf, "tags").select(
        "id", ft.building_height("height", "levels", F.lit(10.0)).alias("height_m"), ft.building_floors("height", "levels", F.lit(10.0)).alias("floors")
    )


@query("roof_shape", with_ctes("tags") + f"SELECT id, {ROOF_SQL} AS roof FROM tags")
def _(spark, sf):
    return fx(spark, sf, "tags").select("id", ft.roof_shape("roof_shape").alias("roof"))


@query("min_level", with_ctes("tags") + f"SELECT id, {MINLEVEL_SQL} AS min_level FROM tags")
def _(spark, sf):
    return fx(spark, sf, "tags").select("id", ft.min_level("min_level").alias("min_level"))


@query("road_width", with_ctes("tags") + f"SELECT id, {WIDTH_SQL} AS width_m FROM tags")
def _(spark, sf):
    return fx(spark, sf, "tags").select("id", ft.road_width("width", "lanes", "highway").alias("width_m"))


@query("road_layer", with_ctes("tags") + f"SELECT id, {LAYER_SQL} AS layer FROM tags")
def _(spark, sf):
    return fx(spark, sf, "tags").select("id", ft.road_layer("layer").alias("layer"))


@query("bridge_offset", with_ctes("tags") + f"SELECT id, {BRIDGE_SQL} AS rise FROM tags")
def _(spark, sf):
    return fx(spark, sf, "tags").select("id", ft.bridge_offset(ft.road_layer("layer"), "bridge").alias("rise"))


@query("road_base_y", with_ctes("tags") + f"SELECT id, CASE WHEN id % 2 = 0 THEN {q6('(id % 300 + (id % 300 + id % 70)) / 2e0 * 1.5e0 + 0.25e0')} ELSE 0.1e0 END AS y FROM tags")
def _(spark, sf):
    low = F.col("id") % 300
    return fx(spark, sf, "tags").select("id", r6(ft.road_base_y(low, low + F.col("id") % 70, F.lit(1.5), F.lit(0.25), F.col("id") % 2 == 0)).alias("y"))


@query("building_base_y", with_ctes("tags") + f"""SELECT id, {q6('''CASE WHEN id % 2 = 0 THEN (id % 300 + (id % 70) *
  ((greatest(0e0, least(1e0, ((id % 50 - 25) * 100e0 + 2000e0) / 4000e0)) + greatest(0e0, least(1e0, ((id % 30 - 15) * 150e0 + 1500e0) / 3000e0))) / 2e0)) * 1.5e0
  ELSE 0e0 END + (id % 4) * 3e0 + id % 9''')} AS y FROM tags""")
def _(spark, sf):
    i = F.col("id")
    y = ft.building_base_y((i % 50 - 25) * 100.0, (i % 30 - 15) * 150.0, F.lit(4000.0), F.lit(3000.0), i % 300, i % 300 + i % 70,
                           F.lit(1.5), i % 4, i % 9, i % 2 == 0)
    return fx(spark, sf, "tags").select("id", r6(y).alias("y"))


@query("mesh_height_range", with_ctes("dem", s="SELECT tile_row, tile_col, y, min(z_nan) AS lo, max(z_nan) AS hi FROM dem GROUP BY ALL") + f"""
  SELECT tile_row, tile_col, y, {q6('greatest(2e0, CASE WHEN isnan(hi) THEN 100e0 ELSE hi END - lo) * 1.5e0')} AS mesh_range,
  {q6('greatest(1e0, CASE WHEN isnan(hi) THEN 100e0 ELSE hi END - lo)')} AS strength FROM s""")
def _(spark, sf):
    s = fx(spark, sf, "dem").groupBy("tile_row", "tile_col", "y").agg(F.min("z_nan").alias("lo"), F.max("z_nan").alias("hi"))
    hi = F.when(F.isnan("hi"), F.lit(None).cast("double")).otherwise(F.col("hi"))
    return s.select("tile_row", "tile_col", "y", r6(ft.mesh_height_range("lo", "hi")).alias("mesh_range"), r6(ft.displacement_strength("lo", hi)).alias("strength"))


RNG_SQL = """d0 AS (SELECT event_id, (42 + CAST(((event_id + 1)::HUGEINT * 1831565813) % 4294967296 AS BIGINT)) & 4294967295 AS s FROM events),
  d1 AS (SELECT event_id, CAST(((xor(s, s >> 15))::HUGEINT * (s | 1)) % 4294967296 AS BIGINT) AS t FROM d0),
  d2 AS (SELECT event_id, xor((t + CAST(((xor(t, t >> 7))::HUGEINT * (t | 61)) % 4294967296 AS BIGINT)) & 4294967295, t) AS u FROM d1)"""


@query("rng", f"WITH {RNG_SQL} SELECT event_id, xor(u, u >> 14) / 4294967296e0 AS draw FROM d2")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", draw(42, "event_id").alias("draw"))


# --- predicates and checks ------------------------------------------------------------------

BOUND_ERRORS = """concat_ws('; ', CASE WHEN west >= east THEN 'west is not below east' END, CASE WHEN south >= north THEN 'south is not below north' END,
  CASE WHEN west < -180 OR east > 180 THEN 'longitude outside -180..180' END, CASE WHEN south < -90 OR north > 90 THEN 'latitude outside -90..90' END)"""


@query("validate_bounds", with_ctes("boxes") + f"SELECT box_id, {BOUND_ERRORS} AS errors, {BOUND_ERRORS} = '' AS valid FROM boxes")
def _(spark, sf):
    return checks.validate_bounds(fx(spark, sf, "boxes")).select("box_id", F.array_join("errors", "; ").alias("errors"), "valid")


def zoom_sql(size, cap):
    return f"CASE WHEN least(east - west, north - south) <= 0 THEN 10 ELSE least({cap}, greatest(1, ceil(log2({size} * 360e0 / (least(east - west, north - south) * 256e0))))) END"


def tiles_sql(z):
    def wy(side):
        return f"((1e0 - ln(tan(radians({side})) + 1e0 / cos(radians({side}))) / pi()) / 2e0)"
    return (f"((floor((east + 180e0) / 360e0 * pow(2e0, {z})) - floor((west + 180e0) / 360e0 * pow(2e0, {z})) + 1) * "
            f"(floor({wy('south')} * pow(2e0, {z})) - floor({wy('north')} * pow(2e0, {z})) + 1))")


@query("export_cost_estimate", with_ctes(
    "boxes", z=f"SELECT *, {zoom_sql(1024, 15)} AS dz, CASE WHEN asked_zoom > 0 THEN asked_zoom ELSE {zoom_sql(1024, 19)} END AS iz FROM boxes",
    n=f"SELECT *, CAST({tiles_sql('dz')} AS BIGINT) AS dn, CAST({tiles_sql('iz')} AS BIGINT) AS im, dem_source LIKE 'opentopo-%' AS whole FROM z",
    m="SELECT *, CASE WHEN whole THEN 1 ELSE dn END + im AS total_tiles, (CASE WHEN whole THEN 1024 * 1024 ELSE dn * 65536 END + im * 65536) * 4 AS memory_bytes FROM n",
) + f"""SELECT box_id, CAST(dz AS BIGINT) AS dem_zoom, CAST(iz AS BIGINT) AS img_zoom, total_tiles, memory_bytes,
  concat_ws('; ', nullif({BOUND_ERRORS}, ''), CASE WHEN total_tiles > 1024 THEN 'more than 1024 tiles' END,
    CASE WHEN memory_bytes > 2147483648 THEN 'more than 2048 MB of memory' END,
    CASE WHEN im * 262144 > 512 * 1048576 THEN 'imagery mosaic above 512 MB' END) AS errors,
  concat_ws('; ', CASE WHEN total_tiles > 256 THEN 'more than 256 tiles may take long' END, CASE WHEN iz > 17 THEN 'imagery zoom above 17 is slow' END) AS warnings FROM m""")
def _(spark, sf):
    return checks.export_cost_estimate(fx(spark, sf, "boxes"), imagery_zoom="asked_zoom").select(
        "box_id", "dem_zoom", "img_zoom", "total_tiles", "memory_bytes",
        F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"),
    )


def _tag_filter(kind):
    @query(f"tag_filter_{kind}", with_ctes("tags", "feat") + f"SELECT sheet, fid AS id, type FROM feat WHERE {KIND_SQL[kind]}")
    def _(spark, sf):
        return features(spark, sf).filter(vectors.tag_filter(kind)).select("sheet", "id", "type")


for _kind in KIND_SQL:
    _tag_filter(_kind)


@query("min_vertex_filter", f"""SELECT o_orderkey AS id, o_orderkey % 6 AS n, o_orderkey % 6 >= 3 AS polygon_ok, o_orderkey % 6 >= 2 AS line_ok,
  o_orderkey % 6 >= 4 AS building_ok, o_orderkey % 6 >= 2 AS road_ok FROM orders""")
def _(spark, sf):
    k = F.col("o_orderkey")
    made = table(spark, sf, "orders").select(k.alias("id"), (k % 6).alias("n"), F.array_repeat(F.struct(F.lit(0.0).alias("lat")), (k % 6).cast("int")).alias("g"))
    return made.select("id", "n", *[vectors.min_vertices("g", u).alias(f"{u}_ok") for u in ("polygon", "line", "building", "road")])


SETTINGS = [f"{K} AS box_id", f"CONCAT('tile_', CAST({K} % 9 AS VARCHAR(20)), '_', CAST({K} % 4 AS VARCHAR(20))) AS tile_prefix",
            f"{K} % 2 = 0 AS road_on", f"{K} % 3 = 0 AS water_on", f"{K} % 5 <> 0 AS vegetation_on", f"{K} % 7 = 0 AS building_on",
            f"{K} % 11 <> 1 AS cliff_on", f"CAST(CASE WHEN {K} % 4 = 0 THEN NULL ELSE {K} % 13 END AS INT) AS road_px"]


def settings(spark, sf):
    return table(spark, sf, "customer").selectExpr(*SETTINGS)


@query("mask_task_plan", f"WITH s AS (SELECT {', '.join(SETTINGS)} FROM customer)" + """, k AS (SELECT * FROM (VALUES ('road', 'features', 'line'), ('water', 'features', 'polygon'),
  ('vegetation', 'landcover', 'raster'), ('building', 'features', 'polygon'), ('cliff', 'elevation', 'raster')) t(kind, data_source, geometry_kind))
  SELECT box_id, tile_prefix, kind, data_source, geometry_kind, tile_prefix || '_' || kind || '_mask.tif' AS file_name,
    CAST(CASE WHEN kind = 'road' THEN coalesce(road_px, 3) END AS INTEGER) AS line_px FROM s, k
  WHERE (kind = 'road' AND road_on) OR (kind = 'water' AND water_on) OR (kind = 'vegetation' AND vegetation_on) OR (kind = 'building' AND building_on) OR (kind = 'cliff' AND cliff_on)""")
def _(spark, sf):
    return masks.mask_task_plan(settings(spark, sf))


LIMITS = [*SETTINGS, f"CAST({K} % 100 AS DOUBLE) AS cliff_threshold", f"({K} % 250) / 2 AS building_height", f"({K} % 30) / 20 - 1 / 4 AS road_offset"]


@query("settings_check", f"WITH s AS (SELECT {', '.join(LIMITS)} FROM customer)" + f"""SELECT box_id, NOT cliff_on OR cliff_threshold BETWEEN 0 AND 90 AS cliff_ok,
  NOT road_on OR road_px BETWEEN 1 AND 10 AS road_ok, CAST(greatest(3, least(100, floor(building_height + 0.5e0))) AS BIGINT) AS building_height,
  {q6('greatest(0e0, least(1e0, road_offset))')} AS road_offset FROM s""")
def _(spark, sf):
    made = table(spark, sf, "customer").selectExpr(*LIMITS)
    return masks.settings_check(made).select("box_id", "cliff_ok", "road_ok", "building_height", r6("road_offset").alias("road_offset"))


CRS = [f"{K} AS box_id", pick(K, ["GEOGCS[\"GCS_WGS_1984\"]", "PROJCS[\"NAD83_UTM\"]", "", "WGS_1984", None]) + " AS projection",
       f"CAST({K} % 400 - 200 AS DOUBLE) AS min_x", f"CAST({K} % 400 - 190 AS DOUBLE) AS max_x",
       f"CAST({K} % 190 - 95 AS DOUBLE) AS min_y", f"CAST({K} % 190 - 90 AS DOUBLE) AS max_y"]


@query("crs_check", f"WITH s AS (SELECT {', '.join(CRS)} FROM customer)" + """SELECT box_id, coalesce(projection, '') = '' OR projection LIKE '%WGS!_1984%' ESCAPE '!' OR projection LIKE '%GEOGCS%' AS geographic,
  min_x >= -180 AND max_x <= 180 AND min_y >= -90 AND max_y <= 90 AS in_range FROM s""")
def _(spark, sf):
    return checks.crs_check(table(spark, sf, "customer").selectExpr(*CRS)).select("box_id", "geographic", "in_range")


@query("lookup_with_default", with_ctes("boxes", "tags") + f"""SELECT b.box_id, t.highway, {CLASS_WIDTH} AS class_width,
  CASE t.highway WHEN 'motorway' THEN 0.15e0 WHEN 'primary' THEN 0.25e0 WHEN 'secondary' THEN 0.25e0 ELSE 0.35e0 END AS red,
  CASE b.preset WHEN 'unreal' THEN 'r16' WHEN 'blender' THEN 'float32' WHEN 'generic' THEN 'float32' ELSE 'png' END AS height_format,
  CASE b.preset WHEN 'generic' THEN 'geotiff' ELSE 'png' END AS image_format,
  CAST(CASE b.preset WHEN 'unigine' THEN 4096 WHEN 'unreal' THEN 2017 WHEN 'blender' THEN 2048 WHEN 'generic' THEN 4096 ELSE 1024 END AS INTEGER) AS height_size,
  CAST(CASE b.preset WHEN 'unigine' THEN 4096 WHEN 'unreal' THEN 2048 WHEN 'blender' THEN 2048 WHEN 'generic' THEN 4096 ELSE 1024 END AS INTEGER) AS image_size,
  CAST(CASE place_type WHEN 'city' THEN 12 WHEN 'town' THEN 14 WHEN 'river' THEN 14 ELSE 16 END AS INTEGER) AS zoom
  FROM boxes b JOIN tags t ON t.id = b.box_id""")
def _(spark, sf):
    both = fx(spark, sf, "boxes").select("box_id", "preset", "place_type").join(fx(spark, sf, "tags").select(F.col("id").alias("box_id"), "highway"), "box_id")
    return presets.with_preset(both, "preset").select(
        "box_id", "highway", ft.highway_width("highway").alias("class_width"), ft.highway_color("highway")[0].alias("red"),
        "height_format", "image_format", "height_size", "image_size", gazetteer.place_zoom("place_type").alias("zoom"),
    )
