"""Tiles of packages, manifests, progress and search streams, and the whole export."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from orograph.functions import geo
from orograph.operators import masks, packages, placement, vectors
from orograph.plans import terrain
from orograph.plans.stages import StageStore
from orograph.session import shared_folder
from orograph.sources import manifests
from orograph.streaming import jobs

from .base import KIND_SQL, SIDE, features, fx, line_cte, polygon_cte, q6, query, r6, recursive, table, with_ctes
from .rasters import GRID, SIDES, grid, hundred, lanczos_cte, slope_cte
from .scalars import FLOORS_SQL, INTENSITY, ROOF_SQL
from .shapes import FEAT

BOX = ["box_id"]
G = ("boxes", "valid_boxes")
SEL = {**GRID, "sel": 'SELECT * FROM grid WHERE ("row" + col) % 2 = 0'}


def selected(spark, sf):
    tiles = grid(spark, sf)
    chosen = tiles.filter("(row + col) % 2 = 0").select("box_id", "row", "col")
    return packages.selected_tiles(tiles, chosen, BOX)


@query("selected_tiles", with_ctes(*G, **SEL) + 'SELECT box_id, "row", col FROM sel')
def _(spark, sf):
    return selected(spark, sf).select("box_id", "row", "col")


@query("tile_order", with_ctes(*G, **SEL) + 'SELECT box_id, "row", col, row_number() OVER (PARTITION BY box_id ORDER BY "row", col) AS ordinal FROM sel')
def _(spark, sf):
    return packages.tile_order(selected(spark, sf), BOX).select("box_id", "row", "col", "ordinal")


MEAN = {"mean": "SELECT box_id, avg((north + south) / 2e0) AS lat FROM sel GROUP BY box_id"}


@query("mean_center_lat", with_ctes(*G, **SEL, **MEAN) + f"SELECT box_id, {q6('lat')} AS center_lat, 111320e0 AS m_per_deg_lat, {q6('111320e0 * cos(radians(lat))')} AS m_per_deg_lng FROM mean")
def _(spark, sf):
    out = packages.mean_center_lat(selected(spark, sf), BOX)
    return out.select("box_id", r6("center_lat").alias("center_lat"), "m_per_deg_lat", r6("m_per_deg_lng").alias("m_per_deg_lng"))


# Every third column is left out, so that gaps occur.
OFFS = {
    **SEL, "sel": "SELECT * FROM grid WHERE (col + box_id) % 3 <> 1", **MEAN,
    "cw": """SELECT box_id, col, arg_min(greatest(1e0, (east - west) * 111320e0 * cos(radians(lat))), "row") AS w FROM sel JOIN mean USING (box_id) GROUP BY ALL""",
    "rh": """SELECT box_id, "row" AS r, arg_min(greatest(1e0, (north - south) * 111320e0), col) AS h FROM sel GROUP BY ALL""",
    "ce": "SELECT box_id, unnest(range(lo, hi + 1)) AS i FROM (SELECT box_id, min(col) AS lo, max(col) AS hi FROM sel GROUP BY box_id)",
    "re": 'SELECT box_id, unnest(range(lo, hi + 1)) AS i FROM (SELECT box_id, min("row") AS lo, max("row") AS hi FROM sel GROUP BY box_id)',
}


@query("world_offsets", with_ctes(*G, **OFFS) + f"""SELECT 'col' AS axis, box_id, i AS at, {q6('coalesce((SELECT sum(w) FROM cw WHERE cw.box_id = ce.box_id AND cw.col < ce.i), 0e0)')} AS offset_m FROM ce
  UNION ALL SELECT 'row', box_id, i, {q6('coalesce((SELECT sum(h) FROM rh WHERE rh.box_id = re.box_id AND rh.r < re.i), 0e0)')} FROM re""")
def _(spark, sf):
    columns, rows = packages.world_offsets(grid(spark, sf).filter("(col + box_id) % 3 <> 1"), BOX)
    return columns.select(F.lit("col").alias("axis"), "box_id", F.col("col").alias("at"), r6("offset_m").alias("offset_m")).unionByName(
        rows.select(F.lit("row").alias("axis"), "box_id", F.col("row").alias("at"), r6("offset_m").alias("offset_m"))
    )


# Tiles with file names and heights; in every third package two rows share their number.
NAMED = {**GRID, "named": """SELECT *, CASE WHEN box_id % 3 = 0 THEN "row" // 2 ELSE "row" END AS r2,
  CASE WHEN col % 3 = 0 THEN 'heightmap.png' ELSE 'tile_' || "row" || '_' || col || '/heightmap.png' END AS heightmap,
  CASE WHEN col % 2 = 0 THEN 'tile_' || "row" || '_' || col || '_albedo.png' END AS albedo,
  CASE WHEN box_id % 7 = 0 THEN CAST('NaN' AS DOUBLE) ELSE box_id % 90 + "row" * 3e0 END AS z_min, box_id % 90 + "row" * 3e0 + col * 5e0 AS z_max FROM grid"""}


def named(spark, sf):
    r, c = F.col("row"), F.col("col")
    stem = F.concat(F.lit("tile_"), r.cast("string"), F.lit("_"), c.cast("string"))
    base = F.col("box_id") % 90 + r * 3.0
    return grid(spark, sf).withColumns({
        "heightmap": F.when(c % 3 == 0, F.lit("heightmap.png")).otherwise(F.concat(stem, F.lit("/heightmap.png"))),
        "albedo": F.when(c % 2 == 0, F.concat(stem, F.lit("_albedo.png"))),
        "z_min": F.when(F.col("box_id") % 7 == 0, F.lit(float("nan"))).otherwise(base), "z_max": base + c * 5.0,
        "r2": F.when(F.col("box_id") % 3 == 0, F.floor(r / 2)).otherwise(r),
    })


@query("duplicate_tile_repair", with_ctes(*G, **NAMED, bad="SELECT DISTINCT box_id FROM (SELECT box_id FROM named GROUP BY box_id, r2, col HAVING count(*) > 1)") + """SELECT box_id, "row" AS true_row, col AS true_col,
  CASE WHEN box_id IN (FROM bad) AND (col % 3 <> 0 OR col % 2 = 0) THEN "row" ELSE r2 END AS "row", col, box_id IN (FROM bad) AS repaired FROM named""")
def _(spark, sf):
    t = named(spark, sf).select("box_id", F.col("row").alias("true_row"), F.col("col").alias("true_col"), F.col("r2").alias("row"), "col", "heightmap", "albedo")
    return packages.duplicate_tile_repair(t, BOX).drop("heightmap", "albedo")


@query("combine_manifests", with_ctes(*G, **NAMED) + """SELECT box_id, greatest(1, max("row") - min("row") + 1) AS rows, greatest(1, max(col) - min(col) + 1) AS cols, min("row") AS min_row, min(col) AS min_col,
  count(*) AS n_tiles, arg_min(heightmap, "row" * 1000 + col) AS heightmap FROM named GROUP BY box_id""")
def _(spark, sf):
    return packages.combine_manifests(named(spark, sf), BOX, ["heightmap"])


@query("relocate_tile_files", with_ctes(*G, **NAMED) + """SELECT box_id, "row", col, 'tile_' || "row" || '_' || col || '/' || heightmap AS heightmap,
  'tile_' || "row" || '_' || col || '/' || albedo AS albedo FROM named""")
def _(spark, sf):
    return packages.relocate_tile_files(named(spark, sf), ["heightmap", "albedo"]).select("box_id", "row", "col", "heightmap", "albedo")


@query("package_elevation_range", with_ctes(*G, **NAMED) + """SELECT box_id, CASE WHEN box_id % 7 = 0 THEN 0e0 ELSE min(z_min) END AS package_min,
  CASE WHEN box_id % 7 = 0 THEN 100e0 ELSE max(z_max) END AS package_max FROM named GROUP BY box_id""")
def _(spark, sf):
    return packages.package_elevation_range(named(spark, sf), BOX)


@query("tile_placement", with_ctes(*G, **SEL, m='SELECT box_id, min("row") AS r0, max("row") AS r1, min(col) AS c0, max(col) AS c1 FROM sel GROUP BY box_id') + f"""SELECT box_id, "row", col,
  {q6('(col - c0) * 4000e0 - (c1 - c0 + 1) * 4000e0 / 2')} AS grid_x, {q6('("row" - r0) * 3000e0 - (r1 - r0 + 1) * 3000e0 / 2')} AS grid_z,
  {q6('CASE WHEN box_id % 2 = 0 THEN box_id ELSE col * 5000e0 END')} AS import_x, {q6('CASE WHEN box_id % 2 = 0 THEN 0e0 ELSE "row" * 5000e0 END')} AS import_z,
  {q6('col * 4000e0')} AS package_x, {q6('"row" * 3000e0')} AS package_z FROM sel JOIN m USING (box_id)""")
def _(spark, sf):
    even = F.when((F.col("box_id") % 2 == 0), F.col("box_id")).otherwise(F.lit(0)).cast("double")
    t = selected(spark, sf).withColumns({"tile_w_m": F.lit(4000.0), "tile_h_m": F.lit(3000.0), "chunk_m": F.lit(5000.0), "offset_x": even, "offset_z": F.lit(0.0)})
    out = packages.tile_placement(t, BOX)
    return out.select("box_id", "row", "col", *[r6(c).alias(c) for c in ("grid_x", "grid_z", "import_x", "import_z", "package_x", "package_z")])


REASON = "CASE WHEN (\"row\" * 5 + col + box_id) % 3 = 0 THEN 'no heightmap file' WHEN (\"row\" + col * 2) % 5 = 4 THEN 'not found' END"


@query("import_summary", with_ctes(*G, **GRID, o=f'SELECT *, "row" * cols + col AS ordinal, {REASON} AS reason FROM grid',
       f="SELECT *, row_number() OVER (PARTITION BY box_id ORDER BY ordinal) AS rn FROM o WHERE reason IS NOT NULL") + """SELECT box_id, count(*) FILTER (WHERE reason IS NULL) AS imported,
  count(*) FILTER (WHERE reason IS NOT NULL) AS failed, coalesce((SELECT string_agg('tile_' || "row" || '_' || col || ' (' || reason || ')', ', ' ORDER BY rn) FROM f WHERE f.box_id = o.box_id AND rn <= 3), '')
  || CASE WHEN count(*) FILTER (WHERE reason IS NOT NULL) > 3 THEN '...' ELSE '' END AS failures FROM o GROUP BY box_id""")
def _(spark, sf):
    o = grid(spark, sf).withColumn("ordinal", F.col("row") * F.col("cols") + F.col("col")).withColumn("reason", F.expr(REASON.replace('"', "`")))
    return packages.import_summary(o, BOX)


@query("folder_order", with_ctes(*G, **GRID) + "SELECT box_id, 'b' || box_id || '/tile_' || \"row\" || '_' || col AS folder FROM grid ORDER BY folder")
def _(spark, sf):
    folder = F.concat(F.lit("b"), F.col("box_id").cast("string"), F.lit("/tile_"), F.col("row").cast("string"), F.lit("_"), F.col("col").cast("string"))
    return packages.folder_order(grid(spark, sf).select("box_id", folder.alias("folder")))


# Mask entries of every tile and the files that exist.
ENTRIES = {**GRID, "en": """SELECT box_id, "row", col, 'b' || box_id || '/tile_' || "row" || '_' || col AS folder, kind,
  CASE WHEN kind = 'cliff' AND box_id % 2 = 0 THEN '' ELSE 'tile_' || "row" || '_' || col || '_' || kind || '_mask.tif' END AS file_name
  FROM grid, (VALUES ('road'), ('water'), ('vegetation'), ('building'), ('cliff')) k(kind)"""}


def entries(spark, sf):
    tile = F.concat(F.lit("tile_"), F.col("row").cast("string"), F.lit("_"), F.col("col").cast("string"))
    kinds = F.explode(F.array(*[F.lit(k) for k, *_ in masks.MASK_KINDS])).alias("kind")
    e = grid(spark, sf).select("box_id", "row", "col", kinds, F.concat(F.lit("b"), F.col("box_id").cast("string"), F.lit("/"), tile).alias("folder"), tile.alias("tile"))
    name = F.when((F.col("kind") == "cliff") & (F.col("box_id") % 2 == 0), F.lit("")).otherwise(F.concat(F.col("tile"), F.lit("_"), F.col("kind"), F.lit("_mask.tif")))
    return e.withColumn("file_name", name).drop("tile")


@query("existing_masks_only", with_ctes(*G, **ENTRIES) + """SELECT box_id, "row", col, kind FROM en WHERE file_name <> '' AND ("row" * 3 + col) % 4 <> 0 AND kind <> 'water'""")
def _(spark, sf):
    e = entries(spark, sf)
    listing = e.filter("(row * 3 + col) % 4 <> 0 AND kind <> 'water'").select("folder", "file_name")
    return manifests.existing_masks(e, listing).select("box_id", "row", "col", "kind")


@query("heightmap_fallback", with_ctes(*G, **ENTRIES) + """SELECT box_id, "row", col, CASE WHEN ("row" + col) % 3 = 0 THEN folder || '/' || file_name
  WHEN ("row" + col) % 3 = 1 THEN folder || '/heightmap/' || file_name END AS heightmap_path, kind FROM en WHERE file_name <> ''""")
def _(spark, sf):
    e = entries(spark, sf).filter("file_name <> ''")
    direct = e.filter("(row + col) % 3 = 0").select("folder", "file_name")
    nested = e.filter("(row + col) % 3 = 1").select(F.concat("folder", F.lit("/heightmap")).alias("folder"), "file_name")
    return manifests.resolve_heightmap(e, direct.unionByName(nested)).select("box_id", "row", "col", "kind", "heightmap_path")


# Packages: root manifest with tiles, root manifest without tiles, tile folders only. Some cannot be read.
@query("read_packages", with_ctes(*G, **GRID) + f"""SELECT 'pk/b' || box_id AS package, CASE WHEN box_id % 3 = 0 THEN 'pk/b' || box_id ELSE 'pk/b' || box_id || '/tile_' || "row" || '_' || col END AS folder,
  "row", col, {q6('west')} AS west FROM grid WHERE box_id % 3 = 0 OR ("row" + col) % 5 <> 4""")
def _(spark, sf):
    g = grid(spark, sf)
    tile = F.struct("row", "col", F.struct("west", "south", "east", "north").alias("bounds"))
    root = F.concat(F.lit("pk/b"), F.col("box_id").cast("string"))
    body = F.to_json(F.struct(F.lit("1.0.0").alias("version"), F.array(tile).alias("tiles")))
    loose = g.select(
        F.concat(root, F.lit("/tile_"), F.col("row").cast("string"), F.lit("_"), F.col("col").cast("string"), F.lit("/manifest.json")).alias("path"),
        F.when((F.col("row") + F.col("col")) % 5 == 4, F.lit("{broken")).otherwise(body).alias("body"),
    )
    # A box has a few dozen tiles at most, so its root manifest is small.
    whole = g.groupBy("box_id").agg(F.collect_list(tile).alias("t")).filter("box_id % 3 < 2").select(
        F.concat(root, F.lit("/manifest.json")).alias("path"),
        F.to_json(F.struct(F.when(F.col("box_id") % 3 == 0, F.col("t")).otherwise(F.slice("t", 1, 0)).alias("tiles"))).alias("body"),
    )
    out = manifests.packages_from_text(loose.unionByName(whole))
    return out.select("package", "folder", F.col("tile.row").alias("row"), F.col("tile.col").alias("col"), r6("tile.bounds.west").alias("west"))


@query("write_features_json", with_ctes("tags", "feat") + f"""SELECT sheet, fid AS id, '{{"id":' || fid || ',"floors":' || {FLOORS_SQL}
  || CASE WHEN {ROOF_SQL} IS NULL THEN '' ELSE ',"roof_shape":"' || {ROOF_SQL} || '"' END || '}}' AS value FROM feat WHERE {KIND_SQL['buildings']}""")
def _(spark, sf):
    b = placement.extract_buildings(features(spark, sf).filter(vectors.tag_filter("buildings")), F.lit(10.0))
    return manifests.features_json(b, ["sheet"], ["id", "floors", "roof_shape"])


# --- masks of all kinds ---------------------------------------------------------------------

# Sheet s uses elevation tile s where there is one.
PLAN = {"road": "sheet % 3 <> 2", "water": "sheet % 2 = 0", "vegetation": "true", "building": "sheet % 4 <> 3", "cliff": "sheet <> 1"}
SMALL = SIDE


def near(name, source, value):
    return {name: f"""SELECT s.sheet, t.x, u.y, s.{value} FROM range({SMALL}) t(x), range({SMALL}) u(y), {source} s WHERE s.x = least(49, CAST(floor(t.x / {SMALL - 1}e0 * 49 + 0.5e0) AS BIGINT))
      AND s.y = least(49, CAST(floor(u.y / {SMALL - 1}e0 * 49 + 0.5e0) AS BIGINT))"""}


ALL_MASKS = {
    "dm": "SELECT tile_row * 2 + tile_col AS sheet, x, y, z FROM dem",
    "lc": f"SELECT tile_row * 2 + tile_col AS sheet, x, y, {INTENSITY} AS v FROM landcover",
    **polygon_cte("pw", KIND_SQL["water"]), **polygon_cte("pb", KIND_SQL["buildings"]), **line_cte("pr", KIND_SQL["roads"], "(sheet % 4) / 2e0"),
    **slope_cte("sl", "dm", ["sheet"]), "cl": "SELECT sheet, x, y, CASE WHEN slope >= 85 THEN 255 ELSE 0 END AS v FROM sl", **near("cn", "cl", "v"), **near("vn", "lc", "v"),
    "hw": f"SELECT sheet, x, y FROM pw WHERE {PLAN['water']}", "hr": f"SELECT sheet, x, y FROM pr WHERE {PLAN['road']}",
    "every": f"""SELECT sheet, 'water' AS kind, x, y, 255 AS v FROM hw UNION ALL SELECT sheet, 'road', x, y, 255 FROM hr
      UNION ALL SELECT sheet, 'building', x, y, 255 FROM pb WHERE {PLAN['building']} UNION ALL SELECT sheet, 'cliff', x, y, v FROM cn WHERE v > 0 AND {PLAN['cliff']}
      UNION ALL SELECT sheet, 'vegetation', x, y, v FROM vn WHERE v > 0 AND NOT ({PLAN['water']} AND (EXISTS (SELECT 1 FROM hw w WHERE w.sheet = vn.sheet AND w.x = vn.x AND w.y = vn.y)
        OR EXISTS (SELECT 1 FROM hr w WHERE w.sheet = vn.sheet AND w.x = vn.x AND w.y = vn.y)))""",
}


@query("mask_generation", recursive(with_ctes("dem", "landcover", *FEAT, **ALL_MASKS)) + """SELECT sheet, kind, y, count(*) AS n, CAST(sum(x) AS BIGINT) AS sum_x, CAST(sum(v) AS BIGINT) AS sum_v
  FROM every GROUP BY ALL""")
def _(spark, sf):
    f = features(spark, sf)
    sheets = f.select("sheet").distinct()
    plan = sheets.select("sheet", F.explode(F.filter(F.array(*[F.when(F.expr(c), F.lit(k)) for k, c in PLAN.items()]), lambda k: k.isNotNull())).alias("kind"))
    plan = plan.withColumn("line_px", F.when(F.col("kind") == "road", F.col("sheet") % 4 + 1).cast("int"))
    sheet = (F.col("tile_row") * 2 + F.col("tile_col")).alias("sheet")
    elevation = fx(spark, sf, "dem").select(sheet, "x", "y", "z")
    cover = fx(spark, sf, "landcover").select(sheet, "x", "y", masks.vegetation_intensity("cls").alias("v"))
    plants = masks.match_size(cover, ["sheet"], (50, 50), (SMALL, SMALL))
    out = masks.generate_masks(plan, f, elevation, plants, ["sheet"], ["id"], SMALL, (50, 50), 85.0)
    return out.groupBy("sheet", "kind", "y").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sum_x"), F.sum("v").alias("sum_v"))


# A plan with masks that cannot be made: no line width, a threshold beyond a right angle, a kind that does not exist.
OUTCOME_PLAN = {k: f"({v}) AND NOT ({b})" for (k, v), b in zip(PLAN.items(), ("sheet % 5 = 1", "false", "false", "false", "sheet % 4 = 2"))}
OUTCOMES = {**ALL_MASKS, "hw": f"SELECT sheet, x, y FROM pw WHERE {PLAN['water']}", "hr": f"SELECT sheet, x, y FROM pr WHERE {OUTCOME_PLAN['road']}",
            "every": ALL_MASKS["every"].replace(f"v > 0 AND {PLAN['cliff']}", f"v > 0 AND {OUTCOME_PLAN['cliff']}"),
            "sheets": "SELECT DISTINCT sheet FROM feat", "listed": " UNION ALL ".join(f"SELECT sheet, '{k}' AS kind FROM sheets WHERE {c}" for k, c in PLAN.items()) + " UNION ALL SELECT sheet, 'snow' FROM sheets WHERE sheet % 7 = 0",
            "counted": "SELECT sheet, kind, count(*) AS n FROM every GROUP BY ALL"}


@query("mask_outcomes", recursive(with_ctes("dem", "landcover", *FEAT, **OUTCOMES)) + """SELECT sheet, kind, CASE WHEN reason IS NOT NULL THEN 'failed' WHEN n > 0 THEN 'painted' ELSE 'empty' END AS status, reason, coalesce(n, 0) AS n_px
  FROM (SELECT sheet, kind, n, CASE WHEN kind = 'snow' THEN 'unknown kind: snow' WHEN kind = 'road' AND sheet % 5 = 1 THEN 'line width: 0' WHEN kind = 'cliff' AND sheet % 4 = 2 THEN 'cliff threshold: 91.0' END AS reason
  FROM listed LEFT JOIN counted USING (sheet, kind))""")
def _(spark, sf):
    f = features(spark, sf)
    kinds = [F.when(F.expr(c), F.lit(k)) for k, c in PLAN.items()] + [F.when(F.col("sheet") % 7 == 0, F.lit("snow"))]
    plan = f.select("sheet").distinct().select("sheet", F.explode(F.filter(F.array(*kinds), lambda k: k.isNotNull())).alias("kind"))
    plan = plan.withColumns({"line_px": F.when(F.col("kind") == "road", F.when(F.col("sheet") % 5 == 1, 0).otherwise(F.col("sheet") % 4 + 1)).cast("int"), "threshold": F.when(F.col("sheet") % 4 == 2, 91.0).otherwise(85.0)})
    plan = masks.plan_with_errors(plan, "threshold")
    sheet = (F.col("tile_row") * 2 + F.col("tile_col")).alias("sheet")
    cover = fx(spark, sf, "landcover").select(sheet, "x", "y", masks.vegetation_intensity("cls").alias("v"))
    plants = masks.match_size(cover, ["sheet"], (50, 50), (SMALL, SMALL))
    good = plan.filter("reason IS NULL").select("sheet", "kind", "line_px")
    painted = masks.generate_masks(good, masks.usable_features(f), fx(spark, sf, "dem").select(sheet, "x", "y", "z"), plants, ["sheet"], ["id"], SMALL, (50, 50), 85.0)
    return masks.mask_outcomes(plan, painted, f, ["sheet"]).drop("n_skipped")


# --- streams, run as tables -----------------------------------------------------------------


@query("job_progress_latest", with_ctes("progress") + """SELECT job_id, state, progress, ts, event_id, state IN ('complete', 'cancelled', 'error') AS is_terminal FROM progress
  QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) = 1""")
def _(spark, sf):
    return jobs.job_progress_latest(fx(spark, sf, "progress"))


GAP = 3600 * 4


@query("debounced_queries", with_ctes("typed") + f"""SELECT user_id, event_id, trim(q) AS q FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM typed)
  WHERE (nx IS NULL OR nx > ts + INTERVAL {GAP} SECOND) AND length(trim(q)) >= 3""")
def _(spark, sf):
    return jobs.debounced_queries(fx(spark, sf, "typed"), GAP).select("user_id", "event_id", "q")


# --- the whole export -----------------------------------------------------------------------

SETTINGS = terrain.PackageSettings(tile_km=55.66, resolution=32, height_format="r16", cliff_threshold=80.0)


def stages(spark) -> StageStore:
    return StageStore(f"{shared_folder(spark)}/stages/{uuid.uuid4().hex}")


def package(spark, sf):
    """One area of one degree per hundred pixel rows, from 10 degrees north to the south."""
    elevation = hundred(spark, sf).withColumnRenamed("mosaic", "area_id")
    cover = hundred(spark, sf, "landcover", "cls").withColumnRenamed("mosaic", "area_id")
    areas = elevation.select("area_id").distinct().withColumns({
        "west": F.lit(0.0), "east": F.lit(1.0), "south": F.lit(9.0) - F.col("area_id"), "north": F.lit(10.0) - F.col("area_id"),
    })
    count = elevation.agg(F.max("area_id") + 1).scalar()
    shift = F.lit(9.0) - F.col("sheet") % count
    moved = features(spark, sf).withColumn("_up", shift)
    moved = moved.withColumn("geometry", F.transform("geometry", lambda p: F.struct((p["lat"] + F.col("_up")).alias("lat"), p["lon"].alias("lon"))))
    store = stages(spark)
    moved = store.keep("given_features", moved.select("type", "id", "geometry", "tags"))
    return terrain.TerrainPackage.from_rasters(areas, "area_id", elevation, cover, moved, terrain.Georeference(100, 100, 0.01), SETTINGS, store)


R = SETTINGS.resolution
T3 = ["area_id", "r", "c"]
PX = f"CAST(floor(greatest(0e0, least({R - 1}e0, (lon - west) / (east - west) * {R - 1}e0)) + 0.5e0) AS BIGINT)"
PY = f"CAST(floor(greatest(0e0, least({R - 1}e0, (north - lat) / (north - south) * {R - 1}e0)) + 0.5e0) AS BIGINT)"


def on_tiles(ctes: dict[str, str]) -> dict[str, str]:
    """The rasterisation steps keyed by tile instead of sheet, with sides of the tile raster."""
    def move(s):
        return (s.replace("JOIN ring_px b ON a.fid = b.fid", "JOIN tpx b ON a.fid = b.fid AND a.sheet = b.sheet").replace("FROM ring_px a", "FROM tpx a")
                .replace(f"{SIDE - 1}", f"{R - 1}"))
    return {k: move(v) for k, v in ctes.items()}


PACKAGE = {
    "el": "SELECT CAST((gy - gy % 100) / 100 AS BIGINT) AS area_id, gx, gy % 100 AS my, z FROM dem",
    "lc": f"SELECT CAST((gy - gy % 100) / 100 AS BIGINT) AS area_id, gx, gy % 100 AS my, {INTENSITY} AS v FROM landcover",
    "ar": "SELECT DISTINCT area_id, 0e0 AS west, 1e0 AS east, 9e0 - area_id AS south, 10e0 - area_id AS north FROM el",
    "tg": """SELECT *, CAST(greatest(1, ceil((north - south) / (55.66e0 / 111.32e0))) AS BIGINT) AS nr, CAST(greatest(1, ceil((east - west) / (55.66e0 / (111.32e0 * cos((north + south) / 2e0 * pi() / 180e0))))) AS BIGINT) AS nc FROM ar""",
    "th": "SELECT *, unnest(range(0, nr)) AS r FROM tg", "ti": "SELECT *, unnest(range(0, nc)) AS c FROM th",
    "ts": """SELECT area_id, r, c, area_id * 100 + r * 10 + c AS sheet, north AS an, west AS aw, west + c * ((east - west) / nc) AS west, CASE WHEN c = nc - 1 THEN east ELSE west + (c + 1) * ((east - west) / nc) END AS east,
      south + r * ((north - south) / nr) AS south, CASE WHEN r = nr - 1 THEN north ELSE south + (r + 1) * ((north - south) / nr) END AS north FROM ti""",
    "tw": """SELECT *, greatest(0, floor((west - aw) / 0.01e0)) AS x0, least(99, ceil((east - aw) / 0.01e0) - 1) AS x1, greatest(0, floor((an - north) / 0.01e0)) AS y0, least(99, ceil((an - south) / 0.01e0) - 1) AS y1 FROM ts""",
    "win": "SELECT *, CAST(greatest(1, x1 - x0 + 1) AS BIGINT) AS cw, CAST(greatest(1, y1 - y0 + 1) AS BIGINT) AS ch FROM tw",
    "cut": "SELECT w.sheet, cw, ch, CAST(gx - x0 AS BIGINT) AS x, CAST(my - y0 AS BIGINT) AS y, z FROM win w JOIN el e ON e.area_id = w.area_id AND gx BETWEEN x0 AND x0 + cw - 1 AND my BETWEEN y0 AND y0 + ch - 1",
    "cov": "SELECT w.sheet, cw, ch, CAST(gx - x0 AS BIGINT) AS x, CAST(my - y0 AS BIGINT) AS y, v FROM win w JOIN lc e ON e.area_id = w.area_id AND gx BETWEEN x0 AND x0 + cw - 1 AND my BETWEEN y0 AND y0 + ch - 1",
    "tt": f"SELECT sheet, t.x, u.y, t.x * ((cw - 1) / {R - 1}e0) AS sx, u.y * ((ch - 1) / {R - 1}e0) AS sy, cw, ch FROM win, range({R}) t(x), range({R}) u(y)",
    "tn": "SELECT *, CAST(floor(sx) AS BIGINT) AS ix, CAST(floor(sy) AS BIGINT) AS iy, least(CAST(floor(sx) AS BIGINT) + 1, cw - 1) AS jx, least(CAST(floor(sy) AS BIGINT) + 1, ch - 1) AS jy, sx - floor(sx) AS fx, sy - floor(sy) AS fy FROM tt",
    "hz": "SELECT n.sheet, n.x, n.y, (coalesce(a.z, 0) * (1e0 - fx) + coalesce(b.z, 0) * fx) * (1e0 - fy) + (coalesce(c.z, 0) * (1e0 - fx) + coalesce(d.z, 0) * fx) * fy AS z FROM tn n "
    + " ".join(f"LEFT JOIN cut {t} ON {t}.sheet = n.sheet AND {t}.x = n.{i} AND {t}.y = n.{j}" for t, i, j in (("a", "ix", "iy"), ("b", "jx", "iy"), ("c", "ix", "jy"), ("d", "jx", "jy"))),
    "sta": "SELECT sheet, min(z) AS z_min, max(z) AS z_max FROM hz GROUP BY sheet",
    "qua": "SELECT sheet, count(*) AS n_pixels, CAST(sum(floor((z - z_min) / CASE WHEN z_max = z_min THEN 1 ELSE z_max - z_min END * 65535e0 + 0.5e0)) AS BIGINT) AS level_sum FROM hz JOIN sta USING (sheet) GROUP BY sheet",
    **slope_cte("sl", "cut", ["sheet"]), "clm": "SELECT sl.*, cw, ch FROM sl JOIN win USING (sheet)",
    "cln": f"""SELECT s.sheet, count(*) AS n FROM range({R}) t(x), range({R}) u(y), clm s WHERE s.x = least(cw - 1, CAST(floor(t.x / {R - 1}e0 * (cw - 1) + 0.5e0) AS BIGINT))
      AND s.y = least(ch - 1, CAST(floor(u.y / {R - 1}e0 * (ch - 1) + 0.5e0) AS BIGINT)) AND slope >= 80 GROUP BY s.sheet""",
    **lanczos_cte("veg", "cov", ["sheet"], "cw", "ch", R, R, 2),
    "world": f"SELECT fid, ord, lon, lat + 9 - sheet % (SELECT max(area_id) + 1 FROM el) AS lat FROM ring",
    "bb": "SELECT fid, min(lon) AS w, max(lon) AS e, min(lat) AS s, max(lat) AS n FROM world GROUP BY fid",
    "ft": "SELECT t.*, b.fid FROM bb b JOIN ts t ON b.w <= t.east AND b.e >= t.west AND b.s <= t.north AND b.n >= t.south",
    "tpx": f"SELECT t.sheet, fid, ord, {PX} AS x, {PY} AS y FROM ft t JOIN world USING (fid)",
    **on_tiles(polygon_cte("pw", KIND_SQL["water"])), **on_tiles(polygon_cte("pb", KIND_SQL["buildings"])), **on_tiles(line_cte("pr", KIND_SQL["roads"], "1e0")),
    "vgn": f"""SELECT sheet, count(*) AS n FROM veg v WHERE floor(greatest(0e0, least(255e0, v)) + 0.5e0) >= 128
      AND NOT EXISTS (SELECT 1 FROM pw w WHERE w.sheet = v.sheet AND w.x = v.x AND w.y = v.y) AND NOT EXISTS (SELECT 1 FROM pr w WHERE w.sheet = v.sheet AND w.x = v.x AND w.y = v.y) GROUP BY sheet""",
    "fc": f"""SELECT t.sheet, count(*) FILTER (WHERE {KIND_SQL['buildings']}) AS n_buildings, count(*) FILTER (WHERE {KIND_SQL['roads']}) AS n_roads FROM ft t JOIN feat f USING (fid) GROUP BY t.sheet""",
}


def per_tile(name):
    return f"coalesce((SELECT count(*) FROM {name} p WHERE p.sheet = t.sheet), 0)"


@query("terrain_package", recursive(with_ctes("dem", "landcover", *FEAT, **PACKAGE)) + f"""SELECT area_id, r AS "row", c AS col, {q6('z_min')} AS z_min, {q6('z_max')} AS z_max, n_pixels, level_sum,
  {per_tile('pr')} AS road_px, {per_tile('pw')} AS water_px, coalesce((SELECT n FROM vgn p WHERE p.sheet = t.sheet), 0) AS vegetation_px, {per_tile('pb')} AS building_px,
  coalesce((SELECT n FROM cln p WHERE p.sheet = t.sheet), 0) AS cliff_px, coalesce(n_buildings, 0) AS n_buildings, coalesce(n_roads, 0) AS n_roads,
  {q6('greatest((east - west) * (111320e0 * cos(radians((north + south) * 0.5e0))), (north - south) * 111320e0)')} AS chunk_m,
  'tile_' || r || '_' || c || '_heightmap.r16' AS heightmap FROM ts t JOIN sta USING (sheet) JOIN qua USING (sheet) LEFT JOIN fc USING (sheet)""")
def _(spark, sf):
    out = terrain.package_report(package(spark, sf), "area_id", SETTINGS)
    return out.select(
        "area_id", "row", "col", r6("z_min").alias("z_min"), r6("z_max").alias("z_max"), "n_pixels", "level_sum", *[f"{k}_px" for k, *_ in masks.MASK_KINDS],
        "n_buildings", "n_roads", r6("chunk_m").alias("chunk_m"), "heightmap",
    )


@query("write_manifests", with_ctes("dem", "landcover", *FEAT, **{k: v for k, v in PACKAGE.items() if k in ("el", "ar", "tg", "th", "ti", "ts", "tw", "win", "cut", "tt", "tn", "hz", "sta")})
       + f"""SELECT area_id, r AS "row", c AS col, 'Terrain_' || area_id AS name, 'EPSG:4326' AS crs, {q6('(east - west) * (111320e0 * cos(radians((north + south) * 0.5e0)))')} AS width_m,
  {q6('c * ((east - west) * (111320e0 * cos(radians((north + south) * 0.5e0))))')} AS offset_x, {q6('floor(z_max * 100 + 0.5e0) / 100e0')} AS shown_max, 'tile_' || r || '_' || c || '_water_mask.tif' AS water,
  CASE WHEN (r + c + area_id) % 2 = 0 THEN 'tile_' || r || '_' || c || '_road_mask.tif' END AS road, 'Mapzen / AWS' AS dem_by, 'Esri' AS image_by FROM ts JOIN sta USING (sheet)""")
def _(spark, sf):
    p = package(spark, sf)
    stats = p.tiles.join(p.stats, ["area_id", "row", "col"])
    files = terrain.names.tile_file_names("row", "col", F.lit("r16"), F.lit("png"))
    report = stats.withColumns(geo.tile_size_meters(*SIDES)).withColumns(files)
    tile = F.concat(F.lit("tile_"), F.col("row").cast("string"), F.lit("_"), F.col("col").cast("string"))
    there = F.when((F.col("row") + F.col("col") + F.col("area_id")) % 2 == 0, F.array(F.lit("road"), F.lit("water"))).otherwise(F.array(F.lit("water")))
    listing = p.tiles.select("area_id", tile.alias("folder"), F.explode(there).alias("k")).select("area_id", "folder", F.concat("folder", F.lit("_"), "k", F.lit("_mask.tif")).alias("file_name"))
    out = terrain.package_manifests(report, "area_id", SETTINGS, listing)

    def at(path, kind="string"):
        return F.get_json_object("value", "$." + path).cast(kind)

    return out.select(
        "area_id", "row", "col", at("terrainName").alias("name"), at("crs").alias("crs"), r6(at("tileGrid.tileWidthM", "double")).alias("width_m"),
        r6(at("tiles[0].worldOffset.x", "double")).alias("offset_x"), r6(at("tiles[0].elevation.max", "double")).alias("shown_max"), at("tiles[0].files.waterMask").alias("water"),
        at("tiles[0].files.roadMask").alias("road"), at("sources.dem.attribution").alias("dem_by"), at("sources.imagery.attribution").alias("image_by"),
    )
