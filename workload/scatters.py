"""Scatter queries: candidates, filters, caps, heights and matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from orograph.functions.heights import vegetation_intensity
from orograph.operators import scatter

from .base import TILE, fx, q6, query, r6, with_ctes
from .scalars import INTENSITY

TK = ["tile_row", "tile_col"]
SETTINGS = scatter.ScatterSettings(density=0.25, cap=300)


def draw_cte(name, source, seed, n, out):
    """Draw number ``n`` of the sequence of ``seed`` as the column ``out``."""
    return {
        f"{name}_0": f"SELECT *, ({seed} + CAST((({n}) + 1)::HUGEINT * 1831565813 % 4294967296 AS BIGINT)) & 4294967295 AS s_ FROM {source}",
        f"{name}_1": f"SELECT *, CAST(xor(s_, s_ >> 15)::HUGEINT * (s_ | 1) % 4294967296 AS BIGINT) AS t_ FROM {name}_0",
        f"{name}_2": f"SELECT *, xor((t_ + CAST(xor(t_, t_ >> 7)::HUGEINT * (t_ | 61) % 4294967296 AS BIGINT)) & 4294967295, t_) AS u_ FROM {name}_1",
        name: f"SELECT * EXCLUDE (s_, t_, u_), xor(u_, u_ >> 14) / 4294967296e0 AS {out} FROM {name}_2",
    }


CAND = {
    "sct": """SELECT DISTINCT tile_row, tile_col, 100e0 + tile_row % 10 * 7 AS width_m, 80e0 + tile_col * 13 AS height_m, tile_col * 100e0 AS offset_x, tile_row * 100e0 AS offset_z FROM dem""",
    "scg": "SELECT *, unnest(range(0, CAST(ceil(height_m / 2) AS BIGINT))) AS r FROM sct",
    "sch": "SELECT *, unnest(range(0, CAST(ceil(width_m / 2) AS BIGINT))) AS c FROM scg",
    "sci": "SELECT *, r * CAST(ceil(width_m / 2) AS BIGINT) + c AS idx FROM sch",
    **draw_cte("sda", "sci", 42, "2 * idx", "da"), **draw_cte("sdb", "sda", 42, "2 * idx + 1", "db"),
    "cand": """SELECT tile_row, tile_col, width_m, height_m, offset_x, offset_z, idx, greatest(0e0, least(width_m, (c + 0.5e0) * 2e0 + (da * 2e0 - 1e0) * 0.7e0)) AS px,
      greatest(0e0, least(height_m, (r + 0.5e0) * 2e0 + (db * 2e0 - 1e0) * 0.7e0)) AS pz FROM sdb""",
}
FILTERED = {
    "spot": f"""SELECT *, least(CAST(floor(px / width_m * {TILE}) AS BIGINT), {TILE - 1}) AS mx, least(CAST(floor((1e0 - pz / height_m) * {TILE}) AS BIGINT), {TILE - 1}) AS my FROM cand""",
    "kept": f"""SELECT s.* FROM spot s JOIN landcover l ON l.tile_row = s.tile_row AND l.tile_col = s.tile_col AND l.x = s.mx AND l.y = s.my AND ({INTENSITY}) >= 128
      JOIN dem d ON d.tile_row = s.tile_row AND d.tile_col = s.tile_col AND d.x = s.mx AND d.y = s.my AND NOT d.z >= 30""",
}
CAPPED = {
    **draw_cte("sdk", "kept", 43, "idx", "dk"),
    "capped": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tile_row, tile_col ORDER BY dk, idx) AS rk FROM sdk) WHERE rk <= 300",
}


def height_sql(source, u, v):
    n = TILE - 1
    return {
        "hp": f"SELECT *, greatest(0e0, least(1e0, {u})) * {n}e0 AS gx_, greatest(0e0, least(1e0, {v})) * {n}e0 AS gz_ FROM {source}",
        "hc": f"SELECT *, least(CAST(floor(gx_) AS BIGINT), {n - 1}) AS x0, least(CAST(floor(gz_) AS BIGINT), {n - 1}) AS z0 FROM hp",
        "tall": "SELECT h.*, (a.z * (1 - (gx_ - x0)) + b.z * (gx_ - x0)) * (1 - (gz_ - z0)) + (c.z * (1 - (gx_ - x0)) + d.z * (gx_ - x0)) * (gz_ - z0) AS height FROM hc h "
        + " ".join(f"JOIN dem {t} ON {t}.tile_row = h.tile_row AND {t}.tile_col = h.tile_col AND {t}.x = h.x0 + {i} AND {t}.y = h.z0 + {j}"
                   for t, i, j in (("a", 0, 0), ("b", 1, 0), ("c", 0, 1), ("d", 1, 1))),
    }


INSTANCES = height_sql("capped", "px / width_m", "(height_m - pz) / height_m")
WORLD = {"inst": """SELECT tile_row, tile_col, idx, px - width_m / 2e0 + offset_x AS world_x, height AS y, (pz - height_m / 2e0) * -1e0 + offset_z AS world_z FROM tall"""}


def tiles(spark, sf):
    t = fx(spark, sf, "dem").select(*TK).distinct()
    return t.withColumns({
        "width_m": F.lit(100.0) + F.col("tile_row") % 10 * 7, "height_m": F.lit(80.0) + F.col("tile_col") * 13,
        "offset_x": F.col("tile_col") * 100.0, "offset_z": F.col("tile_row") * 100.0,
    })


def plants(spark, sf):
    c = fx(spark, sf, "landcover").select(*TK, "x", "y", vegetation_intensity("cls").alias("v"))
    steep = fx(spark, sf, "dem").filter("z >= 30").select(*TK, "x", "y", F.lit(255).alias("v"))
    return c.filter("v > 0"), steep


def candidates(spark, sf):
    return scatter.scatter_candidates(tiles(spark, sf), TK, SETTINGS)


def kept(spark, sf):
    mask, steep = plants(spark, sf)
    return scatter.scatter_filter(candidates(spark, sf), mask, TK, TILE, TILE, 128, steep)


def instances(spark, sf):
    mask, steep = plants(spark, sf)
    grid = fx(spark, sf, "dem").select(*TK, "x", "y", F.col("z").alias("h"))
    return scatter.scatter_instances(tiles(spark, sf), mask, grid, TK, TILE, TILE, TILE - 1, SETTINGS, steep)


@query("scatter_candidates", with_ctes("dem", **CAND) + f"SELECT tile_row, tile_col, idx, {q6('px')} AS px, {q6('pz')} AS pz FROM cand")
def _(spark, sf):
    return candidates(spark, sf).select(*TK, "idx", r6("px").alias("px"), r6("pz").alias("pz"))


@query("scatter_filter", with_ctes("dem", "landcover", **CAND, **FILTERED) + f"SELECT tile_row, tile_col, idx, {q6('px')} AS px FROM kept")
def _(spark, sf):
    return kept(spark, sf).select(*TK, "idx", r6("px").alias("px"))


@query("cap_instances", with_ctes("dem", "landcover", **CAND, **FILTERED, **CAPPED) + "SELECT tile_row, tile_col, idx FROM capped")
def _(spark, sf):
    return scatter.cap_instances(kept(spark, sf), TK, SETTINGS.cap, SETTINGS.seed + 1).select(*TK, "idx")


@query("scatter_instances", with_ctes("dem", "landcover", **CAND, **FILTERED, **CAPPED, **INSTANCES, **WORLD)
       + f"SELECT tile_row, tile_col, idx, {q6('world_x')} AS world_x, {q6('y')} AS y, {q6('world_z')} AS world_z FROM inst")
def _(spark, sf):
    return instances(spark, sf).select(*TK, "idx", *[r6(c).alias(c) for c in ("world_x", "y", "world_z")])


@query("instance_transforms", with_ctes(
    "dem", "landcover", **CAND, **FILTERED, **CAPPED, **INSTANCES, **WORLD,
    num="SELECT *, row_number() OVER (PARTITION BY tile_row, tile_col ORDER BY idx) - 1 AS i FROM inst",
    **draw_cte("dsa", "num", 44, "2 * i", "d1"), **draw_cte("dsb", "dsa", 44, "2 * i + 1", "d2"),
    mat="SELECT *, 0.6e0 + d1 * (1.4e0 - 0.6e0) AS s, d2 * pi() * 2e0 AS a FROM dsb",
) + f"""SELECT tile_row, tile_col, idx, i AS instance, {q6('s * cos(a)')} AS m0, {q6('s * sin(a)')} AS m2, {q6('s')} AS m5, {q6('-(s * sin(a))')} AS m8,
  {q6('s * cos(a)')} AS m10, {q6('world_x')} AS m12, {q6('y')} AS m13, {q6('world_z')} AS m14 FROM mat""")
def _(spark, sf):
    out = scatter.instance_transforms(instances(spark, sf), TK, SETTINGS)
    return out.select(*TK, "idx", "instance", *[r6(F.get("matrix", F.lit(i))).alias(f"m{i}") for i in (0, 2, 5, 8, 10, 12, 13, 14)])


@query("finite_transform_check", with_ctes("dem") + """SELECT tile_row, tile_col, x, y FROM dem d
  WHERE NOT EXISTS (SELECT 1 FROM dem b WHERE b.tile_row = d.tile_row AND b.tile_col = d.tile_col AND b.y = d.y AND NOT isfinite(b.z_nan))""")
def _(spark, sf):
    made = fx(spark, sf, "dem").withColumn("matrix", F.array("z", "z_nan"))
    return scatter.finite_groups(made, [*TK, "y"]).select(*TK, "x", "y")


# Points of the world table on the tile of the same event; some lie outside 0..1.
PTS = {"pt": "SELECT p.point_id, d.tile_row, d.tile_col, lon / 180e0 AS u, (lat + 80e0) / 130e0 AS v FROM points p JOIN (SELECT *, gy * 100 + gx AS i FROM dem) d ON d.i = p.point_id"}


def placed_points(spark, sf):
    d = fx(spark, sf, "dem").select(*TK, (F.col("gy") * 100 + F.col("gx")).alias("point_id"))
    p = fx(spark, sf, "points").select("point_id", (F.col("lon") / 180).alias("u"), ((F.col("lat") + 80) / 130).alias("v"))
    return p.join(d, "point_id")


@query("sample_mask_at_points", with_ctes("points", "dem", "landcover", **PTS) + f"""SELECT point_id, CASE WHEN u BETWEEN 0 AND 1 AND v BETWEEN 0 AND 1 THEN {INTENSITY} ELSE 0 END AS mask_value
  FROM pt JOIN landcover l ON l.tile_row = pt.tile_row AND l.tile_col = pt.tile_col AND l.x = greatest(0, least(CAST(floor(u * {TILE}) AS BIGINT), {TILE - 1}))
  AND l.y = greatest(0, least(CAST(floor(v * {TILE}) AS BIGINT), {TILE - 1}))""")
def _(spark, sf):
    mask, _ = plants(spark, sf)
    return scatter.sample_mask_at_points(placed_points(spark, sf), mask, TK, TILE, TILE, "u", "v").select("point_id", "mask_value")


@query("exclude_points_by_mask", with_ctes("points", "dem", **PTS) + f"""SELECT point_id FROM pt JOIN dem l ON l.tile_row = pt.tile_row AND l.tile_col = pt.tile_col
  AND l.x = greatest(0, least(CAST(floor(u * {TILE}) AS BIGINT), {TILE - 1})) AND l.y = greatest(0, least(CAST(floor(v * {TILE}) AS BIGINT), {TILE - 1}))
  WHERE NOT (u BETWEEN 0 AND 1 AND v BETWEEN 0 AND 1 AND z >= 30)""")
def _(spark, sf):
    _, steep = plants(spark, sf)
    return scatter.exclude_points_by_mask(placed_points(spark, sf), steep, TK, TILE, TILE, "u", "v").select("point_id")


@query("sample_height_at_points", with_ctes("points", "dem", **PTS, **height_sql("pt", "u", "v")) + f"SELECT point_id, {q6('height')} AS height FROM tall")
def _(spark, sf):
    grid = fx(spark, sf, "dem").select(*TK, "x", "y", F.col("z").alias("h"))
    out = scatter.sample_height_at_points(placed_points(spark, sf), grid, TK, TILE - 1, "u", "v")
    return out.select("point_id", r6("height").alias("height"))
