"""Rasters in blocks, on the tables and against the SQL of the same operators on pixels; documents made of lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from orograph.functions.heights import vegetation_intensity
from orograph.operators import blocks, packages, placement, vectors
from orograph.sources import manifests

from .base import KIND_SQL, ORACLES, TILE, features, fx, query, r6, with_ctes
from .rasters import DH, DW, GRID, TILE_KEYS, grid
from .scalars import FLOORS_SQL

#: Small against a tile, so that margins and several targets occur.
SMALL = 16


def tile_blocks(spark, sf, name="dem", value="z"):
    return blocks.blocks_of(fx(spark, sf, name), TILE_KEYS, (value,), SMALL)


def frames(spark, sf, dst_w, dst_h):
    tiles = fx(spark, sf, "dem").select(*TILE_KEYS).distinct()
    sizes = {"left": 0, "top": 0, "src_w": TILE, "src_h": TILE, "dst_w": dst_w, "dst_h": dst_h}
    return tiles.withColumns({k: F.lit(v).cast("bigint") for k, v in sizes.items()})


def resized(spark, sf, raster, how, w, h, value):
    out = blocks.resampled(raster, frames(spark, sf, w, h), TILE_KEYS, TILE_KEYS, how, block=SMALL, cell=SMALL)
    return blocks.pixels_of(out, TILE_KEYS, (value,)).select(*TILE_KEYS, "x", "y", r6(value).alias(value))


@query("slope_blocks", ORACLES["slope_grid"])
def _(spark, sf):
    out = blocks.slopes(tile_blocks(spark, sf), TILE_KEYS, SMALL)
    return blocks.pixels_of(out, TILE_KEYS, ("slope",)).select(*TILE_KEYS, "x", "y", r6("slope").alias("slope"))


@query("resample_bilinear_blocks", ORACLES["resample_bilinear"])
def _(spark, sf):
    return resized(spark, sf, tile_blocks(spark, sf), "bilinear", DW, DH, "z")


@query("resample_lanczos_blocks", ORACLES["resample_lanczos"])
def _(spark, sf):
    graded = tile_blocks(spark, sf, "landcover", "cls").withColumn("v", F.transform("v", lambda c: vegetation_intensity(c).cast("double")))
    return resized(spark, sf, graded, "lanczos3", 20, 33, "v")


@query("resample_nearest_blocks", ORACLES["resample_nearest"])
def _(spark, sf):
    out = blocks.resampled_nearest(tile_blocks(spark, sf, "landcover", "cls"), TILE_KEYS, TILE, TILE, 31, 77)
    return blocks.pixels_of(out, TILE_KEYS, ("cls",)).withColumn("cls", F.col("cls").cast("int"))


@query("quantize_blocks", ORACLES["quantize_u16"])
def _(spark, sf):
    out = blocks.quantized(tile_blocks(spark, sf, value="z_nan"), TILE_KEYS)
    levels = out.withColumn("v", F.col("q").cast("array<double>"))
    return blocks.pixels_of(levels, TILE_KEYS, ("q",)).withColumn("q", F.col("q").cast("int"))


# Tiles of a box as one document: where its lines stand, what they hold and where a comma is due.
@query("combined_manifest", with_ctes("boxes", "valid_boxes", **GRID, o='SELECT *, row_number() OVER (PARTITION BY box_id ORDER BY "row", col) AS n, count(*) OVER (PARTITION BY box_id) AS total FROM grid') + """
  SELECT box_id, CAST(n AS BIGINT) AS line, 'tile' AS part, n < total AS comma, "row", col, 'tile_' || "row" || '_' || col || '/h.r16' AS heightmap, CAST(NULL AS BIGINT) AS rows FROM o
  UNION ALL SELECT box_id, 0, 'head', false, NULL, NULL, NULL, max("row") - min("row") + 1 FROM o GROUP BY box_id
  UNION ALL SELECT box_id, max(total) + 1, 'foot', false, NULL, NULL, NULL, NULL FROM o GROUP BY box_id""")
def _(spark, sf):
    tiles = packages.relocate_tile_files(grid(spark, sf).withColumn("heightmap", F.lit("h.r16")), ["heightmap"])
    placed = packages.tile_order(tiles, ["box_id"]).withColumn("entry", F.to_json(F.struct("row", "col", F.struct("heightmap").alias("files"))))
    heads = packages.combine_manifests(tiles, ["box_id"], ["west"]).select("box_id", "n_tiles", F.to_json(F.struct(F.struct("rows", F.col("cols")).alias("tileGrid"))).alias("before"), F.lit('{"exportPreset":"p"}').alias("behind"))
    lines = manifests.combined_document(placed, heads, ["box_id"])
    is_tile = F.col("part") == manifests.TILE
    tile = F.from_json(F.when(is_tile, F.rtrim("value", F.lit(","))), manifests.TILE_TYPE)
    rows = lines.withColumn("t", tile).select(
        "box_id", "line", "part", (is_tile & F.col("value").endswith(",")).alias("comma"), "t.row", "t.col", F.col("t.files.heightmap").alias("heightmap"),
        F.when(F.col("part") == manifests.HEAD, F.regexp_extract("value", r'"rows":(\d+)', 1).cast("bigint")).alias("rows"),
    )
    return rows


# Sheets times kinds of buildings: a sheet without one has an empty text.
@query("features_json_all_tiles", with_ctes("tags", "feat", f=f"SELECT sheet, fid, {FLOORS_SQL} AS floors FROM feat WHERE {KIND_SQL['buildings']} AND fid % 97 = 5",
       s="SELECT DISTINCT sheet FROM feat") + """SELECT sheet, fid AS id, '{"id":' || fid || ',"floors":' || floors || '}' AS value FROM f
  UNION ALL SELECT sheet, NULL, '' FROM s WHERE sheet NOT IN (SELECT sheet FROM f)""")
def _(spark, sf):
    given = features(spark, sf)
    b = placement.extract_buildings(given.filter(vectors.tag_filter("buildings") & (F.col("id") % 97 == 5)), F.lit(10.0))
    return manifests.features_json(b, ["sheet"], ["id", "floors"], tiles=given.select("sheet"))
