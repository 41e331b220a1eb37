"""Tiles of a package: order, offsets, repair, combination and import reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import path_tile_coords
from ..functions.numbers import double, is_finite
from ..functions.unroll import unroll
from .grids import blocked_row_number, int_range

METERS_PER_DEGREE = 111320.0
DEFAULT_TILE_M = 4000.0
REPORTED_FAILURES = 3


def selected_tiles(tiles: DataFrame, selection: DataFrame, keys: list[str]) -> DataFrame:
    return tiles.join(selection.select(*keys, "row", "col"), [*keys, "row", "col"], "left_semi")


def tile_order(tiles: DataFrame, keys: list[str], name: str = "ordinal") -> DataFrame:
    """Position of each tile by row, then column. Needs ``cols``, the width of the full grid."""
    placed = tiles.withColumn("_at", F.col("row") * F.col("cols") + F.col("col"))
    return blocked_row_number(placed, keys, "_at", name).drop("_at")


def mean_center_lat(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """Mean latitude of the tile centres and the metres of a degree there."""
    out = tiles.groupBy(*keys).agg(F.avg((F.col("north") + F.col("south")) / 2.0).alias("center_lat"))
    return out.withColumn("m_per_deg_lat", F.lit(METERS_PER_DEGREE)).withColumn(
        "m_per_deg_lng", METERS_PER_DEGREE * F.cos(F.radians("center_lat"))
    )


def world_offsets(tiles: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Start of every column and row in metres: (columns, rows).

    Sizes come from the first tile of a column or row in (row, col) order. Columns without a
    tile add nothing. The running sum has one row per column of a grid.
    """
    scaled = tiles.join(mean_center_lat(tiles, keys), keys)

    def axis(index: str, other: str, size) -> DataFrame:
        first = scaled.groupBy(*keys, index).agg(
            F.min_by(F.greatest(F.lit(1.0), size), F.struct("row", "col")).alias("size_m")
        )
        ends = first.groupBy(*keys).agg(F.min(index).alias("_lo"), F.max(index).alias("_hi"))
        every = unroll(ends, int_range("_lo", "_hi"), index).select(*keys, index)
        w = Window.partitionBy(*keys).orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
        full = every.join(first, [*keys, index], "left")
        return full.select(*keys, index, F.coalesce(F.sum(F.coalesce("size_m", F.lit(0.0))).over(w), F.lit(0.0)).alias("offset_m"))

    columns = axis("col", "row", (F.col("east") - F.col("west")) * F.col("m_per_deg_lng"))
    rows = axis("row", "col", (F.col("north") - F.col("south")) * F.col("m_per_deg_lat"))
    return columns, rows


def duplicate_tile_repair(tiles: DataFrame, keys: list[str], heightmap: str = "heightmap", albedo: str = "albedo") -> DataFrame:
    """Rows and columns from the file paths in packages where any position repeats.

    The test is an aggregation (map-side combined) followed by a semi-join on packages, so a
    package with very many tiles is not brought into one task.
    """
    bad = (
        tiles.groupBy(*keys, "row", "col").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*keys).distinct()
        .withColumn("_bad", F.lit(True))
    )
    (hr, hc), (ar, ac) = path_tile_coords(heightmap), path_tile_coords(albedo)
    out = tiles.join(bad, keys, "left").withColumn("repaired", F.coalesce("_bad", F.lit(False)))
    use_h, use_a = F.col("repaired") & hr.isNotNull(), F.col("repaired") & ar.isNotNull()
    return out.withColumns({
        "row": F.when(use_h, hr).when(use_a, ar).otherwise(F.col("row")),
        "col": F.when(use_h, hc).when(use_a, ac).otherwise(F.col("col")),
    }).drop("_bad")


def combine_manifests(tiles: DataFrame, keys: list[str], header: list[str]) -> DataFrame:
    """One header row per package: grid size, number of tiles, other fields of the first tile.

    The tiles stay a table; ``relocate_tile_files`` gives them the folder they lie in. A package
    of any size is therefore never gathered into one row.
    """
    first = F.min_by(F.struct(*header), F.struct("row", "col"))
    one = F.lit(1).cast("bigint")
    return tiles.groupBy(*keys).agg(
        F.greatest(one, F.max("row") - F.min("row") + 1).alias("rows"),
        F.greatest(one, F.max("col") - F.min("col") + 1).alias("cols"),
        F.min("row").alias("min_row"), F.min("col").alias("min_col"), F.count(F.lit(1)).alias("n_tiles"), first.alias("_h"),
    ).select(*keys, "rows", "cols", "min_row", "min_col", "n_tiles", "_h.*")


def relocate_tile_files(tiles: DataFrame, files: list[str]) -> DataFrame:
    folder = F.concat(F.lit("tile_"), F.col("row").cast("string"), F.lit("_"), F.col("col").cast("string"), F.lit("/"))
    return tiles.withColumns({f: F.when(F.length(f) > 0, F.concat(folder, F.col(f))) for f in files})


def package_elevation_range(tiles: DataFrame, keys: list[str], low: str = "z_min", high: str = "z_max") -> DataFrame:
    """Lowest minimum and highest maximum of a package; 0..100 when the minimum is not finite."""
    out = tiles.groupBy(*keys).agg(
        F.min(low).alias("_lo"), F.max(high).alias("_hi"), F.bool_or(F.isnan(low)).alias("_nan")
    )
    ok = is_finite("_lo") & ~F.col("_nan")
    return out.select(
        *keys, F.when(ok, F.col("_lo")).otherwise(F.lit(0.0)).alias("package_min"),
        F.when(ok, F.col("_hi")).otherwise(F.lit(100.0)).alias("package_max"),
    )


def tile_placement(tiles: DataFrame, keys: list[str], width: str = "tile_w_m", height: str = "tile_h_m", size: str = "chunk_m") -> DataFrame:
    """Three placements of a tile: centred grid, import position and package offset.

    The import position falls back to col*size, row*size when both stored offsets are (nearly)
    zero; the package offset is col*width, row*height.
    """
    span = tiles.groupBy(*keys).agg(
        F.min("row").alias("_r0"), F.max("row").alias("_r1"), F.min("col").alias("_c0"), F.max("col").alias("_c1")
    )
    one = F.lit(1).cast("bigint")
    rows, cols = F.greatest(one, F.col("_r1") - F.col("_r0") + 1), F.greatest(one, F.col("_c1") - F.col("_c0") + 1)
    w, h = double(width), double(height)
    stored = (F.abs(double("offset_x")) > 1e-6) | (F.abs(double("offset_z")) > 1e-6)
    fallback = F.coalesce(double(size), F.lit(DEFAULT_TILE_M))
    return tiles.join(span, keys).withColumns({
        "grid_x": (F.col("col") - F.col("_c0")) * w - cols * w / 2.0,
        "grid_z": (F.col("row") - F.col("_r0")) * h - rows * h / 2.0,
        "import_x": F.when(stored, double("offset_x")).otherwise(F.col("col") * fallback),
        "import_z": F.when(stored, double("offset_z")).otherwise(F.col("row") * fallback),
        "package_x": F.col("col") * w, "package_z": F.col("row") * h,
    }).drop("_r0", "_r1", "_c0", "_c1")


def import_summary(outcomes: DataFrame, keys: list[str], order: str = "ordinal", reason: str = "reason") -> DataFrame:
    """Imported and failed tiles with the first failures named; ``reason`` is NULL on success.

    Only the failures that are named are ever gathered, and Spark cuts to them before shuffling.
    """
    counts = outcomes.groupBy(*keys).agg(
        F.count_if(F.col(reason).isNull()).alias("imported"), F.count_if(F.col(reason).isNotNull()).alias("failed")
    )
    text = F.concat(F.lit("tile_"), F.col("row").cast("string"), F.lit("_"), F.col("col").cast("string"), F.lit(" ("), F.col(reason), F.lit(")"))
    w = Window.partitionBy(*keys).orderBy(order)
    named = (
        outcomes.filter(F.col(reason).isNotNull()).select(*keys, order, text.alias("_text"))
        .withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= REPORTED_FAILURES)
        .groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_rn", "_text"))).alias("_l"))
    )
    out = counts.join(named, keys, "left")
    listed = F.array_join(F.transform("_l", lambda s: s["_text"]), ", ")
    dots = F.when(F.col("failed") > REPORTED_FAILURES, F.lit("...")).otherwise(F.lit(""))
    return out.withColumn("failures", F.when(F.col("failed") > 0, F.concat(listed, dots)).otherwise(F.lit(""))).drop("_l")


def folder_order(tiles: DataFrame, folder: str = "folder") -> DataFrame:
    """Tile folders in lexical order (a range-partitioned sort)."""
    return tiles.orderBy(folder)
