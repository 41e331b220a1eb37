"""Slope, cliffs and per-tile value statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import heights
from ..functions.numbers import double, floor_div, is_finite, is_nodata
from ..functions.unroll import unroll
from .resample import resample_nearest

HALO_BLOCK = 256


def halo_blocks(pixels: DataFrame, block: int = HALO_BLOCK, reach: int = 1) -> DataFrame:
    """Cut rasters into blocks and copy a margin of ``reach`` pixels into the neighbours.

    Adds _bx, _by and _own (false for copies). Neighbourhood operators then need one shuffle by
    block; no group grows beyond (block + 2*reach)**2 pixels however large a raster is.
    """
    if block < 2 * reach:
        raise ValueError("a block must be at least twice as wide as the margin")

    def blocks(axis: str) -> Column:
        home = floor_div(axis, block)
        low, high = floor_div(F.col(axis) - reach, block), floor_div(F.col(axis) + reach, block)
        return F.when(low == high, F.array(home)).when(low < home, F.array(low, home)).otherwise(F.array(home, high))

    out = unroll(unroll(pixels, blocks("x"), "_bx"), blocks("y"), "_by")
    own = (F.col("_bx") == floor_div("x", block)) & (F.col("_by") == floor_div("y", block))
    return out.withColumn("_own", own)


def slope_grid(
    pixels: DataFrame, keys: list[str], value: str = "z", block: int = HALO_BLOCK, cell_size: float = 1.0,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Slope in degrees by central differences, one-sided at the border of the raster.

    Distances are pixels unless ``cell_size`` gives the ground size of one. Columns named in
    ``carry`` stay. A hole counts as a border.
    """
    base = pixels.select(*keys, "x", "y", double(value).alias("_z"), *carry)
    cut = halo_blocks(base, block)
    place = [*keys, "_bx", "_by"]
    cut = cut.repartition(*[F.col(c) for c in place])
    across = Window.partitionBy(*place, "y").orderBy("x")
    down = Window.partitionBy(*place, "x").orderBy("y")

    def gradient(axis: str, w) -> Column:
        def side(fn, step):
            return F.when(fn(axis).over(w) == F.col(axis) + step, fn("_z").over(w))

        before, after = side(F.lag, -1), side(F.lead, 1)
        gap = before.isNotNull().cast("double") + after.isNotNull().cast("double")
        rise = F.coalesce(after, F.col("_z")) - F.coalesce(before, F.col("_z"))
        return F.when(gap > 0, rise / (F.nullif(gap, F.lit(0.0)) * float(cell_size))).otherwise(F.lit(0.0))

    out = cut.withColumn("_dx", gradient("x", across)).withColumn("_dy", gradient("y", down)).filter("_own")
    steep = F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy"))
    return out.select(*keys, "x", "y", F.degrees(F.atan(steep)).alias("slope"), *carry)


def cliff_mask(
    pixels: DataFrame, keys: list[str], width, height, threshold: float, resolution: int, value: str = "z",
    sparse: bool = False,
) -> DataFrame:
    """255 where the slope reaches the threshold, resized to ``resolution`` by nearest pixel."""
    sizes = tuple(c for c in (width, height) if isinstance(c, str))
    mask = slope_grid(pixels, keys, value, carry=sizes).select(
        *keys, "x", "y", heights.threshold_mask("slope", F.lit(float(threshold))).alias("v"), *sizes
    )
    if sparse:
        mask = mask.filter("v > 0")
    return resample_nearest(mask, keys, width, height, resolution, resolution, ("v",))


def elevation_stats(pixels: DataFrame, keys: list[str], value: str = "z") -> DataFrame:
    """Minimum, maximum, range and no-data flag per tile; a tile without values gives 0, 0."""
    valid = F.when(~is_nodata(value), double(value))
    out = pixels.groupBy(*keys).agg(
        F.coalesce(F.min(valid), F.lit(0.0)).alias("z_min"),
        F.coalesce(F.max(valid), F.lit(0.0)).alias("z_max"),
        F.bool_or(is_nodata(value)).alias("has_nodata"),
    )
    return out.withColumn("z_range", F.col("z_max") - F.col("z_min"))


def display_elevation(z) -> Column:
    """Elevation with two decimals for people to read."""
    return F.floor(double(z) * 100.0 + 0.5) / 100.0


def quantize_heights(pixels: DataFrame, keys: list[str], value: str = "z") -> DataFrame:
    """16-bit heights scaled per tile.

    The statistics have one row per tile and are joined back; the adaptive planner broadcasts
    them when they turn out small and splits tiles that hold too many pixels otherwise.
    """
    stats = elevation_stats(pixels, keys, value).select(*keys, "z_min", "z_range")
    return pixels.join(stats, keys).withColumn("q", heights.quantize_u16(value, "z_min", "z_range")).drop(
        "z_min", "z_range"
    )


def _finite_range(pixels: DataFrame, keys: list[str], value: str) -> DataFrame:
    finite = F.when(is_finite(value), double(value))
    return pixels.groupBy(*keys).agg(F.min(finite).alias("_low"), F.max(finite).alias("_high"))


def normalize_masks(pixels: DataFrame, keys: list[str], value: str = "v", out: str = "u8") -> DataFrame:
    joined = pixels.join(_finite_range(pixels, keys, value), keys)
    return joined.withColumn(out, heights.normalize_mask_u8(value, "_low", "_high")).drop("_low", "_high")


def preview_bands(pixels: DataFrame, keys: list[str], value: str = "v", out: str = "u8") -> DataFrame:
    joined = pixels.join(_finite_range(pixels, keys, value), keys)
    return joined.withColumn(out, heights.preview_u8(value, "_low", "_high")).drop("_low", "_high")
