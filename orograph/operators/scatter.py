"""Deterministic scattering of instances over a vegetation mask."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import clamp, col, double, is_finite
from ..functions.rng import draw_array, with_draw
from ..functions.unroll import unroll
from ..session import settle
from .grids import blocked_row_number, explode_grid, int_range

CAP_SALTS = 64


@dataclass(frozen=True)
class ScatterSettings:
    """Defaults of a scatter run."""

    density: float = 0.01
    min_scale: float = 0.6
    max_scale: float = 1.4
    random_rotation: bool = True
    seed: int = 42
    threshold: int = 128
    cap: int = 50000
    exaggeration: float = 1.5
    jitter: float = 0.7


def scatter_candidates(tiles: DataFrame, keys: list[str], settings: ScatterSettings = ScatterSettings()) -> DataFrame:
    """Jittered grid over each tile (width_m, height_m): idx, px, pz.

    A candidate takes draws 2*idx and 2*idx+1, so each is made by itself; lines of cells are
    spread over tasks before they are expanded.
    """
    spacing = 1.0 / math.sqrt(settings.density)
    reach = settings.jitter * spacing / 2.0
    sized = tiles.select(*keys, double("width_m").alias("width_m"), double("height_m").alias("height_m"))
    sized = sized.withColumn("_cols", F.ceil(F.col("width_m") / spacing)).withColumn("_rows", F.ceil(F.col("height_m") / spacing))
    grid = explode_grid(sized, int_range(F.lit(0), F.col("_cols") - 1), int_range(F.lit(0), F.col("_rows") - 1), "_c", "_r")
    grid = grid.withColumn("idx", F.col("_r") * F.col("_cols") + F.col("_c"))

    for turn, name in enumerate(("_dx", "_dz")):
        grid = with_draw(grid, settings.seed, F.col("idx") * 2 + turn, name)

    def place(cell: str, size: str, number: str) -> Column:
        moved = (F.col(cell) + 0.5) * spacing + (F.col(number) * 2.0 - 1.0) * reach
        return F.greatest(F.lit(0.0), F.least(F.col(size), moved))

    return grid.select(*keys, "width_m", "height_m", "idx", place("_c", "width_m", "_dx").alias("px"), place("_r", "height_m", "_dz").alias("pz"))


def _mask_pixel(points: DataFrame, mask_w: int, mask_h: int, u, v) -> DataFrame:
    """Mask pixel of each point as _mx, _my; -1, which no mask has, outside 0..1.

    The pixel is never NULL, so the joins on it add no filters on the expressions behind it.
    """
    inside = col(u).between(0.0, 1.0) & col(v).between(0.0, 1.0)

    def pixel(at, size: int) -> Column:
        hit = F.least(F.floor(col(at) * size), F.lit(size - 1).cast("bigint"))
        return F.coalesce(F.when(inside, hit), F.lit(-1).cast("bigint"))

    return points.withColumns({"_mx": pixel(u, mask_w), "_my": pixel(v, mask_h)})


def sample_mask_at_points(
    points: DataFrame, mask: DataFrame, keys: list[str], mask_w: int, mask_h: int, u, v, out: str = "mask_value"
) -> DataFrame:
    """Nearest mask value at (u, v) in 0..1, v downwards; 0 outside and where nothing is stored."""
    spot = _mask_pixel(points, mask_w, mask_h, u, v)
    values = mask.select(*keys, F.col("x").alias("_mx"), F.col("y").alias("_my"), F.col("v").alias(out))
    return spot.join(values, [*keys, "_mx", "_my"], "left").withColumn(out, F.coalesce(F.col(out), F.lit(0))).drop("_mx", "_my")


def exclude_points_by_mask(points: DataFrame, mask: DataFrame, keys: list[str], mask_w: int, mask_h: int, u, v) -> DataFrame:
    """Points whose mask pixel is 0. Points outside the mask stay."""
    spot = _mask_pixel(points, mask_w, mask_h, u, v)
    taken = mask.filter("v > 0").select(*keys, F.col("x").alias("_mx"), F.col("y").alias("_my"))
    return spot.join(taken, [*keys, "_mx", "_my"], "left_anti").drop("_mx", "_my")


def scatter_filter(
    points: DataFrame, mask: DataFrame, keys: list[str], mask_w: int, mask_h: int, threshold: int = 128,
    exclusion: DataFrame | None = None,
) -> DataFrame:
    """Candidates on vegetation and off the exclusion mask; the mask is read north up."""
    u, v = F.col("px") / F.col("width_m"), F.lit(1.0) - F.col("pz") / F.col("height_m")
    if exclusion is not None:
        points = exclude_points_by_mask(points, exclusion, keys, mask_w, mask_h, u, v)
    return sample_mask_at_points(points, mask, keys, mask_w, mask_h, u, v, "mask_value").filter(
        F.col("mask_value") >= threshold
    )


def cap_instances(points: DataFrame, keys: list[str], cap: int, seed: int, salts: int = CAP_SALTS) -> DataFrame:
    """At most ``cap`` points per tile, chosen by the rank of a seeded number per idx.

    Exact size, a subset, the same on every run, everything kept when it fits. It is not the
    subset of a sequential shuffle. Every tile is
    first cut to ``cap`` in ``salts`` parts, so the final ranking sees salts*cap rows at most.
    """
    ranked = with_draw(points, seed, "idx", "_key").withColumn("_salt", F.pmod(F.xxhash64("idx"), F.lit(salts)))
    part = Window.partitionBy(*keys, "_salt").orderBy("_key", "idx")
    whole = Window.partitionBy(*keys).orderBy("_key", "idx")
    first = ranked.withColumn("_rn", F.row_number().over(part)).filter(F.col("_rn") <= cap)
    return first.withColumn("_rn", F.row_number().over(whole)).filter(F.col("_rn") <= cap).drop("_key", "_salt", "_rn")


def height_cells(grid: DataFrame, keys: list[str], subdivisions: int, value: str = "h") -> DataFrame:
    """Corner heights of every cell of an (n+1) x (n+1) height grid (x, y)."""
    last = subdivisions - 1

    def around(axis: str) -> Column:
        return int_range(F.greatest(F.col(axis) - 1, F.lit(0)), F.least(F.col(axis), F.lit(last)))

    base = grid.select(*keys, "x", "y", F.col(value).alias("_h"))
    spread = unroll(unroll(base, around("x"), "cell_x"), around("y"), "cell_z")

    def corner(dx: int, dz: int) -> Column:
        hit = (F.col("x") - F.col("cell_x") == dx) & (F.col("y") - F.col("cell_z") == dz)
        return F.max(F.when(hit, F.col("_h")))

    return spread.groupBy(*keys, "cell_x", "cell_z").agg(
        corner(0, 0).alias("h00"), corner(1, 0).alias("h10"), corner(0, 1).alias("h01"), corner(1, 1).alias("h11")
    )


def sample_height_at_points(
    points: DataFrame, grid: DataFrame, keys: list[str], subdivisions: int, u, v, value: str = "h", out: str = "height"
) -> DataFrame:
    """Bilinear height at (u, v); coordinates are clamped to the grid."""
    last = F.lit(subdivisions - 1).cast("bigint")
    gx = clamp(double(u), F.lit(0.0), F.lit(1.0)) * float(subdivisions)
    gz = clamp(double(v), F.lit(0.0), F.lit(1.0)) * float(subdivisions)
    spot = points.withColumn("_gx", gx).withColumn("_gz", gz)
    spot = spot.withColumns({c: F.coalesce(F.least(F.floor(g), last), F.lit(0).cast("bigint")) for c, g in (("cell_x", "_gx"), ("cell_z", "_gz"))})
    got = spot.join(height_cells(grid, keys, subdivisions, value), [*keys, "cell_x", "cell_z"], "left")
    fx, fz = F.col("_gx") - F.col("cell_x"), F.col("_gz") - F.col("cell_z")
    near = F.col("h00") * (1.0 - fx) + F.col("h10") * fx
    far = F.col("h01") * (1.0 - fx) + F.col("h11") * fx
    height = F.coalesce(near * (1.0 - fz) + far * fz, F.lit(0.0))
    return got.withColumn(out, height).drop("_gx", "_gz", "cell_x", "cell_z", "h00", "h10", "h01", "h11")


def scatter_instances(
    tiles: DataFrame, mask: DataFrame, height_grid: DataFrame, keys: list[str], mask_w: int, mask_h: int,
    subdivisions: int, settings: ScatterSettings = ScatterSettings(), exclusion: DataFrame | None = None,
    scale_z: float = -1.0,
) -> DataFrame:
    """Instances with world x, height and world z, centred on the tile offset.

    ``tiles`` has keys, width_m, height_m, offset_x, offset_z. The height grid starts at the
    south, so it is read at height_m - pz.
    """
    found = scatter_filter(
        scatter_candidates(tiles, keys, settings), mask, keys, mask_w, mask_h, settings.threshold, exclusion
    )
    kept = cap_instances(found, keys, settings.cap, settings.seed + 1)
    tall = sample_height_at_points(
        kept, height_grid, keys, subdivisions, F.col("px") / F.col("width_m"),
        (F.col("height_m") - F.col("pz")) / F.col("height_m"), out="y",
    )
    moved = tall.join(tiles.select(*keys, "offset_x", "offset_z"), keys)
    return moved.select(
        *keys, "idx",
        ((F.col("px") - F.col("width_m") / 2.0) + F.col("offset_x")).alias("world_x"), "y",
        ((F.col("pz") - F.col("height_m") / 2.0) * scale_z + F.col("offset_z")).alias("world_z"),
    )


def finite_groups(transforms: DataFrame, keys: list[str], matrix: str = "matrix") -> DataFrame:
    """Rows of the groups in which all matrix values are finite; other groups are left out whole.

    The test is an aggregation, so that no filter on the whole matrix expression is pushed down.
    """
    tested = transforms.groupBy(*keys).agg(F.bool_and(F.forall(matrix, is_finite)).alias("_finite"))
    bad = tested.filter(~F.col("_finite")).select(*keys)
    return transforms.join(bad, keys, "left_anti")


def instance_transforms(
    instances: DataFrame, keys: list[str], settings: ScatterSettings = ScatterSettings(), order: str = "idx"
) -> DataFrame:
    """Column-major 4x4 matrix per instance: scale, turn about the vertical axis, position.

    Instance i of a tile takes draws 2i and 2i+1 (only draw i without rotation). Positions are
    numbered block-wise, so one crowded tile does not end up in one task.
    """
    seed = settings.seed + 2
    rows = blocked_row_number(settle(instances), keys, order, "_i").withColumn("_i", F.col("_i") - 1)
    per = 2 if settings.random_rotation else 1
    rows = with_draw(rows, seed, F.col("_i") * per, "_s")
    rows = rows.withColumn("_s", F.lit(settings.min_scale) + F.col("_s") * (settings.max_scale - settings.min_scale))
    if settings.random_rotation:
        rows = with_draw(rows, seed, F.col("_i") * 2 + 1, "_a").withColumn("_a", F.col("_a") * math.pi * 2.0)
        rows = rows.withColumn("_sc", F.col("_s") * F.cos("_a")).withColumn("_ss", F.col("_s") * F.sin("_a"))
    else:
        rows = rows.withColumn("_sc", F.col("_s")).withColumn("_ss", F.lit(0.0))
    zero, one = F.lit(0.0), F.lit(1.0)
    matrix = F.array(
        F.col("_sc"), zero, F.col("_ss"), zero, zero, F.col("_s"), zero, zero,
        zero - F.col("_ss"), zero, F.col("_sc"), zero, F.col("world_x"), F.col("y"), F.col("world_z"), one,
    )
    out = rows.select(*keys, "idx", F.col("_i").alias("instance"), matrix.alias("matrix"))
    return finite_groups(out, keys)
