"""Dimensions of buildings and roads from their tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import clamp, col, double, is_finite, is_whole, leading_integer, parse_number, round_half_up

# Limits and unit sizes of building and road tags.
MIN_HEIGHT, MAX_HEIGHT = 0.1, 1000.0
MIN_LEVELS, MAX_LEVELS = 1, 200
MAX_MIN_LEVEL = 200
METERS_PER_LEVEL = 3.0
MIN_ROAD_WIDTH, MAX_ROAD_WIDTH = 0.5, 50.0
METERS_PER_LANE = 3.5
DEFAULT_ROAD_WIDTH = 4.0
BRIDGE_CLEARANCE = 5.0
ROOF_SHAPES = ("flat", "gabled", "hipped", "pyramidal")
HIGHWAY_WIDTH = {
    "motorway": 12.0, "trunk": 10.0, "primary": 8.0, "secondary": 7.0, "tertiary": 6.0,
    "residential": 5.0, "service": 3.5, "footway": 2.0, "path": 2.0, "cycleway": 2.0,
}
HIGHWAY_COLOR = {
    "motorway": (0.15, 0.15, 0.15), "primary": (0.25, 0.25, 0.25), "secondary": (0.25, 0.25, 0.25),
}
DEFAULT_HIGHWAY_COLOR = (0.35, 0.35, 0.35)


def tag(tags, key: str) -> Column:
    return F.try_element_at(col(tags), F.lit(key))


def _valid_levels(levels) -> Column:
    n = parse_number(levels)
    return F.when(is_whole(n) & n.between(MIN_LEVELS, MAX_LEVELS), n)


def _floors_for(height) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), round_half_up(double(height) / METERS_PER_LEVEL))


def building_height(height, levels, default_height) -> Column:
    h = parse_number(height)
    return F.coalesce(
        F.when(h.between(MIN_HEIGHT, MAX_HEIGHT), h),
        _valid_levels(levels) * METERS_PER_LEVEL,
        double(default_height),
    )


def building_floors(height, levels, default_height) -> Column:
    """Valid whole levels win; otherwise the floors that fit in the height."""
    return F.coalesce(
        _valid_levels(levels).cast("bigint"), _floors_for(building_height(height, levels, default_height))
    )


def roof_shape(shape) -> Column:
    return F.when(col(shape).isin(*ROOF_SHAPES), col(shape))


def min_level(level) -> Column:
    n = parse_number(level)
    return F.coalesce(F.when(is_whole(n) & n.between(0, MAX_MIN_LEVEL), n.cast("bigint")), F.lit(0).cast("bigint"))


def _lookup(key, table: dict, default) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce(col(key), F.lit(""))), F.lit(default))


def highway_width(highway) -> Column:
    return _lookup(highway, HIGHWAY_WIDTH, DEFAULT_ROAD_WIDTH)


def highway_color(highway) -> tuple[Column, Column, Column]:
    return tuple(
        _lookup(highway, {k: v[i] for k, v in HIGHWAY_COLOR.items()}, DEFAULT_HIGHWAY_COLOR[i]) for i in range(3)
    )


def road_width(width, lanes, highway) -> Column:
    w, n = parse_number(width), parse_number(lanes)
    return F.coalesce(
        F.when(w.between(MIN_ROAD_WIDTH, MAX_ROAD_WIDTH), w),
        F.when(is_whole(n) & (n > 0), n * METERS_PER_LANE),
        highway_width(highway),
    )


def road_layer(layer) -> Column:
    return leading_integer(layer)


def bridge_offset(layer, bridge, clearance=BRIDGE_CLEARANCE) -> Column:
    """Rise of a road: its layer counts first, a bridge without layer rises once."""
    return (
        F.when(col(layer) > 0, double(layer) * double(clearance))
        .when(F.coalesce(col(bridge), F.lit("")).isin("yes", "viaduct"), double(clearance))
        .otherwise(F.lit(0.0))
    )


def road_base_y(elev_min, elev_max, exaggeration, offset, has_terrain=None) -> Column:
    y = (double(elev_min) + double(elev_max)) / 2.0 * double(exaggeration) + double(offset)
    return y if has_terrain is None else F.when(col(has_terrain), y).otherwise(F.lit(0.1))


def building_base_y(
    centroid_x, centroid_z, width_m, height_m, elev_min, elev_max, exaggeration, level, height, has_terrain=None
) -> Column:
    nx = clamp((double(centroid_x) + double(width_m) / 2.0) / double(width_m), F.lit(0.0), F.lit(1.0))
    nz = clamp((double(centroid_z) + double(height_m) / 2.0) / double(height_m), F.lit(0.0), F.lit(1.0))
    lo, hi = double(elev_min), double(elev_max)
    ground = (lo + (hi - lo) * ((nx + nz) / 2.0)) * double(exaggeration)
    if has_terrain is not None:
        ground = F.when(col(has_terrain), ground).otherwise(F.lit(0.0))
    return ground + F.greatest(col(level), F.lit(0)) * METERS_PER_LEVEL + double(height)


def mesh_height_range(elev_min, elev_max, exaggeration=1.5) -> Column:
    lo = F.when(is_finite(elev_min), double(elev_min)).otherwise(F.lit(0.0))
    hi = F.when(is_finite(elev_max), double(elev_max)).otherwise(F.lit(100.0))
    return F.greatest(F.lit(2.0), hi - lo) * double(exaggeration)


def displacement_strength(elev_min, elev_max) -> Column:
    lo, hi = F.coalesce(double(elev_min), F.lit(0.0)), F.coalesce(double(elev_max), F.lit(100.0))
    return F.greatest(F.lit(1.0), hi - lo)
