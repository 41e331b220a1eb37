"""Longitude/latitude arithmetic as Spark column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import clamp, col, double, round_half_up

TILE_SIZE = 256
METERS_PER_DEGREE = 111320.0
ELEVATION_MAX_ZOOM = 15
IMAGERY_MAX_ZOOM = 19


def _scale(zoom) -> Column:
    return F.pow(F.lit(2.0), double(zoom))


def _world_x(lng) -> Column:
    return (double(lng) + 180.0) / 360.0


def _world_y(lat) -> Column:
    phi = double(lat) * math.pi / 180.0
    return (1.0 - F.ln(F.tan(phi) + 1.0 / F.cos(phi)) / math.pi) / 2.0


def lng_to_pixel_x(lng, zoom, tile_size: int = TILE_SIZE) -> Column:
    return _world_x(lng) * _scale(zoom) * float(tile_size)


def lat_to_pixel_y(lat, zoom, tile_size: int = TILE_SIZE) -> Column:
    return _world_y(lat) * _scale(zoom) * float(tile_size)


def lng_to_tile_x(lng, zoom) -> Column:
    return F.floor(_world_x(lng) * _scale(zoom))


def lat_to_tile_y(lat, zoom) -> Column:
    return F.floor(_world_y(lat) * _scale(zoom))


def lat_range_y(north, south, zoom) -> tuple[Column, Column]:
    """Sides of a box on the web grid in tiles from its northern end; the southern one is exclusive if it is a pole.

    A pole lies infinitely far away on this map. A box that reaches one ends with the last row of the grid or, if it
    lies beyond the grid as a whole, with the first row that begins half a tile or more behind its other side.
    """
    scale, half = _scale(zoom), F.lit(0.5)
    top, bottom = _world_y(north) * scale, _world_y(south) * scale
    below = F.greatest(scale, F.ceil(top + half).cast("double"))
    above = F.least(F.lit(0.0), F.floor(bottom - half).cast("double"))
    # next to the south pole the sum of tangent and secant is 0, whose logarithm is null
    return F.when(double(north) == 90, above).otherwise(top), F.when(bottom.isNull() & double(south).between(-90, 0), below).otherwise(bottom)


def tile_x_to_lng(x, zoom) -> Column:
    return double(x) / _scale(zoom) * 360.0 - 180.0


def tile_y_to_lat(y, zoom) -> Column:
    return F.degrees(F.atan(F.sinh(math.pi - 2.0 * math.pi * double(y) / _scale(zoom))))


def choose_zoom(west, south, east, north, target_size, max_zoom) -> Column:
    """Smallest zoom whose pixels are at least as fine as ``target_size`` over the box.

    ``log2`` of an exact power of two can miss by one unit in the last place, so the
    ceiling is corrected against the power itself.
    """
    span = F.least(double(east) - double(west), double(north) - double(south))
    need = double(target_size) * 360.0 / (span * float(TILE_SIZE))
    z = F.ceil(F.log2(need))
    z = (
        F.when(F.pow(F.lit(2.0), z - 1) >= need, z - 1)
        .when(F.pow(F.lit(2.0), z) < need, z + 1)
        .otherwise(z)
    )
    return F.when(span <= 0, F.lit(10).cast("bigint")).otherwise(
        clamp(z, F.lit(1).cast("bigint"), col(max_zoom).cast("bigint"))
    )


def tile_size_meters(west, south, east, north) -> dict[str, Column]:
    """Ground size of a box: width, height (each at least 1 m) and the larger of the two."""
    mid = F.radians((double(north) + double(south)) * 0.5)
    width = F.greatest(F.lit(1.0), (double(east) - double(west)) * (METERS_PER_DEGREE * F.cos(mid)))
    height = F.greatest(F.lit(1.0), (double(north) - double(south)) * METERS_PER_DEGREE)
    return {"width_m": width, "height_m": height, "chunk_m": F.greatest(width, height)}


def geo_to_pixel(lat, lon, west, south, east, north, width, height) -> tuple[Column, Column]:
    """Raster pixel of a point, north row first; points outside land on the nearest edge."""
    w, s, e, n = double(west), double(south), double(east), double(north)
    fx = F.when(e == w, F.lit(0.5)).otherwise((double(lon) - w) / F.nullif(e - w, F.lit(0.0)))
    fy = F.when(n == s, F.lit(0.5)).otherwise((n - double(lat)) / F.nullif(n - s, F.lit(0.0)))
    last_x, last_y = double(width) - 1.0, double(height) - 1.0
    return (
        round_half_up(clamp(fx * last_x, F.lit(0.0), last_x)),
        round_half_up(clamp(fy * last_y, F.lit(0.0), last_y)),
    )


def geo_to_local(lat, lon, west, south, east, north, width_m, height_m) -> tuple[Column, Column]:
    """Metres east and north of the centre of a tile."""
    w, s, e, n = double(west), double(south), double(east), double(north)
    x = (double(lon) - w) / (e - w) * double(width_m) - double(width_m) / 2.0
    z = (double(lat) - s) / (n - s) * double(height_m) - double(height_m) / 2.0
    return x, z


def affine_georef(west, south, east, north, width, height, raster_type) -> dict[str, Column]:
    """Pixel size and tie point of a raster; samples sit on points or fill areas."""
    less = F.when(col(raster_type) == "point", F.lit(1)).otherwise(F.lit(0))
    return {
        "pixel_width": (double(east) - double(west)) / (col(width) - less),
        "pixel_height": (double(south) - double(north)) / (col(height) - less),
        "tie_lon": double(west),
        "tie_lat": double(north),
    }
