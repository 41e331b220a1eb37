"""Elevation decoding and quantisation expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import clamp, col, double, is_finite, is_nodata, round_half_up

U16_MAX = 65535
# Land-cover class -> vegetation intensity.
VEGETATION_INTENSITY = {10: 255, 20: 200, 30: 150, 40: 100}


def decode_terrarium(r, g, b) -> Column:
    return double(r) * 256.0 + double(g) + double(b) / 256.0 - 32768.0


def decode_terrain_rgb(r, g, b) -> Column:
    return F.lit(-10000.0) + (double(r) * 65536.0 + double(g) * 256.0 + double(b)) * 0.1


def decode_elevation(source, r, g, b) -> Column:
    """Terrain-RGB for the one source that uses it, the Terrarium form for all others."""
    return F.when(col(source) == "mapbox-terrain-rgb", decode_terrain_rgb(r, g, b)).otherwise(
        decode_terrarium(r, g, b)
    )


def vegetation_intensity(cls) -> Column:
    out = F.lit(0)
    for code, value in reversed(VEGETATION_INTENSITY.items()):
        out = F.when(col(cls) == code, F.lit(value)).otherwise(out)
    return out


def threshold_mask(value, threshold) -> Column:
    return F.when(double(value) >= double(threshold), F.lit(255)).otherwise(F.lit(0))


def quantize_u16(z, z_min, z_range) -> Column:
    value = F.when(is_nodata(z), double(z_min)).otherwise(double(z))
    span = F.when(double(z_range) == 0, F.lit(1.0)).otherwise(double(z_range))
    scaled = (value - double(z_min)) / span * float(U16_MAX)
    return round_half_up(clamp(scaled, F.lit(0.0), F.lit(float(U16_MAX)))).cast("int")


def quantize_i16(z) -> Column:
    value = F.when(is_nodata(z), F.lit(0.0)).otherwise(double(z))
    return round_half_up(clamp(value, F.lit(-32768.0), F.lit(32767.0))).cast("int")


def float_height(z) -> Column:
    return F.when(is_nodata(z), F.lit(0.0)).otherwise(double(z))


def nodata_to_zero(z, nodata) -> Column:
    return F.when(col(nodata).isNotNull() & (double(z) == double(nodata)), F.lit(0.0)).otherwise(double(z))


def _to_u8(value) -> Column:
    return round_half_up(clamp(value, F.lit(0.0), F.lit(255.0))).cast("int")


def normalize_mask_u8(v, low, high) -> Column:
    """8-bit mask value from a band whose finite minimum and maximum are ``low`` and ``high``."""
    v, low, high = double(v), double(low), double(high)
    plain = (low >= 0) & (high <= 255) & (low == F.floor(low)) & (high == F.floor(high))
    scaled = F.when(is_finite(v), (v - low) / F.nullif(high - low, F.lit(0.0)) * 255.0).otherwise(0.0)
    return (
        F.when(low.isNull(), F.lit(0))
        .when(low == high, F.when(low > 0, F.lit(255)).otherwise(F.lit(0)))
        .when(plain, _to_u8(F.when(F.isnan(v), F.lit(0.0)).otherwise(v)))
        .otherwise(_to_u8(scaled))
    )


def preview_u8(v, low, high) -> Column:
    """8-bit preview of a band; a constant or empty band is shown on the scale 0..1."""
    v = double(v)
    flat = double(low).isNull() | (double(low) == double(high))
    base = F.when(flat, F.lit(0.0)).otherwise(double(low))
    span = F.when(flat, F.lit(1.0)).otherwise(double(high) - double(low))
    return _to_u8(F.when(is_finite(v), (v - base) / span * 255.0).otherwise(F.lit(0.0)))
