"""The scalar expressions as SQL functions.

``register(spark)`` creates temporary functions whose bodies are plain SQL, so a call is inlined
into the plan like any built-in expression.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

NUMBER = r"^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$"

# name -> (arguments, result type, body); later ones may call earlier ones.
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "round_half_up": ("v DOUBLE", "BIGINT", "floor(v + 0.5D)"),
    "is_nodata": ("z DOUBLE", "BOOLEAN", "z IS NULL OR isnan(z) OR z = double('-Infinity')"),
    "parse_number": ("t STRING", "DOUBLE", "nullif(nullif("
                     f"CASE WHEN t RLIKE '{NUMBER}' THEN try_cast(trim(t) AS DOUBLE) "
                     r"WHEN t RLIKE '^\\s*0[xX][0-9a-fA-F]+\\s*$' THEN aggregate(filter(split(substring(upper(trim(t)), 3), ''), c -> c <> ''), 0D, "
                     "(a, c) -> a * 16D + instr('0123456789ABCDEF', c) - 1) "
                     "WHEN t <> '' AND trim(t) = '' THEN 0D END, double('Infinity')), double('-Infinity'))"),
    "leading_integer": ("t STRING", "BIGINT", r"coalesce(try_cast(regexp_extract(coalesce(t, ''), '^\\s*([+-]?\\d+)', 1) AS BIGINT), 0L)"),
    "lng_to_pixel_x": ("lng DOUBLE, z INT", "DOUBLE", "(lng + 180D) / 360D * pow(2D, z) * 256D"),
    "lat_to_pixel_y": ("lat DOUBLE, z INT", "DOUBLE", "(1D - ln(tan(radians(lat)) + 1D / cos(radians(lat))) / pi()) / 2D * pow(2D, z) * 256D"),
    "lng_to_tile_x": ("lng DOUBLE, z INT", "BIGINT", "floor((lng + 180D) / 360D * pow(2D, z))"),
    "lat_to_tile_y": ("lat DOUBLE, z INT", "BIGINT", "floor((1D - ln(tan(radians(lat)) + 1D / cos(radians(lat))) / pi()) / 2D * pow(2D, z))"),
    "tile_x_to_lng": ("x BIGINT, z INT", "DOUBLE", "x / pow(2D, z) * 360D - 180D"),
    "tile_y_to_lat": ("y BIGINT, z INT", "DOUBLE", "degrees(atan(sinh(pi() - 2D * pi() * y / pow(2D, z))))"),
    "decode_terrarium": ("r INT, g INT, b INT", "DOUBLE", "r * 256D + g + b / 256D - 32768D"),
    "decode_terrain_rgb": ("r INT, g INT, b INT", "DOUBLE", "-10000D + (r * 65536D + g * 256D + b) * 0.1D"),
    "vegetation_intensity": ("cls INT", "INT", "CASE cls WHEN 10 THEN 255 WHEN 20 THEN 200 WHEN 30 THEN 150 WHEN 40 THEN 100 ELSE 0 END"),
    "threshold_mask": ("v DOUBLE, t DOUBLE", "INT", "CASE WHEN v >= t THEN 255 ELSE 0 END"),
    "quantize_u16": ("z DOUBLE, z_min DOUBLE, z_range DOUBLE", "INT",
                     "CAST(floor(greatest(0D, least(65535D, (CASE WHEN z IS NULL OR isnan(z) OR z = double('-Infinity') THEN z_min ELSE z END - z_min) "
                     "/ CASE WHEN z_range = 0 THEN 1D ELSE z_range END * 65535D)) + 0.5D) AS INT)"),
    "quantize_i16": ("z DOUBLE", "INT", "CAST(floor(greatest(-32768D, least(32767D, CASE WHEN z IS NULL OR isnan(z) OR z = double('-Infinity') THEN 0D ELSE z END)) + 0.5D) AS INT)"),
    "float_height": ("z DOUBLE", "DOUBLE", "CASE WHEN z IS NULL OR isnan(z) OR z = double('-Infinity') THEN 0D ELSE z END"),
    "bridge_offset": ("layer BIGINT, bridge STRING", "DOUBLE", "CASE WHEN layer > 0 THEN layer * 5D WHEN coalesce(bridge, '') IN ('yes', 'viaduct') THEN 5D ELSE 0D END"),
    "highway_width": ("h STRING", "DOUBLE", "CASE h WHEN 'motorway' THEN 12D WHEN 'trunk' THEN 10D WHEN 'primary' THEN 8D WHEN 'secondary' THEN 7D WHEN 'tertiary' THEN 6D "
                      "WHEN 'residential' THEN 5D WHEN 'service' THEN 3.5D WHEN 'footway' THEN 2D WHEN 'path' THEN 2D WHEN 'cycleway' THEN 2D ELSE 4D END"),
    "roof_shape": ("s STRING", "STRING", "CASE WHEN s IN ('flat', 'gabled', 'hipped', 'pyramidal') THEN s END"),
    "place_zoom": ("kind STRING", "INT", "CASE kind WHEN 'city' THEN 12 WHEN 'village' THEN 16 WHEN 'address' THEN 16 WHEN 'landmark' THEN 16 ELSE 14 END"),
    "redact_url": ("u STRING", "STRING", r"regexp_replace(regexp_replace(regexp_replace(u, '(?i)API_Key=[^&]+', 'API_Key=****'), "
                   r"'(?i)access_token=[^&]+', 'access_token=****'), '(?i)\\bkey=[^&]+', 'key=****')"),
}


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Create all functions, named with ``prefix``, and return their names."""
    for name, (arguments, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({arguments}) RETURNS {result} RETURN {body}")
    return [prefix + name for name in FUNCTIONS]
