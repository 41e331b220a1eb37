"""Validation of boxes and export requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.numbers import col, double
from ..sources.catalogs import ELEVATION_SOURCES, tile_range

# Limits of one export.
MAX_TILES, WARN_TILES, MAX_MEMORY_MB, MAX_MOSAIC_MB, WARN_ZOOM = 1024, 256, 2048, 512, 17
TILE = geo.TILE_SIZE
# Sources that answer one request per box have a dataset code.
BOX_SOURCES = [s[0] for s in ELEVATION_SOURCES if s[3]]


def messages(*rules: tuple[Column, str]) -> Column:
    """Array of the texts whose condition holds."""
    return F.filter(F.array(*[F.when(cond, F.lit(text)) for cond, text in rules]), lambda m: m.isNotNull())


def bounds_errors(west="west", south="south", east="east", north="north") -> Column:
    w, s, e, n = double(west), double(south), double(east), double(north)
    return messages(
        (w >= e, "west is not below east"),
        (s >= n, "south is not below north"),
        ((w < -180) | (e > 180), "longitude outside -180..180"),
        ((s < -90) | (n > 90), "latitude outside -90..90"),
    )


def validate_bounds(boxes: DataFrame) -> DataFrame:
    out = boxes.withColumn("errors", bounds_errors())
    return out.withColumn("valid", F.size("errors") == 0)


def export_cost_estimate(
    boxes: DataFrame, height_size=1024, image_size=1024, imagery_zoom=0, source: str = "dem_source"
) -> DataFrame:
    """Tiles and memory an export would take, with errors and warnings.

    A source that answers whole boxes counts as one tile of height_size**2 pixels.
    """
    sides = ("west", "south", "east", "north")
    asked = col(imagery_zoom)
    out = boxes.withColumn("dem_zoom", geo.choose_zoom(*sides, height_size, geo.ELEVATION_MAX_ZOOM)).withColumn(
        "img_zoom", F.when(asked > 0, asked.cast("bigint")).otherwise(geo.choose_zoom(*sides, image_size, geo.IMAGERY_MAX_ZOOM))
    )

    def count(zoom: str) -> Column:
        r = tile_range(zoom)
        return (r["max_x"] - r["min_x"] + 1) * (r["max_y"] - r["min_y"] + 1)

    one_box = F.col(source).isin(*BOX_SOURCES)
    out = out.withColumn("_dem", count("dem_zoom")).withColumn("_img", count("img_zoom"))
    out = out.withColumn("dem_tiles", F.when(one_box, F.lit(1).cast("bigint")).otherwise(F.col("_dem")))
    dem_pixels = F.when(one_box, (col(height_size) * col(height_size)).cast("bigint")).otherwise(F.col("_dem") * TILE * TILE)
    mosaic = F.col("_img") * TILE * TILE * 4
    out = out.withColumn("total_tiles", F.col("dem_tiles") + F.col("_img")).withColumn("memory_bytes", dem_pixels * 4 + mosaic)
    mb = 1024 * 1024
    errors = messages(
        (F.col("total_tiles") > MAX_TILES, f"more than {MAX_TILES} tiles"),
        (F.col("memory_bytes") > MAX_MEMORY_MB * mb, f"more than {MAX_MEMORY_MB} MB of memory"),
        (mosaic > MAX_MOSAIC_MB * mb, f"imagery mosaic above {MAX_MOSAIC_MB} MB"),
    )
    warnings = messages(
        (F.col("total_tiles") > WARN_TILES, f"more than {WARN_TILES} tiles may take long"),
        (F.col("img_zoom") > WARN_ZOOM, f"imagery zoom above {WARN_ZOOM} is slow"),
    )
    return out.withColumn("errors", F.concat(bounds_errors(), errors)).withColumn("warnings", warnings).drop("_dem", "_img")


def crs_check(shapes: DataFrame, text: str = "projection") -> DataFrame:
    """Whether the description is geographic and the extent lies in longitude/latitude range."""
    from ..functions.names import geographic_crs

    inside = (F.col("min_x") >= -180) & (F.col("max_x") <= 180) & (F.col("min_y") >= -90) & (F.col("max_y") <= 90)
    return shapes.withColumn("geographic", geographic_crs(text)).withColumn("in_range", inside)
