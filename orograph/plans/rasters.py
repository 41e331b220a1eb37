"""Where the rasters of an export come from, and which window of them a tile of the export reads."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.numbers import round_half_up
from ..operators import blocks, mosaic
from ..sources import catalogs

SIDES = ("west", "south", "east", "north")


@dataclass(frozen=True)
class Georeference:
    """Size of the rasters of all areas and ground size of a pixel; each starts at the north-west corner of its area."""

    width: int
    height: int
    pixel_deg: float


@dataclass(frozen=True)
class RasterSource:
    """A block raster and what the tiles of an export read of it.

    ``windows`` adds left, top, src_w, src_h (and the sides of the clip) and the columns ``keys`` to tiles with a box;
    tiles whose raster is unknown may be left out. ``covered`` keeps the tiles for which there is anything at all.
    """

    blocks: DataFrame
    keys: list[str]
    windows: Callable[[DataFrame], DataFrame]
    covered: Callable[[DataFrame], DataFrame]
    bands: int = 1
    fill: float | None = 0.0

    def frames(self, tiles: DataFrame, width: int, height: int) -> DataFrame:
        return self.windows(tiles).withColumns({"dst_w": F.lit(width).cast("bigint"), "dst_h": F.lit(height).cast("bigint")})


def area_raster(raster: DataFrame, area_key: str, georef: Georeference | DataFrame, values: tuple[str, ...] = ("z",)) -> RasterSource:
    """Rasters of areas, as pixels (area key, x, y, values) or as blocks.

    ``georef`` is one for all areas or a table with the area key, width, height, pixel_w and pixel_h (degrees) and, if the
    rasters do not start at the corner of their areas, origin_lon and origin_lat.
    """
    cut = raster if "v" in raster.columns and "x0" in raster.columns else blocks.blocks_of(raster, [area_key], values)

    def windows(tiles: DataFrame) -> DataFrame:
        if isinstance(georef, Georeference):
            sized = tiles.withColumns({"_gw": F.lit(georef.width), "_gh": F.lit(georef.height), "_pw": F.lit(georef.pixel_deg), "_ph": F.lit(georef.pixel_deg)})
        else:
            more = [F.col(c).alias(f"_{c}") for c in ("origin_lon", "origin_lat") if c in georef.columns]
            facts = georef.select(area_key, F.col("width").alias("_gw"), F.col("height").alias("_gh"), F.col("pixel_w").alias("_pw"), F.col("pixel_h").alias("_ph"), *more)
            sized = tiles.join(facts, area_key)
        lon, lat = ("_origin_lon" if "_origin_lon" in sized.columns else "area_west"), ("_origin_lat" if "_origin_lat" in sized.columns else "area_north")
        out = mosaic.georef_window(sized, "_gw", "_gh", lon, lat, "_pw", "_ph").withColumnsRenamed({"width": "src_w", "height": "src_h"})
        return out.drop("_gw", "_gh", "_pw", "_ph", "_origin_lon", "_origin_lat")

    def covered(tiles: DataFrame) -> DataFrame:
        return tiles.join(cut.select(area_key).distinct(), area_key, "left_semi")

    return RasterSource(cut, [area_key], windows, covered, len(values), None)


def web_tiles(decoded: DataFrame, target_size: int, max_zoom: int, bands: int = 1, zoom: Column | None = None) -> RasterSource:
    """Decoded tiles (z, tile_x, tile_y and a block) of the web grid.

    A tile of the export reads the zoom that is as fine as ``target_size`` pixels over its box (or ``zoom``), from the
    source tiles that its box touches and no others. What is missing there reads as 0.
    """
    size = geo.TILE_SIZE
    held = decoded.filter(F.col("v").isNotNull()).select(
        F.col("z").cast("int").alias("z"), (F.col("tile_x") * size + F.col("x0")).alias("x0"), (F.col("tile_y") * size + F.col("y0")).alias("y0"), "w", "h", "v")

    def zoomed(tiles: DataFrame) -> DataFrame:
        found = geo.choose_zoom(*SIDES, F.lit(target_size), max_zoom) if zoom is None else zoom
        return tiles.withColumn("z", found.cast("int")).withColumns(catalogs.tile_range("z"))

    def windows(tiles: DataFrame) -> DataFrame:
        out = mosaic.mercator_window(zoomed(tiles), "z", "min_x", "min_y").withColumnsRenamed({"width": "src_w", "height": "src_h"})
        clip = {"clip_left": F.col("min_x") * size, "clip_top": F.col("min_y") * size, "clip_right": (F.col("max_x") + 1) * size, "clip_bottom": (F.col("max_y") + 1) * size}
        out = out.withColumns(clip | {"left": F.col("left") + F.col("min_x") * size, "top": F.col("top") + F.col("min_y") * size})
        return out.drop("min_x", "max_x", "min_y", "max_y")

    def covered(tiles: DataFrame) -> DataFrame:
        there = decoded.filter(F.col("v").isNotNull()).select(F.col("z").cast("int").alias("z"), "tile_x", "tile_y")
        met = catalogs.tile_catalog(tiles, geo.choose_zoom(*SIDES, F.lit(target_size), max_zoom) if zoom is None else zoom).join(there, ["z", "tile_x", "tile_y"], "left_semi")
        return met.select(*tiles.columns).distinct()

    return RasterSource(held, ["z"], windows, covered, bands)


def landcover_tiles(decoded: DataFrame, tile_px: int) -> RasterSource:
    """Decoded class rasters (tile_lon, tile_lat and a block) of the 3-degree grid, ``tile_px`` pixels wide and high.

    A tile of the export reads the part of its box; classes that are missing there read as 0.
    """
    d = catalogs.LANDCOVER_DEGREES
    present = decoded.filter(F.col("v").isNotNull())
    held = present.select(
        ((F.col("tile_lon") + 180) / d * tile_px + F.col("x0")).cast("bigint").alias("x0"), ((90 - d - F.col("tile_lat")) / d * tile_px + F.col("y0")).cast("bigint").alias("y0"), "w", "h", "v")

    def windows(tiles: DataFrame) -> DataFrame:
        low = {"_w": F.floor(F.col("west") / d) * d, "_s": F.floor(F.col("south") / d) * d, "_e": F.ceil(F.col("east") / d) * d, "_n": F.ceil(F.col("north") / d) * d}
        sized = tiles.withColumns(low)
        sized = sized.withColumns({"_mw": round_half_up((F.col("_e") - F.col("_w")) / d * tile_px), "_mh": round_half_up((F.col("_n") - F.col("_s")) / d * tile_px)})
        out = mosaic.landcover_window(sized, "_w", "_s", "_e", "_n", "_mw", "_mh").withColumnsRenamed({"width": "src_w", "height": "src_h"})
        out = out.withColumns({
            "left": F.col("left") + ((F.col("_w") + 180) / d * tile_px).cast("bigint"), "top": F.col("top") + ((90 - F.col("_n")) / d * tile_px).cast("bigint"),
        })
        return out.drop("_w", "_s", "_e", "_n", "_mw", "_mh")

    def covered(tiles: DataFrame) -> DataFrame:
        met = catalogs.landcover_tile_catalog(tiles).join(present.select("tile_lon", "tile_lat"), ["tile_lon", "tile_lat"], "left_semi")
        return met.select(*tiles.columns).distinct()

    return RasterSource(held, [], windows, covered)
