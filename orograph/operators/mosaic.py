"""Mosaics and crops of pixel tables.

A pixel belongs to exactly one place of a mosaic and a crop is a shift, so both are narrow
operations; zeros are made only where a tile is missing or a window leaves the mosaic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.numbers import col, double, floor_div, round_half_up
from ..functions.unroll import residual
from ..session import settle, shuffled
from ..sources.catalogs import LANDCOVER_DEGREES, fetch_outcome_fill
from .grids import explode_grid, fill_holes, int_range

# Small against common windows, so that few pixels meet a window they are not in; a window is
# cut into one record per 1024 of its pixels.
WINDOW_BLOCK = 32


def mosaic_tiles(
    pixels: DataFrame, catalog: DataFrame, keys: list[str], tile_w: int, tile_h: int, fill: dict[str, object],
    tile_x: str = "tile_x", tile_y: str = "tile_y", min_x: str = "min_x", min_y: str = "min_y",
) -> DataFrame:
    """Global pixel grid of each mosaic.

    ``catalog`` has one row per tile of a mosaic: keys, tile position and the smallest position
    of the mosaic. ``pixels`` has keys, tile position and local x, y. Positions without a pixel
    give the values of ``fill``.
    """
    full = fetch_outcome_fill(catalog, pixels, [*keys, tile_x, tile_y], tile_w, tile_h, fill, carry=[min_x, min_y])
    return full.select(
        *keys,
        ((F.col(tile_x) - F.col(min_x)) * tile_w + F.col("x")).alias("x"),
        ((F.col(tile_y) - F.col(min_y)) * tile_h + F.col("y")).alias("y"),
        *fill,
    )


def last_written(pixels: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """One value per pixel where tiles overlap: the one written last."""
    return pixels.groupBy(*keys, "x", "y").agg(F.max_by(value, order).alias(value))


def mercator_window(boxes: DataFrame, zoom: str, min_x: str, min_y: str) -> DataFrame:
    """Pixel window of a box inside its mosaic: left, top, width, height.

    A box without any pixel is an error, as nothing could be exported for it.
    """
    west, east = geo.lng_to_pixel_x("west", zoom), geo.lng_to_pixel_x("east", zoom)
    north, south = (side * float(geo.TILE_SIZE) for side in geo.lat_range_y("north", "south", zoom))
    origin_x = geo.lng_to_pixel_x(geo.tile_x_to_lng(min_x, zoom), zoom)
    origin_y = geo.lat_to_pixel_y(geo.tile_y_to_lat(min_y, zoom), zoom)
    out = (
        boxes.withColumn("left", round_half_up(west - origin_x))
        .withColumn("top", round_half_up(north - origin_y))
        .withColumn("width", round_half_up(F.abs(east - west)))
        .withColumn("height", round_half_up(F.abs(south - north)))
    )
    bad = (F.col("width") <= 0) | (F.col("height") <= 0)
    return out.withColumn(
        "width", F.when(bad, F.raise_error(F.lit("the crop window is empty"))).otherwise(F.col("width"))
    )


def crop_windows(
    pixels: DataFrame, windows: DataFrame, mosaic_keys: list[str], out_keys: list[str], block: int = WINDOW_BLOCK,
    carry: list[str] | None = None,
) -> DataFrame:
    """Pixels of ``pixels`` inside each window, shifted to the corner of the window.

    ``windows`` has mosaic_keys, out_keys, left, top, width, height; its columns in ``carry``
    are added to the pixels. Windows are cut into
    blocks, which turns the range condition into an equality on (mosaic, block) and spreads one
    large mosaic over many tasks. Windows pass by the pixels of a block, so the pixels of a window
    follow each other and only a block is held, however many windows meet it.
    """
    right, bottom = F.col("left") + F.col("width") - 1, F.col("top") + F.col("height") - 1
    cut = explode_grid(
        windows.select(*dict.fromkeys([*mosaic_keys, *out_keys, *(carry or [])]), "left", "top", "width", "height"),
        int_range(floor_div("left", block), floor_div(right, block)),
        int_range(floor_div("top", block), floor_div(bottom, block)), "_bx", "_by",
    )
    blocked = pixels.withColumn("_bx", floor_div("x", block)).withColumn("_by", floor_div("y", block))
    joined = cut.join(shuffled(blocked), [*mosaic_keys, "_bx", "_by"])
    inside = (
        (F.col("x") >= F.col("left")) & (F.col("x") <= right) & (F.col("y") >= F.col("top")) & (F.col("y") <= bottom)
    )
    return (
        joined.filter(residual(inside))
        .withColumn("x", F.col("x") - F.col("left"))
        .withColumn("y", F.col("y") - F.col("top"))
        .drop("_bx", "_by", "left", "top", "width", "height")
    )


def outside_pixels(windows: DataFrame, mosaic_w, mosaic_h, out_keys: list[str]) -> DataFrame:
    """Positions of each window that lie outside the mosaic, in window coordinates."""
    w, h = double(mosaic_w).cast("bigint"), double(mosaic_h).cast("bigint")
    left, top, width, height = (F.col(c) for c in ("left", "top", "width", "height"))
    row_out = (F.col("y") + top < 0) | (F.col("y") + top >= h)
    before = int_range(F.lit(0), F.least(width, -left) - 1)
    after = int_range(F.greatest(F.lit(0).cast("bigint"), w - left, ), width - 1)
    every = int_range(F.lit(0), width - 1)
    xs = F.when(row_out, every).otherwise(F.concat(before, after))
    return explode_grid(windows, xs, int_range(F.lit(0), height - 1)).select(*out_keys, "x", "y")


def crop_mercator(
    pixels: DataFrame, windows: DataFrame, mosaic_keys: list[str], out_keys: list[str], fill: dict[str, object],
    mosaic_w="mosaic_w", mosaic_h="mosaic_h",
) -> DataFrame:
    """Crop mosaics to windows; what lies outside the mosaic, or in a hole of it, reads as the fill values."""
    needed = [*mosaic_keys, *out_keys, "left", "top", "width", "height", *[c for c in (mosaic_w, mosaic_h) if isinstance(c, str)]]
    windows = settle(windows.select(*dict.fromkeys(needed)))  # read by four branches
    # pixels carry the size of their window, so they are not joined with the windows again
    sized = windows.withColumns({"_w": F.col("width"), "_h": F.col("height")})
    kept = crop_windows(pixels.select(*mosaic_keys, "x", "y", *fill), sized, mosaic_keys, out_keys, carry=["_w", "_h"])
    blank = outside_pixels(sized, mosaic_w, mosaic_h, [*out_keys, "_w", "_h"])
    blank = blank.select(*out_keys, "x", "y", "_w", "_h", *[F.lit(v).alias(c) for c, v in fill.items()])
    return fill_holes(kept.select(*out_keys, "x", "y", "_w", "_h", *fill).unionByName(blank), windows, out_keys, fill)


def georef_window(boxes: DataFrame, src_w, src_h, origin_lon, origin_lat, pixel_w, pixel_h) -> DataFrame:
    """Pixel window of a box in a north-up raster with an affine georeference."""
    pw, ph, lon0, lat0 = double(pixel_w), double(pixel_h), double(origin_lon), double(origin_lat)
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    first_x = F.greatest(zero, F.floor((F.col("west") - lon0) / pw))
    last_x = F.least(col(src_w) - 1, F.ceil((F.col("east") - lon0) / pw) - 1)
    first_y = F.greatest(zero, F.floor((lat0 - F.col("north")) / ph))
    last_y = F.least(col(src_h) - 1, F.ceil((lat0 - F.col("south")) / ph) - 1)
    return boxes.withColumns({
        "left": first_x, "top": first_y,
        "width": F.greatest(one, last_x - first_x + 1), "height": F.greatest(one, last_y - first_y + 1),
    })


def landcover_window(boxes: DataFrame, west, south, east, north, width, height) -> DataFrame:
    """Pixel window of a box in a raster that covers the given extent, at least one pixel."""
    w, s, e, n = double(west), double(south), double(east), double(north)
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    first_x = F.greatest(zero, F.floor((F.col("west") - w) / (e - w) * col(width)))
    end_x = F.least(col(width).cast("bigint"), F.ceil((F.col("east") - w) / (e - w) * col(width)))
    first_y = F.greatest(zero, F.floor((n - F.col("north")) / (n - s) * col(height)))
    end_y = F.least(col(height).cast("bigint"), F.ceil((n - F.col("south")) / (n - s) * col(height)))
    return boxes.withColumns({
        "left": first_x, "top": first_y,
        "width": F.greatest(one, end_x - first_x), "height": F.greatest(one, end_y - first_y),
    })


def mosaic_extent(tiles: DataFrame, keys: list[str], tile_width_px: int) -> DataFrame:
    """Extent of a set of land-cover tiles and the size of their mosaic in pixels."""
    d = LANDCOVER_DEGREES
    per_degree = tile_width_px / d
    out = tiles.groupBy(*keys).agg(
        F.min("tile_lon").alias("west"), F.min("tile_lat").alias("south"),
        (F.max("tile_lon") + d).alias("east"), (F.max("tile_lat") + d).alias("north"),
    )
    return out.withColumn("mosaic_w", round_half_up((F.col("east") - F.col("west")) * F.lit(per_degree))).withColumn(
        "mosaic_h", round_half_up((F.col("north") - F.col("south")) * F.lit(per_degree))
    )


def reassemble_chunks(
    pixels: DataFrame, chunks: DataFrame, keys: list[str], out_w, out_h, fill: dict[str, object]
) -> DataFrame:
    """Chunk pixels at their place in the output; a chunk without pixels gives the fill values.

    ``chunks`` has keys, chunk_id, out_x, out_y, width, height; ``pixels`` keys, chunk_id, x, y.
    """
    tile_keys = [*keys, "chunk_id"]
    place = chunks.select(*tile_keys, "out_x", "out_y", "width", "height")
    have = pixels.select(*tile_keys).distinct()
    blank = explode_grid(
        place.join(have, tile_keys, "left_anti"), int_range(F.lit(0), F.col("width") - 1),
        int_range(F.lit(0), F.col("height") - 1),
    ).select(*tile_keys, "x", "y", "out_x", "out_y", *[F.lit(v).alias(c) for c, v in fill.items()])
    placed = pixels.join(place, tile_keys).select(*tile_keys, "x", "y", "out_x", "out_y", *fill)
    moved = placed.unionByName(blank).withColumn("x", F.col("x") + F.col("out_x")).withColumn(
        "y", F.col("y") + F.col("out_y")
    )
    return moved.filter((F.col("x") < col(out_w)) & (F.col("y") < col(out_h))).select(*keys, "x", "y", *fill)
