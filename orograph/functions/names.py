"""Names, paths and addresses as text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import col

# File extension and label per height format, extension per image format.
HEIGHT_EXTENSION = {"png": "png", "r16": "r16", "float32": "tif", "geotiff": "tif", "dem": "tif"}
HEIGHT_LABEL = {
    "float32": "Float32 GeoTIFF",
    "geotiff": "UInt16 GeoTIFF (normalized)",
    "dem": "DEM (Int16 GeoTIFF)",
    "r16": "R16 (Raw 16-bit)",
    "png": "PNG (16-bit grayscale)",
}
IMAGE_EXTENSION = {"png": "png", "geotiff": "tif"}


def _choice(value, table: dict[str, str], what: str) -> Column:
    out = F.raise_error(F.concat(F.lit(f"unknown {what}: "), F.coalesce(col(value), F.lit("null"))))
    for key, text in table.items():
        out = F.when(col(value) == key, F.lit(text)).otherwise(out)
    return out


def height_extension(fmt) -> Column:
    return _choice(fmt, HEIGHT_EXTENSION, "height format")


def height_label(fmt) -> Column:
    return _choice(fmt, HEIGHT_LABEL, "height format")


def image_extension(fmt) -> Column:
    return _choice(fmt, IMAGE_EXTENSION, "image format")


def tile_file_name(row, tile_col, kind: str, extension) -> Column:
    stem = F.concat(F.lit("tile_"), col(row).cast("string"), F.lit("_"), col(tile_col).cast("string"))
    return F.concat(stem, F.lit(f"_{kind}."), col(extension))


def tile_file_names(row, tile_col, height_format, image_format) -> dict[str, Column]:
    return {
        "heightmap": tile_file_name(row, tile_col, "heightmap", height_extension(height_format)),
        "albedo": tile_file_name(row, tile_col, "albedo", image_extension(image_format)),
        "format_label": height_label(height_format),
    }


def redact_url(url) -> Column:
    """Hide the values of key parameters, whatever their case."""
    out = col(url)
    for pattern, name in ((r"(?i)API_Key=[^&]+", "API_Key"), (r"(?i)access_token=[^&]+", "access_token"),
                          (r"(?i)\bkey=[^&]+", "key")):
        out = F.regexp_replace(out, pattern, f"{name}=****")
    return out


def hemisphere_name(lat, lon, gap: str = "_00_") -> Column:
    """``N48_00_E002`` (or ``N48W003`` with an empty gap) from whole degrees."""
    ns = F.when(col(lat) >= 0, F.lit("N")).otherwise(F.lit("S"))
    ew = F.when(col(lon) >= 0, F.lit("E")).otherwise(F.lit("W"))
    lat_text, lon_text = (F.abs(col(c)).cast("string") for c in (lat, lon))
    return F.concat(
        ns, F.when(F.length(lat_text) < 2, F.lpad(lat_text, 2, "0")).otherwise(lat_text), F.lit(gap),
        ew, F.when(F.length(lon_text) < 3, F.lpad(lon_text, 3, "0")).otherwise(lon_text),
    )


def path_tile_coords(path) -> tuple[Column, Column]:
    """Row and column from a ``tile_R_C`` folder, else from a ``tile_R_C_`` prefix, else NULL."""
    folder, prefix = r"(?:^|[\\/])tile_(\d+)_(\d+)(?:[\\/]|$)", r"tile_(\d+)_(\d+)_"

    def part(i: int) -> Column:
        hits = [F.nullif(F.regexp_extract(col(path), p, i), F.lit("")) for p in (folder, prefix)]
        return F.coalesce(*hits).try_cast("bigint")

    return part(1), part(2)


def height_format_of(path) -> Column:
    low = F.lower(col(path))
    return (
        F.when(low.endswith(".tif") | low.endswith(".tiff"), F.lit("tif"))
        .when(low.endswith(".r16"), F.lit("r16"))
        .otherwise(F.lit("png"))
    )


def trimmed(text) -> Column:
    """Without white space of any kind at the ends; ``trim`` drops blanks only."""
    return F.regexp_replace(col(text), r"^\s+|\s+$", "")


def search_trigger(query) -> Column:
    return F.length(trimmed(query)) >= 3


def geographic_crs(text) -> Column:
    """A missing description is taken as geographic."""
    t = col(text)
    return t.isNull() | (t == "") | t.contains("WGS_1984") | t.contains("GEOGCS")
