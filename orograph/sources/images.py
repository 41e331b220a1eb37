"""Raster tiles from bytes: a hook for any decoder, and what became of every tile.

A processor takes the bytes of one file and gives its pixels as an array (bands, height, width) or
(height, width). It says with a ``ValueError``, ``EOFError``, ``zlib.error`` or ``struct.error``
that the bytes are broken; such a tile has no pixels but a reason. Any other error is one of the
program and ends the job. Decoders of image formats are the caller's; the ones here read plain
arrays of bytes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.blocks import PLACE, RASTER

Processor = Callable[[bytes], np.ndarray]
DATA_ERRORS = (ValueError, EOFError, zlib.error, struct.error)
MISSING = "no file"


def raw_image(bands: int) -> Processor:
    """Square images of 8-bit values, the bands of a pixel side by side."""

    def read(content: bytes) -> np.ndarray:
        side = int(round((len(content) / bands) ** 0.5))
        if not content or side * side * bands != len(content):
            raise ValueError(f"{len(content)} bytes are no square of {bands} bands")
        return np.frombuffer(content, np.uint8).reshape(side, side, bands).transpose(2, 0, 1)

    return read


def elevation_image(image: Processor, source: str = "aws-terrarium") -> Processor:
    """Heights of images that hold them in red, green and blue, in the form of the elevation source."""

    def read(content: bytes) -> np.ndarray:
        r, g, b = image(content)[:3].astype(np.float64)
        if source == "mapbox-terrain-rgb":
            return -10000.0 + (r * 65536.0 + g * 256.0 + b) * 0.1
        return r * 256.0 + g + b / 256.0 - 32768.0

    return read


def decode_tiles(files: DataFrame, keys: list[str], processor: Processor, content: str = "content") -> DataFrame:
    """One row per tile: keys, the block x0, y0, w, h, v, and ``error``, which is null where v is there.

    Of several files of a tile the longest counts (a cut one is shorter), so tiles never overlap; copies are
    reduced before the shuffle. A tile whose content is null was not fetched. One tile is decoded at a time.
    """
    one = files.groupBy(*keys).agg(F.max_by(content, F.struct(F.length(content), F.xxhash64(content))).alias("_content"))
    fields = ", ".join(f"`{k}` {files.schema[k].dataType.simpleString()}" for k in keys)

    def run(table: pa.Table) -> pa.Table:
        content, values, error = table.column("_content")[0].as_py(), None, MISSING
        if content is not None:
            try:
                values, error = np.asarray(processor(content)), None
                values = values[None] if values.ndim == 2 else values
            except DATA_ERRORS as found:
                error = f"{type(found).__name__}: {found}"
        size = [0, 0] if values is None else [values.shape[2], values.shape[1]]
        flat = pa.array([None if values is None else values.astype(np.float64).ravel()], pa.list_(pa.float64()))
        return pa.table(
            [*[table.column(k).combine_chunks() for k in keys], pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array(size[:1], pa.int32()), pa.array(size[1:], pa.int32()), flat, pa.array([error], pa.string())],
            names=[*keys, *PLACE, "v", "error"],
        )

    return one.groupBy(*keys).applyInArrow(run, f"{fields}, {RASTER}, error string")


def tile_outcomes(catalog: DataFrame, decoded: DataFrame, keys: list[str]) -> DataFrame:
    """Every tile of a catalog with ``success`` and the ``error`` of those that have no pixels."""
    known = decoded.select(*keys, "error", F.lit(True).alias("_known"))
    out = catalog.select(*keys).distinct().join(known, keys, "left")
    reason = F.when(F.col("_known").isNull(), F.lit(MISSING)).otherwise(F.col("error"))
    return out.select(*keys, reason.isNull().alias("success"), reason.alias("error"))
