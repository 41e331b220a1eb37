"""Raw 16-bit height blobs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import floor_div

#: Rows of one band of a packed tile.
BAND_ROWS = 256
BATCH_PIXELS = 1 << 18


def pack_r16(pixels: DataFrame, keys: list[str], width: int, height: int, value: str = "q", band_rows: int = BAND_ROWS) -> DataFrame:
    """Little-endian, row-major u16 heights of every tile in bands: keys, band, start, n_pixels, content.

    The contents of a tile's bands, in order, are its file; ``start`` is the pixel a band begins with.
    Absent pixels are 0, so every height is at its place. Bands are packed by separate tasks, whatever
    the size of a tile.
    """
    base = pixels.select(*keys, floor_div("y", band_rows).cast("bigint").alias("band"), F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"), F.col(value).cast("int").alias("v"))
    bands = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit((height - 1) // band_rows).cast("bigint")))
    none = F.lit(None).cast("bigint")
    empty = pixels.select(*keys).distinct().select(*keys, bands.alias("band"), none.alias("x"), none.alias("y"), F.lit(None).cast("int").alias("v"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.select(*keys).schema)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        band = int(pdf["band"].iloc[0])
        rows = min(band_rows, height - band * band_rows)
        heights = np.zeros(rows * width, "<u2")
        there = pdf[pdf["x"].notna()]
        heights[((there["y"] - band * band_rows) * width + there["x"]).to_numpy("int64")] = there["v"].to_numpy("int64")
        first = {k: [pdf[k].iloc[0]] for k in keys}
        return pd.DataFrame({**first, "band": [band], "start": [band * band_rows * width], "n_pixels": [len(heights)], "content": [heights.tobytes()]})

    return base.unionByName(empty).groupBy(*keys, "band").applyInPandas(pack, f"{fields}, band bigint, start bigint, n_pixels bigint, content binary")


def unpack_bands(bands: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Pixels (x, y, q) of packed bands; ``width`` is that of the tiles."""
    pixels = unpack_r16(bands.select(*keys, "start", "content"), [*keys, "start"], width=1)
    at = F.col("start") + F.col("y")
    return pixels.select(*keys, F.pmod(at, F.lit(width)).alias("x"), floor_div(at, width).alias("y"), "q")


def unpack_r16(blobs: DataFrame, keys: list[str], content: str = "content", width: int | None = None) -> DataFrame:
    """Pixels (x, y, q) of blobs; without a width, a blob is a square with side round(sqrt(n))."""
    base = blobs.select(*keys, content)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.select(*keys).schema)

    def unpack(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                heights = np.frombuffer(row[-1], dtype="<u2")
                side = width or max(1, int(np.floor(np.sqrt(len(heights)) + 0.5)))
                for start in range(0, len(heights), BATCH_PIXELS):
                    part = heights[start:start + BATCH_PIXELS]
                    at = np.arange(start, start + len(part))
                    out = pd.DataFrame({"x": at % side, "y": at // side, "q": part.astype("int32")})
                    for i, k in enumerate(keys):
                        out[k] = row[i]
                    yield out[[*keys, "x", "y", "q"]]

    return base.mapInPandas(unpack, f"{fields}, x bigint, y bigint, q int")


def read_r16(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.r16").load(path)
    return unpack_r16(files.select("path", "content"), ["path"])


def read_r16_file(spark: SparkSession, path: str, width: int, split_bytes: int = 64 << 20) -> DataFrame:
    """Pixels (x, y, q) of one blob of any size, read by ranges of its bytes: a record is a row of ``width`` heights.

    Other than ``read_r16``, no task holds more than a range, so a blob may be larger than the 2 GB of a cell. A file
    that ends within a row is an error.
    """
    hadoop = "org.apache.hadoop"
    records = spark.sparkContext.newAPIHadoopFile(
        path, f"{hadoop}.mapreduce.lib.input.FixedLengthInputFormat", f"{hadoop}.io.LongWritable", f"{hadoop}.io.BytesWritable",
        conf={"fixedlengthinputformat.record.length": str(2 * width), "mapreduce.input.fileinputformat.split.maxsize": str(split_bytes)},
    )
    rows = records.map(lambda r: (r[0] // 2, bytes(r[1])))
    return unpack_bands(spark.createDataFrame(rows, "start bigint, content binary"), [], width)
