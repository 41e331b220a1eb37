"""Small lookup tables with defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Export presets; the last one is the default.
PRESETS = [
    ("unigine", "png", "png", 4096, 4096),
    ("unreal", "r16", "png", 2017, 2048),
    ("blender", "float32", "png", 2048, 2048),
    ("generic", "float32", "geotiff", 4096, 4096),
    ("babylon", "png", "png", 1024, 1024),
]
PRESET_FIELDS = ("height_format", "image_format", "height_size", "image_size")


def preset_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        PRESETS, "preset string, height_format string, image_format string, height_size int, image_size int"
    )


def with_preset(df: DataFrame, key: str) -> DataFrame:
    """Formats and sizes of a preset; unknown presets take the default. The table has five rows."""
    table = preset_table(df.sparkSession).withColumnRenamed("preset", "_preset")
    out = df.join(F.broadcast(table), F.col(key) == F.col("_preset"), "left")
    return out.withColumns(
        {f: F.coalesce(F.col(f), F.lit(v)) for f, v in zip(PRESET_FIELDS, PRESETS[-1][1:])}
    ).drop("_preset")
