"""Geocoder rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import clamp, col

ROW_SCHEMA = (
    "place_id bigint, display_name string, lat string, lon string, type string, class string, "
    "boundingbox array<string>"
)
# Zoom per place type, default and limits.
PLACE_ZOOM = {"city": 12, "town": 14, "village": 16, "address": 16, "landmark": 16}
DEFAULT_PLACE_ZOOM, MIN_PLACE_ZOOM, MAX_PLACE_ZOOM = 14, 2, 18
MAX_SUGGESTIONS = 5
_FLOAT_PREFIX = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def _leading_float(text):
    return F.regexp_extract(text, _FLOAT_PREFIX, 1).try_cast("double")


def typed_gazetteer(rows: DataFrame) -> DataFrame:
    """Numbers from texts; the bounding box is south, north, west, east."""
    return rows.select(
        *[c for c in rows.columns if c not in ("lat", "lon", "boundingbox")],
        _leading_float(F.col("lat")).alias("latitude"), _leading_float(F.col("lon")).alias("longitude"),
        F.transform("boundingbox", _leading_float).alias("bounding_box"),
    )


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    return typed_gazetteer(spark.read.schema(ROW_SCHEMA).json(path))


def parse_gazetteer(rows: DataFrame, body: str = "body") -> DataFrame:
    """The same from a column that holds one JSON row each."""
    rest = [c for c in rows.columns if c != body]
    return typed_gazetteer(rows.select(*rest, F.from_json(body, ROW_SCHEMA).alias("_r")).select(*rest, "_r.*"))


def place_zoom(kind):
    pairs = [F.lit(x) for item in PLACE_ZOOM.items() for x in item]
    zoom = F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce(col(kind), F.lit(""))), F.lit(DEFAULT_PLACE_ZOOM))
    return clamp(zoom, F.lit(MIN_PLACE_ZOOM), F.lit(MAX_PLACE_ZOOM))


def top_suggestions(results: DataFrame, query_keys: list[str], order: list, limit: int = MAX_SUGGESTIONS) -> DataFrame:
    """First results per query. Spark cuts to the limit before the shuffle as well."""
    w = Window.partitionBy(*query_keys).orderBy(*order)
    return results.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
