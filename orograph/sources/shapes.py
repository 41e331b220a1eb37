"""Shape overlays: vertex tables to features, stored in pieces of fixed length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import floor_div

# Shape types that become features.
POINT_TYPE, LINE_TYPE, POLYGON_TYPE = 1, 3, 5
SUPPORTED_TYPES = (POINT_TYPE, LINE_TYPE, POLYGON_TYPE)
#: Vertices of one piece of a ring.
PIECE = 1000


def shape_rings_to_features(vertices: DataFrame, keys: list[str], piece: int = PIECE) -> DataFrame:
    """Features as rows (keys, shape_type, part, ring, piece, points): points = array of [x, y].

    ``vertices`` has keys (a shape), shape_type, ring, ord (from 0 within a ring), x, y. Points give
    one feature per vertex, lines one per part with at least two vertices, polygons one with all rings.
    A ring of any size is cut into pieces of ``piece`` vertices, so nothing is gathered whole.
    """
    kind = F.col("shape_type")
    single = kind == POINT_TYPE
    sizes = vertices.groupBy(*keys, "ring").agg(F.count(F.lit(1)).alias("_n"))
    usable = vertices.filter(kind.isin(*SUPPORTED_TYPES)).join(sizes, [*keys, "ring"]).filter((kind != LINE_TYPE) | (F.col("_n") >= 2))
    part = F.when(kind == POLYGON_TYPE, F.lit(0)).when(single, F.col("ord")).otherwise(F.col("ring")).cast("bigint")
    ring = F.when(kind == LINE_TYPE, F.lit(0)).otherwise(F.col("ring")).cast("bigint")
    cut = F.when(single, F.lit(0)).otherwise(floor_div("ord", piece)).cast("bigint")
    pieces = usable.groupBy(*keys, "shape_type", part.alias("part"), ring.alias("ring"), cut.alias("piece"))
    points = pieces.agg(F.array_sort(F.collect_list(F.struct("ord", "x", "y"))).alias("points"))
    return points.withColumn("points", F.transform("points", lambda p: F.array(p["x"], p["y"])))
