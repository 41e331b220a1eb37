"""Footprints and road ribbons in local metres."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import features as ft
from ..functions import geo
from ..functions.numbers import col, double
from ..functions.unroll import unroll_indexed
from .vectors import BOUNDS, min_vertices

DEFAULT_RIBBON_WIDTH = 6.0


def extract_buildings(features: DataFrame, default_height) -> DataFrame:
    """Building rows: footprint, height, floors, min_level, roof_shape (NULL when unknown)."""
    t = {k: ft.tag("tags", k) for k in ("height", "building:levels", "roof:shape", "building:min_level")}
    return features.filter(min_vertices("geometry", "building")).select(
        *[c for c in features.columns if c not in ("geometry", "tags")],
        F.col("geometry").alias("footprint"),
        ft.building_height(t["height"], t["building:levels"], default_height).alias("height"),
        ft.building_floors(t["height"], t["building:levels"], default_height).alias("floors"),
        ft.min_level(t["building:min_level"]).alias("min_level"),
        ft.roof_shape(t["roof:shape"]).alias("roof_shape"),
        "tags",
    )


def extract_roads(features: DataFrame) -> DataFrame:
    """Road rows: centerline, width, surface, highway, bridge (NULL when absent), layer."""
    def t(key):
        return ft.tag("tags", key)

    return features.filter(min_vertices("geometry", "road")).select(
        *[c for c in features.columns if c not in ("geometry", "tags")],
        F.col("geometry").alias("centerline"),
        ft.road_width(t("width"), t("lanes"), t("highway")).alias("width"),
        F.coalesce(t("surface"), F.lit("")).alias("surface"),
        F.coalesce(t("highway"), F.lit("")).alias("highway"),
        t("bridge").alias("bridge"),
        ft.road_layer(t("layer")).alias("layer"),
        "tags",
    )


def local_points(line, width_m="width_m", height_m="height_m") -> Column:
    """Geometry array as local (x, z) points of the tile in the box columns."""
    def one(p):
        x, z = geo.geo_to_local(p["lat"], p["lon"], *BOUNDS, width_m, height_m)
        return F.struct(x.alias("x"), z.alias("z"))

    return F.transform(col(line), one)


def footprint_centroid(points) -> tuple[Column, Column]:
    """Mean of the vertices; a repeated closing vertex counts twice."""
    def mean(axis):
        total = F.aggregate(col(points), F.lit(0.0), lambda acc, p: acc + p[axis])
        return total / F.nullif(F.size(col(points)), F.lit(0))

    return mean("x"), mean("z")


def road_ribbon_edges(roads: DataFrame, points: str = "points", width: str = "width") -> DataFrame:
    """Left and right edge of a road at each vertex.

    The neighbours of a vertex are taken from the same array, so a road stays in its row until
    the vertices are listed and nothing is shuffled.
    """
    p = F.col(points)
    n = F.size(p)
    around = F.transform(p, lambda v, i: F.struct(
        v.alias("here"), F.get(p, F.greatest(i - 1, F.lit(0))).alias("before"), F.get(p, F.least(i + 1, n - 1)).alias("after"),
    ))
    listed = unroll_indexed(roads.filter(n >= 2), around, "pos", "_v").drop(points)
    dx, dz = F.col("_v.after.x") - F.col("_v.before.x"), F.col("_v.after.z") - F.col("_v.before.z")
    size = F.sqrt(dx * dx + dz * dz)
    flat = size < 1e-10
    safe = F.nullif(size, F.lit(0.0))
    half = F.when(F.coalesce(double(width), F.lit(0.0)) == 0, F.lit(DEFAULT_RIBBON_WIDTH)).otherwise(double(width)) / 2.0
    listed = listed.withColumn("_ux", F.when(flat, F.lit(1.0)).otherwise(dx / safe)).withColumn(
        "_uz", F.when(flat, F.lit(0.0)).otherwise(dz / safe)
    )
    return listed.select(
        "*", (F.col("_v.here.x") - F.col("_uz") * half).alias("left_x"), (F.col("_v.here.z") + F.col("_ux") * half).alias("left_z"),
        (F.col("_v.here.x") + F.col("_uz") * half).alias("right_x"), (F.col("_v.here.z") - F.col("_ux") * half).alias("right_z"),
    ).drop("_v", "_ux", "_uz")


def building_footprints_local(buildings: DataFrame, exaggeration: float = 1.5) -> DataFrame:
    """Footprint vertices in world metres with the height of the top face.

    ``buildings`` has the box, width_m, height_m, offset_x, offset_z, elev_min, elev_max columns.
    """
    placed = buildings.filter(F.size("footprint") >= 4).withColumn("_points", local_points("footprint"))
    cx, cz = footprint_centroid("_points")
    placed = placed.withColumn("centroid_x", cx).withColumn("centroid_z", cz)
    placed = placed.withColumn("base_y", ft.building_base_y(
        "centroid_x", "centroid_z", "width_m", "height_m", "elev_min", "elev_max", F.lit(exaggeration), "min_level", "height"
    ))
    listed = unroll_indexed(placed.drop("footprint", "tags", *BOUNDS), F.col("_points"), "pos", "_p").drop("_points")
    return listed.select("*", (F.col("_p.x") + F.col("offset_x")).alias("x"), (F.col("_p.z") + F.col("offset_z")).alias("z")).drop("_p")


def road_ribbons(roads: DataFrame, exaggeration: float = 1.5, offset: float = 0.1) -> DataFrame:
    """Ribbon vertices in world metres with height and colour."""
    lined = roads.withColumn("_points", local_points("centerline")).drop("centerline", "tags")
    edges = road_ribbon_edges(lined, "_points")
    red, green, blue = ft.highway_color("highway")
    y = ft.road_base_y("elev_min", "elev_max", F.lit(exaggeration), F.lit(offset)) + ft.bridge_offset("layer", "bridge")
    moved = {c: F.col(c) + F.col("offset_" + c[-1]) for c in ("left_x", "left_z", "right_x", "right_z")}
    return edges.withColumns(moved).withColumns({"y": y, "red": red, "green": green, "blue": blue}).drop(*BOUNDS)
