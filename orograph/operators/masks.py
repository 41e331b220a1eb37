"""Terrain masks: planning, painting, vegetation and subtraction.

A mask is a sparse pixel table (keys, kind, x, y, v) that stores v > 0 only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.heights import vegetation_intensity
from ..functions.numbers import clamp, double
from ..functions.unroll import unroll
from ..session import settle, shuffled
from .mosaic import crop_windows
from .resample import resample_lanczos, resample_nearest
from .surface import cliff_mask
from .vectors import fill_spans, line_spans, merge_spans, paint, polygon_spans, tag_filter, union_regions

# Kind, settings flag, where the data come from, how features are drawn.
MASK_KINDS = [
    ("road", "road_on", "features", "line"),
    ("water", "water_on", "features", "polygon"),
    ("vegetation", "vegetation_on", "landcover", "raster"),
    ("building", "building_on", "features", "polygon"),
    ("cliff", "cliff_on", "elevation", "raster"),
]
DEFAULT_ROAD_PX = 3
VEGETATED = 128


def mask_task_plan(settings: DataFrame) -> DataFrame:
    """One row per enabled mask of each settings row (tile_prefix, flags, road_px)."""
    rows = [
        F.struct(
            F.lit(kind).alias("kind"), F.col(flag).alias("enabled"), F.lit(source).alias("data_source"),
            F.lit(shape).alias("geometry_kind"),
            F.concat(F.col("tile_prefix"), F.lit(f"_{kind}_mask.tif")).alias("file_name"),
            (F.coalesce(F.col("road_px"), F.lit(DEFAULT_ROAD_PX)) if kind == "road" else F.lit(None).cast("int")).alias("line_px"),
        )
        for kind, flag, source, shape in MASK_KINDS
    ]
    flags = [flag for _, flag, _, _ in MASK_KINDS]
    out = settings.select("*", F.inline(F.array(*rows))).filter("enabled")
    return out.drop("enabled", "road_px", *flags)


def settings_check(settings: DataFrame) -> DataFrame:
    """Range checks of mask settings and clamped extraction settings."""
    return (
        settings.withColumn("cliff_ok", ~F.col("cliff_on") | F.col("cliff_threshold").between(0, 90))
        .withColumn("road_ok", ~F.col("road_on") | F.col("road_px").between(1, 10))
        .withColumn("building_height", clamp(F.floor(double("building_height") + 0.5), F.lit(3).cast("bigint"), F.lit(100).cast("bigint")))
        .withColumn("road_offset", clamp(double("road_offset"), F.lit(0.0), F.lit(1.0)))
    )


def feature_mask(
    features: DataFrame, kind: str, keys: list[str], feature_keys: list[str], width: int, height: int,
    road_px=DEFAULT_ROAD_PX, waterway_as: str = "polygon",
) -> DataFrame:
    """Mask of one feature kind. Waterway lines are filled as polygons unless asked otherwise."""
    part = features.filter(tag_filter({"road": "roads", "building": "buildings"}.get(kind, kind)))
    if kind == "road":
        spans = line_spans(part, keys, width, height, road_px)
    elif kind == "water" and waterway_as == "line":
        is_line = F.try_element_at(F.col("tags"), F.lit("waterway")).isNotNull()
        spans = polygon_spans(part.filter(~is_line), keys, feature_keys, width, height).unionByName(
            line_spans(part.filter(is_line), keys, width, height, DEFAULT_ROAD_PX)
        )
    else:
        spans = polygon_spans(part, keys, feature_keys, width, height)
    return paint(spans, keys)


def vegetation_mask(
    landcover: DataFrame, windows: DataFrame, mosaic_keys: list[str], out_keys: list[str], width: int, height: int
) -> DataFrame:
    """Land-cover classes to intensity, cut to each window and resized with Lanczos (a = 2).

    The class map is applied once, before the resize. Values are rounded to 0..255.
    """
    graded = landcover.select(*mosaic_keys, "x", "y", vegetation_intensity("cls").cast("double").alias("v"))
    sized = windows.withColumn("_cw", F.col("width")).withColumn("_ch", F.col("height"))
    cut = crop_windows(graded, sized, mosaic_keys, out_keys, carry=["_cw", "_ch"])
    out = resample_lanczos(cut, out_keys, "_cw", "_ch", width, height, 2, "v")
    return out.withColumn("raw", F.col("v")).withColumn(
        "v", F.floor(clamp("v", F.lit(0.0), F.lit(255.0)) + 0.5).cast("int")
    )


def vegetation_with_fallback(satellite: DataFrame, polygons: DataFrame, covered: DataFrame, keys: list[str]) -> DataFrame:
    """Satellite pixels where a tile has any satellite data, painted polygons elsewhere.

    ``covered`` lists the tiles with satellite data. Only tile lists are compared.
    """
    rest = polygons.join(covered.select(*keys).distinct(), keys, "left_anti")
    return satellite.select(*keys, "x", "y", "v").withColumn("origin", F.lit("satellite")).unionByName(
        rest.select(*keys, "x", "y", "v").withColumn("origin", F.lit("features"))
    )


def match_size(mask: DataFrame, keys: list[str], src: tuple[int, int], dst: tuple[int, int]) -> DataFrame:
    return mask if src == dst else resample_nearest(mask, keys, *src, *dst, ("v",))


def subtract_masks(
    vegetation: DataFrame, water: DataFrame, road: DataFrame, keys: list[str], water_tiles: DataFrame,
    road_tiles: DataFrame,
) -> DataFrame:
    """Vegetation cleared where water or road is painted.

    Only tiles that have a water mask (``water_tiles``) are touched, and roads count only where
    a road mask exists as well. All masks have the size of the vegetation mask.
    """
    gate = water_tiles.select(*keys).distinct()
    roads = road.join(road_tiles.select(*keys).distinct(), keys, "left_semi")
    blocked = union_regions([m.filter("v > 0").select(*keys, "x", "y") for m in (water, roads)])
    blocked = blocked.join(gate, keys, "left_semi")
    return vegetation.join(shuffled(blocked), [*keys, "x", "y"], "left_anti")


def mask_clear_counts(
    sizes: DataFrame, water: DataFrame, road: DataFrame, keys: list[str], water_tiles: DataFrame
) -> DataFrame:
    """Pixels under water and under roads per tile that has a water mask.

    The counts do not depend on what grows there, and a road pixel counts although water
    cleared it before.
    """
    flags = union_regions([
        water.filter("v > 0").select(*keys, F.lit(1).alias("_w"), F.lit(0).alias("_r")),
        road.filter("v > 0").select(*keys, F.lit(0).alias("_w"), F.lit(1).alias("_r")),
    ])
    counted = flags.groupBy(*keys).agg(F.sum("_w").alias("water_cleared"), F.sum("_r").alias("road_cleared"))
    tiles = sizes.select(*keys).distinct().join(water_tiles.select(*keys).distinct(), keys, "left_semi")
    return tiles.join(counted, keys, "left").fillna(0, ["water_cleared", "road_cleared"])


def plan_with_errors(plan: DataFrame, cliff_threshold: float | str = 45.0) -> DataFrame:
    """A plan (keys, kind, line_px) with ``reason``: why a mask cannot be made, null where it can.

    ``cliff_threshold`` is a number or a column of the plan.
    """
    threshold = double(F.col(cliff_threshold) if isinstance(cliff_threshold, str) else F.lit(cliff_threshold))
    bad_threshold = threshold.isNull() | F.isnan(threshold) | (threshold < 0) | (threshold > 90)
    px = F.col("line_px").cast("string")
    return plan.withColumn("reason", (
        F.when(F.col("kind").isNull() | ~F.col("kind").isin(*[k for k, *_ in MASK_KINDS]), F.concat(F.lit("unknown kind: "), F.coalesce("kind", F.lit("none"))))
        .when((F.col("kind") == "road") & ~F.coalesce(F.col("line_px") > 0, F.lit(False)), F.concat(F.lit("line width: "), F.coalesce(px, F.lit("none"))))
        .when((F.col("kind") == "cliff") & bad_threshold, F.concat(F.lit("cliff threshold: "), F.coalesce(threshold.cast("string"), F.lit("none"))))
    ))


def usable_features(features: DataFrame, geometry: str = "geometry") -> DataFrame:
    """The features whose points all have finite coordinates; the others would leave holes in what is painted with them."""
    def finite(v) -> Column:
        return F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False))

    return features.filter(F.coalesce(F.forall(geometry, lambda p: F.coalesce(finite(p["lat"]) & finite(p["lon"]), F.lit(False))), F.lit(False)))


def mask_outcomes(plan: DataFrame, painted: DataFrame, features: DataFrame, keys: list[str]) -> DataFrame:
    """One row per mask of a plan (with ``reason``): status painted, empty or failed, its pixels, and features left out.

    ``painted`` are the masks made of the plan's rows without a reason; a mask that fails leaves the others as they are.
    ``features`` are all of the tiles; the unusable ones are counted for the kinds that draw them.
    """
    pixels = painted.groupBy(*keys, "kind").agg(F.count(F.lit(1)).alias("n_px"))
    usable = shuffled(usable_features(features).select(*keys, "type", "id").withColumn("_ok", F.lit(True)).distinct())
    marked = features.join(usable, [*keys, "type", "id"], "left").filter("_ok IS NULL")
    tags = {"road": "roads", "water": "water", "vegetation": "vegetation", "building": "buildings"}
    of = F.filter(F.array(*[F.when(tag_filter(t), F.lit(k)) for k, t in tags.items()]), lambda k: k.isNotNull())
    skipped = unroll(marked, of, "kind").groupBy(*keys, "kind").agg(F.count(F.lit(1)).alias("n_skipped"))
    out = plan.select(*keys, "kind", "reason").join(pixels, [*keys, "kind"], "left").join(skipped, [*keys, "kind"], "left").fillna(0, ["n_px", "n_skipped"])
    status = F.when(F.col("reason").isNotNull(), F.lit("failed")).when(F.col("n_px") > 0, F.lit("painted")).otherwise(F.lit("empty"))
    return out.select(*keys, "kind", status.alias("status"), "reason", "n_px", "n_skipped")


def combine_masks(
    plan: DataFrame, features: DataFrame, cliffs: DataFrame, vegetation: DataFrame, keys: list[str], feature_keys: list[str],
    resolution: int, waterway_as: str = "polygon", drawn_vegetation: DataFrame | None = None,
    keep: Callable[[DataFrame], DataFrame] = lambda spans: spans,
) -> DataFrame:
    """All enabled masks of a plan (keys, kind, line_px), water and roads taken off vegetation.

    ``features`` has keys and the box columns; ``cliffs`` and ``vegetation`` are finished masks (keys, x, y, v).
    In the tiles of ``drawn_vegetation`` vegetation is drawn from features. A kind without features has no pixels.
    Drawn masks are needed twice, as a result and to clear vegetation; ``keep`` may store their merged spans of
    all kinds, one table with much fewer rows than pixels, in between.
    """
    names, by_kind = [*keys, "kind", "x", "y", "v"], [*keys, "kind"]
    kinds = {"water": tag_filter("water"), "building": tag_filter("buildings"), "vegetation": tag_filter("vegetation")}
    wanted = plan.select(*by_kind).distinct()
    filling = wanted.filter("kind IN ('water', 'building')")
    if drawn_vegetation is not None:
        filling = filling.unionByName(wanted.filter("kind = 'vegetation'").join(drawn_vegetation.select(*keys).distinct(), keys, "left_semi"))
    listed = F.filter(F.array(*[F.when(cond, F.lit(k)) for k, cond in kinds.items()]), lambda k: k.isNotNull())
    filled = unroll(features, listed, "kind").join(filling, by_kind, "left_semi")
    is_line = (F.col("kind") == "water") & F.try_element_at(F.col("tags"), F.lit("waterway")).isNotNull()
    px = plan.filter("kind = 'road'").groupBy(*keys).agg(F.max("line_px").alias("_px"))
    drawn = [
        polygon_spans(filled.filter(~is_line) if waterway_as == "line" else filled, by_kind, feature_keys, resolution, resolution),
        line_spans(features.filter(tag_filter("roads")).join(px, keys).withColumn("kind", F.lit("road")), by_kind, resolution, resolution, "_px"),
    ]
    if waterway_as == "line":
        drawn.append(line_spans(filled.filter(is_line), by_kind, resolution, resolution, DEFAULT_ROAD_PX))
    spans = keep(merge_spans(union_regions(drawn), by_kind))

    def painted(kind):
        return fill_spans(spans.filter(F.col("kind") == kind), by_kind)

    def tiles(kind):
        return plan.filter(F.col("kind") == kind).select(*keys).distinct()

    grown = vegetation.filter("v > 0").join(tiles("vegetation"), keys, "left_semi").select(*keys, "x", "y", "v")
    if drawn_vegetation is not None:
        grown = grown.unionByName(painted("vegetation").select(*keys, "x", "y", "v"))
    plants = subtract_masks(grown, painted("water"), painted("road"), keys, tiles("water"), tiles("road"))
    others = fill_spans(spans.filter("kind <> 'vegetation'"), by_kind)
    parts = [("cliff", cliffs.join(tiles("cliff"), keys, "left_semi")), ("vegetation", plants)]
    return union_regions([others.select(*names), *[d.withColumn("kind", F.lit(k)).select(*names) for k, d in parts]])


def generate_masks(
    plan: DataFrame, features: DataFrame, elevation: DataFrame, vegetation: DataFrame, keys: list[str],
    feature_keys: list[str], resolution: int, elevation_size: tuple[int, int], cliff_threshold: float = 45.0, waterway_as: str = "polygon",
) -> DataFrame:
    """``combine_masks`` with cliffs from elevation pixels; the merged spans are settled in the shared folder."""
    wanted = plan.filter("kind = 'cliff'").select(*keys).distinct()
    cliffs = cliff_mask(
        elevation.join(wanted, keys, "left_semi"), keys, *elevation_size, cliff_threshold, resolution, sparse=True
    )
    return combine_masks(plan, features, cliffs, vegetation, keys, feature_keys, resolution, waterway_as, keep=settle)
