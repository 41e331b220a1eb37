"""Which tiles a box needs, where they come from and what to do when one is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.names import hemisphere_name
from ..functions.numbers import col
from ..operators.grids import explode_grid, fill_holes, int_range

LANDCOVER_DEGREES = 3

# Elevation and imagery sources.
ELEVATION_SOURCES = [
    ("aws-terrarium", "AWS Terrain Tiles (Terrarium)", "Mapzen / AWS", None, False),
    ("mapzen", "Mapzen Terrain Tiles", "Mapzen", None, False),
    ("mapbox-terrain-rgb", "Mapbox Terrain RGB", "Mapbox", None, True),
    ("opentopo-srtmgl1", "SRTM GL1 (30m)", "NASA / OpenTopography", "SRTMGL1", True),
    ("opentopo-srtmgl3", "SRTM GL3 (90m)", "NASA / OpenTopography", "SRTMGL3", True),
    ("opentopo-aw3d30", "ALOS World 3D (30m)", "JAXA / OpenTopography", "AW3D30", True),
    ("opentopo-cop30", "Copernicus GLO-30", "ESA / OpenTopography", "COP30", True),
    ("opentopo-nasadem", "NASADEM (30m)", "NASA / OpenTopography", "NASADEM", True),
    ("opentopo-usgs10m", "USGS 3DEP (10m)", "USGS / OpenTopography", "USGS10m", True),
    ("nasa-earthdata", "Copernicus GLO-30 (30m) via AWS", "ESA / Copernicus", None, False),
]
IMAGERY_SOURCES = [
    ("arcgis", "ArcGIS World Imagery", "Esri", None, False),
    ("mapbox", "Mapbox Satellite", "Mapbox", None, True),
    ("maptiler", "MapTiler Satellite", "MapTiler", None, True),
]
# Request addresses of the tile services.
TERRARIUM_URL = "https://s3.amazonaws.com/elevation-tiles-prod/terrarium/%d/%d/%d.png"
TERRAIN_RGB_URL = "https://api.mapbox.com/v4/mapbox.terrain-rgb/%d/%d/%d@2x.pngraw?access_token="
MAPBOX_IMAGE_URL = "https://api.mapbox.com/v4/mapbox.satellite/%d/%d/%d@2x.png?access_token="
MAPTILER_URL = "https://api.maptiler.com/tiles/satellite/%d/%d/%d.jpg?key="
ARCGIS_URL = "https://server.arcgisonline.com/ArcGIS/rest/services/World_Imagery/MapServer/tile/%d/%d/%d"
BOX_URL = "https://portal.opentopography.org/API/globaldem?demtype="
DEGREE_TILE_URL = "https://copernicus-dem-30m.s3.eu-central-1.amazonaws.com/"
LANDCOVER_URL = "https://esa-worldcover.s3.eu-central-1.amazonaws.com/v200/2021/map/"
REGISTRY_SCHEMA = "source_id string, kind string, name string, attribution string, dataset string, needs_key boolean"


def tile_range(zoom) -> dict[str, Column]:
    """Inclusive slippy tile range of the box columns; y grows to the south."""
    top, bottom = geo.lat_range_y("north", "south", zoom)
    pole = geo.lat_to_tile_y("south", zoom).isNull()
    return {
        "min_x": geo.lng_to_tile_x("west", zoom),
        "max_x": geo.lng_to_tile_x("east", zoom),
        "min_y": F.floor(top),
        "max_y": F.when(pole, F.floor(bottom) - 1).otherwise(F.floor(bottom)),
    }


def tile_catalog(boxes: DataFrame, zoom) -> DataFrame:
    """One row per slippy tile of each box: z, tile_x, tile_y and the range they lie in."""
    ranged = boxes.withColumn("z", col(zoom).cast("int")).withColumns(tile_range("z"))
    return explode_grid(ranged, int_range("min_x", "max_x"), int_range("min_y", "max_y"), "tile_x", "tile_y")


def degree_tile_catalog(boxes: DataFrame) -> DataFrame:
    grid = explode_grid(
        boxes, int_range(F.floor("west"), F.floor("east")), int_range(F.floor("south"), F.floor("north")),
        "tile_lon", "tile_lat",
    )
    return grid.withColumn("tile_name", hemisphere_name("tile_lat", "tile_lon"))


def landcover_tile_catalog(boxes: DataFrame) -> DataFrame:
    """Tiles of the 3-degree land-cover grid; the snapped upper ends are exclusive."""
    d = LANDCOVER_DEGREES

    def steps(low, high):
        return int_range(F.floor(F.col(low) / d) * d, F.ceil(F.col(high) / d) * d - d, d)

    grid = explode_grid(boxes, steps("west", "east"), steps("south", "north"), "tile_lon", "tile_lat")
    return grid.withColumn("tile_name", hemisphere_name("tile_lat", "tile_lon", ""))


def source_registry(spark: SparkSession) -> DataFrame:
    rows = [(i, "elevation", *rest) for i, *rest in ELEVATION_SOURCES]
    rows += [(i, "imagery", *rest) for i, *rest in IMAGERY_SOURCES]
    return spark.createDataFrame(rows, REGISTRY_SCHEMA)


def source_info(source_id: str) -> tuple[str, str]:
    """Name and attribution of one source."""
    for known, name, attribution, *_ in ELEVATION_SOURCES + IMAGERY_SOURCES:
        if known == source_id:
            return name, attribution
    raise ValueError(f"unknown source: {source_id}")


def describe_sources(df: DataFrame, source_col: str, kind: str) -> DataFrame:
    """Add name, attribution, dataset and key need of a source; an unknown id gives an error.

    The registry has thirteen rows, so broadcasting it is bounded whatever the data.
    """
    registry = source_registry(df.sparkSession).filter(F.col("kind") == kind).drop("kind")
    out = df.join(F.broadcast(registry), F.col(source_col) == F.col("source_id"), "left")
    return out.withColumn(
        "source_error", F.when(F.col("source_id").isNull(), F.concat(F.lit("unknown source: "), F.col(source_col)))
    ).drop("source_id")


def _xyz(template: str, first="tile_x", second="tile_y") -> Column:
    return F.format_string(template, "z", first, second)


def tile_url(source_col: str, kind: str, key_col: str) -> Column:
    """Address of tile (z, tile_x, tile_y); NULL for sources that are not served as tiles."""
    source, key = F.col(source_col), F.url_encode(F.col(key_col))
    if kind == "elevation":
        return F.when(source.isin("aws-terrarium", "mapzen"), _xyz(TERRARIUM_URL)).when(
            source == "mapbox-terrain-rgb", F.concat(_xyz(TERRAIN_RGB_URL), key)
        )
    return (
        F.when(source == "arcgis", _xyz(ARCGIS_URL, "tile_y", "tile_x"))
        .when(source == "mapbox", F.concat(_xyz(MAPBOX_IMAGE_URL), key))
        .when(source == "maptiler", F.concat(_xyz(MAPTILER_URL), key))
    )


def box_url(dataset, key_col: str) -> Column:
    """Address of one request for a whole box."""
    parts = [F.lit(BOX_URL), col(dataset)]
    for side in ("south", "north", "west", "east"):
        parts += [F.lit(f"&{side}="), F.col(side).cast("string")]
    return F.concat(*parts, F.lit("&outputFormat=GTiff&API_Key="), F.url_encode(F.col(key_col)))


def degree_tile_url(name) -> Column:
    stem = F.concat(F.lit("Copernicus_DSM_COG_10_"), col(name), F.lit("_00_DEM"))
    return F.concat(F.lit(DEGREE_TILE_URL), stem, F.lit("/"), stem, F.lit(".tif"))


def landcover_tile_url(name) -> Column:
    return F.concat(F.lit(LANDCOVER_URL), F.lit("ESA_WorldCover_10m_2021_v200_"), col(name), F.lit("_Map.tif"))


def tile_request_manifest(catalog: DataFrame, source_col: str, kind: str, key_col: str) -> DataFrame:
    """Request table of a tile catalog. Nothing is fetched here."""
    return catalog.withColumn("url", tile_url(source_col, kind, key_col))


def fetch_outcome_fill(
    catalog: DataFrame, fetched: DataFrame, keys: list[str], width: int, height: int, fill: dict[str, object],
    carry: list[str] | None = None,
) -> DataFrame:
    """Pixels of every catalog tile: fetched ones as they are, all other positions filled.

    ``fetched`` has keys, x, y and the value columns named in ``fill``. Tiles are told to be complete
    by their number of pixels; only incomplete ones are compared by position.
    """
    every = [*keys, *(carry or [])]
    wanted = catalog.select(*every).distinct()
    kept = fetched.select(*keys, "x", "y", *fill).join(wanted, keys).withColumn("fetched", F.lit(True))
    sizes = wanted.withColumns({"width": F.lit(width), "height": F.lit(height)})
    return fill_holes(kept, sizes, every, {**fill, "fetched": False})


def fetch_counts(outcomes: DataFrame, keys: list[str], success: str = "success") -> DataFrame:
    return outcomes.groupBy(*keys).agg(
        F.count_if(F.col(success)).alias("n_success"), F.count_if(~F.col(success)).alias("n_failed")
    )
