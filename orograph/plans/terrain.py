"""From boxes to terrain packages: every artefact of an export as one table."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo, names
from ..functions.heights import vegetation_intensity
from ..functions.numbers import clamp
from ..operators import blocks, checks, grids, masks, packages, placement, surface, vectors
from ..sources import catalogs, manifests
from .rasters import SIDES, Georeference, RasterSource, area_raster
from .stages import StageStore

ALBEDO_BANDS = ("r", "g", "b")


@dataclass(frozen=True)
class PackageSettings:
    """Sizes and switches of an export; the fixed values are the defaults of the format."""

    tile_km: float = 4.0
    resolution: int = 1024
    albedo_resolution: int | None = None
    height_format: str = "png"
    image_format: str = "png"
    dem_source: str = "aws-terrarium"
    imagery_source: str = "arcgis"
    preset: str = "generic"
    cliff_threshold: float = 45.0
    road_px: int = 3
    waterway_as: str = "polygon"
    building_height: float = 10.0
    created_by: str = "orograph"
    switches: dict[str, bool] = field(default_factory=lambda: {k: True for k, *_ in masks.MASK_KINDS})

    @property
    def albedo_size(self) -> int:
        return self.albedo_resolution or self.resolution


class TerrainPackage:
    """The tables of an export, each declared when it is asked for; declaring one starts no job.

    ``areas`` has the key and a box; ``elevation``, ``landcover`` and ``imagery`` say where their pixels come from and what
    window of them a tile reads (``rasters``), each with its own geometry and pixel size; ``features`` has type, id, geometry
    and tags. All tiles of all areas are processed together. Without land cover for a tile, its vegetation is drawn from the
    features. With a ``store`` the steps that several tables read (heights, albedo, features of tiles, drawn spans) are written once
    when they are first asked for, and read from there; without one Spark computes them within each result.
    """

    def __init__(
        self, areas: DataFrame, area_key: str, elevation: RasterSource, landcover: RasterSource | None, features: DataFrame,
        settings: PackageSettings = PackageSettings(), imagery: RasterSource | None = None, store: StageStore | None = None,
    ):
        self.area_key, self.keys, self.settings = area_key, [area_key, "row", "col"], settings
        self._areas, self._features, self._store = areas, features, store
        self._elevation, self._landcover, self._imagery = elevation, landcover, imagery

    @classmethod
    def from_rasters(
        cls, areas: DataFrame, area_key: str, elevation: DataFrame, landcover: DataFrame, features: DataFrame, georef: Georeference | DataFrame,
        settings: PackageSettings = PackageSettings(), store: StageStore | None = None, landcover_georef: Georeference | DataFrame | None = None,
    ) -> "TerrainPackage":
        """A package of finished rasters: ``elevation`` (key, x, y, z) and ``landcover`` (key, x, y, cls)."""
        cover = area_raster(landcover, area_key, landcover_georef if landcover_georef is not None else georef, ("cls",))
        return cls(areas, area_key, area_raster(elevation, area_key, georef), cover, features, settings, store=store)

    def _kept(self, name: str, df: DataFrame) -> DataFrame:
        return self._store.keep(name, df) if self._store else df

    @cached_property
    def tiles(self) -> DataFrame:
        usable = checks.validate_bounds(self._areas).filter("valid").select(self.area_key, *SIDES)
        corners = usable.withColumns({"area_north": F.col("north"), "area_west": F.col("west")})
        return self._kept("tiles", grids.tile_grid(corners, F.lit(self.settings.tile_km)))

    @cached_property
    def height_blocks(self) -> DataFrame:
        """Elevation of every tile, cut from the source and resized in one step; what is missing reads as 0."""
        size, source = self.settings.resolution, self._elevation
        frames = source.frames(self.tiles, size, size)
        found = blocks.resampled(source.blocks, frames, source.keys, self.keys, "bilinear", fill=0.0)
        if source.fill is None:  # windows of areas without a georeference are unknown
            blank = blocks.blank(self.tiles.select(*self.keys).join(frames.select(*self.keys), self.keys, "left_anti"), self.keys, size, size)
            found = found.unionByName(blank)
        return self._kept("heights", found)

    @cached_property
    def heights(self) -> DataFrame:
        return blocks.pixels_of(self.height_blocks, self.keys)

    @cached_property
    def stats(self) -> DataFrame:
        return blocks.stats(self.height_blocks, self.keys)

    @cached_property
    def quantized(self) -> DataFrame:
        """Blocks with ``q``, 16-bit heights."""
        return blocks.quantized(self.height_blocks, self.keys, self.stats)

    @cached_property
    def albedo(self) -> DataFrame | None:
        """Blocks of red, green and blue, 0 to 255, of every tile; None without imagery."""
        if self._imagery is None:
            return None
        size, source = self.settings.albedo_size, self._imagery
        found = blocks.resampled(source.blocks, source.frames(self.tiles, size, size), source.keys, self.keys, "imagery", len(ALBEDO_BANDS), 0.0)
        rounded = F.transform("v", lambda v: F.floor(clamp(v, F.lit(0.0), F.lit(255.0)) + 0.5).cast("double"))
        return self._kept("albedo", found.withColumn("v", rounded))

    @cached_property
    def features(self) -> DataFrame:
        return self._kept("features", vectors.features_to_regions(self._features, self.tiles.select(*self.keys, *SIDES), self.keys))

    @cached_property
    def cliffs(self) -> DataFrame:
        """Cliff pixels, from the slopes of the elevation before any resize."""
        size, source = self.settings.resolution, self._elevation
        found = blocks.cliffs(source.blocks, source.frames(self.tiles, size, size), source.keys, self.keys, self.settings.cliff_threshold, source.fill)
        return blocks.pixels_of(found, self.keys, ("v",)).filter("v > 0").withColumn("v", F.col("v").cast("int"))

    @cached_property
    def covered(self) -> DataFrame:
        """Keys of the tiles that have land cover; the others have their vegetation drawn from features."""
        tiles = self.tiles.select(*self.keys, *SIDES)
        return (tiles.limit(0) if self._landcover is None else self._landcover.covered(tiles)).select(*self.keys)

    @cached_property
    def vegetation(self) -> DataFrame | None:
        """Vegetation pixels from land cover, of the covered tiles."""
        size, source = self.settings.resolution, self._landcover
        if source is None:
            return self.tiles.select(*self.keys, F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("v")).limit(0)
        graded = source.blocks.withColumn("v", F.transform("v", lambda c: vegetation_intensity(c).cast("double")))
        found = blocks.resampled(graded, source.frames(self.tiles, size, size), source.keys, self.keys, "lanczos2", fill=source.fill)
        level = F.floor(clamp("v", F.lit(0.0), F.lit(255.0)) + 0.5).cast("int")
        return blocks.pixels_of(found, self.keys, ("v",)).withColumn("v", level).filter("v > 0")

    @cached_property
    def mask_plan(self) -> DataFrame:
        """The masks of all tiles that are switched on, with the reason of those that cannot be made."""
        on = [k for k, yes in self.settings.switches.items() if yes]
        plan = self.tiles.select(*self.keys, F.explode(F.array(*[F.lit(k) for k in on])).alias("kind"))
        return masks.plan_with_errors(plan.withColumn("line_px", F.lit(self.settings.road_px).cast("int")), self.settings.cliff_threshold)

    @cached_property
    def mask_outcomes(self) -> DataFrame:
        """What became of every mask: painted, empty or failed with its reason."""
        return masks.mask_outcomes(self.mask_plan, self.masks, self.features, self.keys)

    @cached_property
    def masks(self) -> DataFrame:
        """Pixels of all masks; vegetation from land cover where a tile has any, else drawn from features."""
        size, plan = self.settings.resolution, self.mask_plan.filter("reason IS NULL").drop("reason")
        bare = self.tiles.select(*self.keys).join(self.covered, self.keys, "left_anti")
        return masks.combine_masks(
            plan, masks.usable_features(self.features), self.cliffs, self.vegetation, self.keys, ["type", "id"], size, self.settings.waterway_as, bare, lambda spans: self._kept("spans", spans)
        )

    @cached_property
    def buildings(self) -> DataFrame:
        found = self.features.filter(vectors.tag_filter("buildings"))
        return placement.extract_buildings(found, F.lit(self.settings.building_height))

    @cached_property
    def roads(self) -> DataFrame:
        return placement.extract_roads(self.features.filter(vectors.tag_filter("roads")))


def package_report(package: TerrainPackage, area_key: str, settings: PackageSettings) -> DataFrame:
    """One row per tile: size on the ground, elevation, painted pixels per mask, features, file names."""
    keys = [area_key, "row", "col"]
    ground = geo.tile_size_meters(*SIDES)
    files = names.tile_file_names("row", "col", F.lit(settings.height_format), F.lit(settings.image_format))
    base = package.tiles.select(*keys, *SIDES, *[c.alias(n) for n, c in ground.items()], *[c.alias(n) for n, c in files.items()])
    kinds = [k for k, *_ in masks.MASK_KINDS]
    painted = package.masks.groupBy(*keys).agg(
        *[F.count_if((F.col("kind") == k) & (F.col("v") >= masks.VEGETATED)).alias(f"{k}_px") for k in kinds]
    )
    total = F.aggregate("q", F.lit(0).cast("bigint"), lambda a, q: a + q)
    levels = package.quantized.groupBy(*keys).agg(F.sum(F.size("q")).alias("n_pixels"), F.sum(total).alias("level_sum"))
    out = base.join(package.stats, keys, "left").join(levels, keys, "left").join(painted, keys, "left")
    if package.albedo is not None:
        size = (F.col("w") * F.col("h")).cast("int")
        bands = {f"{name}_sum": F.aggregate(F.slice("v", k * size + 1, size), F.lit(0.0), lambda a, v: a + v).cast("bigint") for k, name in enumerate(ALBEDO_BANDS)}
        out = out.join(package.albedo.groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in bands.items()]), keys, "left")
    found = package.features.groupBy(*keys).agg(*[
        F.count_if(vectors.tag_filter(kind) & vectors.min_vertices("geometry", use)).alias(name)
        for name, kind, use in (("n_buildings", "buildings", "building"), ("n_roads", "roads", "road"))
    ])
    out = out.join(found, keys, "left")
    counts = [f"{k}_px" for k in kinds] + ["n_buildings", "n_roads", "n_pixels", "level_sum"]
    return out.fillna(0, counts)


MASK_ENTRIES = {"road": "roadMask", "water": "waterMask", "vegetation": "vegetationMask", "building": "buildingMask", "cliff": "cliffMask"}
NAMED = ("heightmap", "albedo", *MASK_ENTRIES.values(), "buildings3D", "roads3D")


def _named_files(report: DataFrame, area_key: str, settings: PackageSettings, listing: DataFrame | None, written: DataFrame | None) -> DataFrame:
    """The report with the name of each file of a tile, null where it is not there."""
    keys = [area_key, "row", "col"]
    if written is not None:
        kind = report.schema[area_key].dataType
        per_tile = written.groupBy(*keys).agg(F.map_from_entries(F.collect_set(F.struct("entry", "file_name"))).alias("_files"))
        per_tile = per_tile.select(F.col(area_key).cast(kind).alias(area_key), F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), "_files")
        out = report.join(per_tile, keys, "left")
        return out.withColumns({m: F.try_element_at("_files", F.lit(m)) for m in NAMED}).drop("_files")
    prefix = F.concat(F.lit("tile_"), F.col("row").cast("string"), F.lit("_"), F.col("col").cast("string"))
    out = report.withColumns({
        MASK_ENTRIES[k]: F.when(F.lit(on), F.concat(prefix, F.lit(f"_{k}_mask.tif"))) for k, on in settings.switches.items()
    } | {"buildings3D": F.concat(prefix, F.lit("_buildings3d.json")), "roads3D": F.concat(prefix, F.lit("_roads3d.json"))})
    if listing is None:
        return out
    entries = out.select(*keys, prefix.alias("folder"), F.explode(F.array(*[F.struct(F.lit(m).alias("entry"), F.col(m).alias("file_name")) for m in NAMED])).alias("e"))
    there = manifests.existing_masks(entries.select(*keys, "folder", "e.*"), listing, area=(area_key,))
    present = there.groupBy(*keys).agg(F.collect_set("entry").alias("_present"))
    return out.join(present, keys, "left").withColumns({
        m: F.when(F.coalesce(F.array_contains("_present", m), F.lit(False)), F.col(m)) for m in NAMED
    }).drop("_present")


def _manifest_columns(area_key: str, settings: PackageSettings) -> dict:
    def source(source_id):
        name, attribution = catalogs.source_info(source_id)
        return F.struct(F.lit(source_id).alias("id"), F.lit(name).alias("name"), F.lit(attribution).alias("attribution"))

    flags = F.struct(
        *[F.lit(settings.switches.get(k, False)).alias(f"generate{k.capitalize()}Masks") for k in MASK_ENTRIES],
        F.lit(settings.cliff_threshold).alias("cliffThresholdDegrees"),
    )
    return {
        "bounds": F.struct(*SIDES), "row": F.col("row"), "col": F.col("col"), "width_m": F.col("width_m"), "height_m": F.col("height_m"),
        "z_min": F.col("z_min"), "z_max": F.col("z_max"), "has_nodata": F.col("has_nodata"),
        "display_min": surface.display_elevation("z_min"), "display_max": surface.display_elevation("z_max"), "files": F.struct(*NAMED),
        "dem": source(settings.dem_source), "imagery": source(settings.imagery_source), "preset": F.lit(settings.preset),
        "flags": flags, "resolution": F.lit(settings.resolution), "albedo_resolution": F.lit(settings.albedo_size),
        "name": F.concat(F.lit("Terrain_"), F.col(area_key).cast("string")), "created_by": F.lit(settings.created_by),
        "created_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
    }


def package_manifests(
    report: DataFrame, area_key: str, settings: PackageSettings, listing: DataFrame | None = None, written: DataFrame | None = None,
) -> DataFrame:
    """Manifest JSON of each tile: key, row, col, value.

    Masks are named where they were switched on. With ``listing`` (area key, folder, file_name) every
    file is named only where it is really there, in the area it belongs to. With ``written``, the result of
    ``manifests.written_files``, what lies there is named by its own place.
    """
    out = _named_files(report, area_key, settings, listing, written)
    return out.select(area_key, "row", "col", manifests.manifest_json(_manifest_columns(area_key, settings)).alias("value"))


def package_documents(
    report: DataFrame, area_key: str, settings: PackageSettings, listing: DataFrame | None = None, written: DataFrame | None = None,
) -> DataFrame:
    """One manifest for all tiles of an area, as lines (``manifests.combined_document``).

    Its box is that of all tiles; sizes in metres and names are those of the first tile. The files keep the names
    that they have below the folder of the package, so with ``listing`` they stand behind the folder of their tile.
    """
    named = _named_files(report, area_key, settings, listing, written)
    if written is None:
        named = packages.relocate_tile_files(named, list(NAMED))
    placed = packages.tile_order(named.drop("cols").join(named.groupBy(area_key).agg((F.max("col") + 1).alias("cols")), area_key), [area_key])
    columns = _manifest_columns(area_key, settings)
    entries = placed.select(area_key, "ordinal", F.to_json(manifests.tile_entry(columns), {"ignoreNullFields": "true"}).alias("entry"))
    extent = report.groupBy(area_key).agg(F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north"))
    heads = packages.combine_manifests(report, [area_key], ["width_m", "height_m"]).join(extent, area_key)
    before, behind = manifests.document_fields(columns, F.col("rows"), F.col("cols"))
    heads = heads.select(area_key, "n_tiles", F.to_json(F.struct(*before)).alias("before"), F.to_json(F.struct(*behind)).alias("behind"))
    return manifests.combined_document(entries, heads, [area_key])


def write_package(package: TerrainPackage, path: str, area_key: str, settings: PackageSettings) -> None:
    """Write all artefacts below ``path``, each tile in folders of its own, then the manifests of what lies there.

    Heights, albedo and masks are Parquet, features JSON lines; a tile without features has an empty file, a mask without
    pixels has none. Every manifest names the folder of each artefact that the file system lists for its tile, and no other.
    ``documents`` has one manifest for each area.
    """
    keys = [area_key, "row", "col"]
    entries = {"heights": "heightmap", "buildings": "buildings3D", "roads": "roads3D"}
    package.quantized.select(*keys, *blocks.PLACE, "q").write.mode("overwrite").partitionBy(*keys).parquet(f"{path}/heights")
    if package.albedo is not None:
        entries["albedo"] = "albedo"
        package.albedo.write.mode("overwrite").partitionBy(*keys).parquet(f"{path}/albedo")
    for kind in (k for k, on in settings.switches.items() if on):
        entries[f"masks/{kind}"] = MASK_ENTRIES[kind]
        package.masks.filter(F.col("kind") == kind).drop("kind").write.mode("overwrite").partitionBy(*keys).parquet(f"{path}/masks/{kind}")
    for name, part, fields in (
        ("buildings", package.buildings, ["footprint", "height", "floors", "min_level", "roof_shape", "tags"]),
        ("roads", package.roads, ["centerline", "width", "surface", "highway", "bridge", "layer", "tags"]),
    ):
        rows = manifests.features_json(part, keys, fields, tiles=package.tiles)
        rows.select(*keys, "value").write.mode("overwrite").partitionBy(*keys).text(f"{path}/{name}")
    report = package_report(package, area_key, settings)
    written = manifests.written_files(report.sparkSession, path, entries, keys)
    manifests.write_texts_by_tile(package_manifests(report, area_key, settings, written=written), f"{path}/manifests", (area_key,))
    manifests.write_documents(package_documents(report, area_key, settings, written=written), [area_key], f"{path}/documents")
