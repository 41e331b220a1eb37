"""Package manifests: reading, checking against files, writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import path_tile_coords
from ..functions.unroll import unroll_indexed
from ..session import shuffle_partitions, shuffled

MASK_KEYS = ("roadMask", "waterMask", "vegetationMask", "buildingMask", "cliffMask")
FILE_KEYS = ("heightmap", "albedo", *MASK_KEYS, "buildings3D", "roads3D")
BOX_TYPE = "struct<west: double, south: double, east: double, north: double>"
TILE_TYPE = (
    f"struct<row: bigint, col: bigint, bounds: {BOX_TYPE}, worldOffset: struct<x: double, y: double, z: double>, "
    f"files: struct<{', '.join(f'{k}: string' for k in FILE_KEYS)}>, "
    "elevation: struct<min: double, max: double, units: string, actualMin: double, actualMax: double, hasNoData: boolean>>"
)
SOURCE_TYPE = "struct<id: string, name: string, attribution: string>"
MANIFEST_SCHEMA = (
    f"version string, createdBy string, createdAt string, terrainName string, bounds {BOX_TYPE}, crs string, "
    "tileGrid struct<rows: bigint, cols: bigint, chunkSizeM: double, tileWidthM: double, tileHeightM: double, "
    "heightmapResolution: bigint, albedoResolution: bigint>, "
    f"tiles array<{TILE_TYPE}>, sources struct<dem: {SOURCE_TYPE}, imagery: {SOURCE_TYPE}>, exportPreset string, "
    "processing struct<generateRoadMasks: boolean, generateWaterMasks: boolean, generateVegetationMasks: boolean, "
    "generateBuildingMasks: boolean, generateCliffMasks: boolean, cliffThresholdDegrees: double>"
)
MANIFEST_NAME = "manifest.json"


def packages_from_text(files: DataFrame, path: str = "path", body: str = "body") -> DataFrame:
    """Tiles of packages from manifest texts.

    The manifest at the root of a package wins when it lists tiles; otherwise each ``tile_R_C``
    folder gives the first tile of its manifest. Texts that cannot be read are skipped.
    """
    folder = F.regexp_replace(F.col(path), rf"/{MANIFEST_NAME}$", "")
    is_tile = folder.rlike(r"(^|/)tile_[^/]*_[^/]*$")
    parsed = files.select(
        F.when(is_tile, F.regexp_replace(folder, r"/[^/]*$", "")).otherwise(folder).alias("package"),
        folder.alias("folder"), is_tile.alias("_tile"), F.from_json(body, MANIFEST_SCHEMA).alias("manifest"),
    ).filter(F.size("manifest.tiles") > 0)
    roots = parsed.filter(~F.col("_tile"))
    listed = unroll_indexed(roots, F.col("manifest.tiles"), "pos", "tile").select("package", "folder", "manifest.tileGrid", "pos", "tile")
    loose = parsed.filter("_tile").join(roots.select("package").distinct(), "package", "left_anti")
    firsts = loose.select(
        "package", "folder", "manifest.tileGrid", F.lit(0).alias("pos"), F.get(F.col("manifest.tiles"), F.lit(0)).alias("tile")
    )
    return listed.unionByName(firsts)


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """Scan a folder of packages. One manifest is one small document."""
    files = (
        spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=MANIFEST_NAME)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))
    )
    return packages_from_text(files)


def existing_masks(entries: DataFrame, listing: DataFrame, folder: str = "folder", name: str = "file_name", area: tuple[str, ...] = ()) -> DataFrame:
    """Entries that have a name and whose file is in ``listing`` (``area``, folder, file_name)."""
    named = entries.filter(F.coalesce(F.length(name), F.lit(0)) > 0)
    on = [*area, folder, name]
    return named.join(shuffled(listing.select(*on).distinct()), on, "left_semi")


def resolve_heightmap(tiles: DataFrame, listing: DataFrame, folder: str = "folder", name: str = "file_name") -> DataFrame:
    """Path of the heightmap in the tile folder, else in its ``heightmap`` folder, else NULL."""
    files = shuffled(listing.select(F.concat_ws("/", folder, name).alias("_path")).distinct())
    direct = F.concat_ws("/", F.col(folder), F.col(name))
    nested = F.concat_ws("/", F.col(folder), F.lit("heightmap"), F.col(name))
    out = tiles.withColumn("_direct", direct).withColumn("_nested", nested)
    out = out.join(files.select(F.col("_path").alias("_a")), F.col("_direct") == F.col("_a"), "left")
    out = out.join(files.select(F.col("_path").alias("_b")), F.col("_nested") == F.col("_b"), "left")
    return out.withColumn("heightmap_path", F.coalesce("_a", "_b")).drop("_direct", "_nested", "_a", "_b")


def tile_entry(c: dict[str, Column]) -> Column:
    """One tile of a manifest."""
    return F.struct(
        c["row"].alias("row"), c["col"].alias("col"), c["bounds"].alias("bounds"),
        F.struct((c["col"] * c["width_m"]).alias("x"), F.lit(0.0).alias("y"), (c["row"] * c["height_m"]).alias("z")).alias("worldOffset"),
        c["files"].alias("files"),
        F.struct(
            c["display_min"].alias("min"), c["display_max"].alias("max"), F.lit("meters").alias("units"),
            c["z_min"].alias("actualMin"), c["z_max"].alias("actualMax"), c["has_nodata"].alias("hasNoData"),
        ).alias("elevation"),
    )


def document_fields(c: dict[str, Column], rows: Column, cols: Column) -> tuple[list[Column], list[Column]]:
    """The fields of a manifest before and behind its tiles."""
    before = [
        F.lit("1.0.0").alias("version"), c["created_by"].alias("createdBy"), c["created_at"].alias("createdAt"),
        c["name"].alias("terrainName"), c["bounds"].alias("bounds"), F.lit("EPSG:4326").alias("crs"),
        F.struct(
            rows.alias("rows"), cols.alias("cols"), F.greatest(c["width_m"], c["height_m"]).alias("chunkSizeM"), c["width_m"].alias("tileWidthM"),
            c["height_m"].alias("tileHeightM"), c["resolution"].alias("heightmapResolution"),
            c["albedo_resolution"].alias("albedoResolution"),
        ).alias("tileGrid"),
    ]
    return before, [F.struct(c["dem"].alias("dem"), c["imagery"].alias("imagery")).alias("sources"), c["preset"].alias("exportPreset"), c["flags"].alias("processing")]


def manifest_json(columns: dict[str, Column]) -> Column:
    """Tile manifest as JSON. Keys whose value is NULL are left out, as in the file format.

    ``columns``: bounds, row, col, width_m, height_m, z_min, z_max, has_nodata, display_min,
    display_max, files (struct), dem and imagery (structs), preset, flags (struct), resolution,
    albedo_resolution, name, created_by, created_at. Only steps that ran are reported.
    """
    before, behind = document_fields(columns, F.lit(1), F.lit(1))
    return F.to_json(F.struct(*before, F.array(tile_entry(columns)).alias("tiles"), *behind), {"ignoreNullFields": "true"})


HEAD, TILE, FOOT = "head", "tile", "foot"


def combined_document(tiles: DataFrame, heads: DataFrame, keys: list[str]) -> DataFrame:
    """One JSON document per package as lines (keys, line, part, value) that give it when they are joined in order.

    ``heads`` has the keys, ``before`` and ``behind`` (JSON objects of the fields before and behind the tiles) and
    n_tiles; ``tiles`` the keys, ``ordinal`` (from 1) and ``entry`` (JSON). Every tile is a line of its own, with
    a comma unless it is the last, so a document of any size is made, written and read by many tasks.
    """
    one, n = F.lit(1).cast("bigint"), F.col("n_tiles").cast("bigint")
    opened = F.concat(F.expr("left(before, length(before) - 1)"), F.lit(',"tiles":['))
    closed = F.concat(F.lit("],"), F.expr("substring(behind, 2)"))
    ends = heads.select(*keys, F.inline(F.array(
        F.struct((one * 0).alias("line"), F.lit(HEAD).alias("part"), opened.alias("value")), F.struct((n + 1).alias("line"), F.lit(FOOT).alias("part"), closed.alias("value")))))
    comma = F.when(F.col("ordinal") < n, F.lit(",")).otherwise(F.lit(""))
    lines = tiles.join(heads.select(*keys, "n_tiles"), keys).select(*keys, F.col("ordinal").cast("bigint").alias("line"), F.lit(TILE).alias("part"), F.concat("entry", comma).alias("value"))
    return ends.unionByName(lines)


def write_documents(lines: DataFrame, keys: list[str], path: str) -> None:
    """Write documents below KEY=K folders: the files of a folder, in the order of their names, are its document.

    Lines are dealt out by ranges of (keys, line), so a large document goes to several files and several tasks.
    """
    n = shuffle_partitions(lines)
    rows = lines.repartitionByRange(n, *keys, "line").sortWithinPartitions(*keys, "line")
    rows.select(*keys, "value").write.mode("overwrite").partitionBy(*keys).text(path)


def read_documents(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Tiles (keys, tile) of documents written by ``write_documents``; each line is parsed where it is read."""
    lines = spark.read.text(path).filter(F.col("value").startswith('{"row":'))
    return lines.select(*keys, F.from_json(F.rtrim("value", F.lit(",")), TILE_TYPE).alias("tile"))


def written_files(spark: SparkSession, path: str, entries: dict[str, str], keys: list[str]) -> DataFrame:
    """What really lies below ``path``: keys (as texts), entry, file_name (the folder of the tile, from ``path``) and n_files.

    ``entries`` names the entry of a manifest for every first folder (a part of a pattern). Only the metadata of
    files are read, back from the file system; a tile without files of an entry has no row.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    tail = "/".join(f"{k}=([^/]+)" for k in keys)
    out = None
    for folder, entry in entries.items():
        pattern = f"/({folder}/{tail}(?:/[^/=]+=[^/]+)*)/[^/]+$"
        hit = found.filter(F.col("path").rlike(pattern)).select(
            *[F.url_decode(F.regexp_extract("path", pattern, i + 2)).alias(k) for i, k in enumerate(keys)], F.lit(entry).alias("entry"), F.regexp_extract("path", pattern, 1).alias("file_name"))
        out = hit if out is None else out.unionByName(hit)
    return out.groupBy(*keys, "entry", "file_name").agg(F.count(F.lit(1)).alias("n_files"))


def write_texts_by_tile(rows: DataFrame, path: str, area: tuple[str, ...] = (), row: str = "row", tile_col: str = "col", text: str = "value") -> None:
    """Write one text per row under AREA=A/tile_row=R/tile_col=C folders."""
    rows.select(*area, F.col(row).alias("tile_row"), F.col(tile_col).alias("tile_col"), F.col(text).alias("value")).write.mode(
        "overwrite"
    ).partitionBy(*area, "tile_row", "tile_col").text(path)


def features_json(features: DataFrame, keys: list[str], fields: list[str], id_col: str = "id", tiles: DataFrame | None = None) -> DataFrame:
    """One JSON object per feature: keys, the id and ``value``. The form is the same for every tile, and nothing is gathered.

    With ``tiles``, one that has no feature gets a row with a null id and an empty value, so that its file exists.
    """
    rows = features.select(*keys, id_col, F.to_json(F.struct(*fields)).alias("value"))
    if tiles is None:
        return rows
    bare = tiles.select(*keys).distinct().join(rows.select(*keys), keys, "left_anti")
    return rows.unionByName(bare.select(*keys, F.lit(None).cast(rows.schema[id_col].dataType).alias(id_col), F.lit("").alias("value")))


def tile_coords_of(path: str = "path") -> dict[str, Column]:
    row, column = path_tile_coords(path)
    return {"row": row, "col": column}
