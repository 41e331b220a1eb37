"""Packages, manifests and streams."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from orograph.operators import packages
from orograph.plans import terrain
from orograph.sources import gazetteer, manifests
from orograph.streaming import jobs


def test_packages_on_disk(spark, tmp_path):
    def tile(r, c):
        return {"row": r, "col": c, "files": {"heightmap": "h.png"}}

    def put(path, text):
        path.mkdir(parents=True, exist_ok=True)
        (path / "manifest.json").write_text(text)

    put(tmp_path / "root", json.dumps({"tiles": [tile(0, 0), tile(0, 1)]}, indent=2))
    put(tmp_path / "root/tile_5_5", json.dumps({"tiles": [tile(5, 5)]}))
    put(tmp_path / "loose", json.dumps({"tiles": []}))
    put(tmp_path / "loose/tile_1_2", json.dumps({"tiles": [tile(1, 2), tile(9, 9)]}))
    put(tmp_path / "loose/tile_3_4", "{not json")
    put(tmp_path / "loose/tile_5_6", json.dumps({"version": "1"}))
    got = {(r["package"].rsplit("/", 1)[1], r["folder"].rsplit("/", 1)[1], r["tile"]["row"], r["tile"]["col"]) for r in manifests.read_packages(spark, str(tmp_path)).collect()}
    assert got == {("root", "root", 0, 0), ("root", "root", 0, 1), ("loose", "tile_1_2", 1, 2)}


def test_features_json_keeps_every_feature(spark):
    f = spark.range(2500).select(F.lit(1).alias("tile"), "id", F.when(F.col("id") % 2 == 0, F.lit("x")).alias("name"))
    rows = manifests.features_json(f, ["tile"], ["id", "name"]).collect()
    found = [json.loads(r["value"]) for r in rows]
    assert sorted(i["id"] for i in found) == list(range(2500)) and {"id": 1} in found


def test_world_offsets_over_gaps(spark):
    rows = [(1, 0, 0, 0.0, 0.0, 1.0, 1.0), (1, 0, 2, 2.0, 0.0, 2.5, 1.0), (1, 1, 0, 0.0, 1.0, 9.0, 3.0), (1, 3, 3, 3.0, 3.0, 4.0, 4.0)]
    df = spark.createDataFrame(rows, "p int, row bigint, col bigint, west double, south double, east double, north double")
    columns, lines = packages.world_offsets(df, ["p"])
    m = packages.mean_center_lat(df, ["p"]).collect()[0]["m_per_deg_lng"]
    assert [r["offset_m"] for r in columns.orderBy("col").collect()] == pytest.approx([0, m, m, 1.5 * m])
    assert [r["offset_m"] / 111320 for r in lines.orderBy("row").collect()] == pytest.approx([0, 1, 3, 3])


def test_repair_only_with_repeated_positions(spark):
    rows = [(1, 0, 0, "tile_2_3/h.png", None), (1, 0, 0, "h.png", "tile_4_5_a.png"), (1, 1, 1, None, None), (2, 7, 7, "tile_2_3/h.png", None)]
    df = spark.createDataFrame(rows, "p int, row bigint, col bigint, heightmap string, albedo string")
    got = sorted((r["p"], r["row"], r["col"], r["repaired"]) for r in packages.duplicate_tile_repair(df, ["p"]).collect())
    assert got == [(1, 1, 1, True), (1, 2, 3, True), (1, 4, 5, True), (2, 7, 7, False)]


def test_import_summary(spark):
    rows = [(1, i, 0, i, "gone" if i > 1 else None) for i in range(8)] + [(2, 0, 0, 0, None)] + [(3, 4, 2, 0, "bad")]
    df = spark.createDataFrame(rows, "p int, row int, col int, ordinal bigint, reason string")
    got = {r["p"]: (r["imported"], r["failed"], r["failures"]) for r in packages.import_summary(df, ["p"]).collect()}
    assert got == {1: (2, 6, "tile_2_0 (gone), tile_3_0 (gone), tile_4_0 (gone)..."), 2: (1, 0, ""), 3: (0, 1, "tile_4_2 (bad)")}


def test_elevation_range_defaults(spark):
    df = spark.createDataFrame([(1, 5.0, 9.0), (1, 3.0, 7.0), (2, float("nan"), 1.0), (2, 4.0, 6.0), (3, float("inf"), 2.0)], "p int, z_min double, z_max double")
    got = {r["p"]: (r["package_min"], r["package_max"]) for r in packages.package_elevation_range(df, ["p"]).collect()}
    assert got == {1: (3.0, 9.0), 2: (0.0, 100.0), 3: (0.0, 100.0)}


def test_gazetteer_numbers(spark):
    row = {"place_id": 1, "display_name": "A", "lat": "48.85abc", "lon": "x", "type": "city", "class": "place", "boundingbox": ["1", "2.5", "-3", "4e1"]}
    got = gazetteer.parse_gazetteer(spark.createDataFrame([(json.dumps(row),)], "body string")).collect()[0]
    assert (got["latitude"], got["longitude"], got["bounding_box"]) == (48.85, None, [1.0, 2.5, -3.0, 40.0])


T0 = dt.datetime(2024, 1, 1)


def debounce_loop(events, gap):
    out = set()
    for user in {e[0] for e in events}:
        mine = sorted((e for e in events if e[0] == user), key=lambda e: (e[1], e[2]))
        for e, after in zip(mine, [*mine[1:], None]):
            if (after is None or (after[1] - e[1]).total_seconds() > gap) and len(e[3].strip()) >= 3:
                out.add((user, e[2], e[3].strip()))
    return out


@pytest.mark.parametrize("bucket", [10, 35, 5000])
def test_debounce_does_not_depend_on_the_buckets(spark, bucket):
    rng = random.Random(bucket)
    events, t = [], T0
    for i in range(800):
        t += dt.timedelta(seconds=rng.choice([0, 1, 3, 9, 10, 11, 40]))
        events.append((rng.choice([1, 1, 1, 2]), t, i, rng.choice(["ab", "abc", " tree ", "x"])))
    df = spark.createDataFrame(events, "user_id int, ts timestamp, event_id bigint, q string")
    want = debounce_loop(events, 10)
    assert {(r["user_id"], r["event_id"], r["q"]) for r in jobs.debounced_queries(df, 10, bucket).collect()} == want


def test_debounce_stream(spark, tmp_path):
    schema = "user_id int, ts timestamp, event_id bigint, q string"
    events = [(1, T0 + dt.timedelta(seconds=s), i, q) for i, (s, q) in enumerate([(0, "ab"), (2, "abc"), (30, "tree"), (31, "x"), (60, "river")])]
    late = [(9, T0 + dt.timedelta(hours=5), 99, "sentinel")]
    for i, rows in enumerate((events[:3], events[3:], late)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.debounced_queries_stream(stream, "10 seconds", "1 minute").writeStream.outputMode("append").format("memory").queryName("debounced").option(
        "checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert {(r["user_id"], r["q"]) for r in spark.sql("SELECT user_id, q FROM debounced").collect()} == {(1, "abc"), (1, "river")}


def test_progress_stream_equals_the_table(spark, tmp_path):
    schema = "job_id bigint, event_id bigint, ts timestamp, state string, progress double"
    rng = random.Random(1)
    rows = [(rng.randint(1, 9), i, T0 + dt.timedelta(seconds=rng.randint(0, 50)), rng.choice(["planning", "complete", "error"]), float(i)) for i in range(300)]
    for part in range(3):
        spark.createDataFrame(rows[part::3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = jobs.start_job_progress(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "cp"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    live = {r["job_id"]: tuple(r) for r in jobs.read_job_progress(spark, str(tmp_path / "out")).collect()}
    assert live == {r["job_id"]: tuple(r) for r in jobs.job_progress_latest(spark.createDataFrame(rows, schema)).collect()}
    best = {j: max((r[2], r[1]) for r in rows if r[0] == j) for j in live}
    assert all((live[j][3], live[j][4]) == best[j] for j in live) and all(r[5] == (r[1] in ("complete", "error")) for r in live.values())


def test_kept_progress_is_compacted(spark, tmp_path):
    """Snapshots take the place of old batches, and a repeated batch or snapshot changes nothing."""
    out, schema = str(tmp_path / "kept"), "job_id long, state string, progress double, ts timestamp, event_id long"
    want = {}
    for batch in range(11):
        rows = [(j, "planning", float(batch), T0 + dt.timedelta(seconds=batch), batch * 10 + j) for j in range(4) if (batch + j) % 3 == 0 or j == 3 and batch == 0]
        want |= {r[0]: r for r in rows}
        changed = jobs.job_progress_latest(spark.createDataFrame(rows, schema)).coalesce(1)
        for _ in range(2 if batch in (4, 8, 10) else 1):  # those are delivered twice
            jobs.write_progress_batch(changed, batch, out, every=3)
        got = {r.job_id: (r.job_id, r.state, r.progress, r.ts, r.event_id) for r in jobs.read_job_progress(spark, out).collect()}
        assert got == want
    assert sorted(p.name for p in (tmp_path / "kept" / "snapshots").iterdir() if "=" in p.name) == ["upto=5", "upto=8"]
    assert sorted(p.name for p in (tmp_path / "kept" / "batches").iterdir() if "=" in p.name) == sorted(f"batch={n}" for n in (6, 7, 8, 9, 10))


def test_written_package(spark, tmp_path):
    areas = spark.createDataFrame([(1, 0.0, 9.0, 1.0, 10.0), (2, 5.0, 9.0, 4.0, 10.0)], "area_id int, west double, south double, east double, north double")
    px = spark.range(10000).select(F.lit(1).alias("area_id"), (F.col("id") % 100).alias("x"), F.floor(F.col("id") / 100).alias("y"))
    square = lambda lat, lon: [(lat, lon), (lat, lon + 0.1), (lat + 0.1, lon + 0.1), (lat + 0.1, lon)]
    feats = spark.createDataFrame(
        [("way", 1, square(9.2, 0.2), {"building": "yes"}), ("way", 2, square(9.45, 0.45), {"natural": "water"}), ("way", 3, square(9.7, 0.1)[:2], {"highway": "path"})],
        "type string, id bigint, geometry array<struct<lat: double, lon: double>>, tags map<string,string>")
    settings = terrain.PackageSettings(tile_km=55.66, resolution=16, height_format="r16")
    areas = areas.unionByName(spark.createDataFrame([(3, 2.0, 1.0, 2.4, 1.4)], areas.schema))
    p = terrain.TerrainPackage.from_rasters(areas, "area_id", px.withColumn("z", (F.col("x") + F.col("y")) / 4), px.withColumn("cls", F.lit(10)), feats, terrain.Georeference(100, 100, 0.01), settings)
    terrain.write_package(p, str(tmp_path), "area_id", settings)
    heights = spark.read.parquet(str(tmp_path / "heights"))
    assert heights.agg(F.sum(F.size("q"))).first()[0] == 5 * 256 and heights.filter("area_id = 3").agg(F.array_max(F.flatten(F.collect_list("q")))).first()[0] == 0
    kinds = {k: spark.read.parquet(str(tmp_path / "masks" / k)).count() for k in ("road", "water", "building", "vegetation")}
    assert all(kinds.values()) and kinds["vegetation"] < 4 * 256
    texts = spark.read.text(str(tmp_path / "manifests"), wholetext=False)
    docs = [json.loads(r["value"]) for r in texts.collect()]
    assert len(docs) == 5 and {(d["tiles"][0]["row"], d["tiles"][0]["col"]) for d in docs} == {(0, 0), (0, 1), (1, 0), (1, 1)}
    assert all(d["tiles"][0]["elevation"]["min"] <= d["tiles"][0]["elevation"]["max"] and "seamStitching" not in d["processing"] for d in docs)
    again = manifests.packages_from_text(texts.select(F.concat(F.lit("pk/tile_"), F.col("tile_row").cast("string"), F.lit("_"), F.col("tile_col").cast("string"), F.lit("/manifest.json")).alias("path"), F.col("value").alias("body")))
    assert again.count() == 5
    assert {(r["area_id"], r["tile_row"], r["tile_col"]) for r in texts.collect()} == {(1, 0, 0), (1, 0, 1), (1, 1, 0), (1, 1, 1), (3, 0, 0)}
    # every folder of a tile on the disk is named by the manifest of that tile, and none else
    named = {(d["terrainName"], e, f) for d in docs for e, f in d["tiles"][0]["files"].items()}
    on_disk = {str(f.parent.relative_to(tmp_path)) for top in ("heights", "buildings", "roads", "masks") for f in (tmp_path / top).rglob("part-*")}
    assert {f for _, _, f in named} == on_disk and len(named) == len(on_disk)
    assert all(f"area_id={name.removeprefix('Terrain_')}/" in f for name, _, f in named)
    assert {e for _, e, _ in named} == {"heightmap", "buildings3D", "roads3D", "roadMask", "waterMask", "buildingMask", "vegetationMask"}
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "buildings")).collect()]
    buildings = [json.loads(v) for v in lines if v]
    assert len(buildings) == 1 and len(buildings[0]["footprint"]) == 4 and len(lines) == 5  # four tiles have an empty file
    combined = manifests.read_documents(spark, str(tmp_path / "documents"), ["area_id"])
    assert {(r.area_id, r.tile.row, r.tile.col, tuple(r.tile.bounds), r.tile.files.heightmap) for r in combined.collect()} == {
        (int(d["terrainName"][8:]), t["row"], t["col"], tuple(t["bounds"].values()), t["files"]["heightmap"]) for d in docs for t in d["tiles"]}


def test_a_combined_document_of_many_parts(spark, tmp_path):
    """Larger than a partition: the files of a package, in order, are one JSON text that holds all its tiles."""
    keys = ["pkg"]
    tiles = spark.range(5000).selectExpr("IF(id < 4990, 'big', 'a=b c') AS pkg", "id AS row", "id % 3 AS col", "IF(id < 4990, id, id - 4990) + 1 AS ordinal")
    entry = F.to_json(F.struct("row", "col", F.struct(F.lit("x").alias("heightmap")).alias("files")))
    heads = tiles.groupBy("pkg").agg(F.count(F.lit(1)).alias("n_tiles")).withColumns({"before": F.lit('{"version":"1"}'), "behind": F.lit('{"exportPreset":"p"}')})
    lines = manifests.combined_document(tiles.withColumn("entry", entry), heads, keys)
    manifests.write_documents(lines, keys, str(tmp_path / "d"))
    folders = sorted((tmp_path / "d").glob("pkg=*"))
    assert len(folders) == 2
    for folder, n, first in zip(folders, (10, 4990), (4990, 0)):
        files = sorted(folder.glob("part-*"))
        whole = json.loads("".join(f.read_text() for f in files))
        assert [t["row"] for t in whole["tiles"]] == list(range(first, first + n)) and (whole["version"], whole["exportPreset"]) == ("1", "p")
        assert n == 10 or len(files) > 1
    back = manifests.read_documents(spark, str(tmp_path / "d"), keys)
    assert back.selectExpr("pkg", "tile.row", "tile.col", "tile.files.heightmap").exceptAll(tiles.selectExpr("pkg", "row", "col", "'x'")).count() == 0 and back.count() == 5000
