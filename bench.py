"""Time the queries on one machine and print one JSON line.

BENCH_SF_DIR and BENCH_CPUS name the tables and the cores. ``python bench.py --all`` times every
query, ``--sweep`` adds pixel rates on generated rasters of 10**6 and 10**7 pixels, for rasters in blocks of 10**6 to 10**8.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

from workload import QUERIES
from workload.compare import make_session

HEADLINE = [
    "tile_catalog", "tile_grid", "split_bounds", "crop_mercator", "mosaic_tiles", "resample_bilinear", "resample_nearest", "resample_lanczos",
    "slope_grid", "elevation_stats", "quantize_u16", "scanline_spans", "rasterize_polygons", "rasterize_lines", "features_to_regions",
    "dedupe_features", "extract_buildings", "extract_roads", "road_ribbons", "scatter_candidates", "scatter_instances", "instance_transforms",
    "mask_generation", "job_progress_latest", "debounced_queries", "terrain_package",
]


def run(df) -> float:
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def sweep(spark) -> dict[str, float]:
    """Seconds for the raster operators on tiles of 1000 x 1000 generated pixels."""
    from orograph.operators import blocks, resample, surface

    out, side = {}, blocks.BLOCK
    for power in (6, 7, 8):
        # tiles of four by four blocks, whose values are made as arrays
        n = round(10 ** power / side ** 2)
        place = {"tile": F.floor(F.col("id") / 16), "x0": F.col("id") % 4 * side, "y0": F.floor(F.col("id") % 16 / 4) * side, "w": F.lit(side), "h": F.lit(side)}
        raster = spark.range(0, n, 1, max(n // 16, 8)).withColumns(place).withColumn("v", F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: (i * 7919 % 4801 / 10).cast("double"))).drop("id")
        whole = {"left": 0, "top": 0, "src_w": 4 * side, "src_h": 4 * side, "dst_w": 512, "dst_h": 512}
        frames = spark.range(-(-n // 16)).select(F.col("id").alias("tile"), *[F.lit(v).cast("bigint").alias(k) for k, v in whole.items()])
        out[f"blocks_made_1e{power}"] = run(raster)
        out[f"slope_blocks_1e{power}"] = run(blocks.slopes(raster, ["tile"]))
        out[f"bilinear_blocks_1e{power}"] = run(blocks.resampled(raster, frames, ["tile"], ["tile"], "bilinear"))
        out[f"lanczos_blocks_1e{power}"] = run(blocks.resampled(raster, frames, ["tile"], ["tile"], "lanczos3"))
        out[f"quantized_blocks_1e{power}"] = run(blocks.quantized(raster, ["tile"]))
    for power in (6, 7):
        n = 10 ** power
        cell = F.col("id") % 1000000
        pixels = spark.range(n).select(
            F.floor(F.col("id") / 1000000).alias("tile"), (cell % 1000).alias("x"), F.floor(cell / 1000).alias("y"),
            (F.col("id") * 7919 % 4801 / 10).alias("z"),
        )
        out[f"slope_grid_1e{power}"] = run(surface.slope_grid(pixels, ["tile"]))
        out[f"resample_bilinear_1e{power}"] = run(resample.resample_bilinear(pixels, ["tile"], 1000, 1000, 512, 512))
        out[f"resample_nearest_1e{power}"] = run(resample.resample_nearest(pixels, ["tile"], 1000, 1000, 512, 512, ("z",)))
        out[f"quantize_u16_1e{power}"] = run(surface.quantize_heights(pixels, ["tile"]))
    return out


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [a for a in sys.argv[1:] if not a.startswith("--")] or (list(QUERIES) if "--all" in sys.argv else HEADLINE)
    spark = make_session(cpus, cpus)
    run(QUERIES["elevation_stats"](spark, sf))
    times = {}
    for name in names:
        start = time.perf_counter()
        run(QUERIES[name](spark, sf))
        times[name] = round(time.perf_counter() - start, 3)
        if "--verbose" in sys.argv:
            print(name, times[name], file=sys.stderr, flush=True)
    if "--sweep" in sys.argv:
        times |= {k: round(v, 3) for k, v in sweep(spark).items()}
    print(json.dumps({"metric": "total seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
