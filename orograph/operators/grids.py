"""Grids of tiles and pixels, and the helpers that keep hot tiles spread out."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import col, double, floor_div, round_half_up
from ..functions.unroll import unroll
from ..session import shuffle_partitions

KM_PER_DEGREE = 111.32
MAX_REGION_DEG2 = 0.25
# Pixels one image operation may touch, and the safety share of it.
CHUNK_PIXEL_LIMIT = 268435456 * 0.9
#: Positions of one word of marks, and words of a raster that are listed from one row.
BITS, PART_WORDS = 64, 512
# The divisions start within a half of values whose product suffices, and a step adds at least the
# smaller of them, so two steps are always enough; the check behind them stops a wrong split.
GROWTH_STEPS = 2


def int_range(low, high, step: int = 1) -> Column:
    """Array low, low+step, ... up to high inclusive; empty when high is below low."""
    low, high = col(low).cast("bigint"), col(high).cast("bigint")
    return F.when(low <= high, F.sequence(low, high, F.lit(step).cast("bigint"))).otherwise(
        F.array().cast("array<bigint>")
    )


def explode_grid(df: DataFrame, xs: Column, ys: Column, x: str = "x", y: str = "y") -> DataFrame:
    """One row per (x, y); ``xs`` may depend on the column ``y``.

    The row list (one record per grid line) is shuffled before the lines are expanded, so that a
    single huge grid is produced by many tasks.
    """
    lines = unroll(df, ys, y)
    hashable = [c for c, t in lines.dtypes if "map<" not in t]
    return unroll(lines.repartition(shuffle_partitions(df), F.xxhash64(*hashable)), xs, x)


def fill_holes(pixels: DataFrame, sizes: DataFrame, keys: list[str], fill: dict[str, object]) -> DataFrame:
    """``pixels`` (keys, x, y and the columns of ``fill``) with every position of each raster in ``sizes`` (keys, width, height).

    The positions that are there, each once and only inside of the raster, are marked in words of ``BITS`` positions, so small
    rasters take no more room than they have pixels. The words of all rasters, without marks, and those of the pixels are combined
    before and behind one shuffle; what is not marked is filled. Null keys are keys like others. Pixels pass through as they are;
    if they carry the size of their raster as ``_w`` and ``_h``, they are not joined with ``sizes``.
    """
    columns, words = [*keys, "x", "y", *fill], [*keys, "_w", "_h", "_word"]
    rasters = sizes.select(*keys, F.col("width").cast("bigint").alias("_w"), F.col("height").cast("bigint").alias("_h")).distinct()
    x, y = F.col("x").cast("bigint").alias("_x"), F.col("y").cast("bigint").alias("_y")
    if "_w" in pixels.columns and "_h" in pixels.columns:
        placed = pixels.select(*keys, x, y, F.col("_w").cast("bigint").alias("_w"), F.col("_h").cast("bigint").alias("_h"))
    else:
        named = {k: f"_k_{k}" for k in keys}
        same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(n)) for k, n in named.items()])
        placed = pixels.select(*keys, x, y).join(rasters.withColumnsRenamed(named), same)
    at = F.col("_y") * F.col("_w") + F.col("_x")
    mark = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(at, F.lit(BITS)).cast("int"))
    inside = placed.filter("_x >= 0 AND _x < _w AND _y >= 0 AND _y < _h").select(*keys, "_w", "_h", floor_div(at, BITS).alias("_word"), mark.alias("_marks"))
    last = floor_div(F.col("_w") * F.col("_h") - 1, BITS)
    part = F.col("_part") * PART_WORDS
    every = explode_grid(rasters, int_range(part, F.least(part + (PART_WORDS - 1), last)), int_range(F.lit(0), floor_div(last, PART_WORDS)), "_word", "_part")
    found = inside.unionByName(every.select(*words, F.lit(0).cast("bigint").alias("_marks"))).groupBy(*words).agg(F.bit_or("_marks").alias("_marks"))
    bits = F.least(F.lit(BITS).cast("bigint"), F.col("_w") * F.col("_h") - F.col("_word") * BITS)
    gone = F.filter(F.sequence(F.lit(0).cast("bigint"), bits - 1), lambda i: F.getbit("_marks", i.cast("int")) == 0)
    blank = unroll(found.filter(F.bit_count("_marks") < bits), gone, "_i").withColumn("_at", F.col("_word") * BITS + F.col("_i"))
    blank = blank.select(*keys, F.pmod("_at", F.col("_w")).alias("x"), floor_div("_at", F.col("_w")).alias("y"), *[F.lit(v).alias(c) for c, v in fill.items()])
    return pixels.select(*columns).unionByName(blank.select(*columns))


def blocked_row_number(df: DataFrame, keys: Sequence[str], order: str, name: str, block: int = 65536) -> DataFrame:
    """``row_number() over (partition by keys order by order)`` without one task per key.

    ``order`` is a unique non-negative integer. Rows are numbered inside blocks of the order
    value and shifted by the number of rows in earlier blocks, so a key that holds most rows
    is still sorted by many tasks. Only the block counts are windowed per key.
    """
    keys = list(keys)
    blocked = df.withColumn("_block", floor_div(order, block))
    counts = blocked.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    numbered = blocked.withColumn("_rn", F.row_number().over(inside))
    return (
        numbered.join(offsets, [*keys, "_block"])
        .withColumn(name, (F.col("_rn") + F.col("_offset")).cast("bigint"))
        .drop("_block", "_rn", "_offset")
    )


def _span_parts(west, south, east, north):
    w, s, e, n = (double(c) for c in (west, south, east, north))
    return w, s, e, n, e - w, n - s


def tile_grid(boxes: DataFrame, tile_km) -> DataFrame:
    """Equal split of each box into tiles of about ``tile_km``; row 0 is the southern one."""
    w, s, e, n, width, height = _span_parts("west", "south", "east", "north")
    km_lng = KM_PER_DEGREE * F.cos((n + s) / 2.0 * F.lit(3.141592653589793) / 180.0)
    one = F.lit(1).cast("bigint")
    sized = boxes.withColumn("rows", F.greatest(one, F.ceil(height / (double(tile_km) / KM_PER_DEGREE)))).withColumn(
        "cols", F.greatest(one, F.ceil(width / (double(tile_km) / km_lng)))
    )
    grid = explode_grid(
        sized.withColumnsRenamed({"west": "_w", "south": "_s", "east": "_e", "north": "_n"}),
        int_range(F.lit(0), F.col("cols") - 1), int_range(F.lit(0), F.col("rows") - 1), "col", "row",
    )
    return _place_cells(grid, "_w", "_s", "_e", "_n", "row", "col", "rows", "cols").withColumn(
        "center_lng", (F.col("west") + F.col("east")) / 2.0
    ).withColumn("center_lat", (F.col("south") + F.col("north")) / 2.0).drop("_w", "_s", "_e", "_n")


def _place_cells(grid, w, s, e, n, row, column, rows, cols) -> DataFrame:
    """Bounds of cell (row, column); the last cell of an axis ends exactly on the box."""
    dx = (F.col(e) - F.col(w)) / F.col(cols)
    dy = (F.col(n) - F.col(s)) / F.col(rows)
    return (
        grid.withColumn("west", F.col(w) + F.col(column) * dx)
        .withColumn("east", F.when(F.col(column) == F.col(cols) - 1, F.col(e)).otherwise(F.col(w) + (F.col(column) + 1) * dx))
        .withColumn("south", F.col(s) + F.col(row) * dy)
        .withColumn("north", F.when(F.col(row) == F.col(rows) - 1, F.col(n)).otherwise(F.col(s) + (F.col(row) + 1) * dy))
    )


def _grow(first: Column, second: Column, first_span: Column, second_span: Column, fits) -> Column:
    """Raise the divisions of the axis with the larger part until ``fits(part1, part2)``."""
    start = F.struct(first.alias("a"), second.alias("b"))

    def step(acc, _):
        part_a, part_b = first_span / acc["a"], second_span / acc["b"]
        grow_a = part_a >= part_b
        return F.when(fits(part_a, part_b), acc).otherwise(
            F.struct(
                F.when(grow_a, acc["a"] + 1).otherwise(acc["a"]).alias("a"),
                F.when(grow_a, acc["b"]).otherwise(acc["b"] + 1).alias("b"),
            )
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(GROWTH_STEPS)), start, step)


def _checked(divisions: Column, first_span: Column, second_span: Column, fits) -> Column:
    ok = fits(first_span / divisions["a"], second_span / divisions["b"])
    return F.when(ok, divisions).otherwise(F.raise_error(F.lit("the split did not reach its limit")))


def split_bounds(boxes: DataFrame, max_area: float = MAX_REGION_DEG2) -> DataFrame:
    """Split boxes into parts of at most ``max_area`` square degrees that cover them fully.

    The divisions start proportional to the sides and grow while a part is too large. The
    growth needs one step at most in practice; should a box ever need more than
    ``GROWTH_STEPS`` the query fails instead of giving a wrong split.
    """
    w, s, e, n, lon_span, lat_span = _span_parts("west", "south", "east", "north")
    area = lat_span * lon_span
    need, ratio, one = F.ceil(area / max_area), lat_span / F.nullif(lon_span, F.lit(0.0)), F.lit(1).cast("bigint")
    lat0 = F.greatest(one, round_half_up(F.sqrt(need * ratio)))
    lon0 = F.greatest(one, round_half_up(F.sqrt(need / ratio)))

    def fits(a, b):
        return a * b <= max_area

    grown = _checked(_grow(lat0, lon0, lat_span, lon_span, fits), lat_span, lon_span, fits)
    single = F.struct(one.alias("a"), one.alias("b"))
    sized = boxes.withColumn("_div", F.when(area <= max_area, single).otherwise(grown))
    sized = sized.select("*", F.col("_div.a").alias("lat_parts"), F.col("_div.b").alias("lon_parts")).drop("_div")
    sized = sized.withColumnsRenamed({"west": "_w", "south": "_s", "east": "_e", "north": "_n"})
    grid = explode_grid(
        sized, int_range(F.lit(0), F.col("lon_parts") - 1), int_range(F.lit(0), F.col("lat_parts") - 1),
        "lon_idx", "lat_idx",
    )
    placed = _place_cells(grid, "_w", "_s", "_e", "_n", "lat_idx", "lon_idx", "lat_parts", "lon_parts")
    return placed.withColumn("region_idx", F.col("lat_idx") * F.col("lon_parts") + F.col("lon_idx")).drop(
        "_w", "_s", "_e", "_n"
    )


def chunk_plan(jobs: DataFrame, limit: float = CHUNK_PIXEL_LIMIT) -> DataFrame:
    """Output rectangles and boxes so that every chunk reads fewer than ``limit`` source pixels.

    ``jobs`` has out_w, out_h, src_w, src_h and a box; chunk row 0 is the northern one. The
    number of chunks is also a good hint for the number of partitions.
    """
    src_w, src_h, one = double("src_w"), double("src_h"), F.lit(1).cast("bigint")
    need, aspect = F.ceil(src_w * src_h / limit), src_w / src_h

    def fits(a, b):
        return a * b < limit

    cols0 = F.greatest(one, round_half_up(F.sqrt(need * aspect)))
    rows0 = F.greatest(one, round_half_up(F.sqrt(need / aspect)))
    grown = _checked(_grow(cols0, rows0, src_w, src_h, fits), src_w, src_h, fits)
    single = F.struct(one.alias("a"), one.alias("b"))
    sized = jobs.withColumn("_div", F.when(src_w * src_h < limit, single).otherwise(grown))
    sized = sized.select("*", F.col("_div.a").alias("chunk_cols"), F.col("_div.b").alias("chunk_rows")).drop("_div")
    sized = sized.withColumnsRenamed({"west": "_w", "south": "_s", "east": "_e", "north": "_n"})
    grid = explode_grid(
        sized, int_range(F.lit(0), F.col("chunk_cols") - 1), int_range(F.lit(0), F.col("chunk_rows") - 1),
        "chunk_col", "chunk_row",
    )
    cw, ch = floor_div("out_w", F.col("chunk_cols")), floor_div("out_h", F.col("chunk_rows"))
    lon, lat = F.col("_e") - F.col("_w"), F.col("_n") - F.col("_s")
    c, r, nc, nr = (F.col(k) for k in ("chunk_col", "chunk_row", "chunk_cols", "chunk_rows"))
    return (
        grid.withColumn("out_x", c * cw)
        .withColumn("out_y", r * ch)
        .withColumn("width", F.when(c == nc - 1, F.col("out_w") - c * cw).otherwise(cw))
        .withColumn("height", F.when(r == nr - 1, F.col("out_h") - r * ch).otherwise(ch))
        .withColumn("west", F.col("_w") + c / nc * lon)
        .withColumn("east", F.col("_w") + (c + 1) / nc * lon)
        .withColumn("north", F.col("_n") - r / nr * lat)
        .withColumn("south", F.col("_n") - (r + 1) / nr * lat)
        .drop("_w", "_s", "_e", "_n")
    )


def generation_plan(boxes: DataFrame, per_degree: float = 2.0, zoom: int = 12, max_parts: int = 4) -> DataFrame:
    """Coarse plan of 1..4 by 1..4 tiles with the memory and time set aside for each."""
    w, s, e, n, width, height = _span_parts("west", "south", "east", "north")

    def parts(span):
        return F.least(F.lit(max_parts).cast("bigint"), F.greatest(F.lit(1).cast("bigint"), F.ceil(span * per_degree)))

    sized = boxes.withColumn("rows", parts(height)).withColumn("cols", parts(width))
    sized = sized.withColumnsRenamed({"west": "_w", "south": "_s", "east": "_e", "north": "_n"})
    grid = explode_grid(
        sized, int_range(F.lit(0), F.col("cols") - 1), int_range(F.lit(0), F.col("rows") - 1), "col", "row"
    )
    w, s, width, height = F.col("_w"), F.col("_s"), F.col("_e") - F.col("_w"), F.col("_n") - F.col("_s")
    c, r, nc, nr = (F.col(k) for k in ("col", "row", "cols", "rows"))
    return (
        grid.withColumn("west", w + c / nc * width)
        .withColumn("east", w + (c + 1) / nc * width)
        .withColumn("south", s + r / nr * height)
        .withColumn("north", s + (r + 1) / nr * height)
        .withColumn("zoom", F.lit(zoom))
        .withColumn("memory_mb", nr * nc * 256)
        .withColumn("duration_sec", nr * nc * 45)
        .drop("_w", "_s", "_e", "_n")
    )
