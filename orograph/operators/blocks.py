"""Rasters in blocks: one row per rectangle of pixels, with its values in one array.

A block raster has key columns and x0, y0 (place of the first pixel), w, h and v: the values of all
bands, one band after the other, row by row; null stands for an absent pixel. The blocks of a raster
do not overlap. Operators move blocks, or rectangles cut from them, through one shuffle and work on
whole arrays behind it; no row of a single pixel is ever sorted.

``gather`` is the one operator that brings pixels together: every target names the rectangle of the
source it reads, blocks and targets meet by cells of the source (an equality, not a range condition),
and only the rectangles in common are sent. Crops, mosaics, all ways to resize and slopes are gathers
with another kernel. A target is at most ``BLOCK`` pixels wide and high, so a task holds one target
and what it reads, however large a raster is. ``slopes`` sends the margins of regular blocks directly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import heights
from ..functions.numbers import double, floor_div, is_nodata
from ..functions.unroll import residual, unroll
from .grids import int_range
from .resample import LEAST_WEIGHT

BLOCK = 256
SLACK = 1e-6
PLACE = ("x0", "y0", "w", "h")
RASTER = "x0 bigint, y0 bigint, w int, h int, v array<double>"
#: (values (bands, height, width), absent, facts of the target) -> (x0, y0, values, absent or None) of the results
Kernel = Callable[[np.ndarray, np.ndarray, dict], Iterable[tuple[int, int, np.ndarray, np.ndarray | None]]]


def _fields(df: DataFrame, names: Iterable[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def _raster(results: list[tuple[int, int, np.ndarray, np.ndarray | None]]) -> list[pa.Array]:
    """The columns x0, y0, w, h and v of some results."""
    flat = [r[2].ravel() for r in results]
    absent = [np.zeros(r[2].size, bool) if r[3] is None else np.broadcast_to(r[3], r[2].shape).ravel() for r in results]
    offsets = np.append(0, np.cumsum([len(f) for f in flat])).astype(np.int32)
    values = pa.array(np.concatenate(flat).astype(np.float64), mask=np.concatenate(absent)) if flat else pa.array([], pa.float64())
    sides = [pa.array([r[2].shape[axis] for r in results], pa.int32()) for axis in (2, 1)]
    return [*[pa.array([r[k] for r in results], pa.int64()) for k in (0, 1)], *sides, pa.ListArray.from_arrays(pa.array(offsets), values)]


def blocks_of(pixels: DataFrame, keys: list[str], values: tuple[str, ...] = ("z",), block: int = BLOCK) -> DataFrame:
    """Block raster of a pixel table (keys, x, y and one column per band), cut at multiples of ``block``.

    A repeated pixel counts once, with its last value as the shuffle delivers them; null values are absent.
    """
    base = pixels.select(*keys, floor_div("x", block).alias("_bx"), floor_div("y", block).alias("_by"), F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"), *[double(v).alias(f"_v{i}") for i, v in enumerate(values)])
    bands = len(values)

    def pack(table: pa.Table) -> pa.Table:
        x, y = table.column("x").to_numpy(), table.column("y").to_numpy()
        x0, y0 = table.column("_bx")[0].as_py() * block, table.column("_by")[0].as_py() * block
        out = np.zeros((bands, int(y.max()) - y0 + 1, int(x.max()) - x0 + 1))
        absent = np.ones(out.shape, bool)
        for band in range(bands):
            column = table.column(f"_v{band}")
            there = np.asarray(column.is_valid())
            out[band, y[there] - y0, x[there] - x0] = column.drop_null().to_numpy()
            absent[band, y[there] - y0, x[there] - x0] = False
        return pa.table([*[table.column(k).slice(0, 1).combine_chunks() for k in keys], *_raster([(x0, y0, out, absent)])], names=[*keys, *PLACE, "v"])

    return base.groupBy(*keys, "_bx", "_by").applyInArrow(pack, f"{_fields(base, keys)}, {RASTER}")


def pixels_of(blocks: DataFrame, keys: list[str], values: tuple[str, ...] = ("z",), absent: bool = False) -> DataFrame:
    """Pixel table of a block raster. A pixel whose first band is absent has no row, unless ``absent`` asks for it."""
    size = (F.col("w") * F.col("h")).cast("int")
    bands = [F.get(F.col("v"), F.col("_at") + k * size).alias(name) for k, name in enumerate(values)]
    first = F.posexplode_outer(F.slice("v", 1, size)).alias("_at", "_first")
    rows = blocks.select(*keys, *PLACE, "v", first).filter(F.col("_at").isNotNull() & (F.lit(absent) | F.col("_first").isNotNull()))
    return rows.select(*keys, (F.col("x0") + F.col("_at") % F.col("w")).alias("x"), (F.col("y0") + floor_div("_at", F.col("w"))).alias("y"), *bands)


def blank(rasters: DataFrame, keys: list[str], width: int, height: int, value: float = 0.0, block: int = BLOCK) -> DataFrame:
    """Rasters of one value."""
    rows = unroll(unroll(rasters.select(*keys), int_range(F.lit(0), F.lit((height - 1) // block)), "_by"), int_range(F.lit(0), F.lit((width - 1) // block)), "_bx")
    sides = {"w": F.least(F.lit(block), width - F.col("_bx") * block), "h": F.least(F.lit(block), height - F.col("_by") * block)}
    rows = rows.withColumns({"x0": F.col("_bx") * block, "y0": F.col("_by") * block, **{n: c.cast("int") for n, c in sides.items()}})
    return rows.select(*keys, *PLACE, F.array_repeat(F.lit(value), F.col("w") * F.col("h")).alias("v"))


def _cut(x: Column, y: Column, w: Column, h: Column, bands: int, own_w: str = "w", own_h: str = "h") -> Column:
    """The values of a rectangle (in pixels of the block) of all bands."""
    def line(i: Column) -> Column:
        band = F.floor(i / h).cast("int")
        return F.slice(F.col("v"), ((band * F.col(own_h) + y + i - band * h) * F.col(own_w) + x + 1).cast("int"), w)

    return F.flatten(F.transform(F.sequence(F.lit(0), h * bands - 1), line))


def _pasted(table: pa.Table, left: int, top: int, width: int, height: int, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and absent places of a rectangle from its pieces (_px, _py, _pw, _ph, _pv); the rest is absent."""
    values, absent = np.zeros((bands, height, width)), np.ones((bands, height, width), bool)
    for batch in table.to_batches():
        pieces = batch.column("_pv")
        there, offsets, child = np.asarray(pieces.is_valid()), pieces.offsets.to_numpy(), pieces.values
        gone = np.asarray(child.is_null()) if child.null_count else None
        numbers = (child.fill_null(0.0) if child.null_count else child).to_numpy(zero_copy_only=False)
        px, py, pw, ph = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_px", "_py", "_pw", "_ph"))
        for k in np.flatnonzero(there):
            x, y, w, h = int(px[k]) - left, int(py[k]) - top, int(pw[k]), int(ph[k])
            part = slice(int(offsets[k]), int(offsets[k + 1]))
            values[:, y:y + h, x:x + w] = numbers[part].reshape(bands, h, w)
            absent[:, y:y + h, x:x + w] = False if gone is None else gone[part].reshape(bands, h, w)
    return values, absent


def gather(
    blocks: DataFrame, targets: DataFrame, source_keys: list[str], keys: list[str], kernel: Kernel, facts: tuple[str, ...] = (), bands: int = 1,
    fill: float | None = None, cell: int = BLOCK,
) -> DataFrame:
    """Block raster of ``keys`` that ``kernel`` makes of a rectangle of the source for every target.

    ``targets`` has both keys, x0 and y0 (which with the keys name a target), the rectangle left, top, width,
    height in pixels of the source and the numbers in ``facts``; where it has clip_left, clip_top, clip_right and
    clip_bottom as well, pixels outside of these (the last two exclusive) count as absent. Absent pixels read as
    ``fill`` if one is given. ``cell`` should be the usual size of the blocks, as a block goes to every cell it touches.
    """
    every = list(dict.fromkeys([*keys, "x0", "y0", "left", "top", "width", "height", *facts]))
    sides = {"left": F.col("left"), "top": F.col("top"), "right": F.col("left") + F.col("width"), "bottom": F.col("top") + F.col("height")}
    if "clip_left" in targets.columns:
        sides = {s: (F.greatest if s in ("left", "top") else F.least)(c, F.col(f"clip_{s}")) for s, c in sides.items()}
    wanted = targets.select(*dict.fromkeys([*source_keys, *every]), *[c.cast("bigint").alias(f"_{s}") for s, c in sides.items()])
    spots = unroll(wanted, int_range(floor_div("_left", cell), floor_div(F.col("_right") - 1, cell)), "_gx")
    spots = unroll(spots, int_range(floor_div("_top", cell), floor_div(F.col("_bottom") - 1, cell)), "_gy")
    held = blocks.select(*[F.col(k).alias(f"_s_{k}") for k in source_keys], *[F.col(c).alias(f"_b_{c}") for c in PLACE], "v")
    held = unroll(held, int_range(floor_div("_b_x0", cell), floor_div(F.col("_b_x0") + F.col("_b_w") - 1, cell)), "_sx")
    held = unroll(held, int_range(floor_div("_b_y0", cell), floor_div(F.col("_b_y0") + F.col("_b_h") - 1, cell)), "_sy")
    on = (F.col("_gx") == F.col("_sx")) & (F.col("_gy") == F.col("_sy"))
    for k in source_keys:
        on = on & (F.col(k) == F.col(f"_s_{k}"))
    x, y = F.greatest("_left", "_b_x0"), F.greatest("_top", "_b_y0")
    right, bottom = F.least(F.col("_right"), F.col("_b_x0") + F.col("_b_w")), F.least(F.col("_bottom"), F.col("_b_y0") + F.col("_b_h"))
    # a block and a target that meet in several cells are paired in the cell of their first common pixel
    once = (x < right) & (y < bottom) & (floor_div(x, cell) == F.col("_gx")) & (floor_div(y, cell) == F.col("_gy"))
    met = spots.join(held, on).filter(residual(once)).select(*every, *[c.cast("int").alias(n) for n, c in (("_pw", right - x), ("_ph", bottom - y))], x.alias("_px"), y.alias("_py"), "_b_x0", "_b_y0", "_b_w", "_b_h", "v")
    piece = _cut((F.col("_px") - F.col("_b_x0")).cast("int"), (F.col("_py") - F.col("_b_y0")).cast("int"), F.col("_pw"), F.col("_ph"), bands, "_b_w", "_b_h")
    pieces = met.select(*every, "_px", "_py", "_pw", "_ph", piece.alias("_pv"))
    none = wanted.select(*every, *[F.lit(None).cast(t).alias(n) for n, t in (("_px", "bigint"), ("_py", "bigint"), ("_pw", "int"), ("_ph", "int"), ("_pv", "array<double>"))])
    numbers = [c for c in every if c not in keys]

    def run(table: pa.Table) -> pa.Table:
        row = {c: table.column(c)[0].as_py() for c in numbers}
        values, absent = _pasted(table, row["left"], row["top"], row["width"], row["height"], bands)
        if fill is not None:
            values[absent] = fill
            absent[:] = False
        results = list(kernel(values, absent, row))
        first = [table.column(k).combine_chunks().take(pa.array([0] * len(results), pa.int32())) for k in keys]
        return pa.table([*first, *_raster(results)], names=[*keys, *PLACE, "v"])

    both = none.unionByName(pieces)
    return both.groupBy(*keys, "x0", "y0").applyInArrow(run, f"{_fields(both, keys)}, {RASTER}")


# --- kernels: how a target is made of what it reads ------------------------------------------


def lanczos_weights(first: int, n: int, n_src: int, n_dst: int, low: int, taps: int, a: int) -> np.ndarray:
    """Weight of source position low + j for target first + i."""
    scale = n_src / n_dst
    d = ((np.arange(first, first + n)[:, None] + 0.5) * scale - 0.5 - (low + np.arange(taps))[None, :]) / max(scale, 1.0)
    x = d * np.pi
    with np.errstate(invalid="ignore", divide="ignore"):
        weight = np.where(d == 0, 1.0, a * np.sin(x) * np.sin(x / a) / (x * x))
    return np.where(np.abs(d) < a, weight, 0.0)


def _lanczos_axis(values: np.ndarray, there: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted means along the last axis over the pixels that are there."""
    total = there.astype(np.float64) @ weight.T
    reached = np.abs(total) > LEAST_WEIGHT
    return np.where(reached, (np.where(there, values, 0.0) @ weight.T) / np.where(reached, total, 1.0), 0.0), reached


def lanczos(values: np.ndarray, absent: np.ndarray, row: dict, a: int):
    wx = lanczos_weights(row["x0"], row["w"], row["src_w"], row["dst_w"], row["first_x"], row["width"], a)
    wy = lanczos_weights(row["y0"], row["h"], row["src_h"], row["dst_h"], row["first_y"], row["height"], a)
    wide, there = _lanczos_axis(values, ~absent, wx)
    high, there = _lanczos_axis(wide.swapaxes(1, 2), there.swapaxes(1, 2), wy)
    yield row["x0"], row["y0"], high.swapaxes(1, 2), ~there.swapaxes(1, 2)


def bilinear(values: np.ndarray, absent: np.ndarray, row: dict):
    """Corners of source and target on top of each other; an absent pixel counts as 0."""
    source = np.where(absent, 0.0, values)

    def axis(x0: int, w: int, n_src: int, n_dst: int, low: int):
        at = np.arange(x0, x0 + w) * ((n_src - 1.0) / (n_dst - 1.0))
        first = np.floor(at).astype(np.int64)
        return first - low, np.minimum(first + 1, n_src - 1) - low, at - first

    x, x1, fx = axis(row["x0"], row["w"], row["src_w"], row["dst_w"], row["first_x"])
    y, y1, fy = axis(row["y0"], row["h"], row["src_h"], row["dst_h"], row["first_y"])
    top = source[:, y][:, :, x] * (1.0 - fx) + source[:, y][:, :, x1] * fx
    bottom = source[:, y1][:, :, x] * (1.0 - fx) + source[:, y1][:, :, x1] * fx
    yield row["x0"], row["y0"], top * (1.0 - fy)[:, None] + bottom * fy[:, None], None


def _nearest_places(x0: int, w: int, n_src: int, n_dst: int) -> np.ndarray:
    if n_dst == 1:
        return np.zeros(w, np.int64)
    return np.minimum(np.floor(np.arange(x0, x0 + w) / (n_dst - 1.0) * (n_src - 1.0) + 0.5).astype(np.int64), n_src - 1)


def nearest(values: np.ndarray, absent: np.ndarray, row: dict):
    x = _nearest_places(row["x0"], row["w"], row["src_w"], row["dst_w"]) - row["first_x"]
    y = _nearest_places(row["y0"], row["h"], row["src_h"], row["dst_h"]) - row["first_y"]
    yield row["x0"], row["y0"], values[:, y][:, :, x], absent[:, y][:, :, x]


def copied(values: np.ndarray, absent: np.ndarray, row: dict):
    yield row["x0"], row["y0"], values, absent


def imagery(values: np.ndarray, absent: np.ndarray, row: dict):
    """Lanczos when a side shrinks, nearest otherwise; the same size passes unchanged."""
    if row["src_w"] > row["dst_w"] or row["src_h"] > row["dst_h"]:
        return lanczos(values, absent, row, 3)
    return nearest(values, absent, row)


def slope_of(values: np.ndarray, absent: np.ndarray, cell_size: float = 1.0) -> np.ndarray:
    """Slope in degrees of every pixel of a single band by central differences; an absent neighbour counts as a border."""
    z, there = np.pad(values[0], 1), np.pad(~absent[0], 1)

    def gradient(before: tuple[slice, slice], after: tuple[slice, slice]) -> np.ndarray:
        own = values[0]
        gap = there[before].astype(np.float64) + there[after]
        rise = np.where(there[after], z[after], own) - np.where(there[before], z[before], own)
        return np.where(gap > 0, rise / (np.maximum(gap, 1.0) * cell_size), 0.0)

    core = slice(1, -1)
    dx = gradient((core, slice(None, -2)), (core, slice(2, None)))
    dy = gradient((slice(None, -2), core), (slice(2, None), core))
    return np.degrees(np.arctan(np.sqrt(dx * dx + dy * dy)))


def _slope_kernel(values: np.ndarray, absent: np.ndarray, row: dict):
    steep = slope_of(values, absent)
    y, x = row["y0"] - row["first_y"], row["x0"] - row["first_x"]
    core = (slice(y, y + row["h"]), slice(x, x + row["w"]))
    yield row["x0"], row["y0"], steep[core][None], absent[0][core][None]


# --- operators -------------------------------------------------------------------------------

WAYS: dict[str, Kernel] = {
    "copy": copied, "bilinear": bilinear, "nearest": nearest, "imagery": imagery, "slope": _slope_kernel,
    "lanczos2": lambda v, a, r: lanczos(v, a, r, 2), "lanczos3": lambda v, a, r: lanczos(v, a, r, 3),
}


def _reads(how: str, n_src: Column, n_dst: Column, first: Column, last: Column) -> tuple[Column, Column]:
    """First and last source position that targets ``first`` to ``last`` of an axis read."""
    zero, end = F.lit(0).cast("bigint"), n_src.cast("bigint") - 1
    if how == "copy":
        return first, last
    if how == "slope":
        return F.greatest(zero, first - 1), F.least(end, last + 1)
    span_src, span_dst = n_src.cast("double") - 1.0, n_dst.cast("double") - 1.0
    if how == "bilinear":
        scale = span_src / span_dst
        return F.floor(first * scale), F.least(F.floor(last * scale) + 1, end)
    near = [F.when(span_dst == 0, zero).otherwise(F.least(F.floor(at / F.nullif(span_dst, F.lit(0.0)) * span_src + 0.5), end)) for at in (first, last)]
    if how == "nearest":
        return near[0], near[1]
    scale = n_src.cast("double") / n_dst.cast("double")
    reach = F.greatest(scale, F.lit(1.0)) * (2.0 if how == "lanczos2" else 3.0)
    low = F.greatest(zero, F.ceil((first + 0.5) * scale - 0.5 - reach - SLACK))
    high = F.least(end, F.floor((last + 0.5) * scale - 0.5 + reach + SLACK))
    return low, high


FACTS = ("w", "h", "first_x", "first_y", "src_w", "src_h", "dst_w", "dst_h")


def _targets(frames: DataFrame, how: str, block: int) -> DataFrame:
    """Blocks of the rasters that frames ask for, with the rectangle of the source that each reads."""
    if how == "bilinear":
        tall = (F.col("dst_w") < 2) | (F.col("dst_h") < 2)
        frames = frames.withColumn("dst_w", F.when(tall, F.raise_error(F.lit("the target needs at least 2x2 pixels"))).otherwise(F.col("dst_w")))
    if how in ("copy", "slope"):
        frames = frames.withColumns({"dst_w": F.col("src_w"), "dst_h": F.col("src_h")})
    rows = frames
    for axis, side in (("y", "h"), ("x", "w")):
        rows = unroll(rows, int_range(F.lit(0), floor_div(F.col(f"dst_{side}") - 1, block)), f"_{axis}")
        rows = rows.withColumn(f"{axis}0", F.col(f"_{axis}") * block)
        rows = rows.withColumn(side, F.least(F.lit(block).cast("bigint"), F.col(f"dst_{side}") - F.col(f"{axis}0")).cast("int"))
        n_src, n_dst, first = F.col(f"src_{side}"), F.col(f"dst_{side}"), F.col(f"{axis}0")
        last = first + F.col(side) - 1
        if how == "imagery":
            shrinks = (F.col("src_w") > F.col("dst_w")) | (F.col("src_h") > F.col("dst_h"))
            reads = [F.when(shrinks, a).otherwise(b) for a, b in zip(_reads("lanczos3", n_src, n_dst, first, last), _reads("nearest", n_src, n_dst, first, last))]
        else:
            reads = _reads(how, n_src, n_dst, first, last)
        rows = rows.withColumns({f"first_{axis}": reads[0].cast("bigint"), f"_last_{axis}": reads[1].cast("bigint")})
    rows = rows.withColumns({
        "left": F.col("left") + F.col("first_x"), "top": F.col("top") + F.col("first_y"),
        "width": (F.col("_last_x") - F.col("first_x") + 1).cast("int"), "height": (F.col("_last_y") - F.col("first_y") + 1).cast("int"),
    })
    return rows


def resampled(
    blocks: DataFrame, frames: DataFrame, source_keys: list[str], keys: list[str], how: str, bands: int = 1, fill: float | None = None,
    block: int = BLOCK, cell: int = BLOCK,
) -> DataFrame:
    """One raster per frame, cut from the source and brought to its size in one step.

    ``frames`` has both keys, left, top, src_w, src_h (the window in pixels of the source), dst_w and dst_h (for "copy" and
    "slope" the size of the window) and, if wanted, the sides of ``gather``'s clip. ``how`` is one of ``WAYS``. All bands
    share weights. The size of a block of the result, or of the source, changes no value.
    """
    return gather(blocks, _targets(frames, how, block), source_keys, keys, WAYS[how], FACTS, bands, fill, cell)


def cliffs(
    blocks: DataFrame, frames: DataFrame, source_keys: list[str], keys: list[str], threshold: float, fill: float | None = None, block: int = BLOCK,
    cell: int = BLOCK,
) -> DataFrame:
    """255 where the slope inside a frame reaches the threshold, else 0, resized to dst_w x dst_h by nearest pixel; absent pixels are 0."""
    sized = frames.withColumnsRenamed({"dst_w": "out_w", "dst_h": "out_h"})

    def kernel(values: np.ndarray, absent: np.ndarray, row: dict):
        for x0, y0, steep, gone in _slope_kernel(values, absent, row):
            places = []
            for start, size, n_src, n_dst in ((x0, row["w"], row["src_w"], row["out_w"]), (y0, row["h"], row["src_h"], row["out_h"])):
                hits = _nearest_places(0, n_dst, n_src, n_dst)
                places.append(np.flatnonzero((hits >= start) & (hits < start + size)))
                places.append(hits[places[-1]] - start)
            tx, sx, ty, sy = places
            if len(tx) and len(ty):
                mask = np.where(~gone[0] & (steep[0] >= threshold), 255.0, 0.0)
                yield int(tx[0]), int(ty[0]), mask[np.ix_(sy, sx)][None], None

    return gather(blocks, _targets(sized, "slope", block), source_keys, keys, kernel, (*FACTS, "out_w", "out_h"), 1, fill, cell)


def slopes(blocks: DataFrame, keys: list[str], block: int = BLOCK, cell_size: float = 1.0) -> DataFrame:
    """Slopes of a raster whose blocks lie at multiples of ``block``: each sends a line to its four neighbours, once.

    A hole counts as a border. Blocks without pixels of their own give none.
    """
    w, h, home_x, home_y = F.col("w"), F.col("h"), floor_div("x0", block), floor_div("y0", block)
    one, zero = F.lit(1), F.lit(0)

    def piece(dx: int, dy: int, x: Column, y: Column, pw: Column, ph: Column) -> Column:
        return F.struct(
            (home_x + dx).alias("_bx"), (home_y + dy).alias("_by"), (F.col("x0") + x).alias("_px"), (F.col("y0") + y).alias("_py"), pw.cast("int").alias("_pw"),
            ph.cast("int").alias("_ph"), F.lit(dx == dy == 0).alias("_own"), _cut(x.cast("int"), y.cast("int"), pw.cast("int"), ph.cast("int"), 1).alias("_pv"),
        )

    sent = F.array(piece(0, 0, zero, zero, w, h), piece(-1, 0, zero, zero, one, h), piece(1, 0, w - 1, zero, one, h), piece(0, -1, zero, zero, w, one), piece(0, 1, zero, h - 1, w, one))
    pieces = blocks.select(*keys, F.explode_outer(sent).alias("_p")).select(*keys, "_p.*")

    def run(table: pa.Table) -> pa.Table:
        own = np.flatnonzero(table.column("_own").to_numpy())
        results = []
        if len(own):
            x0, y0, pw, ph = (table.column(c)[int(own[0])].as_py() for c in ("_px", "_py", "_pw", "_ph"))
            # a neighbour's line may run on where this block ends; only what touches it counts
            values, absent = _framed(table, x0 - 1, y0 - 1, pw + 2, ph + 2)
            steep = slope_of(values, absent, cell_size)[1:-1, 1:-1]
            results.append((x0, y0, steep[None], absent[:, 1:-1, 1:-1]))
        first = [table.column(k).combine_chunks().take(pa.array([0] * len(results), pa.int32())) for k in keys]
        return pa.table([*first, *_raster(results)], names=[*keys, *PLACE, "v"])

    return pieces.groupBy(*keys, "_bx", "_by").applyInArrow(run, f"{_fields(blocks, keys)}, {RASTER}")


def _framed(table: pa.Table, left: int, top: int, width: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``_pasted`` for one band, with pieces that reach over the rectangle cut off."""
    low = min(left, *table.column("_px").to_pylist()), min(top, *table.column("_py").to_pylist())
    right = max(left + width, *[x + w for x, w in zip(table.column("_px").to_pylist(), table.column("_pw").to_pylist())])
    bottom = max(top + height, *[y + h for y, h in zip(table.column("_py").to_pylist(), table.column("_ph").to_pylist())])
    values, absent = _pasted(table, low[0], low[1], right - low[0], bottom - low[1], 1)
    x, y = left - low[0], top - low[1]
    return values[:, y:y + height, x:x + width], absent[:, y:y + height, x:x + width]


def resampled_nearest(blocks: DataFrame, keys: list[str], src_w, src_h, dst_w, dst_h) -> DataFrame:
    """Nearest resize of a single band without a shuffle: each block makes the targets that read it.

    Sizes are numbers or columns of ``blocks``.
    """
    def size(n) -> Column:
        return (F.col(n) if isinstance(n, str) else F.lit(n)).cast("bigint")

    def targets(start: str, side: str, n_src: Column, n_dst: Column) -> Column:
        """Target positions whose source lies in the block; a stretch of consecutive ones."""
        span_src, span_dst = n_src.cast("double") - 1.0, n_dst.cast("double") - 1.0
        safe = F.nullif(span_src, F.lit(0.0))
        flat = (span_src == 0) | (span_dst == 0)
        low = F.when(flat, F.lit(0.0)).otherwise((F.col(start) - 0.5) / safe * span_dst)
        high = F.when(flat, span_dst).otherwise((F.col(start) + F.col(side) - 0.5) / safe * span_dst)
        near = int_range(F.greatest(F.lit(0).cast("bigint"), F.ceil(low - SLACK)), F.least(n_dst - 1, F.floor(high + SLACK)))
        return F.filter(near, lambda t: (_hit(t, n_src, n_dst) >= F.col(start)) & (_hit(t, n_src, n_dst) < F.col(start) + F.col(side)))

    def _hit(t: Column, n_src: Column, n_dst: Column) -> Column:
        span_dst = n_dst.cast("double") - 1.0
        return F.when(span_dst == 0, F.lit(0).cast("bigint")).otherwise(F.least(F.floor(t / F.nullif(span_dst, F.lit(0.0)) * (n_src.cast("double") - 1.0) + 0.5), n_src - 1))

    sw, sh, dw, dh = (size(n) for n in (src_w, src_h, dst_w, dst_h))
    rows = blocks.select(*keys, *PLACE, "v", sw.alias("_sw"), sh.alias("_sh"), dw.alias("_dw"), dh.alias("_dh"))
    sw, sh, dw, dh = (F.col(f"_{n}") for n in ("sw", "sh", "dw", "dh"))
    rows = rows.select("*", targets("x0", "w", sw, dw).alias("_tx"), targets("y0", "h", sh, dh).alias("_ty")).filter((F.size("_tx") > 0) & (F.size("_ty") > 0))
    rows = rows.select("*", F.transform("_tx", lambda t: _hit(t, sw, dw) - F.col("x0")).alias("_sx"))
    lines = F.transform("_ty", lambda t: F.transform("_sx", lambda x: F.get(F.col("v"), ((_hit(t, sh, dh) - F.col("y0")) * F.col("w") + x).cast("int"))))
    rows = rows.select(*keys, "_tx", "_ty", F.flatten(lines).alias("_lines"))  # a step of its own, as names inside of lambdas would mean the new w
    return rows.select(*keys, F.get("_tx", F.lit(0)).alias("x0"), F.get("_ty", F.lit(0)).alias("y0"), F.size("_tx").alias("w"), F.size("_ty").alias("h"), F.col("_lines").alias("v"))


def stats(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Minimum, maximum, range and no-data flag per raster; one without values gives 0, 0."""
    valid = F.filter("v", lambda z: ~is_nodata(z))
    per = blocks.select(*keys, F.array_min(valid).alias("_lo"), F.array_max(valid).alias("_hi"), F.exists("v", is_nodata).alias("_no"))
    out = per.groupBy(*keys).agg(
        F.coalesce(F.min("_lo"), F.lit(0.0)).alias("z_min"), F.coalesce(F.max("_hi"), F.lit(0.0)).alias("z_max"), F.coalesce(F.bool_or("_no"), F.lit(False)).alias("has_nodata"))
    return out.withColumn("z_range", F.col("z_max") - F.col("z_min"))


def quantized(blocks: DataFrame, keys: list[str], levels: DataFrame | None = None) -> DataFrame:
    """The blocks with ``q``, 16-bit heights scaled per raster; ``levels`` are its statistics, if they are known."""
    known = (levels if levels is not None else stats(blocks, keys)).select(*keys, "z_min", "z_range")
    return blocks.join(known, keys).withColumn("q", F.transform("v", lambda z: heights.quantize_u16(z, F.col("z_min"), F.col("z_range")))).drop("z_min", "z_range")
