"""Resampling of pixel tables.

Every source pixel computes by itself which target pixels it takes part in. Nearest needs no
shuffle at all, bilinear needs one aggregation with map-side combining, Lanczos one shuffle of
pixels per axis, behind which its sums are made; none of them joins a target grid with the source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import col, double, floor_div, round_half_up
from ..functions.unroll import unroll
from ..session import shuffle_partitions
from .grids import fill_holes, int_range


SLACK = 1e-6
#: A target whose taps weigh less in sum, as it lies in a hole, has no value.
LEAST_WEIGHT = 1e-9
#: Lines of a raster whose taps are summed together.
LINES = 64


def _last(n: Column) -> Column:
    return n.cast("double") - 1.0


def _candidates(low: Column, high: Column, n_dst: Column) -> Column:
    """Whole numbers between two bounds, widened by more than the bounds can be off."""
    zero = F.lit(0).cast("bigint")
    return int_range(
        F.greatest(zero, F.ceil(low - SLACK)), F.least(n_dst.cast("bigint") - 1, F.floor(high + SLACK))
    )


def _sizes(*sizes) -> tuple:
    """Sizes as columns, and the names of those that have to travel with the pixels."""
    return (*[col(s) for s in sizes], list(dict.fromkeys(s for s in sizes if isinstance(s, str))))


def _at_least_two(n: Column, given) -> Column:
    message = "the target needs at least 2x2 pixels"
    if isinstance(given, int):
        if given < 2:
            raise ValueError(message)
        return n
    return F.when(n < 2, F.raise_error(F.lit(message))).otherwise(n)


def _linear_axis(df: DataFrame, src: str, n_src: Column, n_dst: Column, dst: str) -> DataFrame:
    """Target positions that use source position ``src`` as lower or upper neighbour."""
    scale = _last(n_src) / F.nullif(_last(n_dst), F.lit(0.0))
    flat = scale == 0
    safe = F.nullif(scale, F.lit(0.0))
    low = F.when(flat, F.lit(0.0)).otherwise((F.col(src) - 1) / safe)
    high = F.when(flat, _last(n_dst)).otherwise((F.col(src) + 1) / safe)
    out = unroll(df, _candidates(low, high, n_dst), dst)
    first = F.floor(F.col(dst) * scale)
    second = F.least(first + 1, n_src.cast("bigint") - 1)
    out = out.withColumn(f"_{dst}_low", first == F.col(src)).withColumn(f"_{dst}_high", second == F.col(src))
    return out.filter(F.col(f"_{dst}_low") | F.col(f"_{dst}_high"))


def resample_bilinear(
    pixels: DataFrame, keys: list[str], src_w, src_h, dst_w, dst_h, value: str = "z"
) -> DataFrame:
    """Resize with the corners of source and target on top of each other.

    Sizes are numbers or columns of ``pixels`` that are constant per key. The four neighbours
    are gathered by a conditional maximum, so the result does not depend on summation order. An
    absent pixel counts as 0, and so does a target all of whose neighbours are absent.
    """
    sw, sh, dw, dh, carried = _sizes(src_w, src_h, dst_w, dst_h)
    base = pixels.select(*keys, "x", "y", double(value).alias("_z"), *carried)
    dw, dh = _at_least_two(dw, dst_w), _at_least_two(dh, dst_h)
    spread = _linear_axis(base, "x", sw, dw, "tx")
    spread = _linear_axis(spread, "y", sh, dh, "ty")

    def corner(a: str, b: str) -> Column:
        return F.coalesce(F.max(F.when(F.col(a) & F.col(b), F.col("_z"))), F.lit(0.0))

    got = spread.groupBy(*keys, "tx", "ty", *carried).agg(
        corner("_tx_low", "_ty_low").alias("_v00"), corner("_tx_high", "_ty_low").alias("_v01"),
        corner("_tx_low", "_ty_high").alias("_v10"), corner("_tx_high", "_ty_high").alias("_v11"),
    )
    sx, sy = F.col("tx") * (_last(sw) / _last(dw)), F.col("ty") * (_last(sh) / _last(dh))
    fx, fy = sx - F.floor(sx), sy - F.floor(sy)
    top = F.col("_v00") * (1.0 - fx) + F.col("_v01") * fx
    bottom = F.col("_v10") * (1.0 - fx) + F.col("_v11") * fx
    out = got.select(*keys, F.col("tx").alias("x"), F.col("ty").alias("y"), (top * (1.0 - fy) + bottom * fy).alias(value))
    sizes = base.select(*keys, *carried).distinct().withColumns({"width": col(dst_w), "height": col(dst_h)})
    return fill_holes(out, sizes, keys, {value: 0.0})


def _nearest_axis(df: DataFrame, src: str, n_src: Column, n_dst: Column, dst: str) -> DataFrame:
    span_src, span_dst = _last(n_src), _last(n_dst)
    flat = (span_src == 0) | (span_dst == 0)
    safe = F.nullif(span_src, F.lit(0.0))
    low = F.when(flat, F.lit(0.0)).otherwise((F.col(src) - 0.5) / safe * span_dst)
    high = F.when(flat, span_dst).otherwise((F.col(src) + 0.5) / safe * span_dst)
    out = unroll(df, _candidates(low, high, n_dst), dst)
    # A target of a single pixel reads index 0.
    hit = F.when(span_dst == 0, F.lit(0).cast("bigint")).otherwise(
        round_half_up(F.col(dst) / F.nullif(span_dst, F.lit(0.0)) * span_src)
    )
    return out.filter(F.least(hit, n_src.cast("bigint") - 1) == F.col(src))


def resample_nearest(
    pixels: DataFrame, keys: list[str], src_w, src_h, dst_w, dst_h, values: tuple[str, ...] = ("v",)
) -> DataFrame:
    """Nearest resize. Each target reads one source pixel, so no row leaves its partition."""
    spread = _nearest_axis(pixels, "x", col(src_w), col(dst_w), "_tx")
    spread = _nearest_axis(spread, "y", col(src_h), col(dst_h), "_ty")
    return spread.select(*keys, F.col("_tx").alias("x"), F.col("_ty").alias("y"), *values)


def lanczos_weight(distance: Column, a: int) -> Column:
    x = distance * math.pi
    inside = float(a) * F.sin(x) * F.sin(x / float(a)) / F.nullif(x * x, F.lit(0.0))
    return F.when(distance == 0, F.lit(1.0)).when(F.abs(distance) < float(a), inside).otherwise(F.lit(0.0))


def _lanczos_axis(df, keys, axis, other, n_src, n_dst, a, value, aggregated_sizes):
    scale = n_src.cast("double") / n_dst.cast("double")
    stretch = F.greatest(scale, F.lit(1.0))
    reach = stretch * float(a)
    low = (F.col(axis) - reach + 0.5) / scale - 0.5
    high = (F.col(axis) + reach + 0.5) / scale - 0.5
    # A pixel has several taps, so pixels are shuffled, not their taps: what follows stays within the lines.
    dealt = df.withColumn("_lines", floor_div(other, LINES)).repartition(shuffle_partitions(df), *keys, "_lines")
    spread = unroll(dealt, _candidates(low, high, n_dst), "_t")
    spread = spread.withColumn("_d", ((F.col("_t") + 0.5) * scale - 0.5 - F.col(axis)) / stretch)
    spread = spread.filter(F.abs("_d") < float(a)).withColumn("_w", lanczos_weight(F.col("_d"), a))
    sums = spread.groupBy(*keys, "_lines", F.col("_t").alias(axis), other, *aggregated_sizes).agg(
        F.sum(F.col("_w") * F.col(value)).alias("_v"), F.sum("_w").alias("_w")
    )
    reached = sums.filter(F.abs("_w") > LEAST_WEIGHT)
    return reached.withColumn(value, F.col("_v") / F.nullif("_w", F.lit(0.0))).drop("_v", "_w", "_lines")


def resample_lanczos(
    pixels: DataFrame, keys: list[str], src_w, src_h, dst_w, dst_h, a: int = 3, value: str = "v"
) -> DataFrame:
    """Separable Lanczos resize; taps outside the raster are dropped and the rest renormalised."""
    sw, sh, dw, dh, carried = _sizes(src_w, src_h, dst_w, dst_h)
    base = pixels.select(
        *keys, F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"), double(value).alias(value), *carried
    )
    wide = _lanczos_axis(base, keys, "x", "y", sw, dw, a, value, carried)
    high = _lanczos_axis(wide, keys, "y", "x", sh, dh, a, value, carried)
    return high.select(*keys, "x", "y", value)


def resample_imagery(
    pixels: DataFrame, keys: list[str], src_w: int, src_h: int, dst_w: int, dst_h: int, value: str = "v"
) -> DataFrame:
    """Lanczos when a side shrinks, nearest otherwise; same size passes unchanged."""
    if (src_w, src_h) == (dst_w, dst_h):
        return pixels.select(*keys, "x", "y", value)
    if src_w > dst_w or src_h > dst_h:
        return resample_lanczos(pixels, keys, src_w, src_h, dst_w, dst_h, 3, value)
    return resample_nearest(pixels, keys, src_w, src_h, dst_w, dst_h, (value,))
