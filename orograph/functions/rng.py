"""mulberry32 as a pure function of (seed, draw number).

The generator only adds a constant to its state, so draw n needs no earlier draw and every
row can compute its own numbers on any executor.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbers import col

MASK32 = 0xFFFFFFFF
STEP = 0x6D2B79F5


def _mul32(a: Column, b: Column) -> Column:
    """Product modulo 2**32 of two values below 2**32; no step leaves the signed 64-bit range."""
    low, high = b.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(b, 16)
    return (a * low + (a * high).bitwiseAND(F.lit(0xFFFF)) * F.lit(65536)).bitwiseAND(F.lit(MASK32))


def _state(seed, n) -> Column:
    step_no = (col(n).cast("bigint") + F.lit(1)).bitwiseAND(F.lit(MASK32))
    return (_mul32(step_no, F.lit(STEP).cast("bigint")) + col(seed).cast("bigint")).bitwiseAND(F.lit(MASK32))


def _stir(s: Column) -> Column:
    return _mul32(s.bitwiseXOR(F.shiftrightunsigned(s, 15)), s.bitwiseOR(F.lit(1)))


def _blend(t: Column) -> Column:
    u = _mul32(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(F.lit(61)))
    return (t + u).bitwiseAND(F.lit(MASK32)).bitwiseXOR(t)


def _fraction(t: Column) -> Column:
    return t.bitwiseXOR(F.shiftrightunsigned(t, 14)) / F.lit(4294967296.0)


def draw(seed, n) -> Column:
    """The n-th number (from 0) in [0, 1) of the sequence started with ``seed``, as one expression."""
    return _fraction(_blend(_stir(_state(seed, n))))


def with_draw(df: DataFrame, seed, n, name: str) -> DataFrame:
    """The same as a column, in steps. The one expression repeats its parts and is long; plans
    with several draws would outgrow the size of a compiled method."""
    out = df.withColumn("_rng", _state(seed, n))
    for step in (_stir, _blend):
        out = out.withColumn("_rng", step(F.col("_rng")))
    return out.withColumn(name, _fraction(F.col("_rng"))).drop("_rng")


def draw_array(seed: int, n: np.ndarray) -> np.ndarray:
    """The same numbers for an array of draw numbers, for code that runs inside a task."""
    with np.errstate(over="ignore"):
        state = ((n.astype(np.uint64) + np.uint64(1)) * np.uint64(STEP) + np.uint64(seed & MASK32)) & np.uint64(MASK32)
        state = state.astype(np.uint32)
        t = (state ^ (state >> np.uint32(15))) * (state | np.uint32(1))
        t = (t + (t ^ (t >> np.uint32(7))) * (t | np.uint32(61))) ^ t
        return (t ^ (t >> np.uint32(14))).astype(np.float64) / 4294967296.0
