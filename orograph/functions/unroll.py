"""One row per array element.

``explode`` lets the optimizer add ``size(array) > 0`` as a filter and push it down, which
evaluates a computed array twice per row and copies its whole expression into the filter. The
outer form does not; the rows of empty arrays are dropped afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unroll(df: DataFrame, array: Column, name: str) -> DataFrame:
    return df.select("*", F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def unroll_indexed(df: DataFrame, array: Column, index: str, name: str) -> DataFrame:
    return df.select("*", F.posexplode_outer(array).alias(index, name)).filter(F.col(index).isNotNull())


def residual(condition: Column) -> Column:
    """A join condition the optimizer does not derive ``isnotnull`` filters from.

    Such filters are pushed below the projections and evaluate the computed columns of the
    condition a second time, with their whole expressions copied.
    """
    return F.coalesce(condition, F.lit(False))
