"""Number rules shared by every operator.

Rounding sends halves up (-2.5 becomes -2), text becomes a number only when the whole
text is one, and an integer prefix is enough where only a prefix is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
HEX_PATTERN = r"^\s*0[xX][0-9a-fA-F]+\s*$"


def col(value) -> Column:
    """A column name, a Column or a plain number, as a Column."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        return F.col(value)
    return F.lit(value)


def double(value) -> Column:
    return col(value).cast("double")


def round_half_up(value) -> Column:
    return F.floor(col(value) + F.lit(0.5))


def clamp(value, low, high) -> Column:
    return F.greatest(col(low), F.least(col(high), col(value)))


def floor_div(value, size) -> Column:
    return F.floor(col(value) / col(size))


def is_nodata(z) -> Column:
    """True for the values a raster uses for "nothing measured here"."""
    z = col(z)
    return z.isNull() | F.isnan(z) | (z == F.lit(float("-inf")))


def is_finite(z) -> Column:
    z = col(z)
    return z.isNotNull() & ~F.isnan(z) & (F.abs(z) < F.lit(float("inf")))


def _hex_value(text: Column) -> Column:
    """Value of a hexadecimal text with its two-character prefix, of any length."""
    digits = F.filter(F.split(F.substring(text, 3, 1 << 30), ""), lambda c: c != "")
    return F.aggregate(digits, F.lit(0.0), lambda acc, c: acc * 16.0 + F.instr(F.lit("0123456789ABCDEF"), c) - 1)


def parse_number(text) -> Column:
    """The number written in a text, or NULL.

    An empty text is missing, one of blanks only is 0, hexadecimal is accepted. ``try_cast``
    alone would also take ``1d``, ``5f`` and ``NaN``.
    """
    text = col(text)
    value = (
        F.when(text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double"))
        .when(text.rlike(HEX_PATTERN), _hex_value(F.upper(F.trim(text))))
        .when((text != "") & (F.trim(text) == ""), F.lit(0.0))
    )
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def leading_integer(text) -> Column:
    """Integer prefix of a text, 0 when there is none: ``2;3`` gives 2."""
    digits = F.regexp_extract(F.coalesce(col(text), F.lit("")), r"^\s*([+-]?\d+)", 1)
    return F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))


def is_whole(value) -> Column:
    value = col(value)
    return value == F.floor(value)
