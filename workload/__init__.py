"""Queries of the library on the given tables, with the SQL that checks them."""

from . import blocks, exports, packaging, rasters, scalars, scatters, shapes  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
