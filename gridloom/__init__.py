"""Structural analytics over n-dimensional arrays on Spark: coordinates and values as DataFrames, tiles as groups."""

from .operators.array import NDArray
from .operators.blocks import BlockArray
from .operators.tile import TiledArray
from .plans.config import TileQuery

__all__ = ["BlockArray", "NDArray", "TileQuery", "TiledArray"]
