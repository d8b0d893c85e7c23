"""Several files as one array: overlaid, or one after another along the records."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .array import NDArray


def combine(arrays: Sequence[NDArray]) -> NDArray:
    """All cells of all arrays, at their own coordinates."""
    ranks = {a.rank for a in arrays}
    if len(ranks) != 1:
        raise ValueError(f"arrays of one rank are needed, not of {sorted(ranks)}")
    shapes = [a.shape for a in arrays]
    shape = tuple(map(max, zip(*shapes, strict=True))) if all(shapes) else None
    return replace(arrays[0], df=reduce(DataFrame.unionByName, (a.df for a in arrays)), shape=shape)


def concat(arrays: Sequence[NDArray]) -> NDArray:
    """Each array begins at the record where the one before it ends; tiles may span both."""
    out, offset = [], 0  # a number, or a sum of scalar subqueries
    for a in arrays:
        out.append(a.shifted(offset))
        offset = offset + a.shape_columns()[0]
    known = all(a.shape for a in arrays)
    return replace(combine(out), shape=(offset, *map(max, zip(*(a.shape[1:] for a in arrays), strict=True))) if known else None)


def concat_by(array_df: DataFrame, file: str, rank: int) -> NDArray:
    """concat() of the arrays that a column names, in the order of its values; rows of array_df are c0, ..., value and that column."""
    lengths = array_df.groupBy(file).agg((F.max("c0") + 1).alias("length"))
    before = Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    offsets = lengths.select(file, F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))  # a row for each file
    moved = array_df.join(offsets, file).withColumn("c0", (F.col("c0") + F.col("offset")).cast("int"))
    return NDArray(moved.select(*(f"c{i}" for i in range(rank)), "value"), rank)
