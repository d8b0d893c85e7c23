"""How an array is cut into rectangles that tasks read.

Rectangles never affect results; they decide how much one task reads, and with
query-dependent cuts, whether tiles along the records stay whole."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import shape as sh

Rectangle = tuple[tuple[int, ...], tuple[int, ...]]  # corner, shape


def record_step(mode: str, shape: Sequence[int], blocks: int = 1, first_extraction: int | None = None) -> int:
    """Records in one rectangle of the modes "record" and "proportional"; first_extraction makes them whole tiles."""
    step = 1 if mode == "record" else max(1, shape[0] // max(1, blocks))
    return step if first_extraction is None else max(step // first_extraction, 1) * first_extraction


def by_records(shape: Sequence[int], step: int, low: int = 0, high: int | None = None) -> Iterator[Rectangle]:
    """Slabs of step records, the last one shorter; only those parts with low <= record < high."""
    high = shape[0] if high is None else min(high, shape[0])
    for first in range(max(low, 0) // step * step, high, step):
        a, b = max(first, low), min(first + step, high)
        if a < b:
            yield (a, *([0] * (len(shape) - 1))), (b - a, *shape[1:])


def of_range(shape: Sequence[int], first: int, end: int) -> Iterator[Rectangle]:
    """Largest rectangles, in order, that make up the cells first to end in row-major order."""
    steps = sh.strides(shape)
    while first < end:
        i = next(i for i, s in enumerate(steps) if first % s == 0 and s <= end - first)
        corner = sh.inflate(shape, first)
        n = min((end - first) // steps[i], shape[i] - corner[i])
        yield corner, (*([1] * i), n, *shape[i + 1 :])
        first += n * steps[i]


def by_blocks(shape: Sequence[int], begin: int, cell_bytes: int, block_bytes: int) -> Iterator[tuple[int, Rectangle]]:
    """(block of the file, rectangle): rectangles whose cells begin in one block, for a variable stored without gaps from begin."""
    total, cell = sh.size(shape), 0
    while cell < total:
        block = (begin + cell * cell_bytes) // block_bytes
        end = min(total, -(-((block + 1) * block_bytes - begin) // cell_bytes))
        for r in of_range(shape, cell, end):
            yield block, r
        cell = end


def clip(r: Rectangle, window: Sequence[tuple[int, int]]) -> Rectangle | None:
    """What a rectangle shares with (first, end) of each dimension; dimensions that window doesn't have stay whole."""
    corner, shape = list(r[0]), list(r[1])
    for i, (first, end) in enumerate(window):
        a, b = max(corner[i], first), min(corner[i] + shape[i], end)
        if a >= b:
            return None
        corner[i], shape[i] = a, b - a
    return tuple(corner), tuple(shape)


def cell_offsets(cells: DataFrame, shape: Sequence[int | Column], begin: int, cell_bytes: int, record_bytes: int | Column | None = None) -> DataFrame:
    """cells (c0, c1, ...) with offset: where a cell's bytes begin in its file. record_bytes is the distance of records for a variable with an unlimited dimension."""
    dims = [f"c{i}" for i in range(len(shape))]
    if record_bytes is None:
        at = sh.flat_column(shape, dims) * cell_bytes
    else:
        inner = sh.flat_column(shape[1:], dims[1:]) if len(shape) > 1 else F.lit(0)
        at = F.col("c0").cast("bigint") * record_bytes + inner * cell_bytes
    return cells.withColumn("offset", at + F.lit(begin))
