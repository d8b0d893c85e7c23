"""Aggregates over tiles from blocks, without a row for each cell.

A block is a rectangle of cells in one row: corner, shape and values. A task
finishes each tile whose cells are all in one block. Of a tile that several
blocks share, each gives a partial state, and only these states are shuffled and
merged: a sum and a count, a maximum, or for the median the sorted distinct
values with their counts. What the tasks found is written to the shared folder
once, so that finished tiles and states are told apart without reading the
blocks twice."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import shape as sh
from ..plans.config import TileQuery
from ..sources.folders import shared_folder
from .tile import upper_middle

OPERATORS = ("average", "max", "median")
#: States of one tile and block: distinct values in one row.
STATE_VALUES = 1 << 16


@dataclass(frozen=True)
class BlockArray:
    """blocks: corner and shape (array<int>) and values (array of numbers, row-major; nulls are no cells). shape: the array's, if known: a tile that its end cuts off is whole inside it. overlaid: blocks may have cells at one coordinate, so no tile is finished before all have been seen."""

    blocks: DataFrame
    shape: tuple[int, ...] | None = None
    overlaid: bool = False

    @classmethod
    def read(cls, spark: SparkSession, path: str, query: TileQuery = TileQuery(), options: dict[str, str] | None = None) -> BlockArray:
        """Blocks of NetCDF files. Of a slice, a tile counts the cells inside it."""
        from ..sources import netcdf3

        blocks, shape = netcdf3.read_blocks(spark, path, query, options)
        window, limited = netcdf3.window_of(query)
        whole = shape if not limited and window[0][0] <= 0 and window[0][1] >= shape[0] else None
        return cls(blocks, whole, query.multi_file_mode != "concat")

    def tile(self, extraction: Sequence[int]) -> BlockTiles:
        return BlockTiles(self, sh.checked(extraction, 1))


@dataclass(frozen=True)
class BlockTiles:
    array: BlockArray
    extraction: tuple[int, ...]

    @property
    def keys(self) -> list[str]:
        return [f"g{i}" for i in range(len(self.extraction))]

    @property
    def _kind(self) -> T.DataType:
        return self.array.blocks.schema["values"].dataType.elementType

    def states(self, operator: str) -> DataFrame:
        """(g0, ..., whole, n, value, total, distinct, counts): of each tile in each block, the finished value if the tile is whole there, else its partial state."""
        if operator not in OPERATORS:
            raise ValueError(f"no such operator: {operator!r}; there are {', '.join(OPERATORS)}")
        extraction, bounds, overlaid, kind = self.extraction, self.array.shape, self.array.overlaid, self._kind
        whole_numbers = isinstance(kind, T.IntegralType)
        value_type = pa.int32() if operator == "average" else to_arrow_type(kind)
        total_type, list_type = (pa.int64() if whole_numbers else pa.float64()), pa.list_(to_arrow_type(kind))
        names = [*self.keys, "whole", "n", "value", "total", "distinct", "counts"]

        types = [*[pa.int32()] * len(extraction), pa.bool_(), pa.int64(), value_type, total_type, list_type, pa.list_(pa.int64())]

        def found_in(corner: list[int], shape: list[int], values: pa.Scalar) -> Iterator[pa.RecordBatch]:
            raw = values.values
            held = raw.is_valid().to_numpy(zero_copy_only=False).reshape(shape) if raw.null_count else None
            block = (raw.fill_null(0) if raw.null_count else raw).to_numpy(zero_copy_only=False).reshape(shape)
            inner = [(-(-c // e), (c + s) // e) for c, s, e in zip(corner, shape, extraction, strict=True)]
            if held is not None or any(a >= b for a, b in inner) or (overlaid and operator == "median"):
                inner = [(0, 0)] * len(extraction)
            else:  # the tiles that lie inside with their full extent, all at once
                keys = [np.ascontiguousarray(k.ravel(), np.int32) for k in np.meshgrid(*(np.arange(a, b, dtype=np.int32) for a, b in inner), indexing="ij")]
                part = block[tuple(slice(a * e - c, b * e - c) for (a, b), e, c in zip(inner, extraction, corner, strict=True))]
                part = part.reshape([x for (a, b), e in zip(inner, extraction, strict=True) for x in (b - a, e)])
                rank = len(extraction)
                cells = part.transpose([*range(0, 2 * rank, 2), *range(1, 2 * rank, 2)]).reshape(len(keys[0]), -1)
                value, total = _of_rows(operator, cells, whole_numbers)
                n = len(keys[0])
                sums = pa.nulls(n, total_type) if total is None else pa.array(total, total_type)
                yield pa.RecordBatch.from_arrays([*map(pa.array, keys), pa.array(np.full(n, not overlaid)), pa.array(np.full(n, cells.shape[1])), pa.array(value, value_type), sums, pa.nulls(n, list_type), pa.nulls(n, types[-1])], names=names)
            rows = []
            for tile, inside, full in _touched(corner, shape, extraction, bounds):
                if not all(a <= g < b for g, (a, b) in zip(tile, inner, strict=True)):
                    cells = block[inside].ravel() if held is None else block[inside].ravel()[held[inside].ravel()]
                    if len(cells):
                        rows += [(*tile, *r) for r in _state(operator, cells, full and not overlaid, whole_numbers)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for corner, shape, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    yield from found_in(corner, shape, values)

        fields = ", ".join(f"{k} int" for k in self.keys)
        sql = kind.simpleString()
        return self.array.blocks.select("corner", "shape", "values").mapInArrow(run, f"{fields}, whole boolean, n long, value {'int' if operator == 'average' else sql}, total {'long' if whole_numbers else 'double'}, distinct array<{sql}>, counts array<long>")

    def run(self, operator: str, details: bool = False) -> DataFrame:
        """average, max or median, as TiledArray has them, for each tile with cells."""
        found = self.states(operator)
        folder = shared_folder(found.sparkSession, "tiles")
        found.write.parquet(folder)
        found = found.sparkSession.read.parquet(folder)
        edges = merged(found.where("NOT whole"), self.keys, operator, self._kind)
        out = found.where("whole").select(*self.keys, "value", "n").unionByName(edges)
        extras = [F.col("n").alias("n_cells"), (F.col("n") == sh.size(self.extraction)).alias("is_full")] if details else []
        return out.select(*self.keys, "value", *extras)


def merged(states: DataFrame, keys: Sequence[str], operator: str, kind: T.DataType) -> DataFrame:
    """(keys, value, n): one row for each tile of partial states. The one shuffle there is."""
    n = F.sum("n").alias("n")
    if operator == "average":
        exact = isinstance(kind, T.IntegralType)
        mean = F.call_function("div", F.sum("total"), F.sum("n")) if exact else F.sum("total") / F.sum("n")
        return states.groupBy(*keys).agg(mean.cast("int").alias("value"), n)
    if operator == "max":
        return states.groupBy(*keys).agg(F.max("value").alias("value"), n)
    counted = states.select(*keys, F.explode(F.arrays_zip("distinct", "counts")).alias("x")).select(*keys, F.col("x.distinct").alias("value"), F.col("x.counts").alias("k"))
    return upper_middle(counted.groupBy(*keys, "value").agg(F.sum("k").alias("n")), keys).select(*keys, "value", F.col("n_cells").alias("n"))


def _of_rows(operator: str, cells: np.ndarray, whole_numbers: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """The value of each row of cells, and its sum for the average."""
    n = cells.shape[1]
    if operator == "max":
        return cells.max(axis=1), None
    if operator == "median":
        return np.partition(cells, n // 2, axis=1)[:, n // 2], None
    if whole_numbers:
        total = cells.sum(axis=1, dtype=np.int64)
        return np.sign(total) * (np.abs(total) // n), total
    total = cells.sum(axis=1, dtype=np.float64)
    return np.trunc(total / n), total


def _state(operator: str, cells: np.ndarray, whole: bool, whole_numbers: bool) -> Iterator[tuple]:
    """(whole, n, value, total, distinct, counts) of one tile's cells: one row, or as many as its distinct values fill."""
    n = len(cells)
    if operator == "median" and not whole:
        distinct, counts = np.unique(cells, return_counts=True)
        for i in range(0, len(distinct), STATE_VALUES):
            k = counts[i : i + STATE_VALUES]
            yield False, int(k.sum()), None, None, distinct[i : i + STATE_VALUES], k
        return
    value, total = _of_rows(operator, cells.reshape(1, n), whole_numbers)
    yield whole, n, value[0], None if total is None else total[0], None, None


def _touched(corner: Sequence[int], shape: Sequence[int], extraction: Sequence[int], bounds: Sequence[int] | None) -> Iterator[tuple[tuple[int, ...], tuple[slice, ...], bool]]:
    """(tile, its part of the block, whether the block has all of it) of each tile that a block touches."""
    axes = []
    for i, (c, s, e) in enumerate(zip(corner, shape, extraction, strict=True)):
        parts = []
        for g in range(c // e, -(-(c + s) // e)):
            first, end = g * e, (g + 1) * e if bounds is None else min((g + 1) * e, bounds[i])
            parts.append((g, slice(max(first, c) - c, min(end, c + s) - c), c <= first and end <= c + s))
        axes.append(parts)
    for at in np.ndindex(*map(len, axes)):
        picked = [axis[k] for axis, k in zip(axes, at, strict=True)]
        yield tuple(p[0] for p in picked), tuple(p[1] for p in picked), all(p[2] for p in picked)
