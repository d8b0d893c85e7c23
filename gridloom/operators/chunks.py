"""Chunks: rectangles of cells as rows, with their values in row-major order.

A chunk relation has corner and shape (ARRAY<INT>) and values. Where chunks hold
whole tiles, local_tiles() finishes the tiles inside each chunk, without a
shuffle."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import shape as sh
from .array import NDArray


def to_chunks(array: NDArray, chunk: Sequence[int]) -> DataFrame:
    """Chunks of one shape (smaller at the array's end). Needs a dense array without repeated coordinates: cells that are missing would close up."""
    whole = array.shape_columns()
    tiles = array.tile(chunk)
    corner = sh.corner_columns(tiles.keys, chunk)
    extent = [F.least(F.lit(c), (F.lit(d) if isinstance(d, int) else d) - at).cast("int") for c, d, at in zip(chunk, whole, corner, strict=True)]
    place = sh.flat_column(whole, array.dims)  # its order is row-major inside a chunk, too
    placed = tiles.cells.withColumn("_at", place)
    grouped = placed.groupBy(*tiles.keys).agg(F.array_sort(F.collect_list(F.struct(F.col("_at").alias("at"), F.col("value").alias("v")))).alias("cells"))
    return grouped.select(F.array(*corner).alias("corner"), F.array(*extent).alias("shape"), F.transform("cells", lambda x: x["v"]).alias("values"))


def to_cells(chunks: DataFrame, rank: int) -> NDArray:
    """One row for each value, at its coordinate."""
    rows = chunks.select("corner", "shape", F.posexplode("values").alias("at", "value"))
    columns = []
    for i in range(rank):
        inner = F.lit(1)
        for j in range(i + 1, rank):
            inner = inner * F.get("shape", F.lit(j))
        step = F.call_function("div", F.col("at"), inner)
        columns.append((F.get("corner", F.lit(i)) + (step % F.get("shape", F.lit(i)) if i else step)).cast("int").alias(f"c{i}"))
    return NDArray(rows.select(*columns, "value"), rank)


def local_tiles(chunks: DataFrame, extraction: Sequence[int], operator: str) -> DataFrame:
    """average, max or median (as TiledArray has them) of tiles that each lie inside one chunk: a chunk's corner must be a multiple of the extraction shape, else the query fails."""
    extraction = sh.checked(extraction, 1)
    kind = chunks.schema["values"].dataType.elementType
    arrow = pa.int32() if operator == "average" else to_arrow_type(kind)
    rules = {"average": lambda v: int(np.trunc(v.mean())) if v.dtype.kind == "f" else _truncated_mean(v), "max": np.max, "median": lambda v: np.partition(v, len(v) // 2)[len(v) // 2]}
    if operator not in rules:
        raise ValueError(f"no such operator: {operator!r}; there are {', '.join(rules)}")
    rule, names = rules[operator], [f"g{i}" for i in range(len(extraction))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found = [], []
            for corner, shape, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if any(c % e for c, e in zip(corner, extraction, strict=True)):
                    raise ValueError(f"the chunk at {corner} isn't aligned to {extraction}")
                block = values.values.to_numpy(zero_copy_only=False).reshape(shape)
                for tile in np.ndindex(*sh.grid(shape, extraction)):
                    inside = tuple(slice(t * e, (t + 1) * e) for t, e in zip(tile, extraction, strict=True))
                    keys.append([c // e + t for c, e, t in zip(corner, extraction, tile, strict=True)])
                    found.append(rule(block[inside].ravel()))
            columns = list(zip(*keys, strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns), pa.array(found, arrow)], names=[*names, "value"])

    fields = ", ".join(f"{n} int" for n in names)
    return chunks.select("corner", "shape", "values").mapInArrow(run, f"{fields}, value {'int' if operator == 'average' else kind.simpleString()}")


def _truncated_mean(v: np.ndarray) -> int:
    total = int(v.sum(dtype=np.int64))
    return total // len(v) if total >= 0 else -(-total // len(v))


def bounding_tiles(rectangles: DataFrame, extraction: Sequence[int]) -> DataFrame:
    """For each row with corner and shape (ARRAY<INT>): all tiles that it touches (g0, ...), with the corner and shape of what they share."""
    extraction = sh.checked(extraction, 1)
    out = rectangles
    for i, e in enumerate(extraction):
        first, last = F.get("corner", F.lit(i)), F.get("corner", F.lit(i)) + F.get("shape", F.lit(i)) - 1
        out = out.where(F.get("shape", F.lit(i)) > 0).withColumn(f"g{i}", F.explode(F.sequence(sh.div(first, e).cast("int"), sh.div(last, e).cast("int"))))
    n = len(extraction)
    corner, shape = ([F.get(c, F.lit(i)) for i in range(n)] for c in ("corner", "shape"))
    low, width = sh.clipped_columns([f"g{i}" for i in range(n)], extraction, corner, shape)
    return out.select(*rectangles.columns, *(f"g{i}" for i in range(n)), *(c.alias(f"low{i}") for i, c in enumerate(low)), *(c.alias(f"width{i}") for i, c in enumerate(width)))
