"""Row-major coordinate arithmetic. The last dimension is the fastest.

Functions on columns build plain arithmetic that stays in generated code;
division is DIV, never a division of doubles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import prod

from pyspark.sql import Column
from pyspark.sql import functions as F


def checked(shape: Sequence[int], least: int = 0) -> tuple[int, ...]:
    out = tuple(int(x) for x in shape)
    if not out or any(x < least for x in out):
        raise ValueError(f"a shape needs dimensions of at least {least}: {shape!r}")
    return out


def size(shape: Sequence[int]) -> int:
    return prod(checked(shape))


def byte_size(shape: Sequence[int], cell_bytes: int) -> int:
    return size(shape) * cell_bytes


def strides(shape: Sequence[int]) -> tuple[int, ...]:
    """Cells from one index of a dimension to the next."""
    shape = checked(shape)
    return tuple(prod(shape[i + 1 :]) for i in range(len(shape)))


def flatten(shape: Sequence[int], at: Sequence[int]) -> int:
    if len(shape) != len(at):
        raise ValueError(f"ranks differ: {shape!r}, {at!r}")
    return sum(s * c for s, c in zip(strides(shape), at, strict=True))


def inflate(shape: Sequence[int], number: int) -> tuple[int, ...]:
    """The inverse of flatten()."""
    return tuple(number // s % d if i else number // s for i, (s, d) in enumerate(zip(strides(shape), checked(shape), strict=True)))


def grid(shape: Sequence[int], extraction: Sequence[int]) -> tuple[int, ...]:
    """Tiles along each dimension."""
    return tuple(-(-d // e) for d, e in zip(checked(shape), checked(extraction, 1), strict=True))


# --- Columns


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def div(c: Column | str, by: int | Column) -> Column:
    """Integer division that drops the fraction."""
    if isinstance(by, Column):
        return F.call_function("div", _column(c), by)
    return F.call_function("div", _column(c), F.lit(int(by))) if by != 1 else _column(c)


def stride_columns(shape: Sequence[int | Column]) -> list[int | Column]:
    """strides() of a shape that may be known only when the query runs."""
    if not any(isinstance(d, Column) for d in shape):
        return list(strides(shape))
    wide = [d.cast("bigint") if isinstance(d, Column) else d for d in shape]
    return [reduce(lambda a, b: a * b, wide[i + 1 :], 1) for i in range(len(wide))]


def flat_column(shape: Sequence[int | Column], at: Sequence[Column | str]) -> Column:
    """flatten() of columns, as BIGINT."""
    return reduce(lambda a, b: a + b, (_column(c).cast("bigint") * (s if isinstance(s, Column) else F.lit(s)) for c, s in zip(at, stride_columns(shape), strict=True)))


def inflated_columns(shape: Sequence[int | Column], number: Column | str) -> list[Column]:
    """inflate() of a column, each INT."""
    out = []
    for i, (s, d) in enumerate(zip(stride_columns(shape), shape, strict=True)):
        c = div(number, s)
        out.append((c % (d if isinstance(d, Column) else F.lit(d)) if i else c).cast("int"))
    return out


def tile_columns(at: Sequence[Column | str], extraction: Sequence[int], names: Sequence[str] | None = None) -> list[Column]:
    """The index of the tile that holds a coordinate: g0, g1, ..., each INT."""
    names = names or [f"g{i}" for i in range(len(at))]
    return [div(c, e).cast("int").alias(n) for c, e, n in zip(at, checked(extraction, 1), names, strict=True)]


def corner_columns(tile: Sequence[Column | str], extraction: Sequence[int]) -> list[Column]:
    """The first coordinate of a tile."""
    return [(_column(g) * F.lit(e)).cast("int") for g, e in zip(tile, checked(extraction, 1), strict=True)]


def clipped_columns(tile: Sequence[Column | str], extraction: Sequence[int], corner: Sequence[Column], shape: Sequence[Column]) -> tuple[list[Column], list[Column]]:
    """Corner and shape of what a tile and a rectangle share."""
    low, width = [], []
    for g, e, c, s in zip(tile, checked(extraction, 1), corner, shape, strict=True):
        first = F.greatest(_column(g) * F.lit(e), c)
        low.append(first.cast("int"))
        width.append((F.least((_column(g) + 1) * F.lit(e), c + s) - first).cast("int"))
    return low, width
