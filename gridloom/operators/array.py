"""Arrays as cell relations: a column for each coordinate, and one for the value."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import shape as sh
from ..plans.config import INT_MAX, INT_MIN, TileQuery

if TYPE_CHECKING:
    from .tile import TiledArray


@dataclass(frozen=True)
class NDArray:
    """df has INT columns c0, c1, ... (coordinates, not negative) and value; shape may be unknown (None).

    A coordinate may occur several times (arrays overlaid) or not at all."""

    df: DataFrame
    rank: int
    shape: tuple[int, ...] | None = None
    name: str = "value"

    @property
    def dims(self) -> list[str]:
        return [f"c{i}" for i in range(self.rank)]

    # --- Where arrays come from

    @classmethod
    def from_table(cls, df: DataFrame, dims: Sequence[Column | str], value: Column | str, shape: Sequence[int] | None = None, name: str = "value") -> NDArray:
        """Columns of a table as coordinates and value. Rows with a null coordinate or value are no cells."""
        columns = [(F.col(d) if isinstance(d, str) else d).cast("int").alias(f"c{i}") for i, d in enumerate(dims)]
        cells = df.select(*columns, (F.col(value) if isinstance(value, str) else value).alias("value")).dropna()
        return cls(cells, len(columns), sh.checked(shape) if shape else None, name)

    @classmethod
    def from_range(cls, spark: SparkSession, shape: Sequence[int], value: Callable[[Column], Column] | None = None, partitions: int | None = None) -> NDArray:
        """A dense array; a cell's value is value(its flattened index), by default that index."""
        shape = sh.checked(shape)
        ids = spark.range(0, sh.size(shape), 1, partitions)
        made = (value or (lambda i: i.cast("int")))(F.col("id"))
        return cls(ids.select(*(c.alias(f"c{i}") for i, c in enumerate(sh.inflated_columns(shape, "id"))), made.alias("value")), len(shape), shape)

    @classmethod
    def from_list_column(cls, df: DataFrame, dims: Sequence[Column | str], values: Column | str, value: Callable[[Column], Column] = lambda v: v, shape: Sequence[int] | None = None) -> NDArray:
        """A list column as the last dimension; value makes a cell's value of a list element."""
        keys = [(F.col(d) if isinstance(d, str) else d).cast("int").alias(f"c{i}") for i, d in enumerate(dims)]
        last = f"c{len(keys)}"
        cells = df.select(*keys, F.posexplode(values).alias(last, "_v"))
        return cls(cells.select(*(f"c{i}" for i in range(len(keys))), last, value(F.col("_v")).alias("value")).dropna(), len(keys) + 1, sh.checked(shape) if shape else None)

    @classmethod
    def read(cls, spark: SparkSession, path: str, query: TileQuery = TileQuery(), options: Mapping[str, str] | None = None) -> NDArray:
        """A variable of NetCDF-3 files (see sources.netcdf3). Its record range is pruned when files are split, and filtered exactly."""
        from ..sources import netcdf3

        return netcdf3.read_array(spark, path, query, dict(options or {}))

    # --- What can be done with them

    def where_records(self, low: int = INT_MIN, high: int = INT_MAX) -> NDArray:
        """Cells with low <= c0 < high."""
        df = self.df
        if low > INT_MIN:
            df = df.where(F.col("c0") >= low)
        if high < INT_MAX:
            df = df.where(F.col("c0") < high)
        return replace(self, df=df)

    def slice(self, corner: Sequence[int], shape: Sequence[int]) -> NDArray:
        """The cells of a rectangle; coordinates stay as they are."""
        keep = [F.col(d).between(c, c + s - 1) for d, c, s in zip(self.dims, corner, sh.checked(shape), strict=True)]
        df = self.df
        for k in keep:
            df = df.where(k)
        return replace(self, df=df)

    def shifted(self, records: int | Column) -> NDArray:
        """The same cells, so many records later."""
        others = [c for c in self.df.columns if c != "c0"]
        shape = None if self.shape is None or isinstance(records, Column) else (self.shape[0] + records, *self.shape[1:])
        return replace(self, df=self.df.select((F.col("c0") + records).cast("int").alias("c0"), *others), shape=shape)

    def shape_columns(self) -> list[int | Column]:
        """The shape, or scalar subqueries for the least one that holds all cells: nothing runs before the query does."""
        if self.shape is not None:
            return list(self.shape)
        return [self.df.agg((F.coalesce(F.max(d), F.lit(-1)) + 1).alias("n")).scalar() for d in self.dims]

    def measured_shape(self) -> tuple[int, ...]:
        """The shape, or the least one that holds all cells, in numbers: one pass over the coordinates, now."""
        if self.shape is not None:
            return self.shape
        row = self.df.agg(*(F.max(d) for d in self.dims)).first()
        return tuple(0 if x is None else x + 1 for x in row)

    def with_flat_id(self, shape: Sequence[int | Column] | None = None) -> DataFrame:
        """df and gid: the flattened coordinate."""
        return self.df.withColumn("gid", sh.flat_column(shape or self.shape_columns(), self.dims))

    def tile(self, extraction: Sequence[int] | None = None) -> TiledArray:
        from .tile import TiledArray

        ones = (1,) * self.rank
        extraction = sh.checked(extraction or ones, 1)
        if len(extraction) != self.rank:
            raise ValueError(f"the extraction shape {extraction} has another rank than the array: {self.rank}")
        return TiledArray(self, extraction)
