"""Tiles kept as tables, laid out for what is asked of them again and again.

A bucketed store has all cells of a tile in one bucket: an aggregate of its tiles
has no shuffle. An ordered store has tiles in the order of their index over all
files, with an index of what each file holds: ranges of tiles and slices read the
files that can have them, and no others."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import shape as sh
from .array import NDArray
from .tile import TiledArray


@dataclass(frozen=True)
class StoredTiles(TiledArray):
    """Tiles whose cells have their tile's index stored beside them."""

    @property
    def cells(self) -> DataFrame:
        return self.array.df


def _laid(tiles: TiledArray) -> DataFrame:
    return tiles.cells.select(*tiles.keys, *tiles.array.dims, "value")


# --- Without a shuffle


def save_bucketed(tiles: TiledArray, table: str, buckets: int, path: str | None = None) -> StoredTiles:
    """Write the cells as a table of so many buckets by tile; path: a folder for its files, else the warehouse's.

    One task writes a bucket, and one will read it, so a bucket should fit what
    a task is to do; all cells of one tile are in one bucket whatever its size."""
    writer = _laid(tiles).repartition(buckets, *tiles.keys).write.bucketBy(buckets, *tiles.keys).sortBy(*tiles.keys)
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return open_bucketed(tiles.array.df.sparkSession, table, tiles.extraction, tiles.array.shape, tiles.array.name)


def open_bucketed(spark: SparkSession, table: str, extraction: Sequence[int], shape: Sequence[int] | None = None, name: str = "value") -> StoredTiles:
    extraction = sh.checked(extraction, 1)
    return StoredTiles(NDArray(spark.table(table), len(extraction), tuple(shape) if shape else None, name), extraction)


# --- In order


@dataclass(frozen=True)
class OrderedStore:
    """cells: Parquet files of tiles in order. index: file, n_cells, and the least and largest of each g and c in it."""

    spark: SparkSession
    folder: str
    extraction: tuple[int, ...]

    @property
    def index(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/index")

    def _files(self, window: Sequence[tuple[str, int, int]]) -> list[str]:
        """Files that can have rows with first <= column < end for all of the window: a name for each file that is read."""
        kept = self.index
        for column, first, end in window:
            kept = kept.where((F.col(f"high_{column}") >= first) & (F.col(f"low_{column}") < end))
        return [r["file"] for r in kept.select("file").orderBy("file").collect()]

    def _read(self, window: Sequence[tuple[str, int, int]]) -> StoredTiles:
        files = self._files(window)
        whole = self.spark.read.schema(self.spark.read.parquet(f"{self.folder}/cells").schema)
        df = whole.parquet(*files) if files else whole.parquet(f"{self.folder}/cells").where("false")
        for column, first, end in window:
            df = df.where((F.col(column) >= first) & (F.col(column) < end))
        return StoredTiles(NDArray(df, len(self.extraction)), self.extraction)

    def tiles(self, first: Sequence[int] | None = None, end: Sequence[int] | None = None) -> StoredTiles:
        """Tiles with first <= g < end in each dimension; all without them."""
        return self._read([(f"g{i}", a, b) for i, (a, b) in enumerate(zip(first or (), end or (), strict=True))])

    def slice(self, corner: Sequence[int], shape: Sequence[int]) -> NDArray:
        """The cells of a rectangle."""
        found = self._read([(f"c{i}", c, c + s) for i, (c, s) in enumerate(zip(corner, shape, strict=True))]).array
        return NDArray(found.df.select(*found.dims, "value"), found.rank)


def save_ordered(tiles: TiledArray, folder: str, files: int | None = None) -> OrderedStore:
    """Write the cells in the order of their tiles, over so many files at most (by default, as many as a shuffle has partitions), and the index.

    Files end where they may, also inside a tile, so a tile of any size is
    spread over as many as it takes."""
    spark, order = tiles.array.df.sparkSession, [*tiles.keys, *tiles.array.dims]
    cells = _laid(tiles)
    laid = cells.repartitionByRange(files, *order) if files else cells.repartitionByRange(*order)
    laid.sortWithinPartitions(*order).write.parquet(f"{folder}/cells")
    bounds = [f(c).alias(f"{n}_{c}") for c in order for n, f in (("low", F.min), ("high", F.max))]
    written = spark.read.parquet(f"{folder}/cells")
    written.groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n_cells"), *bounds).write.parquet(f"{folder}/index")
    return OrderedStore(spark, folder, tiles.extraction)


def table_name(prefix: str = "tiles") -> str:
    return f"{prefix}_{uuid4().hex}"
