"""Aggregates over the tiles of an array.

A tile is a group by c_i DIV e_i; Spark aggregates partially before the one
shuffle there is, on the tile's columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import shape as sh
from ..plans.config import TileQuery
from ..sources.folders import shared_folder
from .array import NDArray


@dataclass(frozen=True)
class TiledArray:
    array: NDArray
    extraction: tuple[int, ...]

    @property
    def keys(self) -> list[str]:
        return [f"g{i}" for i in range(self.array.rank)]

    @property
    def cells(self) -> DataFrame:
        """The array's columns with g0, g1, ..."""
        return self.array.df.select("*", *sh.tile_columns(self.array.dims, self.extraction))

    def where_tile(self, first: int | None = None, end: int | None = None, dim: int = 0) -> TiledArray:
        """Tiles first <= g < end of a dimension, as a range of coordinates: a scan can be pruned by these, not by a division."""
        df, d, e = self.array.df, self.array.dims[dim], self.extraction[dim]
        if first is not None:
            df = df.where(F.col(d) >= first * e)
        if end is not None:
            df = df.where(F.col(d) < end * e)
        return replace(self, array=replace(self.array, df=df))

    def agg(self, *aggregates: Column) -> DataFrame:
        """Any Spark aggregates of value, for each tile."""
        return self.cells.groupBy(*self.keys).agg(*aggregates)

    @property
    def _integral(self) -> bool:
        return isinstance(self.array.df.schema["value"].dataType, T.IntegralType)

    def _extras(self, details: bool) -> list[Column]:
        n = F.count(F.lit(1))
        return [n.alias("n_cells"), (n == sh.size(self.extraction)).alias("is_full")] if details else []

    def average(self, details: bool = False) -> DataFrame:
        """The mean, its fraction dropped (towards zero), as INT: from an exact sum for integers."""
        total = F.call_function("div", F.sum("value"), F.count("value")) if self._integral else F.avg("value")
        return self.agg(total.cast("int").alias("value"), *self._extras(details))

    def average_double(self, details: bool = False) -> DataFrame:
        return self.agg(F.avg("value").alias("value"), *self._extras(details))

    def max(self, details: bool = False) -> DataFrame:
        return self.agg(F.max("value").alias("value"), *self._extras(details))

    def max_by_flat_id(self) -> DataFrame:
        """max() grouped by one BIGINT, the flattened tile index over the array's shape."""
        shape = self.array.shape_columns()
        gid = sh.flat_column(shape, sh.tile_columns(self.array.dims, self.extraction)).alias("gid")
        grouped = self.array.df.select(gid, "value").groupBy("gid").agg(F.max("value").alias("value"))
        return grouped.select("gid", *(c.alias(k) for k, c in zip(self.keys, sh.inflated_columns(shape, "gid"), strict=True)), "value")

    def median(self, details: bool = False, full_tiles_only: bool = False, plan: str = "percentile", counters: int = 4096) -> DataFrame:
        """The upper median: of n values in order, the one at n DIV 2.

        plan "percentile" holds a tile's distinct values in memory while it
        aggregates; "histogram" counts (tile, value) first and finds the middle
        of sorted counts, which can spill, for very large tiles; "collect" sorts
        the collected values; "refine", for whole numbers, keeps so many counters
        for a tile whatever its cells, and reads the array several times."""
        kind = self.array.df.schema["value"].dataType
        if plan == "percentile":
            out = self.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value DESC)").cast(kind).alias("value"), *self._extras(True))
        elif plan == "collect":
            values = F.sort_array(F.collect_list("value"))
            out = self.agg(F.get(values, F.call_function("div", F.size(values), F.lit(2)).cast("int")).alias("value"), *self._extras(True))
        elif plan == "histogram":
            out = upper_middle(self.agg_by_value(), self.keys).withColumn("is_full", F.col("n_cells") == sh.size(self.extraction))
        elif plan == "refine":
            out = self._refined(counters).withColumn("is_full", F.col("n_cells") == sh.size(self.extraction))
        else:
            raise ValueError(f"no such plan: {plan}")
        out = out.where("is_full") if full_tiles_only else out
        return out if details else out.select(*self.keys, "value")

    def _refined(self, counters: int) -> DataFrame:
        """(tile, value, n_cells): the upper median by refining ranges of values.

        A tile begins with the range of its values. Each pass cuts the range into
        at most so many equal parts, counts the cells in each, and goes on with
        the part that holds the middle, until that has one value: three passes
        at most for INT with 4096 counters, beside the one for the ranges. A task
        holds counters of the tiles that it reads alone, and gives these to the
        shuffle, not cells. Ranges are kept in the shared folder between passes;
        Spark broadcasts them to the cells if their files are small enough for
        that, and else joins them by tile."""
        kind = self.array.df.schema["value"].dataType
        if not isinstance(kind, T.IntegralType):
            raise ValueError(f"the plan refine needs whole numbers, not {kind.simpleString()}")
        wide = "decimal(20,0)" if isinstance(kind, T.LongType) else "bigint"  # the width of a range of BIGINT has no BIGINT
        cells = self.cells.where("value IS NOT NULL").select(*self.keys, F.col("value").cast(wide).alias("value"))
        spark = cells.sparkSession

        def kept(df: DataFrame) -> DataFrame:
            folder = shared_folder(spark, "ranges")
            df.write.parquet(folder)
            return spark.read.parquet(folder)

        state = ("low", "high", "at", "n_cells")
        first = cells.groupBy(*self.keys).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count(F.lit(1)).alias("n_cells"))
        now = kept(first.withColumn("at", F.call_function("div", F.col("n_cells"), F.lit(2))))  # at: the place of the middle in the range
        found = now.where("low = high")
        left = now.where("low < high")
        while not left.isEmpty():
            width = (F.call_function("div", F.col("high") - F.col("low"), F.lit(counters)) + 1).cast(wide)
            inside = cells.join(left.withColumn("width", width), self.keys).where(F.col("value").between(F.col("low"), F.col("high")))
            counted = inside.groupBy(*self.keys, "at", "n_cells", F.call_function("div", F.col("value") - F.col("low"), F.col("width")).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
            upto = F.sum("n").over(Window.partitionBy(*self.keys).orderBy("part"))
            ranked = counted.withColumn("upto", upto).where((F.col("upto") > F.col("at")) & (F.col("upto") - F.col("n") <= F.col("at")))
            now = kept(ranked.withColumn("at", F.col("at") - (F.col("upto") - F.col("n"))).select(*self.keys, *state))
            found = found.unionByName(now.where("low = high"))
            left = now.where("low < high")
        return found.select(*self.keys, F.col("low").cast(kind).alias("value"), "n_cells")

    def agg_by_value(self) -> DataFrame:
        """(tile, value, n): how often each value occurs."""
        return self.cells.groupBy(*self.keys, "value").agg(F.count(F.lit(1)).alias("n"))

    def completeness(self) -> DataFrame:
        """n_cells and is_full of each tile that has cells."""
        return self.agg(*self._extras(True))

    def tile_counts(self) -> DataFrame:
        """One row: n_cells, n_full and n_not_full, the tiles that have all their cells and those that have some."""
        tiles = self.completeness()
        return tiles.agg(F.coalesce(F.sum("n_cells"), F.lit(0)).alias("n_cells"), F.count_if("is_full").alias("n_full"), F.count_if(~F.col("is_full")).alias("n_not_full"))

    def null_scan(self) -> DataFrame:
        """Reads all cells and gives one constant row, or none if there are no cells: what the scan alone costs."""
        seen = self.array.df.agg(F.count("value").alias("n"), *(F.max(d) for d in self.array.dims))
        return seen.where("n > 0").select(F.lit(0).alias("g0"), F.lit(-(2**31)).cast("int").alias("value"))

    def catalog(self) -> DataFrame:
        """Each tile with cells: its index, corner and flattened id."""
        shape = self.array.shape_columns()
        tiles = self.cells.select(*self.keys).distinct()
        corner = [c.alias(f"corner{i}") for i, c in enumerate(sh.corner_columns(self.keys, self.extraction))]
        return tiles.select(*self.keys, *corner, sh.flat_column(shape, self.keys).alias("gid"))

    def run(self, operator: str, details: bool = False) -> DataFrame:
        """One of plans.config.OPERATORS."""
        by_name = {"average": self.average, "max": self.max, "simplemax": self.max, "median": self.median, "simplemedian": self.median, "nulltest": self.null_scan}
        if operator not in by_name:
            raise ValueError(f"no such operator: {operator!r}; there are {', '.join(by_name)}")
        return by_name[operator](details=True) if details and operator != "nulltest" else by_name[operator]()


def upper_middle(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, value, n_cells) of (keys, value, n): the upper median of values that occur n times each. Sorted counts can spill."""
    tile = Window.partitionBy(*keys)
    up_to = tile.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("seen", F.sum("n").over(up_to)).withColumn("n_cells", F.sum("n").over(tile))
    middle = F.call_function("div", F.col("n_cells"), F.lit(2))
    return ranked.where((F.col("seen") > middle) & (F.col("seen") - F.col("n") <= middle)).select(*keys, "value", "n_cells")


def run_query(array: NDArray, query: TileQuery, seen: Observation | None = None, tiles: Observation | None = None) -> DataFrame:
    """A whole query: records, tiles, operator, and the order or the number of partitions of the result.

    seen, if given, has n_cells and n_invalid (those outside the range of
    records) of all cells read once the result has been computed. Filters aren't
    pushed below it, and cells of records that the scan leaves out aren't seen:
    read the array with noscan=False to count these, too. tiles, if given, has
    n_tiles, n_full and n_not_full of the result in the same run."""
    if seen is not None:
        inside = F.col("c0").between(query.low, query.high - 1)
        array = replace(array, df=array.df.observe(seen, F.count(F.lit(1)).alias("n_cells"), F.count_if(~inside).alias("n_invalid")))
    tiled = array.where_records(query.low, query.high).tile(query.extraction_shape)
    if tiles is None or query.operator == "nulltest":
        out = tiled.run(query.operator)
    else:
        out = tiled.run(query.operator, details=True).observe(tiles, F.count(F.lit(1)).alias("n_tiles"), F.count_if("is_full").alias("n_full"), F.count_if(~F.col("is_full")).alias("n_not_full"))
        out = out.drop("n_cells", "is_full")
    if query.ordered:
        return out.orderBy(*(c for c in out.columns if c != "value"))
    return out.repartition(query.num_partitions) if query.num_partitions > 1 else out
