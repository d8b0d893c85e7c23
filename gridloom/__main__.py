"""python -m gridloom average|max|median|identity INPUT OUTPUT [-D key=value ...]
python -m gridloom generate OUTPUT --shape 80,180,360,50 [--variable NAME] [--gaussian SEED]

The first three name the operator; identity takes it from the key operator.
generate writes NetCDF files of a dense array, whose values are its flattened
indexes, or normally distributed with --gaussian."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.array import NDArray
from .operators.tile import run_query
from .plans.config import TileQuery
from .sources import netcdf3, text

#: Fixed value: the standard deviation of normally distributed cells, whose sign is dropped.
SPREAD = 40


def generate(args: list[str], spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gridloom generate")
    parser.add_argument("output")
    parser.add_argument("--shape", required=True, type=lambda raw: tuple(int(x) for x in raw.split(",")))
    parser.add_argument("--variable", default="windspeed1")
    parser.add_argument("--gaussian", type=int, metavar="SEED")
    given = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName("gridloom generate").getOrCreate()
    value = None if given.gaussian is None else lambda i: (F.abs(F.randn(given.gaussian)) * SPREAD).cast("int")
    netcdf3.write(NDArray.from_range(spark, given.shape, value), given.output, given.variable)
    return 0


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = sys.argv[1:] if args is None else args
    if args[:1] == ["generate"]:
        return generate(args[1:], spark)
    parser = argparse.ArgumentParser(prog="gridloom", description=__doc__)
    parser.add_argument("tool", choices=("average", "max", "median", "identity"))
    parser.add_argument("input")
    parser.add_argument("output")
    parser.add_argument("-D", action="append", default=[], metavar="key=value", dest="conf")
    given = parser.parse_args(args)
    query = TileQuery.from_conf(dict(x.split("=", 1) for x in given.conf))
    if given.tool != "identity":
        query = query.with_(operator=given.tool)
    if not query.operator:
        print("identity needs -D operator=average|max|simpleMax|median|simpleMedian|nulltest", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName(f"gridloom {query.operator}").getOrCreate()
    array = NDArray.read(spark, given.input, query)
    text.write(run_query(array, query), given.output, array.name)
    return 0


if __name__ == "__main__":
    sys.exit(main())
