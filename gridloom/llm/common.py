"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts spell it: [\x20\x09-\x0D].
SPACE = b" \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ensure_shared_dir(spark: SparkSession) -> None:
    """Make checkpoint() usable, in the folder that the cluster names in spark.checkpoint.dir; without one there is no place that all machines see."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(folder)


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Bound what a task hands to Python at once by bytes, unless the session has a bound of its own. Results don't depend on it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(most))


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left joined to right by a key of which left may have very many rows.

    A second key, which the first gives, makes Spark shuffle both sides for this
    join; only then does adaptive execution split a large partition of it."""
    again = "_again"
    return left.withColumn(again, F.hash(key)).join(right.withColumn(again, F.hash(key)), [key, again], how).drop(again)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there, so that it is computed once and survives lost executors."""
    ensure_shared_dir(df.sparkSession)
    return df.checkpoint()


class Scratch:
    """Relations written as Parquet in a folder of their own under the shared one: computed once, there after an executor is lost, and gone when they are dropped. What isn't dropped stays for whoever reads the result."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        ensure_shared_dir(spark)
        self.spark, self.base = spark, f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid4().hex}"
        self.kept: dict[int, tuple[DataFrame, str]] = {}
        self.made = 0

    def cut(self, df: DataFrame) -> DataFrame:
        folder = f"{self.base}/{self.made}"
        self.made += 1
        df.write.parquet(folder)
        out = self.spark.read.schema(df.schema).parquet(folder)
        self.kept[id(out)] = (out, folder)
        return out

    def drop(self, *relations: DataFrame) -> None:
        """Nothing may read these any more."""
        for df in relations:
            remove_folder(self.spark, self.kept.pop(id(df))[1])


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder in any store that Spark writes to."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The texts of an Arrow string column as UTF-8."""
    large = pa.types.is_large_string(column.type)
    return column.cast(pa.large_binary() if large else pa.binary()).to_pylist()


def map_text(docs: DataFrame, function, schema: str, key: str = "doc_id") -> DataFrame:
    """One output row for each document: function(utf8 text) -> tuple of the columns after the key.

    A null text reaches the function as b"". Only key and text are read, so
    other columns of docs, whatever their names, neither clash nor cost."""
    names = [c.split()[0] for c in schema.split(",")]
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [function(t or b"") for t in utf8(batch.column(1))]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[key, *names])

    small_batches(docs.sparkSession)
    types = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}[c.split()[1]] for c in schema.split(",")]
    return docs.select(key, F.col("text")).mapInArrow(run, f"{key} {key_type}, {schema}")


def code_points(text: bytes, places: Iterable[int]) -> dict[int, int]:
    """For each place in a UTF-8 text, none of which may be inside a code point: the code points before it."""
    out, before, n = {}, 0, 0
    for p in sorted(places):
        n += len(text[before:p].decode("utf-8", "replace"))
        out[p], before = n, p
    return out
