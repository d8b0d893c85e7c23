"""Results as text lines: "<variable>: groupID = [g0, g1, ...]", a tab, the value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_lines(result: DataFrame, variable: str) -> DataFrame:
    """One string column, line, of a result with g0, g1, ... and value."""
    keys = [c for c in result.columns if c[0] == "g" and c[1:].isdigit()]
    inside = F.concat_ws(", ", *(F.col(k).cast("string") for k in keys))
    return result.select(F.concat(F.lit(f"{variable}: groupID = ["), inside, F.lit("]\t"), F.col("value").cast("string")).alias("line"))


def write(result: DataFrame, path: str, variable: str) -> None:
    as_lines(result, variable).write.text(path)
