"""Folders that all machines share."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str, required: bool = True) -> str | None:
    """A new folder's name in the place that the cluster names in spark.checkpoint.dir; None, or an error, if it names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if required:
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            return None
        sc.setCheckpointDir(shared)
    return f"{sc.getCheckpointDir()}/{name}-{uuid4().hex}"
