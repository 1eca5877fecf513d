"""Specimens that arrive while a study runs.

A folder is watched for tables of landmarks. Means are kept as running
aggregates, so a new specimen costs its own landmarks and not a new pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.points import mean_shape

LANDMARKS = "specimen_id long, population int, pidx int, x double, y double, z double"


def watch(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """Landmarks of Parquet files as they appear in ``folder``."""
    return spark.readStream.schema(LANDMARKS).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def running_mean_shape(arrivals: DataFrame, *by: str) -> DataFrame:
    """Mean shape of all that has arrived; for the ``complete`` or ``update`` output mode."""
    return mean_shape(arrivals, *by)
