"""Shapes carried by the ``embeddings`` table: 21 landmarks of 3 coordinates each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

N_POINTS = 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """specimen_id, population, pidx, x, y, z; ``pidx`` is a landmark's identity."""
    e = F.col("embedding")
    marks = F.array(*(F.struct(F.lit(k).alias("pidx"), *(e[3 * k + a].cast("double").alias(n) for a, n in enumerate("xyz"))) for k in range(N_POINTS)))
    rows = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL")
    return rows.select(F.col("vec_id").alias("specimen_id"), F.col("label").alias("population"), F.inline(marks))


def faces(spark: SparkSession) -> DataFrame:
    """fid, a, b, c: a strip of triangles over the landmarks."""
    return spark.range(N_POINTS - 2).select(*(F.expr(f"cast(id + {k} AS int)").alias(n) for n, k in (("fid", 0), ("a", 0), ("b", 1), ("c", 2))))
