"""Keyed joins of collections: specimens with landmarks, models with their parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_keys(files: DataFrame, key: str, path: str) -> DataFrame:
    """One path for each key, the last in order; ``duplicates`` says how many others there were."""
    return files.groupBy(key).agg(F.max(path).alias(path), (F.count(F.lit(1)) - 1).alias("duplicates"))


def pair(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of both with equal keys."""
    return left.join(right, key, "inner")


def unpaired(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of ``left`` whose key ``right`` lacks."""
    return left.join(right.select(key), key, "left_anti")


def with_optional(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """All of ``left``, with what ``right`` has for its keys."""
    return left.join(right, key, "left")


def readiness(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many keys both sides, and only one of them, have."""
    sides = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    keys = sides.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return keys.agg(*(F.coalesce(F.sum(F.expr(e)), F.lit(0)).cast("long").alias(n) for n, e in (("both", "l * r"), ("only_left", "l * (1 - r)"), ("only_right", "r * (1 - l)"))))


def latest_complete(parts: DataFrame, group: str, part: str, seq: str, required: list[str]) -> DataFrame:
    """The group with the highest sequence number that has all required parts."""
    whole = parts.where(F.col(part).isin(required)).groupBy(group).agg(F.countDistinct(part).alias("n"), F.max(seq).alias("seq")).where(F.col("n") == len(required))
    return whole.orderBy(F.desc("seq"), F.desc(group)).limit(1).select(group, "seq")
