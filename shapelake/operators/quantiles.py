"""Medians of large groups, exact, without a task that holds a group's values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_median(rows: DataFrame, by: list[str], value: str, name: str, accuracy: int = 10_000) -> DataFrame:
    """Median of ``value`` within each group of ``by``, the mean of the middle two of an even number.

    A sketch brackets the middle; values in the bracket are counted one by one, those
    below it only as a number, both before the shuffle. Nulls do not count, and a group
    of nothing else has a null median. Groups whose key is null have no row.
    """
    rows = rows.select(*by, F.col(value).alias("value"))
    margin = 5.0 / accuracy
    box = rows.groupBy(*by).agg(F.count("value").alias("n"), F.percentile_approx("value", [0.5 - margin, 0.5 + margin], accuracy).alias("box"))
    near = rows.join(box, by).where(F.col("value") <= F.col("box")[1])
    counts = near.groupBy(*by, "n", F.when(F.col("value") >= F.col("box")[0], F.col("value")).alias("value")).agg(F.count(F.lit(1)).alias("m"))
    upto = F.sum("m").over(Window.partitionBy(*by).orderBy(F.col("value").asc_nulls_first()))
    at = lambda rank: F.max(F.when((F.col("upto") >= rank) & (F.col("upto") - F.col("m") < rank), F.col("value")))
    middle = counts.withColumn("upto", upto).groupBy(*by).agg(at(F.ceil(F.col("n") / 2)).alias("low"), at(F.floor(F.col("n") / 2) + 1).alias("high"))
    found = F.when(F.col("n") > 0, F.coalesce((F.col("low") + F.col("high")) / 2, F.raise_error(F.lit("the bracket missed the median")).cast("double")))
    return box.join(middle, by, "left").select(*by, found.alias(name))
