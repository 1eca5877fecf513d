"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, word_count

#: Hash buckets a source is cut into when part of it is sampled.
BUCKETS = 4096


def _bucket(doc_id: Column, seed: int) -> Column:
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 3), 16, 10).cast("int")


def water_fill(sources: DataFrame, budget: int, max_epochs: float) -> DataFrame:
    """``target`` for each row of ``sources`` (columns source_size, weight).

    Sources share ``budget`` by weight. A source whose share exceeds
    ``max_epochs * source_size`` stops there, and the excess goes to the rest by
    weight, until none is above. Each round sends two sums to the driver; the
    level only rises, so there are at most as many rounds as sources.
    """
    cap = F.lit(float(max_epochs)) * F.col("source_size")
    level = 0.0
    while True:
        capped = cap <= F.lit(level) * F.col("weight")
        fixed, free = sources.agg(
            F.coalesce(F.sum(F.when(capped, cap)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~capped, F.col("weight").cast("double"))), F.lit(0.0)),
        ).first()
        if free == 0 or (raised := (budget - fixed) / free) <= level:
            break
        level = raised
    return sources.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))


def mix(
    docs: DataFrame,
    *,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.0,
    max_epochs: float = 3.0,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """How many words of each document a mix takes.

    Sources in code-point order, null last, weigh ``weights``, repeating. They
    share ``share`` of all words by :func:`water_fill`. A source whose target is
    r times its size has every document taken floor(r) times whole. The
    fraction that is left comes from documents in order of a seeded hash of the
    id: buckets below a threshold are taken once more whole, and those of the
    one bucket at the threshold by the part that is still missing. Only counts
    for each source and bucket are gathered, so a hot source costs no more than
    others; ranking the sources takes one row for each of them to one task.

    Returns id, size, source, source_size, target, repeats (whole), part (0 to 1,
    the fractional repetition) and taken (words, repeats counted).

    Null or empty text: size 0, taken 0. A null source is a source. A null id
    hashes as the text ``null``. Repeated rows each count. An empty table
    returns no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        _bucket(F.col(id_col), seed).alias("bucket"),
    )
    scratch = Scratch(spark)
    sized = scratch.keep(sized, "sized")  # small: four numbers a document
    cells = scratch.keep(sized.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "cells")
    sources = cells.groupBy("source").agg(F.sum("words").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank % len(weights) + 1).cast("int"))
    sources = scratch.keep(sources.withColumn("weight", weight), "sources")
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    plan = water_fill(sources, share * total, max_epochs).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    plan = plan.withColumn("repeats", F.floor("rate")).withColumn("missing", (F.col("rate") - F.floor("rate")) * F.col("source_size"))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    part = F.when(F.col("words") == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("missing") - F.coalesce(F.col("before"), F.lit(0))) / F.col("words"))))
    cells = cells.withColumn("before", before).alias("c").join(plan.alias("p"), F.col("c.source").eqNullSafe(F.col("p.source")))
    cells = cells.select("c.source", "bucket", "source_size", "target", "repeats", part.alias("part"))
    out = sized.alias("d").join(cells.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d.bucket") == F.col("c.bucket")))
    taken = F.least(F.col("repeats") * F.col("size") + F.round(F.col("part") * F.col("size")), F.lit(float(max_epochs)) * F.col("size")).cast("long")
    return out.select("doc_id", "size", "d.source", "source_size", "target", "repeats", "part", taken.alias("taken"))
