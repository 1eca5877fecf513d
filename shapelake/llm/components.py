"""Connected components of an edge list, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, rounds: int = 1_000) -> DataFrame:
    """(node, root) for each node of ``edges`` (u, v longs): root is the smallest
    node of its component.

    Large-star and small-star rounds (Kiveris et al. 2014): every node points its
    larger neighbours to the smallest, then its smaller ones, until nothing
    changes. A hub's neighbours are only aggregated and joined, never gathered.
    Each round is a table in the shared folder. Loops and repeated edges do no
    harm; an empty list has no nodes. A chain of n nodes takes about log n rounds;
    it is an error if ``rounds`` are not enough.
    """
    ordered = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, said, tag = scratch.write(ordered, "cc-0"), None, "cc-0"
    for k in range(1, rounds + 1):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        after = scratch.write(small, f"cc-{k}")
        scratch.drop(tag)
        now, tag = after, f"cc-{k}"
        got = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if got == said:
            break
        said = got
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
