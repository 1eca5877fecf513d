"""Biharmonic deformation of many meshes at once by conjugate gradients.

The system of a mesh is its squared Laplacian; it is never made. Meshes that fit a
task are rows, and a task steps through many of them together. Of larger ones, edges
are rows: a product is two joins with the Laplacian's entries and two sums by vertex,
vertices carry their own state, and scalars are sums over a specimen's vertices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.lineage import cut
from . import kernels, mesh
from .neighbors import larger, tasks

XYZ = ("x", "y", "z")
STATE = ("free", "soft", "scale", "mass", *(f"{v}{c}" for v in ("u", "r", "p", "s", "o") for c in XYZ))


def _entries(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(specimen_id, src, dst, l) of each mesh's half-cotangent Laplacian; every vertex has a diagonal entry."""
    w = mesh.cotangent_weights(vertices, faces)
    number = lambda c: F.col(c).cast("long")
    cell = lambda i, j, v: F.struct(number(i).alias("src"), number(j).alias("dst"), v.alias("l"))
    parts = w.select("specimen_id", F.inline(F.array(cell("lo", "hi", -F.col("w")), cell("hi", "lo", -F.col("w")), cell("lo", "lo", F.col("w")), cell("hi", "hi", F.col("w")))))
    own = vertices.select("specimen_id", number("vid").alias("src"), number("vid").alias("dst"), F.lit(0.0).alias("l"))
    return parts.unionByName(own).groupBy("specimen_id", "src", "dst").agg(F.sum("l").alias("l"))


def _times(entries: DataFrame, rows: DataFrame, vector: str, out: str, carry: tuple[str, ...]) -> DataFrame:
    """The Laplacian times ``vector``, as ``out``, with each vertex's ``carry`` columns."""
    own = F.col("src") == F.col("dst")
    far = entries.join(rows.withColumnRenamed("vid", "dst"), ["specimen_id", "dst"])
    sums = [F.sum(F.col("l") * F.col(f"{vector}{c}")).alias(f"{out}{c}") for c in XYZ]
    return far.groupBy("specimen_id", F.col("src").alias("vid")).agg(*sums, *(F.max(F.when(own, F.col(c))).alias(c) for c in carry))


def _system(entries: DataFrame, rows: DataFrame, vector: str, ridge: float) -> DataFrame:
    """Rows with q = (L M^-1 L + ridge + soft) vector on free vertices, 0 on others."""
    once = _times(entries, rows, vector, "t", STATE).withColumns({f"t{c}": F.col(f"t{c}") / F.col("mass") for c in XYZ})
    twice = _times(entries, once, "t", "q", STATE)
    return twice.withColumns({f"q{c}": F.col("free") * (F.col(f"q{c}") + (F.col("soft") + F.lit(ridge)) * F.col(f"{vector}{c}")) for c in XYZ})


def _sum(a: str, b: str, c: str):
    return F.sum(F.col(f"{a}{c}") * F.col(f"{b}{c}")).over(Window.partitionBy("specimen_id"))


def _ratio(a, b):
    return F.when(F.abs(b) > 0, a / b).otherwise(0.0)


def _scaled(rows: DataFrame) -> DataFrame:
    return rows.withColumns({f"z{c}": F.col("scale") * F.col(f"r{c}") for c in XYZ})


def _solve(entries: DataFrame, start: DataFrame, ridge: float, tolerance: float, rounds: int) -> DataFrame:
    """State of all specimens after as many steps as the slowest needs, and ``residual``:
    the largest of the three coordinates' remaining over their first residuals."""
    rows = _scaled(_system(entries, start, "u", ridge).withColumns({f"r{c}": F.col("free") * (F.col(f"r{c}") - F.col(f"q{c}")) for c in XYZ}))
    rows = rows.withColumns({f"s{c}": _sum("r", "z", c) for c in XYZ}).withColumns({f"p{c}": F.col(f"z{c}") for c in XYZ} | {f"o{c}": _sum("r", "r", c) for c in XYZ})
    rows = cut(rows.select("specimen_id", "vid", *STATE))
    for k in range(1, rounds + 1):
        rows = _system(entries, rows, "p", ridge)
        rows = rows.withColumns({f"a{c}": _ratio(F.col(f"s{c}"), _sum("p", "q", c)) for c in XYZ})
        rows = rows.withColumns({f"u{c}": F.col(f"u{c}") + F.col(f"a{c}") * F.col(f"p{c}") for c in XYZ} | {f"r{c}": F.col(f"r{c}") - F.col(f"a{c}") * F.col(f"q{c}") for c in XYZ})
        rows = _scaled(rows).withColumns({f"n{c}": _sum("r", "z", c) for c in XYZ})
        rows = rows.withColumns({f"p{c}": F.col(f"z{c}") + _ratio(F.col(f"n{c}"), F.col(f"s{c}")) * F.col(f"p{c}") for c in XYZ}).withColumns({f"s{c}": F.col(f"n{c}") for c in XYZ})
        rows = cut(rows.select("specimen_id", "vid", *STATE))
        if k % 4 == 0 or k == rounds:
            left = rows.groupBy("specimen_id").agg(F.greatest(*(F.sqrt(_ratio(F.sum(F.col(f"r{c}") * F.col(f"r{c}")), F.max(f"o{c}"))) for c in XYZ)).alias("residual"))
            if left.where(F.col("residual") > tolerance).isEmpty():
                break
    left = rows.groupBy("specimen_id").agg(F.greatest(*(F.sqrt(_ratio(F.sum(F.col(f"r{c}") * F.col(f"r{c}")), F.max(f"o{c}"))) for c in XYZ)).alias("residual"))
    return rows.join(left, "specimen_id")


#: Meshes of up to so many vertices are solved in a task, about so many vertices together.
WHOLE, TOGETHER = 100_000, 100_000


def _solved(points: DataFrame, targets: DataFrame, faces: DataFrame, soft: float | None, weigh: bool, ridge: float, tolerance: float, rounds: int, retries: int) -> DataFrame:
    """:func:`warp` of meshes that are a row each."""
    to = targets.agg(F.array_sort(F.collect_list(F.struct(F.col("pidx").cast("long").alias("i"), *XYZ))).alias("to"))
    v = points.select("specimen_id", F.col("pidx").alias("vid"), *XYZ).repartition(tasks(points), "specimen_id")
    rows = mesh.whole(v, faces).crossJoin(to.select(*(F.col(f"to.{c}").alias(f"t{c}") for c in ("i", *XYZ))))  # one row of targets

    def read(row):
        index, p = np.asarray(row.i), np.stack([row.x, row.y, row.z], 1)
        f = np.zeros((0, 3), np.int64) if row.a is None else np.stack([row.a, row.b, row.c], 1)
        f = np.searchsorted(index, f[np.isin(f, index).all(1)])
        goal, known = np.full(p.shape, np.nan), np.isin(row.ti, index)
        goal[np.searchsorted(index, row.ti[known])] = np.stack([row.tx, row.ty, row.tz], 1)[known]
        return row.specimen_id, index, p, f, goal

    def solve(some):
        weight = ridge
        for k in range(retries + 1):
            sizes = [len(s[1]) for s in some]
            ends = np.cumsum(sizes)
            f = np.concatenate([s[3] + end - n for s, end, n in zip(some, ends, sizes, strict=True)])
            p, of = np.concatenate([s[2] for s in some]), np.repeat(np.arange(len(some)), sizes)
            moves, left = kernels.biharmonic_many(p, of, f, np.concatenate([s[4] for s in some]), soft, weigh, weight, tolerance, rounds)
            good = (left <= tolerance) | (k == retries)
            keep = good[of]
            at = (p + moves)[keep]
            yield pd.DataFrame({"specimen_id": np.repeat([s[0] for s in some], sizes)[keep], "pidx": np.concatenate([s[1] for s in some])[keep], **dict(zip(XYZ, at.T, strict=True)), "residual": left[of][keep], "ridge": weight})
            some, weight = [s for s, done in zip(some, good, strict=True) if not done], weight * 10
            if not some:
                return

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            some, size = [], 0
            for row in batch.itertuples(index=False):
                some.append(read(row))
                size += len(some[-1][1])
                if size >= TOGETHER:
                    yield from solve(some)
                    some, size = [], 0
            if some:
                yield from solve(some)

    return rows.mapInPandas(run, "specimen_id long, pidx int, x double, y double, z double, residual double, ridge double")


def warp(points: DataFrame, targets: DataFrame, faces: DataFrame, *, soft: float | None = None, weigh: bool = False, ridge: float = 1e-8, tolerance: float = 1e-8, rounds: int = 200, retries: int = 3, whole: int = WHOLE) -> DataFrame:
    """Each specimen's mesh moved as smoothly as the squared Laplacian allows so that its
    constrained vertices meet ``targets`` (pidx, x, y, z), exactly or, with ``soft``, with that weight.

    With ``weigh`` the two Laplacians have the inverse of the vertices' areas between
    them. Conjugate gradients, scaled by the system's diagonal, run on all specimens
    until every ``residual`` is at most ``tolerance``, or for ``rounds`` steps, meshes of
    up to ``whole`` vertices in a task, larger ones over rows of edges; those
    that fail are solved again with ten times the ``ridge``, up to ``retries`` times.
    Returns (specimen_id, pidx, x, y, z, residual, ridge): what is still above the
    tolerance then says so. Vertices without faces stay unless they are constrained;
    a specimen without constraints stays as it is.
    """
    large, how = larger(points, whole), (soft, weigh, ridge, tolerance, rounds, retries)
    if large is None:
        return _solved(points, targets, faces, *how)
    large = cut(large)
    small = _solved(points.join(large, "specimen_id", "left_anti"), targets, faces, *how)
    return small.unionByName(_over_edges(points.join(large, "specimen_id", "left_semi"), targets, faces, *how))


def _over_edges(points: DataFrame, targets: DataFrame, faces: DataFrame, soft: float | None, weigh: bool, ridge: float, tolerance: float, rounds: int, retries: int) -> DataFrame:
    """:func:`warp` of meshes whose edges are rows."""
    v = points.select("specimen_id", F.col("pidx").cast("long").alias("vid"), *XYZ)
    entries = cut(_entries(v, faces))
    to = targets.select(F.col("pidx").cast("long").alias("vid"), *(F.col(c).alias(f"t{c}") for c in XYZ))
    start = v.join(to, "vid", "left").withColumn("held", F.col("tx").isNotNull())
    area = mesh.vertex_areas(v, faces).withColumnRenamed("area", "mass").select("specimen_id", F.col("vid").cast("long").alias("vid"), "mass") if weigh else v.select("specimen_id", "vid", F.lit(1.0).alias("mass"))
    start = start.join(area, ["specimen_id", "vid"], "left").withColumn("mass", F.coalesce("mass", F.lit(1.0)))
    move = {c: F.when(F.col("held"), F.col(f"t{c}") - F.col(c)).otherwise(0.0) for c in XYZ}
    if soft is None:
        start = start.withColumn("free", F.when(F.col("held"), 0.0).otherwise(1.0)).withColumn("soft", F.lit(0.0)).withColumns({f"u{c}": move[c] for c in XYZ} | {f"r{c}": F.lit(0.0) for c in XYZ})
    else:
        start = start.withColumn("free", F.lit(1.0)).withColumn("soft", F.when(F.col("held"), float(soft)).otherwise(0.0)).withColumns({f"u{c}": F.lit(0.0) for c in XYZ} | {f"r{c}": F.col("soft") * move[c] for c in XYZ})
    start = start.withColumns({f"{k}{c}": F.lit(0.0) for k in ("p", "s", "o") for c in XYZ})
    own = entries.join(start.select("specimen_id", F.col("vid").alias("dst"), "mass"), ["specimen_id", "dst"]).groupBy("specimen_id", F.col("src").alias("vid")).agg(F.sum(F.col("l") * F.col("l") / F.col("mass")).alias("diagonal"))
    start = cut(start.join(own, ["specimen_id", "vid"]).withColumn("scale", 1 / (F.col("diagonal") + F.col("soft") + F.lit(ridge))).select("specimen_id", "vid", *STATE))
    done, todo = None, start
    for k in range(retries + 1):
        weight = ridge * 10**k
        got = _solve(entries, todo, weight, tolerance, rounds).select("specimen_id", "vid", *(f"u{c}" for c in XYZ), "residual", F.lit(weight).alias("ridge"))
        good = got if k == retries else got.where(F.col("residual") <= tolerance)
        done = good if done is None else done.unionByName(good)
        failed = got.where(F.col("residual") > tolerance).select("specimen_id").distinct()
        if k == retries or failed.isEmpty():
            break
        todo = cut(start.join(failed, "specimen_id", "left_semi"))
        entries = entries.join(failed, "specimen_id", "left_semi")
    return v.join(done, ["specimen_id", "vid"]).select("specimen_id", F.col("vid").cast("int").alias("pidx"), *((F.col(c) + F.col(f"u{c}")).alias(c) for c in XYZ), "residual", "ridge")
