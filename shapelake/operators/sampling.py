"""Samples of exact size, of all specimens together.

The search for a voxel size is a table: a row for each specimen with the bounds of
its bisection and the best size so far. A pass counts, in one aggregate over all
specimens still open, the cells of each size that the next few steps may ask for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..sources.lineage import cut
from . import kernels
from .neighbors import shapes

WIDTH = 8  # a pass makes at most about this many rows for each point given
MOST_STEPS = 6


def _middle(low: Column, high: Column) -> Column:
    return F.sqrt(low * high)


def _asked(steps: int) -> Column:
    """The sizes that the next steps may ask for, as a heap: node k halves into 2k and 2k + 1."""
    spans, sizes = [(F.col("small"), F.col("large"))], []
    for _ in range(steps):
        sizes += [_middle(*s) for s in spans]
        spans = [half for a, b in spans for half in ((a, _middle(a, b)), (_middle(a, b), b))]
    return F.array(*sizes)


def _cell(size: Column) -> Column:
    return F.struct(*(F.floor((F.col(c) - F.col(f"low_{c}")) / size).alias(f"c{c}") for c in "xyz"))


def _step(state: DataFrame, target: int, tolerance: float, fewest_over: bool) -> DataFrame:
    """One bisection of each open specimen; ``node`` is where it stands in its heap of sizes."""
    size, n = F.element_at("sizes", F.col("node")), F.element_at("counts", F.col("node"))
    asked = state.withColumns({"size": size, "n": F.when(F.col("open"), n)})
    over = F.col("n") >= target if fewest_over else F.col("n") > target
    if fewest_over:
        better, enough = over & (F.col("n") <= F.col("best_n")), over & (F.col("n") <= target * (1 + tolerance))
    else:
        error = F.abs(F.col("n") - target)
        better = error < F.abs(F.col("best_n") - target)
        enough = (error == 0) | (better & (error <= max(1, round(target * tolerance))))
    moved = asked.withColumns({"over": F.col("open") & over, "better": F.col("open") & better, "enough": F.col("open") & enough})
    return moved.select(
        "specimen_id", "n_points", "diagonal", *(f"low_{c}" for c in "xyz"), "sizes", "counts",
        F.when(F.col("over"), F.col("size")).otherwise(F.col("small")).alias("small"),
        F.when(F.col("open") & ~F.col("over"), F.col("size")).otherwise(F.col("large")).alias("large"),
        F.when(F.col("better"), F.col("size")).otherwise(F.col("best_size")).alias("best_size"),
        F.when(F.col("better"), F.col("n")).otherwise(F.col("best_n")).alias("best_n"),
        (2 * F.col("node") + F.col("over").cast("int")).alias("node"),
        (F.col("open") & ~F.col("enough")).alias("open"),
    )


def voxel_sizes(points: DataFrame, target: int, *, fewest_over: bool = True, tolerance: float = 0.02, rounds: int = 40) -> DataFrame:
    """The voxel size of each specimen for ``target`` occupied cells: (specimen_id, n_points,
    diagonal, low_x, low_y, low_z, best_size, best_n).

    Sizes are bisected geometrically between a thousand-millionth of the diagonal and
    the diagonal, at most ``rounds`` times. ``fewest_over`` keeps the size with the fewest
    cells of at least ``target``, the later on ties; otherwise the one nearest to ``target``
    counts, the earlier on ties. A specimen stops within ``tolerance``. Where no size does
    better than all points apart, ``best_size`` is null and ``best_n`` the number of points;
    so it is for specimens of at most ``target`` points (``fewest_over``) and for those
    without extent. Points with a null or non-finite coordinate are an error. No specimen
    is gathered: cells are counted, summed in the tasks that read them.
    """
    if target < 1:
        raise ValueError("the target must be positive")
    good = F.lit(True)
    for c in "xyz":
        good = good & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    box = points.groupBy("specimen_id").agg(F.count(F.lit(1)).alias("n_points"), F.count_if(~good).alias("bad"), *(f(c).alias(f"{n}_{c}") for n, f in (("low", F.min), ("high", F.max)) for c in "xyz"))
    diagonal = F.sqrt(g.distance2(g.vector("high_"), g.vector("low_")))
    box = cut(box.withColumn("diagonal", diagonal).drop("high_x", "high_y", "high_z"))
    bad = box.where("bad > 0").count()
    if bad:
        raise ValueError(f"points of {bad} specimens are not finite")
    open_ = (F.col("diagonal") > 0) & ((F.col("n_points") > target) if fewest_over else F.lit(True))
    state = box.drop("bad").withColumns({"small": F.col("diagonal") * 1e-9, "large": F.col("diagonal"), "best_size": F.lit(None).cast("double"), "best_n": F.col("n_points"), "open": open_})
    kept = ["specimen_id", "n_points", "diagonal", "low_x", "low_y", "low_z", "best_size", "best_n"]
    closed = state.where("not open").select(kept)
    state = state.where("open")
    every, left = box.agg(F.sum("n_points")).first()[0], rounds
    while left and (points_left := state.agg(F.sum("n_points")).first()[0]):
        steps = min(left, MOST_STEPS, max(2, int(np.log2(WIDTH * every / points_left + 1))))  # fewer points, more steps ahead
        asked = state.withColumn("sizes", _asked(steps))
        each = asked.select("specimen_id", "low_x", "low_y", "low_z", F.posexplode("sizes").alias("node", "size"))
        cells = points.join(each, "specimen_id").select("specimen_id", "node", _cell(F.col("size")).alias("cell")).distinct()
        counts = cells.groupBy("specimen_id", "node").agg(F.count(F.lit(1)).alias("n"))
        counts = counts.groupBy("specimen_id").agg(F.array_sort(F.collect_list(F.struct("node", "n"))).alias("c"))  # at most 63
        state = asked.join(counts.select("specimen_id", F.col("c.n").alias("counts")), "specimen_id").withColumn("node", F.lit(1))
        for _ in range(steps):
            state = _step(state, target, tolerance, fewest_over)
        state, left = cut(state.drop("sizes", "counts", "node")), left - steps
        closed = closed.unionByName(state.where("not open").select(kept))
        state = state.where("open")
    return closed.unionByName(state.select(kept))


_PICKED = pa.schema([("specimen_id", pa.int64()), ("pidx", pa.int32())])


def _farthest_of(count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, index = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            ends = np.asarray(index.offsets)
            flat, p = np.asarray(index.values), np.stack([np.asarray(batch.column(c).values) for c in (2, 3, 4)], 1)
            sizes = np.diff(ends)
            for n in np.unique(sizes):  # specimens of equal size go through the steps together
                alike = np.flatnonzero(sizes == n)
                for rows in np.array_split(alike, 1 + len(alike) * n // 200_000):
                    take = ends[rows][:, None] - ends[0] + np.arange(n)
                    got = np.take_along_axis(flat[take], kernels.farthest_many(p[take], count), 1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[rows], got.shape[1])), pa.array(got.ravel().astype(np.int32))], schema=_PICKED)

    return run


def farthest(points: DataFrame, count: int) -> DataFrame:
    """Farthest-point subset of each specimen: (specimen_id, pidx).

    It starts farthest from the centroid; each next point is the one farthest from all
    chosen, ties to the lowest index. A specimen of at most ``count`` points is kept whole.
    A choice needs all the ones before, so a specimen is one row here; those of a batch
    that have equally many points advance together.
    """
    return shapes(points).mapInArrow(_farthest_of(count), "specimen_id long, pidx int")


def target_count_sample(points: DataFrame, target: int, tolerance: float = 0.02, rounds: int = 40) -> DataFrame:
    """Exactly ``target`` points of each specimen, even over space: (specimen_id, pidx).

    The first point of each cell at the size of :func:`voxel_sizes`, thinned to the count by
    :func:`farthest`. All points where there are no more than ``target``, the first ``target``
    where all lie in one place. Only the cells' points are gathered by specimen: within
    ``tolerance`` of ``target``, but where points share so few places that no size comes near.
    """
    found = voxel_sizes(points, target, tolerance=tolerance, rounds=rounds)
    near = points.join(found, "specimen_id")
    flat = F.col("diagonal") == 0
    cell = F.when(F.col("best_size").isNotNull(), _cell(F.col("best_size")))
    alone = F.when(F.col("best_size").isNull(), F.col("pidx"))
    ahead = near.where(~flat | (F.col("n_points") <= target))
    firsts = ahead.groupBy("specimen_id", cell.alias("cell"), alone.alias("alone")).agg(F.min(F.struct("pidx", "x", "y", "z")).alias("p")).select("specimen_id", "p.*")
    same = near.where(flat & (F.col("n_points") > target)).select("specimen_id", "pidx", F.row_number().over(Window.partitionBy("specimen_id").orderBy("pidx")).alias("rank"))
    return farthest(firsts, target).unionByName(same.where(F.col("rank") <= target).select("specimen_id", F.col("pidx").cast("int").alias("pidx")))


def voxel_size_for(points: DataFrame, target: int, tolerance: float = 0.02, rounds: int = 40) -> tuple[float, int]:
    """The voxel size of one cloud whose number of occupied cells is nearest to ``target``, and that number."""
    found = voxel_sizes(points.withColumn("specimen_id", F.lit(0)), target, fewest_over=False, tolerance=tolerance, rounds=rounds).first()
    return found.best_size or 1e-9 * found.diagonal, found.best_n
