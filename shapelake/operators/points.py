"""Landmarks and clouds: means, bounds, scaling, voxels, checks.

All functions take points as rows of specimen_id, pidx, x, y, z (population
where named) and stay inside the JVM, but for the solving of small systems. Groups are aggregated before the shuffle,
so a specimen or population with a large part of all rows is no bottleneck.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g

XYZ = ("x", "y", "z")


def centroid(points: DataFrame, *by: str) -> DataFrame:
    """Mean position of each group."""
    return points.groupBy(*by).agg(*(F.avg(c).alias(c) for c in XYZ))


def mean_shape(points: DataFrame, *by: str) -> DataFrame:
    """Mean position of each landmark, over all specimens or those of a group."""
    return centroid(points, *by, "pidx")


def bounds(points: DataFrame, *by: str) -> DataFrame:
    """Box of each group, its diagonal and number of points."""
    box = points.groupBy(*by).agg(*(f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in XYZ), F.count(F.lit(1)).alias("n_points"))
    return box.withColumn("diagonal", F.sqrt(g.distance2(g.vector("max_"), g.vector("min_"))))


def closest_to_mean(points: DataFrame, *by: str) -> DataFrame:
    """The specimen of each group with the least sum of squares to the group's mean shape; ties to the lowest id."""
    mean = mean_shape(points, *by).select(*by, "pidx", *(F.col(c).alias(f"m{c}") for c in XYZ))
    apart = points.join(mean, [*by, "pidx"]).groupBy(*by, "specimen_id").agg(F.sum(g.distance2(g.vector(), g.vector("m"))).alias("ss"))
    return apart.groupBy(*by).agg(F.min(F.struct(F.round("ss", 9).alias("ss"), "specimen_id")).alias("best")).select(*by, F.col("best.specimen_id").alias("specimen_id"), F.col("best.ss").alias("ss"))


def scale_diagonal(points: DataFrame, size: float = 20.0) -> DataFrame:
    """Each specimen scaled to a box diagonal of ``size``; the factor undoes it."""
    box = bounds(points, "specimen_id").select("specimen_id", (F.lit(size) / F.when(F.col("diagonal") > 0, F.col("diagonal"))).alias("factor"))
    return points.join(box, "specimen_id").select("specimen_id", "pidx", *((F.col(c) * F.col("factor")).alias(c) for c in XYZ), "factor")


def unit_frames(points: DataFrame) -> DataFrame:
    """The centre (mid_x, ...) of each specimen's box and its longest side; 1 where all points are one."""
    box = bounds(points, "specimen_id")
    side = F.greatest(*(F.col(f"max_{c}") - F.col(f"min_{c}") for c in XYZ))
    return box.select("specimen_id", *(((F.col(f"max_{c}") + F.col(f"min_{c}")) / 2).alias(f"mid_{c}") for c in XYZ), F.when(side > 0, side).otherwise(1.0).alias("side"))


def unit_size(points: DataFrame) -> DataFrame:
    """Each specimen about its box's centre, its longest side as 1."""
    return points.join(unit_frames(points), "specimen_id").select("specimen_id", "pidx", *(((F.col(c) - F.col(f"mid_{c}")) / F.col("side")).alias(c) for c in XYZ))


def from_unit_size(points: DataFrame, frames: DataFrame) -> DataFrame:
    """What :func:`unit_size` gave, or points found in its frame, back in the specimen's own."""
    return points.join(frames, "specimen_id").select("specimen_id", "pidx", *((F.col(c) * F.col("side") + F.col(f"mid_{c}")).alias(c) for c in XYZ))


def prescale(source: DataFrame, target: DataFrame, coverage: float = 1.0) -> DataFrame:
    """Factor that gives the source's box the target's size, for a target that covers part of it."""
    share = min(1.0, max(1e-3, coverage))
    d = [bounds(p).select(F.col("diagonal").alias(n)) for p, n in ((source, "source_diagonal"), (target, "target_diagonal"))]
    return d[0].crossJoin(d[1]).withColumn("factor", F.col("target_diagonal") / F.lit(share) / F.col("source_diagonal"))  # one row each


def fixed_scale_shift(source: DataFrame, target: DataFrame, rotation: list[list[float]]) -> DataFrame:
    """Translation that brings the rotated source's mean to the target's mean, at scale 1."""
    a = centroid(source).select(*(F.col(c).alias(f"s{c}") for c in XYZ))
    turned = g.apply_matrix(g.vector("s"), g.similarity_matrix(rotation, 1.0, [0.0, 0.0, 0.0]))
    return centroid(target).crossJoin(a).select(*((F.col(c) - t).alias(c) for c, t in zip(XYZ, turned, strict=True)))  # one row each


def transform(points: DataFrame, matrix: list[list[float]]) -> DataFrame:
    """All points through one 4 x 4 matrix; other columns are kept."""
    return points.withColumns(dict(zip(XYZ, g.apply_matrix(g.vector(), matrix), strict=True)))


def voxel_key(size: float, origin: tuple[float, float, float]) -> list[Column]:
    return [F.floor((F.col(c) - F.lit(o)) / F.lit(size)).cast("long").alias(f"k{c}") for c, o in zip(XYZ, origin, strict=True)]


def voxel_representatives(points: DataFrame, size: float, *by: str, origin: tuple[float, float, float] = (0.0, 0.0, 0.0), index: str = "pidx") -> DataFrame:
    """The lowest index of each occupied cell."""
    return points.groupBy(*by, *voxel_key(size, origin)).agg(F.min(index).alias(index), F.count(F.lit(1)).alias("n_points"))


def voxel_downsample(points: DataFrame, size: float, *by: str, origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """The mean position of each occupied cell."""
    return points.groupBy(*by, *voxel_key(size, origin)).agg(*(F.avg(c).alias(c) for c in XYZ), F.count(F.lit(1)).alias("n_points"))


def voxel_count(points: DataFrame, size: float, *by: str, origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """How many cells each group occupies."""
    return points.select(*by, *voxel_key(size, origin)).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("n_voxels"))


def finite_points(points: DataFrame) -> DataFrame:
    """Points without NaN, infinite or null coordinates."""
    return points.where(g.all_finite(g.vector()))


def non_finite_counts(points: DataFrame, *by: str) -> DataFrame:
    """Number of points and of those that are not finite: what a guard raises on."""
    bad = ~g.all_finite(g.vector())
    return points.groupBy(*by).agg(F.count(F.lit(1)).alias("n_points"), F.sum(bad.cast("long")).alias("n_bad"))


def require_finite(points: DataFrame) -> DataFrame:
    """``points`` itself; raises if any coordinate is not finite."""
    bad = non_finite_counts(points).first()
    if bad["n_bad"]:
        raise ValueError(f"{bad['n_bad']} of {bad['n_points']} points are not finite")
    return points


def count_consistency(points: DataFrame, *by: str) -> DataFrame:
    """Whether the specimens of each group have equally many landmarks."""
    n = points.groupBy(*by, "specimen_id").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*by).agg(F.count(F.lit(1)).alias("n_specimens"), F.min("n").alias("least"), F.max("n").alias("most"), (F.min("n") == F.max("n")).alias("consistent"))


def non_zero_shapes(points: DataFrame) -> DataFrame:
    """Specimens with some coordinate other than zero."""
    return points.groupBy("specimen_id").agg(F.max(F.greatest(*(F.abs(c) for c in XYZ))).alias("largest")).where("largest > 0")


def coordinate_check(distances: DataFrame, flipped: DataFrame, diagonals: DataFrame, limit: float = 0.03) -> DataFrame:
    """Whether landmarks lie on their mesh, and whether flipping x and y would put them there.

    Takes (specimen_id, d) distances as read and flipped, and diagonals.
    """
    ratio = lambda d, n: d.groupBy("specimen_id").agg(F.median("d").alias(n))
    both = ratio(distances, "near").join(ratio(flipped, "far"), "specimen_id").join(diagonals.select("specimen_id", "diagonal"), "specimen_id")
    both = both.select("specimen_id", (F.col("near") / F.col("diagonal")).alias("ratio"), (F.col("far") / F.col("diagonal")).alias("flipped_ratio"))
    return both.withColumn("failed", F.col("ratio") > limit).withColumn("hint_lps", (F.col("ratio") > limit) & (F.col("flipped_ratio") < 0.5 * F.col("ratio")) & (F.col("flipped_ratio") < limit))


def control_point_counts(points: DataFrame, *by: str) -> DataFrame:
    """Number of control points of each markup; a repeated index counts once."""
    return points.groupBy(*by).agg(F.countDistinct("pidx").alias("n_points"))


def copy_labels(points: DataFrame, template: DataFrame) -> DataFrame:
    """Labels of a template's landmarks (pidx, label) by index, for the specimens that
    have as many landmarks as it; null for the others."""
    counts = control_point_counts(points, "specimen_id").crossJoin(template.agg(F.countDistinct("pidx").alias("m")))  # one row
    fits = counts.select("specimen_id", (F.col("n_points") == F.col("m")).alias("fits"))
    rows = points.join(fits, "specimen_id").join(template.select("pidx", F.col("label").alias("own")), "pidx", "left")
    return rows.select("specimen_id", "pidx", F.when(F.col("fits"), F.col("own")).alias("label"))


def to_world(poses: DataFrame, rotation: list[list[float]]) -> DataFrame:
    """Shift of a pose found between centred clouds, for the clouds as they were.

    Takes (sx, sy, sz) and (tx, ty, tz), the centroids of source and target, the
    shift (x, y, z) between the centred ones and ``scale``; x' = scale R x + shift.
    """
    turned = g.apply_matrix(g.vector("s"), g.similarity_matrix(rotation, 1.0, [0.0, 0.0, 0.0]))
    return poses.withColumns({c: F.col(c) + F.col(f"t{c}") - F.col("scale") * t for c, t in zip(XYZ, turned, strict=True)})


def projection_limit(diagonals: DataFrame, percent: float, skip: bool = True) -> DataFrame:
    """How far a landmark of each specimen may be moved onto the surface: a share of the box's diagonal, 0 if ``skip``."""
    share = 0.0 if skip else percent / 100.0
    return diagonals.select("specimen_id", (F.col("diagonal") * F.lit(share)).alias("most"))


def run_summary(points: DataFrame, expected: int) -> DataFrame:
    """Counters of a run over specimens: how many there are, how many are used (all
    ``expected`` landmarks, finite, not all zero), how many skipped, and points in those used."""
    here = g.all_finite(g.vector())
    one = points.groupBy("specimen_id").agg(F.countDistinct("pidx").alias("n"), F.min(here).alias("finite"), F.max(F.greatest(*(F.abs(c) for c in XYZ))).alias("largest"))
    used = (F.col("n") == expected) & F.col("finite") & (F.col("largest") > 0)
    n = one.select("n", F.coalesce(used, F.lit(False)).cast("long").alias("used"))
    whole = lambda e: F.coalesce(F.sum(e), F.lit(0)).cast("long")
    return n.agg(F.count(F.lit(1)).alias("specimens"), whole(F.col("used")).alias("used"), whole(1 - F.col("used")).alias("skipped"), whole(F.col("used") * F.col("n")).alias("points"))


def subsample(rows: DataFrame, count: int, key: str, *by: str, seed: int = 0) -> DataFrame:
    """``count`` rows (of each group), the same on every run: those whose hash of seed and ``key`` is least."""
    order = [F.md5(F.concat_ws(":", F.lit(str(seed)), *by, key)), key]
    if not by:
        return rows.orderBy(*order).limit(count)
    return rows.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_at") <= count).drop("_at")


def preview(points: DataFrame, count: int, key: str = "specimen_id") -> DataFrame:
    """All rows of the first ``count`` specimens in order of their key."""
    first = points.select(key).distinct().orderBy(key).limit(count)
    return points.join(F.broadcast(first), key)  # at most count rows


def principal_axis(points: DataFrame, *by: str) -> DataFrame:
    """Unit direction of the greatest spread of each group and the sum of squares
    along it; its largest part is positive. Three numbers of a group are solved in a task."""
    m = principal_axis_moments(points, *by)
    names = [f"{a}{b}" for i, a in enumerate(XYZ) for b in XYZ[i:]]

    @F.pandas_udf("array<double>")
    def solve(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.Series:
        full = np.stack([np.stack(r, -1) for r in ((xx, xy, xz), (xy, yy, yz), (xz, yz, zz))], -2).astype(float)
        value, vector = np.linalg.eigh(full)
        v = vector[:, :, 2]
        largest = np.take_along_axis(v, np.abs(v).argmax(1)[:, None], 1)
        return pd.Series(list(np.concatenate([v * np.where(largest < 0, -1.0, 1.0), value[:, 2:]], 1)))

    return m.withColumn("_v", solve(*names)).select(*by, *(F.col("_v")[k].alias(n) for k, n in enumerate((*XYZ, "ss"))))


def principal_axis_moments(points: DataFrame, *by: str) -> DataFrame:
    """The six sums of X'X about the group's centroid, of which the principal axis is the first eigenvector."""
    n, pairs = F.count(F.lit(1)), [(a, b) for i, a in enumerate(XYZ) for b in XYZ[i:]]
    return points.groupBy(*by).agg(*((F.sum(F.col(a) * F.col(b)) - F.sum(a) * F.sum(b) / n).alias(f"{a}{b}") for a, b in pairs))
