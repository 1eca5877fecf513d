"""Least-squares similarity fits from moments.

No specimen is ever gathered: what a fit needs of a specimen are the covariances of
its landmarks' coordinates with the template's, sums that Spark combines within
tasks. The 3 x 3 solves run over batches of specimens.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .points import XYZ

#: A template of more points than this is not one shape.
MOST_POINTS = 1_000_000
CROSS = [f"{a}{b}" for a in XYZ for b in XYZ]
FIT = "struct<scale: double, r: array<double>>"


def moments(points: DataFrame, template: DataFrame) -> DataFrame:
    """Of each specimen, over the landmarks that it shares with the template: n, means
    (sx .. of its own, tx .. of the template's), spread (mean square distance from its
    mean) and the covariances cxy of its x with the template's y, and so on."""
    if template.count() > MOST_POINTS:
        raise ValueError("the template has too many points")
    to = template.select("pidx", *(F.col(c).alias(f"t{c}") for c in XYZ))
    both = points.join(F.broadcast(to), "pidx")
    return both.groupBy("specimen_id").agg(
        F.count(F.lit(1)).alias("n"),
        *(F.avg(c).alias(f"s{c}") for c in XYZ),
        *(F.avg(f"t{c}").alias(f"t{c}") for c in XYZ),
        sum((F.var_pop(c) for c in XYZ), F.lit(0.0)).alias("spread"),
        *(F.covar_pop(a, f"t{b}").alias(f"c{a}{b}") for a in XYZ for b in XYZ),
    )


def fits(points: DataFrame, template: DataFrame, scaling: bool = True) -> DataFrame:
    """(specimen_id, scale, r00 .. r22, tx, ty, tz): the least-squares fit scale R p + t of
    each specimen's landmarks to the template's (Umeyama 1991), never a reflection.

    A specimen whose shared landmarks are one point is only shifted; one that shares
    none has no row.
    """

    @F.pandas_udf(FIT)
    def solve(spread: pd.Series, xx: pd.Series, xy: pd.Series, xz: pd.Series, yx: pd.Series, yy: pd.Series, yz: pd.Series, zx: pd.Series, zy: pd.Series, zz: pd.Series) -> pd.DataFrame:
        m = np.stack([xx, yx, zx, xy, yy, zy, xz, yz, zz], 1).reshape(-1, 3, 3)  # target by source
        good = np.isfinite(m).all((1, 2))
        u, d, v = np.linalg.svd(np.where(good[:, None, None], m, 0.0))
        sign = np.where(np.linalg.det(u @ v) < 0, -1.0, 1.0)
        d[:, 2] *= sign
        u[:, :, 2] *= sign[:, None]
        own = spread.to_numpy()
        scale = np.where(own > 0, d.sum(1) / np.where(own > 0, own, 1.0), 1.0) if scaling else np.ones(len(m))
        rotation = u @ v
        rotation[~good], scale[~good] = np.nan, np.nan
        return pd.DataFrame({"scale": scale, "r": list(rotation.reshape(-1, 9))})

    got = moments(points, template).withColumn("f", solve("spread", *(f"c{p}" for p in CROSS)))
    r = [[F.col("f.r")[3 * i + j] for j in range(3)] for i in range(3)]
    shift = [F.col(f"t{c}") - F.col("f.scale") * sum((r[i][j] * F.col(f"s{d}") for j, d in enumerate(XYZ)), F.lit(0.0)) for i, c in enumerate(XYZ)]
    return got.select("specimen_id", F.col("f.scale").alias("scale"), *(r[i][j].alias(f"r{i}{j}") for i in range(3) for j in range(3)), *(s.alias(f"t{c}") for s, c in zip(shift, XYZ, strict=True)))


def place(points: DataFrame, poses: DataFrame) -> DataFrame:
    """Specimens (specimen_id, pidx, x, y, z) under their own poses of :func:`fits`; null without one."""
    moved = [F.col("scale") * sum((F.col(f"r{i}{j}") * F.col(c) for j, c in enumerate(XYZ)), F.lit(0.0)) + F.col(f"t{XYZ[i]}") for i in range(3)]
    return points.join(poses, "specimen_id", "left").select("specimen_id", F.col("pidx").cast("int").alias("pidx"), *(m.alias(c) for m, c in zip(moved, XYZ, strict=True)))


def align(points: DataFrame, template: DataFrame, scaling: bool = True) -> DataFrame:
    """Each specimen after the least-squares similarity (or rigid) fit of its landmarks to the template's."""
    return place(points, fits(points, template, scaling))


def optimality(points: DataFrame, template: DataFrame) -> DataFrame:
    """What must hold of :func:`fits`: (specimen_id, skew, turn, nearer). R M is
    symmetric for the best rotation, M being the covariances (``skew`` is how far
    it is not, over M's size), R is a rotation (``turn``, its determinant, is 1), and
    no specimen is further from the template than where it was."""
    m = moments(points, template)
    both = m.drop("tx", "ty", "tz", "n").join(fits(points, template), "specimen_id")
    rm = [[sum((F.col(f"r{i}{k}") * F.col(f"c{XYZ[k]}{XYZ[j]}") for k in range(3)), F.lit(0.0)) for j in range(3)] for i in range(3)]
    size = F.sqrt(sum((F.col(f"c{p}") * F.col(f"c{p}") for p in CROSS), F.lit(0.0))) + F.lit(1e-300)
    skew = F.greatest(*(F.abs(rm[i][j] - rm[j][i]) for i, j in ((0, 1), (0, 2), (1, 2)))) / size
    turn = sum((F.col(f"r0{i}") * (F.col(f"r1{j}") * F.col(f"r2{k}") - F.col(f"r1{k}") * F.col(f"r2{j}")) for i, j, k in ((0, 1, 2), (1, 2, 0), (2, 0, 1))), F.lit(0.0))
    to = template.select("pidx", *(F.col(c).alias(f"t{c}") for c in XYZ))

    def apart(p: DataFrame, name: str) -> DataFrame:
        away = sum(((F.col(c) - F.col(f"t{c}")) * (F.col(c) - F.col(f"t{c}")) for c in XYZ), F.lit(0.0))
        return p.join(F.broadcast(to), "pidx").groupBy("specimen_id").agg(F.sum(away).alias(name))

    where = apart(points, "before").join(apart(align(points, template), "after"), "specimen_id")
    return both.select("specimen_id", skew.alias("skew"), turn.alias("turn")).join(where, "specimen_id").select("specimen_id", "skew", "turn", (F.col("after") <= F.col("before") * (1 + 1e-9)).alias("nearer"))
