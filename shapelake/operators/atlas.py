"""Mean atlases and dense correspondences of a whole collection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .points import XYZ, closest_to_mean
from .registration import POINTS, align, dense_correspondence, per_specimen, procrustes_mean, template_arrays
from .surfaces import onto_surface


def mean_atlas(points: DataFrame, landmarks: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """Mean of all specimens in dense correspondence, and that correspondence.

    Specimens are placed on the Procrustes mean of their landmarks; the one closest
    to the mean gives vertices and topology; each of its vertices is matched in
    every specimen after a spline through the landmarks, and matches are averaged.
    Returns (pidx, x, y, z) and (specimen_id, pidx, x, y, z) in the mean's space.
    Specimens without all landmarks do not count; without any specimen it is an error.
    """
    here = F.col("pidx").isin(*landmarks)
    marks = points.where(here)
    whole = marks.groupBy("specimen_id").agg(F.countDistinct("pidx").alias("n")).where(F.col("n") == len(set(landmarks))).select("specimen_id")
    points, marks = points.join(whole, "specimen_id"), marks.join(whole, "specimen_id")
    placed = align(points, procrustes_mean(marks)).persist()
    chosen = closest_to_mean(placed.where(here)).first()
    if chosen is None:
        raise ValueError("no specimen has all landmarks")
    base = placed.where(F.col("specimen_id") == chosen["specimen_id"])
    match = dense_correspondence(placed, list(landmarks), base).select("specimen_id", F.col("pidx").alias("at"), F.col("vid").cast("int").alias("pidx"))
    dense = match.join(placed, ["specimen_id", "pidx"]).select("specimen_id", F.col("at").alias("pidx"), *XYZ)
    return dense.groupBy("pidx").agg(*(F.avg(c).alias(c) for c in XYZ)), dense


def dense_export(landmarks: DataFrame, vertices: DataFrame, faces: DataFrame, atlas: DataFrame, atlas_landmarks: DataFrame) -> DataFrame:
    """The atlas's points on each specimen's surface: warped by the spline from the
    atlas's landmarks to the specimen's, then moved to the closest surface point."""
    ai, ap = template_arrays(atlas)
    li, lp = template_arrays(atlas_landmarks)

    def work(index, p):
        import numpy as np

        w, a = kernels.tps_fit(lp[np.isin(li, index)], p[np.isin(index, li)])
        at = kernels.tps_apply(ap, lp[np.isin(li, index)], w, a)
        return {"pidx": ai.astype(np.int32), "x": at[:, 0], "y": at[:, 1], "z": at[:, 2]}

    warped = per_specimen(landmarks, work, POINTS)
    return onto_surface(warped, vertices, faces)
