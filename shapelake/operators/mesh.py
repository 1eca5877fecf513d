"""Triangle meshes as (specimen_id, vid) vertices and (fid, a, b, c) faces.

``faces`` without a specimen_id is a topology that all specimens share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from .neighbors import shapes


def own_columns(faces: DataFrame) -> list[str]:
    """``specimen_id`` if specimens have faces of their own."""
    return ["specimen_id"] if "specimen_id" in faces.columns else []


def corners(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Faces with the positions of their corners (ax .. cz)."""
    own = own_columns(faces)
    out = faces
    for k, c in enumerate("abc"):
        side = vertices.select("specimen_id", F.col("vid").alias(c), *(F.col(n).alias(f"{c}{n}") for n in "xyz"))
        out = out.join(side, [c, *(own or (["specimen_id"] if k else []))])
    return out.select("specimen_id", "fid", "a", "b", "c", *(f"{c}{n}" for c in "abc" for n in "xyz"))


def face_geometry(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Unit normal and area of each face."""
    normal, area = g.triangle_normal(*(g.vector(c) for c in "abc"))
    return corners(vertices, faces).select("specimen_id", "fid", "a", "b", "c", *(n.alias(f"n{c}") for n, c in zip(normal, "xyz", strict=True)), area.alias("area"))


def non_degenerate(vertices: DataFrame, faces: DataFrame, least: float = 0.0) -> DataFrame:
    """Faces with an area above ``least``."""
    return face_geometry(vertices, faces).where(F.col("area") > least).select("specimen_id", "fid", "a", "b", "c")


def half_edges(faces: DataFrame, *keep: str) -> DataFrame:
    """Three rows for each face, with the edge's lower and higher vertex and the opposite corner."""
    edge = lambda i, j, o: F.struct(F.least(i, j).alias("lo"), F.greatest(i, j).alias("hi"), F.col(o).alias("opp"))
    return faces.select(*keep, "fid", F.inline(F.array(edge("a", "b", "c"), edge("b", "c", "a"), edge("c", "a", "b"))))


def unique_edges(faces: DataFrame, *keep: str) -> DataFrame:
    """Each edge once, and how many faces it has."""
    return half_edges(faces, *keep).groupBy(*keep, "lo", "hi").agg(F.count(F.lit(1)).alias("n_faces"))


def edge_lengths(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Mean length over the three edges of all faces, and its share of the box's diagonal."""
    sides = F.explode(F.array(*(g.norm(g.minus(g.vector(p), g.vector(q))) for p, q in ("ab", "bc", "ca"))))
    mean = corners(vertices, faces).select("specimen_id", sides.alias("side")).groupBy("specimen_id").agg(F.avg("side").alias("mean_edge"))
    box = vertices.groupBy("specimen_id").agg(*(f(c).alias(f"{n}{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in "xyz"))
    return mean.join(box.select("specimen_id", F.sqrt(g.distance2(g.vector("hi"), g.vector("lo"))).alias("diagonal")), "specimen_id").withColumn("share", F.col("mean_edge") / F.col("diagonal"))


def dense_mesh(sizes: DataFrame, vertices: int = 300_000, triangles: int = 500_000, share: float = 0.001) -> DataFrame:
    """Whether a mesh (n_vertices, n_faces, share of mean edge) is denser than is useful."""
    return sizes.withColumn("dense", (F.col("n_vertices") > vertices) | (F.col("n_faces") > triangles) | (F.col("share") < share))


def vertex_areas(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """A third of the area of a vertex's faces, at least 1e-12."""
    return face_geometry(vertices, faces).select("specimen_id", F.explode(F.array("a", "b", "c")).alias("vid"), "area").groupBy("specimen_id", "vid").agg(F.greatest(F.sum(F.col("area") / 3), F.lit(1e-12)).alias("area"))


def cotangent_weights(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Half the sum of the cotangents opposite to each edge: one standard Laplacian's weights."""
    parts = []
    for i, j, o in ("abc", "bca", "cab"):
        u, v = g.minus(g.vector(i), g.vector(o)), g.minus(g.vector(j), g.vector(o))
        cot = g.dot(u, v) / F.greatest(g.norm(g.cross(u, v)), F.lit(1e-12))
        parts.append(F.struct(F.least(i, j).alias("lo"), F.greatest(i, j).alias("hi"), cot.alias("cot")))
    return corners(vertices, faces).select("specimen_id", F.inline(F.array(*parts))).groupBy("specimen_id", "lo", "hi").agg((F.sum("cot") / 2).alias("w"))


def adjacency(faces: DataFrame, *keep: str) -> DataFrame:
    """Both directions of each edge."""
    e = unique_edges(faces, *keep)
    return e.select(*keep, F.col("lo").alias("src"), F.col("hi").alias("dst")).unionByName(e.select(*keep, F.col("hi").alias("src"), F.col("lo").alias("dst")))


def ring(faces: DataFrame, hops: int = 1) -> DataFrame:
    """(src, dst) of vertices that edges join in at most ``hops`` steps, each with itself; of each specimen if it has its own faces."""
    own = own_columns(faces)
    step = adjacency(faces, *own)
    out = step.select(*own, "src", F.col("src").alias("dst")).distinct()
    for _ in range(hops):
        out = out.unionByName(out.withColumnRenamed("dst", "via").join(step.withColumnRenamed("src", "via"), [*own, "via"]).select(*own, "src", "dst")).distinct()
    return out


def _angles(geometry: DataFrame) -> DataFrame:
    """The absolute angle between the faces of each edge; 0 for edges with other than two."""
    normal = geometry.select("specimen_id", "fid", "nx", "ny", "nz")
    sides = half_edges(geometry, "specimen_id").select("specimen_id", "lo", "hi", "fid")
    two = sides.groupBy("specimen_id", "lo", "hi").agg(F.min("fid").alias("f"), F.max("fid").alias("g"), F.count(F.lit(1)).alias("n"))
    for side in "fg":
        two = two.join(normal.select("specimen_id", F.col("fid").alias(side), *(F.col(f"n{c}").alias(f"{side}{c}") for c in "xyz")), ["specimen_id", side])
    angle = F.when(F.col("n") == 2, F.acos(g.clip(g.dot(g.vector("f"), g.vector("g")), -1.0, 1.0))).otherwise(0.0)
    return two.select("specimen_id", "lo", "hi", angle.alias("angle"))


def mean_dihedral(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Mean absolute angle between faces over the edges of each vertex."""
    e = _angles(face_geometry(vertices, faces))
    return e.select("specimen_id", F.explode(F.array("lo", "hi")).alias("vid"), "angle").groupBy("specimen_id", "vid").agg(F.avg("angle").alias("dihedral"))


def vertex_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Area-weighted unit normals of vertices."""
    n = face_geometry(vertices, faces).select("specimen_id", F.explode(F.array("a", "b", "c")).alias("vid"), *((F.col(f"n{c}") * F.col("area")).alias(f"n{c}") for c in "xyz"))
    n = n.groupBy("specimen_id", "vid").agg(*(F.sum(f"n{c}").alias(f"n{c}") for c in "xyz"))
    size = g.norm(g.vector("n")) + F.lit(1e-12)
    return n.select("specimen_id", "vid", *((F.col(f"n{c}") / size).alias(f"n{c}") for c in "xyz"))


def normal_variation(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Mean angle between a vertex's normal and those its edges lead to."""
    own = own_columns(faces)
    n, e = vertex_normals(vertices, faces), adjacency(faces, *own)
    out = n.withColumnRenamed("vid", "src").join(e, [*own, "src"])
    out = out.join(n.select("specimen_id", F.col("vid").alias("dst"), *(F.col(f"n{c}").alias(f"m{c}") for c in "xyz")), ["specimen_id", "dst"])
    angle = F.acos(g.clip(g.dot(g.vector("n"), g.vector("m")), -1.0, 1.0))
    return out.groupBy("specimen_id", F.col("src").alias("vid")).agg(F.avg(angle).alias("variation"))


def outward(points: DataFrame) -> DataFrame:
    """Normals (nx, ny, nz) turned away from the specimen's centroid."""
    mid = points.groupBy("specimen_id").agg(*(F.avg(c).alias(f"m{c}") for c in "xyz"))
    out = points.join(mid, "specimen_id")
    inward = g.dot(g.vector("n"), g.minus(g.vector(), g.vector("m"))) < 0
    return out.withColumns({f"n{c}": F.when(inward, -F.col(f"n{c}")).otherwise(F.col(f"n{c}")) for c in "xyz"}).drop("mx", "my", "mz")


def repair(vertices: DataFrame, faces: DataFrame, most: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """Vertices that are finite, numbered anew from 0, and the faces that keep all
    three; raises if more than ``most`` of a mesh's vertices go, or all its faces."""
    from pyspark.sql import Window

    good = vertices.where(g.all_finite(g.vector()))
    lost = vertices.groupBy("specimen_id").agg(F.avg((~g.all_finite(g.vector())).cast("double")).alias("lost")).where(F.col("lost") > most)
    if not lost.isEmpty():
        raise ValueError("too many vertices are not finite")
    number = F.row_number().over(Window.partitionBy("specimen_id").orderBy("vid")) - 1
    numbered = good.withColumn("new", number.cast("long"))
    out = faces
    for c in "abc":
        out = out.join(numbered.select("specimen_id", F.col("vid").alias(c), F.col("new").alias(f"new_{c}")), ["specimen_id", c])
    out = out.select("specimen_id", "fid", *(F.col(f"new_{c}").alias(c) for c in "abc"))
    if not faces.select("specimen_id").distinct().join(out.select("specimen_id").distinct(), "specimen_id", "left_anti").isEmpty():
        raise ValueError("no faces remain")
    return numbered.withColumn("vid", F.col("new")).drop("new"), out


def pooled_median(values: DataFrame, faces: DataFrame, hops: int = 1) -> DataFrame:
    """Median of each feature over the vertices within ``hops`` edges."""
    near = ring(faces, hops)
    return near.join(values.withColumnRenamed("vid", "dst"), [*own_columns(faces), "dst"]).groupBy("specimen_id", F.col("src").alias("vid"), "fidx").agg(F.median("v").alias("v"))


def smooth(vertices: DataFrame, faces: DataFrame, step: float = 0.5) -> DataFrame:
    """One step of every vertex towards the mean of its neighbours."""
    own = own_columns(faces)
    near = adjacency(faces, *own).join(vertices.withColumnRenamed("vid", "dst"), [*own, "dst"]).groupBy("specimen_id", F.col("src").alias("vid")).agg(*(F.avg(c).alias(f"m{c}") for c in "xyz"))
    return vertices.join(near, ["specimen_id", "vid"]).select("specimen_id", "vid", *((F.col(c) + step * (F.col(f"m{c}") - F.col(c))).alias(c) for c in "xyz"))


def whole(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """One row for each mesh: its vertices (i, x, y, z), its faces' corners (a, b, c) and numbers (fid) as arrays, null without faces."""
    corner = F.array_sort(F.collect_list(F.struct(F.col("fid").cast("long").alias("fid"), *(F.col(c).cast("long").alias(c) for c in "abc")))).alias("f")
    rows = shapes(vertices, "vid")
    if own_columns(faces):
        rows = rows.join(faces.groupBy("specimen_id").agg(corner), "specimen_id", "left")
    else:
        rows = rows.crossJoin(faces.agg(corner))  # one topology, one row
    return rows.select("specimen_id", *"ixyz", *(F.col(f"f.{c}").alias(c) for c in (*"abc", "fid")))


def smoothed(vertices: DataFrame, faces: DataFrame, scales: tuple[int, ...], step: float = 0.5) -> DataFrame:
    """Each mesh after each of several numbers of smoothing steps (specimen_id, scale, vid, x, y, z).

    Steps are those of :func:`smooth`, one mesh at a time in a task; vertices
    without edges stay where they are.
    """
    rows = whole(vertices, faces)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                index, p = np.asarray(row.i), np.stack([row.x, row.y, row.z], 1)
                f = np.zeros((0, 3), np.int64) if row.a is None else np.stack([row.a, row.b, row.c], 1).astype(np.int64)
                f = np.searchsorted(index, f[np.isin(f, index).all(1)])
                e = np.unique(np.sort(np.concatenate([f[:, [0, 1]], f[:, [1, 2]], f[:, [2, 0]]]), 1), axis=0)
                degree = np.bincount(e.ravel(), minlength=len(p))[:, None]
                for n in range(max(scales) + 1):
                    if n in scales:
                        yield pd.DataFrame({"specimen_id": row.specimen_id, "scale": np.int32(n), "vid": index, "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})
                    around = np.zeros_like(p)
                    np.add.at(around, e[:, 0], p[e[:, 1]])
                    np.add.at(around, e[:, 1], p[e[:, 0]])
                    p = np.where(degree > 0, p + step * (around / np.maximum(degree, 1) - p), p)

    return rows.mapInPandas(run, "specimen_id long, scale int, vid long, x double, y double, z double")


def curvature(vertices: DataFrame, faces: DataFrame, signed: bool = False) -> DataFrame:
    """Discrete mean curvature (half the Laplacian's length over the area) and
    Gaussian curvature (angle defect over the area) of each vertex.

    ``signed``, the mean curvature is negative where the surface bends towards
    the side that its faces' normals point to.
    """
    w = cotangent_weights(vertices, faces)
    way = lambda i, j: F.struct(F.col(i).alias("vid"), F.col(j).alias("to"), "w")
    both = w.select("specimen_id", F.inline(F.array(way("lo", "hi"), way("hi", "lo"))))
    pull = both.join(vertices, ["specimen_id", "vid"]).join(vertices.select("specimen_id", F.col("vid").alias("to"), *(F.col(c).alias(f"t{c}") for c in "xyz")), ["specimen_id", "to"])
    pull = pull.groupBy("specimen_id", "vid").agg(*(F.sum(F.col("w") * (F.col(f"t{c}") - F.col(c))).alias(f"l{c}") for c in "xyz"))
    normal, area = g.triangle_normal(*(g.vector(c) for c in "abc"))
    parts = []
    for o, i, j in ("abc", "bca", "cab"):
        u, v = g.minus(g.vector(i), g.vector(o)), g.minus(g.vector(j), g.vector(o))
        angle = F.acos(g.clip(g.dot(u, v) / (g.norm(u) * g.norm(v) + F.lit(1e-12)), -1.0, 1.0))
        parts.append(F.struct(F.col(o).alias("vid"), angle.alias("angle"), area.alias("area"), *((n * area).alias(f"n{c}") for n, c in zip(normal, "xyz", strict=True))))
    around = corners(vertices, faces).select("specimen_id", F.inline(F.array(*parts))).groupBy("specimen_id", "vid")
    out = pull.join(around.agg((2 * F.pi() - F.sum("angle")).alias("defect"), F.greatest(F.sum(F.col("area") / 3), F.lit(1e-12)).alias("area"), *(F.sum(f"n{c}").alias(f"n{c}") for c in "xyz")), ["specimen_id", "vid"])
    size = g.norm(g.vector("l"))
    if signed:
        size = F.when(g.dot(g.vector("l"), g.vector("n")) > 0, -size).otherwise(size)
    return out.select("specimen_id", "vid", (size / (2 * F.col("area"))).alias("mean_curvature"), (F.col("defect") / F.col("area")).alias("gauss_curvature"))
