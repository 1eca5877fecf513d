"""Closest points on triangle surfaces and what is carried by them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import boxes
from .mesh import corners, own_columns, whole
from .neighbors import FEW, alike, arrays, nearest_in, parts, shapes, tasks

CLOSEST = "specimen_id long, qidx long, fid long, wa double, wb double, wc double, d2 double"


def _apart(q: np.ndarray, tri: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of points (m x 3) from triangles (n x 3 x 3, or m x n x 3 x 3 for
    each point its own) and the barycentric weights of the closest points.

    The closest point is inside, or the best of the three edges' closest points.
    """
    q, a, b, c = q[:, None], tri[..., 0, :], tri[..., 1, :], tri[..., 2, :]
    u, v = b - a, c - a
    uu, uv, vv = (u * u).sum(-1), (u * v).sum(-1), (v * v).sum(-1)
    below = uu * vv - uv * uv
    w = q - a
    wu, wv = (w * u).sum(-1), (w * v).sum(-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        beta, gamma = (vv * wu - uv * wv) / below, (uu * wv - uv * wu) / below
    inside = (below > 1e-12) & (beta >= 0) & (gamma >= 0) & (beta + gamma <= 1)
    options = [np.where(inside[..., None], np.stack([1 - beta - gamma, beta, gamma], -1), np.nan)]
    for i, j in ((0, 1), (1, 2), (2, 0)):
        s, e = tri[..., i, :], tri[..., j, :] - tri[..., i, :]
        t = np.clip(((q - s) * e).sum(-1) / np.maximum((e * e).sum(-1), 1e-300), 0, 1)
        edge = np.zeros((*t.shape, 3))
        edge[..., i], edge[..., j] = 1 - t, t
        options.append(edge)
    best_d, best_w = np.full(inside.shape, np.inf), np.zeros((*inside.shape, 3))
    for o in options:
        there = o[..., :1] * a + o[..., 1:2] * b + o[..., 2:] * c
        d2 = ((q - there) ** 2).sum(-1)
        nearer = d2 < best_d
        best_d, best_w = np.where(nearer, d2, best_d), np.where(nearer[..., None], o, best_w)
    return best_d, best_w


def closest_on_triangles(p: np.ndarray, tri: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each point the triangle (of ``tri``, n x 3 x 3) that is nearest, the lowest
    of equals, the barycentric weights of its closest point and the squared distance.

    Many triangles are searched in leaves of triangles that lie together.
    """
    face, weight, apart = np.zeros(len(p), np.int64), np.zeros((len(p), 3)), np.zeros(len(p))
    if len(tri) > 256 and np.isfinite(p).all() and np.isfinite(tri).all():
        face = boxes.nearest(p, tri.min(1), tri.max(1), 1, lambda q, at: _apart(q, tri[at])[0])[0][:, 0]
        for at in range(0, len(p), 65_536):
            d2, w = _apart(p[at : at + 65_536], tri[face[at : at + 65_536]][:, None])
            apart[at : at + 65_536], weight[at : at + 65_536] = d2[:, 0], w[:, 0]
        return face, weight, apart
    block = max(1, 65_536 // max(len(tri), 1))
    for at in range(0, len(p), block):
        d2, w = _apart(p[at : at + block], tri)
        k, rows = d2.argmin(1), np.arange(len(d2))
        face[at : at + block], weight[at : at + block], apart[at : at + block] = k, w[rows, k], d2[rows, k]
    return face, weight, apart


def closest_on_few(p: np.ndarray, tri: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`closest_on_triangles` of many shapes of few triangles each: points (many x m x 3), triangles (many x n x 3 x 3)."""
    many, m = p.shape[:2]
    face, weight, apart = np.zeros((many, m), np.int64), np.zeros((many, m, 3)), np.zeros((many, m))
    block = max(1, 65_536 // max(1, m * tri.shape[1]))
    for at in range(0, many, block):
        d2, w = _apart(p[at : at + block].reshape(-1, 3), np.repeat(tri[at : at + block], m, axis=0))
        k, rows = d2.argmin(1), np.arange(len(d2))
        for out, found in ((face, k), (weight, w[rows, k]), (apart, d2[rows, k])):
            out[at : at + block] = found.reshape(-1, *out.shape[1:])
    return face, weight, apart


def surface_rows(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Specimens with faces as a row each, dealt out to all cores: vertices (vi, vx, vy, vz) and faces (fid, a, b, c) as arrays."""
    n = tasks(vertices)
    rows = whole(vertices.repartition(n, "specimen_id"), faces.repartition(n, "specimen_id") if own_columns(faces) else faces)
    return rows.where("a IS NOT NULL").select("specimen_id", *(F.col(c).alias(f"v{c}") for c in "ixyz"), "fid", *"abc")


def triangles(batch: pa.RecordBatch, rows: np.ndarray, first: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of the specimens ``rows``, all of one size, with :func:`surface_rows`'s columns from ``first`` on: which of them,
    the numbers (many x n), corners' places (many x n x 3) and positions (many x n x 3 x 3) of the faces all of whose corners
    are vertices. They come together if they have the same faces."""
    (vi, v), (fid, f) = arrays(batch, rows, first), arrays(batch, rows, first + 4)
    alike_ = len(rows) and (vi == vi[0]).all() and (f == f[0]).all()
    for at in [slice(None)] if alike_ else (slice(k, k + 1) for k in range(len(rows))):
        there = np.isin(f[at][0], vi[at][0]).all(1)
        if there.any():
            place = np.searchsorted(vi[at][0], f[at][0][there])
            yield at, fid[at][:, there], np.broadcast_to(place, (len(vi[at]), *place.shape)), v[at][:, place]


_CLOSEST = pa.schema([("specimen_id", pa.int64()), ("qidx", pa.int64()), ("fid", pa.int64()), *((c, pa.float64()) for c in ("wa", "wb", "wc", "d2", "x", "y", "z"))])


def _closest(queries: DataFrame, vertices: DataFrame, faces: DataFrame, block: int) -> DataFrame:
    """:func:`closest_points` and their positions."""
    rows = shapes(queries.repartition(tasks(vertices), "specimen_id")).join(surface_rows(vertices, faces), "specimen_id")
    rows = parts(rows, block, "vi", "vx", "vy", "vz", "fid", "a", "b", "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            specimens, numbers = (np.asarray(batch.column(c)) for c in (0, 1))
            for of in alike(batch, 2, 6, 10, few=min(FEW, block)):
                every, p = arrays(batch, of, 2)
                if p.shape[1] > block:  # such rows come alone
                    own = slice(numbers[of[0]] * block, (numbers[of[0]] + 1) * block)
                    every, p = every[:, own], p[:, own]
                for at, fid, _, tri in triangles(batch, of, 6):
                    q = p[at]
                    k, w, d2 = closest_on_few(q, tri) if len(q) > 1 else (x[None] for x in closest_on_triangles(q[0], tri[0]))
                    on = (w[..., None] * np.take_along_axis(tri, k[..., None, None], 1)).reshape(-1, 3, 3)
                    on = on[:, 0] + on[:, 1] + on[:, 2]
                    flat = w.reshape(-1, 3)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(specimens[of[at]], q.shape[1])), pa.array(every[at].ravel()), pa.array(np.take_along_axis(fid, k, 1).ravel()), *(pa.array(flat[:, c]) for c in range(3)), pa.array(d2.ravel()), *(pa.array(on[:, c]) for c in range(3))], schema=_CLOSEST)

    return rows.mapInArrow(run, f"{CLOSEST}, x double, y double, z double")


def closest_points(queries: DataFrame, vertices: DataFrame, faces: DataFrame, block: int = 65_536) -> DataFrame:
    """Nearest face of the specimen's surface for each query point (specimen_id,
    pidx), with the barycentric weights of the closest point and the squared
    distance. Large query sets of a specimen are dealt out in blocks; specimens of few
    points and triangles are searched many at a time, corners are no rows."""
    return _closest(queries, vertices, faces, block).drop(*"xyz")


def onto_surface(points: DataFrame, vertices: DataFrame, faces: DataFrame, block: int = 65_536) -> DataFrame:
    """(specimen_id, pidx, x, y, z): each point's closest point on the specimen's surface."""
    return _closest(points, vertices, faces, block).select("specimen_id", F.col("qidx").alias("pidx"), *"xyz")


def on_surface(closest: DataFrame, vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Positions on a surface of :func:`closest_points` found on it, or on another pose of it:
    landmarks are carried by the weights of their triangle."""
    tri = corners(vertices, faces).withColumn("fid", F.col("fid").cast("long"))
    return closest.join(tri, ["specimen_id", "fid"]).select("specimen_id", F.col("qidx").alias("pidx"), *((F.col("wa") * F.col(f"a{n}") + F.col("wb") * F.col(f"b{n}") + F.col("wc") * F.col(f"c{n}")).alias(n) for n in "xyz"))


def surface_distance(queries: DataFrame, vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Median distance of each specimen's points from its surface."""
    return closest_points(queries, vertices, faces).groupBy("specimen_id").agg(F.median(F.sqrt("d2")).alias("median_distance"))


_NORMALS = pa.schema([("specimen_id", pa.int64()), ("pidx", pa.int64()), ("nx", pa.float64()), ("ny", pa.float64()), ("nz", pa.float64())])


def _least_axes(p: np.ndarray, index: np.ndarray, near: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Least principal axes (many x m x 3) of the points ``q`` and those of ``index`` that are ``near``, away from the means of ``p``."""
    around = p[np.arange(len(p))[:, None, None], index]
    n = near.sum(2)[..., None] + 1
    mean = (np.where(near[..., None], around, 0).sum(2) + q) / n
    off, own = np.where(near[..., None], around - mean[:, :, None], 0), q - mean
    moments = (np.einsum("abki,abkj->abij", off, off) + own[..., None] * own[..., None, :]) / n[..., None]
    known = np.isfinite(moments).all((2, 3))
    axis = np.where(known[..., None], np.linalg.eigh(np.where(known[..., None, None], moments, 0))[1][..., 0], np.nan)
    return np.where(((axis * (q - p.mean(1, keepdims=True))).sum(-1) < 0)[..., None], -axis, axis)


def cloud_normals(points: DataFrame, radius: float, most: int = 30, block: int = 65_536) -> DataFrame:
    """Unit normal of each point: the least principal axis of its neighbourhood,
    turned away from the specimen's centroid. Found where the neighbours are, a
    large specimen's in blocks of points; neighbours are no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            specimens, numbers = (np.asarray(batch.column(c)) for c in (0, 1))
            for rows in alike(batch, 2, few=min(FEW, block)):
                i, p = arrays(batch, rows, 2)
                at = slice(numbers[rows[0]] * block, (numbers[rows[0]] + 1) * block) if p.shape[1] > block else slice(None)
                qi, q = i[:, at], p[:, at]
                index, d2 = nearest_in(qi, q, i, p, most, True)
                n = _least_axes(p, index, d2 <= radius * radius, q).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(specimens[rows], qi.shape[1])), pa.array(qi.ravel()), *(pa.array(n[:, c]) for c in range(3))], schema=_NORMALS)

    found = parts(shapes(points), block).mapInArrow(run, "specimen_id long, pidx long, nx double, ny double, nz double")
    return found.withColumn("pidx", F.col("pidx").cast(points.schema["pidx"].dataType))
