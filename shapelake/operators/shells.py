"""Connected parts of meshes and graphs, merged vertices, and which side of a surface a point is on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..sources.lineage import cut
from . import kernels, mesh
from .neighbors import alike, arrays, larger, shapes
from .surfaces import closest_points

XYZ = ("x", "y", "z")


def components(nodes: DataFrame, edges: DataFrame, *by: str, rounds: int = 200) -> DataFrame:
    """(by.., node, component): the lowest node that edges (by.., src, dst) lead to, for all of ``nodes`` (by.., node).

    Each round, a node takes the lowest label around it, and then that label's own
    label, so that labels run along paths in doubling steps. Edges count both ways
    and may repeat; nodes without edges are their own component. It is an error if
    labels still change after ``rounds``.
    """
    both = edges.select(*by, "src", "dst").unionByName(edges.select(*by, F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    both = cut(both)
    now = cut(nodes.select(*by, "node").distinct().withColumn("component", F.col("node")))
    for _ in range(rounds):
        around = both.join(now.withColumnRenamed("node", "dst"), [*by, "dst"]).groupBy(*by, F.col("src").alias("node")).agg(F.min("component").alias("least"))
        step = now.join(around, [*by, "node"], "left").select(*by, "node", F.col("component").alias("was"), F.least("component", F.coalesce("least", "component")).alias("component"))
        step = cut(step)
        jump = step.select(*by, F.col("node").alias("component"), F.col("component").alias("further"))
        after = cut(step.join(jump, [*by, "component"], "left").select(*by, "node", "was", F.coalesce("further", "component").alias("component")))
        now = after.drop("was")
        if after.where("component <> was").isEmpty():
            return now
    raise RuntimeError(f"components have not settled after {rounds} rounds")


def mesh_components(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(specimen_id, vid, component) of each mesh's vertices; a shared topology is searched once."""
    own = mesh.own_columns(faces)
    corners = faces.select(*own, F.explode(F.array(*(F.col(c).cast("long") for c in "abc"))).alias("node"))
    steps = mesh.adjacency(faces, *own).select(*own, *(F.col(c).cast("long").alias(c) for c in ("src", "dst")))
    found = components(corners, steps, *own)
    of = vertices.select("specimen_id", F.col("vid").cast("long").alias("vid"))
    return of.join(found.withColumnRenamed("node", "vid"), [*own, "vid"], "left").select("specimen_id", "vid", F.coalesce("component", "vid").alias("component"))


def component_sizes(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(specimen_id, component, n_vertices, n_faces)."""
    of = mesh_components(vertices, faces)
    own = mesh.own_columns(faces)
    sides = faces.select(*own, F.col("a").cast("long").alias("vid"))
    n = of.join(sides.groupBy(*own, "vid").agg(F.count(F.lit(1)).alias("f")), [*own, "vid"], "left")
    return n.groupBy("specimen_id", "component").agg(F.count(F.lit(1)).alias("n_vertices"), F.coalesce(F.sum("f"), F.lit(0)).alias("n_faces"))


def outer_shell(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Faces (specimen_id, fid, a, b, c) of the component that is met first from far above
    a mesh's box, ten diagonals up the third axis: inner shells are left out."""
    box = vertices.groupBy("specimen_id").agg(*(f(c).alias(f"{n}{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in XYZ))
    diagonal = F.sqrt(g.distance2(g.vector("hi"), g.vector("lo"))) + F.lit(1e-12)
    mid = [(F.col(f"lo{c}") + F.col(f"hi{c}")) / 2 for c in XYZ]
    eye = box.select("specimen_id", mid[0].alias("ex"), mid[1].alias("ey"), (mid[2] + 10 * diagonal).alias("ez"))
    of = mesh_components(vertices, faces)
    near = vertices.join(eye, "specimen_id").join(of, ["specimen_id", "vid"])
    on_face = mesh.corners(vertices, faces).select("specimen_id", F.explode(F.array("a", "b", "c")).alias("vid")).distinct()
    near = near.join(on_face, ["specimen_id", "vid"], "left_semi")
    first = near.groupBy("specimen_id").agg(F.min(F.struct(g.distance2(g.vector(), g.vector("e")).alias("d2"), "vid", "component")).alias("m")).select("specimen_id", F.col("m.component").alias("component"))
    every = mesh.corners(vertices, faces).select("specimen_id", "fid", "a", "b", "c")
    return every.join(of.withColumnRenamed("vid", "a"), ["specimen_id", "a"]).join(first, ["specimen_id", "component"], "left_semi").select("specimen_id", "fid", "a", "b", "c")


def _turned_out(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(specimen_id, way): 1 where a closed mesh's normals point out, -1 where they point in, by the sign of its volume."""
    volume = g.dot(g.vector("a"), g.cross(g.vector("b"), g.vector("c"))) / 6
    mid = vertices.groupBy("specimen_id").agg(*(F.avg(c).alias(f"m{c}") for c in XYZ))
    moved = vertices.join(mid, "specimen_id").select("specimen_id", "vid", *((F.col(c) - F.col(f"m{c}")).alias(c) for c in XYZ))
    return mesh.corners(moved, faces).groupBy("specimen_id").agg(F.when(F.sum(volume) < 0, -1.0).otherwise(1.0).alias("way"))


def signed_distance(queries: DataFrame, vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(specimen_id, pidx, d, qx, qy, qz, nx, ny, nz): signed distance from each mesh's
    surface, negative inside; the closest point and the outward direction there.

    The direction is the normal of the face, of the two faces of an edge, or of a
    corner with faces weighed by their angles, whatever the closest point lies on:
    its side decides rightly for every point (Baerentzen and Aanaes 2005). Faces
    are taken to be wound alike; a mesh with a negative volume is turned.
    """
    tri = mesh.corners(vertices, faces)
    normal, _ = g.triangle_normal(*(g.vector(c) for c in "abc"))
    tri = tri.select("specimen_id", F.col("fid").cast("long").alias("fid"), *"abc", *(f"{c}{n}" for c in "abc" for n in XYZ), *(v.alias(f"f{n}") for v, n in zip(normal, XYZ, strict=True)))
    around, along = [], []
    for o, i, j in ("abc", "bca", "cab"):
        u, v = g.minus(g.vector(i), g.vector(o)), g.minus(g.vector(j), g.vector(o))
        angle = F.acos(g.clip(g.dot(u, v) / (g.norm(u) * g.norm(v) + F.lit(1e-300)), -1.0, 1.0))
        around.append(F.struct(F.col(o).cast("long").alias("vid"), *((angle * F.col(f"f{n}")).alias(f"v{n}") for n in XYZ)))
        along.append(F.struct(F.least(i, j).cast("long").alias("lo"), F.greatest(i, j).cast("long").alias("hi"), *(F.col(f"f{n}").alias(f"e{n}") for n in XYZ)))
    at_vertex = tri.select("specimen_id", F.inline(F.array(*around))).groupBy("specimen_id", "vid").agg(*(F.sum(f"v{n}").alias(f"v{n}") for n in XYZ))
    at_edge = tri.select("specimen_id", F.inline(F.array(*along))).groupBy("specimen_id", "lo", "hi").agg(*(F.sum(f"e{n}").alias(f"e{n}") for n in XYZ))
    near = closest_points(queries, vertices, faces).join(tri, ["specimen_id", "fid"])
    on = [F.col(f"w{c}") > 1e-9 for c in "abc"]
    count = sum((o.cast("int") for o in on), F.lit(0))
    held = F.filter(F.array(*(F.when(o, F.col(c).cast("long")) for o, c in zip(on, "abc", strict=True))), lambda v: v.isNotNull())
    near = near.withColumn("count", count).withColumn("vid", F.when(F.col("count") == 1, held[0])).withColumn("lo", F.when(F.col("count") == 2, F.array_min(held))).withColumn("hi", F.when(F.col("count") == 2, F.array_max(held)))
    near = near.join(at_vertex, ["specimen_id", "vid"], "left").join(at_edge, ["specimen_id", "lo", "hi"], "left").join(_turned_out(vertices, faces), "specimen_id")
    way = [F.col("way") * F.coalesce(f"v{n}", f"e{n}", f"f{n}") for n in XYZ]
    size = F.sqrt(sum((w * w for w in way), F.lit(0.0))) + F.lit(1e-300)
    found = near.select("specimen_id", F.col("qidx").alias("pidx"), "d2", *(sum((F.col(f"w{c}") * F.col(f"{c}{n}") for c in "abc"), F.lit(0.0)).alias(f"q{n}") for n in XYZ), *((w / size).alias(f"n{n}") for w, n in zip(way, XYZ, strict=True)))
    both = found.join(queries.select("specimen_id", F.col("pidx").cast("long").alias("pidx"), *XYZ), ["specimen_id", "pidx"])
    side = g.dot(g.minus(g.vector(), g.vector("q")), g.vector("n"))
    return both.select("specimen_id", "pidx", F.when(side < 0, -F.sqrt("d2")).otherwise(F.sqrt("d2")).alias("d"), *(f"q{n}" for n in XYZ), *(f"n{n}" for n in XYZ))


def outside_projection(marks: DataFrame, vertices: DataFrame, faces: DataFrame, *, most: float, near: float = 5e-4, lift: float = 1e-3, k: int = 6, weight: float = 0.7, smooth: float = 2.0) -> DataFrame:
    """Landmarks (specimen_id, pidx, x, y, z) moved together onto the outer shell of their mesh, none left inside it.

    Lengths ``near``, ``lift`` and ``most`` are shares of the box's diagonal. Marks
    outside and within ``near`` of the surface stay. The others are drawn to their
    closest points, lifted by ``lift`` where they are inside, while the graph of
    ``k`` neighbours holds them together (one small solve a specimen); no move is longer than ``most``;
    then each goes to its closest point, lifted if that is not outside.
    """
    outer = cut(outer_shell(vertices, faces))
    box = vertices.groupBy("specimen_id").agg(*(f(c).alias(f"{n}{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in XYZ)).select("specimen_id", F.sqrt(g.distance2(g.vector("hi"), g.vector("lo"))).alias("diagonal"))
    start = marks.select("specimen_id", F.col("pidx").cast("long").alias("pidx"), *XYZ)
    first = signed_distance(start, vertices, outer).join(box, "specimen_id")
    stays = (F.col("d") >= 0) & (F.col("d") <= near * F.col("diagonal"))
    up = F.when(F.col("d") < 0, lift * F.col("diagonal")).otherwise(0.0)
    first = first.select("specimen_id", "pidx", "diagonal", stays.alias("stays"), *((F.col(f"q{c}") + up * F.col(f"n{c}")).alias(f"q{c}") for c in XYZ))
    rows = start.join(first, ["specimen_id", "pidx"]).groupBy("specimen_id").agg(F.max("diagonal").alias("diagonal"), F.array_sort(F.collect_list(F.struct("pidx", *XYZ, "qx", "qy", "qz", "stays"))).alias("m"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                p, q = (np.array([[r[f"{s}{c}"] for c in XYZ] for r in row.m], float) for s in ("", "q"))
                fixed = np.array([r["stays"] for r in row.m], bool)
                moved = kernels.held_together(p, q, fixed, k, weight, smooth, most * row.diagonal)
                yield pd.DataFrame({"specimen_id": row.specimen_id, "pidx": [r["pidx"] for r in row.m], **dict(zip(XYZ, moved.T, strict=True)), "stays": fixed})

    moved = cut(rows.mapInPandas(run, "specimen_id long, pidx long, x double, y double, z double, stays boolean"))
    last = signed_distance(moved.where("NOT stays").drop("stays"), vertices, outer).join(box, "specimen_id")
    snapped = last.select("specimen_id", "pidx", *((F.col(f"q{c}") + F.lit(1e-9) * F.col("diagonal") * F.col(f"n{c}")).alias(c) for c in XYZ))
    return moved.where("stays").drop("stays").unionByName(snapped)


def _merged(i: np.ndarray, p: np.ndarray, tolerance: float) -> np.ndarray:
    """The lowest place (many x n) that steps of at most ``tolerance`` lead to from each point of many shapes."""
    d2 = sum((p[:, :, None, c] - p[:, None, :, c]) ** 2 for c in range(3))
    joined = (d2 <= tolerance * tolerance) | (i[:, :, None] == i[:, None])
    into = np.broadcast_to(np.arange(i.shape[1]), i.shape)
    while True:
        least = np.where(joined, into[:, None], i.shape[1]).min(2)
        least = np.take_along_axis(least, least, 1)  # and that place's own
        if (least == into).all():
            return into
        into = least


def _coincident_in(tolerance: float):
    schema = pa.schema([("specimen_id", pa.int64()), ("vid", pa.int64()), ("into", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            specimens = np.asarray(batch.column(0))
            for rows in alike(batch, 1):
                i, p = arrays(batch, rows, 1)
                with np.errstate(invalid="ignore"):
                    into = np.take_along_axis(i, _merged(i, p, tolerance), 1)
                once = np.diff(i, axis=1, prepend=i[:, :1] - 1) != 0
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(specimens[rows], once.sum(1))), pa.array(i[once]), pa.array(into[once])], schema=schema)

    return run


def coincident(vertices: DataFrame, tolerance: float, whole: int = 1024) -> DataFrame:
    """(specimen_id, vid, into): the lowest vertex that steps of at most ``tolerance`` lead to.

    Meshes of up to ``whole`` vertices are merged in a task. Vertices of larger ones meet in
    cells as wide as the tolerance and the cells around; 0 merges equal positions only. Vertices that are not finite are left alone.
    """
    good = vertices.where(g.all_finite(g.vector())).select("specimen_id", F.col("vid").cast("long").alias("vid"), *XYZ)
    every = vertices.select("specimen_id", F.col("vid").cast("long").alias("node"))
    if tolerance <= 0:
        least = F.min("vid").over(Window.partitionBy("specimen_id", *XYZ))
        same = good.select("specimen_id", F.col("vid").alias("node"), least.alias("into"))
        return every.join(same, ["specimen_id", "node"], "left").select("specimen_id", F.col("node").alias("vid"), F.coalesce("into", "node").alias("into"))
    large = larger(vertices, whole)
    few = vertices if large is None else vertices.join(large, "specimen_id", "left_anti")
    found = shapes(few, "vid").mapInArrow(_coincident_in(tolerance), "specimen_id long, vid long, into long")
    if large is None:
        return found
    good, every = (v.join(large, "specimen_id", "left_semi") for v in (good, every))
    cell = [F.floor(F.col(c) / tolerance).cast("long").alias(f"k{c}") for c in XYZ]
    base = good.select("*", *cell)
    off = F.explode(F.array(*(F.struct(*((F.col(f"k{c}") + F.lit(d - 1)).alias(f"k{c}") for c, d in zip(XYZ, o, strict=True))) for o in np.ndindex(3, 3, 3)))).alias("k")
    around = base.select("specimen_id", F.col("vid").alias("src"), *XYZ, off).select("specimen_id", "src", *XYZ, "k.*")
    other = base.select("specimen_id", F.col("vid").alias("dst"), *(F.col(c).alias(f"t{c}") for c in XYZ), "kx", "ky", "kz")
    edges = around.join(other, ["specimen_id", "kx", "ky", "kz"]).where((F.col("src") < F.col("dst")) & (g.distance2(g.vector(), g.vector("t")) <= tolerance * tolerance))
    return found.unionByName(components(every, edges, "specimen_id").select("specimen_id", F.col("node").alias("vid"), F.col("component").alias("into")))


def triangulated(polygons: DataFrame) -> DataFrame:
    """Triangles (.., fid, a, b, c) of convex polygons (.., fid, vids), as fans from their first corner, numbered anew."""
    own = [c for c in polygons.columns if c not in ("fid", "vids")]
    fan = F.posexplode(F.transform(F.sequence(F.lit(2), F.greatest(F.size("vids") - 1, F.lit(2))), lambda k: F.struct(F.get("vids", F.lit(0)).alias("a"), F.get("vids", k - 1).alias("b"), F.get("vids", k).alias("c"))))
    rows = polygons.where(F.size("vids") > 2).select(*own, F.col("fid").alias("polygon"), fan.alias("at", "t"))
    # A number from the polygon's and the place in its fan: no ordering of all triangles in one task.
    return rows.select(*own, F.shiftleft(F.col("polygon").cast("long"), 20).bitwiseOR(F.col("at").cast("long")).alias("fid"), "t.a", "t.b", "t.c")


def cleaned(vertices: DataFrame, faces: DataFrame, tolerance: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """A mesh whose coincident vertices are one: vertices (specimen_id, vid, x, y, z) that
    remain, and faces (specimen_id, fid, a, b, c) renumbered to them. Faces that lose a
    corner, repeat another's corners, or leave a vertex unused go, and so do such vertices."""
    into = coincident(vertices, tolerance)
    out = mesh.corners(vertices, faces).select("specimen_id", "fid", *(F.col(c).cast("long").alias(c) for c in "abc"))
    for c in "abc":
        out = out.join(into.select("specimen_id", F.col("vid").alias(c), F.col("into").alias(f"new_{c}")), ["specimen_id", c])
    out = out.select("specimen_id", "fid", *(F.col(f"new_{c}").alias(c) for c in "abc")).where("a <> b AND b <> c AND a <> c")
    corners = F.array_sort(F.array("a", "b", "c"))
    out = out.withColumn("key", corners).groupBy("specimen_id", "key").agg(F.min(F.struct("fid", "a", "b", "c")).alias("f")).select("specimen_id", "f.*")
    used = out.select("specimen_id", F.explode(F.array("a", "b", "c")).alias("vid")).distinct()
    kept = vertices.select("specimen_id", F.col("vid").cast("long").alias("vid"), *XYZ).join(used, ["specimen_id", "vid"], "left_semi")
    return kept, out
