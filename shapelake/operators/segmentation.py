"""Segmenting landmarks into regions by what the surface does around them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import kernels, mesh
from .neighbors import tasks
from .points import principal_axis
from .quantiles import exact_median


def z_scores(features: DataFrame) -> DataFrame:
    """Features (specimen_id, pidx, fidx, v) less their mean over the population deviation plus 1e-8, within specimen and feature."""
    stats = features.groupBy("specimen_id", "fidx").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    return features.join(stats, ["specimen_id", "fidx"]).select("specimen_id", "pidx", "fidx", ((F.col("v") - F.col("m")) / (F.col("s") + F.lit(1e-8))).alias("v"))


def clean(features: DataFrame) -> DataFrame:
    """Features whose NaN, infinite or null values are the feature's median."""
    good = F.when(~F.isnan("v") & (F.abs("v") < F.lit(float("inf"))), F.col("v"))
    middle = exact_median(features.select("fidx", good.alias("good")), ["fidx"], "good", "middle")
    return features.join(middle, "fidx").select("specimen_id", "pidx", "fidx", F.coalesce(good, "middle").alias("v"))


def edge_feature_median(features: DataFrame, edges: DataFrame) -> DataFrame:
    """For each edge (src, dst) the root of the median over specimens of the squared feature distance, plus 1e-12."""
    ends = [features.select("specimen_id", "fidx", F.col("pidx").alias(n), F.col("v").alias(f"v_{n}")) for n in ("src", "dst")]
    rows = edges.select("src", "dst").join(ends[0], "src").join(ends[1], ["specimen_id", "fidx", "dst"])
    apart = rows.groupBy("src", "dst", "specimen_id").agg(F.sum((F.col("v_src") - F.col("v_dst")) * (F.col("v_src") - F.col("v_dst"))).alias("d2"))
    return exact_median(apart, ["src", "dst"], "d2", "middle").select("src", "dst", F.sqrt(F.col("middle") + F.lit(1e-12)).alias("df"))


def node_sigma(edges: DataFrame) -> DataFrame:
    """Median feature distance of a node's edges (each edge counts at both ends)."""
    both = edges.select(F.explode(F.array("src", "dst")).alias("node"), "df")
    return both.groupBy("node").agg(F.median("df").alias("sigma"))


def kernel_terms(edges: DataFrame) -> DataFrame:
    """How alike the features of undirected edges (src, dst, df, dx) are, and how near the positions."""
    s = node_sigma(edges)
    rows = edges.join(s.select(F.col("node").alias("src"), F.col("sigma").alias("si")), "src").join(s.select(F.col("node").alias("dst"), F.col("sigma").alias("sj")), "dst")
    sx = edges.agg(F.median("dx").alias("sx"))
    near = F.exp(-F.col("dx") * F.col("dx") / (F.col("sx") * F.col("sx")))
    alike = F.exp(-F.col("df") * F.col("df") / (F.col("si") * F.col("sj") + F.lit(1e-12)))
    return rows.crossJoin(sx).select("src", "dst", alike.alias("alike"), near.alias("near"))  # sx is one row


def locus_kernel(edges: DataFrame, alpha: float) -> DataFrame:
    """Weight of undirected edges (src, dst, df, dx): ``alpha`` of how alike the
    features are, the rest of how near the positions."""
    return kernel_terms(edges).select("src", "dst", (alpha * F.col("alike") + (1 - alpha) * F.col("near")).alias("w"))


def weighted_degree(edges: DataFrame, *by: str) -> DataFrame:
    """Sum of the weights of directed edges from each node."""
    return edges.groupBy(*by, "src").agg(F.sum("w").alias("degree"))


def modularity(edges: DataFrame, labels: DataFrame, *by: str) -> DataFrame:
    """Modularity of a labelling (src, dst, w in both directions; pidx, label); 0 without weight.

    Labels may have columns of ``by`` too and then hold for those values alone.
    """
    own = [c for c in by if c in labels.columns]
    rows = edges.join(labels.select(*own, F.col("pidx").alias("src"), F.col("label").alias("ls")), [*own, "src"]).join(labels.select(*own, F.col("pidx").alias("dst"), F.col("label").alias("ld")), [*own, "dst"])
    total = rows.groupBy(*by).agg(F.sum("w").alias("total"))
    part = rows.groupBy(*by, "ls").agg(F.sum(F.when(F.col("ls") == F.col("ld"), F.col("w")).otherwise(0.0)).alias("inside"), F.sum("w").alias("reach"))
    joined = part.join(total, list(by)) if by else part.crossJoin(total)
    q = F.when(F.col("total") > 0, F.col("inside") / F.col("total") - (F.col("reach") / F.col("total")) * (F.col("reach") / F.col("total"))).otherwise(0.0)
    return joined.groupBy(*by).agg(F.sum(q).alias("modularity"))


def majority_vote(edges: DataFrame, labels: DataFrame, rounds: int = 1) -> DataFrame:
    """Labels after rounds in which every node takes the commonest label among its
    distinct neighbours, the lowest of equals; nodes without neighbours keep theirs."""
    near = edges.select("src", "dst").distinct()
    for _ in range(rounds):
        votes = near.join(labels.select(F.col("pidx").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.count(F.lit(1)).alias("n"))
        won = votes.groupBy("src").agg(F.max(F.struct("n", (-F.col("label")).alias("neg"))).alias("best")).select(F.col("src").alias("pidx"), (-F.col("best.neg")).alias("won"))
        labels = labels.join(won, "pidx", "left").select("pidx", F.coalesce("won", "label").alias("label"))
    return labels


def parameter_grid(spark, ks: list[int], alphas: list[float]) -> DataFrame:
    """All pairs of two short lists of parameters."""
    return spark.createDataFrame([(k,) for k in ks], "k int").crossJoin(spark.createDataFrame([(a,) for a in alphas], "alpha double"))


def grid_modularity(edges: DataFrame, grid: DataFrame, labels: DataFrame) -> DataFrame:
    """Modularity of the labels (k, pidx, label) under the kernel of each (k, alpha) of a short grid."""
    terms = kernel_terms(edges)
    both = terms.unionByName(terms.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "alike", "near"))
    weights = both.crossJoin(grid).withColumn("w", F.col("alpha") * F.col("alike") + (1 - F.col("alpha")) * F.col("near"))
    return modularity(weights, labels, "k", "alpha")


_STACK = pa.schema([("specimen_id", pa.int64()), ("pidx", pa.int64()), ("fidx", pa.int32()), ("v", pa.float64())])
#: About so many vertices are worked on together.
TOGETHER = 50_000


def feature_stack(vertices: DataFrame, faces: DataFrame, loci: DataFrame, scales: tuple[int, ...] = (0, 4, 12), hops: int = 1, whole: int = 100_000) -> DataFrame:
    """Geometric features (specimen_id, pidx, fidx, v) of loci (specimen_id, pidx, vid), z-scored within a specimen.

    Four for each number of smoothing steps: shape index, curvedness and the two
    principal curvatures. Then the mean angle at a vertex's edges, how much its normal
    varies, and how its normal lies to the specimen's longest axis. The last is the
    mean over the vertices within ``hops`` edges of a locus, all others the median.
    Meshes of up to ``whole`` vertices are worked on in a task, many together; those of
    larger ones, or with null coordinates, are joins.
    """
    odd = vertices.groupBy("specimen_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(sum((F.col(c) for c in "xyz"), F.lit(0.0)).isNotNull(), 1)).alias("known"))
    odd = odd.where((F.col("n") > whole) | (F.col("known") < F.col("n"))).select("specimen_id")
    if odd.isEmpty():
        return _stacked(vertices, faces, loci, scales, hops)
    most = _stacked(vertices.join(odd, "specimen_id", "left_anti"), faces, loci.join(odd, "specimen_id", "left_anti"), scales, hops)
    return most.unionByName(_stacked_by_joins(vertices.join(odd, "specimen_id", "left_semi"), faces, loci.join(odd, "specimen_id", "left_semi"), scales, hops))


def _stacked(vertices: DataFrame, faces: DataFrame, loci: DataFrame, scales: tuple[int, ...], hops: int) -> DataFrame:
    """:func:`feature_stack` of meshes that are a row each."""
    n = tasks(vertices)
    marks = F.array_sort(F.collect_list(F.struct(F.col("pidx").cast("long").alias("pidx"), F.col("vid").cast("long").alias("vid")))).alias("m")
    marks = loci.where("vid IS NOT NULL").repartition(n, "specimen_id").groupBy("specimen_id").agg(marks)
    rows = mesh.whole(vertices.repartition(n, "specimen_id"), faces).where("a IS NOT NULL").join(marks, "specimen_id")
    rows = rows.select("specimen_id", *"ixyzabc", F.col("m.pidx").alias("pidx"), F.col("m.vid").alias("vid"))

    def joined(parts: list[tuple]) -> pa.RecordBatch:
        """Features of meshes (specimen, node labels, which are vertices, positions, faces, loci)."""
        ends = np.cumsum([len(x[1]) for x in parts])
        starts = ends - [len(x[1]) for x in parts]
        of = np.repeat(np.arange(len(parts)), ends - starts)
        values, on, edges = kernels.vertex_features_many(np.concatenate([x[3] for x in parts]), of, np.concatenate([x[2] for x in parts]), np.concatenate([x[4] + s for x, s in zip(parts, starts, strict=True)]), scales)
        at, index = np.concatenate([x[5] + s for x, s in zip(parts, starts, strict=True)]), np.concatenate([x[6] for x in parts])
        # loci come in order of specimen and index; an index that has several vertices is one locus
        locus = np.cumsum(np.append(True, (np.diff(of[at]) != 0) | (np.diff(index) != 0))) - 1 if len(at) else at
        pairs = kernels.within_hops(at, edges, len(of), hops)
        pairs = pairs[on[pairs[:, 1]]]
        kept, group = np.unique(locus[pairs[:, 0]], return_inverse=True)
        row = np.searchsorted(locus, kept)
        shape = np.unique(of[at[row]], return_inverse=True)[1]
        v = kernels.pooled_z_scores(values[pairs[:, 1]], group, shape, values.shape[1] - 1)
        many = v.shape[1]
        specimens = np.array([x[0] for x in parts], np.int64)[of[at[row]]]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(specimens, many)), pa.array(np.repeat(index[row], many)), pa.array(np.tile(np.arange(many, dtype=np.int32), len(row))), pa.array(v.ravel())], schema=_STACK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None  # labels and faces of the last mesh and what they gave: most have the same
        for batch in batches:
            specimens = np.asarray(batch.column(0))
            columns = [(np.asarray(c.offsets), np.asarray(c.values)) for c in batch.columns[1:]]
            parts, size = [], 0
            for k, specimen in enumerate(specimens):
                i, x, y, z, a, b, c, pidx, vid = (v[o[k] : o[k + 1]] for o, v in columns)
                f = np.stack([a, b, c], 1)
                if known is None or not (np.array_equal(known[0], i) and np.array_equal(known[1], f)):
                    labels = np.union1d(i, f.ravel())
                    known = i, f, labels, np.isin(labels, i), np.searchsorted(labels, f)
                _, _, labels, here, at = known
                p = np.zeros((len(labels), 3))
                p[here] = np.stack([x, y, z], 1)
                there = np.isin(vid, labels)
                parts.append((specimen, labels, here, p, at, np.searchsorted(labels, vid[there]), pidx[there]))
                size += len(labels)
                if size >= TOGETHER:
                    yield joined(parts)
                    parts, size = [], 0
            if parts:
                yield joined(parts)

    found = rows.mapInArrow(run, "specimen_id long, pidx long, fidx int, v double")
    return found.withColumn("pidx", F.col("pidx").cast(loci.schema["pidx"].dataType))


def _stacked_by_joins(vertices: DataFrame, faces: DataFrame, loci: DataFrame, scales: tuple[int, ...], hops: int) -> DataFrame:
    """:func:`feature_stack` of meshes whose vertices and edges are rows."""
    own, last = mesh.own_columns(faces), 4 * len(scales)
    steps = F.array(*(F.lit(s) for s in scales))
    # a mesh after some steps is a mesh of its own here, so that one plan does all scales
    scaled = mesh.smoothed(vertices, faces, scales).select(F.struct("specimen_id", "scale").alias("specimen_id"), "vid", "x", "y", "z")
    shared = faces if not own else faces.withColumn("scale", F.explode(steps)).withColumn("specimen_id", F.struct("specimen_id", "scale")).drop("scale")
    k1, k2 = g.principal_curvatures(F.col("mean_curvature"), F.col("gauss_curvature"))
    bent = mesh.curvature(scaled, shared, signed=True).select("specimen_id", "vid", k1.alias("k1"), k2.alias("k2"))
    first = 4 * (F.array_position(steps, F.col("specimen_id.scale")) - 1)
    four = (g.shape_index(F.col("k1"), F.col("k2")), g.curvedness(F.col("k1"), F.col("k2")), F.col("k1"), F.col("k2"))
    bent = bent.select("specimen_id.specimen_id", "vid", F.inline(F.array(*(F.struct((first + j).cast("int").alias("fidx"), v.alias("v")) for j, v in enumerate(four)))))
    extra = lambda df, j, v: df.select("specimen_id", "vid", F.lit(last + j).alias("fidx"), v.alias("v"))
    axis = principal_axis(vertices, "specimen_id").select("specimen_id", *(F.col(c).alias(f"a{c}") for c in "xyz"))
    out = mesh.outward(vertices.join(mesh.vertex_normals(vertices, faces), ["specimen_id", "vid"])).join(axis, "specimen_id")
    values = bent.unionByName(extra(mesh.mean_dihedral(vertices, faces), 0, F.col("dihedral")))
    values = values.unionByName(extra(mesh.normal_variation(vertices, faces), 1, F.col("variation"))).unionByName(extra(out, 2, g.dot(g.vector("n"), g.vector("a"))))
    near = loci.select("specimen_id", "pidx", "vid").join(mesh.ring(faces, hops).withColumnRenamed("src", "vid"), [*own, "vid"])
    pooled = near.select("specimen_id", "pidx", F.col("dst").alias("vid")).join(values, ["specimen_id", "vid"]).groupBy("specimen_id", "pidx", "fidx")
    return z_scores(pooled.agg(F.when(F.col("fidx") == last + 2, F.avg("v")).otherwise(F.median("v")).alias("v")))
