"""Spectral clustering of weighted graphs whose vectors stay rows.

A graph is rows (src, dst, w) with both directions of each edge. A block of vectors
is one row for each node with a column for each vector; multiplying by the graph is
a join with the edges and a sum by node. Only sums of products of the columns, a
few hundred numbers, come to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.lineage import cut
from .segmentation import modularity


def lazy_walk(edges: DataFrame) -> DataFrame:
    """(src, dst, w) of (I + D^-1/2 W D^-1/2) / 2, whose largest eigenvalues are the
    smallest of the normalised Laplacian. Repeated edges count with their largest
    weight, and the larger weight of both directions counts for both."""
    both = edges.select("src", "dst", "w").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    one = both.where("src <> dst").groupBy("src", "dst").agg(F.max("w").alias("w"))
    degree = one.groupBy("src").agg(F.greatest(F.sum("w"), F.lit(1e-12)).alias("d"))
    scaled = one.join(degree.withColumnRenamed("d", "ds"), "src").join(degree.select(F.col("src").alias("dst"), F.col("d").alias("dd")), "dst")
    own = degree.select("src", F.col("src").alias("dst"), F.lit(0.5).alias("w"))
    return scaled.select("src", "dst", (F.col("w") / F.sqrt(F.col("ds") * F.col("dd")) / 2).alias("w")).unionByName(own)


def _names(letter: str, p: int) -> list[str]:
    return [f"{letter}{i}" for i in range(p)]


def _times(matrix: DataFrame, rows: DataFrame, p: int, scale: float = 1.0, shift: float = 0.0, before: float = 0.0) -> DataFrame:
    """From rows (node, a.., b..): b as the new a, and scale * matrix b + shift * b + before * a as the new b.

    Every node has an entry of its own in the matrix, which carries what is not a
    product, so the rows are read once and steps can follow each other in one plan."""
    a, b = _names("a", p), _names("b", p)
    far = matrix.join(rows.withColumnRenamed("node", "dst"), "dst")
    own = F.col("src") == F.col("dst")
    new_b = [(scale * F.col("w") * F.col(y) + F.when(own, shift * F.col(y) + before * F.col(x)).otherwise(0.0)).alias(y) for x, y in zip(a, b, strict=True)]
    parts = far.select(F.col("src").alias("node"), *(F.when(own, F.col(y)).otherwise(0.0).alias(x) for x, y in zip(a, b, strict=True)), *new_b)
    return parts.groupBy("node").agg(*(F.sum(c).alias(c) for c in (*a, *b)))


def _turned(rows: DataFrame, q: np.ndarray, p: int) -> DataFrame:
    """Rows (node, b..) whose columns are mixed by ``q``; a.. are 0."""
    mixed = [sum((float(q[i, j]) * F.col(f"b{i}") for i in range(p)), F.lit(0.0)).alias(f"b{j}") for j in range(q.shape[1])]
    return rows.select("node", *(F.lit(0.0).alias(a) for a in _names("a", q.shape[1])), *mixed)


def leading_vectors(matrix: DataFrame, k: int, *, extra: int = 6, degree: int = 8, rounds: int = 60, tolerance: float = 1e-6, seed: int = 0) -> tuple[DataFrame, list[float], list[float]]:
    """The ``k`` largest eigenvalues of a symmetric matrix (src, dst, w) with eigenvalues
    in [0, 1]: rows (node, b0 ..), the values and the residuals |M v - value v|.

    Block iteration with a Chebyshev filter: each round solves the problem within a
    block of ``k + extra`` vectors (their products are summed by Spark), then damps
    what lies below the block's smallest value by ``degree`` multiplications. Stops
    when all k residuals are below ``tolerance`` or after ``rounds``; the residuals
    say how good the vectors are. Starting vectors come from hashes of the nodes.
    """
    matrix = cut(matrix)
    nodes = matrix.select(F.col("src").alias("node")).distinct()
    n = nodes.count()
    p = min(n, k + extra)
    k = min(k, n)
    start = [(F.xxhash64(F.col("node"), F.lit(seed), F.lit(j)) / F.lit(2.0**63)).alias(f"b{j}") for j in range(p)]
    rows = cut(nodes.select("node", *(F.lit(0.0).alias(a) for a in _names("a", p)), *start))
    for done in range(rounds):
        both = _times(matrix, rows, p)
        pairs = [(i, j) for i in range(p) for j in range(i, p)]
        sums = [F.sum(F.col(f"a{i}") * F.col(f"a{j}")) for i, j in pairs] + [F.sum(F.col(f"a{i}") * F.col(f"b{j}")) for i in range(p) for j in range(p)] + [F.sum(F.col(f"b{i}") * F.col(f"b{j}")) for i, j in pairs]
        got = np.array(both.agg(F.array(*sums).alias("s")).first()["s"])
        g, m = np.zeros((p, p)), np.zeros((p, p))
        for x, part in ((g, got[: len(pairs)]), (m, got[len(pairs) + p * p :])):
            for (i, j), v in zip(pairs, part, strict=True):
                x[i, j] = x[j, i] = v
        h = got[len(pairs) : len(pairs) + p * p].reshape(p, p)
        own, u = np.linalg.eigh(g)
        good = own > 1e-14 * own.max()
        basis = u[:, good] / np.sqrt(own[good])
        values, turn = np.linalg.eigh(basis.T @ (h + h.T) / 2 @ basis)
        order = np.argsort(-values)
        values, q = values[order], basis @ turn[:, order]
        square = np.einsum("ij,ik,kj->j", q, m, q) - values * values
        residuals = np.sqrt(np.maximum(square, 0.0))
        if residuals[:k].max() < tolerance or done == rounds - 1 or len(values) == n:
            return cut(_turned(rows, q[:, :k], p).select("node", *_names("b", k))), values[:k].tolist(), residuals[:k].tolist()
        # The filter: Chebyshev polynomials that stay within 1 on [0, low] and grow above it.
        rows, p, low = _turned(rows, q, p), len(values), max(float(values[-1]), 1e-3)
        rows = _times(matrix, rows, p, 2 / low, -1.0)
        for _ in range(degree - 1):
            rows = _times(matrix, rows, p, 4 / low, -2.0, -1.0)
        rows = cut(rows)
    raise ValueError("rounds must be positive")


def _clusters(vectors: DataFrame, k: int, seed: int) -> DataFrame:
    """(pidx, label) by k-means on the first ``k`` columns of each node, scaled to length 1."""
    size = F.sqrt(sum((F.col(b) * F.col(b) for b in _names("b", k)), F.lit(0.0)))
    rows = vectors.select(F.col("node").alias("pidx"), array_to_vector(F.array(*(F.col(b) / F.greatest(size, F.lit(1e-12)) for b in _names("b", k)))).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=60, initSteps=5).fit(rows)
    return model.transform(rows).select(F.col("pidx").cast("long").alias("pidx"), F.col("prediction").cast("int").alias("label"))


#: Clusters need no exact vectors.
ENOUGH = {"tolerance": 1e-3, "rounds": 12}


def _fitting(edges: DataFrame, k: int) -> int:
    return max(2, min(k, edges.select("src").union(edges.select("dst")).distinct().count() - 1))


def spectral_labels(edges: DataFrame, k: int, *, seed: int = 0, **how) -> DataFrame:
    """(pidx, label): k-means on the first eigenvectors of the normalised Laplacian (Ng,
    Jordan and Weiss 2001). ``k`` is at least 2 and less than the number of nodes;
    ``how`` goes to :func:`leading_vectors`; by default residuals of a thousandth are
    enough, and vectors that no gap sets apart are given up after 12 rounds."""
    k = _fitting(edges, k)
    return _clusters(leading_vectors(lazy_walk(edges), k, seed=seed, **(ENOUGH | how))[0], k, seed)


def tune(edges_of: Callable[[float], DataFrame], ks: list[int], alphas: list[float], *, seed: int = 0, **how) -> DataFrame:
    """(k, alpha, modularity) of the clusters of each setting of a short grid;
    ``edges_of(alpha)`` are both directions of each edge. Vectors are found once for each alpha."""
    spark, found = None, []
    for alpha in alphas:
        edges = cut(edges_of(alpha))
        spark = edges.sparkSession
        sizes = {k: _fitting(edges, k) for k in ks}
        vectors = leading_vectors(lazy_walk(edges), max(sizes.values()), seed=seed, **(ENOUGH | how))[0]
        found += [(k, float(alpha), modularity(edges, _clusters(vectors, sizes[k], seed)).first()[0]) for k in ks]
    if spark is None:
        raise ValueError("there are no settings to try")
    return spark.createDataFrame(found, "k int, alpha double, modularity double")


def best(settings: DataFrame) -> tuple[int, float, float]:
    """The setting with the highest modularity; of equal ones the lowest alpha, then the lowest k."""
    r = settings.orderBy(F.desc("modularity"), "alpha", "k").first()
    return r.k, r.alpha, r.modularity
