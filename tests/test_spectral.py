"""Spectral clustering on edge rows against dense eigenvectors and planted clusters."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapelake.operators import segmentation, spectral

EDGES = "src int, dst int, w double"


def planted(n=90, parts=3, seed=1):
    """A graph whose nodes of one part are joined often, others seldom; both directions of each edge."""
    rng = random.Random(seed)
    edges = {}
    for i in range(n):
        for j in range(i):
            if rng.random() < (0.5 if i % parts == j % parts else 0.02):
                edges[i, j] = edges[j, i] = rng.uniform(0.5, 1.5)
    return [(i, j, w) for (i, j), w in edges.items()]


def dense(edges):
    n = max(i for i, _, _ in edges) + 1
    w = np.zeros((n, n))
    for i, j, x in edges:
        w[i, j] = x
    d = 1 / np.sqrt(w.sum(1))
    return (np.eye(n) + d[:, None] * w * d) / 2


def test_leading_vectors_equal_dense_ones(spark):
    edges = planted()
    m = dense(edges)
    got, values, residuals = spectral.leading_vectors(spectral.lazy_walk(spark.createDataFrame(edges, EDGES)), 3)
    want, vectors = np.linalg.eigh(m)
    assert values == pytest.approx(want[::-1][:3], abs=1e-8) and max(residuals) < 1e-5
    b = got.orderBy("node").select(*(f"b{k}" for k in range(3))).toPandas().to_numpy()
    apart = b @ b.T - vectors[:, -3:] @ vectors[:, -3:].T
    assert np.abs(apart).max() < 1e-5
    assert np.abs(m @ b - b * values).max() < 1e-5


def test_planted_clusters_are_found_and_chosen(spark):
    edges = planted()
    e = spark.createDataFrame(edges, EDGES)
    label = {r.pidx: r.label for r in spectral.spectral_labels(e, 3).collect()}
    assert [len({label[k] for k in range(90) if k % 3 == part}) for part in range(3)] == [1, 1, 1] and len(set(label.values())) == 3
    settings = spectral.tune(lambda alpha: e.withColumn("w", F.col("w") * alpha), [2, 3, 4], [0.5])
    k, alpha, q = spectral.best(settings)
    assert (k, alpha) == (3, 0.5) and settings.count() == 3
    truth = spark.createDataFrame([(k, k % 3) for k in range(90)], "pidx int, label int")
    assert q == pytest.approx(segmentation.modularity(e, truth).first()[0], abs=1e-9)


def test_two_cliques_and_few_nodes(spark):
    edges = [(i, j, 1.0) for i in range(8) for j in range(8) if i != j and (i < 4) == (j < 4)] + [(3, 4, 0.01), (4, 3, 0.01)]
    label = {r.pidx: r.label for r in spectral.spectral_labels(spark.createDataFrame(edges, EDGES), 2).collect()}
    assert len({label[k] for k in range(4)}) == len({label[k] for k in range(4, 8)}) == 1 and label[0] != label[7]
    assert spectral.spectral_labels(spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (1, 2, 1.0)], EDGES), 9).count() == 3
