"""Conjugate gradients on rows against dense solves of the same systems."""

import numpy as np
import pytest

from shapelake.operators import biharmonic, kernels


def grid(n, seed):
    rng = np.random.default_rng(seed)
    p = np.array([[i, j, 0.0] for i in range(n) for j in range(n)]) + rng.normal(scale=0.05, size=(n * n, 3))
    f = [(a, a + 1, a + n) for i in range(n - 1) for j in range(n - 1) for a in [i * n + j]] + [(a + 1, a + n + 1, a + n) for i in range(n - 1) for j in range(n - 1) for a in [i * n + j]]
    return p, np.array(f)


def frames(spark, shapes, faces, to):
    p = spark.createDataFrame([(s, k, *map(float, q)) for s, shape in shapes.items() for k, q in enumerate(shape)], "specimen_id long, pidx int, x double, y double, z double")
    t = spark.createDataFrame([(k, *map(float, q)) for k, q in to.items()], "pidx int, x double, y double, z double")
    return p, t, spark.createDataFrame([(k, *map(int, f)) for k, f in enumerate(faces)], "fid int, a int, b int, c int")


@pytest.mark.parametrize("soft", [None, 5.0])
def test_warps_equal_dense_solves(spark, soft):
    shapes, faces = {1: grid(4, 1)[0], 2: 3 * grid(4, 2)[0]}, grid(4, 1)[1]
    to = {0: (0, 0, 1), 3: (0, 3, 0), 12: (3, 0, 0), 15: (3.5, 3, 0.5)}
    got = biharmonic.warp(*frames(spark, shapes, faces, to), soft=soft, tolerance=1e-10).toPandas().sort_values("pidx")
    assert got["residual"].max() <= 1e-10
    for s, p in shapes.items():
        want = kernels.biharmonic_warp(p, faces, np.array(list(to)), np.array(list(to.values()), float), soft)
        own = got[got["specimen_id"] == s][["x", "y", "z"]].to_numpy()
        assert np.abs(own - want).max() < 1e-5
        if soft is None:
            assert np.abs(own[list(to)] - np.array(list(to.values()))).max() < 1e-12


def test_areas_between_the_laplacians(spark):
    p, faces = grid(4, 3)
    to, soft = {0: (0, 0, 1), 5: (1, 1, 0.2), 15: (3, 3, 0)}, 2.0
    got = biharmonic.warp(*frames(spark, {7: p}, faces, to), soft=soft, weigh=True, tolerance=1e-10).toPandas().sort_values("pidx")
    area = np.zeros(len(p))
    for f in faces:
        area[f] += np.linalg.norm(np.cross(p[f[1]] - p[f[0]], p[f[2]] - p[f[0]])) / 6
    lap = kernels.laplacian(p, faces)
    w, right = np.zeros(len(p)), np.zeros_like(p)
    w[list(to)] = soft
    right[list(to)] = soft * (np.array(list(to.values())) - p[list(to)])
    want = p + np.linalg.solve(lap @ np.diag(1 / area) @ lap + 1e-8 * np.eye(len(p)) + np.diag(w), right)
    assert np.abs(got[["x", "y", "z"]].to_numpy() - want).max() < 1e-5
