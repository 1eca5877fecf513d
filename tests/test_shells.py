"""Components, merged vertices and signed distances on meshes whose answers are known."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapelake.operators import shells

V, FACES = "specimen_id long, vid long, x double, y double, z double", "specimen_id long, fid long, a long, b long, c long"
CUBE = np.array([[x, y, z] for x in (-1, 1) for y in (-1, 1) for z in (-1, 1)], float)
SIDES = [(0, 1, 3), (0, 3, 2), (4, 6, 7), (4, 7, 5), (0, 4, 5), (0, 5, 1), (2, 3, 7), (2, 7, 6), (0, 2, 6), (0, 6, 4), (1, 5, 7), (1, 7, 3)]


def cubes(spark, flip=False):
    """Specimen 1: a cube with a smaller one inside; specimen 2: a cube alone, turned inside out if ``flip``."""
    v = [(1, k, *p) for k, p in enumerate(CUBE)] + [(1, 8 + k, *(0.5 * p)) for k, p in enumerate(CUBE)] + [(2, k, *(2 * p)) for k, p in enumerate(CUBE)]
    f = [(1, k, *s) for k, s in enumerate(SIDES)] + [(1, 20 + k, *(8 + x for x in s)) for k, s in enumerate(SIDES)]
    f += [(2, k, a, *((c, b) if flip else (b, c))) for k, (a, b, c) in enumerate(SIDES)]
    return spark.createDataFrame([(i, n, *map(float, p)) for i, n, *p in v], V), spark.createDataFrame(f, FACES)


def box_distance(p, half):
    q = np.abs(p) - half
    return np.linalg.norm(np.maximum(q, 0)) + min(q.max(), 0)


def test_components_of_long_chains_and_lone_nodes(spark):
    chain = [(1, k, k + 1) for k in range(300)] + [(2, 5, 3), (2, 3, 5), (2, 3, 3)]
    nodes = spark.createDataFrame([(1, k) for k in range(301)] + [(2, k) for k in (3, 5, 9)], "g long, node long")
    got = {(r.g, r.node): r.component for r in shells.components(nodes, spark.createDataFrame(chain, "g long, src long, dst long"), "g").collect()}
    assert got == {(1, k): 0 for k in range(301)} | {(2, 3): 3, (2, 5): 3, (2, 9): 9}
    with pytest.raises(RuntimeError):
        shells.components(nodes, spark.createDataFrame(chain, "g long, src long, dst long"), "g", rounds=2)


def test_inner_shells_are_ignored(spark):
    v, f = cubes(spark)
    sizes = {tuple(r) for r in shells.component_sizes(v, f).collect()}
    assert sizes == {(1, 0, 8, 12), (1, 8, 8, 12), (2, 0, 8, 12)}
    assert {(r.specimen_id, r.fid) for r in shells.outer_shell(v, f).collect()} == {(s, k) for s in (1, 2) for k in range(12)}


@pytest.mark.parametrize("flip", [False, True])
def test_signed_distance_of_cubes(spark, flip):
    v, f = cubes(spark, flip)
    rng = np.random.default_rng(1)
    points = np.concatenate((rng.uniform(-4, 4, (60, 3)), CUBE * 3, CUBE * 0.9, np.eye(3) * 3, [[3, 3, 0], [0, -3, 3]]))
    q = spark.createDataFrame([(s, k, *map(float, p)) for s in (1, 2) for k, p in enumerate(points)], "specimen_id long, pidx long, x double, y double, z double")
    got = shells.signed_distance(q, v, shells.outer_shell(v, f)).collect()
    assert len(got) == 2 * len(points)
    for r in got:
        assert r.d == pytest.approx(box_distance(points[r.pidx], r.specimen_id), abs=1e-9)
        assert np.linalg.norm([r.nx, r.ny, r.nz]) == pytest.approx(1)


def test_no_landmark_stays_inside(spark):
    v, f = cubes(spark)
    rng = np.random.default_rng(2)
    marks = [(s, k, *map(float, p)) for s in (1, 2) for k, p in enumerate(rng.uniform(-2.5, 2.5, (25, 3)))] + [(1, 25, 0.3, 0.2, 1.0)]
    m = spark.createDataFrame(marks, "specimen_id long, pidx long, x double, y double, z double")
    got = {(r.specimen_id, r.pidx): np.array([r.x, r.y, r.z]) for r in shells.outside_projection(m, v, f, most=0.5).collect()}
    assert len(got) == len(marks)
    assert all(0 <= box_distance(p, s) < 1e-6 for (s, _), p in got.items())
    assert got[1, 25].tolist() == [0.3, 0.2, 1.0]  # it was on the surface


def test_cleaning_merges_vertices_and_renumbers_faces(spark):
    tri = [CUBE[list(s)] for s in SIDES]
    rng = np.random.default_rng(3)
    v = [(1, 3 * k + c, *map(float, t[c] + rng.uniform(-1e-4, 1e-4, 3))) for k, t in enumerate(tri) for c in range(3)] + [(1, 99, 5.0, 5.0, 5.0)]
    f = [(1, k, 3 * k, 3 * k + 1, 3 * k + 2) for k in range(12)] + [(1, 12, 0, 1, 2), (1, 13, 0, 0, 1)]
    kept, faces = shells.cleaned(spark.createDataFrame(v, V), spark.createDataFrame(f, FACES), 1e-2)
    assert kept.count() == 8 and faces.count() == 12
    assert {tuple(r) for r in shells.component_sizes(kept, faces).select("n_vertices", "n_faces").collect()} == {(8, 12)}
    exact, _ = shells.cleaned(spark.createDataFrame(v, V), spark.createDataFrame(f, FACES))
    assert exact.count() == 36
    quads = spark.createDataFrame([(1, 0, [4, 5, 6, 7]), (1, 1, [1, 2, 3]), (1, 2, [1, 2])], "specimen_id long, fid long, vids array<long>")
    assert {(r.a, r.b, r.c) for r in shells.triangulated(quads).collect()} == {(4, 5, 6), (4, 6, 7), (1, 2, 3)}
    assert shells.triangulated(quads).select(F.count_distinct("fid")).first()[0] == 3
