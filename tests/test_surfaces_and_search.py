"""Surfaces, searches for poses, and model fits, by recovery of what was put in."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapelake.operators import kernels, points, registration, shape_model, surfaces
from shapelake.plans.catalogue import QUERIES
from shapelake.sources import store

from .test_operators import arrays, frame, turn


def test_closest_points_on_a_tetrahedron(spark):
    v = np.array([[0.0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1]])
    f = [(0, 0, 1, 2), (1, 0, 1, 3), (2, 0, 2, 3), (3, 1, 2, 3)]
    vertices = spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(v)], "specimen_id long, vid long, x double, y double, z double")
    faces = spark.createDataFrame([(1, *x) for x in f], "specimen_id long, fid long, a long, b long, c long")
    rng = np.random.default_rng(0)
    q = rng.normal(size=(40, 3))
    near = surfaces.closest_points(frame(spark, {1: q}), vertices, faces, block=7)
    there = arrays(surfaces.on_surface(near, vertices, faces))[1]
    d2 = np.array([r.d2 for r in near.orderBy("qidx").collect()])
    assert ((there - q) ** 2).sum(1) == pytest.approx(d2)
    w = rng.dirichlet(np.ones(3), 4_000)
    samples = np.concatenate([w @ v[list(x[1:])] for x in f])
    brute = np.array([((samples - p) ** 2).sum(1).min() for p in q])
    assert (d2 <= brute + 1e-12).all() and np.sqrt(d2) == pytest.approx(np.sqrt(brute), abs=0.05)


def test_a_degenerate_triangle_is_its_edges():
    tri = np.array([[[0.0, 0, 0], [1, 0, 0], [2, 0, 0]]])
    _, w, d2 = surfaces.closest_on_triangles(np.array([[1.5, 1.0, 0]]), tri)
    assert d2[0] == pytest.approx(1) and w[0].sum() == pytest.approx(1)


def test_features_find_a_turned_template(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 3)) * [3, 1.5, 0.6]
    r = turn(rng)
    shapes = {1: base @ r.T + 2, 2: np.full((60, 3), np.nan)}
    got = {x.specimen_id: x for x in registration.register_by_features(frame(spark, shapes), frame(spark, {0: base}), 0.1, retries=2).collect()}
    assert got[1].rmse < 0.05 * np.linalg.norm(np.ptp(base, axis=0)) and got[1].error is None
    assert "finite" in got[2].error


def test_pose_search_prefers_the_true_rotation(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 3)) * [3, 1.5, 0.6] + [0.5, 0, 0]
    turns = registration.rotations(12, seed=0)
    assert np.einsum("kij,kil->kjl", turns, turns) == pytest.approx(np.broadcast_to(np.eye(3), (12, 3, 3)), abs=1e-12)
    shapes = {k: base @ turns[k].T for k in (0, 3, 7)}
    for row in registration.pose_search(frame(spark, shapes), frame(spark, {0: base}), hypotheses=12).collect():
        assert row.score == pytest.approx(0, abs=1e-6) and row.margin >= 0 and row.entropy >= 0


def test_pose_search_finds_rotations_that_are_no_start(spark):
    rng = np.random.default_rng(12)
    base = rng.normal(size=(21, 3)) * [3, 1.5, 0.6] + [0.5, 0, 0]
    shapes = {k: base @ turn(rng).T + 1 for k in range(30)}
    for row in registration.pose_search(frame(spark, shapes), frame(spark, {0: base})).collect():
        assert row.score == pytest.approx(0, abs=1e-6)


def test_searches_are_registered_with_the_operators_own_effort(spark, monkeypatch):
    given = {}
    for name in ("pose_search", "register_by_features", "procrustes_mean"):
        monkeypatch.setattr(registration, name, lambda *a, name=name, **how: given.update({name: how}) or a[0])
    for query in ("pose_search", "feature_ransac", "procrustes_mean"):
        QUERIES[query](spark, "/root/testdata/sf0.001")
    assert given == {"pose_search": {}, "register_by_features": {}, "procrustes_mean": {}}


def test_ransac_tries_every_triple_of_few_matches():
    rng = np.random.default_rng(13)
    p, r = rng.normal(size=(21, 3)), turn(rng)
    q = p @ r.T + 1
    pairs = np.stack([np.arange(21), np.concatenate((np.arange(4), rng.permutation(np.arange(4, 21))))], 1)
    for scaling in (False, True):
        s, found, t, share = kernels.ransac(p, q * (1 + scaling), pairs, 1e-6, scaling=scaling)
        assert (s, share >= 4 / 21) == (pytest.approx(1 + scaling), True) and found == pytest.approx(r, abs=1e-6)


def test_procrustes_mean_settles_or_says_that_it_has_not(spark):
    rng = np.random.default_rng(14)
    base = rng.normal(size=(8, 3))
    shapes = frame(spark, {k: (base + rng.normal(size=(8, 3))) @ turn(rng).T for k in range(12)}).cache()
    with pytest.raises(RuntimeError, match="not settled"):
        registration.procrustes_mean(shapes, rounds=2)
    mean = registration.procrustes_mean(shapes)
    (_, once), (_, again) = (registration.template_arrays(m) for m in (mean, points.mean_shape(registration.align(shapes, mean))))
    once, again = (m - m.mean(0) for m in (once, again))
    assert again / np.linalg.norm(again) == pytest.approx(once / np.linalg.norm(once), abs=1e-5)


def test_model_fit_recovers_a_bent_shape(spark):
    rng = np.random.default_rng(3)
    base, move = rng.normal(size=(25, 3)) * [3, 1.5, 0.6], rng.normal(size=(25, 3)) * 0.3
    train = frame(spark, {k: base + b * move for k, b in enumerate(rng.normal(size=30))})
    a = 0.2
    r = np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]])
    target = (base + 0.8 * move) @ r.T + 0.3
    got = arrays(registration.fit_model(frame(spark, {5: target[rng.permutation(25)]}), *shape_model.build(train)))[5]
    assert np.median(np.linalg.norm(got - target, axis=1)) < 0.05 * np.linalg.norm(np.ptp(target, axis=0))


def test_transfer_to_a_turned_scaled_and_bent_specimen(spark):
    rng = np.random.default_rng(15)
    base, move = rng.normal(size=(25, 3)) * [3, 1.5, 0.6], rng.normal(size=(25, 3)) * 0.3
    a, order = np.radians(150), rng.permutation(25)
    r = np.array([[np.cos(a), 0, np.sin(a)], [0, 1, 0], [-np.sin(a), 0, np.cos(a)]])
    stiff, bent = (1.7 * q @ r.T + 4 for q in (base, base + 0.8 * move))
    got = registration.transfer(frame(spark, {1: stiff[order]}), frame(spark, {0: base}), frame(spark, {0: base[:5]}))
    assert got.where("error IS NOT NULL").count() == 0
    assert arrays(got)[1] == pytest.approx(stiff[:5], abs=0.05)
    mean, *model = shape_model.build(frame(spark, {k: base + b * move for k, b in enumerate(rng.normal(size=30))}))
    got = registration.transfer(frame(spark, {1: bent[order]}), mean, mean.where("pidx < 5"), model=tuple(model))
    assert arrays(got)[1] == pytest.approx(bent[:5], abs=0.05)


def test_dense_correspondence_of_a_moved_copy_is_the_identity(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 3))
    got = registration.dense_correspondence(frame(spark, {1: base @ turn(rng).T * 2 + 1}), list(range(10)), frame(spark, {0: base}))
    assert got.where("pidx <> vid").count() == 0 and got.count() == 30


def test_heat_signature_does_not_see_the_pose():
    rng = np.random.default_rng(5)
    p = rng.normal(size=(12, 3))
    f = np.array([(k, k + 1, k + 2) for k in range(10)])
    assert kernels.heat_signature(p, f) == pytest.approx(kernels.heat_signature(p @ turn(rng).T + 3, f), abs=1e-6)


def test_coherent_projection_keeps_what_is_near_and_moves_the_rest():
    rng = np.random.default_rng(6)
    marks = rng.normal(size=(20, 3))
    onto = marks + [0, 0, 1.0]
    onto[:5] = marks[:5]
    got = kernels.coherent_projection(marks, onto, most=0.5)
    assert got[:5] == pytest.approx(marks[:5], abs=1e-4)
    moved = got[5:] - marks[5:]
    assert (moved[:, 2] > 0).all() and (np.linalg.norm(moved, axis=1) <= 0.5 + 1e-9).all()
    assert kernels.coherent_projection(marks, marks) == pytest.approx(marks)


def test_cloud_normals_of_a_plane_and_smooth_projection(spark):
    rng = np.random.default_rng(7)
    plane = np.column_stack([rng.uniform(size=(80, 2)), np.zeros(80)])
    n = surfaces.cloud_normals(frame(spark, {1: plane}), 0.4).toPandas()
    assert np.abs(n["nz"]).to_numpy() == pytest.approx(np.ones(len(n)), abs=1e-6)


def test_voxel_size_for_a_count(spark):
    rng = np.random.default_rng(31)
    cloud = rng.normal(size=(8_000, 3)) * [4, 1.4, 0.3]
    cloud[:, 2] += 0.05 * cloud[:, 0] ** 2
    size, n = registration.voxel_size_for(frame(spark, {1: cloud}).cache(), 600)
    assert abs(n - 600) <= 12 and size > 0


def test_store_lists_models_and_writes_segments(spark, tmp_path):
    rng = np.random.default_rng(8)
    mean, modes, eig = shape_model.build(frame(spark, {k: rng.normal(size=(4, 3)) for k in range(5)}))
    for name in ("b", "a"):
        store.save_model(mean, modes, eig, str(tmp_path), name)
    assert store.list_models(spark, str(tmp_path)) == ["a", "b"]
    v = frame(spark, {1: rng.normal(size=(6, 3))}).withColumnRenamed("pidx", "vid")
    store.write_segments(v, v.select("specimen_id", "vid", (F.col("vid") % 2).alias("label")), str(tmp_path / "seg"))
    assert spark.read.parquet(str(tmp_path / "seg")).where("label = 1").count() == 3
    store.write_points(frame(spark, {1: rng.normal(size=(6, 3))}), store.run_folder(str(tmp_path), "atlas", "2026_01-01_00_00_00"), "specimen_id")


def test_point_to_plane_ends_nearer_than_it_starts():
    rng = np.random.default_rng(50)
    uv = rng.uniform(-1, 1, size=(900, 2))
    surface = np.column_stack([uv, 0.4 * uv[:, 0] ** 2 - 0.2 * uv[:, 1] ** 2 + 0.3 * uv[:, 0] * uv[:, 1] + 0.2 * uv[:, 1] ** 3])
    a = 0.05
    r = np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]])
    source = surface[::5]
    got = kernels.plane_icp(source @ r.T + [0.02, -0.01, 0.03], surface, kernels.normals(surface, 12), 0.3)
    assert np.linalg.norm(got - source, axis=1).max() < 0.01
    far = source + 100
    assert kernels.plane_icp(far, surface, kernels.normals(surface, 12), 0.3) == pytest.approx(far)


def test_fine_drift_follows_a_smooth_bend():
    rng = np.random.default_rng(51)
    base = rng.uniform(-1, 1, size=(150, 3)) * [3, 2, 1]
    bent = base + 0.15 * np.sin(base[:, [1, 2, 0]])
    got = kernels.fine_drift(base, bent[rng.permutation(150)])
    assert np.median(np.linalg.norm(got - bent, axis=1)) < 0.2 * np.median(np.linalg.norm(base - bent, axis=1))
    assert kernels.fine_drift(base, base) == pytest.approx(base, abs=0.02)


def test_rounds_of_the_procrustes_mean_are_jobs_without_a_plan(spark):
    """A round that plans and shuffles costs more than its fits; partial specimens count where they have landmarks."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 3))
    rows = [(s, k, *(float(c) for c in base[k] + 0.2 * rng.normal(size=3))) for s in range(40) for k in range(6) if s % 5 or k != 2]
    points = spark.createDataFrame(rows, "specimen_id long, pidx int, x double, y double, z double").repartition(3)
    planned, made = [], type(points).mapInPandas
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(points), "mapInPandas", lambda self, *a, **b: planned.append(a[1]) or made(self, *a, **b))
        mean = registration.procrustes_mean(points)
    assert len(planned) == 1
    got = mean.orderBy("pidx").toPandas()[["x", "y", "z"]].to_numpy()
    total, n = np.zeros((6, 3)), np.zeros((6, 1))
    for s in range(40):
        at = [k for _, k, *_ in (r for r in rows if r[0] == s)]
        total[at] += kernels.similarity_fits(np.array([[r[2:] for r in rows if r[0] == s]]), got[at])[0]
        n[at] += 1
    again = total / n - (total / n).mean(0)
    assert np.abs(again * np.linalg.norm(got) / np.linalg.norm(again) - got).max() < 2e-6


def test_heavy_work_on_few_bytes_goes_to_all_cores(spark):
    rng = np.random.default_rng(4)
    shapes = frame(spark, {k: rng.normal(size=(5, 3)) for k in range(200)})
    held = registration.per_specimen(shapes, lambda i, p: {"task": [__import__("pyspark").TaskContext.get().partitionId()]}, "specimen_id long, task int")
    assert len({r.task for r in held.collect()}) >= 4
    posed = registration.pose_search(shapes, points.mean_shape(shapes), hypotheses=20)
    # small specimens are searched in one row, large ones in blocks: the same poses
    parts = registration.pose_search(shapes, points.mean_shape(shapes), hypotheses=20, small=0)
    for one, other in zip(sorted(map(tuple, posed.collect())), sorted(map(tuple, parts.collect()))):
        assert one == pytest.approx(other, abs=1e-9)


def test_results_of_specimens_leave_a_task_in_blocks_and_may_fail(spark):
    shapes = frame(spark, {k: np.full((3, 3), float(k)) for k in range(20)})
    work = lambda i, p: {"pidx": i.astype(np.int32), "v": p[:, 0], "error": [None] * 3} if p[0, 0] % 2 else {"pidx": [None], "v": [None], "error": ["even"]}
    got = registration.per_specimen(shapes, work, "specimen_id long, pidx int, v double, error string", many=3).collect()
    assert len(got) == 40 and {r.error for r in got} == {None, "even"}
    assert all((r.pidx, r.v) == (None, None) if r.error else r.v == r.specimen_id for r in got)
    made = registration._rows
    parts = [(s, {"v": np.zeros(2)}) for s in range(5)]
    assert made(["specimen_id", "v"], parts).shape == (10, 2)


def test_pose_scores_of_few_points_equal_the_searches():
    rng = np.random.default_rng(5)
    placed, target = rng.normal(size=(30, 7, 3)), rng.normal(size=(9, 3))
    want = [-(kernels.nearest(q, target, 1)[1].mean() + 0.1 * kernels.nearest(target, q, 1)[1].mean()) for q in placed]
    assert kernels.pose_scores(placed, target) == pytest.approx(want, rel=1e-14)


def test_closest_points_of_specimens_searched_together_and_alone(spark):
    """Specimens 0 to 3 have the same vertices and faces, 4 and 5 lack vertices, 6 has more points: together or alone, the same is found."""
    rng = np.random.default_rng(71)
    rows = [(k, i, *map(float, rng.normal(size=3))) for k in range(7) for i in range(9) if (k, i) not in ((4, 3), (5, 0), (5, 8))]
    v = spark.createDataFrame(rows, "specimen_id long, vid int, x double, y double, z double")
    f = [(10 - k, k, k + 1, k + 2) for k in range(7)] + [(40, 0, 4, 8)]
    faces = spark.createDataFrame(f, "fid int, a int, b int, c int")
    q = [(k, i, *map(float, rng.normal(size=3))) for k in range(7) for i in range(9 if k == 6 else 5)]
    points = spark.createDataFrame(q, "specimen_id long, pidx int, x double, y double, z double")
    found = {(r.specimen_id, r.qidx): r for r in surfaces.closest_points(points, v, faces).collect()}
    moved = {(r.specimen_id, r.pidx): np.array([r.x, r.y, r.z]) for r in surfaces.onto_surface(points, v, faces, block=2).collect()}
    assert len(found) == len(moved) == len(q)
    for k in range(7):
        at = {r[1]: np.array(r[2:]) for r in rows if r[0] == k}
        whole = sorted(x for x in f if all(c in at for c in x[1:]))
        tri = np.array([[at[c] for c in x[1:]] for x in whole])
        p = np.array([r[2:] for r in q if r[0] == k])
        face, weight, d2 = surfaces.closest_on_triangles(p, tri)
        for i in range(len(p)):
            r = found[k, i]
            assert (r.fid, r.wa, r.wb, r.wc, r.d2) == (whole[face[i]][0], *weight[i], d2[i])
            assert moved[k, i] == pytest.approx(weight[i] @ tri[face[i]])
