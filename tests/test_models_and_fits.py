"""Shape models by either matrix, and fits from moments."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapelake.operators import kernels, procrustes, shape_model
from shapelake.sources import store

POINTS = "specimen_id long, pidx int, x double, y double, z double"


def frame(spark, shapes):
    return spark.createDataFrame([(s, k, *map(float, p)) for s, shape in shapes.items() for k, p in enumerate(shape)], POINTS)


def modes_of(modes, n):
    got = modes.toPandas().sort_values(["mode", "pidx"])
    return got[["x", "y", "z"]].to_numpy().reshape(-1, 3 * n)


def test_both_branches_give_the_same_model(spark):
    rng = np.random.default_rng(1)
    shapes = {10 * k + 3: rng.normal(size=(30, 3)) for k in range(7)}
    p = frame(spark, shapes)
    x = np.stack([s.ravel() for s in shapes.values()])
    want = np.linalg.svd(x - x.mean(0))[1][:6] ** 2 / 6
    found = {}
    for branch in ("gram", "covariance"):
        mean, modes, eig = shape_model.build(p, branch=branch)
        assert [r.v for r in eig.orderBy("mode").collect()] == pytest.approx(want.tolist())
        found[branch] = modes_of(modes, 30)
        shape_model.validate(mean, modes, eig)
        assert shape_model.residuals(p, modes, eig).where("residual > 1e-9 OR abs(norm - 1) > 1e-9").count() == 0
    assert np.abs(found["gram"] - found["covariance"]).max() < 1e-8
    # more coordinates than twice the specimens: the smaller matrix is chosen, in tiles of any size
    assert np.abs(modes_of(shape_model.build(p)[1], 30) - found["gram"]).max() < 1e-12
    tiled = shape_model.gram(p, specimens=2, landmarks=7).orderBy("si", "sj").toPandas()
    product = (x - x.mean(0)) @ (x - x.mean(0)).T
    assert tiled["v"].to_numpy() == pytest.approx(product[np.triu_indices(7)])
    assert tiled["si"].unique().tolist() == sorted(shapes)


def test_models_of_nothing_and_of_unlike_specimens(spark):
    one = frame(spark, {1: np.eye(3)})
    for branch in ("gram", "covariance"):
        _, modes, eig = shape_model.build(one, branch=branch)
        assert modes.count() == eig.count() == 0
    with pytest.raises(ValueError):
        shape_model.build(frame(spark, {1: np.eye(3), 2: np.eye(3)[:2]}), branch="gram")
    with pytest.raises(ValueError):
        shape_model.gram(frame(spark, {k: np.eye(3) for k in range(4)}), most=3)


def test_covariance_over_batches(spark):
    rng = np.random.default_rng(2)
    shapes = {k: 1e3 + rng.normal(size=(4, 3)) for k in range(60)}
    got = shape_model.covariance(frame(spark, shapes).repartition(5)).toPandas()
    want = np.cov(np.stack([s.ravel() for s in shapes.values()]).T)
    assert len(got) == 78 and np.abs(got["cov"] - want[got["i"], got["j"]]).max() < 1e-9


def test_wide_modes_have_the_mean_and_no_silent_end(spark):
    mean = frame(spark, {0: np.arange(6.0).reshape(2, 3)}).drop("specimen_id")
    modes = spark.createDataFrame([(m, k, float(m), float(k), 0.5) for m in range(3) for k in range(2)], "mode int, pidx int, x double, y double, z double")
    got = store.wide_modes(modes, mean).orderBy("axis").collect()
    assert [tuple(r) for r in got] == [(a, float(a), *((float(m), float(a // 3), 0.5)[a % 3] for m in range(3))) for a in range(6)]
    assert "mean_shape" not in store.wide_modes(modes).columns
    with pytest.raises(ValueError):
        store.wide_modes(modes, most=2)


@pytest.mark.parametrize("scaling", [True, False])
def test_fits_from_moments_equal_gathered_ones(spark, scaling):
    rng = np.random.default_rng(3)
    template = rng.normal(size=(9, 3))
    shapes = {k: rng.normal(size=(9, 3)) * 100 + 500 for k in range(6)}
    shapes[7], shapes[8] = template * [1, 1, -1], np.ones((9, 3))  # a mirror image, and one point
    t = frame(spark, {0: template}).drop("specimen_id")
    got = procrustes.align(frame(spark, shapes), t, scaling).toPandas().sort_values(["specimen_id", "pidx"])
    for k, p in shapes.items():
        s, r, shift = kernels.similarity_fit(p, template, scaling)
        own = got[got["specimen_id"] == k][["x", "y", "z"]].to_numpy()
        assert np.abs(own - (s * p @ r.T + shift)).max() < (1e-9 if k != 8 else 1e-6)
    best = procrustes.optimality(frame(spark, shapes), t).where("specimen_id <> 8").toPandas()
    assert (best["skew"] < 1e-9).all() and np.allclose(best["turn"], 1) and best["nearer"].all()


def test_specimens_that_share_no_landmark(spark):
    t = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0)], "pidx int, x double, y double, z double")
    p = spark.createDataFrame([(1, 5, 1.0, 2.0, 3.0)], POINTS)
    assert procrustes.fits(p, t).count() == 0
    assert procrustes.align(p, t).where(F.col("x").isNull()).count() == 1


def test_products_of_any_number_of_specimens_are_made_in_tiles(spark):
    rng = np.random.default_rng(6)
    shapes = {3 * k + 1: rng.normal(size=(5, 3)) for k in range(60)}
    x = np.stack([s.ravel() for s in shapes.values()])
    product = (x - x.mean(0)) @ (x - x.mean(0)).T
    for specimens, landmarks in ((7, 2), (60, 5), (None, 1_024)):
        got = shape_model.gram(frame(spark, shapes), specimens=specimens, landmarks=landmarks).orderBy("si", "sj").toPandas()
        assert got["v"].to_numpy() == pytest.approx(product[np.triu_indices(60)])
        assert list(zip(got["si"], got["sj"])) == [(3 * i + 1, 3 * j + 1) for i in range(60) for j in range(i, 60)]
    assert shape_model.gram.__kwdefaults__["most"] is None  # no bound on specimens but on request


def test_gram_models_of_more_specimens_than_the_driver_takes(spark):
    rng = np.random.default_rng(7)
    p = frame(spark, {k: rng.normal(size=(4, 3)) for k in range(40)})
    want, eig = shape_model._by_gram(p, 40)
    modes, values = shape_model._by_gram(p, 12)
    assert np.abs(modes_of(modes, 4) - modes_of(want, 4)).max() < 1e-9
    assert [r.v for r in values.orderBy("mode").collect()] == pytest.approx([r.v for r in eig.orderBy("mode").collect()])
    assert shape_model.residuals(p, modes, values).where("residual > 1e-9 OR abs(norm - 1) > 1e-9").count() == 0
    with pytest.raises(ValueError):
        shape_model._by_gram(p, 11)


def test_tiles_are_not_written_once_more_for_each_pair(spark):
    rng = np.random.default_rng(8)
    shapes = {k: rng.normal(size=(3, 3)) for k in range(11)}
    got = shape_model.gram(frame(spark, shapes), specimens=5, landmarks=2)
    x = np.stack([s.ravel() for s in shapes.values()])
    product = (x - x.mean(0)) @ (x - x.mean(0)).T
    assert {(r.si, r.sj): r.v for r in got.collect()} == pytest.approx({(i, j): product[i, j] for i in range(11) for j in range(i, 11)})
    lines = got._jdf.queryExecution().executedPlan().toString().splitlines()  # the final plan comes first
    shuffled = [line for line in lines if "Exchange" in line]
    paired = next(n for n, line in enumerate(lines) if "CartesianProduct" in line)
    assert not any(line in shuffled for line in lines[:paired]) and "rangepartitioning" in shuffled[0]


def test_products_of_one_specimen_and_of_none(spark):
    one = shape_model.gram(frame(spark, {4: np.eye(3)})).collect()
    assert [(r.si, r.sj, r.v) for r in one] == [(4, 4, 0.0)]
    assert shape_model.gram(frame(spark, {4: np.eye(3)}).where("false")).count() == 0
