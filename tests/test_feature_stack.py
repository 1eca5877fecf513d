"""Exact medians, smoothing and the feature stack, by NumPy and by what a moved mesh must keep."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapelake.operators import mesh, segmentation
from shapelake.operators.quantiles import exact_median

from .test_operators import frame, turn


def test_median_of_groups_that_are_large_even_tied_or_without_values(spark):
    rng = np.random.default_rng(40)
    groups = {1: rng.normal(size=4_001), 2: rng.normal(size=4_000), 3: np.repeat([2.0, 5.0], [1_500, 1_500]), 4: np.zeros(900), 5: np.array([3.0])}
    rows = spark.createDataFrame([(k, float(v)) for k, values in groups.items() for v in values] + [(6, None), (1, None)], "k int, v double")
    got = {r.k: r.middle for r in exact_median(rows, ["k"], "v", "middle", accuracy=200).collect()}
    assert got == {**{k: float(np.median(v)) for k, v in groups.items()}, 6: None}
    assert exact_median(rows.where("k > 9"), ["k"], "v", "middle").count() == 0


def ball(rng, bumps=0.05):
    """A closed bumpy sphere of 6 x 8 vertices and two poles, faces outwards."""
    n, m = 6, 8
    polar, round_ = np.meshgrid(np.pi * (np.arange(n) + 1) / (n + 1), 2 * np.pi * np.arange(m) / m, indexing="ij")
    p = np.stack([np.sin(polar) * np.cos(round_), np.sin(polar) * np.sin(round_), np.cos(polar)], -1).reshape(-1, 3)
    p = np.concatenate([p, [[0, 0, 1.0], [0, 0, -1.0]]]) * (1 + bumps * rng.normal(size=(n * m + 2, 1)))
    f = [(i * m + j, (i + 1) * m + j, (i + 1) * m + (j + 1) % m) for i in range(n - 1) for j in range(m)]
    f += [(i * m + j, (i + 1) * m + (j + 1) % m, i * m + (j + 1) % m) for i in range(n - 1) for j in range(m)]
    f += [(n * m, j, (j + 1) % m) for j in range(m)] + [(n * m + 1, (n - 1) * m + (j + 1) % m, (n - 1) * m + j) for j in range(m)]
    return p * [1, 1.3, 2], f


def test_smoothing_by_scales_is_repeated_smoothing(spark):
    p, f = ball(np.random.default_rng(41))
    faces = spark.createDataFrame([(k, *map(int, x)) for k, x in enumerate(f)], "fid long, a long, b long, c long")
    v = frame(spark, {1: p, 2: 2 * p}).withColumnRenamed("pidx", "vid")
    got = mesh.smoothed(v, faces, (0, 2)).toPandas().set_index(["scale", "specimen_id", "vid"]).sort_index()
    want = mesh.smooth(mesh.smooth(v, faces), faces).toPandas().set_index(["specimen_id", "vid"]).sort_index()
    assert got.loc[2].to_numpy() == pytest.approx(want.to_numpy())
    assert got.loc[0].loc[1].to_numpy() == pytest.approx(p)


def test_a_convex_mesh_has_positive_mean_curvature(spark):
    p, f = ball(np.random.default_rng(42), 0.0)
    faces = spark.createDataFrame([(k, *map(int, x)) for k, x in enumerate(f)], "fid long, a long, b long, c long")
    v = frame(spark, {1: p}).withColumnRenamed("pidx", "vid")
    assert mesh.curvature(v, faces, signed=True).where("mean_curvature <= 0").count() == 0
    inside_out = faces.select("fid", F.col("b").alias("a"), F.col("a").alias("b"), "c")
    assert mesh.curvature(v, inside_out, signed=True).where("mean_curvature >= 0").count() == 0


def test_feature_stack_does_not_see_the_pose_and_knows_each_specimens_faces(spark):
    rng = np.random.default_rng(43)
    p, f = ball(rng)
    v = frame(spark, {1: p, 2: p @ turn(rng).T + 3}).withColumnRenamed("pidx", "vid")
    faces = spark.createDataFrame([(k, *map(int, x)) for k, x in enumerate(f)], "fid long, a long, b long, c long")
    own = faces.crossJoin(spark.createDataFrame([(1,), (2,)], "specimen_id long"))
    loci = v.where("vid % 5 = 0").select("specimen_id", F.floor(F.col("vid") / 5).alias("pidx"), "vid")
    tables = []
    for some in (faces, own):
        got = segmentation.feature_stack(v, some, loci, scales=(0, 3)).toPandas().pivot(index=["specimen_id", "pidx"], columns="fidx", values="v")
        assert got.shape == (20, 11) and got.notna().all().all()
        tables.append(got)
        one, two = (got.loc[k].to_numpy() for k in (1, 2))
        assert one[:, :10] == pytest.approx(two[:, :10], abs=1e-6)
        assert np.minimum(np.abs(one[:, 10] - two[:, 10]), np.abs(one[:, 10] + two[:, 10])) == pytest.approx(np.zeros(10), abs=1e-6)  # an axis has two ends
        assert one.mean(0) == pytest.approx(np.zeros(11), abs=1e-9) and one.std(0) == pytest.approx(np.ones(11), abs=1e-5)
    assert tables[0].to_numpy() == pytest.approx(tables[1].to_numpy(), abs=1e-9)


def test_feature_stack_of_a_task_is_that_of_the_joins(spark):
    rng = np.random.default_rng(44)
    rows = [(k, i, *map(float, rng.normal(size=3))) for k in range(4) for i in range(12) if (k, i) not in ((1, 5), (1, 11))] + [(3, 40, 1.0, 2.0, 3.0)]
    v = spark.createDataFrame([(*r[:2], None, *r[3:]) if r[:2] == (2, 4) else r for r in rows], "specimen_id long, vid int, x double, y double, z double").coalesce(1)
    faces = spark.createDataFrame([(i, i, i + 1, i + 2) for i in range(10)] + [(30, 2, 5, 9)], "fid int, a int, b int, c int").coalesce(1)
    loci = v.where("vid % 2 = 0").select("specimen_id", F.expr("cast(vid / 4 as int)").alias("pidx"), "vid")  # two vertices a locus
    tables = [segmentation.feature_stack(v, faces, loci, scales=(0, 2), whole=n).toPandas().set_index(["specimen_id", "pidx", "fidx"]).sort_index() for n in (100, 0)]
    assert len(tables[0]) == 4 * 3 * 11 and tables[0].index.equals(tables[1].index)
    assert tables[0].v.to_numpy() == pytest.approx(tables[1].v.to_numpy(), abs=1e-9, nan_ok=True)
