"""Work done on whole specimens in a task against the same by joins, for specimens of many sizes."""

import numpy as np
import pytest

from shapelake.operators import biharmonic, features, neighbors, shells, surfaces

from .test_biharmonic import frames, grid

POINTS = "specimen_id long, pidx int, x double, y double, z double"


def clouds(spark, sizes, scale=1.0, seed=0):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(s, 3 * k, *map(float, scale * p)) for s, n in sizes.items() for k, p in enumerate(rng.uniform(-1, 1, (n, 3)))], POINTS)


@pytest.mark.parametrize("style", ["segmentation", "projection"])
def test_graphs_made_in_a_task_equal_those_by_joins(spark, style):
    p = clouds(spark, {1: 30, 2: 30, 3: 100, 4: 4, 5: 1})
    one, two = (neighbors.gaussian_graph(p, 6, style, block=block).toPandas().set_index(["specimen_id", "src", "dst"])["w"].sort_index() for block in (65_536, 16))
    assert list(one.index) == list(two.index) and len(one) > 700
    assert one.to_numpy() == pytest.approx(two.to_numpy(), nan_ok=True)
    plan = neighbors.gaussian_graph(p, 6, style)._jdf.queryExecution().optimizedPlan().toString()
    assert "median" not in plan and plan.count("Aggregate") == 1  # one grouping of points, none of edges


@pytest.mark.parametrize(("soft", "weigh"), [(None, False), (3.0, True)])
def test_warps_in_a_task_equal_those_over_edges(spark, soft, weigh):
    shapes, faces = {1: grid(3, 1)[0], 2: 3 * grid(4, 2)[0], 3: grid(4, 3)[0]}, grid(4, 1)[1]
    p, to, f = frames(spark, shapes, faces, {0: (0, 0, 1), 3: (0, 3, 0), 12: (3, 0, 0)})
    plan = biharmonic.warp(p, to, f, soft=soft, weigh=weigh)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1 and plan.count("Join") == 2  # topology and targets, one row each
    one, two = (biharmonic.warp(p, to, f, soft=soft, weigh=weigh, tolerance=1e-10, whole=whole).toPandas().sort_values(["specimen_id", "pidx"]) for whole in (8, 15))
    assert len(one) == 41 and one["residual"].max() <= 1e-10
    assert one[["x", "y", "z"]].to_numpy() == pytest.approx(two[["x", "y", "z"]].to_numpy(), abs=1e-6)
    alone = biharmonic.warp(p, to, f, soft=soft, weigh=weigh, tolerance=1e-10).toPandas().sort_values(["specimen_id", "pidx"])
    assert alone[["x", "y", "z"]].to_numpy() == pytest.approx(two[["x", "y", "z"]].to_numpy(), abs=1e-6)


def test_normals_in_blocks_equal_those_of_whole_specimens_without_rows_of_pairs(spark):
    p = clouds(spark, {1: 40, 2: 40, 3: 90}, seed=1)
    one, two = (surfaces.cloud_normals(p, 0.9, 12, block=block).toPandas().sort_values(["specimen_id", "pidx"])[["nx", "ny", "nz"]].to_numpy() for block in (65_536, 16))
    assert one == pytest.approx(two) and np.linalg.norm(one, axis=1) == pytest.approx(np.ones(170))
    plan = surfaces.cloud_normals(p, 0.9)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1


def test_vertices_merged_in_a_task_equal_those_merged_by_joins(spark):
    v = clouds(spark, {1: 30, 2: 30, 3: 80, 4: 1}, seed=2).withColumnRenamed("pidx", "vid")
    v = v.unionByName(spark.createDataFrame([(4, 50, float("nan"), 0.0, 0.0), (4, 60, float("inf"), 0.0, 0.0)], v.schema))
    one, two = ({tuple(r) for r in shells.coincident(v, 0.4, whole).select("specimen_id", "vid", "into").collect()} for whole in (1024, 0))
    assert one == two and len(one) == 143 and len({(s, k) for s, _, k in one}) < 100
    assert "MapInArrow" in shells.coincident(v, 0.4)._jdf.queryExecution().optimizedPlan().toString()


def test_histograms_made_in_a_task_equal_those_by_joins(spark):
    p = clouds(spark, {1: 30, 2: 30, 3: 70, 4: 1}, seed=3)
    n = clouds(spark, {1: 30, 2: 30, 3: 70, 4: 1}, seed=4).selectExpr("specimen_id", "pidx", *(f"{c} / sqrt(x * x + y * y + z * z) AS n{c}" for c in "xyz"))
    both = p.join(n, ["specimen_id", "pidx"])
    one, two = (features.fpfh(both, 0.9, 8, whole).toPandas().set_index(["specimen_id", "pidx", "fidx"])["v"].sort_index() for whole in (10_000, 0))
    assert list(one.index) == list(two.index) and one.to_numpy() == pytest.approx(two.to_numpy())
    assert features.fpfh(both, 0.9, 8)._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_edges_that_a_walk_reads_many_times_are_found_once(spark):
    from shapelake.plans import catalogue

    edges = catalogue._locus_edges(spark, "/root/testdata/sf0.001")
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert edges.count() == 39 and "Aggregate" not in plan and "Relation" not in plan
