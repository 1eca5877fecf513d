"""Searches in leaves against comparing all with all."""

import time
import tracemalloc

import numpy as np
import pytest

from shapelake.operators import boxes, kernels, neighbors, surfaces

from .test_operators import frame


def compared(q, t, k):
    d2 = kernels._squares(q, t)
    order = np.argsort(d2, axis=1, kind="stable")[:, :k]
    return order, np.take_along_axis(d2, order, 1)


def clouds():
    rng = np.random.default_rng(5)
    normal = rng.normal(size=(3_000, 3)) * [5, 1, 0.1]
    yield "normal", normal[:300] + 0.1, normal
    yield "ties", rng.integers(0, 6, (200, 3)).astype(float), rng.integers(0, 6, (2_500, 3)).astype(float)
    yield "far", np.concatenate([normal[:50], [[1e6, -1e6, 0]]]), np.concatenate([normal, [[1e7, 0, 0]]])
    yield "one place", normal[:20], np.ones((1_500, 3))
    yield "line", np.column_stack([rng.normal(size=90), np.zeros((90, 2))]), np.column_stack([rng.normal(size=2_000), np.zeros((2_000, 2))])


@pytest.mark.parametrize("k", [1, 6, 150])
@pytest.mark.parametrize("case", list(clouds()), ids=lambda c: c[0])
def test_nearest_points_equal_all_with_all(case, k):
    _, q, t = case
    index, apart = kernels.nearest(q, t, k)
    want, d2 = compared(q, t, k)
    assert (index == want).all() and (apart == d2).all()


def test_a_point_is_no_neighbour_of_itself_among_many(spark):
    rng = np.random.default_rng(6)
    t = rng.integers(0, 9, (1_500, 3)).astype(float)  # many in one place
    index, apart = kernels.nearest(t, t, 5, skip_self=True)
    d2 = kernels._squares(t, t)
    np.fill_diagonal(d2, np.inf)
    assert (np.sort(d2, axis=1)[:, :5] == apart).all() and (index != np.arange(len(t))[:, None]).all()
    p = frame(spark, {1: t, 2: t[:40]})
    got = {(r.specimen_id, r.qidx, r["rank"]): r.d2 for r in neighbors.k_nearest(p, p, 5, same=True, block=400).collect()}
    assert len(got) == 5 * 1_540
    assert all(got[1, i, j + 1] == apart[i, j] for i in range(0, 1_500, 7) for j in range(5))


def test_numbers_that_are_not_finite_and_no_queries():
    t = np.random.default_rng(7).normal(size=(2_000, 3))
    assert kernels.nearest(np.zeros((0, 3)), t, 3)[0].shape == (0, 3)
    assert np.isnan(kernels.nearest(np.full((2, 3), np.nan), t, 1)[1]).all()


def surface(n, rng):
    """A wavy sheet of about 2 n triangles whose neighbours share edges and corners."""
    side = int(np.sqrt(n)) + 1
    x, y = np.meshgrid(np.arange(side, dtype=float), np.arange(side, dtype=float))
    v = np.stack([x.ravel(), y.ravel(), 3 * np.sin(x / 9).ravel() + rng.integers(0, 2, x.size)], 1)
    a = (np.arange(side - 1)[:, None] * side + np.arange(side - 1)).ravel()
    return v, np.concatenate([v[np.stack([a, a + 1, a + side], 1)], v[np.stack([a + 1, a + side + 1, a + side], 1)]])


def test_nearest_triangles_equal_all_with_all():
    rng = np.random.default_rng(8)
    v, tri = surface(900, rng)
    q = np.concatenate([v[::9], v[::7] + rng.normal(size=v[::7].shape), [[-500.0, 80, 3]]])  # corners are ties of six
    face, weight, d2 = surfaces.closest_on_triangles(q, tri)
    every = surfaces._apart(q, tri)[0]
    assert (face == every.argmin(1)).all() and d2 == pytest.approx(every.min(1), abs=1e-12)
    assert ((np.einsum("nk,nkc->nc", weight, tri[face]) - q) ** 2).sum(1) == pytest.approx(d2, abs=1e-9)


def test_half_a_million_triangles_stay_under_a_gigabyte():
    rng = np.random.default_rng(9)
    v, tri = surface(250_000, rng)
    q = v[rng.choice(len(v), 256)] + rng.normal(size=(256, 3))
    tracemalloc.start()
    began = time.time()
    face, _, d2 = surfaces.closest_on_triangles(q, tri)
    took, peak = time.time() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1e9 and took < 120
    some = rng.choice(len(tri), 2_000)
    assert (d2[:40, None] <= surfaces._apart(q[:40], tri[some])[0] + 1e-12).all()
    assert surfaces._apart(q, tri[face][:, None])[0][:, 0] == pytest.approx(d2)


def test_leaves_of_fewer_items_than_are_asked_for_at_once():
    t = np.random.default_rng(10).normal(size=(70, 3))
    index, apart = boxes.nearest(t[:9], t, t, 70, lambda q, at: kernels._squares(q, t[at]))
    want, d2 = compared(t[:9], t, 70)
    assert (index == want).all() and (apart == d2).all()
