"""Sampling of all specimens together, against each specimen by itself in plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapelake.operators import kernels, sampling

from .test_operators import frame


def one_by_one(p, count):
    chosen = [max(range(len(p)), key=lambda i: (((p[i] - p.mean(0)) ** 2).sum(), -i))]
    while len(chosen) < count:
        rest = [i for i in range(len(p)) if i not in chosen]
        chosen.append(max(rest, key=lambda i: (min(((p[i] - p[j]) ** 2).sum() for j in chosen), -i)))
    return sorted(chosen)


def cells(p, size):
    return np.unique(np.floor((p - p.min(0)) / size).astype(np.int64), axis=0, return_index=True)[1]


def bisected(p, target, fewest_over, rounds=40):
    small, large = np.linalg.norm(np.ptp(p, axis=0)) * 1e-9, np.linalg.norm(np.ptp(p, axis=0))
    best = (None, len(p))
    for _ in range(rounds):
        size = np.sqrt(small * large)
        n = len(cells(p, size))
        if fewest_over:
            better, over = target <= n <= best[1], n >= target
            done = target <= n <= target * 1.02
        else:
            better, over = abs(n - target) < abs(best[1] - target), n > target
            done = n == target or (better and abs(n - target) <= max(1, round(target * 0.02)))
        best = (size, n) if better else best
        if done:
            break
        small, large = (size, large) if over else (small, size)
    return best


@pytest.fixture(scope="module")
def clouds():
    rng = np.random.default_rng(11)
    lattice = np.stack(np.meshgrid(*[np.arange(6.0)] * 3), -1).reshape(-1, 3)  # sizes skip most counts
    return {1: rng.normal(size=(900, 3)) * [3, 1, 0.2], 2: rng.normal(size=(45, 3)), 3: lattice, 4: rng.normal(size=(12, 3)), 5: np.repeat(rng.normal(size=(8, 3)), 20, 0), 6: np.ones((70, 3)), 7: rng.normal(size=(1, 3))}


@pytest.mark.parametrize("fewest_over", [True, False])
def test_sizes_are_those_of_bisecting_each_specimen(spark, clouds, fewest_over):
    got = {r.specimen_id: (r.best_size, r.best_n) for r in sampling.voxel_sizes(frame(spark, clouds), 40, fewest_over=fewest_over).collect()}
    assert got.keys() == clouds.keys()
    for k, p in clouds.items():
        closed = np.ptp(p) == 0 or (fewest_over and len(p) <= 40) or k in (6, 7)
        size, n = (None, len(p)) if closed else bisected(p, 40, fewest_over)
        assert got[k][1] == n
        assert got[k][0] == (None if size is None else pytest.approx(size, rel=1e-12))


def test_few_rounds_are_kept_to(spark, clouds):
    two = {k: clouds[k] for k in (1, 3)}
    for rounds in (1, 4, 7):
        got = {r.specimen_id: r.best_n for r in sampling.voxel_sizes(frame(spark, two), 40, rounds=rounds).collect()}
        assert got == {k: bisected(p, 40, True, rounds)[1] for k, p in two.items()}


def test_samples_have_the_count_and_are_those_of_each_specimen(spark, clouds):
    got = {}
    for r in sampling.target_count_sample(frame(spark, clouds), 40).collect():
        got.setdefault(r.specimen_id, []).append(r.pidx)
    for k, p in clouds.items():
        if len(p) <= 40:
            want = list(range(len(p)))
        elif np.ptp(p) == 0:
            want = list(range(40))
        else:
            size, _ = bisected(p, 40, True)
            first = np.arange(len(p)) if size is None else np.sort(cells(p, size))
            want = first[kernels.farthest_points(p[first], 40)].tolist()
        assert sorted(got[k]) == want, k


def test_farthest_points_of_batches_equal_those_of_one(spark, clouds):
    ties = np.random.default_rng(3).integers(0, 3, (5, 20, 3)).astype(float)
    for p, got in zip(ties, kernels.farthest_many(ties, 6), strict=True):
        assert got.tolist() == one_by_one(p, 6)
    got = sampling.farthest(frame(spark, clouds), 9).groupBy("specimen_id").agg(F.sort_array(F.collect_list("pidx")).alias("p")).collect()
    for r in got:
        assert r.p == (one_by_one(clouds[r.specimen_id], 9) if len(clouds[r.specimen_id]) > 9 else list(range(len(clouds[r.specimen_id]))))


def test_points_that_are_not_finite_and_empty_tables(spark, clouds):
    with pytest.raises(ValueError, match="of 1 specimens"):
        sampling.voxel_sizes(frame(spark, {1: clouds[2], 2: np.array([[0, 0, np.nan]])}), 5)
    with pytest.raises(ValueError, match="positive"):
        sampling.voxel_sizes(frame(spark, {1: clouds[2]}), 0)
    assert sampling.target_count_sample(frame(spark, {1: clouds[7]}).where("false"), 5).count() == 0
