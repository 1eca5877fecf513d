"""Registrations of many shapes together against loops over shapes."""

import numpy as np
import pytest

from shapelake.operators import kernels, registration, shape_model
from shapelake.operators.registration import rotations


def turn_by_singular_values(h):
    u, _, vt = np.linalg.svd(h)
    u[:, :, 2] *= np.where(np.linalg.det(u @ vt) < 0, -1.0, 1.0)[:, None]
    return u @ vt


def test_turns_are_those_of_singular_values():
    rng = np.random.default_rng(1)
    h = rng.normal(size=(500, 3, 3)) * 10.0 ** rng.integers(-150, 150, (500, 1, 1))
    h[::5, 2] = 0  # of flat shapes
    assert kernels.best_turns(h) == pytest.approx(turn_by_singular_values(h), abs=1e-9)
    poor = np.stack([np.zeros((3, 3)), np.diag([1.0, 0, 0]), np.diag([1.0, 1, -1]), np.diag([1.0, -1, -1]), np.full((3, 3), np.nan)])
    got = kernels.best_turns(poor)
    assert np.isnan(got[4]).all() and got[:4] @ np.swapaxes(got[:4], 1, 2) == pytest.approx(np.tile(np.eye(3), (4, 1, 1)), abs=1e-9)
    assert (got * poor).sum((1, 2))[:4] == pytest.approx([0, 1, 1, 3], abs=1e-9)


def icp_in_a_loop(start, target, rounds):
    placed, last = start, np.inf
    for _ in range(rounds):
        d2 = ((placed[:, None] - target) ** 2).sum(2)
        rms = np.sqrt(d2.min(1).mean())
        if last - rms < 1e-9:
            break
        last = rms
        _, r, t = kernels.similarity_fit(start, target[d2.argmin(1)], False)
        placed = start @ r.T + t
    return placed


def test_positions_on_several_shapes_end_where_each_ends_alone():
    rng = np.random.default_rng(2)
    targets = [rng.normal(size=(n, 3)) + 5 for n in (21, 9, 1_100)]  # the last is searched in leaves
    starts, of = rng.normal(size=(30, 3)) @ np.swapaxes(rotations(12, 3), 1, 2) + 5, np.repeat([0, 1, 2], [6, 1, 5])
    got = kernels.icp_shapes(starts, of, targets, 30)
    for start, k, end in zip(starts, of, got, strict=True):
        assert end == pytest.approx(icp_in_a_loop(start, targets[k], 30), abs=1e-9)


def soft_matches(target, moved, sigma2, outliers=0.1):
    box = max(np.prod(np.ptp(target, axis=0)), 1e-12)
    p = np.exp(-((target[:, None] - moved[None]) ** 2).sum(-1) / (2 * sigma2))
    return p / np.maximum(p.sum(1, keepdims=True) + (2 * np.pi * sigma2) ** 1.5 * outliers / (1 - outliers) * len(moved) / box, 1e-300)


def bent_drift_in_a_loop(mean, modes, values, target, rounds=250):
    shape, s, r, t = mean, 1.0, np.eye(3), target.mean(0) - mean.mean(0)
    sigma2 = ((target[:, None] - (mean + t)[None]) ** 2).sum() / (3 * len(mean) * len(target))
    for _ in range(rounds):
        p = soft_matches(target, s * shape @ r.T + t, sigma2)
        weight = np.maximum(p.sum(0), 1e-12)
        expected = (p.T @ target) / weight[:, None]
        a, c = (weight @ shape) / weight.sum(), (weight @ expected) / weight.sum()
        h = (expected - c).T @ ((shape - a) * weight[:, None])
        r = turn_by_singular_values(h[None])[0]
        s = (r * h).sum() / (weight * ((shape - a) ** 2).sum(1)).sum()
        t = c - s * r @ a
        flat, w3 = modes.reshape(len(modes), -1), np.repeat(weight, 3)
        b = np.linalg.solve((flat * w3) @ flat.T + 0.01 * sigma2 / s**2 * np.diag(1 / values), (flat * w3) @ ((expected - t) @ r / s - mean).ravel())
        shape = mean + np.tensordot(b, modes, 1)
        before, sigma2 = sigma2, max((p * ((target[:, None] - (s * shape @ r.T + t)[None]) ** 2).sum(-1)).sum() / (3 * p.sum()), 1e-12)
        if abs(before - sigma2) < 1e-6 * before:
            break
    return s * shape @ r.T + t


def test_models_bent_onto_many_specimens_are_those_of_each_alone():
    rng = np.random.default_rng(4)
    mean, values = rng.normal(size=(14, 3)), np.array([0.4, 0.2])
    modes = np.linalg.qr(rng.normal(size=(42, 2)))[0].T.reshape(2, 14, 3)
    targets = np.stack([1.3 * (mean + np.tensordot(rng.normal(size=2) * np.sqrt(values), modes, 1))[rng.permutation(14)] + 4 for _ in range(9)])
    targets[3] = np.nan
    got, b, s, _, _ = kernels.ssm_drift_many(mean, modes, values, targets)
    assert np.isnan(got[3]).all() and b.shape == (9, 2) and len(s) == 9
    for k in set(range(9)) - {3}:  # they settle after different rounds
        assert got[k] == pytest.approx(bent_drift_in_a_loop(mean, modes, values, targets[k]), abs=1e-6)
    with pytest.raises(np.linalg.LinAlgError):
        kernels.ssm_drift(mean, modes, values, targets[3])


def test_fits_of_specimens_of_several_sizes_do_not_change_with_their_company(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base, move = rng.normal(size=(12, 3)), rng.normal(size=(12, 3)) * 0.3
    rows = lambda shapes: spark.createDataFrame([(n, k, *map(float, p)) for n, s in shapes.items() for k, p in enumerate(s)], "specimen_id long, pidx int, x double, y double, z double").repartition(1)
    model = shape_model.build(rows({n: base + b * move for n, b in enumerate(rng.normal(size=30))}))
    specimens = rows({n: (base + b * move)[: 12 - 3 * (n % 3)] + 0.3 for n, b in enumerate(rng.normal(size=12))})
    found = lambda: np.array(sorted(map(tuple, registration.fit_model(specimens, *model).collect())))
    together = found()
    monkeypatch.setattr(registration, "TOGETHER", 1)
    assert together == pytest.approx(found(), abs=1e-6) and len(together) == 12 * 12


def drift_in_a_loop(source, target, rounds=250):
    s, r, t = 1.0, np.eye(3), np.zeros(3)
    sigma2 = ((target[:, None] - source[None]) ** 2).sum() / (3 * len(source) * len(target))
    for _ in range(rounds):
        p = soft_matches(target, s * source @ r.T + t, sigma2)
        total, px, py = p.sum(), p.sum(1), p.sum(0)
        mx, my = px @ target / total, py @ source / total
        x, y = target - mx, source - my
        h = x.T @ p @ y
        r = turn_by_singular_values(h[None])[0]
        s = (r * h).sum() / (py @ (y * y).sum(1))
        t = mx - s * r @ my
        before, sigma2 = sigma2, max((px @ (x * x).sum(1) - s * (r * h).sum()) / (3 * total), 1e-12)
        if abs(before - sigma2) < 1e-6 * before:
            break
    return s * source @ r.T + t


def free_drift_in_a_loop(source, target, rounds=250):
    scale = 20.0 / np.linalg.norm(np.ptp(target, axis=0))
    y, x = source * scale, target * scale
    kernel = np.exp(-((y[:, None] - y[None]) ** 2).sum(-1) / 8)
    moved, sigma2 = y, ((x[:, None] - y[None]) ** 2).sum() / (3 * len(x) * len(y))
    for _ in range(rounds):
        p = soft_matches(x, moved, sigma2)
        weight = p.sum(0)
        moved = y + kernel @ np.linalg.solve(weight[:, None] * kernel + 2 * sigma2 * np.eye(len(y)), p.T @ x - weight[:, None] * y)
        before, sigma2 = sigma2, max((p * ((x[:, None] - moved[None]) ** 2).sum(-1)).sum() / (3 * p.sum()), 1e-12)
        if abs(before - sigma2) < 1e-6 * before:
            break
    return moved / scale


def test_many_drifts_are_those_of_each_alone():
    rng = np.random.default_rng(6)
    base = rng.normal(size=(12, 3)) * (3, 2, 1)
    targets = np.stack([base @ turn.T * 1.2 + rng.normal(size=(12, 3)) * 0.1 for turn in rotations(7, 8)])
    targets[2] = np.nan
    s, r, t = kernels.cpd_rigid_many(np.broadcast_to(base, targets.shape), targets)
    rigid, free = kernels.posed(base[None], s, r, t), kernels.fine_drift_many(np.broadcast_to(base, targets.shape), targets)
    assert np.isnan(rigid[2]).all() and np.isnan(free[2]).all()
    for k in set(range(7)) - {2}:
        assert rigid[k] == pytest.approx(drift_in_a_loop(base, targets[k]), abs=1e-6)
        assert free[k] == pytest.approx(free_drift_in_a_loop(base, targets[k]), abs=1e-4)


def test_transfer_of_specimens_of_several_sizes_does_not_change_with_their_company(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(12, 3)) * (3, 2, 1)
    shapes = {n: (base @ turn.T * 2 + rng.normal(size=(12, 3)) * 0.05)[: 12 - n % 3] for n, turn in enumerate(rotations(7, 8))}
    shapes[7] = np.full((12, 3), np.nan)
    rows = lambda shapes: spark.createDataFrame([(n, k, *map(float, p)) for n, s in shapes.items() for k, p in enumerate(s)], "specimen_id long, pidx int, x double, y double, z double").repartition(1)
    mean = rows({0: base}).drop("specimen_id")
    found = lambda: sorted((r.specimen_id, r.pidx, r.x, r.y, r.z) for r in registration.transfer(rows(shapes), mean, mean.where("pidx < 4"), hypotheses=20).where("error IS NULL").collect())
    together = found()
    monkeypatch.setattr(registration, "TOGETHER", 1)
    monkeypatch.setattr(registration, "REFINED", 1)
    assert len(together) == 28 and np.array(together) == pytest.approx(np.array(found()), abs=1e-9)


def test_a_shape_that_meets_one_target_alone_is_not_turned():
    start = np.random.default_rng(7).normal(size=(9, 3)) * 0.01
    target = np.array([[0.1, 0.2, 0.3], [50.0, 0, 0], [0, 50.0, 0]])
    assert kernels.icp_many(start[None], target, 30)[0] == pytest.approx(start - start.mean(0) + target[0], abs=1e-12)
