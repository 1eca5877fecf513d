"""Point feature histograms against loops over pairs."""

import numpy as np
import pytest

from shapelake.operators import features

SCHEMA = "specimen_id long, pidx int, x double, y double, z double, nx double, ny double, nz double"


def cloud(seed, n=40):
    rng = np.random.default_rng(seed)
    p, m = rng.uniform(-1, 1, (n, 3)), rng.normal(size=(n, 3))
    return p, m / np.linalg.norm(m, axis=1, keepdims=True)


def by_pairs(p, n, radius, most):
    near = []
    for i in range(len(p)):
        d2 = ((p - p[i]) ** 2).sum(1)
        near.append([(j, d2[j]) for j in sorted((j for j in range(len(p)) if j != i and d2[j] <= radius**2), key=lambda j: (d2[j], j))[:most]])
    own = np.zeros((len(p), 33))
    for i, found in enumerate(near):
        for j, d2 in found:
            line, u, m = p[j] - p[i], n[i], n[j]
            a1, a2 = u @ line / np.sqrt(d2), m @ line / np.sqrt(d2)
            rise = a1
            if abs(a1) < abs(a2):
                u, m, line, rise = n[j], n[i], -line, -a2
            v = np.cross(line, u)
            v /= np.linalg.norm(v)
            turn, lean = np.arctan2(np.cross(u, v) @ m, u @ m), v @ m
            for k, share in enumerate(((turn + np.pi) / (2 * np.pi), (lean + 1) / 2, (rise + 1) / 2)):
                own[i, 11 * k + min(10, max(0, int(np.floor(11 * share))))] += 100 / len(found)
    out = own.copy()
    for i, found in enumerate(near):
        total = sum((own[j] / d2 for j, d2 in found), np.zeros(33))
        for k in range(3):
            s = total[11 * k : 11 * k + 11].sum()
            out[i, 11 * k : 11 * k + 11] += 100 * total[11 * k : 11 * k + 11] / s if s else 0
    return out


def frame(spark, shapes):
    return spark.createDataFrame([(s, i, *map(float, a), *map(float, b)) for s, (p, m) in shapes.items() for i, (a, b) in enumerate(zip(p, m, strict=True))], SCHEMA)


@pytest.mark.parametrize("most", [100, 4])
def test_histograms_equal_loops(spark, most):
    shapes = {1: cloud(1), 2: cloud(2)}
    got = {s: np.zeros((40, 33)) for s in shapes}
    for r in features.fpfh(frame(spark, shapes), 0.8, most).collect():
        got[r.specimen_id][r.pidx, r.fidx] = r.v
    for s, (p, n) in shapes.items():
        assert np.allclose(got[s], by_pairs(p, n, 0.8, most))


def test_histograms_do_not_change_with_the_pose_and_find_their_match(spark):
    p, n = cloud(4)
    turn = np.linalg.qr(np.random.default_rng(5).normal(size=(3, 3)))[0]
    turn *= np.sign(np.linalg.det(turn))
    a, b = features.fpfh(frame(spark, {1: (p, n)}), 0.8), features.fpfh(frame(spark, {1: (p @ turn.T + 3, n @ turn.T)}), 0.8)
    matches = features.nearest_features(a, b).collect()
    assert len(matches) >= 38 and all(r.match == r.pidx and r.d2 < 1e-3 for r in matches)


def test_lone_and_equal_points(spark):
    rows = [(1, 0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0), (1, 1, 9.0, 0.0, 0.0, 1.0, 0.0, 0.0), (2, 0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0), (2, 1, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0)]
    got = features.fpfh(spark.createDataFrame(rows, SCHEMA), 1.0).collect()
    assert {r.specimen_id for r in got} == {2} and all(np.isfinite(r.v) for r in got)
