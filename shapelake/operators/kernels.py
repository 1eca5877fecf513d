"""NumPy helpers that tasks run on one specimen at a time; no Spark in here."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations
from math import comb

import numpy as np

from . import boxes


def _least(d2: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` least values of each row in order, ties to the lower column."""
    if 4 * k >= d2.shape[1]:
        return np.argsort(d2, axis=1, kind="stable")[:, :k]
    order = np.sort(np.argpartition(d2, k - 1, axis=1)[:, :k], axis=1)
    value = np.take_along_axis(d2, order, 1)
    order = np.take_along_axis(order, np.argsort(value, axis=1, kind="stable"), 1)
    tied = np.flatnonzero((d2 <= value.max(1, keepdims=True)).sum(1) > k)  # equals at the edge: which of them were taken is open
    order[tied] = np.argsort(d2[tied], axis=1, kind="stable")[:, :k]
    return order


FEW = 1024  # up to so many targets, all are compared


def _squares(queries: np.ndarray, targets: np.ndarray) -> np.ndarray:
    out = 0.0
    for c in range(3):  # a coordinate at a time, so that rows lie together
        d = queries[:, c, None] - targets[None, :, c]
        d *= d
        out = d if c == 0 else np.add(out, d, out=out)
    return out


def nearest(queries: np.ndarray, targets: np.ndarray, k: int, skip_self: bool = False, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Indices and squared distances of the ``k`` nearest targets of each query,
    nearest first, ties to the lower index. A block of queries at a time; many
    targets are searched in leaves of points that lie together."""
    k = max(0, min(k, len(targets) - skip_self))
    if k and len(targets) > FEW and np.isfinite(queries).all() and np.isfinite(targets).all():
        index, apart = boxes.nearest(queries, targets, targets, k + skip_self, lambda q, at: _squares(q, targets[at]))
        if skip_self:
            own = index == np.arange(len(queries))[:, None]
            own[~own.any(1), -1] = True
            index, apart = index[~own].reshape(-1, k), apart[~own].reshape(-1, k)
        return index, apart
    block = max(1, min(block, 4_000_000 // max(len(targets), 1)))
    index, apart = np.zeros((len(queries), k), np.int64), np.zeros((len(queries), k))
    for at in range(0, len(queries) if k else 0, block):
        d2 = _squares(queries[at : at + block], targets)
        if skip_self:
            rows = np.arange(len(d2))
            d2[rows, rows + at] = np.inf
        order = np.argmin(d2, axis=1)[:, None] if k == 1 else _least(d2, k)
        index[at : at + block], apart[at : at + block] = order, np.take_along_axis(d2, order, 1)
    return index, apart


def nearest_many(queries: np.ndarray, targets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`nearest` of many shapes of few points each, ``queries`` (many x m x 3) in ``targets`` (many x n x 3)."""
    d2 = 0.0
    for c in range(3):
        d = queries[:, :, None, c] - targets[:, None, :, c]
        d2 = d2 + d * d
    d2 = d2.reshape(-1, targets.shape[1])
    k = max(0, min(k, d2.shape[1]))
    order = np.argmin(d2, axis=1)[:, None] if k == 1 else _least(d2, k) if k else np.zeros((len(d2), 0), np.int64)
    return (a.reshape(*queries.shape[:2], k) for a in (order, np.take_along_axis(d2, order, 1)))


#: Numbers in an array, as many as stay in a core's memory, for shapes that are worked on together.
TOGETHER = 1 << 14


def _columns(queries: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Squared distances (targets x queries): few targets, so that rows are long."""
    out = 0.0
    for c in range(3):
        d = queries[None, :, c] - targets[:, c, None]
        d *= d
        out = d if c == 0 else np.add(out, d, out=out)
    return out


def closest(targets: list[np.ndarray]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function that gives the nearest points (h x m x 3) to those of many positions (h x m x 3) among the
    ``targets`` that ``of``, in order, says.

    Compared are |t|^2 - 2 q t, so targets should lie about 0; of points that are equally near but for
    rounding it may be either."""
    every, first = np.concatenate(targets), np.cumsum([0, *(len(t) for t in targets)])[:-1]
    forms = [np.concatenate([-2 * t.T, (t * t).sum(1)[None]]) for t in targets]

    def find(placed: np.ndarray, of: np.ndarray) -> np.ndarray:
        rows, index = np.ones((*placed.shape[:2], 4)), np.empty(placed.shape[:2], np.int64)
        rows[:, :, :3] = placed
        ends = np.searchsorted(of, np.arange(len(targets) + 1)).tolist()
        for target, form, i, j in zip(targets, forms, ends, ends[1:]):
            step = max(1, 2 * TOGETHER // max(1, placed.shape[1] * len(target)))
            for at in range(i, j, step):
                some = rows[at : min(at + step, j)].reshape(-1, 4)
                out = index[at : min(at + step, j)].reshape(-1)
                if len(target) > FEW:
                    out[:] = nearest(some[:, :3], target, 1)[0][:, 0]
                else:
                    (some @ form).argmin(1, out=out)
        index += first[of][:, None]
        return every.take(index, 0)

    return find


def middle(values: np.ndarray) -> np.ndarray:
    """Median of each row, NaN counting as the largest; NaN without values."""
    n = values.shape[-1]
    if not n:
        return np.full(values.shape[:-1], np.nan)
    s = np.sort(values, axis=-1)
    return (s[..., (n - 1) // 2] + s[..., n // 2]) / 2


def graph_weights(index: np.ndarray, d2: np.ndarray, style: str, k: int) -> np.ndarray:
    """Weights of the neighbours (many x n x k) of many shapes, by each shape's own bandwidth."""
    seg, apart = style == "segmentation", np.sqrt(d2)
    s = middle(apart.reshape(len(d2), -1) if seg else apart[:, :, k - 1] if d2.shape[2] >= k else apart[:, :, :0].reshape(len(d2), -1))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.exp(-d2 / ((1 if seg else 2) * s * s)[:, None, None])


def symmetrised(src: np.ndarray, dst: np.ndarray, w: np.ndarray, n: int, how: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both directions of edges between numbers below ``n`` once: the larger weight (``max``) or half the sum."""
    key = np.concatenate([src * n + dst, dst * n + src])
    order = np.argsort(key, kind="stable")
    key, w = key[order], np.concatenate([w, w])[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    key = key[first]
    w = w[first] if not len(first) else np.maximum.reduceat(w, first) if how == "max" else np.add.reduceat(w, first) / 2
    return key // n, key % n, w


def similarity_fit(source: np.ndarray, target: np.ndarray, scaling: bool = True) -> tuple[float, np.ndarray, np.ndarray]:
    """Scale, rotation and shift of the least-squares fit s R p + t (Umeyama 1991)."""
    a, b = source.mean(0), target.mean(0)
    p, q = source - a, target - b
    u, s, vt = np.linalg.svd(q.T @ p)
    sign = np.array([1.0, 1.0, np.sign(np.linalg.det(u @ vt)) or 1.0])
    rotation = (u * sign) @ vt
    spread = (p * p).sum()
    scale = float((s * sign).sum() / spread) if scaling and spread > 0 else 1.0
    return scale, rotation, b - scale * rotation @ a


def _form(*cells: tuple[int, int, int]) -> np.ndarray:
    m = np.zeros((4, 4))
    for i, j, v in cells:
        m[i, j] = m[j, i] = v
    return m.ravel()


#: Cell ij of the rotation of a unit quaternion q (w, x, y, z) is q' A q for row 3 i + j here.
_FORMS = np.stack([
    _form((0, 0, 1), (1, 1, 1), (2, 2, -1), (3, 3, -1)), _form((1, 2, 1), (0, 3, -1)), _form((1, 3, 1), (0, 2, 1)),
    _form((1, 2, 1), (0, 3, 1)), _form((0, 0, 1), (1, 1, -1), (2, 2, 1), (3, 3, -1)), _form((2, 3, 1), (0, 1, -1)),
    _form((1, 3, 1), (0, 2, -1)), _form((2, 3, 1), (0, 1, 1)), _form((0, 0, 1), (1, 1, -1), (2, 2, -1), (3, 3, 1)),
])


def best_turns(h: np.ndarray) -> np.ndarray:
    """Rotations R with the largest sums of R * h (g x 3 x 3): unit quaternions, the leading eigenvectors of
    4 x 4 matrices (Horn 1987) by Newton's method on their characteristic polynomials; by singular values
    where these are not exact. Of equally good ones it is one that turns little. What is not finite has no rotation (NaN)."""
    with np.errstate(all="ignore"):
        unit = h / np.sqrt((h * h).sum((1, 2), keepdims=True))
        minors = np.cross(unit[:, [1, 2, 0]], unit[:, [2, 0, 1]])
        d, c = 8 * (unit[:, 0] * minors[:, 0]).sum(1), 1 - 4 * (minors * minors).sum((1, 2))
        top = np.full(len(h), 3**0.5)  # no eigenvalue is above
        for _ in range(12):
            top = top - (((top * top - 2) * top - d) * top + c) / (4 * (top * top - 1) * top - d)
        n, one = (unit.reshape(-1, 9) @ _FORMS).reshape(-1, 4, 4), np.eye(4)
        q = n + top[:, None, None] * one  # the polynomial without its leading root leaves that root's vector alone
        q = q @ n + (top * top - 2)[:, None, None] * one
        q = q @ n + ((top * top - 2) * top - d)[:, None, None] * one
        at = np.abs(np.diagonal(q, axis1=1, axis2=2)).argmax(1)
        q = q @ q[np.arange(len(q)), :, at][:, :, None]
        q = q / np.sqrt((q * q).sum(1, keepdims=True))
        off, alone = np.abs(n @ q - top[:, None, None] * q).max((1, 2)), 4 * (top * top - 1) * top - d
    r = ((q @ np.swapaxes(q, 1, 2)).reshape(-1, 16) @ _FORMS.T).reshape(-1, 3, 3)
    poor = np.flatnonzero(~((off <= 1e-12) & (alone > 1e-9)))
    if len(poor):
        known = poor[np.isfinite(h[poor]).all((1, 2))]
        u, _, vt = np.linalg.svd(h[known] + 1e-12 * np.abs(h[known]).max((1, 2), initial=0, keepdims=True) * np.eye(3))
        u[:, :, 2] *= np.where(np.linalg.det(u @ vt) < 0, -1.0, 1.0)[:, None]
        r[poor] = np.nan
        r[known] = u @ vt
    return r


def rigid_fits(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Rotations (g x 3 x 3) of the least-squares fits of many shapes (g x m x 3) to as many targets."""
    return best_turns(np.swapaxes(target - target.mean(1, keepdims=True), 1, 2) @ (source - source.mean(1, keepdims=True)))


def similarity_poses(source: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`similarity_fit` of one shape (m x 3) to many targets (g x m x 3): scales, rotations and shifts."""
    a, b = source.mean(0), target.mean(1, keepdims=True)
    h, spread = np.swapaxes(target - b, 1, 2) @ (source - a), ((source - a) ** 2).sum()
    r = best_turns(h)
    s = (r * h).sum((1, 2)) / spread if spread > 0 else np.ones(len(target))
    return s, r, b[:, 0] - s[:, None] * (r @ a)


def similarity_fits(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Many shapes (h x m x 3) after their least-squares similarity fits to one target."""
    a, b = source.mean(1, keepdims=True), target.mean(0)
    p = source - a
    u, d, vt = np.linalg.svd((target - b).T @ p)
    sign = np.where(np.linalg.det(u @ vt) < 0, -1.0, 1.0)
    u[:, :, 2] *= sign[:, None]
    spread = (p * p).sum((1, 2))
    scale = np.where(spread > 0, (d[:, 0] + d[:, 1] + sign * d[:, 2]) / np.where(spread > 0, spread, 1), 1.0)
    return scale[:, None, None] * p @ np.swapaxes(u @ vt, 1, 2) + b


def farthest_many(shapes: np.ndarray, count: int) -> np.ndarray:
    """Sorted indices of a greedy max-min subset of each of ``shapes`` (many x n x 3), all a step at a time.

    The first is farthest from the centroid; ties go to the lowest index.
    """
    many, n = shapes.shape[:2]
    if count >= n:
        return np.tile(np.arange(n), (many, 1))
    each, taken = np.arange(many), np.zeros((many, n), bool)
    reach, away = np.full((many, n), np.inf), ((shapes - shapes.mean(1, keepdims=True)) ** 2).sum(2)
    for _ in range(count):
        at = np.where(taken, -np.inf, away).argmax(1)
        taken[each, at] = True
        away = reach = np.minimum(reach, ((shapes - shapes[each, at][:, None]) ** 2).sum(2))
    return np.nonzero(taken)[1].reshape(many, count)


def farthest_points(points: np.ndarray, count: int) -> np.ndarray:
    """:func:`farthest_many` of one shape."""
    return farthest_many(points[None], max(count, 0))[0]


def tps_fit(source: np.ndarray, target: np.ndarray, smooth: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Weights and affine part of the thin-plate spline with kernel r (Bookstein 1989).

    Fewer than four points get an affine least-squares fit; a singular system is
    solved with a little regularisation.
    """
    n = len(source)
    ones = np.hstack([np.ones((n, 1)), source])
    if n < 4:
        return np.zeros((n, 3)), np.linalg.lstsq(ones, target, rcond=None)[0]
    r = np.sqrt(((source[:, None] - source[None]) ** 2).sum(-1)) + smooth * np.eye(n)
    system = np.block([[r, ones], [ones.T, np.zeros((4, 4))]])
    right = np.vstack([target, np.zeros((4, 3))])
    try:
        w = np.linalg.solve(system, right)
    except np.linalg.LinAlgError:
        w = np.linalg.lstsq(system + 1e-8 * np.eye(n + 4), right, rcond=None)[0]
    return w[:n], w[n:]


def tps_apply(points: np.ndarray, source: np.ndarray, weights: np.ndarray, affine: np.ndarray, block: int = 50_000) -> np.ndarray:
    out = np.empty_like(points)
    for at in range(0, len(points), block):
        p = points[at : at + block]
        r = np.sqrt(((p[:, None] - source[None]) ** 2).sum(-1))
        out[at : at + block] = r @ weights + np.hstack([np.ones((len(p), 1)), p]) @ affine
    return out


def laplacian(points: np.ndarray, faces: np.ndarray) -> np.ndarray:
    """Half-cotangent Laplacian D - W of a triangle mesh, dense."""
    out = np.zeros((len(points), len(points)))
    for a, b, c in ((0, 1, 2), (1, 2, 0), (2, 0, 1)):
        i, j, o = faces[:, a], faces[:, b], faces[:, c]
        u, v = points[i] - points[o], points[j] - points[o]
        w = 0.5 * (u * v).sum(1) / np.maximum(np.linalg.norm(np.cross(u, v), axis=1), 1e-12)
        np.add.at(out, (i, j), -w)
        np.add.at(out, (j, i), -w)
        np.add.at(out, (i, i), w)
        np.add.at(out, (j, j), w)
    return out


def biharmonic_warp(points: np.ndarray, faces: np.ndarray, fixed: np.ndarray, to: np.ndarray, soft: float | None = None) -> np.ndarray:
    """Positions whose displacement is as smooth as the squared Laplacian allows.

    Constrained points go exactly ``to`` theirs, or near them with weight ``soft``.
    """
    l = laplacian(points, faces)
    system = l.T @ l + 1e-8 * np.eye(len(points))
    move = np.zeros_like(points)
    if soft is not None:
        w = np.zeros(len(points))
        w[fixed] = soft
        right = np.zeros_like(points)
        right[fixed] = soft * (to - points[fixed])
        return points + np.linalg.solve(system + np.diag(w), right)
    free = np.setdiff1d(np.arange(len(points)), fixed)
    move[fixed] = to - points[fixed]
    if len(free):
        move[free] = np.linalg.solve(system[np.ix_(free, free)], -system[np.ix_(free, fixed)] @ move[fixed])
    return points + move


def _by_row(at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between the starts ``at``, none of them empty."""
    return np.add.reduceat(values, at, axis=0)


def biharmonic_many(p: np.ndarray, of: np.ndarray, faces: np.ndarray, to: np.ndarray, soft: float | None, weigh: bool, ridge: float, tolerance: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Moves of the vertices ``p`` of many meshes (``of`` says which, 0 to n - 1, in order) that :func:`biharmonic_warp`
    would find, and each mesh's residual: sparse conjugate gradients, scaled by the diagonal.

    ``to`` is NaN where a vertex is free. A mesh stops when it is done, so that others do not change it."""
    i, j, o = (np.concatenate([faces[:, list(c)] for c in ((0, 1, 2), (1, 2, 0), (2, 0, 1))]).T)
    u, v = p[i] - p[o], p[j] - p[o]
    cross = np.linalg.norm(np.cross(u, v), axis=1)
    w, every = (u * v).sum(1) / np.maximum(cross, 1e-12) / 2, np.arange(len(p))
    key = np.concatenate([i, j, i, j, every]) * len(p) + np.concatenate([j, i, i, j, every])
    order = np.argsort(key, kind="stable")
    key, value = key[order], np.concatenate([-w, -w, w, w, np.zeros(len(p))])[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    value, src, dst = np.add.reduceat(value, first), key[first] // len(p), key[first] % len(p)
    rows, meshes = np.searchsorted(src, every), np.searchsorted(of, np.arange(of[-1] + 1))
    mass = np.ones(len(p))
    if weigh:  # each face is met at three corners, so its area is too
        mass = np.bincount(o, cross / 6, len(p))
        mass = np.where(np.bincount(o, minlength=len(p)) > 0, np.maximum(mass, 1e-12), 1.0)
    held = np.isfinite(to).all(1)
    move = np.where(held[:, None], to - p, 0.0)
    free, extra = np.where(held & (soft is None), 0.0, 1.0)[:, None], np.where(held, soft or 0.0, 0.0)[:, None] + ridge
    times = lambda x: _by_row(rows, value[:, None] * x[dst])
    system = lambda x: free * (times(times(x) / mass[:, None]) + extra * x)
    scale = 1 / (_by_row(rows, value * value / mass[dst])[:, None] + extra)
    x = move if soft is None else np.zeros_like(p)
    r = free * ((extra - ridge) * move * (soft is not None) - system(x))
    total = lambda a: _by_row(meshes, a)
    ratio = lambda a, b: np.divide(a, b, out=np.zeros_like(a), where=np.abs(b) > 0)
    d = scale * r
    rz, start = total(r * d), total(r * r)
    left = np.sqrt(ratio(start, start)).max(1)
    for _ in range(rounds):
        open_ = ~(left <= tolerance)
        if not open_.any():
            break
        q = system(d)
        step = np.where(open_[:, None], ratio(rz, total(d * q)), 0.0)[of]
        x, r = x + step * d, r - step * q
        z = scale * r
        now = total(r * z)
        d = z + ratio(now, rz)[of] * d
        rz = now
        left = np.sqrt(ratio(total(r * r), start)).max(1)
    return x, left


def icp(source: np.ndarray, target: np.ndarray, rounds: int = 50, tolerance: float = 1e-9, scaling: bool = False) -> tuple[float, np.ndarray, np.ndarray, float]:
    """Point-to-point registration from the given pose; scale, rotation, shift, root mean square."""
    s, r, t, last = 1.0, np.eye(3), np.zeros(3), np.inf
    for _ in range(rounds):
        moved = s * source @ r.T + t
        index, d2 = nearest(moved, target, 1)
        rms = float(np.sqrt(d2.mean()))
        if last - rms < tolerance:
            break
        last = rms
        s, r, t = similarity_fit(source, target[index[:, 0]], scaling)
    return s, r, t, last


def plane_icp(placed: np.ndarray, target: np.ndarray, n: np.ndarray, limit: float, rounds: int = 30, tolerance: float = 1e-9) -> np.ndarray:
    """Rigid point-to-plane registration (Chen and Medioni 1991) from where ``placed`` lies: where it ends.

    Each round takes the points with a target within ``limit`` and the small turn and
    shift that least squares gives for their distances along the targets' normals ``n``.
    """
    placed, last = placed.copy(), np.inf
    for _ in range(rounds):
        index, d2 = nearest(placed, target, 1)
        near = d2[:, 0] <= limit**2
        if near.sum() < 6:
            break
        p, q, m = placed[near], target[index[near, 0]], n[index[near, 0]]
        off = ((q - p) * m).sum(1)
        rms = float(np.sqrt((off**2).mean()))
        if last - rms < tolerance:
            break
        last = rms
        step = np.linalg.lstsq(np.hstack([np.cross(p, m), m]), off, rcond=None)[0]
        angle = np.linalg.norm(step[:3])
        x, y, z = step[:3] / max(angle, 1e-300)
        k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
        placed = placed @ (np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * k @ k).T + step[3:]
    return placed


def icp_many(starts: np.ndarray, target: np.ndarray, rounds: int = 50, tolerance: float = 1e-9) -> np.ndarray:
    """Rigid point-to-point registration of many starting positions (h x m x 3) of one shape: where each ends."""
    return icp_shapes(starts, np.zeros(len(starts), int), [target], rounds, tolerance)


def icp_shapes(starts: np.ndarray, of: np.ndarray, targets: list[np.ndarray], rounds: int = 50, tolerance: float = 1e-9) -> np.ndarray:
    """:func:`icp_many` on several shapes: ``of``, in order, says to which of ``targets`` each position goes."""
    centres = np.stack([t.mean(0) for t in targets])
    level, lift = [t - c for t, c in zip(targets, centres, strict=True)], centres[of][:, None]
    find, middle = closest(level), np.full((1, starts.shape[1]), 1 / starts.shape[1])
    placed, own, last, live = starts - lift, starts - middle @ starts, np.full(len(starts), np.inf), np.arange(len(starts))
    for _ in range(rounds):
        now = placed[live]
        to = find(now, of[live])
        now -= to
        rms = np.sqrt(np.einsum("hmc,hmc->h", now, now) / now.shape[1])
        goes = last[live] - rms >= tolerance
        live, to = live[goes], to[goes]
        last[live] = rms[goes]
        if not len(live):
            break
        r = best_turns(np.swapaxes(to - to[:, :1], 1, 2) @ own[live])  # all zero where one target is nearest to all
        placed[live] = own[live] @ np.swapaxes(r, 1, 2) + middle @ to
    return placed + lift


def pose_scores(placed: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Minus the mean squared distance to the target, and a tenth of that back, of each position (h x m x 3)."""
    h, m = placed.shape[:2]
    if m and 0 < len(target) <= FEW and m <= FEW:  # both ways from the same squares, some positions at a time
        out, step = np.empty(h), max(1, 2 * TOGETHER // (m * len(target)))
        across = np.ascontiguousarray(placed.reshape(-1, 3).T).T
        for at in range(0, h, step):
            d2 = _columns(across[at * m : (at + step) * m], target).reshape(len(target), -1, m)
            out[at : at + step] = -(d2.min(0).mean(1) + 0.1 * d2.min(2).mean(0))
        return out
    there = nearest(placed.reshape(-1, 3), target, 1)[1].reshape(len(placed), -1).mean(1)
    back = np.array([nearest(target, q, 1)[1].mean() for q in placed])
    return -(there + 0.1 * back)


def _apart(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Squared distances (g x n x m) of many shapes' points from those of others."""
    out = 0.0
    for c in range(3):
        d = target[:, :, None, c] - source[:, None, :, c]
        d *= d
        out = d if c == 0 else np.add(out, d, out=out)
    return out


def _soft(d2: np.ndarray, sigma2: np.ndarray, outliers: np.ndarray) -> np.ndarray:
    """Shares of the sources (g x n x m) in each target, some left to ``outliers``."""
    p = np.exp(d2 / (-2 * sigma2)[:, None, None])
    p /= np.maximum(p @ np.ones((p.shape[2], 1)) + ((2 * np.pi * sigma2) ** 1.5 * outliers)[:, None, None], 1e-300)
    return p


def _uniform(target: np.ndarray, outliers: float, m: int) -> np.ndarray:
    """What :func:`_soft` takes for outliers spread evenly over each target's box."""
    return outliers / (1 - outliers) * m / np.maximum(np.prod(np.ptp(target, axis=1), axis=1), 1e-12)


def _solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solutions of many systems, NaN for singular ones."""
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        if len(a) == 1:
            return np.full(b.shape, np.nan)
        return np.concatenate([_solved(a[k : k + 1], b[k : k + 1]) for k in range(len(a))])


def posed(points: np.ndarray, s: np.ndarray, r: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Many shapes scaled, turned and shifted, each its own way."""
    return s[:, None, None] * (points @ np.swapaxes(r, 1, 2)) + t[:, None]


def sound(result: np.ndarray) -> np.ndarray:
    """``result`` of one shape, or the error that the numbers have run out of range."""
    if not np.isfinite(result).all():
        raise np.linalg.LinAlgError("SVD did not converge")
    return result


def cpd_rigid(source: np.ndarray, target: np.ndarray, outliers: float = 0.1, rounds: int = 250, tolerance: float = 1e-6) -> tuple[float, np.ndarray, np.ndarray]:
    """:func:`cpd_rigid_many` of one shape."""
    s, r, t = (a[0] for a in cpd_rigid_many(source[None], target[None], outliers, rounds, tolerance))
    return float(s), sound(r), t


def cpd_rigid_many(source: np.ndarray, target: np.ndarray, outliers: float = 0.1, rounds: int = 250, tolerance: float = 1e-6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coherent point drift for similarity transforms (Myronenko and Song 2010) of many shapes
    (g x m x 3) to as many targets (g x n x 3): scales, rotations and shifts.

    Outliers are spread evenly over the target's box. A shape that has settled is left out of later
    rounds, so that others do not change it; one whose numbers run out of range has NaN.
    """
    (g, m), n = source.shape[:2], target.shape[1]
    s, r, t = np.ones(g), np.tile(np.eye(3), (g, 1, 1)), np.zeros((g, 3))
    live, y, x, extra, d2 = np.arange(g), source, target, _uniform(target, outliers, m), _apart(target, source)
    sigma2 = d2.sum((1, 2)) / (3 * m * n)
    with np.errstate(all="ignore"):
        for _ in range(rounds):
            p = _soft(d2, sigma2, extra)
            px, py = p @ np.ones((m, 1)), np.swapaxes(p, 1, 2) @ np.ones((n, 1))
            total = px.sum((1, 2))
            mx, my = ((w * a).sum(1) / total[:, None] for w, a in ((px, x), (py, y)))
            far, own = x - mx[:, None], y - my[:, None]
            h = np.swapaxes(far, 1, 2) @ p @ own
            r[live] = turn = best_turns(h)
            trace = (turn * h).sum((1, 2))
            s[live] = size = trace / (py * own * own).sum((1, 2))
            t[live] = shift = mx - size[:, None] * (turn @ my[:, :, None])[:, :, 0]
            before, sigma2 = sigma2, np.maximum(((px * far * far).sum((1, 2)) - size * trace) / (3 * total), 1e-12)
            open_ = np.abs(before - sigma2) >= tolerance * before
            if not open_.any():
                break
            if not open_.all():
                live, y, x, extra, sigma2, size, turn, shift = (a[open_] for a in (live, y, x, extra, sigma2, size, turn, shift))
            d2 = _apart(x, posed(y, size, turn, shift))
    return s, r, t


def mode_count(eigenvalues: np.ndarray, share: float) -> int:
    return int(np.searchsorted(np.cumsum(eigenvalues) / eigenvalues.sum(), share - 1e-12) + 1) if len(eigenvalues) else 0


def ssm_drift(mean: np.ndarray, modes: np.ndarray, eigenvalues: np.ndarray, target: np.ndarray, outliers: float = 0.1, ridge: float = 0.01, rounds: int = 250, tolerance: float = 1e-6) -> tuple[np.ndarray, np.ndarray, float]:
    """:func:`ssm_drift_many` of one target."""
    placed, b, s, _, _ = (a[0] for a in ssm_drift_many(mean, modes, eigenvalues, target[None], outliers, ridge, rounds, tolerance))
    return sound(placed), b, float(s)


def ssm_drift_many(mean: np.ndarray, modes: np.ndarray, eigenvalues: np.ndarray, target: np.ndarray, outliers: float = 0.1, ridge: float = 0.01, rounds: int = 250, tolerance: float = 1e-6) -> tuple[np.ndarray, ...]:
    """Coherent point drift whose template bends along a shape model's modes (k x m x 3), to many targets (g x n x 3).

    Each round matches softly, fits the pose to the expected targets, and then the
    coefficients, held back by their variances, until the spread settles or
    ``rounds`` are over. Returns the fitted points, the coefficients, scales, rotations and shifts. A target that has
    settled is left out of later rounds, so that others do not change it; one whose numbers run out of range has NaN.
    """
    (g, n), m, k = target.shape[:2], len(mean), len(modes)
    flat = modes.reshape(k, m * 3)
    products = np.einsum("ima,jma->mij", modes, modes).reshape(m, k * k)  # what a landmark's weight gives to the systems
    stiff = ridge * np.diag(1 / np.maximum(eigenvalues, 1e-10))
    b, s, r, t = np.zeros((g, k)), np.ones(g), np.tile(np.eye(3), (g, 1, 1)), target.mean(1) - mean.mean(0)
    live, x, extra, shape = np.arange(g), target, _uniform(target, outliers, m), np.tile(mean, (g, 1, 1))
    d2 = _apart(x, shape + t[:, None])
    sigma2 = d2.sum((1, 2)) / (3 * m * n)
    with np.errstate(all="ignore"):
        for _ in range(rounds):
            p = _soft(d2, sigma2, extra)
            gathered = np.swapaxes(p, 1, 2) @ np.concatenate([x, np.ones((*x.shape[:2], 1))], 2)
            total, weight = gathered[:, :, 3].sum(1), np.maximum(gathered[:, :, 3:], 1e-12)
            expected, whole = gathered[:, :, :3] / weight, weight.sum((1, 2))[:, None]
            a, c = ((weight * v).sum(1) / whole for v in (shape, expected))
            own = shape - a[:, None]
            h = np.swapaxes(expected - c[:, None], 1, 2) @ (own * weight)
            r[live] = turn = best_turns(h)
            s[live] = size = (turn * h).sum((1, 2)) / np.maximum((weight * own * own).sum((1, 2)), 1e-300)
            t[live] = shift = c - size[:, None] * (turn @ a[:, :, None])[:, :, 0]
            if k:
                back = (expected - shift[:, None]) @ turn / size[:, None, None] - mean
                systems = (weight[:, :, 0] @ products).reshape(-1, k, k) + (sigma2 / size**2)[:, None, None] * stiff
                b[live] = own_b = _solved(systems, ((weight * back).reshape(len(live), -1) @ flat.T)[:, :, None])[:, :, 0]
                shape = mean + (own_b @ flat).reshape(-1, m, 3)
            d2 = _apart(x, posed(shape, size, turn, shift))
            before, sigma2 = sigma2, np.maximum((p * d2).sum((1, 2)) / (3 * total), 1e-12)
            open_ = np.abs(before - sigma2) >= tolerance * before
            if not open_.any():
                break
            if not open_.all():
                live, x, extra, shape, d2, sigma2 = (v[open_] for v in (live, x, extra, shape, d2, sigma2))
    return posed(mean + (b @ flat).reshape(g, m, 3), s, r, t), b, s, r, t


def fine_drift(source: np.ndarray, target: np.ndarray, **how) -> np.ndarray:
    """:func:`fine_drift_many` of one shape."""
    return sound(fine_drift_many(source[None], target[None], **how)[0])


def fine_drift_many(source: np.ndarray, target: np.ndarray, beta: float = 2.0, alpha: float = 2.0, outliers: float = 0.1, rank: int = 300, rounds: int = 250, tolerance: float = 1e-6) -> np.ndarray:
    """Non-rigid coherent point drift (Myronenko and Song 2010) of many shapes (g x m x 3) to as many targets (g x n x 3): where the sources' points end.

    Both are worked on at a diagonal of the target of 20. Moves are combinations of the
    ``rank`` leading eigenvectors of the Gaussian kernel of width ``beta``, held back by ``alpha``. A shape that has
    settled is left out of later rounds; one whose numbers run out of range has NaN.
    """
    scale = 20.0 / np.maximum(np.linalg.norm(np.ptp(target, axis=1), axis=1), 1e-12)[:, None, None]
    known = np.isfinite(source).all((1, 2)) & np.isfinite(target).all((1, 2))
    y, x = np.where(known[:, None, None], source * scale, 0.0), np.where(known[:, None, None], target * scale, 0.0)
    (g, m), n = y.shape[:2], x.shape[1]
    values, basis = np.linalg.eigh(np.exp(_apart(y, y) / (-2 * beta**2)))
    values, basis = values[:, ::-1][:, :rank], basis[:, :, ::-1][:, :, :rank]
    kept = values > 1e-10 * values[:, :1]
    most = int(kept.sum(1).max(initial=0))
    kept, basis = kept[:, :most], np.ascontiguousarray(np.where(kept[:, None], basis, 0.0)[:, :, :most])
    stiff = alpha / np.where(kept, values[:, :most], 1.0)
    moved, live, extra, d2, out = y, np.arange(g), _uniform(x, outliers, m), _apart(x, y), y.copy()
    sigma2 = np.maximum(d2.sum((1, 2)) / (3 * m * n), 1e-12)
    with np.errstate(all="ignore"):
        for _ in range(rounds):
            p = _soft(d2, sigma2, extra)
            gathered = np.swapaxes(p, 1, 2) @ np.concatenate([x, np.ones((*x.shape[:2], 1))], 2)
            weight, over = gathered[:, :, 3:], np.swapaxes(basis, 1, 2)
            held = over @ (weight * basis)
            held[:, np.arange(most), np.arange(most)] += sigma2[:, None] * stiff
            out[live] = moved = y + basis @ _solved(held, over @ (gathered[:, :, :3] - weight * y))
            d2 = _apart(x, moved)
            before, sigma2 = sigma2, np.maximum((p * d2).sum((1, 2)) / np.maximum(3 * weight.sum((1, 2)), 1e-300), 1e-12)
            open_ = np.abs(before - sigma2) >= tolerance * before
            if not open_.any():
                break
            if not open_.all():
                live, y, x, extra, d2, sigma2, basis, stiff = (v[open_] for v in (live, y, x, extra, d2, sigma2, basis, stiff))
    return np.where(known[:, None, None], out / scale, np.nan)


def normals(points: np.ndarray, k: int) -> np.ndarray:
    """Least principal axis of each point's ``k`` nearest, turned away from the centroid."""
    near, _ = nearest(points, points, k)
    around = points[near] - points[near].mean(1, keepdims=True)
    n = np.linalg.eigh(np.einsum("pki,pkj->pij", around, around))[1][:, :, 0]
    return n * np.where(((points - points.mean(0)) * n).sum(1) < 0, -1, 1)[:, None]


def point_features(points: np.ndarray, n: np.ndarray, k: int, bins: int = 11) -> np.ndarray:
    """Fast point feature histograms (Rusu 2009): angles of pairs, own and weighted by neighbours'."""
    near, d2 = nearest(points, points, k, skip_self=True)
    away = points[near] - points[:, None]
    size = np.sqrt(np.maximum(d2, 1e-24))[..., None]
    u = np.broadcast_to(n[:, None], away.shape)
    v = np.cross(u, away / size)
    v /= np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)
    w = np.cross(u, v)
    m = n[near]
    angles = ((v * m).sum(-1), (u * away / size).sum(-1), np.arctan2((w * m).sum(-1), (u * m).sum(-1)) / np.pi)
    own = np.zeros((len(points), 3 * bins))
    for f, a in enumerate(angles):
        cell = np.clip(((a + 1) / 2 * bins).astype(int), 0, bins - 1) + f * bins
        np.add.at(own, (np.arange(len(points))[:, None], cell), 1.0 / max(1, near.shape[1]))
    return own + (own[near] / size).mean(1) if near.shape[1] else own


def ransac(source: np.ndarray, target: np.ndarray, pairs: np.ndarray, limit: float, iterations: int = 4_000, scaling: bool = False, edge: float = 0.9, seed: int = 42) -> tuple[float, np.ndarray, np.ndarray, float]:
    """Best pose from triples of ``pairs`` (source, target indices) whose sides agree to
    ``edge``, by the share of pairs within ``limit``; refitted to those.

    All triples are tried if there are no more than ``iterations``, else that many random ones.
    """
    n, best = len(pairs), (1.0, np.eye(3), target.mean(0) - source.mean(0), 0.0)
    if n < 3:
        return best
    if comb(n, 3) <= iterations:
        triples = np.array(list(combinations(range(n), 3)))
    else:
        rng = np.random.default_rng(seed)
        triples = np.stack([rng.choice(n, 3, replace=False) for _ in range(iterations)])
    source, target = source[pairs[:, 0]], target[pairs[:, 1]]
    wide = max(1, 1_000_000 // n)
    for at in range(0, len(triples), wide):
        pick = triples[at : at + wide]
        if not scaling:
            da, db = (np.linalg.norm(q[pick] - np.roll(q[pick], 1, 1), axis=2) for q in (source, target))
            pick = pick[(np.minimum(da, db) / np.maximum(np.maximum(da, db), 1e-12) >= edge).all(1)]
        if not len(pick):
            continue
        p, q = source[pick], target[pick]
        a, b = p.mean(1, keepdims=True), q.mean(1, keepdims=True)
        u, d, vt = np.linalg.svd(np.swapaxes(q - b, 1, 2) @ (p - a))
        sign = np.where(np.linalg.det(u @ vt) < 0, -1.0, 1.0)
        u[:, :, 2] *= sign[:, None]
        spread = ((p - a) ** 2).sum((1, 2))
        s = (d[:, 0] + d[:, 1] + sign * d[:, 2]) / np.where(spread > 0, spread, 1) if scaling else np.ones(len(pick))
        s = np.where(spread > 0, s, 1.0)[:, None, None]
        near = ((s * ((source - a) @ np.swapaxes(u @ vt, 1, 2)) + b - target) ** 2).sum(2) <= limit**2
        top = int(near.sum(1).argmax())
        if near[top].mean() > best[3] and near[top].sum() >= 3:
            kept = near[top]
            best = (*similarity_fit(source[kept], target[kept], scaling), float(kept.mean()))
    return best


def heat_signature(points: np.ndarray, faces: np.ndarray, times: int = 4, most: int = 40) -> np.ndarray:
    """Heat kernel signature of each vertex at ``times`` scales, z-scored over the mesh."""
    l = laplacian(points, faces)
    area = np.full(len(points), 1e-12)
    sides = np.cross(points[faces[:, 1]] - points[faces[:, 0]], points[faces[:, 2]] - points[faces[:, 0]])
    for k in range(3):
        np.add.at(area, faces[:, k], np.linalg.norm(sides, axis=1) / 6)
    root = 1 / np.sqrt(area)
    # The constant mode adds the same to every vertex, which the z-score takes away again. It is
    # moved to the far end, so that at late times its rounding does not hide what is left.
    even = np.sqrt(area / area.sum())
    system = root[:, None] * l * root
    system = (system + system.T) / 2 + np.trace(system) * np.outer(even, even)
    values, vectors = np.linalg.eigh(system)
    values, phi = np.maximum(values[:most], 0), (root[:, None] * vectors)[:, :most]
    edge2 = np.median(((points[faces[:, 0]] - points[faces[:, 1]]) ** 2).sum(1))
    out = np.stack([(phi**2) @ np.exp(-values * t) for t in np.geomspace(1, 100, times) * edge2], 1)
    return (out - out.mean(0)) / (out.std(0) + 1e-8)


def coherent_projection(marks: np.ndarray, onto: np.ndarray, k: int = 6, weight: float = 0.7, smooth: float = 2.0, near: float = 1e-3, most: float = np.inf) -> np.ndarray:
    """Landmarks moved towards their closest surface points, together.

    Marks already within ``near`` of the surface stay. The moves of the others are
    smoothed over the graph of ``k`` neighbours, and none is longer than ``most``.
    """
    move = onto - marks
    apart = np.linalg.norm(move, axis=1)
    moving = apart > near
    if not moving.any():
        return marks.copy()
    index, d2 = nearest(marks, marks, min(k, len(marks) - 1), skip_self=True)
    w = np.zeros((len(marks), len(marks)))
    sigma2 = max(np.median(d2[:, -1]) if d2.size else 1.0, 1e-12)
    np.put_along_axis(w, index, np.exp(-d2 / (2 * sigma2)), 1)
    w = (w + w.T) / 2
    system = weight * np.diag(moving.astype(float)) + smooth * (np.diag(w.sum(1)) - w) + np.diag((~moving) * 1e6)
    step = np.linalg.solve(system + 1e-9 * np.eye(len(marks)), weight * move * moving[:, None])
    length = np.linalg.norm(step, axis=1, keepdims=True)
    return marks + np.where(moving[:, None], step * np.minimum(1, most / np.maximum(length, 1e-12)), 0)


def held_together(marks: np.ndarray, anchors: np.ndarray, fixed: np.ndarray, k: int, weight: float, smooth: float, most: float) -> np.ndarray:
    """Marks drawn to their anchors with ``weight`` while neighbours' places pull with
    ``smooth``; ``fixed`` ones stay, and no move is longer than ``most``."""
    moving = ~fixed
    if not moving.any():
        return marks.copy()
    w = np.zeros((len(marks), len(marks)))
    index, d2 = nearest(marks, marks, min(k, len(marks) - 1), skip_self=True)
    spread = max(float(np.median(d2[:, -1])), 1e-12) if d2.size else 1.0
    np.put_along_axis(w, index, np.exp(-d2 / (2 * spread)), 1)
    w = (w + w.T) / 2
    pull = smooth * (np.diag(w.sum(1)) - w)
    system = pull[np.ix_(moving, moving)] + weight * np.eye(int(moving.sum()))
    out = marks.copy()
    out[moving] = np.linalg.solve(system, weight * anchors[moving] - pull[np.ix_(moving, fixed)] @ marks[fixed])
    step = out - marks
    length = np.linalg.norm(step, axis=1, keepdims=True)
    return marks + step * np.minimum(1.0, most / np.maximum(length, 1e-300))


def _sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` at each of ``n`` places."""
    return np.bincount(at, values, n) if values.ndim == 1 else np.stack([np.bincount(at, v, n) for v in values.T], 1)


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.fmin(np.maximum(cosine, -1), 1))  # what is no number is 1, as in Spark's least


def _unit_normals(p: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit normals (norm plus 1e-12) and areas of triangles."""
    n = np.cross(p[f[:, 1]] - p[f[:, 0]], p[f[:, 2]] - p[f[:, 0]])
    size = np.sqrt((n * n).sum(1))
    return n / (size + 1e-12)[:, None], size / 2


def _around_corners(p: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Principal curvatures of vertices, by the signed curvatures of ``mesh.curvature``; of those without faces no numbers."""
    i, j, o = np.concatenate([f[:, c] for c in ([0, 1, 2], [1, 2, 0], [2, 0, 1])]).T
    u, v = p[i] - p[o], p[j] - p[o]
    along, size = (u * v).sum(1), np.sqrt((np.cross(u, v) ** 2).sum(1))
    pull = (along / np.maximum(size, 1e-12) / 2)[:, None] * (p[j] - p[i])
    pull = _sums(i, pull, len(p)) - _sums(j, pull, len(p))
    defect = 2 * np.pi - _sums(o, _angle(along / (np.sqrt((u * u).sum(1)) * np.sqrt((v * v).sum(1)) + 1e-12)), len(p))
    # at a corner of one face alone pull and normal are at right angles but for rounding: it must be that of the joins
    normal, share = _unit_normals(p, f)
    area = np.maximum(_sums(f.ravel(), np.repeat(share / 3, 3), len(p)), 1e-12)
    up = _sums(f.ravel(), np.repeat(normal * share[:, None], 3, axis=0), len(p))
    mean, gauss = np.sqrt((pull * pull).sum(1)) / (2 * area), defect / area
    mean = np.where((pull * up).sum(1) > 0, -mean, mean)
    root = np.sqrt(np.maximum(mean * mean - gauss, 0))
    a, b = mean + root, mean - root
    first = np.abs(a) >= np.abs(b)
    return np.where(first, a, b), np.where(first, b, a)


def _axes(p: np.ndarray, of: np.ndarray, many: int) -> np.ndarray:
    """Each shape's direction of the greatest spread, its largest part positive."""
    n, total = np.maximum(np.bincount(of, minlength=many), 1), _sums(of, p, many)
    m = np.stack([np.stack([np.bincount(of, p[:, a] * p[:, b], many) - total[:, a] * total[:, b] / n for b in range(3)], -1) for a in range(3)], -2)
    known = np.isfinite(m).all((1, 2))
    v = np.where(known[:, None], np.linalg.eigh(np.where(known[:, None, None], m, 0))[1][:, :, 2], np.nan)
    return v * np.where(np.take_along_axis(v, np.abs(v).argmax(1)[:, None], 1) < 0, -1.0, 1.0)


def vertex_features_many(p: np.ndarray, of: np.ndarray, here: np.ndarray, faces: np.ndarray, scales: tuple[int, ...], step: float = 0.5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values (vertices x features) of ``segmentation.feature_stack`` before pooling, of many meshes together
    (``of`` says which), which vertices have them, and each edge once in both directions.

    Vertices that are not ``here`` are only named by faces: such faces have edges and nothing else."""
    n, many = len(p), int(of[-1]) + 1
    ends = lambda f: np.unique(np.concatenate([np.minimum(f, f[:, [1, 2, 0]]).ravel() * n + np.maximum(f, f[:, [1, 2, 0]]).ravel()]))
    f = faces[here[faces].all(1)]
    every, own = (np.stack(np.divmod(ends(x), n), 1) for x in (faces, f))
    both = np.concatenate([every, every[:, ::-1]])
    on = np.zeros(n, bool)
    on[f] = True
    degree, now, bent = np.bincount(own.ravel(), minlength=n)[:, None], p, {}
    for k in range(max(scales, default=0) + 1):
        if k in scales:
            one, two = _around_corners(now, f)
            bent[k] = [2 / np.pi * np.arctan2(one + two, one - two + 1e-12), np.sqrt((one * one + two * two) / 2), one, two]
        around = _sums(own.T.ravel(), now[own[:, ::-1].T.ravel()], n)
        now = np.where(degree > 0, now + step * (around / np.maximum(degree, 1) - now), now)
    out = [v for k in scales for v in bent[k]]
    normal, share = _unit_normals(p, f)
    # the two faces of each edge; edges with other than two count as flat
    key = (np.minimum(f, f[:, [1, 2, 0]]) * n + np.maximum(f, f[:, [1, 2, 0]])).ravel()
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])) if len(key) else np.zeros(0, np.int64)
    count, owner = np.diff(np.append(first, len(key))), order // 3
    angle = np.where(count == 2, _angle((normal[owner[first]] * normal[owner[first + count - 1]]).sum(1)), 0.0)
    mean = lambda at, values: np.bincount(at, values, n) / np.maximum(np.bincount(at, minlength=n), 1)
    out.append(mean(np.concatenate(np.divmod(key[order][first], n)), np.tile(angle, 2)))
    up = _sums(f.ravel(), np.repeat(normal * share[:, None], 3, axis=0), n)
    up = up / (np.sqrt((up * up).sum(1)) + 1e-12)[:, None]
    known = both[on[both].all(1)]
    out.append(mean(known[:, 0], _angle((up[known[:, 0]] * up[known[:, 1]]).sum(1))))
    middle = _sums(of[on], p[on], many) / np.maximum(np.bincount(of[on], minlength=many), 1)[:, None]
    up = np.where(((up * (p - middle[of])).sum(1) < 0)[:, None], -up, up)
    out.append((up * _axes(p[here], of[here], many)[of]).sum(1))
    return np.stack(out, 1), on, np.unique(both, axis=0)


def within_hops(start: np.ndarray, edges: np.ndarray, n: int, hops: int) -> np.ndarray:
    """Pairs (number in ``start``, vertex) of what ``edges`` (in both directions, in order) lead to from
    vertices in at most ``hops`` steps, themselves included; vertices without edges have none."""
    first = np.searchsorted(edges[:, 0], np.arange(n + 1))
    pairs = np.stack([np.arange(len(start)), start], 1)[np.diff(first)[start] > 0]
    for _ in range(hops):
        times = np.diff(first)[pairs[:, 1]]
        at = np.repeat(first[pairs[:, 1]] - np.cumsum(times) + times, times) + np.arange(times.sum())
        key = np.unique(np.concatenate([pairs[:, 0] * n + pairs[:, 1], np.repeat(pairs[:, 0], times) * n + edges[at, 1]]))
        pairs = np.stack(np.divmod(key, n), 1)
    return pairs


def pooled_z_scores(values: np.ndarray, group: np.ndarray, of: np.ndarray, mean_of: int) -> np.ndarray:
    """Medians of the rows of ``values`` (of the column ``mean_of``, means) in each group, less their mean over
    the deviation plus 1e-8 within the groups' shapes ``of``; groups and shapes count from 0, none is empty."""
    count = np.bincount(group)
    first, out = np.cumsum(count) - count, np.empty((len(count), values.shape[1]))
    for c, column in enumerate(values.T):
        if c == mean_of:
            out[:, c] = np.bincount(group, column) / count
        else:
            s = column[np.lexsort((column, group))]
            low, high = s[first + (count - 1) // 2], s[first + count // 2]
            out[:, c] = np.where(low == high, low, (low + high) / 2)
    size, many = np.bincount(of)[:, None], int(of.max(initial=-1)) + 1
    apart = out - (_sums(of, out, many) / size)[of]
    return apart / (np.sqrt(_sums(of, apart * apart, many) / size) + 1e-8)[of]
