"""Bringing specimens onto a template: alignment, warps, subsets, batch transfer.

A template is one shape and goes to every task; specimens are rows, each with
its points, and are worked on one by one. What fails on one specimen is said in
its ``error`` and does not stop the others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .neighbors import k_nearest, shapes, tasks
from .points import mean_shape
from .procrustes import MOST_POINTS, align  # noqa: F401
from .sampling import farthest, target_count_sample, voxel_size_for  # noqa: F401

POINTS = "specimen_id long, pidx int, x double, y double, z double"


def template_arrays(template: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Indices and positions of one shape, in order."""
    got = template.select("pidx", "x", "y", "z").limit(MOST_POINTS + 1).toPandas().sort_values("pidx")
    if len(got) > MOST_POINTS:
        raise ValueError("the template has too many points")
    return got["pidx"].to_numpy(np.int64), got[["x", "y", "z"]].to_numpy(float)


def per_specimen(points: DataFrame, work: Callable[[np.ndarray, np.ndarray], dict], schema: str, many: int = 256) -> DataFrame:
    """``work(indices, positions)`` of each specimen as rows of ``schema`` (specimen_id first).

    Specimens are dealt out to all cores, however few bytes they have; results leave a
    task after ``many`` specimens, or sooner after as many rows as fill a block."""
    return _dealt(points, lambda rows: (work(np.asarray(row.i), np.stack([row.x, row.y, row.z], 1)) for row in rows), schema, many)


#: Products of sizes of the specimens that :func:`per_group` works on together.
TOGETHER = 1 << 17


def per_group(points: DataFrame, work: Callable[[np.ndarray], list[dict]], schema: str, landmarks: int, many: int = 256) -> DataFrame:
    """:func:`per_specimen` for ``work`` on the positions (specimens x n x 3) of several specimens of equal size: as many as
    share arrays of about ``TOGETHER`` distances from ``landmarks`` points, one at a time if they are large."""

    def run(rows: list) -> Iterator[dict]:
        sizes = np.array([len(row.x) for row in rows])
        out: list = [None] * len(rows)
        for n in np.unique(sizes):
            own, step = np.flatnonzero(sizes == n), max(1, TOGETHER // max(1, int(n) * landmarks))
            for at in range(0, len(own), step):
                some = own[at : at + step]
                p = np.stack([np.stack([rows[k].x, rows[k].y, rows[k].z], 1) for k in some])
                for k, got in zip(some, work(p), strict=True):
                    out[k] = got
        return iter(out)

    return _dealt(points, run, schema, many)


def _dealt(points: DataFrame, work: Callable[[list], Iterator[dict]], schema: str, many: int) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts, rows, every = [], 0, list(batch.itertuples(index=False))
            for row, got in zip(every, work(every), strict=True):
                parts.append((row.specimen_id, got))
                rows += len(got[names[1]])
                if len(parts) >= many or rows >= 1 << 17:
                    yield _rows(names, parts)
                    parts, rows = [], 0
            if parts:
                yield _rows(names, parts)

    return shapes(points.repartition(tasks(points), "specimen_id")).mapInPandas(run, schema)


def _rows(names: list[str], parts: list[tuple]) -> pd.DataFrame:
    """Columns of several specimens' results (specimen_id and a dict of columns) below each other."""
    out = {"specimen_id": np.repeat([s for s, _ in parts], [len(got[names[1]]) for _, got in parts])}
    for name in names[1:]:
        columns = [got[name] for _, got in parts]
        whole = np.concatenate(columns) if all(isinstance(c, np.ndarray) for c in columns) else [v for c in columns for v in c]
        out[name] = pd.array(whole, dtype="Int32") if name == "pidx" else pd.Series(whole)
    return pd.DataFrame(out)


def _placed(index: np.ndarray, p: np.ndarray) -> dict:
    return {"pidx": index.astype(np.int32), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]}


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Specimens of equal landmarks together: how many, the landmarks and all positions as bytes."""
    for batch in batches:
        alike: dict[bytes, list] = {}
        for row in batch.itertuples(index=False):
            alike.setdefault(np.asarray(row.i, np.int64).tobytes(), []).append(np.stack([row.x, row.y, row.z], 1))
        yield pd.DataFrame({"n": [len(m) for m in alike.values()], "i": list(alike), "p": [np.stack(m).tobytes() for m in alike.values()]})


def _aligned_sums(ti: np.ndarray, tp: np.ndarray):
    """Of each task, the sum of each landmark over its specimens as :func:`align` places them, and their number."""

    def run(packed: Iterator) -> Iterator[np.ndarray]:
        total = np.zeros((len(ti), 4))
        for n, i, p in packed:
            at = np.searchsorted(ti, np.frombuffer(i, np.int64))
            np.add.at(total, (at, slice(0, 3)), kernels.similarity_fits(np.frombuffer(p).reshape(n, -1, 3), tp[at]).sum(0))
            np.add.at(total, (at, 3), n)
        yield total

    return run


def procrustes_mean(points: DataFrame, rounds: int = 5000, tolerance: float = 1e-6) -> DataFrame:
    """Generalised Procrustes mean (Gower 1975): align to the mean, average, repeat.

    Specimens are packed once, thousands to a block. A round is one job without a plan
    or a shuffle over the blocks, and only the mean shape comes back. It is
    an error if the mean still moves by ``tolerance`` or more after ``rounds``.
    """
    spark = points.sparkSession
    index, mean = template_arrays(mean_shape(points))
    rows = shapes(points).repartition(spark.sparkContext.defaultParallelism)  # rounds cost a task's work, so all cores get a share of small tables too
    blocks = rows.mapInPandas(_packed, "n int, i binary, p binary").rdd.map(lambda b: (b.n, bytes(b.i), bytes(b.p))).persist(StorageLevel.MEMORY_AND_DISK)
    depth = 1 if len(index) <= 10_000 else 2  # sums of large shapes meet in tasks first
    try:
        for _ in range(rounds):
            total = blocks.mapPartitions(_aligned_sums(index, mean)).treeReduce(np.add, depth)
            after = total[:, :3] / total[:, 3:]
            after = (after - after.mean(0)) * np.linalg.norm(mean - mean.mean(0)) / max(np.linalg.norm(after - after.mean(0)), 1e-30)
            moved, mean = np.abs(after - (mean - mean.mean(0))).max(), after
            if moved < tolerance:
                break
        else:
            raise RuntimeError(f"the mean shape has not settled within {tolerance} after {rounds} rounds")
    finally:
        blocks.unpersist()
    return spark.createDataFrame(pd.DataFrame({"pidx": index.astype(np.int32), "x": mean[:, 0], "y": mean[:, 1], "z": mean[:, 2]}))


def tps_warp(points: DataFrame, targets: DataFrame, smooth: float = 0.0, most: int = 800) -> DataFrame:
    """Each specimen warped by the thin-plate spline that takes its landmarks to ``targets``.

    Of more than ``most`` constraints a farthest-point subset is used.
    """
    ti, tp = template_arrays(targets)

    def work(index, p):
        at, to = np.flatnonzero(np.isin(index, ti)), np.flatnonzero(np.isin(ti, index))
        if len(at) > most:
            keep = kernels.farthest_points(p[at], most)
            at, to = at[keep], to[keep]
        w, a = kernels.tps_fit(p[at], tp[to], smooth)
        return _placed(index, kernels.tps_apply(p, p[at], w, a))

    return per_specimen(points, work, POINTS)


def biharmonic_warp(points: DataFrame, targets: DataFrame, faces: DataFrame, soft: float | None = None) -> DataFrame:
    """Each specimen's mesh deformed smoothly so that constrained vertices meet ``targets``; by a spline where that fails."""
    ti, tp = template_arrays(targets)
    f = faces.select("a", "b", "c").toPandas().to_numpy()  # one topology

    def work(index, p):
        at, to = np.flatnonzero(np.isin(index, ti)), np.flatnonzero(np.isin(ti, index))
        try:
            return _placed(index, kernels.biharmonic_warp(p, np.searchsorted(index, f), at, tp[to], soft))
        except np.linalg.LinAlgError:
            w, a = kernels.tps_fit(p[at], tp[to])
            return _placed(index, kernels.tps_apply(p, p[at], w, a))

    return per_specimen(points, work, POINTS)


def vertex_constraints(landmarks: DataFrame, vertices: DataFrame) -> DataFrame:
    """Mean position of the landmarks whose nearest vertex is the same, for each such vertex."""
    near = k_nearest(landmarks, vertices, 1).select("specimen_id", F.col("qidx").alias("lidx"), F.col("tidx").alias("vid"))
    marks = landmarks.withColumn("lidx", F.col("pidx").cast("long"))
    return near.join(marks, ["specimen_id", "lidx"]).groupBy("specimen_id", "vid").agg(*(F.avg(c).alias(c) for c in "xyz"), F.count(F.lit(1)).alias("n"))


POSE = "specimen_id long, scale double, r00 double, r01 double, r02 double, r10 double, r11 double, r12 double, r20 double, r21 double, r22 double, tx double, ty double, tz double, rmse double, error string"


def register(points: DataFrame, template: DataFrame, method: str = "icp") -> DataFrame:
    """Pose of the template on each specimen without using which point is which, by iterated closest points or coherent point drift."""
    if method not in ("icp", "cpd"):
        raise ValueError(f"unknown method {method!r}")
    _, tp = template_arrays(template)

    def work(p):
        known = np.isfinite(p).all((1, 2))
        out = [[*[None] * 14, "points are not finite"] for _ in p]
        if method == "cpd" and known.any():
            found = zip(*kernels.cpd_rigid_many(np.broadcast_to(tp, (int(known.sum()), *tp.shape)), p[known]), strict=True)
        for k in np.flatnonzero(known):
            try:
                base = tp - tp.mean(0) + p[k].mean(0) if method == "icp" else tp
                s, r, t = kernels.icp(base, p[k])[:3] if method == "icp" else next(found)
                rmse = float(np.sqrt(kernels.nearest(s * base @ kernels.sound(r).T + t, p[k], 1)[1].mean()))
                out[k] = [s, *r.ravel(), *t, rmse, None]
            except (ValueError, np.linalg.LinAlgError) as e:
                out[k][-1] = str(e)
        return [{f.split()[0]: [v] for f, v in zip(POSE.split(", ")[1:], values, strict=True)} for values in out]

    return per_group(points, work, POSE, len(tp))


#: Points of all starting positions of all specimens that are refined together.
REFINED = 1 << 16


def _global_poses(tp: np.ndarray, p: np.ndarray, turns: np.ndarray, rounds: int = 30, coarse: int = 400, finalists: int = 12) -> np.ndarray:
    """The template where it lies best on each specimen (g x n x 3), whatever way that is turned.

    Scaled to the specimen's diagonal, it is refined from every rotation on subsets
    of ``coarse`` points, the best ``finalists`` on all points, and the best of
    those by coherent point drift where that brings it nearer.
    """
    few, first = kernels.farthest_points(tp, coarse), np.empty((len(p), *tp.shape))
    turned = (tp - tp.mean(0)) @ np.swapaxes(turns, 1, 2)
    step = max(1, REFINED // max(1, len(turns) * len(few)))
    for at in range(0, len(p), step):
        own = p[at : at + step]
        g, each = len(own), np.arange(len(own))
        scale = np.linalg.norm(np.ptp(own, axis=1), axis=1) / max(np.linalg.norm(np.ptp(tp, axis=0)), 1e-300)
        some = np.take_along_axis(own, kernels.farthest_many(own, coarse)[:, :, None], 1)
        starts = (scale[:, None, None, None] * turned[:, few] + own.mean(1)[:, None, None]).reshape(-1, len(few), 3)
        placed = kernels.icp_shapes(starts, np.repeat(each, len(turns)), list(some), rounds).reshape(g, len(turns), len(few), 3)
        best = np.stack([np.argsort(-kernels.pose_scores(x, q), kind="stable")[:finalists] for x, q in zip(placed, some, strict=True)])
        begun, ended = (np.take_along_axis(x.reshape(placed.shape), best[:, :, None, None], 1).reshape(-1, len(few), 3) for x in (starts, placed))
        whole = (scale[:, None, None, None] * turned[best]).reshape(-1, *tp.shape) + np.repeat(own.mean(1), best.shape[1], 0)[:, None]
        whole = (whole - begun.mean(1, keepdims=True)) @ np.swapaxes(kernels.rigid_fits(begun, ended), 1, 2) + ended.mean(1, keepdims=True)
        placed = kernels.icp_shapes(whole, np.repeat(each, best.shape[1]), list(own), rounds).reshape(g, -1, *tp.shape)
        first[at : at + step] = [x[kernels.pose_scores(x, q).argmax()] for x, q in zip(placed, own, strict=True)]
    both = np.stack([first, kernels.posed(first, *kernels.cpd_rigid_many(first, p))], 1)
    return np.stack([x[kernels.pose_scores(x, q).argmax()] for x, q in zip(both, p, strict=True)])


def transfer(points: DataFrame, template: DataFrame, landmarks: DataFrame, snap: bool = True, *, fine: bool = True, model: tuple[DataFrame, DataFrame] | None = None, share: float = 0.95, most: int = 10, hypotheses: int = 193, seed: int = 0) -> DataFrame:
    """Landmarks of the template predicted on each specimen: its scale, the best of
    ``hypotheses`` starting rotations, coherent point drift along the modes of
    ``model`` (modes and eigenvalues of a shape model whose mean is the template;
    no bending without one), free coherent drift if ``fine``, a spline to the nearest
    points, then each landmark to the nearest point if ``snap``. A specimen that fails has one row that says why."""
    turns = rotations(hypotheses, seed)
    _, tp = template_arrays(template)
    li, lp = template_arrays(landmarks)

    values, table = (np.zeros(0), np.zeros((0, len(tp), 3))) if model is None else _modes(*model, len(tp))
    k = min(most, kernels.mode_count(values, share))

    def ends(p: np.ndarray) -> tuple[np.ndarray, ...]:
        """Where the template is posed on specimens of equal size, how, and where it drifts to."""
        placed = _global_poses(tp, p, turns)
        s, r, t = kernels.similarity_poses(tp, placed)
        bent = placed if not k else kernels.posed(kernels.ssm_drift_many(tp, table[:k], values[:k], (p - t[:, None]) @ r / s[:, None, None])[0], s, r, t)
        return placed, kernels.posed(lp[None], s, r, t), kernels.fine_drift_many(bent, p) if fine else bent

    def marks(p: np.ndarray, placed: np.ndarray, predicted: np.ndarray, drifted: np.ndarray) -> dict:
        near, _ = kernels.nearest(kernels.sound(drifted), p, 1)
        w, a = kernels.tps_fit(placed, p[near[:, 0]], smooth=1e-3)
        found = kernels.tps_apply(predicted, placed, w, a)
        return _placed(li, p[kernels.nearest(found, p, 1)[0][:, 0]] if snap else found)

    def work(p):
        known = np.isfinite(p).all((1, 2))
        out = [{"pidx": [None], "x": [None], "y": [None], "z": [None], "error": ["points are not finite"]} for _ in p]
        for n, found in zip(np.flatnonzero(known), zip(*ends(p[known]), strict=True) if known.any() else (), strict=True):
            try:
                out[n] = {**marks(p[n], *found), "error": [None] * len(li)}
            except (ValueError, np.linalg.LinAlgError) as e:
                out[n]["error"] = [str(e)]
        return out

    return per_group(points, work, f"{POINTS}, error string", len(tp))


def register_by_features(points: DataFrame, template: DataFrame, limit: float, *, k: int = 12, iterations: int = 4_000, fitness: float = 0.99, retries: int = 20, seed: int = 42) -> DataFrame:
    """Pose of the template by matched point features and RANSAC, then closest points and planes.

    The first try is rigid; up to ``retries`` more allow scaling, with other seeds,
    until the share of points with one of the other shape within ``limit``, the mean
    of both ways, reaches ``fitness``. The best try counts; it is refined point to
    plane, which stays where that share or the distances get better. Where a try goes through all
    triples of matches, seeds make no difference and one try with scaling is all.
    """
    _, tp = template_arrays(template)
    tf = kernels.point_features(tp, kernels.normals(tp, k), k)

    def score(p, placed):
        there, back = (kernels.nearest(a, b, 1)[1] for a, b in ((placed, p), (p, placed)))
        return (float((there <= limit**2).mean()) + float((back <= limit**2).mean())) / 2, -float(np.sqrt(there.mean()))

    def work(index, p):
        try:
            if not np.isfinite(p).all():
                raise ValueError("points are not finite")
            pn = kernels.normals(p, k)
            pf = kernels.point_features(p, pn, k)
            match = ((tf[:, None] - pf[None]) ** 2).sum(-1)
            pairs = np.stack([np.arange(len(tp)), match.argmin(1)], 1)
            best = None
            tries = min(retries, 1) if comb(len(pairs), 3) <= iterations else retries
            for n in range(1 + tries):
                s, r, t, _ = kernels.ransac(tp, p, pairs, limit, iterations, scaling=n > 0, seed=seed + n)
                s2, r2, t2, _ = kernels.icp(s * tp @ r.T + t, p)
                got = (*score(p, s2 * (s * tp @ r.T + t) @ r2.T + t2), s2 * (s * tp @ r.T + t) @ r2.T + t2)
                best = got if best is None or got[:2] > best[:2] else best
                if best[0] >= fitness:
                    break
            onto = kernels.plane_icp(best[2], p, pn, limit)
            _, rmse, placed = max(best, (*score(p, onto), onto), key=lambda b: b[:2])
            s, r, t = kernels.similarity_fit(tp, placed)
            values = [s, *r.ravel(), *t, -rmse, None]
        except (ValueError, np.linalg.LinAlgError) as e:
            values = [*[None] * 14, str(e)]
        return {f.split()[0]: [v] for f, v in zip(POSE.split(", ")[1:], values, strict=True)}

    return per_specimen(points, work, POSE)


def rotations(count: int, seed: int = 0) -> np.ndarray:
    """The identity and ``count`` - 1 seeded rotations, even over all of them."""
    q = np.random.default_rng(seed).normal(size=(count, 4))
    q[0] = (1, 0, 0, 0)
    w, x, y, z = (q / np.linalg.norm(q, axis=1, keepdims=True)).T
    return np.stack([1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), 2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w), 2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)], -1).reshape(-1, 3, 3)


def pose_search(points: DataFrame, template: DataFrame, *, hypotheses: int = 193, rounds: int = 30, temperature: float = 1.0, seed: int = 0, block: int = 16, small: int = 1_024) -> DataFrame:
    """Best of many starting rotations for each specimen, with how sure that is.

    Every (specimen, ``block`` of rotations) is a row of its own and each rotation is
    refined by itself, so one large specimen's hypotheses run side by side; scores meet
    in one aggregate. All rotations of a specimen of up to ``small`` points, which take
    milliseconds, are one row. No hypothesis is given up before its ``rounds``. A score
    is minus the mean squared distance over the template's own scale; ``margin``
    is the gap to the second best, ``entropy`` that of the softmax over scores.
    """
    _, tp = template_arrays(template)
    turns, spread = rotations(hypotheses, seed), float(((tp - tp.mean(0)) ** 2).sum(1).mean())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = list(batch.itertuples(index=False))
            many = max(1, REFINED // max(1, max((row.wide for row in rows), default=1) * len(tp)))
            for some in (rows[at : at + many] for at in range(0, len(rows), many)):
                shapes_ = [np.stack([row.x, row.y, row.z], 1) for row in some]
                parts = [np.arange(row.part * row.wide, min((row.part + 1) * row.wide, hypotheses)) for row in some]
                starts = np.concatenate([(tp - tp.mean(0)) @ np.swapaxes(turns[h], 1, 2) + p.mean(0) for h, p in zip(parts, shapes_, strict=True)])
                placed = kernels.icp_shapes(starts, np.repeat(np.arange(len(some)), [len(h) for h in parts]), shapes_, rounds)
                ends = np.cumsum([len(h) for h in parts])
                scores = [kernels.pose_scores(placed[i:j], p) / spread for i, j, p in zip(ends - [len(h) for h in parts], ends, shapes_, strict=True)]
                yield pd.DataFrame({"specimen_id": [row.specimen_id for row in some], "part": [row.part for row in some], "scores": scores})

    wide = F.when(F.size("i") <= small, hypotheses).otherwise(block)
    rows = shapes(points).withColumn("wide", wide).withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((hypotheses - 1) / F.col("wide")).cast("int"))))
    scores = rows.repartition(tasks(points), "specimen_id", "part").mapInPandas(run, "specimen_id long, part int, scores array<double>")
    top = scores.groupBy("specimen_id").agg(F.array_sort(F.collect_list(F.struct("part", "scores"))).alias("parts")).select("specimen_id", F.flatten("parts.scores").alias("all"))
    top = top.withColumn("best", F.array_max("all")).withColumn("two", F.slice(F.sort_array("all", asc=False), 1, 2))
    weights = F.transform("all", lambda s: F.exp((s - F.col("best")) / temperature))
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    entropy = -F.aggregate(weights, F.lit(0.0), lambda a, w: a + F.when(w > 0, w / total * F.log(w / total)).otherwise(0.0))
    return top.select("specimen_id", (F.array_position("all", F.col("best")) - 1).cast("int").alias("hypothesis"), F.col("best").alias("score"), (F.col("two")[0] - F.get("two", F.lit(1))).alias("margin"), entropy.alias("entropy"))


def _modes(modes: DataFrame, eigenvalues: DataFrame, landmarks: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and modes (k x m x 3) of a shape model, in order."""
    values = np.array([r["v"] for r in eigenvalues.orderBy("mode").limit(MOST_POINTS).collect()])
    return values, modes.toPandas().sort_values(["mode", "pidx"])[["x", "y", "z"]].to_numpy().reshape(len(values), landmarks, 3)


def fit_model(points: DataFrame, mean: DataFrame, modes: DataFrame, eigenvalues: DataFrame, share: float = 0.95, most: int = 10) -> DataFrame:
    """A shape model bent and posed onto each specimen without correspondence:
    fitted positions of the model's landmarks."""
    mi, mp = template_arrays(mean)
    values, table = _modes(modes, eigenvalues, len(mi))
    k = min(most, kernels.mode_count(values, share))

    def work(p):
        return [_placed(mi, kernels.sound(x)) for x in kernels.ssm_drift_many(mp, table[:k], values[:k], p)[0]]

    return per_group(points, work, POINTS, len(mi))


def dense_correspondence(points: DataFrame, landmarks: list[int], base: DataFrame) -> DataFrame:
    """For each vertex of ``base`` (one shape) the specimen's vertex that lies nearest
    after a spline takes the specimen's landmarks to the base's."""
    bi, bp = template_arrays(base)
    fixed = np.isin(bi, landmarks)

    def work(index, p):
        at, to = np.isin(index, bi[fixed]), np.isin(bi, index) & fixed
        w, a = kernels.tps_fit(p[at], bp[to])
        near, d2 = kernels.nearest(bp, kernels.tps_apply(p, p[at], w, a), 1)
        return {"pidx": bi.astype(np.int32), "vid": index[near[:, 0]], "d2": d2[:, 0]}

    return per_specimen(points, work, "specimen_id long, pidx int, vid long, d2 double")


def heat_signatures(points: DataFrame, faces: DataFrame, times: int = 4) -> DataFrame:
    """Heat kernel signature of each landmark: fidx is the time scale."""
    f = faces.select("a", "b", "c").toPandas().to_numpy()  # one topology

    def work(index, p):
        v = kernels.heat_signature(p, np.searchsorted(index, f), times)
        return {"pidx": np.repeat(index, times).astype(np.int32), "fidx": np.tile(np.arange(times), len(index)), "v": v.ravel()}

    return per_specimen(points, work, "specimen_id long, pidx int, fidx int, v double")


def project(points: DataFrame, onto: DataFrame, **how) -> DataFrame:
    """Landmarks moved coherently to their closest surface points (specimen_id, pidx, x, y, z)."""
    near = onto.select("specimen_id", F.col("pidx").cast("int").alias("pidx"), *(F.col(c).alias(f"s{c}") for c in "xyz"))
    rows = points.join(near, ["specimen_id", "pidx"]).groupBy("specimen_id").agg(F.array_sort(F.collect_list(F.struct("pidx", "x", "y", "z", "sx", "sy", "sz"))).alias("m"))
    names, many = [f.split()[0] for f in POINTS.split(", ")], 256  # specimens whose results are held

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for row in batch.itertuples(index=False):
                m = np.array([[r[k] for k in ("pidx", "x", "y", "z", "sx", "sy", "sz")] for r in row.m], float)
                parts.append((row.specimen_id, _placed(m[:, 0], kernels.coherent_projection(m[:, 1:4], m[:, 4:7], **how))))
                if len(parts) >= many:
                    yield _rows(names, parts)
                    parts = []
            if parts:
                yield _rows(names, parts)

    return rows.mapInPandas(run, POINTS)
