"""Which shape of a model is the best template for each specimen.

Candidates are coefficients of the model in standard deviations: few, the same for
every specimen, and sent to the tasks. A large specimen's candidates are dealt out in
blocks, so that a hard specimen is no long task; only scores are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels
from .neighbors import FEW, shapes, tasks
from .registration import _modes, rotations, template_arrays


@dataclass(frozen=True)
class SearchSettings:
    """What a search tries; values out of range are an error when it is made."""

    modes: int = 10
    span: float = 2.5  # standard deviations
    candidates: int = 192  # beside those on the axes
    beam: int = 24
    keep: int = 12
    hypotheses: int = 193  # starting rotations of the mean
    finalists: int = 12  # of them, those that candidates start from; far from the mean more help
    rounds: int = 30
    points: int = 2_000  # of a specimen and of a candidate, spread evenly
    coarse: int = 400
    limit: float = 0.12  # inliers, as a share of the mean's diagonal
    w_rmse: float = 0.6
    strength: float = 0.1
    good_fit: float = 0.82
    good_rmse: float = 0.025
    margin: float = 1e-5
    evaluations: int = 240  # around the best candidate
    seed: int = 0

    def __post_init__(self):
        whole = ("modes", "candidates", "beam", "keep", "hypotheses", "finalists", "rounds", "points", "coarse")
        bad = [n for n in whole if getattr(self, n) < 1]
        bad += [n for n in ("span", "limit") if not 0 < getattr(self, n) < float("inf")]
        bad += [n for n in ("w_rmse", "strength", "margin", "good_rmse", "evaluations") if not getattr(self, n) >= 0]
        if self.keep > self.beam:
            bad.append("keep")
        if not 0 <= self.good_fit <= 1:
            bad.append("good_fit")
        if bad:
            raise ValueError(f"settings out of range: {', '.join(bad)}")


def candidate_pool(modes: int, settings: SearchSettings) -> np.ndarray:
    """Distinct coefficients (n x modes), in order: even at random within the span, and half and whole spans on each axis."""
    some = np.random.default_rng(settings.seed).uniform(-settings.span, settings.span, (settings.candidates, modes))
    axes = np.concatenate([np.eye(modes) * settings.span * s for s in (1.0, 0.5, -1.0, -0.5)])
    return np.unique(np.round(np.concatenate([some, axes]), 6), axis=0)


def diverse(pool: np.ndarray, count: int) -> np.ndarray:
    """``count`` candidates that lie far from each other, over columns of equal spread."""
    level = (pool - pool.mean(0)) / (pool.std(0) + 1e-9)
    return pool[kernels.farthest_points(level, count)]


def worth_scoring(scores: DataFrame, best: DataFrame, w_rmse: float, margin: float, key: str = "specimen_id") -> DataFrame:
    """Candidates (key, ..., penalty) that may still beat ``best`` (key, best): a perfect
    fit less the penalty has to reach it, with a headroom of 0.05 for the error's weight."""
    return scores.join(best, key).where(F.lit(1.0) - F.col("penalty") > F.col("best") - F.lit(0.05 * w_rmse + margin))


def beam(scores: DataFrame, keep: int, key: str = "specimen_id", candidate: str = "candidate") -> DataFrame:
    """The ``keep`` best candidates of each specimen with their rank; ties to the lower candidate."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), candidate))
    return scores.withColumn("rank", rank).where(F.col("rank") <= keep)


def _quality(placed: np.ndarray, of: np.ndarray, targets: list[np.ndarray], limit: float, diagonal: float) -> tuple[np.ndarray, np.ndarray]:
    """Share of each placed shape near its specimen (``of`` says in order which), and those points' error over the diagonal."""
    d2 = ((placed - kernels.closest(targets)(placed, of)) ** 2).sum(2)
    near = d2 <= limit * limit
    return near.mean(1), np.sqrt((d2 * near).sum(1) / np.maximum(near.sum(1), 1)) / diagonal


#: Points of all positions of all specimens that are refined together.
TOGETHER = 1 << 17


def _some(batch: pd.DataFrame, points: int) -> Iterator[list]:
    """Rows of a batch, a few at a time, each of which has positions of so many ``points``."""
    rows, many = list(batch.itertuples(index=False)), max(1, TOGETHER // max(1, points))
    yield from (rows[at : at + many] for at in range(0, len(rows), many))


def _level(row, diagonal: float, points: int) -> np.ndarray:
    """A specimen's points about 0, as large as the mean."""
    p = np.stack([row.x, row.y, row.z], 1)
    if not np.isfinite(p).all():
        raise ValueError("points are not finite")
    p = p[kernels.farthest_points(p, points)]
    level = (p - p.mean(0)) * diagonal / max(np.linalg.norm(np.ptp(p, axis=0)), 1e-300)
    if not np.isfinite(level).all():
        raise ValueError("points are too large")
    return level


def search(points: DataFrame, mean: DataFrame, modes: DataFrame, eigenvalues: DataFrame, settings: SearchSettings = SearchSettings()) -> DataFrame:
    """Coefficients of the template that each specimen is best registered to.

    Specimens and candidates are compared at the mean's size, whatever their own.
    The mean is placed from many rotations. Where that is good already, it stays
    (``baseline``). Otherwise widely spread candidates start from its best poses and
    are scored on few points, those that cannot win unscored; the best ones are
    scored on all points beside the mean, and steps along single modes go on from
    the best of these, halved where none gains. Score: inliers less weighted error less a penalty on
    the coefficients, which are over their eigenvalues and so in the model's unit of
    length: shapes of a diagonal near 20 leave it small. A specimen with points that are not finite has a row whose
    decision is ``failed`` and whose other values are null. An empty table gives no rows.
    """
    s = settings
    mi, mp = template_arrays(mean)
    values, table = _modes(modes, eigenvalues, len(mi))
    k = min(s.modes, len(values))
    few = kernels.farthest_points(mp, s.points)
    base, move = mp[few] - mp[few].mean(0), table[:k][:, few] * np.sqrt(values[:k])[:, None, None]
    diagonal = float(np.linalg.norm(np.ptp(mp, axis=0)))
    limit, turns = s.limit * diagonal, rotations(s.hypotheses, s.seed)
    pool = diverse(candidate_pool(k, s), s.beam) if k else np.zeros((0, 0))
    stiff = 1.0 / (values[:k] + 1e-12)
    weight = min(s.strength / max(k, 1), 0.25 / (max(k, 1) * s.span**2))
    penalty = weight * (pool * pool * stiff).sum(1)

    def shape(b: np.ndarray) -> np.ndarray:
        made = base + np.tensordot(b, move, 1)
        made = made - made.mean(-2, keepdims=True)
        return made * (diagonal / np.maximum(np.linalg.norm(np.ptp(made, axis=-2), axis=-1), 1e-300))[..., None, None]

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = kernels.farthest_points(base, s.coarse)
        starts = base[c] @ np.swapaxes(turns, 1, 2)
        for batch in batches:
            for rows in _some(batch, starts.size // 3):
                out, own = [(row.specimen_id, None, None, None, None, False) for row in rows], {}
                for n, row in enumerate(rows):
                    with suppress(ValueError):
                        own[n] = _level(row, diagonal, s.points)
                ps, g = list(own.values()), len(own)
                if g:
                    qs = [p[kernels.farthest_points(p, s.coarse)] for p in ps]
                    placed = kernels.icp_shapes(np.tile(starts, (g, 1, 1)), np.repeat(np.arange(g), len(starts)), qs, s.rounds).reshape(g, *starts.shape)
                    best = np.stack([np.argsort(-kernels.pose_scores(x, q), kind="stable")[: s.finalists] for x, q in zip(placed, qs, strict=True)])
                    found = np.take_along_axis(placed, best[:, :, None, None], 1).reshape(-1, *starts.shape[1:])
                    r, of = kernels.rigid_fits(np.broadcast_to(base[c], found.shape), found), np.repeat(np.arange(g), best.shape[1])
                    fit, rmse = (v.reshape(g, -1) for v in _quality(kernels.icp_shapes(base @ np.swapaxes(r, 1, 2), of, ps, s.rounds), of, ps, limit, diagonal))
                    at = (fit - s.w_rmse * rmse).argmax(1)
                    for n, k, turn, f, e in zip(own, at, r.reshape(g, -1), fit, rmse, strict=True):
                        out[n] = (rows[n].specimen_id, turn, f[k] - s.w_rmse * e[k], f[k], e[k], True)
                yield pd.DataFrame(out, columns=["specimen_id", "r", "best", "fit", "rmse", "sound"])

    def score(ps: list[np.ndarray], of: np.ndarray, r: np.ndarray, b: np.ndarray, few: int) -> tuple[np.ndarray, ...]:
        """Best of its specimen's starting poses (specimens x poses x 3 x 3) for each of the coefficients, which
        are of the specimens ``of``, in order: score, fit, error, which pose."""
        c = kernels.farthest_points(base, few)
        starts = (shape(b)[:, None, c] @ np.swapaxes(r[of], 2, 3)).reshape(-1, len(c), 3)
        each = np.repeat(of, r.shape[1])
        fit, rmse = _quality(kernels.icp_shapes(starts, each, ps, s.rounds), each, ps, limit, diagonal)
        fit, rmse = fit.reshape(len(b), -1), rmse.reshape(len(b), -1)
        at = np.round(fit - s.w_rmse * rmse, 9).argmax(1)[:, None]  # poses that end alike are equal, whatever the rounding
        fit, rmse = (np.take_along_axis(v, at, 1)[:, 0] for v in (fit, rmse))
        return np.round(fit - s.w_rmse * rmse - weight * (b * b * stiff).sum(1), 9), fit, rmse, at[:, 0]

    def poses(rows: list) -> np.ndarray:
        return np.stack([row.r for row in rows]).reshape(len(rows), -1, 3, 3)

    def rough(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows in _some(batch, int(batch["own"].map(len).max()) * s.finalists * min(s.coarse, len(base))):
                of, c = np.repeat(np.arange(len(rows)), [len(row.own) for row in rows]), np.concatenate([row.own for row in rows])
                got = score([_level(row, diagonal, s.coarse) for row in rows], of, poses(rows), pool[c], s.coarse)[0]
                yield pd.DataFrame({"specimen_id": np.array([row.specimen_id for row in rows])[of], "candidate": c, "score": got})

    def fine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows in _some(batch, (int(batch["own"].map(len).max()) + 1) * s.finalists * len(base)):
                ps, r = [_level(row, diagonal, s.points) for row in rows], poses(rows)
                size = np.array([len(row.own) + 1 for row in rows])
                b = np.concatenate([v for row in rows for v in (pool[row.own], np.zeros((1, k)))])
                got, fit, rmse, pose = score(ps, np.repeat(np.arange(len(rows)), size), r, b, s.points)
                ends = np.cumsum(size)
                at = np.array([i + got[i:j].argmax() for i, j in zip(ends - size, ends, strict=True)])
                r = r[np.arange(len(rows)), pose[at]][:, None]  # steps stay in the pose of the best
                best, b, step = np.stack([got[at], fit[at], rmse[at]], 1), b[at], np.full(len(rows), s.span / 4)
                for _ in range(s.evaluations // (2 * max(k, 1))):
                    live = np.flatnonzero(step >= 1e-3)
                    if not len(live):
                        break
                    near = np.clip(b[live][:, None] + np.concatenate([np.eye(k), -np.eye(k)]) * step[live][:, None, None], -s.span, s.span)
                    new = np.stack(score([ps[n] for n in live], np.repeat(np.arange(len(live)), 2 * k), r[live], near.reshape(-1, k), s.points)[:3], 1).reshape(len(live), 2 * k, 3)
                    at = new[:, :, 0].argmax(1)
                    new, near = new[np.arange(len(live)), at], near[np.arange(len(live)), at]
                    better = new[:, 0] > best[live, 0]
                    best[live[better]], b[live[better]] = new[better], near[better]
                    step[live[~better]] /= 2
                yield pd.DataFrame({"specimen_id": [row.specimen_id for row in rows], "score": best[:, 0], "fit": best[:, 1], "rmse": best[:, 2], "b": list(b)})

    # By a hash, as a shuffle by the key that a join has used is left out of the plan, whose few bytes then are few tasks.
    deal = lambda df, *by: df.repartition(tasks(points), F.xxhash64("specimen_id", *by))
    cloud = shapes(points.repartition(tasks(points), "specimen_id"))
    start = cloud.mapInPandas(first, "specimen_id long, r array<double>, best double, fit double, rmse double, sound boolean").persist()
    good = (F.col("fit") >= s.good_fit) & (F.col("rmse") <= s.good_rmse)
    rows = points.sparkSession.createDataFrame([(n, float(v)) for n, v in enumerate(penalty)], "candidate int, penalty double")
    poor = start.where("sound").where(~good)
    asked = worth_scoring(poor.select("specimen_id").crossJoin(F.broadcast(rows)), poor.select("specimen_id", "best"), s.w_rmse, s.margin)  # at most ``beam`` rows a specimen
    block = lambda df: df.groupBy("specimen_id").agg(F.array_sort(F.collect_list("candidate")).alias("own"))
    carried = cloud.join(poor.select("specimen_id", "r"), "specimen_id")
    # four rows of a large specimen; of small ones, whose arrays would only be sent more often, one
    parts = F.when(F.size("i") > FEW, F.array(*(F.expr(f"filter(own, c -> c % 4 = {k})") for k in range(4)))).otherwise(F.array("own"))
    dealt = deal(carried.join(block(asked), "specimen_id").withColumn("own", F.explode(parts)).where(F.size("own") > 0), "own")
    scored = dealt.mapInPandas(rough, "specimen_id long, candidate int, score double")
    found = deal(carried.join(block(beam(scored, s.keep)), "specimen_id")).mapInPandas(fine, "specimen_id long, score double, fit double, rmse double, b array<double>")
    found = found.select("specimen_id", F.struct("score", "fit", "rmse", "b").alias("new"))
    both = start.join(found, "specimen_id", "left")
    better = F.col("new.score") > F.col("best")
    zero = F.array_repeat(F.lit(0.0), k)
    pick = lambda n, old: F.when(better, F.col(f"new.{n}")).otherwise(old)
    decision = F.when(~F.col("sound"), "failed").when(better, "searched").when(good, "baseline").otherwise("baseline_kept")
    out = both.select("specimen_id", decision.alias("decision"), pick("score", F.col("best")).alias("score"), pick("fit", F.col("fit")).alias("fit"), pick("rmse", F.col("rmse")).alias("rmse"), F.when(F.col("sound"), pick("b", zero)).alias("b"))
    return out.withColumn("norm_b", F.sqrt(F.aggregate("b", F.lit(0.0), lambda a, v: a + v * v)))
