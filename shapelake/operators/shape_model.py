"""Statistical shape models: building, choosing modes, sampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from .neighbors import shapes
from .points import XYZ, bounds, mean_shape, transform
from .procrustes import MOST_POINTS


def covariance(points: DataFrame) -> DataFrame:
    """Covariance of the coordinates (axis i <= j) over specimens, with n - 1.

    A task multiplies its specimens' matrix with itself and gives one row for each
    pair of axes, however many specimens it has; only these are shuffled. A pair's
    covariance is over the specimens that have both landmarks; null for one specimen.
    """
    part = shapes(points).mapInPandas(_products, "i int, j int, n long, si double, sj double, m double")
    n, si, sj = F.sum("n"), F.sum("si"), F.sum("sj")
    between = F.sum(F.col("si") * F.col("sj") / F.col("n")) - si * sj / n
    return part.groupBy("i", "j").agg(F.when(n > 1, (F.sum("m") + between) / F.nullif(n - 1, F.lit(0))).alias("cov"))


def _products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a task's specimens with equal landmarks: number, sums and centred sums of products for each pair of axes."""
    # landmarks -> number, sum and centred products; batches are added as in Chan et al. 1983
    held: dict[bytes, tuple[int, np.ndarray, np.ndarray]] = {}
    for batch in batches:
        alike: dict[bytes, list] = {}
        for row in batch.itertuples(index=False):
            alike.setdefault(np.asarray(row.i, np.int64).tobytes(), []).append(np.stack([row.x, row.y, row.z], 1).ravel())
        for key, many in alike.items():
            x = np.stack(many)
            n, total, centred = len(x), x.sum(0), x - x.mean(0)
            m = centred.T @ centred
            if key in held:
                n0, total0, m0 = held[key]
                apart = total / n - total0 / n0
                n, total, m = n + n0, total + total0, m + m0 + np.outer(apart, apart) * (n * n0 / (n + n0))
            held[key] = n, total, m
    for key, (n, total, m) in held.items():
        axis = (np.frombuffer(key, np.int64)[:, None] * 3 + np.arange(3)).ravel().astype(np.int32)
        rows = max(1, (1 << 18) // len(axis))  # so many rows of the matrix at a time
        for at in range(0, len(axis), rows):
            i, j = np.nonzero(np.arange(at, min(at + rows, len(axis)))[:, None] <= np.arange(len(axis)))
            i += at
            yield pd.DataFrame({"i": axis[i], "j": axis[j], "n": n, "si": total[i], "sj": total[j], "m": m[i, j]})


def total_variance(points: DataFrame, *by: str) -> DataFrame:
    """Sum of the sample variances of all coordinates."""
    per = points.groupBy(*by, "pidx").agg(*(F.coalesce(F.var_samp(c), F.lit(0.0)).alias(f"v{c}") for c in XYZ))
    return per.groupBy(*by).agg(F.sum(F.col("vx") + F.col("vy") + F.col("vz")).alias("variance"))


def _centred(points: DataFrame) -> DataFrame:
    mean = mean_shape(points).select("pidx", *(F.col(c).alias(f"m{c}") for c in XYZ))
    if points.select("pidx").distinct().count() <= MOST_POINTS:  # else few landmarks would be the few keys of a shuffle
        mean = F.broadcast(mean)
    return points.join(mean, "pidx").select("specimen_id", F.col("pidx").cast("int").alias("pidx"), *((F.col(c) - F.col(f"m{c}")).alias(c) for c in XYZ))


def _alike(points: DataFrame, most: int | None) -> tuple[DataFrame, int]:
    """(specimen_id, n) and how many specimens there are; it is an error if they are over ``most`` or lack landmarks."""
    sizes = points.groupBy("specimen_id").agg(F.count(F.lit(1)).alias("n"))
    n, low, high = sizes.agg(F.count(F.lit(1)), F.min("n"), F.max("n")).first()
    if most is not None and n > most:
        raise ValueError(f"{n} specimens; at most {most} are compared with each other")
    if n and (low != high or points.select("pidx").distinct().count() != low):
        raise ValueError("specimens do not all have the same landmarks")
    return sizes, n


def _numbers(points: DataFrame, most: int) -> DataFrame:
    """(specimen_id, s): specimens counted from 0."""
    sizes, _ = _alike(points, most)
    return sizes.select("specimen_id", (F.row_number().over(Window.orderBy("specimen_id")) - 1).cast("int").alias("s"))  # at most ``most`` rows


def _tiles(rows: DataFrame, specimens: int, landmarks: int) -> DataFrame:
    """Rows (s, pidx, x, y, z) as tiles of at most ``specimens`` x ``landmarks``: block, tile and arrays."""
    keys = (F.floor(F.col("pidx") / landmarks).cast("int").alias("block"), F.floor(F.col("s") / specimens).cast("int").alias("tile"))
    tile = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("s", "pidx", "x", "y", "z"))).alias("t"))
    return tile.select("block", "tile", *(F.col(f"t.{c}").alias(c) for c in ("s", "pidx", "x", "y", "z")))


def _matrix(s, x, y, z) -> tuple[np.ndarray, np.ndarray]:
    """Specimens of a tile and their coordinates in it, one row each."""
    own, starts = np.unique(np.asarray(s), return_index=True)
    return own, np.stack([x, y, z], 1).reshape(len(starts), -1)


def gram(points: DataFrame, *, most: int | None = None, specimens: int | None = None, landmarks: int = 1_024) -> DataFrame:
    """Products (si, sj, v; si <= sj) of the specimens' differences from the mean shape.

    Coordinates are cut into tiles of about ``specimens`` x ``landmarks`` (an 8th of
    the specimens, 256 to 4096, if not given). Tiles are written once, dealt out by range, and every two
    of them are read by two tasks of their own (a product of the tiles with themselves), so that what is
    on disk grows with the specimens alone. All blocks of landmarks of a pair are added up in
    its task, so the products themselves are not shuffled. A task holds two
    tiles and one product, whatever the numbers of landmarks and specimens. All specimens
    must have the same landmarks and, if given, be at most ``most``.
    """
    _, n = _alike(points, most)
    specimens = specimens or min(4096, max(256, -(-n // 8)))
    count = max(1, -(-n // specimens))
    keys = (F.floor(F.col("pidx") / landmarks).cast("int").alias("block"), F.pmod(F.xxhash64("specimen_id"), F.lit(count)).cast("int").alias("tile"))
    tiles = _centred(points).where("specimen_id IS NOT NULL").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("specimen_id", "pidx", *XYZ))).alias("t"))
    tiles = tiles.select("tile", "block", F.array_distinct("t.specimen_id").alias("ids"), *(F.col(f"t.{c}").alias(c) for c in XYZ))
    tiles = tiles.repartitionByRange(count, "tile").sortWithinPartitions("tile", "block")
    other = tiles.select(*(F.col(c).alias(f"o{c}") for c in tiles.columns)).hint("shuffle_replicate_nl")
    pairs = tiles.join(other, F.col("block") - F.col("oblock") == 0)  # an equality of columns would be a shuffle by block

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tile, totals = None, {}  # the open tile, and its products with others as far as they are added up: (ids, ids, products)
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.tile != tile:
                    for total in totals.values():
                        yield from _pairs(*total)
                    tile, totals = row.tile, {}
                (a, x), (b, y) = ((np.asarray(ids), np.stack(c, 1).reshape(len(ids), -1)) for ids, c in ((row.ids, (row.x, row.y, row.z)), (row.oids, (row.ox, row.oy, row.oz))))
                if row.tile < row.otile:  # two tiles meet twice, so each time with half of the lower one
                    a, x = a[: len(a) // 2], x[: len(a) // 2]
                elif row.tile > row.otile:
                    a, x, b, y = b[len(b) // 2 :], y[len(b) // 2 :], a, x
                if row.otile in totals:
                    totals[row.otile][2] += x @ y.T
                else:
                    totals[row.otile] = [a, b, x @ y.T]
        for total in totals.values():
            yield from _pairs(*total)

    return pairs.mapInPandas(run, "si long, sj long, v double")


def _pairs(a: np.ndarray, b: np.ndarray, m: np.ndarray, rows: int = 1 << 19) -> Iterator[pd.DataFrame]:
    """Products of two tiles, each pair of specimens once, lower id first, so many rows at a time."""
    step, same = max(1, rows // max(1, len(b))), np.array_equal(a, b)
    for at in range(0, len(a), step):
        i, v = np.repeat(a[at : at + step], len(b)), m[at : at + step].ravel()
        j = np.tile(b, len(a[at : at + step]))
        if same:
            keep = i <= j
            i, j, v = i[keep], j[keep], v[keep]
        yield pd.DataFrame({"si": np.minimum(i, j), "sj": np.maximum(i, j), "v": v})


#: Landmarks of all modes that are sent to tasks as one matrix.
MOST_CELLS = 500_000
MODES = "mode int, pidx int, x double, y double, z double"


def _by_gram(points: DataFrame, most: int, specimens: int = 256, landmarks: int = 1_024) -> tuple[DataFrame, DataFrame]:
    """Modes and eigenvalues by the eigenvectors of :func:`gram`: mode k is the sum over
    specimens of u_sk times their difference from the mean, of length 1.

    Of more than ``most`` specimens the products' eigenvectors are made where the
    specimens are (:func:`_by_wide_gram`), and no row for a pair of them."""
    spark = points.sparkSession
    _, many = _alike(points, None)
    if many > most:
        return _by_wide_gram(points, many, most)
    numbers = _numbers(points, most)
    cells = gram(points, most=most, specimens=specimens, landmarks=landmarks).toPandas()  # at most most^2 / 2 rows
    ids = np.unique(np.concatenate([cells["si"].to_numpy(np.int64), cells["sj"].to_numpy(np.int64)]))
    n = len(ids)
    matrix = np.zeros((n, n))
    i, j = np.searchsorted(ids, cells["si"]), np.searchsorted(ids, cells["sj"])
    matrix[i, j] = matrix[j, i] = cells["v"]
    values, vectors = np.linalg.eigh(matrix) if n > 1 else (np.zeros(0), np.zeros((0, 0)))
    keep = [k for k in np.argsort(-values, kind="stable") if values[k] > 1e-10 * max(values.max(), 1e-30)]
    u = vectors[:, keep] / np.sqrt(values[keep]) if keep else np.zeros((n, 0))
    tiles = _tiles(_centred(points).join(F.broadcast(numbers), "specimen_id"), specimens, landmarks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                own, x = _matrix(row.s, row.x, row.y, row.z)
                part = (u[own].T @ x).reshape(u.shape[1], x.shape[1] // 3, 3)
                marks = np.asarray(row.pidx)[: part.shape[1]]
                for k in range(len(part)):
                    yield pd.DataFrame({"mode": np.int32(k), "pidx": marks, "x": part[k, :, 0], "y": part[k, :, 1], "z": part[k, :, 2]})

    modes = _signed(tiles.mapInPandas(run, MODES).groupBy("mode", "pidx").agg(*(F.sum(c).alias(c) for c in XYZ)))
    return modes, spark.createDataFrame([(m, float(values[k] / (n - 1))) for m, k in enumerate(keep)], "mode int, v double")


def _signed(modes: DataFrame) -> DataFrame:
    # The sign that makes a mode's largest coordinate positive; of equal ones the first landmark's.
    sides = F.array(*(F.struct(F.round(F.abs(c), 9).alias("size"), (-F.col("pidx")).alias("first"), F.lit(-k).alias("axis"), F.signum(c).alias("sign")) for k, c in enumerate(XYZ)))
    sign = modes.groupBy("mode").agg(F.max(F.array_max(sides)).alias("most")).select("mode", F.when(F.col("most.sign") < 0, -1.0).otherwise(1.0).alias("sign"))
    return modes.join(sign, "mode").select("mode", "pidx", *((F.col(c) * F.col("sign")).alias(c) for c in XYZ))


def _along(points: DataFrame, index: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """(mode, pidx, x, y, z): for each column of ``vectors`` (coordinates x modes, landmarks
    ``index``) the sum over specimens of their difference from the mean times its product with
    the column. A task gives one row for each mode and landmark; absent landmarks count nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((vectors.shape[1], len(index) * 3))
        for batch in batches:
            for at in range(0, len(batch), rows := max(1, (1 << 21) // max(1, len(index)))):
                part = batch.iloc[at : at + rows]
                x = np.zeros((len(part), len(index), 3))
                for s, row in enumerate(part.itertuples(index=False)):
                    x[s, np.searchsorted(index, np.asarray(row.i))] = np.stack([row.x, row.y, row.z], 1)
                x = x.reshape(len(part), -1)
                total += (x @ vectors).T @ x
        total = total.reshape(len(total), -1, 3)
        for k, own in enumerate(total):
            yield pd.DataFrame({"mode": np.int32(k), "pidx": index.astype(np.int32), "x": own[:, 0], "y": own[:, 1], "z": own[:, 2]})

    return shapes(_centred(points)).mapInPandas(run, MODES).groupBy("mode", "pidx").agg(*(F.sum(c).alias(c) for c in XYZ))


def _by_wide_gram(points: DataFrame, n: int, most: int) -> tuple[DataFrame, DataFrame]:
    """:func:`_by_gram` of ``n`` specimens, more than there are coordinates.

    X X' has no more non-zero eigenvalues than X has columns: those of X' X, and its
    eigenvectors are u = X v / sqrt(value). Each specimen's part of u is made in the task
    that has the specimen, and mode k is again the sum of u_sk times the specimen."""
    index = np.array(sorted(r["pidx"] for r in points.select("pidx").distinct().limit(most + 1).collect()), np.int64)
    if 3 * len(index) > most:
        raise ValueError(f"{n} specimens of {len(index)} landmarks or more; at most {most} specimens or coordinates are decomposed on the driver")
    cells = covariance(points).toPandas()
    place = np.full(3 * int(index.max()) + 3, -1)
    place[(index[:, None] * 3 + np.arange(3)).ravel()] = np.arange(3 * len(index))
    matrix = np.zeros((3 * len(index),) * 2)
    i, j = place[cells["i"]], place[cells["j"]]
    matrix[i, j] = matrix[j, i] = cells["cov"]
    values, vectors = np.linalg.eigh(matrix)
    keep = [k for k in np.argsort(-values, kind="stable") if values[k] > 1e-10 * max(values.max(), 1e-30)]
    # u'u = 1 for value (n - 1) * cov, and the mode is X'u over its root once more
    modes = _signed(_along(points, index, vectors[:, keep] / (values[keep] * (n - 1))))
    return modes, points.sparkSession.createDataFrame([(m, float(values[k])) for m, k in enumerate(keep)], "mode int, v double")


def build(points: DataFrame, most: int = 5_000, branch: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mean (pidx, x, y, z), modes (mode, pidx, x, y, z) and eigenvalues (mode, v).

    With more than twice as many coordinates as specimens (or ``branch`` "gram") the
    specimens' products are decomposed (:func:`gram`), and modes are sums over
    specimens made by Spark; else ("covariance") the coordinates' covariance. Only
    the smaller matrix, of at most ``most`` rows, reaches the driver. Both give the
    same modes. Fewer than two specimens, or no variance, give no modes.
    """
    spark = points.sparkSession
    mean = mean_shape(points)
    last, specimens = points.agg(F.max("pidx"), F.count_distinct("specimen_id")).first()
    size = 0 if last is None else 3 * int(last) + 3
    if branch is None:
        branch = "gram" if size > 2 * specimens else "covariance"
    if branch == "gram":
        return mean, *_by_gram(points, most)
    if size > most:
        raise ValueError(f"{size} coordinates; at most {most} are decomposed on the driver")
    cells = covariance(points).toPandas()
    matrix = np.zeros((size, size))
    matrix[cells["i"], cells["j"]] = matrix[cells["j"], cells["i"]] = cells["cov"]
    values, vectors = np.linalg.eigh(np.nan_to_num(matrix)) if size else (np.zeros(0), np.zeros((0, 0)))
    keep = [k for k in np.argsort(-values, kind="stable") if values[k] > 1e-10 * max(values.max(), 1e-30)]
    rows, eig = [], []
    for mode, k in enumerate(keep):
        v = vectors[:, k] * (np.sign(vectors[np.argmax(np.round(np.abs(vectors[:, k]), 9)), k]) or 1)
        eig.append((mode, float(values[k])))
        rows += [(mode, p, *(float(x) for x in v[3 * p : 3 * p + 3])) for p in range(size // 3)]
    return mean, spark.createDataFrame(rows, MODES), spark.createDataFrame(eig, "mode int, v double")


def residuals(points: DataFrame, modes: DataFrame, eigenvalues: DataFrame) -> DataFrame:
    """(mode, residual, norm): how far the covariance times each mode is from its
    eigenvalue times it, in the largest coordinate, and the mode's length.

    The covariance is never made: coefficients along the mode weigh the specimens."""
    n = points.select("specimen_id").distinct().count()
    got = modes.limit(MOST_CELLS + 1).toPandas()
    if len(got) <= MOST_CELLS:  # the modes go to the tasks, which give sums
        index, names = np.unique(got["pidx"].to_numpy(np.int64)), np.unique(got["mode"].to_numpy(np.int64))
        vectors = np.zeros((len(names), len(index), 3))
        vectors[np.searchsorted(names, got["mode"]), np.searchsorted(index, got["pidx"])] = got[list(XYZ)]
        here = points.where(F.col("pidx").isin(index.tolist())) if len(index) < 10_000 else points.join(modes.select("pidx").distinct(), "pidx", "left_semi")
        sums = _along(here, index, vectors.reshape(len(names), -1).T)
        named = points.sparkSession.createDataFrame([(k, int(m)) for k, m in enumerate(names)], "k int, name int")
        times = sums.join(F.broadcast(named), F.col("mode") == F.col("k")).select(F.col("name").alias("mode"), "pidx", *((F.col(c) / max(1, n - 1)).alias(f"c{c}") for c in XYZ))  # one row for each mode
    else:
        along = coefficients(points, mean_shape(points), modes)
        times = _centred(points).join(along, "specimen_id").groupBy("mode", "pidx").agg(*((F.sum(F.col("b") * F.col(c)) / max(1, n - 1)).alias(f"c{c}") for c in XYZ))
    both = modes.join(times, ["mode", "pidx"]).join(eigenvalues, "mode")
    off = F.greatest(*(F.abs(F.col(f"c{c}") - F.col("v") * F.col(c)) for c in XYZ))
    return both.groupBy("mode").agg(F.max(off).alias("residual"), F.sqrt(F.sum(g.dot(g.vector(), g.vector()))).alias("norm"))


def explained(eigenvalues: DataFrame) -> DataFrame:
    """Running share of the variance, largest eigenvalue first."""
    running = Window.orderBy(F.desc("v"), "mode").rowsBetween(Window.unboundedPreceding, 0)  # one row for each mode of a model
    total = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return eigenvalues.select("mode", "v", F.row_number().over(Window.orderBy(F.desc("v"), "mode")).alias("rank"), (F.sum("v").over(running) / F.sum("v").over(total)).alias("share"))


def mode_count(eigenvalues: DataFrame, share: float) -> DataFrame:
    """The fewest modes whose share reaches ``share``; all of them if none does."""
    e = explained(eigenvalues)
    return e.agg(F.coalesce(F.min(F.when(F.col("share") >= share, F.col("rank"))), F.max("rank")).alias("modes"))


def sample(mean: DataFrame, modes: DataFrame, weights: DataFrame, eigenvalues: DataFrame | None = None) -> DataFrame:
    """Shapes mean + sum of weight * mode for each ``sample`` of ``weights`` (sample, mode, b).

    With ``eigenvalues`` (floored at 1e-10) the weights are in standard deviations.
    """
    if eigenvalues is not None:
        weights = weights.join(eigenvalues, "mode").select("sample", "mode", (F.col("b") * F.sqrt(F.greatest(F.col("v"), F.lit(1e-10)))).alias("b"))
    move = weights.join(modes, "mode").groupBy("sample", "pidx").agg(*(F.sum(F.col("b") * F.col(c)).alias(f"d{c}") for c in XYZ))
    return move.join(mean, "pidx").select("sample", "pidx", *((F.col(c) + F.col(f"d{c}")).alias(c) for c in XYZ))


def validate(mean: DataFrame, modes: DataFrame, eigenvalues: DataFrame) -> None:
    """Raise unless all parts are finite, modes cover the mean's landmarks and eigenvalues are positive."""
    from .points import require_finite

    require_finite(mean)
    require_finite(modes)
    n = mean.count()
    if not modes.groupBy("mode").agg(F.countDistinct("pidx").alias("n")).where(F.col("n") != n).isEmpty() or not eigenvalues.where("NOT v > 0").isEmpty():
        raise ValueError("modes do not fit the mean, or eigenvalues are not positive")


def rotate(modes: DataFrame, rotation: list[list[float]]) -> DataFrame:
    """Modes turned with their shape: directions rotate, nothing is shifted."""
    return transform(modes, g.similarity_matrix(rotation, 1.0, [0.0, 0.0, 0.0]))


def coefficients(points: DataFrame, mean: DataFrame, modes: DataFrame) -> DataFrame:
    """(specimen_id, mode, b) of aligned specimens: their difference from the mean along each (unit) mode."""
    away = points.join(mean.select("pidx", *(F.col(c).alias(f"m{c}") for c in XYZ)), "pidx").select("specimen_id", "pidx", *((F.col(c) - F.col(f"m{c}")).alias(c) for c in XYZ))
    along = away.join(modes.select("mode", "pidx", *(F.col(c).alias(f"d{c}") for c in XYZ)), "pidx")
    return along.groupBy("specimen_id", "mode").agg(F.sum(g.dot(g.vector(), g.vector("d"))).alias("b"))


def diagnostics(points: DataFrame, mean: DataFrame, modes: DataFrame, eigenvalues: DataFrame) -> DataFrame:
    """How far each specimen lies from a model: the norm of its coefficients in standard
    deviations, the largest of them, and its box's diagonal over the mean's."""
    b = coefficients(points, mean, modes).join(eigenvalues, "mode").select("specimen_id", (F.col("b") / F.sqrt(F.greatest("v", F.lit(1e-10)))).alias("b"))
    far = b.groupBy("specimen_id").agg(F.sqrt(F.sum(F.col("b") * F.col("b"))).alias("coefficient_norm"), F.max(F.abs("b")).alias("largest"))
    sizes = bounds(points, "specimen_id").select("specimen_id", F.col("diagonal").alias("own"))
    ratio = sizes.crossJoin(bounds(mean).select("diagonal")).select("specimen_id", (F.col("own") / F.nullif("diagonal", F.lit(0.0))).alias("size_ratio"))  # the mean is one row
    return far.join(ratio, "specimen_id")
