"""Fast point feature histograms (Rusu 2009) as rows: of a specimen in a task, or joins for pairs, aggregates for histograms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from .neighbors import alike, arrays, larger, nearest_in, radius_neighbours

XYZ = ("x", "y", "z")
#: Cells of each of the three angles' histograms.
BINS = 11


def pair_angles(near: DataFrame, points: DataFrame) -> DataFrame:
    """Cells (c0, c1, c2) of the three angles of each pair of :func:`radius_neighbours`;
    ``points`` has unit normals (nx, ny, nz).

    The point whose normal lies closer to the line between the two is the one whose
    frame counts. Cells are 0 to 10; pairs at one place, or whose frame has no second
    axis, have all angles 0."""
    side = lambda letter, key: points.select("specimen_id", F.col("pidx").alias(key), *(F.col(c).alias(f"{letter}{c}") for c in XYZ), *(F.col(f"n{c}").alias(f"{letter}n{c}") for c in XYZ))
    rows = near.select("specimen_id", "qidx", "tidx", "d2").join(side("q", "qidx"), ["specimen_id", "qidx"]).join(side("t", "tidx"), ["specimen_id", "tidx"])
    rows = rows.withColumns({f"l{c}": F.col(f"t{c}") - F.col(f"q{c}") for c in XYZ}).withColumn("size", F.sqrt("d2"))
    one, two = (g.dot(g.vector(f"{s}n"), g.vector("l")) / F.nullif("size", F.lit(0.0)) for s in "qt")
    rows = rows.withColumn("a1", one).withColumn("a2", two).withColumn("swap", F.abs("a1") < F.abs("a2"))
    pick = lambda yes, no: F.when(F.col("swap"), yes).otherwise(no)
    rows = rows.withColumns({**{f"u{c}": pick(F.col(f"tn{c}"), F.col(f"qn{c}")) for c in XYZ}, **{f"m{c}": pick(F.col(f"qn{c}"), F.col(f"tn{c}")) for c in XYZ}, **{f"o{c}": pick(-F.col(f"l{c}"), F.col(f"l{c}")) for c in XYZ}})
    rows = rows.withColumns(dict(zip(("vx", "vy", "vz"), g.cross(g.vector("o"), g.vector("u")), strict=True))).withColumn("vsize", g.norm(g.vector("v")))
    rows = rows.withColumns({f"v{c}": F.col(f"v{c}") / F.nullif("vsize", F.lit(0.0)) for c in XYZ})
    rows = rows.withColumns(dict(zip(("wx", "wy", "wz"), g.cross(g.vector("u"), g.vector("v")), strict=True)))
    turn = F.coalesce(F.atan2(g.dot(g.vector("w"), g.vector("m")), g.dot(g.vector("u"), g.vector("m"))), F.lit(0.0))
    lean = F.coalesce(g.dot(g.vector("v"), g.vector("m")), F.lit(0.0))
    rise = F.when(F.col("vsize") > 0, pick(-F.col("a2"), F.col("a1"))).otherwise(0.0)
    cell = lambda share: F.least(F.greatest(F.floor(BINS * share), F.lit(0)), F.lit(BINS - 1)).cast("int")
    return rows.select("specimen_id", "qidx", "tidx", "d2", cell((turn + F.pi()) / (2 * F.pi())).alias("c0"), cell((lean + 1) * 0.5).alias("c1"), cell((rise + 1) * 0.5).alias("c2"))


def _by_joins(points: DataFrame, radius: float, most: int) -> DataFrame:
    """:func:`fpfh` of specimens whose pairs are rows."""
    near = radius_neighbours(points, radius, most)
    cells = pair_angles(near, points)
    share = F.lit(100.0) / F.col("n")
    of = cells.groupBy("specimen_id", "qidx").agg(F.count(F.lit(1)).alias("n"))
    rows = cells.select("specimen_id", "qidx", F.explode(F.array(*(F.col(f"c{k}") + BINS * k for k in range(3)))).alias("fidx"))
    own = rows.groupBy("specimen_id", "qidx", "fidx").agg(F.count(F.lit(1)).alias("times")).join(of, ["specimen_id", "qidx"])
    own = own.select("specimen_id", F.col("qidx").alias("pidx"), "fidx", (F.col("times") * share).alias("v"))
    weighed = near.where("d2 > 0").select("specimen_id", "qidx", F.col("tidx").alias("pidx"), "d2").join(own, ["specimen_id", "pidx"])
    weighed = weighed.groupBy("specimen_id", "qidx", "fidx").agg(F.sum(F.col("v") / F.col("d2")).alias("v"))
    angle = F.floor(F.col("fidx") / BINS).cast("int").alias("angle")
    total = weighed.groupBy("specimen_id", "qidx", angle).agg(F.sum("v").alias("total"))
    scaled = weighed.withColumn("angle", F.floor(F.col("fidx") / BINS).cast("int")).join(total, ["specimen_id", "qidx", "angle"])
    scaled = scaled.select("specimen_id", F.col("qidx").alias("pidx"), "fidx", (100.0 * F.col("v") / F.col("total")).alias("v"))
    return own.unionByName(scaled).groupBy("specimen_id", "pidx", "fidx").agg(F.sum("v").alias("v"))


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[..., 0] * b[..., 0] + a[..., 1] * b[..., 1] + a[..., 2] * b[..., 2]


def _histograms(p: np.ndarray, n: np.ndarray, index: np.ndarray, d2: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Histograms (many x m x 33) of the points ``p`` with normals ``n`` (many x m x 3) of many shapes, whose
    neighbours are those of ``index`` (many x m x k) that are ``near``; cells are those of :func:`pair_angles`."""
    many, m, k = index.shape
    each = np.arange(many)[:, None]
    counts, times = np.zeros(many * m * 3 * BINS), near.sum(2)
    first = 3 * BINS * np.arange(many * m).reshape(many, m)
    for j in range(k):  # a neighbour at a time bounds memory
        t, line, size = n[each, index[:, :, j]], p[each, index[:, :, j]] - p, np.sqrt(d2[:, :, j])
        with np.errstate(divide="ignore", invalid="ignore"):
            a1, a2 = _dot(n, line) / size, _dot(t, line) / size
            swap = np.abs(a1) < np.abs(a2)
            u, w, o = (np.where(swap[..., None], x, y) for x, y in ((t, n), (n, t), (-line, line)))
            v = np.cross(o, u)
            wide = np.sqrt(_dot(v, v))
            v = v / wide[..., None]
            turn, lean, rise = np.arctan2(_dot(np.cross(u, v), w), _dot(u, w)), _dot(v, w), np.where(swap, -a2, a1)
        flat = ~(wide > 0)
        for angle, share in enumerate(((np.where(flat, 0, turn) + np.pi) / (2 * np.pi), (np.where(flat, 0, lean) + 1) * 0.5, (np.where(flat, 0, rise) + 1) * 0.5)):
            cell = np.clip(np.floor(BINS * np.nan_to_num(share)), 0, BINS - 1).astype(np.int64) + BINS * angle
            counts += np.bincount((first + cell)[near[:, :, j]], minlength=len(counts))
    own = counts.reshape(many, m, -1) * (100.0 / np.maximum(times, 1))[..., None]
    weighed = np.zeros_like(own)
    for j in range(k):
        far = near[:, :, j] & (d2[:, :, j] > 0)
        weighed += np.where(far[..., None], own[each, index[:, :, j]] / np.where(far, d2[:, :, j], 1)[..., None], 0)
    total = weighed.reshape(many, m, 3, BINS).sum(3)
    return own + 100.0 * weighed / np.repeat(np.where(total > 0, total, 1), BINS, axis=2)


_ROWS = pa.schema([("specimen_id", pa.int64()), ("pidx", pa.int64()), ("fidx", pa.int32()), ("v", pa.float64())])


def fpfh(points: DataFrame, radius: float, most: int = 100, whole: int = 10_000) -> DataFrame:
    """(specimen_id, pidx, fidx, v): 33 numbers for each point with neighbours, those that are not 0.

    ``points`` are (specimen_id, pidx, x, y, z, nx, ny, nz). A point's own histogram
    counts its at most ``most`` nearest within ``radius`` in percent, for each of
    three angles; to it comes the sum of its neighbours' own ones, each over its
    squared distance, scaled to 100 for each angle. Points without neighbours have no rows.
    Specimens of up to ``whole`` points are worked on in a task, pairs of larger ones are rows.
    """
    large = larger(points, whole)
    few = points if large is None else points.join(large, "specimen_id", "left_anti")
    columns = (*XYZ, *(f"n{c}" for c in XYZ))
    rows = few.groupBy("specimen_id").agg(F.array_sort(F.collect_list(F.struct(F.col("pidx").cast("long").alias("i"), *columns))).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            specimens = np.asarray(batch.column(0))
            for at in alike(batch, 1):
                i, p = arrays(batch, at, 1)
                n = arrays(batch, at, 4)[1]  # the columns behind z
                index, d2 = nearest_in(i, p, i, p, most, True)
                found = _histograms(p, n, index, d2, d2 <= radius * radius)
                row, point, cell = np.nonzero(found)
                yield pa.RecordBatch.from_arrays([pa.array(specimens[at][row]), pa.array(i[row, point]), pa.array(cell.astype(np.int32)), pa.array(found[row, point, cell])], schema=_ROWS)

    found = rows.select("specimen_id", *(F.col(f"p.{c}").alias(c) for c in ("i", *columns))).mapInArrow(run, "specimen_id long, pidx long, fidx int, v double")
    found = found.withColumn("pidx", F.col("pidx").cast(points.schema["pidx"].dataType))
    return found if large is None else found.unionByName(_by_joins(points.join(large, "specimen_id", "left_semi"), radius, most))


def nearest_features(source: DataFrame, target: DataFrame) -> DataFrame:
    """(specimen_id, pidx, match, d2): for each point's features the point of the other
    shape of the specimen whose features (pidx, fidx, v) are nearest, ties to the lowest.

    Features are sparse rows: products of what both have, and sums of squares, give all distances."""
    square = lambda f, name: f.groupBy("specimen_id", F.col("pidx").alias(name)).agg(F.sum(F.col("v") * F.col("v")).alias(f"{name}_2"))
    both = source.select("specimen_id", F.col("pidx").alias("s"), "fidx", F.col("v").alias("sv")).join(target.select("specimen_id", F.col("pidx").alias("t"), "fidx", F.col("v").alias("tv")), ["specimen_id", "fidx"])
    product = both.groupBy("specimen_id", "s", "t").agg(F.sum(F.col("sv") * F.col("tv")).alias("st"))
    d2 = product.join(square(source, "s"), ["specimen_id", "s"]).join(square(target, "t"), ["specimen_id", "t"])
    d2 = d2.withColumn("d2", F.greatest(F.col("s_2") + F.col("t_2") - 2 * F.col("st"), F.lit(0.0)))
    return d2.groupBy("specimen_id", F.col("s").alias("pidx")).agg(F.min(F.struct(F.round("d2", 9).alias("d2"), "t")).alias("m")).select("specimen_id", "pidx", F.col("m.t").alias("match"), F.col("m.d2").alias("d2"))
