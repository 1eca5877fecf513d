"""Registered queries over the given tables and the SQL each must equal.

Shapes are the 21 landmarks that each row of ``embeddings`` carries; a strip of
19 triangles joins them. Numbers are rounded so that the order of sums does not
show.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import atlas, biharmonic, mesh, neighbors, pairing, points, procrustes, registration, sampling, segmentation, shape_model, shells, spectral, surfaces, template_search
from ..operators import features as histograms
from ..sources import bridge, readers
from ..sources.lineage import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

P = "p AS (SELECT vec_id AS specimen_id, label AS population, i AS pidx, embedding[3*i+1]::DOUBLE AS x, embedding[3*i+2]::DOUBLE AS y, embedding[3*i+3]::DOUBLE AS z FROM embeddings, (SELECT unnest(range(0, 21))::INTEGER AS i))"
FACES = "f AS (SELECT i::INTEGER AS fid, i::INTEGER AS a, (i+1)::INTEGER AS b, (i+2)::INTEGER AS c FROM range(0, 19) t(i))"
TRI = "t AS (SELECT p.specimen_id, fid, a, b, c, p.x AS ax, p.y AS ay, p.z AS az, q.x AS bx, q.y AS by_, q.z AS bz, r.x AS cx, r.y AS cy, r.z AS cz FROM f JOIN p ON p.pidx = a JOIN p q ON q.pidx = b AND q.specimen_id = p.specimen_id JOIN p r ON r.pidx = c AND r.specimen_id = p.specimen_id)"
NORMAL = "n0 AS (SELECT *, (by_-ay)*(cz-az)-(bz-az)*(cy-ay) AS ux, (bz-az)*(cx-ax)-(bx-ax)*(cz-az) AS uy, (bx-ax)*(cy-ay)-(by_-ay)*(cx-ax) AS uz FROM t), n AS (SELECT specimen_id, fid, a, b, c, ux/(sqrt(ux*ux+uy*uy+uz*uz)+1e-12) AS nx, uy/(sqrt(ux*ux+uy*uy+uz*uz)+1e-12) AS ny, uz/(sqrt(ux*ux+uy*uy+uz*uz)+1e-12) AS nz, sqrt(ux*ux+uy*uy+uz*uz)/2 AS area FROM n0)"
EDGES = "e0 AS (SELECT fid, a AS u, b AS v FROM f UNION ALL SELECT fid, b, c FROM f UNION ALL SELECT fid, c, a FROM f), e AS (SELECT least(u, v) AS lo, greatest(u, v) AS hi, count(*) AS n_faces FROM e0 GROUP BY 1, 2), adj AS (SELECT lo AS src, hi AS dst FROM e UNION ALL SELECT hi, lo FROM e)"
BOX = "b AS (SELECT specimen_id, min(x) AS ix, min(y) AS iy, min(z) AS iz, max(x) AS mx, max(y) AS my, max(z) AS mz, sqrt((max(x)-min(x))*(max(x)-min(x))+(max(y)-min(y))*(max(y)-min(y))+(max(z)-min(z))*(max(z)-min(z))) AS diagonal FROM p GROUP BY 1)"
D2 = "((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z))"
KNN = f"nn AS (SELECT p.specimen_id, p.pidx AS qidx, q.pidx AS tidx, {D2} AS d2, row_number() OVER (PARTITION BY p.specimen_id, p.pidx ORDER BY {D2}, q.pidx) AS rank FROM p JOIN p q ON p.specimen_id = q.specimen_id AND p.pidx <> q.pidx QUALIFY rank <= 6)"
MATRIX = g.similarity_matrix([[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]], 1.5, [0.1, -0.2, 0.3])


def query(name: str, sql: str | None):
    """Register a query and its SQL; ``WITH`` and a list of shared parts come first."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, and minus zero as zero."""
    return df.select(*(((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c)) for c, t in df.dtypes))


def r(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({e}, {digits}) + 0.0 AS {n}" for n, _, e in (x.partition("=") for x in (n if "=" in n else f"{n}={n}" for n in names)))


def vertices(spark: SparkSession, sf: str) -> DataFrame:
    return bridge.points(spark, sf).select("specimen_id", F.col("pidx").alias("vid"), "x", "y", "z")


# --- points -----------------------------------------------------------------


@query("mean_shape", f"WITH {P} SELECT pidx, {r('x=avg(x)', 'y=avg(y)', 'z=avg(z)')} FROM p GROUP BY pidx")
def _(spark, sf):
    return rounded(points.mean_shape(bridge.points(spark, sf)))


@query("mean_shape_by_label", f"WITH {P} SELECT population, pidx, {r('x=avg(x)', 'y=avg(y)', 'z=avg(z)')} FROM p GROUP BY 1, 2")
def _(spark, sf):
    return rounded(points.mean_shape(bridge.points(spark, sf), "population"))


@query("centroid_by_specimen", f"WITH {P} SELECT specimen_id, {r('x=avg(x)', 'y=avg(y)', 'z=avg(z)')} FROM p GROUP BY 1")
def _(spark, sf):
    return rounded(points.centroid(bridge.points(spark, sf), "specimen_id"))


@query("bbox_diagonal", f"WITH {P}, {BOX} SELECT specimen_id, {r('diagonal')} FROM b")
def _(spark, sf):
    return rounded(points.bounds(bridge.points(spark, sf), "specimen_id").select("specimen_id", "diagonal"))


_CLOSEST = "m AS (SELECT {by} pidx, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM p GROUP BY ALL), s AS (SELECT {pby} p.specimen_id, round(sum((p.x-m.x)*(p.x-m.x)+(p.y-m.y)*(p.y-m.y)+(p.z-m.z)*(p.z-m.z)), 9) AS ss FROM p JOIN m USING ({by} pidx) GROUP BY ALL)"


@query("closest_to_mean", f"WITH {P}, {_CLOSEST.format(by='', pby='')} SELECT specimen_id, {r('ss')} FROM s ORDER BY s.ss, specimen_id LIMIT 1")
def _(spark, sf):
    return rounded(points.closest_to_mean(bridge.points(spark, sf)))


@query("closest_to_mean_by_label", f"WITH {P}, {_CLOSEST.format(by='population,', pby='population,')} SELECT population, specimen_id, {r('ss')} FROM s QUALIFY row_number() OVER (PARTITION BY population ORDER BY s.ss, specimen_id) = 1")
def _(spark, sf):
    return rounded(points.closest_to_mean(bridge.points(spark, sf), "population"))


@query("prescale_to_target", f"WITH {P}, d AS (SELECT population, sqrt((max(x)-min(x))*(max(x)-min(x))+(max(y)-min(y))*(max(y)-min(y))+(max(z)-min(z))*(max(z)-min(z))) AS d FROM p GROUP BY 1) SELECT {r('source_diagonal=a.d', 'target_diagonal=b.d', 'factor=b.d/0.5/a.d')} FROM d a, d b WHERE a.population = 0 AND b.population = 1")
def _(spark, sf):
    p = bridge.points(spark, sf)
    return rounded(points.prescale(p.where("population = 0"), p.where("population = 1"), 0.5))


@query("normalize_diag20", f"WITH {P}, {BOX} SELECT specimen_id, pidx, {r('x=x*(20.0/diagonal)', 'y=y*(20.0/diagonal)', 'z=z*(20.0/diagonal)', 'factor=20.0/diagonal')} FROM p JOIN b USING (specimen_id)")
def _(spark, sf):
    return rounded(points.scale_diagonal(bridge.points(spark, sf)))


@query("unit_size", f"WITH {P}, {BOX}, s AS (SELECT *, greatest(mx-ix, my-iy, mz-iz) AS side FROM b) SELECT specimen_id, pidx, {r('x=(x-(mx+ix)/2)/side', 'y=(y-(my+iy)/2)/side', 'z=(z-(mz+iz)/2)/side')} FROM p JOIN s USING (specimen_id)")
def _(spark, sf):
    return rounded(points.unit_size(bridge.points(spark, sf)))


@query("apply_similarity", f"WITH {P} SELECT specimen_id, population, pidx, {r('x=-1.5*y+0.1', 'y=1.5*x-0.2', 'z=1.5*z+0.3')} FROM p")
def _(spark, sf):
    return rounded(points.transform(bridge.points(spark, sf), MATRIX))


@query("fixed_scale_shift", f"WITH {P}, c AS (SELECT population, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM p GROUP BY 1) SELECT {r('x=b.x+a.y', 'y=b.y-a.x', 'z=b.z-a.z')} FROM c a, c b WHERE a.population = 0 AND b.population = 1")
def _(spark, sf):
    p = bridge.points(spark, sf)
    return rounded(points.fixed_scale_shift(p.where("population = 0"), p.where("population = 1"), [[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]]))


_VOX = "floor(x/0.1)::BIGINT AS kx, floor(y/0.1)::BIGINT AS ky, floor(z/0.1)::BIGINT AS kz"


@query("voxel_representative", f"WITH {P} SELECT specimen_id, {_VOX}, min(pidx) AS pidx, count(*) AS n_points FROM p GROUP BY ALL")
def _(spark, sf):
    return points.voxel_representatives(bridge.points(spark, sf), 0.1, "specimen_id")


@query("voxel_downsample", f"WITH {P} SELECT population, {_VOX}, {r('x=avg(x)', 'y=avg(y)', 'z=avg(z)')}, count(*) AS n_points FROM p GROUP BY population, floor(x/0.1), floor(y/0.1), floor(z/0.1)")
def _(spark, sf):
    return rounded(points.voxel_downsample(bridge.points(spark, sf), 0.1, "population"))


@query("voxel_count", f"WITH {P} SELECT population, count(DISTINCT (floor(x/0.1), floor(y/0.1), floor(z/0.1))) AS n_voxels FROM p GROUP BY 1")
def _(spark, sf):
    return points.voxel_count(bridge.points(spark, sf), 0.1, "population")


@query("finite_filter", f"WITH {P}, v AS (SELECT specimen_id, pidx, CASE WHEN abs(x) > 0.3 THEN 'nan'::DOUBLE ELSE x END AS x FROM p) SELECT specimen_id, count(*) AS n FROM v WHERE NOT isnan(x) GROUP BY 1")
def _(spark, sf):
    p = bridge.points(spark, sf).withColumn("x", F.when(F.abs("x") > 0.3, F.lit(float("nan"))).otherwise(F.col("x")))
    return points.finite_points(p).groupBy("specimen_id").agg(F.count(F.lit(1)).alias("n"))


@query("non_finite_guard", f"WITH {P} SELECT population, count(*) AS n_points, count(*) FILTER (abs(x) > 0.3)::BIGINT AS n_bad FROM p GROUP BY 1")
def _(spark, sf):
    p = bridge.points(spark, sf).withColumn("x", F.when(F.abs("x") > 0.3, F.lit(float("inf"))).otherwise(F.col("x")))
    return points.non_finite_counts(p, "population")


@query("count_consistency", f"WITH {P}, n AS (SELECT population, specimen_id, count(*) AS n FROM p WHERE x > -0.2 GROUP BY 1, 2) SELECT population, count(*) AS n_specimens, min(n) AS least, max(n) AS most, min(n) = max(n) AS consistent FROM n GROUP BY 1")
def _(spark, sf):
    return points.count_consistency(bridge.points(spark, sf).where("x > -0.2"), "population")


@query("non_zero_shapes", f"WITH {P} SELECT specimen_id, {r('largest=max(greatest(abs(x), abs(y), abs(z)))')} FROM p GROUP BY 1 HAVING max(greatest(abs(x), abs(y), abs(z))) > 0")
def _(spark, sf):
    return rounded(points.non_zero_shapes(bridge.points(spark, sf)))


@query("coordinate_flip", f"WITH {P} SELECT specimen_id, pidx, {r('x=CASE WHEN population % 2 = 0 THEN -x ELSE x END', 'y=CASE WHEN population % 2 = 0 THEN -y ELSE y END', 'z')} FROM p")
def _(spark, sf):
    p = bridge.points(spark, sf)
    flipped = g.to_ras(g.vector(), F.when(F.col("population") % 2 == 0, "LPS").otherwise("RAS"))
    return rounded(p.select("specimen_id", "pidx", *(f.alias(c) for f, c in zip(flipped, "xyz", strict=True))))


@query("principal_axis_moments", f"WITH {P} SELECT population, {', '.join(f'round(sum({a}*{b}) - sum({a})*sum({b})/count(*), 6) + 0.0 AS {a}{b}' for a, b in ('xx', 'xy', 'xz', 'yy', 'yz', 'zz'))} FROM p GROUP BY 1")
def _(spark, sf):
    return rounded(points.principal_axis_moments(bridge.points(spark, sf), "population"))


_MOM = ", ".join(f"sum({a}*{b}) - sum({a})*sum({b})/count(*) AS {a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))
_AXIS = f"""mo AS (SELECT population, {_MOM} FROM p GROUP BY 1), tr AS (SELECT *, (xx+yy+zz)/3 AS q FROM mo),
dv AS (SELECT *, sqrt(((xx-q)*(xx-q)+(yy-q)*(yy-q)+(zz-q)*(zz-q)+2*(xy*xy+xz*xz+yz*yz))/6) AS s FROM tr),
ro AS (SELECT *, ((xx-q)*((yy-q)*(zz-q)-yz*yz)-xy*(xy*(zz-q)-yz*xz)+xz*(xy*yz-(yy-q)*xz))/(2*s*s*s) AS r FROM dv),
ev AS (SELECT *, q+2*s*cos(acos(greatest(-1.0, least(1.0, r)))/3) AS ss FROM ro),
vx AS (SELECT population, ss, xy*yz-xz*(yy-ss) AS x, xz*xy-(xx-ss)*yz AS y, (xx-ss)*(yy-ss)-xy*xy AS z FROM ev),
un AS (SELECT population, ss, x, y, z, CASE WHEN greatest(x, y, z) < -least(x, y, z) THEN -1 ELSE 1 END / sqrt(x*x+y*y+z*z) AS f FROM vx)"""


@query("principal_axis", f"WITH {P}, {_AXIS} SELECT population, {r('x=x*f', 'y=y*f', 'z=z*f', 'ss', digits=4)} FROM un")
def _(spark, sf):
    return rounded(points.principal_axis(bridge.points(spark, sf), "population"), 4)


@query("unit_size_inverse", f"WITH {P} SELECT specimen_id, pidx, {r('x', 'y', 'z')} FROM p")
def _(spark, sf):
    p = bridge.points(spark, sf)
    return rounded(points.from_unit_size(points.unit_size(p), points.unit_frames(p)))


@query("control_point_count", f"WITH {P} SELECT specimen_id, count(DISTINCT pidx) AS n_points FROM p WHERE x > -0.2 GROUP BY 1")
def _(spark, sf):
    return points.control_point_counts(bridge.points(spark, sf).where("x > -0.2"), "specimen_id")


@query("copy_labels", f"WITH {P}, l AS (SELECT DISTINCT pidx, 'locus ' || pidx // 7 AS label FROM p), v AS (SELECT specimen_id, pidx FROM p WHERE x > -0.2), n AS (SELECT specimen_id, count(*) = (SELECT count(*) FROM l) AS fits FROM v GROUP BY 1) SELECT specimen_id, pidx, CASE WHEN fits THEN label END AS label FROM v JOIN n USING (specimen_id) LEFT JOIN l USING (pidx)")
def _(spark, sf):
    p = bridge.points(spark, sf)
    template = p.select("pidx").distinct().withColumn("label", F.concat(F.lit("locus "), F.floor(F.col("pidx") / 7).cast("string")))
    return points.copy_labels(p.where("x > -0.2"), template)


@query("pose_to_world", f"WITH {P}, {BOX}, c AS (SELECT specimen_id, population, avg(x) AS sx, avg(y) AS sy, avg(z) AS sz FROM p GROUP BY 1, 2), t AS (SELECT population, avg(x) AS tx, avg(y) AS ty, avg(z) AS tz FROM p GROUP BY 1) SELECT specimen_id, {r('x=0.1+tx+20.0/diagonal*sy', 'y=ty-20.0/diagonal*sx', 'z=tz-20.0/diagonal*sz')} FROM c JOIN t USING (population) JOIN b USING (specimen_id)")
def _(spark, sf):
    p = bridge.points(spark, sf)
    source = points.centroid(p, "specimen_id", "population").select("specimen_id", "population", *(F.col(c).alias(f"s{c}") for c in "xyz"))
    target = points.centroid(p, "population").select("population", *(F.col(c).alias(f"t{c}") for c in "xyz"))
    scale = points.bounds(p, "specimen_id").select("specimen_id", (F.lit(20.0) / F.col("diagonal")).alias("scale"), F.lit(0.1).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    poses = source.join(target, "population").join(scale, "specimen_id")
    return rounded(points.to_world(poses, [[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]]).select("specimen_id", "x", "y", "z"))


@query("projection_limit", f"WITH {P}, {BOX} SELECT specimen_id, {r('most=diagonal*0.05')} FROM b")
def _(spark, sf):
    return rounded(points.projection_limit(points.bounds(bridge.points(spark, sf), "specimen_id"), 5.0, skip=False))


@query("run_summary", f"WITH {P}, o AS (SELECT specimen_id, count(*) = 21 AND max(x) <= 0.3 AND max(greatest(abs(x), abs(y), abs(z))) > 0 AS ok FROM p WHERE y > -0.4 GROUP BY 1) SELECT count(*) AS specimens, count(*) FILTER (ok) AS used, count(*) FILTER (NOT ok) AS skipped, 21 * count(*) FILTER (ok) AS points FROM o")
def _(spark, sf):
    p = bridge.points(spark, sf).where("y > -0.4").withColumn("x", F.when(F.col("x") > 0.3, F.lit(float("nan"))).otherwise(F.col("x")))
    return points.run_summary(p, bridge.N_POINTS)


@query("seeded_subsample", f"WITH {P} SELECT specimen_id, population, pidx, {r('x', 'y', 'z')} FROM p QUALIFY row_number() OVER (PARTITION BY specimen_id ORDER BY md5(concat_ws(':', '7', specimen_id::VARCHAR, pidx::VARCHAR)), pidx) <= 5")
def _(spark, sf):
    return rounded(points.subsample(bridge.points(spark, sf), 5, "pidx", "specimen_id", seed=7))


@query("first_preview", f"WITH {P} SELECT specimen_id, population, pidx, {r('x', 'y', 'z')} FROM p WHERE specimen_id IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 10)")
def _(spark, sf):
    return rounded(points.preview(bridge.points(spark, sf), 10))


# --- shape models -----------------------------------------------------------


@query("total_variance", f"WITH {P}, v AS (SELECT population, var_samp(x)+var_samp(y)+var_samp(z) AS v FROM p GROUP BY population, pidx) SELECT population, {r('variance=sum(v)')} FROM v GROUP BY 1")
def _(spark, sf):
    return rounded(shape_model.total_variance(bridge.points(spark, sf), "population"))


@query("covariance", f"WITH {P}, l AS (SELECT specimen_id, 3*pidx AS k, x AS v FROM p UNION ALL SELECT specimen_id, 3*pidx+1, y FROM p UNION ALL SELECT specimen_id, 3*pidx+2, z FROM p) SELECT a.k::INTEGER AS i, b.k::INTEGER AS j, {r('cov=covar_samp(a.v, b.v)')} FROM l a JOIN l b ON a.specimen_id = b.specimen_id AND a.k <= b.k GROUP BY 1, 2")
def _(spark, sf):
    return rounded(shape_model.covariance(bridge.points(spark, sf)))


_EIG = "g AS (SELECT pidx AS mode, var_samp(x) AS v FROM p GROUP BY 1)"


@query("cumulative_variance", f"WITH {P}, {_EIG} SELECT mode, {r('v')}, row_number() OVER (ORDER BY g.v DESC, mode)::INTEGER AS rank, round(sum(g.v) OVER (ORDER BY g.v DESC, mode ROWS UNBOUNDED PRECEDING) / sum(g.v) OVER (), 6) AS share FROM g")
def _(spark, sf):
    eig = bridge.points(spark, sf).groupBy(F.col("pidx").alias("mode")).agg(F.var_samp("x").alias("v"))
    return rounded(shape_model.explained(eig))


@query("mode_count_95", f"WITH {P}, {_EIG}, c AS (SELECT row_number() OVER (ORDER BY v DESC, mode)::INTEGER AS rank, sum(v) OVER (ORDER BY v DESC, mode ROWS UNBOUNDED PRECEDING) / sum(v) OVER () AS share FROM g) SELECT min(rank) AS modes FROM c WHERE share >= 0.95")
def _(spark, sf):
    eig = bridge.points(spark, sf).groupBy(F.col("pidx").alias("mode")).agg(F.var_samp("x").alias("v"))
    return shape_model.mode_count(eig, 0.95)


@query("gram_matrix", f"WITH {P}, m AS (SELECT pidx, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM p GROUP BY 1), d AS (SELECT specimen_id, pidx, p.x - m.x AS x, p.y - m.y AS y, p.z - m.z AS z FROM p JOIN m USING (pidx)) SELECT a.specimen_id AS si, b.specimen_id AS sj, {r('v=sum(a.x*b.x+a.y*b.y+a.z*b.z)')} FROM d a JOIN d b USING (pidx) WHERE a.specimen_id <= b.specimen_id GROUP BY 1, 2")
def _(spark, sf):
    return rounded(shape_model.gram(bridge.points(spark, sf)))


#: Eigenvalues cannot be found by SQL, but what must hold of them and of the modes can be said.
_FULL = "SELECT i::INTEGER AS mode FROM range(0, 63) t(i)"


@query("ssm_gram", f"SELECT mode, 0.0::DOUBLE AS residual, 1.0::DOUBLE AS norm FROM ({_FULL})")
def _(spark, sf):
    p = bridge.points(spark, sf)
    _, modes, eig = shape_model.build(p, branch="gram")
    return rounded(shape_model.residuals(p, modes, eig))


@query("ssm_residuals", f"SELECT mode, 0.0::DOUBLE AS residual, 1.0::DOUBLE AS norm FROM ({_FULL})")
def _(spark, sf):
    p = bridge.points(spark, sf)
    _, modes, eig = shape_model.build(p, branch="covariance")
    return rounded(shape_model.residuals(p, modes, eig))


@query("ssm_explained", f"WITH {P}, v AS (SELECT sum(var_samp_x + var_samp_y + var_samp_z) AS v FROM (SELECT var_samp(x) AS var_samp_x, var_samp(y) AS var_samp_y, var_samp(z) AS var_samp_z FROM p GROUP BY pidx)) SELECT 63::BIGINT AS modes, {r('variance=v')}, true AS falls, 1.0::DOUBLE AS share, true AS fewest_95 FROM v")
def _(spark, sf):
    p = bridge.points(spark, sf)
    _, _, eig = shape_model.build(p)
    shares = shape_model.explained(eig).crossJoin(shape_model.mode_count(eig, 0.95))  # one row
    enough = F.min(F.when(F.col("rank") >= F.col("modes"), F.col("share"))) >= 0.95
    short = F.coalesce(F.max(F.when(F.col("rank") < F.col("modes"), F.col("share"))), F.lit(0.0)) < 0.95
    falls = F.max(F.struct(F.col("rank"), F.col("mode")))["mode"] == F.max("mode")
    return rounded(shares.groupBy().agg(F.count(F.lit(1)).alias("modes"), F.sum("v").alias("variance"), falls.alias("falls"), F.max("share").alias("share"), (enough & short).alias("fewest_95")))


_SAMPLE = "m AS (SELECT pidx, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM p GROUP BY 1), u AS (SELECT population AS mode, pidx, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM p GROUP BY 1, 2), w AS (SELECT specimen_id AS sample, population AS mode, avg(x) AS b FROM p GROUP BY 1, 2), g AS (SELECT population AS mode, var_pop(x) AS v FROM p GROUP BY 1)"


def _sampled(spark, sf, sigma):
    p = bridge.points(spark, sf)
    modes = points.mean_shape(p, "population").withColumnRenamed("population", "mode")
    weights = p.groupBy(F.col("specimen_id").alias("sample"), F.col("population").alias("mode")).agg(F.avg("x").alias("b"))
    eig = p.groupBy(F.col("population").alias("mode")).agg(F.var_pop("x").alias("v")) if sigma else None
    return rounded(shape_model.sample(points.mean_shape(p), modes, weights, eig))


@query("ssm_sample_native", f"WITH {P}, {_SAMPLE} SELECT sample, pidx, {r('x=m.x+b*u.x', 'y=m.y+b*u.y', 'z=m.z+b*u.z')} FROM w JOIN u USING (mode) JOIN m USING (pidx)")
def _(spark, sf):
    return _sampled(spark, sf, False)


@query("ssm_sample_sigma", f"WITH {P}, {_SAMPLE} SELECT sample, pidx, {r(*(f'{c}=m.{c}+b*sqrt(greatest(v, 1e-10))*u.{c}' for c in 'xyz'))} FROM w JOIN u USING (mode) JOIN m USING (pidx) JOIN g USING (mode)")
def _(spark, sf):
    return _sampled(spark, sf, True)


# --- neighbours -------------------------------------------------------------


@query("knn_self", f"WITH {P}, {KNN} SELECT specimen_id, qidx::BIGINT AS qidx, tidx::BIGINT AS tidx, rank::INTEGER AS rank, {r('d2')} FROM nn")
def _(spark, sf):
    p = bridge.points(spark, sf)
    return rounded(neighbors.k_nearest(p, p, 6, same=True))


@query("nn_landmark_to_vertex", f"WITH {P} SELECT p.specimen_id, p.pidx::BIGINT AS qidx, q.pidx::BIGINT AS tidx, 1::INTEGER AS rank, {r(f'd2={D2}')} FROM p JOIN p q ON p.specimen_id = q.specimen_id WHERE p.pidx < 7 AND q.pidx >= 7 QUALIFY row_number() OVER (PARTITION BY p.specimen_id, p.pidx ORDER BY {D2}, q.pidx) = 1")
def _(spark, sf):
    p = bridge.points(spark, sf)
    return rounded(neighbors.k_nearest(p.where("pidx < 7"), p.where("pidx >= 7"), 1))


@query("radius_neighbors", f"WITH {P} SELECT p.specimen_id, p.pidx AS qidx, q.pidx AS tidx, {r(f'd2={D2}')}, row_number() OVER (PARTITION BY p.specimen_id, p.pidx ORDER BY {D2}, q.pidx)::INTEGER AS rank FROM p JOIN p q ON p.specimen_id = q.specimen_id AND p.pidx <> q.pidx WHERE {D2} <= 0.15*0.15 QUALIFY rank <= 5")
def _(spark, sf):
    return rounded(neighbors.radius_neighbours(bridge.points(spark, sf), 0.15, 5))


_SYM = "s AS (SELECT specimen_id, src, dst, w FROM d UNION ALL SELECT specimen_id, dst, src, w FROM d)"


@query("knn_graph_segmentation", f"WITH {P}, {KNN}, h AS (SELECT specimen_id, median(sqrt(d2)) AS s FROM nn GROUP BY 1), d AS (SELECT specimen_id, qidx::BIGINT AS src, tidx::BIGINT AS dst, exp(-d2/(s*s)) AS w FROM nn JOIN h USING (specimen_id)), {_SYM} SELECT specimen_id, src, dst, {r('w=max(w)')} FROM s GROUP BY 1, 2, 3")
def _(spark, sf):
    return rounded(neighbors.gaussian_graph(bridge.points(spark, sf), 6, "segmentation"))


@query("knn_laplacian_projection", f"WITH {P}, {KNN}, h AS (SELECT specimen_id, median(sqrt(d2)) AS s FROM nn WHERE rank = 6 GROUP BY 1), d AS (SELECT specimen_id, qidx::BIGINT AS src, tidx::BIGINT AS dst, exp(-d2/(2*s*s)) AS w FROM nn JOIN h USING (specimen_id)), {_SYM} SELECT specimen_id, src, dst, {r('w=sum(w)/2')} FROM s GROUP BY 1, 2, 3")
def _(spark, sf):
    return rounded(neighbors.gaussian_graph(bridge.points(spark, sf), 6, "projection"))


@query("bandwidth_p75", f"WITH {P}, {KNN} SELECT specimen_id, {r('h=quantile_cont(sqrt(d2), 0.75) + 1e-9')} FROM nn GROUP BY 1")
def _(spark, sf):
    p = bridge.points(spark, sf)
    return rounded(neighbors.k_nearest(p, p, 6, same=True).groupBy("specimen_id").agg((F.percentile(F.sqrt("d2"), F.lit(0.75)) + 1e-9).alias("h")))


@query("rbf_deform", f"WITH {P}, m AS (SELECT pidx, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM p GROUP BY 1), nn AS (SELECT p.specimen_id, p.pidx AS qidx, q.pidx AS tidx, {D2} AS d2, m.x-q.x AS dx, m.y-q.y AS dy, m.z-q.z AS dz FROM p JOIN p q ON p.specimen_id = q.specimen_id AND p.pidx >= 7 AND q.pidx < 7 JOIN m ON m.pidx = q.pidx), h AS (SELECT specimen_id, quantile_cont(sqrt(d2), 0.75) + 1e-9 AS h FROM nn GROUP BY 1), w AS (SELECT *, exp(-d2/(h*h)) AS w FROM nn JOIN h USING (specimen_id)), s AS (SELECT specimen_id, qidx, sum(w*dx)/sum(w) AS mx, sum(w*dy)/sum(w) AS my, sum(w*dz)/sum(w) AS mz FROM w GROUP BY 1, 2) SELECT specimen_id, pidx, {r('x=x+mx', 'y=y+my', 'z=z+mz')} FROM p JOIN s ON s.specimen_id = p.specimen_id AND qidx = pidx".replace("SELECT specimen_id, pidx, round(x+mx", "SELECT p.specimen_id, pidx, round(x+mx"))
def _(spark, sf):
    p = bridge.points(spark, sf)
    mean = points.mean_shape(p).select("pidx", *(F.col(c).alias(f"m{c}") for c in "xyz"))
    moves = p.where("pidx < 7").join(mean, "pidx").select("specimen_id", "pidx", *((F.col(f"m{c}") - F.col(c)).alias(f"d{c}") for c in "xyz"))
    return rounded(neighbors.rbf_deform(p.where("pidx >= 7"), p.where("pidx < 7"), moves))


@query("registration_fitness", f"WITH {P}, nn AS (SELECT p.specimen_id, p.pidx, min({D2}) AS d2 FROM p JOIN p q ON p.specimen_id = q.specimen_id WHERE p.pidx < 7 AND q.pidx >= 7 GROUP BY 1, 2) SELECT specimen_id, {r('fitness=avg((d2 <= 0.15*0.15)::INTEGER)', 'rmse=coalesce(sqrt(avg(d2) FILTER (d2 <= 0.15*0.15)), 0.0)')} FROM nn GROUP BY 1")
def _(spark, sf):
    p = bridge.points(spark, sf)
    return rounded(neighbors.fitness(p.where("pidx < 7"), p.where("pidx >= 7"), 0.15))


@query("project_labels", f"WITH {P} SELECT p.specimen_id, p.pidx::BIGINT AS vid, (q.pidx % 3)::INTEGER AS label FROM p JOIN p q ON p.specimen_id = q.specimen_id AND q.pidx < 7 QUALIFY row_number() OVER (PARTITION BY p.specimen_id, p.pidx ORDER BY {D2}, q.pidx) = 1")
def _(spark, sf):
    p = bridge.points(spark, sf)
    labels = p.where("pidx < 7").select("pidx", (F.col("pidx") % 3).cast("int").alias("label")).distinct()
    return neighbors.project_labels(p, p.where("pidx < 7"), labels)


@query("duplicate_constraints_avg", f"WITH {P}, nn AS (SELECT p.specimen_id, p.x, p.y, p.z, q.pidx AS vid FROM p JOIN p q ON p.specimen_id = q.specimen_id AND p.pidx >= 7 AND q.pidx < 7 QUALIFY row_number() OVER (PARTITION BY p.specimen_id, p.pidx ORDER BY {D2}, q.pidx) = 1) SELECT specimen_id, vid::BIGINT AS vid, {r('x=avg(x)', 'y=avg(y)', 'z=avg(z)')}, count(*) AS n FROM nn GROUP BY 1, 2")
def _(spark, sf):
    return rounded(registration.vertex_constraints(bridge.points(spark, sf).where("pidx >= 7"), bridge.points(spark, sf).where("pidx < 7")))


# --- meshes -----------------------------------------------------------------


@query("unique_edges", f"WITH {P}, {FACES}, {TRI}, {NORMAL}, k AS (SELECT * FROM n WHERE area > 0.02), h AS (SELECT specimen_id, a AS u, b AS v FROM k UNION ALL SELECT specimen_id, b, c FROM k UNION ALL SELECT specimen_id, c, a FROM k) SELECT specimen_id, least(u, v) AS lo, greatest(u, v) AS hi, count(*) AS n_faces FROM h GROUP BY 1, 2, 3")
def _(spark, sf):
    return mesh.unique_edges(mesh.non_degenerate(vertices(spark, sf), bridge.faces(spark), 0.02), "specimen_id")


@query("face_normals", f"WITH {P}, {FACES}, {TRI}, {NORMAL} SELECT specimen_id, fid, {r('nx', 'ny', 'nz', 'area')} FROM n")
def _(spark, sf):
    return rounded(mesh.face_geometry(vertices(spark, sf), bridge.faces(spark)).drop("a", "b", "c"))


@query("degenerate_triangles", f"WITH {P}, {FACES}, {TRI}, {NORMAL} SELECT specimen_id, fid, a, b, c FROM n WHERE area > 0.02")
def _(spark, sf):
    return mesh.non_degenerate(vertices(spark, sf), bridge.faces(spark), 0.02)


@query("edge_lengths", f"WITH {P}, {BOX}, {FACES}, {EDGES}, l AS (SELECT p.specimen_id, avg(sqrt({D2})) AS m FROM e0 JOIN p ON p.pidx = u JOIN p q ON q.pidx = v AND q.specimen_id = p.specimen_id GROUP BY 1) SELECT specimen_id, {r('mean_edge=m', 'diagonal', 'share=m/diagonal')} FROM l JOIN b USING (specimen_id)")
def _(spark, sf):
    return rounded(mesh.edge_lengths(vertices(spark, sf), bridge.faces(spark)))


@query("dense_mesh_warning", f"WITH {P}, {BOX}, {FACES}, {EDGES}, l AS (SELECT p.specimen_id, avg(sqrt({D2})) AS m FROM e0 JOIN p ON p.pidx = u JOIN p q ON q.pidx = v AND q.specimen_id = p.specimen_id GROUP BY 1) SELECT specimen_id, m / diagonal < 0.35 AS dense FROM l JOIN b USING (specimen_id)")
def _(spark, sf):
    v, f = vertices(spark, sf), bridge.faces(spark)
    n_vertices = v.groupBy("specimen_id").agg(F.count(F.lit(1)).alias("n_vertices"))
    n_faces = mesh.corners(v, f).groupBy("specimen_id").agg(F.count(F.lit(1)).alias("n_faces"))
    sizes = mesh.edge_lengths(v, f).join(n_vertices, "specimen_id").join(n_faces, "specimen_id")
    return mesh.dense_mesh(sizes, share=0.35).select("specimen_id", "dense")


@query("vertex_area", f"WITH {P}, {FACES}, {TRI}, {NORMAL}, c3 AS (SELECT specimen_id, a AS vid, area FROM n UNION ALL SELECT specimen_id, b, area FROM n UNION ALL SELECT specimen_id, c, area FROM n) SELECT specimen_id, vid, {r('area=greatest(sum(area/3), 1e-12)')} FROM c3 GROUP BY 1, 2")
def _(spark, sf):
    return rounded(mesh.vertex_areas(vertices(spark, sf), bridge.faces(spark)))


def _cot(i, j, o):
    d = lambda a, b: [f"({a}x-{b}x)", f"({a}{'y_' if a == 'b' else 'y'}-{b}{'y_' if b == 'b' else 'y'})", f"({a}z-{b}z)"]
    (ux, uy, uz), (vx, vy, vz) = d(i, o), d(j, o)
    c = [f"({uy}*{vz}-{uz}*{vy})", f"({uz}*{vx}-{ux}*{vz})", f"({ux}*{vy}-{uy}*{vx})"]
    return f"SELECT specimen_id, least({i}, {j}) AS lo, greatest({i}, {j}) AS hi, ({ux}*{vx}+{uy}*{vy}+{uz}*{vz})/greatest(sqrt({'+'.join(f'{x}*{x}' for x in c)}), 1e-12) AS cot FROM t"


@query("cotangent_weights", f"WITH {P}, {FACES}, {TRI}, k AS ({_cot(*'abc')} UNION ALL {_cot(*'bca')} UNION ALL {_cot(*'cab')}) SELECT specimen_id, lo, hi, {r('w=sum(cot)/2', digits=4)} FROM k GROUP BY 1, 2, 3")
def _(spark, sf):
    return rounded(mesh.cotangent_weights(vertices(spark, sf), bridge.faces(spark)), 4)


@query("dihedral_vertex", f"WITH {P}, {FACES}, {TRI}, {NORMAL}, {EDGES}, ef AS (SELECT least(u, v) AS lo, greatest(u, v) AS hi, min(fid) AS f1, max(fid) AS f2, count(*) AS k FROM e0 GROUP BY 1, 2), an AS (SELECT a.specimen_id, lo, hi, CASE WHEN k = 2 THEN acos(least(greatest(a.nx*c.nx+a.ny*c.ny+a.nz*c.nz, -1.0), 1.0)) ELSE 0.0 END AS angle FROM ef JOIN n a ON a.fid = f1 JOIN n c ON c.fid = f2 AND c.specimen_id = a.specimen_id), v AS (SELECT specimen_id, lo AS vid, angle FROM an UNION ALL SELECT specimen_id, hi, angle FROM an) SELECT specimen_id, vid, {r('dihedral=avg(angle)')} FROM v GROUP BY 1, 2")
def _(spark, sf):
    return rounded(mesh.mean_dihedral(vertices(spark, sf), bridge.faces(spark)))


_VN = "v0 AS (SELECT specimen_id, a AS vid, nx*area AS x, ny*area AS y, nz*area AS z FROM n UNION ALL SELECT specimen_id, b, nx*area, ny*area, nz*area FROM n UNION ALL SELECT specimen_id, c, nx*area, ny*area, nz*area FROM n), v1 AS (SELECT specimen_id, vid, sum(x) AS x, sum(y) AS y, sum(z) AS z FROM v0 GROUP BY 1, 2), vn AS (SELECT specimen_id, vid, x/(sqrt(x*x+y*y+z*z)+1e-12) AS nx, y/(sqrt(x*x+y*y+z*z)+1e-12) AS ny, z/(sqrt(x*x+y*y+z*z)+1e-12) AS nz FROM v1)"


@query("normal_variation", f"WITH {P}, {FACES}, {TRI}, {NORMAL}, {EDGES}, {_VN} SELECT a.specimen_id, a.vid, {r('variation=avg(acos(least(greatest(a.nx*c.nx+a.ny*c.ny+a.nz*c.nz, -1.0), 1.0)))')} FROM vn a JOIN adj ON src = a.vid JOIN vn c ON c.vid = dst AND c.specimen_id = a.specimen_id GROUP BY 1, 2")
def _(spark, sf):
    return rounded(mesh.normal_variation(vertices(spark, sf), bridge.faces(spark)))


def _angle(o, i, j):
    c = lambda k, n: "by_" if k + n == "by" else k + n
    u, v = ([f"({c(k, n)}-{c(o, n)})" for n in "xyz"] for k in (i, j))
    dot = lambda a, b: "+".join(f"{x}*{y}" for x, y in zip(a, b, strict=True))
    return f"SELECT specimen_id, {o} AS vid, acos(least(greatest(({dot(u, v)})/(sqrt({dot(u, u)})*sqrt({dot(v, v)})+1e-12), -1.0), 1.0)) AS angle FROM t"


@query("curvature", f"WITH {P}, {FACES}, {TRI}, {NORMAL}, k AS ({_cot(*'abc')} UNION ALL {_cot(*'bca')} UNION ALL {_cot(*'cab')}), cw AS (SELECT specimen_id, lo, hi, sum(cot)/2 AS w FROM k GROUP BY 1, 2, 3), ew AS (SELECT specimen_id, lo AS vid, hi AS o, w FROM cw UNION ALL SELECT specimen_id, hi, lo, w FROM cw), l AS (SELECT ew.specimen_id, vid, {', '.join(f'sum(w*(q.{c}-p.{c})) AS {c}' for c in 'xyz')} FROM ew JOIN p ON p.specimen_id = ew.specimen_id AND p.pidx = vid JOIN p q ON q.specimen_id = ew.specimen_id AND q.pidx = o GROUP BY 1, 2), an AS ({_angle(*'abc')} UNION ALL {_angle(*'bca')} UNION ALL {_angle(*'cab')}), df AS (SELECT specimen_id, vid, 2*pi() - sum(angle) AS defect FROM an GROUP BY 1, 2), c3 AS (SELECT specimen_id, unnest([a, b, c]) AS vid, area FROM n), ar AS (SELECT specimen_id, vid, greatest(sum(area/3), 1e-12) AS area FROM c3 GROUP BY 1, 2) SELECT specimen_id, vid, {r('mean_curvature=sqrt(x*x+y*y+z*z)/(2*area)', 'gauss_curvature=defect/area', digits=4)} FROM l JOIN df USING (specimen_id, vid) JOIN ar USING (specimen_id, vid)")
def _(spark, sf):
    return rounded(mesh.curvature(vertices(spark, sf), bridge.faces(spark)), 4)


@query("outward_normals", f"WITH {P}, {FACES}, {TRI}, {NORMAL}, {_VN}, m AS (SELECT specimen_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM p GROUP BY 1) SELECT vn.specimen_id, vid, {r(*(f'n{c}=CASE WHEN nx*(p.x-m.x)+ny*(p.y-m.y)+nz*(p.z-m.z) < 0 THEN -n{c} ELSE n{c} END' for c in 'xyz'))} FROM vn JOIN p ON p.specimen_id = vn.specimen_id AND pidx = vid JOIN m ON m.specimen_id = vn.specimen_id")
def _(spark, sf):
    v = vertices(spark, sf)
    return rounded(mesh.outward(v.join(mesh.vertex_normals(v, bridge.faces(spark)), ["specimen_id", "vid"])).drop("x", "y", "z"))


@query("ring_pool_median", f"WITH {P}, {FACES}, {EDGES}, g AS (SELECT src, dst FROM adj UNION SELECT src, src FROM adj) SELECT specimen_id, src AS vid, 0 AS fidx, {r('v=median(x)')} FROM g JOIN p ON pidx = dst GROUP BY 1, 2")
def _(spark, sf):
    values = vertices(spark, sf).select("specimen_id", "vid", F.lit(0).alias("fidx"), F.col("x").alias("v"))
    return rounded(mesh.pooled_median(values, bridge.faces(spark)))


@query("mesh_smoothing", f"WITH {P}, {FACES}, {EDGES}, m AS (SELECT specimen_id, src, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM adj JOIN p ON pidx = dst GROUP BY 1, 2) SELECT p.specimen_id, pidx AS vid, {r(*(f'{c}=p.{c}+0.5*(m.{c}-p.{c})' for c in 'xyz'))} FROM p JOIN m ON m.specimen_id = p.specimen_id AND src = pidx")
def _(spark, sf):
    return rounded(mesh.smooth(vertices(spark, sf), bridge.faces(spark)))


@query("shape_index", f"WITH {P}, k AS (SELECT specimen_id, pidx, x + sqrt(greatest(x*x-y, 0.0)) AS a, x - sqrt(greatest(x*x-y, 0.0)) AS b FROM p), o AS (SELECT specimen_id, pidx, CASE WHEN abs(a) >= abs(b) THEN a ELSE b END AS k1, CASE WHEN abs(a) >= abs(b) THEN b ELSE a END AS k2 FROM k) SELECT specimen_id, pidx, {r('k1', 'k2', 's=2.0/pi()*atan2(k1+k2, k1-k2+1e-12)', 'c=sqrt((k1*k1+k2*k2)/2)')} FROM o")
def _(spark, sf):
    k1, k2 = g.principal_curvatures(F.col("x"), F.col("y"))
    p = bridge.points(spark, sf).select("specimen_id", "pidx", k1.alias("k1"), k2.alias("k2"))
    return rounded(p.withColumn("s", g.shape_index(F.col("k1"), F.col("k2"))).withColumn("c", g.curvedness(F.col("k1"), F.col("k2"))))



@query("barycentric", f"""WITH {P}, {FACES}, {TRI}, c0 AS (SELECT specimen_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM p GROUP BY 1),
u AS (SELECT t.specimen_id, fid, bx-ax AS ux, by_-ay AS uy, bz-az AS uz, cx-ax AS vx, cy-ay AS vy, cz-az AS vz, c0.x-ax AS wx, c0.y-ay AS wy, c0.z-az AS wz FROM t JOIN c0 USING (specimen_id)),
d AS (SELECT specimen_id, fid, ux*ux+uy*uy+uz*uz AS uu, ux*vx+uy*vy+uz*vz AS uv, vx*vx+vy*vy+vz*vz AS vv, wx*ux+wy*uy+wz*uz AS wu, wx*vx+wy*vy+wz*vz AS wv FROM u),
b AS (SELECT specimen_id, fid, CASE WHEN abs(uu*vv-uv*uv) <= 1e-12 THEN 0.0 ELSE (vv*wu-uv*wv)/(uu*vv-uv*uv) END AS beta, CASE WHEN abs(uu*vv-uv*uv) <= 1e-12 THEN 0.0 ELSE (uu*wv-uv*wu)/(uu*vv-uv*uv) END AS gamma FROM d)
SELECT specimen_id, fid, {r('wa=1-beta-gamma', 'wb=beta', 'wc=gamma', digits=4)} FROM b""")
def _(spark, sf):
    p = bridge.points(spark, sf)
    mid = points.centroid(p, "specimen_id").select("specimen_id", *(F.col(c).alias(f"p{c}") for c in "xyz"))
    tri = mesh.corners(vertices(spark, sf), bridge.faces(spark)).join(mid, "specimen_id")
    w = g.barycentric(*(g.vector(c) for c in "pabc"))
    return rounded(tri.select("specimen_id", "fid", *(x.alias(f"w{c}") for x, c in zip(w, "abc", strict=True))), 4)


# --- segmentation -----------------------------------------------------------

FEAT = "ft AS (SELECT specimen_id, pidx, 0 AS fidx, x AS v FROM p UNION ALL SELECT specimen_id, pidx, 1, y FROM p UNION ALL SELECT specimen_id, pidx, 2, z FROM p)"


def features(spark, sf):
    rows = F.inline(F.array(*(F.struct(F.lit(k).alias("fidx"), F.col(c).alias("v")) for k, c in enumerate("xyz"))))
    return bridge.points(spark, sf).select("specimen_id", "pidx", rows)


@query("zscore_features", f"WITH {P}, {FEAT} SELECT specimen_id, pidx, fidx, {r('v=(v - avg(v) OVER (PARTITION BY specimen_id, fidx)) / (stddev_pop(v) OVER (PARTITION BY specimen_id, fidx) + 1e-8)')} FROM ft")
def _(spark, sf):
    return rounded(segmentation.z_scores(features(spark, sf)))


@query("feature_cleaning", f"WITH {P}, {FEAT}, g AS (SELECT specimen_id, pidx, fidx, CASE WHEN v <= 0.3 THEN v END AS v FROM ft), m AS (SELECT fidx, median(v) AS m FROM g GROUP BY 1) SELECT specimen_id, pidx, fidx, {r('v=coalesce(v, m)')} FROM g JOIN m USING (fidx)")
def _(spark, sf):
    return rounded(segmentation.clean(features(spark, sf).withColumn("v", F.when(F.col("v") > 0.3, F.lit(float("nan"))).otherwise(F.col("v")))))


_EF = "fd AS (SELECT lo AS src, hi AS dst, a.specimen_id, sum((a.v-b.v)*(a.v-b.v)) AS d2 FROM e JOIN ft a ON a.pidx = lo JOIN ft b ON b.pidx = hi AND b.specimen_id = a.specimen_id AND b.fidx = a.fidx GROUP BY 1, 2, 3), fe AS (SELECT src, dst, sqrt(median(d2) + 1e-12) AS df FROM fd GROUP BY 1, 2)"


def _feature_edges(spark, sf):
    edges = mesh.unique_edges(bridge.faces(spark)).select(F.col("lo").alias("src"), F.col("hi").alias("dst"))
    return segmentation.edge_feature_median(features(spark, sf), edges)


@query("edge_feature_median", f"WITH {P}, {FEAT}, {FACES}, {EDGES}, {_EF} SELECT src, dst, {r('df')} FROM fe")
def _(spark, sf):
    return rounded(_feature_edges(spark, sf))


_NS = "ns AS (SELECT node, median(df) AS sigma FROM (SELECT src AS node, df FROM fe UNION ALL SELECT dst, df FROM fe) GROUP BY 1)"


@query("node_sigma", f"WITH {P}, {FEAT}, {FACES}, {EDGES}, {_EF}, {_NS} SELECT node, {r('sigma')} FROM ns")
def _(spark, sf):
    return rounded(segmentation.node_sigma(_feature_edges(spark, sf)))


_LK = "m AS (SELECT pidx, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM p GROUP BY 1), ex AS (SELECT src, dst, df, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS dx FROM fe JOIN m a ON a.pidx = src JOIN m b ON b.pidx = dst), lk AS (SELECT src, dst, 0.7*exp(-df*df/(i.sigma*j.sigma+1e-12)) + 0.3*exp(-dx*dx/((SELECT median(dx) FROM ex)*(SELECT median(dx) FROM ex))) AS w FROM ex JOIN ns i ON i.node = src JOIN ns j ON j.node = dst)"


def _locus_edges(spark, sf):
    mean = points.mean_shape(bridge.points(spark, sf))
    ends = [mean.select(F.col("pidx").alias(n), *(F.col(c).alias(f"{n[0]}{c}") for c in "xyz")) for n in ("src", "dst")]
    # what the kernel and the walk on it read many times are as many rows as the topology has edges, found once
    return cut(_feature_edges(spark, sf).join(ends[0], "src").join(ends[1], "dst").select("src", "dst", "df", g.norm(g.minus(g.vector("s"), g.vector("d"))).alias("dx")))


@query("locus_kernel", f"WITH {P}, {FEAT}, {FACES}, {EDGES}, {_EF}, {_NS}, {_LK} SELECT src, dst, {r('w')} FROM lk")
def _(spark, sf):
    return rounded(segmentation.locus_kernel(_locus_edges(spark, sf), 0.7))


def _both(edges):
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


_BW = "bw AS (SELECT src, dst, w FROM lk UNION ALL SELECT dst, src, w FROM lk)"


@query("weighted_degree", f"WITH {P}, {FEAT}, {FACES}, {EDGES}, {_EF}, {_NS}, {_LK}, {_BW} SELECT src, {r('degree=sum(w)')} FROM bw GROUP BY 1")
def _(spark, sf):
    return rounded(segmentation.weighted_degree(_both(segmentation.locus_kernel(_locus_edges(spark, sf), 0.7))))


def _thirds(spark):
    return spark.range(bridge.N_POINTS).select(F.col("id").cast("int").alias("pidx"), F.floor(F.col("id") / 7).cast("int").alias("label"))


@query("modularity", f"WITH {P}, {FEAT}, {FACES}, {EDGES}, {_EF}, {_NS}, {_LK}, {_BW}, c AS (SELECT src // 7 AS l, sum(CASE WHEN src // 7 = dst // 7 THEN w ELSE 0.0 END) AS i, sum(w) AS k FROM bw GROUP BY 1), tt AS (SELECT sum(w) AS t FROM bw) SELECT {r('modularity=sum(i/t - (k/t)*(k/t))')} FROM c, tt")
def _(spark, sf):
    return rounded(segmentation.modularity(_both(segmentation.locus_kernel(_locus_edges(spark, sf), 0.7)), _thirds(spark)))


@query("majority_vote", f"WITH {P}, {KNN}, ed AS (SELECT DISTINCT qidx AS src, tidx AS dst FROM nn WHERE rank <= 2), v AS (SELECT src, dst % 3 AS label, count(*) AS n FROM ed GROUP BY 1, 2), w AS (SELECT src, label FROM v QUALIFY row_number() OVER (PARTITION BY src ORDER BY n DESC, label) = 1) SELECT i::INTEGER AS pidx, coalesce(label, i % 3)::INTEGER AS label FROM range(0, 21) t(i) LEFT JOIN w ON src = i")
def _(spark, sf):
    p = bridge.points(spark, sf)
    edges = neighbors.k_nearest(p, p, 2, same=True).select(F.col("qidx").cast("int").alias("src"), F.col("tidx").cast("int").alias("dst"))
    labels = spark.range(bridge.N_POINTS).select(F.col("id").cast("int").alias("pidx"), (F.col("id") % 3).cast("int").alias("label"))
    return segmentation.majority_vote(edges, labels)


# --- collections ------------------------------------------------------------


@query("pair_specimens", "SELECT doc_id, n_chars, quality FROM documents JOIN labels USING (doc_id)")
def _(spark, sf):
    return pairing.pair(bridge.table(spark, sf, "documents").select("doc_id", "n_chars"), bridge.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


@query("unpaired_specimens", "SELECT doc_id, n_chars FROM documents ANTI JOIN labels USING (doc_id)")
def _(spark, sf):
    return pairing.unpaired(bridge.table(spark, sf, "documents").select("doc_id", "n_chars"), bridge.table(spark, sf, "labels"), "doc_id")


@query("lookup_optional", "SELECT doc_id, n_chars, quality FROM documents LEFT JOIN labels USING (doc_id)")
def _(spark, sf):
    return pairing.with_optional(bridge.table(spark, sf, "documents").select("doc_id", "n_chars"), bridge.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


@query("pair_readiness", "SELECT (SELECT count(*) FROM documents SEMI JOIN labels USING (doc_id)) AS both, (SELECT count(*) FROM documents ANTI JOIN labels USING (doc_id)) AS only_left, (SELECT count(*) FROM labels ANTI JOIN documents USING (doc_id)) AS only_right")
def _(spark, sf):
    return pairing.readiness(bridge.table(spark, sf, "documents"), bridge.table(spark, sf, "labels"), "doc_id")


@query("latest_complete_set", "SELECT source, max(doc_id) AS seq FROM documents WHERE lang IN ('de', 'en', 'es') GROUP BY 1 HAVING count(DISTINCT lang) = 3 ORDER BY seq DESC, source DESC LIMIT 1")
def _(spark, sf):
    return pairing.latest_complete(bridge.table(spark, sf, "documents"), "source", "lang", "doc_id", ["de", "en", "es"])


@query("key_index", "SELECT regexp_extract(url, '://([^/?#]*)', 1) AS key, max(url) AS path, count(*) - 1 AS duplicates FROM pages GROUP BY 1")
def _(spark, sf):
    return pairing.unique_keys(bridge.table(spark, sf, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("key"), F.col("url").alias("path")), "key", "path")


@query("key_normalize", "SELECT page_id, regexp_replace(regexp_replace(lower(regexp_extract(url, '[^/]*$') || CASE page_id % 3 WHEN 0 THEN '.PLY' WHEN 1 THEN '.mrk.json' ELSE '.fcsv' END), '(\\.(json|mrk|fcsv))+$', ''), '\\.(ply|stl|vtp|vtk|obj)$', '') AS key FROM pages")
def _(spark, sf):
    tail = F.when(F.col("page_id") % 3 == 0, ".PLY").when(F.col("page_id") % 3 == 1, ".mrk.json").otherwise(".fcsv")
    return bridge.table(spark, sf, "pages").select("page_id", g.normalise_key(F.concat(F.regexp_extract("url", "[^/]*$", 0), tail)).alias("key"))


@query("safe_name", "SELECT page_id, NOT regexp_matches(n, '[\\x00-\\x1f<>:\"/\\\\|?*]') AND NOT regexp_matches(n, '[. ]$') AND trim(n) <> '' AND upper(regexp_extract(n, '^([^.]*)', 1)) NOT IN ('CON', 'PRN', 'AUX', 'NUL') AS safe FROM (SELECT page_id, regexp_extract(url, '[^/]*$') AS n FROM pages)")
def _(spark, sf):
    return bridge.table(spark, sf, "pages").select("page_id", g.safe_name(F.regexp_extract("url", "[^/]*$", 0)).alias("safe"))


@query("json_attributes", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def _(spark, sf):
    return readers.json_attribute(bridge.table(spark, sf, "events"), "props", "k").select("event_id", F.col("value").alias("k"))


_GK = _LK.replace("0.7*exp", "alpha*exp").replace("0.3*exp", "(1-alpha)*exp").replace("AS w FROM ex", "AS w, alpha FROM (SELECT unnest([0.5, 0.7])::DOUBLE AS alpha) al, ex") + ", bw AS (SELECT src, dst, w, alpha FROM lk UNION ALL SELECT dst, src, w, alpha FROM lk)"


@query("parameter_grid", f"WITH {P}, {FEAT}, {FACES}, {EDGES}, {_EF}, {_NS}, {_GK}, c AS (SELECT alpha, k, src * k // 21 AS l, sum(CASE WHEN src * k // 21 = dst * k // 21 THEN w ELSE 0.0 END) AS i, sum(w) AS d FROM bw, (SELECT unnest([8, 12, 15]) AS k) ks GROUP BY 1, 2, 3), tt AS (SELECT alpha, sum(w) AS t FROM bw GROUP BY 1) SELECT k::INTEGER AS k, alpha, {r('modularity=sum(i/t - (d/t)*(d/t))')} FROM c JOIN tt USING (alpha) GROUP BY 1, 2")
def _(spark, sf):
    grid = segmentation.parameter_grid(spark, [8, 12, 15], [0.5, 0.7])
    label = F.floor(F.col("pidx") * F.col("k") / bridge.N_POINTS).cast("int")
    labels = grid.select("k").distinct().crossJoin(_thirds(spark).select("pidx")).withColumn("label", label)
    return rounded(segmentation.grid_modularity(_locus_edges(spark, sf), grid, labels))


_IN = "(bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)+(bz-az)*(bz-az) AS uu, (bx-ax)*(cx-ax)+(by_-ay)*(cy-ay)+(bz-az)*(cz-az) AS uv, (cx-ax)*(cx-ax)+(cy-ay)*(cy-ay)+(cz-az)*(cz-az) AS vv, (qx-ax)*(bx-ax)+(qy-ay)*(by_-ay)+(qz-az)*(bz-az) AS wu, (qx-ax)*(cx-ax)+(qy-ay)*(cy-ay)+(qz-az)*(cz-az) AS wv"


def _edge(i, j):
    y = {"a": "ay", "b": "by_", "c": "cy"}
    e = [f"({j}x-{i}x)", f"({y[j]}-{y[i]})", f"({j}z-{i}z)"]
    s = [f"(qx-{i}x)", f"(qy-{y[i]})", f"(qz-{i}z)"]
    t = f"least(greatest(({'+'.join(f'{a}*{b}' for a, b in zip(s, e, strict=True))})/greatest({'+'.join(f'{a}*{a}' for a in e)}, 1e-300), 0.0), 1.0)"
    return "+".join(f"({a}-{t}*{b})*({a}-{t}*{b})" for a, b in zip(s, e, strict=True))


_CLOSEST_SQL = f"WITH {P}, {FACES}, {TRI}, k AS (SELECT t.*, p.pidx AS qidx, 0.5*p.x AS qx, 0.5*p.y AS qy, 0.5*p.z AS qz FROM t JOIN p USING (specimen_id)), i AS (SELECT *, {_IN} FROM k), w AS (SELECT *, (vv*wu-uv*wv)/(uu*vv-uv*uv) AS beta, (uu*wv-uv*wu)/(uu*vv-uv*uv) AS gamma FROM i), d AS (SELECT specimen_id, qidx, least({_edge('a', 'b')}, {_edge('b', 'c')}, {_edge('c', 'a')}, CASE WHEN beta >= 0 AND gamma >= 0 AND beta+gamma <= 1 THEN power(qx-ax-beta*(bx-ax)-gamma*(cx-ax), 2)+power(qy-ay-beta*(by_-ay)-gamma*(cy-ay), 2)+power(qz-az-beta*(bz-az)-gamma*(cz-az), 2) END) AS d2 FROM w), m AS (SELECT specimen_id, qidx, min(d2) AS d2 FROM d GROUP BY 1, 2)"


def _shrunk(spark, sf):
    return points.transform(bridge.points(spark, sf), g.similarity_matrix([[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], 0.5, [0.0, 0.0, 0.0]))


@query("closest_surface_point", f"{_CLOSEST_SQL} SELECT specimen_id, qidx::BIGINT AS qidx, {r('d2')} FROM m")
def _(spark, sf):
    return rounded(surfaces.closest_points(_shrunk(spark, sf), vertices(spark, sf), bridge.faces(spark)).select("specimen_id", "qidx", "d2"))


@query("surface_distance", f"{_CLOSEST_SQL} SELECT specimen_id, {r('median_distance=median(sqrt(d2))')} FROM m GROUP BY 1")
def _(spark, sf):
    return rounded(surfaces.surface_distance(_shrunk(spark, sf), vertices(spark, sf), bridge.faces(spark)))


_REACH = "rc AS (SELECT specimen_id, pidx AS node, pidx AS reached FROM p UNION SELECT rc.specimen_id, rc.node, sd.dst FROM rc JOIN sd ON sd.specimen_id = rc.specimen_id AND sd.src = rc.reached)"
_STEPS = f"sh AS (SELECT p.specimen_id, lo, hi FROM e JOIN p ON p.pidx = lo JOIN p q ON q.pidx = hi AND q.specimen_id = p.specimen_id WHERE {D2} < 0.3*0.3), sd AS (SELECT specimen_id, lo AS src, hi AS dst FROM sh UNION ALL SELECT specimen_id, hi, lo FROM sh)"


@query("edge_components", f"WITH RECURSIVE {P}, {FACES}, {EDGES}, {_STEPS}, {_REACH} SELECT specimen_id, node::BIGINT AS node, min(reached)::BIGINT AS component FROM rc GROUP BY 1, 2")
def _(spark, sf):
    """What each mesh falls into without its long edges."""
    v = vertices(spark, sf)
    e = mesh.unique_edges(bridge.faces(spark))
    for c in ("lo", "hi"):
        e = e.join(v.select("specimen_id", F.col("vid").alias(c), *(F.col(n).alias(f"{c}{n}") for n in "xyz")), [c, *(["specimen_id"] if c == "hi" else [])])
    short = e.where(g.distance2(g.vector("lo"), g.vector("hi")) < 0.3 * 0.3)
    number = lambda c, name: F.col(c).cast("long").alias(name)
    return shells.components(v.select("specimen_id", number("vid", "node")), short.select("specimen_id", number("lo", "src"), number("hi", "dst")), "specimen_id")


_MERGE = f"sd AS (SELECT p.specimen_id, p.pidx AS src, q.pidx AS dst FROM p JOIN p q ON p.specimen_id = q.specimen_id AND p.pidx <> q.pidx WHERE {D2} <= 0.12*0.12), {_REACH}, mg AS (SELECT specimen_id, node AS vid, min(reached) AS into_ FROM rc GROUP BY 1, 2)"


@query("merged_vertices", f"WITH RECURSIVE {P}, {_MERGE} SELECT specimen_id, vid::BIGINT AS vid, into_::BIGINT AS into_vid FROM mg")
def _(spark, sf):
    return shells.coincident(vertices(spark, sf), 0.12).withColumnRenamed("into", "into_vid")


@query("cleaned_mesh", f"WITH RECURSIVE {P}, {FACES}, {_MERGE}, nf AS (SELECT specimen_id, fid, x.into_ AS a, y.into_ AS b, z.into_ AS c FROM f JOIN mg x ON x.vid = a JOIN mg y USING (specimen_id) JOIN mg z USING (specimen_id) WHERE y.vid = f.b AND z.vid = f.c), kf AS (SELECT * FROM nf WHERE a <> b AND b <> c AND a <> c QUALIFY row_number() OVER (PARTITION BY specimen_id, list_sort([a, b, c]) ORDER BY fid) = 1) SELECT specimen_id, fid::INTEGER AS fid, a::BIGINT AS a, b::BIGINT AS b, c::BIGINT AS c FROM kf")
def _(spark, sf):
    return shells.cleaned(vertices(spark, sf), bridge.faces(spark), 0.12)[1]


@query("surface_sides", f"{_CLOSEST_SQL} SELECT specimen_id, qidx::BIGINT AS pidx, {r('d2')}, 1.0::DOUBLE AS norm FROM m")
def _(spark, sf):
    d = shells.signed_distance(_shrunk(spark, sf), vertices(spark, sf), bridge.faces(spark))
    return rounded(d.select("specimen_id", "pidx", (F.col("d") * F.col("d")).alias("d2"), g.norm(g.vector("n")).alias("norm")))


_FPFH = (
    "nr AS (SELECT p.specimen_id, p.pidx AS q, t.pidx AS t, {D2T} AS d2 FROM p JOIN p t ON p.specimen_id = t.specimen_id AND p.pidx <> t.pidx WHERE {D2T} <= 0.25 QUALIFY row_number() OVER (PARTITION BY p.specimen_id, p.pidx ORDER BY {D2T}, t.pidx) <= 8),"
    " l0 AS (SELECT nr.*, b.x-a.x AS lx, b.y-a.y AS ly, b.z-a.z AS lz, sqrt(d2) AS size, i.nx AS ix, i.ny AS iy, i.nz AS iz, j.nx AS jx, j.ny AS jy, j.nz AS jz FROM nr JOIN p a ON a.specimen_id = nr.specimen_id AND a.pidx = q JOIN p b ON b.specimen_id = nr.specimen_id AND b.pidx = t JOIN vn i ON i.specimen_id = nr.specimen_id AND i.vid = q JOIN vn j ON j.specimen_id = nr.specimen_id AND j.vid = t),"
    " l1 AS (SELECT *, (ix*lx+iy*ly+iz*lz)/size AS a1, (jx*lx+jy*ly+jz*lz)/size AS a2 FROM l0),"
    " l2 AS (SELECT *, CASE WHEN abs(a1) < abs(a2) THEN jx ELSE ix END AS ux, CASE WHEN abs(a1) < abs(a2) THEN ix ELSE jx END AS mx, CASE WHEN abs(a1) < abs(a2) THEN -lx ELSE lx END AS ox, CASE WHEN abs(a1) < abs(a2) THEN jy ELSE iy END AS uy, CASE WHEN abs(a1) < abs(a2) THEN iy ELSE jy END AS my, CASE WHEN abs(a1) < abs(a2) THEN -ly ELSE ly END AS oy, CASE WHEN abs(a1) < abs(a2) THEN jz ELSE iz END AS uz, CASE WHEN abs(a1) < abs(a2) THEN iz ELSE jz END AS mz, CASE WHEN abs(a1) < abs(a2) THEN -lz ELSE lz END AS oz, CASE WHEN abs(a1) < abs(a2) THEN -a2 ELSE a1 END AS rise FROM l1),"
    " l3 AS (SELECT *, oy*uz-oz*uy AS vx, oz*ux-ox*uz AS vy, ox*uy-oy*ux AS vz FROM l2),"
    " l4 AS (SELECT * REPLACE (vx/sqrt(vx*vx+vy*vy+vz*vz) AS vx, vy/sqrt(vx*vx+vy*vy+vz*vz) AS vy, vz/sqrt(vx*vx+vy*vy+vz*vz) AS vz) FROM l3),"
    " l5 AS (SELECT *, uy*vz-uz*vy AS wx, uz*vx-ux*vz AS wy, ux*vy-uy*vx AS wz FROM l4),"
    " ce AS (SELECT specimen_id, q, t, d2, [(atan2(wx*mx+wy*my+wz*mz, ux*mx+uy*my+uz*mz)+pi())/(2*pi()), (vx*mx+vy*my+vz*mz+1)*0.5, (rise+1)*0.5] AS sh FROM l5),"
    " c1 AS (SELECT specimen_id, q, unnest([0, 1, 2]) AS k, unnest(sh) AS share FROM ce),"
    " c2 AS (SELECT specimen_id, q, (11*k + least(greatest(floor(11*share), 0), 10))::INTEGER AS fidx FROM c1),"
    " ow AS (SELECT specimen_id, q, fidx, count(*)*100.0/any_value(n) AS v FROM c2 JOIN (SELECT specimen_id, q, count(*) AS n FROM nr GROUP BY 1, 2) USING (specimen_id, q) GROUP BY 1, 2, 3),"
    " wg AS (SELECT nr.specimen_id, nr.q, fidx, sum(v/d2) AS v FROM nr JOIN ow ON ow.specimen_id = nr.specimen_id AND ow.q = t GROUP BY 1, 2, 3),"
    " sc AS (SELECT specimen_id, q, fidx, 100.0*v/sum(v) OVER (PARTITION BY specimen_id, q, fidx // 11) AS v FROM wg),"
    " fh AS (SELECT specimen_id, q AS pidx, fidx, sum(v) AS v FROM (FROM ow UNION ALL FROM sc) GROUP BY 1, 2, 3)"
).replace("{D2T}", D2.replace("q.", "t."))


@query("fpfh", f"WITH {P}, {FACES}, {TRI}, {NORMAL}, {_VN}, {_FPFH} SELECT specimen_id, pidx, fidx, {r('v', digits=4)} FROM fh")
def _(spark, sf):
    v, f = vertices(spark, sf), bridge.faces(spark)
    both = v.join(mesh.vertex_normals(v, f), ["specimen_id", "vid"]).withColumnRenamed("vid", "pidx")
    return rounded(histograms.fpfh(both, 0.5, 8), 4)


@query("coordinate_check", f"WITH {P}, {BOX}, a AS (SELECT p.specimen_id, p.pidx, min({D2}) AS d2 FROM p JOIN p q ON p.specimen_id = q.specimen_id WHERE p.pidx < 7 AND q.pidx >= 7 GROUP BY 1, 2), f AS (SELECT p.specimen_id, p.pidx, min((-p.x-q.x)*(-p.x-q.x)+(-p.y-q.y)*(-p.y-q.y)+(p.z-q.z)*(p.z-q.z)) AS d2 FROM p JOIN p q ON p.specimen_id = q.specimen_id WHERE p.pidx < 7 AND q.pidx >= 7 GROUP BY 1, 2), x AS (SELECT specimen_id, median(sqrt(a.d2)) / any_value(diagonal) AS ratio, median(sqrt(f.d2)) / any_value(diagonal) AS flipped_ratio FROM a JOIN f USING (specimen_id, pidx) JOIN b USING (specimen_id) GROUP BY 1) SELECT specimen_id, {r('ratio', 'flipped_ratio')}, ratio > 0.2 AS failed, ratio > 0.2 AND flipped_ratio < 0.5 * ratio AND flipped_ratio < 0.2 AS hint_lps FROM x".replace(", ratio > 0.2 AS failed, ratio > 0.2 AND flipped_ratio < 0.5 * ratio AND flipped_ratio < 0.2", ", x.ratio > 0.2 AS failed, x.ratio > 0.2 AND x.flipped_ratio < 0.5 * x.ratio AND x.flipped_ratio < 0.2"))
def _(spark, sf):
    p = bridge.points(spark, sf)
    marks, rest = p.where("pidx < 7"), p.where("pidx >= 7")
    flipped = marks.withColumn("x", -F.col("x")).withColumn("y", -F.col("y"))
    d = [neighbors.k_nearest(m, rest, 1).select("specimen_id", F.sqrt("d2").alias("d")) for m in (marks, flipped)]
    return rounded(points.coordinate_check(*d, points.bounds(p, "specimen_id"), 0.2))


_MODES = "m AS (SELECT pidx, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM p GROUP BY 1), pm AS (SELECT population AS mode, pidx, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM p GROUP BY 1, 2), d AS (SELECT mode, pidx, pm.x - m.x AS x, pm.y - m.y AS y, pm.z - m.z AS z FROM pm JOIN m USING (pidx))"


def _population_modes(p):
    """What sets each population's mean apart from the mean of all, as a mode."""
    mean = points.mean_shape(p).select("pidx", *(F.col(c).alias(f"m{c}") for c in "xyz"))
    return points.mean_shape(p, "population").join(mean, "pidx").select(F.col("population").alias("mode"), "pidx", *((F.col(c) - F.col(f"m{c}")).alias(c) for c in "xyz"))


@query("rotate_modes", f"WITH {P}, {_MODES} SELECT mode, pidx, {r('x=-d.y', 'y=d.x', 'z=d.z')} FROM d")
def _(spark, sf):
    return rounded(shape_model.rotate(_population_modes(bridge.points(spark, sf)), [[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]]))


_COEF = "cf AS (SELECT p.specimen_id, d.mode, sum((p.x-m.x)*d.x+(p.y-m.y)*d.y+(p.z-m.z)*d.z) AS b FROM p JOIN m USING (pidx) JOIN d USING (pidx) GROUP BY 1, 2)"


@query("model_coefficients", f"WITH {P}, {_MODES}, {_COEF} SELECT specimen_id, mode, {r('b')} FROM cf")
def _(spark, sf):
    p = bridge.points(spark, sf)
    return rounded(shape_model.coefficients(p, points.mean_shape(p), _population_modes(p)))


_TV = "tv AS (SELECT mode, sum(v) AS v FROM (SELECT population AS mode, coalesce(var_samp(x), 0) + coalesce(var_samp(y), 0) + coalesce(var_samp(z), 0) AS v FROM p GROUP BY population, pidx) GROUP BY 1)"


@query("pose_diagnostics", f"WITH {P}, {BOX}, {_MODES}, {_COEF}, {_TV}, sb AS (SELECT specimen_id, b / sqrt(greatest(v, 1e-10)) AS b FROM cf JOIN tv USING (mode)), md AS (SELECT sqrt((max(x)-min(x))*(max(x)-min(x))+(max(y)-min(y))*(max(y)-min(y))+(max(z)-min(z))*(max(z)-min(z))) AS d FROM m), fa AS (SELECT specimen_id, sqrt(sum(b*b)) AS coefficient_norm, max(abs(b)) AS largest FROM sb GROUP BY 1) SELECT specimen_id, {r('coefficient_norm', 'largest', 'size_ratio=diagonal/md.d')} FROM fa JOIN b USING (specimen_id), md")
def _(spark, sf):
    p = bridge.points(spark, sf)
    v = shape_model.total_variance(p, "population").select(F.col("population").alias("mode"), F.col("variance").alias("v"))
    return rounded(shape_model.diagnostics(p, points.mean_shape(p), _population_modes(p), v))


_MISFIT = "mf AS (SELECT specimen_id, mode AS candidate, round(sum((p.x-pm.x)*(p.x-pm.x)+(p.y-pm.y)*(p.y-pm.y)+(p.z-pm.z)*(p.z-pm.z)), 9) AS ss FROM p JOIN pm USING (pidx) GROUP BY 1, 2)"


def _misfit(p):
    """Sum of squares between each specimen and each population's mean: candidates for its template."""
    mean = points.mean_shape(p, "population").select(F.col("population").alias("candidate"), "pidx", *(F.col(c).alias(f"m{c}") for c in "xyz"))
    return p.join(mean, "pidx").groupBy("specimen_id", "candidate").agg(F.round(F.sum(g.distance2(g.vector(), g.vector("m"))), 9).alias("ss"))


@query("candidate_beam", f"WITH {P}, {_MODES}, {_MISFIT} SELECT specimen_id, candidate, -{'round(ss, 6)'} + 0.0 AS score, (row_number() OVER (PARTITION BY specimen_id ORDER BY mf.ss, candidate))::INTEGER AS rank FROM mf QUALIFY row_number() OVER (PARTITION BY specimen_id ORDER BY mf.ss, candidate) <= 3")
def _(spark, sf):
    return rounded(template_search.beam(_misfit(bridge.points(spark, sf)).select("specimen_id", "candidate", (-F.col("ss")).alias("score")), 3))


@query("candidate_pruning", f"WITH {P}, {_MODES}, {_MISFIT}, be AS (SELECT specimen_id, 1 - min(ss) AS best FROM mf GROUP BY 1) SELECT specimen_id, candidate, {r('penalty=ss', 'best')} FROM mf JOIN be USING (specimen_id) WHERE 1 - ss > best - (0.05 * 0.6 + 1e-5)")
def _(spark, sf):
    scores = _misfit(bridge.points(spark, sf)).withColumnRenamed("ss", "penalty")
    best = scores.groupBy("specimen_id").agg((F.lit(1.0) - F.min("penalty")).alias("best"))
    return rounded(template_search.worth_scoring(scores, best, 0.6, 1e-5))


# --- what SQL does not express ----------------------------------------------


def _horn() -> str:
    """Aligned landmarks by Horn's quaternions: the largest root of a quartic by Newton's steps from above, and cofactors."""
    c = {f"{u}{v}": f"c{u}{v}" for u in "xyz" for v in "xyz"}
    k = [
        [f"({c['xx']}+{c['yy']}+{c['zz']})", f"({c['yz']}-{c['zy']})", f"({c['zx']}-{c['xz']})", f"({c['xy']}-{c['yx']})"],
        ["", f"({c['xx']}-{c['yy']}-{c['zz']})", f"({c['xy']}+{c['yx']})", f"({c['zx']}+{c['xz']})"],
        ["", "", f"(-{c['xx']}+{c['yy']}-{c['zz']})", f"({c['yz']}+{c['zy']})"],
        ["", "", "", f"(-{c['xx']}-{c['yy']}+{c['zz']})"],
    ]
    at = lambda i, j: f"k{min(i, j)}{max(i, j)}"
    lam = lambda i, j: f"({at(i, j)}-l)" if i == j else at(i, j)

    def det(m):
        if len(m) == 1:
            return m[0][0]
        return "(" + "+".join(f"{'-' if j % 2 else ''}1*{m[0][j]}*{det([row[:j] + row[j + 1 :] for row in m[1:]])}" for j in range(len(m))).replace("+-", "-") + ")"

    cof = lambda i, j: f"({'-' if (i + j) % 2 else ''}1*{det([[lam(a, b) for b in range(4) if b != j] for a in range(4) if a != i])})"
    rows = ", ".join(f"{k[i][j]} AS k{i}{j}" for i in range(4) for j in range(i, 4))
    step = "l - (l*l*l*l + c2*l*l + c1*l + c0) / nullif(4*l*l*l + 2*c2*l + c1, 0)"
    pick = " ".join(f"WHEN {i} THEN [{', '.join(f'f{min(i, j)}{max(i, j)}' for j in range(4))}]" for i in range(4))
    r = [["w*w+a*a-b*b-d*d", "2*(a*b-w*d)", "2*(a*d+w*b)"], ["2*(a*b+w*d)", "w*w-a*a+b*b-d*d", "2*(b*d-w*a)"], ["2*(a*d-w*b)", "2*(b*d+w*a)", "w*w-a*a-b*b+d*d"]]
    turned = [f"t{n} + s/q2*(({row[0]})*(p.x-sx)+({row[1]})*(p.y-sy)+({row[2]})*(p.z-sz))" for n, row in zip("xyz", r, strict=True)]
    return f"""m AS (SELECT pidx, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM p GROUP BY 1),
mo AS (SELECT specimen_id, {', '.join(f'avg(p.{u}) AS s{u}, avg(m.{u}) AS t{u}' for u in 'xyz')}, var_pop(p.x)+var_pop(p.y)+var_pop(p.z) AS spread, {', '.join(f'covar_pop(p.{u}, m.{v}) AS c{u}{v}' for u in 'xyz' for v in 'xyz')} FROM p JOIN m USING (pidx) GROUP BY 1),
n4 AS (SELECT *, {rows}, -2*({'+'.join(f'c{u}{v}*c{u}{v}' for u in 'xyz' for v in 'xyz')}) AS c2, -8*{det([[f'c{u}{v}' for v in 'xyz'] for u in 'xyz'])} AS c1 FROM mo),
n5 AS (SELECT *, {det([[at(i, j) for j in range(4)] for i in range(4)])} AS c0 FROM n4),
n6 AS (SELECT *, list_reduce(list_prepend(sqrt(-1.5*c2), [0.0 FOR i IN range(80)]), lambda l, i: coalesce({step}, l)) AS l FROM n5),
n7 AS (SELECT *, {', '.join(f'{cof(i, j)} AS f{i}{j}' for i in range(4) for j in range(i, 4))} FROM n6),
n8 AS (SELECT *, CASE list_position([abs(f00), abs(f11), abs(f22), abs(f33)], greatest(abs(f00), abs(f11), abs(f22), abs(f33))) - 1 {pick} END AS q, l / spread AS s FROM n7),
n9 AS (SELECT *, q[1] AS w, q[2] AS a, q[3] AS b, q[4] AS d, q[1]*q[1]+q[2]*q[2]+q[3]*q[3]+q[4]*q[4] AS q2 FROM n8),
al AS (SELECT p.specimen_id, p.pidx, {', '.join(f'{t} AS {n}' for t, n in zip(turned, 'xyz', strict=True))} FROM p JOIN n9 USING (specimen_id))"""


@query("similarity_align", f"WITH {P}, {_horn()} SELECT specimen_id, pidx, {r('x', 'y', 'z', digits=5)} FROM al")
def _(spark, sf):
    p = bridge.points(spark, sf)
    return rounded(registration.align(p, points.mean_shape(p)), 5)


@query("similarity_optimality", "SELECT vec_id AS specimen_id, 0.0::DOUBLE AS skew, 1.0::DOUBLE AS turn, true AS nearer FROM embeddings")
def _(spark, sf):
    p = bridge.points(spark, sf)
    return rounded(procrustes.optimality(p, points.mean_shape(p)))


@query("procrustes_mean", None)
def _(spark, sf):
    return rounded(registration.procrustes_mean(bridge.points(spark, sf)), 4)


@query("procrustes_settled", "SELECT 21::BIGINT AS landmarks, true AS settled")
def _(spark, sf):
    """Aligning all specimens to the mean and averaging gives the mean again, up to its size."""
    p = bridge.points(spark, sf)
    mean = registration.procrustes_mean(p, tolerance=1e-3)
    again = points.centroid(registration.align(p, mean), "pidx").select("pidx", *(F.col(c).alias(f"m{c}") for c in "xyz"))
    square = lambda u: F.sum(sum((F.col(f"{u}{c}") * F.col(f"{u}{c}") for c in "xyz"), F.lit(0.0)))
    both = mean.join(again, "pidx")
    size = both.agg(F.sqrt(square("") / square("m")).alias("size"))
    moved = F.max(F.greatest(*(F.abs(F.col(c) - F.col("size") * F.col(f"m{c}")) for c in "xyz")))
    return both.crossJoin(size).agg(F.count(F.lit(1)).alias("landmarks"), (moved < 2e-3).alias("settled"))  # size is one row


@query("tps_warp", None)
def _(spark, sf):
    p = bridge.points(spark, sf)
    return rounded(registration.tps_warp(p, points.mean_shape(p).where("pidx < 12")))


@query("tps_constraints", f"WITH {P}, m AS (SELECT pidx, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM p WHERE pidx < 12 GROUP BY 1) SELECT vec_id AS specimen_id, pidx, {r('x', 'y', 'z', digits=5)} FROM m, embeddings")
def _(spark, sf):
    """A spline without smoothing takes the constraints to their targets."""
    p = bridge.points(spark, sf)
    return rounded(registration.tps_warp(p, points.mean_shape(p).where("pidx < 12")).where("pidx < 12"), 5)


@query("biharmonic_warp", None)
def _(spark, sf):
    p = bridge.points(spark, sf)
    return rounded(registration.biharmonic_warp(p, points.mean_shape(p).where("pidx < 7"), bridge.faces(spark)))


@query("biharmonic_solved", "SELECT vec_id AS specimen_id, 0.0::DOUBLE AS miss, true AS solved FROM embeddings")
def _(spark, sf):
    """All meshes by conjugate gradients: constraints are met, and nothing of the system remains."""
    p = bridge.points(spark, sf)
    to = points.mean_shape(p).where("pidx < 7")
    got = biharmonic.warp(p, to, bridge.faces(spark), rounds=80)
    away = got.join(to.select("pidx", *(F.col(c).alias(f"t{c}") for c in "xyz")), "pidx", "left").withColumn("miss", F.when(F.col("tx").isNotNull(), g.norm(g.minus(g.vector(), g.vector("t")))))
    return rounded(away.groupBy("specimen_id").agg(F.max("miss").alias("miss"), (F.max("residual") <= 1e-8).alias("solved")))


@query("outside_projection", None)
def _(spark, sf):
    marks = _shrunk(spark, sf).select("specimen_id", "pidx", "x", "y", "z")
    return rounded(shells.outside_projection(marks, vertices(spark, sf), bridge.faces(spark), most=0.5), 4)


def _far(candidates: str, count: int) -> str:
    """SQL parts: of ``candidates`` (specimen_id, pidx, x, y, z), ``count`` chosen one by one in ``far``."""
    point = "{'d': %s, 'i': -q.pidx, 'x': q.x, 'y': q.y, 'z': q.z}"
    centre = point % "(q.x-m.x)*(q.x-m.x)+(q.y-m.y)*(q.y-m.y)+(q.z-m.z)*(q.z-m.z)"
    apart = point % "list_min(list_transform(l, lambda u: (q.x-u.x)*(q.x-u.x)+(q.y-u.y)*(q.y-u.y)+(q.z-u.z)*(q.z-u.z)))"
    return f"far AS (SELECT specimen_id, 1 AS step, [max({centre})] AS l FROM {candidates} q JOIN (SELECT specimen_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM {candidates} GROUP BY 1) m USING (specimen_id) GROUP BY 1 UNION ALL SELECT specimen_id, step + 1, list_append(l, max({apart})) FROM far JOIN {candidates} q USING (specimen_id) WHERE step < {count} AND NOT list_contains(list_transform(l, lambda u: u.i), -q.pidx) GROUP BY specimen_id, step, l), last AS (SELECT specimen_id, unnest(l) AS u FROM far WHERE step = {count})"


@query("farthest_point", f"WITH RECURSIVE {P}, {_far('p', 7)} SELECT specimen_id, (-u.i)::INTEGER AS pidx FROM last")
def _(spark, sf):
    return sampling.farthest(bridge.points(spark, sf), 7)


def _bisected(over: str, better: str, enough: str) -> str:
    """SQL parts: the bisection of voxel sizes a step at a time, its end in ``found``."""
    keys = ", ".join(f"floor((p.{c} - b.i{c}) / sqrt(small * large))" for c in "xyz")
    counted = f"(SELECT s.specimen_id, step, small, large, best_size, best_n, sqrt(small * large) AS size, count(DISTINCT ({keys})) AS n FROM s JOIN p USING (specimen_id) JOIN b USING (specimen_id) WHERE s.open AND step < 40 GROUP BY ALL)"
    return f"{BOX}, s AS (SELECT specimen_id, 0 AS step, diagonal * 1e-9 AS small, diagonal AS large, NULL::DOUBLE AS best_size, 21::BIGINT AS best_n, true AS open FROM b UNION ALL SELECT specimen_id, step + 1, CASE WHEN {over} THEN size ELSE small END, CASE WHEN {over} THEN large ELSE size END, CASE WHEN {better} THEN size ELSE best_size END, CASE WHEN {better} THEN n ELSE best_n END, NOT ({enough}) FROM {counted}), found AS (SELECT specimen_id, max_by(best_size, step) FILTER (best_size IS NOT NULL) AS size, max_by(best_n, step) AS n FROM s GROUP BY 1)"


_FEWEST = _bisected("n >= 10", "n >= 10 AND n <= best_n", "n >= 10 AND n <= 10 * (1 + 0.02::DOUBLE)")


@query("voxel_sizes", f"WITH RECURSIVE {P}, {_bisected('n > 10', 'abs(n - 10) < abs(best_n - 10)', 'n = 10 OR (abs(n - 10) < abs(best_n - 10) AND abs(n - 10) <= 1)')} SELECT specimen_id, round(size, 9) AS size, n AS cells FROM found")
def _(spark, sf):
    found = sampling.voxel_sizes(bridge.points(spark, sf), 10, fewest_over=False)
    return found.select("specimen_id", F.round("best_size", 9).alias("size"), F.col("best_n").alias("cells"))


@query("target_count_sample", f"WITH RECURSIVE {P}, {_FEWEST}, k AS (SELECT specimen_id, min_by(p.pidx, p.pidx) AS pidx, min_by(x, p.pidx) AS x, min_by(y, p.pidx) AS y, min_by(z, p.pidx) AS z FROM p JOIN b USING (specimen_id) JOIN found USING (specimen_id) GROUP BY specimen_id, floor((x - ix) / size), floor((y - iy) / size), floor((z - iz) / size)), {_far('k', 10)} SELECT specimen_id, (-u.i)::INTEGER AS pidx FROM last")
def _(spark, sf):
    return sampling.target_count_sample(bridge.points(spark, sf), 10)


@query("ssm_build", None)
def _(spark, sf):
    _, modes, eig = shape_model.build(bridge.points(spark, sf))
    return rounded(modes.join(eig, "mode"))


@query("spectral_segments", None)
def _(spark, sf):
    return spectral.spectral_labels(_both(segmentation.locus_kernel(_locus_edges(spark, sf), 0.7)), 4)


@query("spectral_vectors", "SELECT i::INTEGER AS vector, 0.0::DOUBLE AS residual, 1.0::DOUBLE AS norm, i = 0 AS largest_is_one FROM range(0, 4) t(i)")
def _(spark, sf):
    """Eigenvectors of the graph that labels are found from: what must hold of each."""
    matrix = spectral.lazy_walk(_both(segmentation.locus_kernel(_locus_edges(spark, sf), 0.7)))
    vectors, values, _ = spectral.leading_vectors(matrix, 4)
    far = matrix.join(vectors.withColumnRenamed("node", "dst"), "dst").groupBy("src").agg(*(F.sum(F.col("w") * F.col(f"b{j}")).alias(f"m{j}") for j in range(4)))
    both = far.join(vectors.withColumnRenamed("node", "src"), "src")
    off = lambda j: F.col(f"m{j}") - F.lit(values[j]) * F.col(f"b{j}")
    cells = both.agg(F.array(*(F.struct(F.lit(j).alias("vector"), F.sqrt(F.sum(off(j) * off(j))).alias("residual"), F.sqrt(F.sum(F.col(f"b{j}") * F.col(f"b{j}"))).alias("norm"), F.lit(abs(values[j] - 1) < 1e-6).alias("largest_is_one")) for j in range(4))).alias("c"))
    return rounded(cells.select(F.inline("c")), 5)


@query("tune", None)
def _(spark, sf):
    edges = _locus_edges(spark, sf).persist()
    return rounded(spectral.tune(lambda alpha: _both(segmentation.locus_kernel(edges, alpha)), [3, 4], [0.5, 0.7]), 4)


@query("rigid_icp", None)
def _(spark, sf):
    p = bridge.points(spark, sf)
    return rounded(registration.register(p, points.mean_shape(p), "icp"))


@query("cpd_register", None)
def _(spark, sf):
    p = bridge.points(spark, sf)
    return rounded(registration.register(p, points.mean_shape(p), "cpd"), 4)


@query("batch_transfer", None)
def _(spark, sf):
    p = bridge.points(spark, sf)
    mean, *model = shape_model.build(p)
    return rounded(registration.transfer(p, mean, mean.where("pidx % 3 = 0"), model=tuple(model)), 4)


@query("feature_ransac", None)
def _(spark, sf):
    p = bridge.points(spark, sf)
    return rounded(registration.register_by_features(p, points.mean_shape(p), 0.2), 4)


@query("pose_search", None)
def _(spark, sf):
    p = bridge.points(spark, sf)
    return rounded(registration.pose_search(p, points.mean_shape(p)), 4)


@query("model_fit", None)
def _(spark, sf):
    p = bridge.points(spark, sf)
    return rounded(registration.fit_model(p, *shape_model.build(p)), 4)


@query("dense_correspondence", None)
def _(spark, sf):
    p = bridge.points(spark, sf)
    return rounded(registration.dense_correspondence(p, list(range(0, 21, 3)), points.mean_shape(p)), 4)


@query("feature_stack", None)
def _(spark, sf):
    v = vertices(spark, sf)
    return rounded(segmentation.feature_stack(v, bridge.faces(spark), v.select("specimen_id", F.col("vid").alias("pidx"), "vid")), 4)


@query("heat_signature", None)
def _(spark, sf):
    return rounded(registration.heat_signatures(bridge.points(spark, sf), bridge.faces(spark)), 3)


@query("coherent_projection", None)
def _(spark, sf):
    v, f = vertices(spark, sf), bridge.faces(spark)
    marks = _shrunk(spark, sf).select("specimen_id", "pidx", "x", "y", "z")
    return rounded(registration.project(marks, surfaces.onto_surface(marks, v, f)), 4)


@query("cloud_normals", None)
def _(spark, sf):
    return rounded(surfaces.cloud_normals(bridge.points(spark, sf), 0.4), 3)


@query("mean_atlas", None)
def _(spark, sf):
    return rounded(atlas.mean_atlas(bridge.points(spark, sf), list(range(0, 21, 3)))[0], 4)


@query("dense_export", None)
def _(spark, sf):
    p, f = bridge.points(spark, sf), bridge.faces(spark)
    mean, marks = points.mean_shape(p), F.col("pidx") % 3 == 0
    return rounded(atlas.dense_export(p.where(marks), vertices(spark, sf), f, mean, mean.where(marks)), 4)


@query("dense_export_on_surface", "SELECT vec_id AS specimen_id, 21::BIGINT AS points, 0.0::DOUBLE AS away FROM embeddings")
def _(spark, sf):
    """Exported points lie on the surface of their own specimen."""
    p, f, v = bridge.points(spark, sf), bridge.faces(spark), vertices(spark, sf)
    mean, marks = points.mean_shape(p), F.col("pidx") % 3 == 0
    dense = atlas.dense_export(p.where(marks), v, f, mean, mean.where(marks)).select("specimen_id", "pidx", "x", "y", "z")
    near = surfaces.closest_points(dense, v, f).groupBy("specimen_id").agg(F.count(F.lit(1)).alias("points"), F.sqrt(F.max("d2")).alias("away"))
    return rounded(near)


@query("template_search", None)
def _(spark, sf):
    p = points.scale_diagonal(bridge.points(spark, sf))
    return rounded(template_search.search(p, *shape_model.build(p)), 4)
