"""Tables of an analysis on disk: shapes by specimen, segments, and model databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_points(points: DataFrame, path: str, *by: str) -> None:
    """Points as Parquet, a folder for each value of ``by``; 32-bit coordinates as files of this kind hold."""
    points.withColumns({c: F.col(c).cast("float") for c in "xyz"}).write.partitionBy(*by).mode("overwrite").parquet(path)


def write_markups(points: DataFrame, path: str) -> None:
    """One JSON object a line for each specimen: a markup of its landmarks in order."""
    marks = F.array_sort(F.collect_list(F.struct("pidx", F.array("x", "y", "z").alias("position"))))
    rows = points.groupBy("specimen_id").agg(marks.alias("m"))
    points_of = F.transform("m", lambda p: F.struct(p["pidx"].cast("string").alias("label"), F.lit("").alias("description"), p["position"].alias("position")))
    rows.select("specimen_id", F.array(F.struct(F.lit("RAS").alias("coordinateSystem"), points_of.alias("controlPoints"))).alias("markups")).write.mode("overwrite").json(path)


def save_model(mean: DataFrame, modes: DataFrame, eigenvalues: DataFrame, path: str, name: str) -> None:
    """A model database: three tables and a manifest of its sizes."""
    to = f"{path}/{name}"
    for df, part in ((mean, "mean"), (modes, "modes"), (eigenvalues, "eigenvalues")):
        df.write.mode("overwrite").parquet(f"{to}/{part}")
    manifest = mean.agg(F.lit(1).alias("version"), F.count(F.lit(1)).alias("n_points")).crossJoin(eigenvalues.agg(F.count(F.lit(1)).alias("n_modes")))
    manifest.write.mode("overwrite").json(f"{to}/manifest")


def load_model(spark: SparkSession, path: str, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mean, modes and eigenvalues (at least 1e-10) of a database."""
    mean, modes, eig = (spark.read.parquet(f"{path}/{name}/{p}") for p in ("mean", "modes", "eigenvalues"))
    return mean, modes, eig.withColumn("v", F.greatest("v", F.lit(1e-10)))


def wide_modes(modes: DataFrame, mean: DataFrame | None = None, most: int = 1_000) -> DataFrame:
    """A row for each coordinate (axis) and a column for each mode, and ``mean_shape`` if ``mean`` is given.

    It is an error if the model has more than ``most`` modes: a table has no room for more columns."""
    long = lambda df, *keep: df.select(*keep, F.inline(F.array(*(F.struct((F.col("pidx") * 3 + k).alias("axis"), F.col(c).alias("v")) for k, c in enumerate("xyz")))))
    names = sorted(r[0] for r in modes.select("mode").distinct().limit(most + 1).collect())
    if len(names) > most:
        raise ValueError(f"more than {most} modes")
    rows = long(modes, "mode").groupBy("axis").pivot("mode", names).agg(F.first("v"))
    rows = rows.select("axis", *(F.col(str(n)).alias(f"mode_{n}") for n in names))
    return rows if mean is None else long(mean).withColumnRenamed("v", "mean_shape").join(rows, "axis")


def list_models(spark: SparkSession, path: str) -> list[str]:
    """Names of the databases under ``path``, sorted; those with a manifest."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").where("path LIKE '%/manifest/%'")
    return sorted({r[0] for r in found.select(F.regexp_extract("path", "([^/]+)/manifest/", 1)).distinct().collect()})


def write_segments(vertices: DataFrame, labels: DataFrame, path: str) -> None:
    """Vertices with their labels, a folder for each segment."""
    vertices.join(labels, ["specimen_id", "vid"]).write.partitionBy("label").mode("overwrite").parquet(path)


def run_folder(root: str, kind: str, when: str) -> str:
    """Where a run (``%Y_%m-%d_%H_%M_%S``) keeps results of a kind, such as atlas or alignedLMs."""
    return f"{root}/run={when}/kind={kind}"


def remove_model(spark: SparkSession, path: str, name: str) -> bool:
    """Delete a model database; whether there was one."""
    if not name or "/" in name or name in (".", ".."):
        raise ValueError(f"not the name of a model: {name!r}")
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def write_mesh(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    """A warped mesh of each specimen: its vertices by specimen, and the faces."""
    vertices.write.partitionBy("specimen_id").mode("overwrite").parquet(f"{path}/vertices")
    faces.write.mode("overwrite").parquet(f"{path}/faces")


def write_diagnostics(diagnostics: DataFrame, path: str) -> None:
    """One JSON object a line for each target, its landmarks and figures; nulls are kept."""
    diagnostics.write.option("ignoreNullFields", False).mode("overwrite").json(path)


def write_labels(labels: DataFrame, path: str) -> None:
    """Label of each locus (pidx, label) as Parquet, and as text in order of the loci."""
    labels.write.mode("overwrite").parquet(f"{path}/table")
    labels.orderBy("pidx").select(F.col("label").cast("string")).write.mode("overwrite").text(f"{path}/text")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`write_labels` wrote."""
    return spark.read.parquet(f"{path}/table")
