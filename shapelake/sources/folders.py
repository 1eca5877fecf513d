"""Folders as users keep them: meshes beside landmarks, and shape models with their parts.

Which file plays which part is decided by aggregates over the listing, for all
folders at once; contents are read only of the files that are chosen or counted.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import pairing, shells
from . import readers
from .lineage import cut

# Suffixes and hints in names by which the parts of a model folder are known.
MESHES, MARKUPS, HINTS_DENSE, HINT_SPARSE, MODEL_NAME = r"\.(ply|vtk|vtp|stl)$", r"\.(fcsv|json)$", "dense|corr", "sparse", "ssm_model.npz"
FLOOR = 1e-10
FILES = "files struct<model: string, dense: string, sparse: string, ssm: string>"


class Models(NamedTuple):
    parts: DataFrame  # model, mesh, ssm, dense, sparse, swapped, error
    mean: DataFrame  # model, pidx, x, y, z
    modes: DataFrame  # model, mode, pidx, x, y, z
    eigenvalues: DataFrame  # model, mode, v


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(model, name, path) of all files in folders directly or deeper below ``root``; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    return found.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("model"), F.regexp_extract("path", "[^/]*$", 0).alias("name"), "path")


def _text(content: Column) -> Column:
    return content.cast("string")  # bytes that are no text stay, and match nothing


def point_counts(files: DataFrame) -> DataFrame:
    """(path, n_points) of markup files (path, content): control points of a JSON file's first
    markup, or lines of an FCSV file with three coordinates; 0 of what is neither."""
    first = F.get(F.from_json(_text(F.col("content")), readers.MARKUPS)["markups"], F.lit(0))
    is_point = lambda line: ~line.startswith("#") & F.forall(F.array(*(F.get(F.split(line, ","), F.lit(k)).try_cast("double") for k in (1, 2, 3))), lambda v: v.isNotNull())
    lines = F.size(F.filter(F.split(_text(F.col("content")), "\r?\n"), is_point))
    n = F.when(F.lower("path").endswith(".json"), F.size(first["controlPoints"])).otherwise(lines)
    return files.select("path", F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)).alias("n_points"))


def resolve(files: DataFrame, manifests: DataFrame, counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """The parts of each model folder: (model, mesh, ssm, dense, sparse, swapped, error), paths or null.

    ``files``: (model, name, path). ``manifests``: (model, mesh, ssm, dense, sparse) as paths; a
    folder with a row here is taken at its word. Others go by names, in order of code points:
    the first mesh; ``ssm_model.npz``, or the first such archive; of two or more markups the
    first whose name hints at dense ones and the first that hints at sparse ones, or, unless both
    are there, the two with the most points by ``counts`` (path, n_points), ties by name; a single
    one is dense. Then, by ``sizes`` (ssm, n_points), dense and sparse change places where only the
    sparse ones are as many as the model has points. ``error`` says when mesh, model or
    dense landmarks are missing. A folder without any of these files has no row.
    """
    low = F.lower("name")
    named = files.join(manifests.select("model"), "model", "left_anti").join(counts, "path", "left")
    mark, archive = low.rlike(MARKUPS), low.endswith(".npz")
    first = lambda where: F.min(F.when(where, F.struct("name", "path")))["path"]
    most = lambda: F.struct((-F.coalesce("n_points", F.lit(0))).alias("fewer"), "name", "path")
    top = F.min(F.when(mark, most()))
    seen = named.where(low.rlike(MESHES) | mark | archive).groupBy("model").agg(
        first(low.rlike(MESHES)).alias("mesh"),
        F.coalesce(first(F.col("name") == MODEL_NAME), first(archive)).alias("ssm"),
        F.count_if(mark).alias("n_marks"),
        first(mark & low.rlike(HINTS_DENSE)).alias("dense_hint"),
        first(mark & low.contains(HINT_SPARSE)).alias("sparse_hint"),
        top["path"].alias("largest"),
        F.get(F.array_sort(F.collect_set(F.when(mark, most()))), F.lit(1))["path"].alias("second"),  # the files of one folder
    )
    hinted = F.col("dense_hint").isNotNull() & F.col("sparse_hint").isNotNull() & (F.col("n_marks") > 1)
    guessed = seen.select("model", "mesh", "ssm", F.when(hinted, F.col("dense_hint")).otherwise(F.col("largest")).alias("dense"), F.when(hinted, F.col("sparse_hint")).otherwise(F.col("second")).alias("sparse"))
    both = guessed.unionByName(manifests.select(guessed.columns))
    count = lambda side: counts.select(F.col("path").alias(side), F.col("n_points").alias(f"n_{side}"))
    both = both.join(count("dense"), "dense", "left").join(count("sparse"), "sparse", "left").join(sizes.withColumnRenamed("n_points", "n_model"), "ssm", "left")
    swapped = F.coalesce(F.col("sparse").isNotNull() & ~F.col("n_dense").eqNullSafe(F.col("n_model")) & (F.col("n_sparse") == F.col("n_model")), F.lit(False))
    missing = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in ("mesh", "ssm", "dense"))))
    return both.select(
        "model", "mesh", "ssm", F.when(swapped, F.col("sparse")).otherwise(F.col("dense")).alias("dense"), F.when(swapped, F.col("dense")).otherwise(F.col("sparse")).alias("sparse"),
        swapped.alias("swapped"), F.when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", "))).alias("error"),
    )


ARCHIVE = "ssm string, kind string, mode int, pidx int, x double, y double, z double, error string"


def _archives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [f.split()[0] for f in ARCHIVE.split(", ")]
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            try:
                with np.load(io.BytesIO(content), allow_pickle=False) as held:
                    mean, modes, values = (np.asarray(held[n], float) for n in ("mean_shape", "modes", "eigenvalues"))
                mean, modes = mean.reshape(-1, 3), modes.reshape(-1, 3, modes.shape[-1])
                if len(modes) != len(mean) or modes.shape[2] != len(values):
                    raise ValueError("mean, modes and eigenvalues do not fit together")
            except (ValueError, KeyError, OSError, IndexError) as e:
                yield pd.DataFrame([(path, "error", None, None, None, None, None, f"{type(e).__name__}: {e}")], columns=columns)
                continue
            for kind, m, rows in (("mean", None, mean), *(("mode", k, modes[:, :, k]) for k in range(len(values)))):
                yield pd.DataFrame({"ssm": path, "kind": kind, "mode": m, "pidx": np.arange(len(rows)), "x": rows[:, 0], "y": rows[:, 1], "z": rows[:, 2], "error": None})
            yield pd.DataFrame({"ssm": path, "kind": "value", "mode": np.arange(len(values)), "pidx": None, "x": values, "y": None, "z": None, "error": None})


def load_models(spark: SparkSession, root: str) -> Models:
    """All shape models in folders below ``root``: their parts by :func:`resolve`, and the mean,
    modes and eigenvalues (at least 1e-10) of each that has all it needs.

    A ``manifest.json`` names files of its own folder under ``files``: model (the mesh), dense,
    sparse and ssm. An archive that cannot be read is an ``error`` of its model; the others load.
    """
    files = listing(spark, root)
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    held = read.option("pathGlobFilter", "manifest.json").load(root)
    named = held.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("model"), F.from_json(_text(F.col("content")), FILES)["files"].alias("f"))
    inside = lambda part: F.when(F.length(F.col(f"f.{part}")) > 0, F.concat("model", F.lit("/"), F.col(f"f.{part}")))
    manifests = named.select("model", inside("model").alias("mesh"), F.coalesce(inside("ssm"), F.concat("model", F.lit(f"/{MODEL_NAME}"))).alias("ssm"), inside("dense").alias("dense"), inside("sparse").alias("sparse"))
    manifests = cut(manifests)
    counts = cut(point_counts(read.option("pathGlobFilter", "*.{json,fcsv,JSON,FCSV}").load(root).where(~F.col("path").endswith("/manifest.json"))))
    arrays = cut(read.option("pathGlobFilter", "*.{npz,NPZ}").load(root).select("path", "content").mapInPandas(_archives, ARCHIVE))
    sizes = arrays.where("kind = 'mean'").groupBy("ssm").agg(F.count(F.lit(1)).alias("n_points"))
    parts = resolve(files, manifests, counts, sizes)
    broken = arrays.where("kind = 'error'").select("ssm", F.col("error").alias("unread"))
    parts = parts.join(broken, "ssm", "left").join(sizes, "ssm", "left")
    unread = F.when(F.col("ssm").isNotNull() & F.col("n_points").isNull(), F.coalesce("unread", F.lit("the model's file is not there")))
    parts = cut(parts.select("model", "mesh", "ssm", "dense", "sparse", "swapped", F.coalesce("error", unread).alias("error")))
    whole = arrays.join(parts.where("error IS NULL").select("model", "ssm"), "ssm")
    mean = whole.where("kind = 'mean'").select("model", "pidx", "x", "y", "z")
    modes = whole.where("kind = 'mode'").select("model", "mode", "pidx", "x", "y", "z")
    return Models(parts, mean, modes, whole.where("kind = 'value'").select("model", "mode", F.greatest("x", F.lit(FLOOR)).alias("v")))


def import_pairs(spark: SparkSession, meshes: str, landmarks: str, tolerance: float = 0.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Specimens that have both a mesh and landmarks, meshes cleaned: vertices (specimen_id, vid,
    x, y, z), faces (specimen_id, fid, a, b, c) and landmarks (specimen_id, pidx, x, y, z, label).

    ``specimen_id`` is the file's key. Of files with one key the last path counts. A mesh
    that cannot be read has no rows; :func:`readers.parse_meshes` says why.
    """
    m = pairing.unique_keys(readers.files(spark, meshes, readers.MESH_SUFFIXES), "key", "path").drop("duplicates")
    k = pairing.unique_keys(readers.files(spark, landmarks, ("json", "fcsv")), "key", "path").select("key", F.col("path").alias("marks"))
    both = cut(pairing.pair(m, k, "key"))
    parsed = cut(readers.parse_meshes(spark, meshes).join(both.select("path"), "path", "left_semi"))
    vertices, faces = (df.withColumnRenamed("key", "specimen_id") for df in readers.exploded(parsed))
    marks = readers.read_markups(spark, f"{landmarks}/*.[jJ]*").withColumn("kind", F.lit("json"))
    if spark.read.format("binaryFile").load(landmarks).where(F.lower("path").endswith(".fcsv")).select("path").limit(1).count():
        marks = marks.unionByName(readers.read_fcsv(spark, f"{landmarks}/*.[fF]*").withColumn("kind", F.lit("fcsv")), allowMissingColumns=True)
    own = both.select("key", F.lower(F.regexp_extract("marks", "[^.]*$", 0)).alias("kind"))
    marks = marks.join(own, ["key", "kind"]).select(F.col("key").alias("specimen_id"), "pidx", "x", "y", "z", "label")
    return (*shells.cleaned(vertices, faces, tolerance), marks)
