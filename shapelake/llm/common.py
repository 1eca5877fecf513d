"""What the operators of this subpackage share: words, scratch tables, sizes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one table of ``sf_dir``; all of them if none is named."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lowered and everything else left alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids fall in fold -1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(-1)).cast("int")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``. Where that is unset, as in
    tests on one machine, a temporary folder is set in its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="shapelake-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables in the shared folder that cut lineage; leaving the block deletes
    those that ``keep`` was not called for.

        with Scratch(spark) as scratch:
            sized = scratch.write(df, "sized")
            ...
            return scratch.keep(result, "result")
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def __enter__(self) -> Scratch:
        return self

    def path(self, tag: str) -> str:
        made = f"{shared_dir(self.spark)}/shapelake-{tag}-{uuid.uuid4().hex}"
        self.paths.append(made)
        return made

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        path = self.path(tag)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tags: str) -> None:
        """Delete the tables of these tags now."""
        for path in [p for p in self.paths if p.rpartition("/shapelake-")[2][:-33] in tags]:
            self.paths.remove(path)
            delete(self.spark, path)

    def keep(self, df: DataFrame, tag: str) -> DataFrame:
        out = self.write(df, tag)
        self.paths.pop()
        return out

    def __exit__(self, *_) -> None:
        for path in self.paths:
            delete(self.spark, path)


def text_hash(text: Column) -> Column:
    """64 bits that stand for a row's whole text."""
    return F.xxhash64(text)


def without(docs: DataFrame, gone: DataFrame, *, id_col: str, text_col: str, broadcast_rows: int) -> DataFrame:
    """``docs`` without the rows that ``gone`` (doc_id, text_hash) names; all columns are kept.

    An id that one row has is enough to drop it. Rows whose id is null or that of
    several rows are told apart by their texts, so each row's own decision counts
    whatever shares its id. Broadcasts are of at most ``broadcast_rows`` rows;
    beyond that the same joins shuffle.
    """
    scratch = Scratch(docs.sparkSession)
    own = F.col(id_col).cast(gone.schema["doc_id"].dataType)

    def small(df: DataFrame) -> tuple[DataFrame, int]:
        n = df.count()
        return (F.broadcast(df) if n <= broadcast_rows else df), n

    gone = scratch.keep(gone.select("doc_id", "text_hash").distinct(), "gone")
    ids = gone.where("doc_id IS NOT NULL").select("doc_id").distinct()
    repeated = docs.select(own.alias("doc_id")).join(small(ids)[0], "doc_id", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    repeated = scratch.keep(repeated, "gone-repeated")
    alone, n_alone = small(scratch.keep(ids.join(small(repeated)[0], "doc_id", "left_anti").select(F.col("doc_id").alias("__gone_id")), "gone-ids"))
    shared = gone.where("doc_id IS NULL").unionByName(gone.join(small(repeated)[0], "doc_id", "left_semi"))
    shared, n_shared = small(scratch.keep(shared.select(F.col("doc_id").alias("__gone_id"), F.col("text_hash").alias("__gone_text")), "gone-texts"))
    out = docs
    if n_alone:
        out = out.join(alone, own == alone["__gone_id"], "left_anti")
    if n_shared:
        out = out.join(shared, own.eqNullSafe(shared["__gone_id"]) & (text_hash(F.col(text_col)) == shared["__gone_text"]), "left_anti")
    return out
