"""A corpus from raw documents to a weighted mix, in five stages.

Each stage is a function of (spark, docs, sf_dir) that applies one operator of
``shapelake.llm``. What a stage returns is written as Parquet, in the folder that
the cluster names in ``spark.checkpoint.dir``, and read again as the next one's
documents, so a lost executor costs no more than the stage that it worked on.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapelake.llm import decontaminate, jaccard, mixing, quality, toxicity
from shapelake.llm.common import Scratch, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels, does not reject."""
    model = quality.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality.keep_good(docs, model)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxic passages do not make them likely to be toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with a similarity of 0.8 over five words."""
    return jaccard.keep_one(docs, percent=80, words=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents of which it takes words, how often whole, and how many words in all."""
    mixed = mixing.mix(docs)
    return mixed.where("taken > 0").select("doc_id", "source", "size", "source_size", "target", "repeats", "part", "taken")


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: Learned scores decide what stays, which SQL cannot say.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        for name, stage in STAGES[:-1]:
            docs = scratch.write(stage(spark, docs, sf_dir), f"stage-{name}")
        name, stage = STAGES[-1]
        return scratch.keep(stage(spark, docs, sf_dir), f"stage-{name}")
