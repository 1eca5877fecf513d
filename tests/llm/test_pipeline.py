"""The pipeline on the smallest tables: every stage keeps the columns, and does its own work."""

import os

import pytest

import corpus_pipeline
from shapelake.llm import decontaminate, jaccard

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF)
        after.write.parquet(str(tmp_path / name))
        got = spark.read.parquet(str(tmp_path / name))
        assert 0 < got.count() <= docs.count()
        if name != "mixing":
            assert got.columns == columns
            assert got.join(docs.select("doc_id"), "doc_id", "left_semi").count() == got.count()
        if name == "near_duplicates":
            again = jaccard.similar(got, percent=80, words=5)
            assert again.where("component_id <> doc_id").count() == 0
        if name == "decontamination":
            assert decontaminate.overlaps(got, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
        docs = got
    assert before > docs.count()
    assert docs.where("taken <= 0 OR taken > 3 * size").count() == 0
