"""The pipeline's stages on planted rows, and the package's queries against their SQL."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from attestry.llm import queries
from attestry.llm.common import handed_over
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    problem, *_ = compare(spark, connect(SF), SF, queries.QUERIES[name], queries.ORACLES[name])
    assert not problem


def test_one_query_for_each_operator():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 14))


def test_stages_take_effect_and_keep_clean_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = docs.filter("doc_id = 0").first()["text"]
    planted = spark.createDataFrame(
        [(90_001, clean + " you stupid idiot and worthless moron"), (90_002, clean.upper()), (90_003, clean + " end"), (90_004, None)],
        "doc_id long, text string",
    )
    docs = docs.unionByName(planted, allowMissingColumns=True).withColumn("kept", F.lit(1))
    ids, columns = {}, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = handed_over(stage(spark, docs, SF))
        ids[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
        if stage is not corpus_pipeline.tokenise:
            assert docs.columns == columns
    assert 90_001 not in ids["toxicity"] and {90_002, 90_003, 90_004} <= set(ids["toxicity"])
    assert not {0, 90_002} <= set(ids["exact dedup"]) and 90_004 in ids["exact dedup"]
    assert len({0, 90_002, 90_003} & set(ids["n-gram Jaccard join"])) == 1
    assert set(ids["mixing to target weights"]) == set(ids["n-gram Jaccard join"]) == set(ids["byte-level BPE"])
    assert len(ids["mixing to target weights"]) > len(ids["n-gram Jaccard join"])


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = handed_over(stage(spark, docs, SF))
    assert docs.count() == 0
