"""Corpus pipeline: stages over ``documents``, each written as Parquet and read again.

Toxic texts go, then exact copies (the largest id stays), then near copies (the smallest id
stays); what is left is mixed to the wanted shares of quality, by reading documents more often and
none less than once, and tokenised. Every stage works on whole texts and on all rows that its
predecessor kept. Since a stage's rows are written before the next begins, a stage first deletes the
inner tables of those before it. Nulls, empty tables and extra columns are as the operators define them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm import bpe, grace, mixing, partenum, toxicity
from attestry.llm.common import STAGE_FOLDERS, delete_folders, fold, handed_over, read

#: Wanted shares of tokens by the label ``quality``.
WEIGHTS = {"1": 0.92, "0": 0.08}

#: Inner tables of the stage before, which go when the next one begins.
_left: list[str] = []


def stage(fn: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """``fn`` that first deletes the inner tables of the stage before it."""

    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        delete_folders(spark, _left)
        made = len(STAGE_FOLDERS)
        out = fn(spark, docs, sf_dir)
        _left[:] = STAGE_FOLDERS[made:]
        return out

    return run_stage


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that score below 0.5; the model learns from the labelled rows whose fold isn't 0."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    scored = toxicity.score(docs, model, out="__toxicity")
    return scored.filter(F.col("__toxicity") < 0.5).select(*docs.columns)


@stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return grace.drop_copies(docs)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return partenum.keep_one(docs)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once: the domain that is most over its share sets the total."""
    return mixing.mixed(docs, read(spark, sf_dir, "labels"), F.col("quality"), WEIGHTS, least=1.0)


@stage
def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(docs, path, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing to target weights", mix_sources),
    ("byte-level BPE", tokenise),
]

#: The toxicity model and the fitted rates can't be written in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, apply) in enumerate(STAGES):
        docs = apply(spark, handed_over(docs) if i else docs, sf_dir)
    return docs
