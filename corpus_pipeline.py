"""A corpus pipeline of five stages: toxicity, copies, near copies, mixture and packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. It is written as Parquet and read again as the next one's docs.
All stages but the last return the columns of documents.

Defined results: a null text counts as empty everywhere (no terms, no words, one end id); empty texts are copies of each other, and the mixture
draws no text without words; a null id is an id of its own kind and sorts last; rows that repeat one another are copies; ties go to
the smaller id, then to the text's hash; extra columns pass through, whatever their names; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm.common import marked, release, scratch_path
from tallyloom.llm.exact_dedup import drop_copies
from tallyloom.llm.mixing import mixed
from tallyloom.llm.near_dedup import drop_near
from tallyloom.llm.packing import pack
from tallyloom.llm.queries import toxicity_machine, vocabulary
from tallyloom.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold."""
    return drop_toxic(docs, toxicity_machine(spark, docs, sf_dir))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised texts, the one with the smallest id."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates, the document with the smallest id."""
    return drop_near(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mixture takes, shard by shard: a document whole, cut where its source's target ends, or twice."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows and their places in sequences of 1024 ids."""
    return pack(docs, vocabulary(), end_id=2, capacity=1024).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: SQL has no words for the trained classifier, the signatures and the packing; the tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage_{name}")
        mark = marked()
        stage(spark, docs, sf_dir).write.parquet(path)
        release(spark, mark)  # the stage's own scratch tables
        docs = spark.read.parquet(path)
    return docs
