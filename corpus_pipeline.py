"""From documents to training sequences: toxic, poor and repeated documents go, sources are mixed, texts packed.

Each stage takes (spark, docs, sf_dir), docs being what the stage before returned, and returns documents; the last returns
pieces and their sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import stages
from tidemark.llm.common import shared_folder, table
from tidemark.llm.queries import tokenizer_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.without_toxic(docs, table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.good_ones(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.packed(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]
#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared checkpoint folder as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    shared = shared_folder(spark)
    for name, stage in STAGES:
        path = f"{shared}/{name}-{uuid.uuid4().hex}.parquet"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
