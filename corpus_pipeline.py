"""From raw documents to training-ready token shards, in five stages.

Each stage works on all rows that its predecessor kept, is written as Parquet and read
again. The stages before the last return the columns of documents. Every operation's
module states what it does with nulls, empty texts, repeated rows and empty tables;
the stages pass that on: rejected are texts without words (first stage), and of rows
that are the same document (equal doc_id and text) one stays (second stage).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, mixing, near_dup, quality_rules, token_shards
from tessera.llm.staging import staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and their fitted model keep."""
    return quality_rules.keep(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least doc_id."""
    return near_dup.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage to speak of."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document appears as often as it is taken."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences in training order."""
    return token_shards.training_order(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", deduplicate),
    ("benchmark_decontamination", decontaminated),
    ("mixing", mix),
    ("token_output", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Neither the fitted rules nor the tokenizer can be said in SQL
ORACLE_SQL = None
