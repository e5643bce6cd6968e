"""The corpus pipeline: documents through a chain of stages, each written and read again.

Every stage keeps rows with nulls in columns that it doesn't judge by, treats repeated rows and ties alike wherever they
stand, and gives an empty table for an empty one; what it does with null and empty texts is said at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesselon.llm import classifier, decontaminate, jaccard, mixing, sharding
from tesselon.llm.common import settle
from tesselon.llm.queries import CLASSIFIER, MIX, NEAR, SHARDS, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text the classifier keeps, fitted on the labels. A null text goes; an empty one is judged on the biases alone."""
    return classifier.keep_good(spark, docs, table(spark, sf_dir, "labels"), **CLASSIFIER)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the least id. Null ids, null texts and texts of fewer than five words stay."""
    return jaccard.one_of_each_group(spark, docs, **NEAR)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that hold no benchmark item, word for word or paraphrased. Null and empty texts hold none."""
    return decontaminate.without_leaks(spark, docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents that make up the drawn blocks, under their documents' ids. Texts without tokens have no pieces; a null source counts as the empty one."""
    return mixing.mixed_documents(spark, docs, **MIX)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with their shard, by id; a null id counts as the empty text. Nothing else is changed."""
    return sharding.assign_shards(docs, SHARDS)


STAGES = [
    ("quality_classifier", good_quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminated),
    ("source_mixing", mixed),
    ("sharding", sharded),
]

#: The stages fit models and draw samples, which SQL can't express; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs, name)
    return docs
