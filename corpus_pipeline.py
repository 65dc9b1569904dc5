"""The corpus pipeline: quality rules, near-duplicate removal, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result is
written as Parquet and read again as the next one's docs. All but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from grainmill.llm import decontam, mixing, ngram_join, quality, sharding
from grainmill.llm.common import cut, discard, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the limits or are outliers of their language and source go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at 0.8 stays."""
    return ngram_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out to bring sources to their target words."""
    return mixing.mix_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's shard of 16 of near equal bytes, and its slot in it."""
    return sharding.shard(docs, shards=16)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mix),
    ("sharding", shards),
]

#: Outlier estimates, edit bounds and hashes are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        last, docs = docs, cut(stage(spark, docs, sf_dir), "stage")
        discard(last)
    return docs
