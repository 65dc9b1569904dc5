"""The registered queries of this package: opN_<name>(spark, sf_dir) over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from grainmill.llm import bpe_count, decontam, line_dedup, mixing, ngram_join, quality, secrets, sharding, toxicity, warc_zip
from grainmill.llm.common import table


def _model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report_lines(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.count_tokens(table(spark, sf_dir, "documents"), _model())


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op7_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=16)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rate_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate_quality(table(spark, sf_dir, "documents"))


def op10_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.warc_round_trip(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_decontaminate, op2_mixing, op3_line_dedup, op4_token_counts, op5_ngram_join, op6_secret_scan, op7_kd_shards, op8_toxicity, op9_quality_rules, op10_warc_zip)}

ORACLE_SQL: dict[str, str] = {"op2_mixing": mixing.SQL}
