"""The training-data queries and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import html_extract, jaccard_join, knn, mixing, quality_crf, quality_rules, sentencepiece_codec, suffix_dedup, toxicity, url_filter
from kindred.llm.common import read


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(read(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.groups(read(spark, sf_dir, "documents"))


def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.pairs(read(spark, sf_dir, "documents")).withColumn("jaccard", F.round("jaccard", 9))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(read(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.content(read(spark, sf_dir, "pages"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.manifest(read(spark, sf_dir, "documents"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.knn_join(read(spark, sf_dir, "embeddings")).withColumn("distance", F.round("distance", 6))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(read(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_hits(read(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")} | {"jaccard_pairs": jaccard_pairs}


def oracle_sql() -> dict[str, str]:
    return {"op4_ngram_jaccard_join": jaccard_join.sql(), "jaccard_pairs": jaccard_join.sql_pairs(), "op7_mixing": mixing.sql(), "op8_topk": knn.sql(), "op9_suffix_array_dedup": suffix_dedup.sql(), "op10_url_filter": url_filter.sql()}
