"""The registered queries of the subpackage and the SQL that some of them must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, html_text, language_id, lm_scoring, mixing, near_dedup, quality, sharding, substring_dedup, token_counts
from ._store import materialise
from .oracles import ORACLES


def _read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "source", "text")
    sizes = materialise(docs.select("doc_id", "source", mixing.n_words(docs["text"]).alias("words")), "sizes")
    return mixing.mix(sizes, size=sizes["words"]).select("doc_id", "size", "source_size", "target", "taken")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.digest(_read(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_read(spark, sf_dir, "pages", "page_id", "url", "html")).select("page_id", "url", "text")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_read(spark, sf_dir, "documents", "doc_id"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(quality.judge(_read(spark, sf_dir, "documents", "doc_id", "text"), _read(spark, sf_dir, "labels", "doc_id", "quality")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _read(spark, sf_dir, "documents", "doc_id", "text"), _read(spark, sf_dir, "benchmark", "item_id", "text")
    return decontamination.digest(decontamination.contamination(docs, items))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.digest(near_dedup.groups(_read(spark, sf_dir, "documents", "doc_id", "text")))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.remove(_read(spark, sf_dir, "documents", "doc_id", "text")))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(_read(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_source_mixing, op2_language_id, op3_html_extraction, op4_sharding, op5_quality_rules, op6_decontamination, op7_near_dedup, op8_token_counts, op9_substring_dedup, op10_lm_scoring)}

__all__ = ["ORACLES", "QUERIES"]
