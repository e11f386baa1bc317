"""Registered queries of this subpackage: one for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skeinlake.llm import (
    chat,
    decontaminate,
    doubling_dedup,
    html_extract,
    language,
    oracle,
    packing,
    quality,
    setsketch,
    suffix_dedup,
    token_counts,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_language(_table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(_table(spark, sf_dir, "conversations"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_suffixes(_table(spark, sf_dir, "documents"))


def op4_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.dedup_near(_table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return html_extract.extract_pages(pages, html_extract.train(pages, _table(spark, sf_dir, "documents")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.filter_quality(_table(spark, sf_dir, "documents"))


def op10_doubling_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubling_dedup.dedup_doubling(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_chat_format,
        op3_suffix_dedup,
        op4_setsketch_dedup,
        op5_decontaminate,
        op6_best_fit_packing,
        op7_token_counts,
        op8_html_extraction,
        op9_quality_rules,
        op10_doubling_dedup,
    )
}

SQL: dict[str, str] = {
    "op3_suffix_dedup": oracle.REPEATS,
    "op4_setsketch_dedup": oracle.NEAR,
    "op5_decontaminate": oracle.LEAKS,
    "op10_doubling_dedup": oracle.DOUBLED_REPEATS,
}
