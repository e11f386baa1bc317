"""The corpus pipeline: raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a table; it is written as Parquet and read again as the next
stage's documents. All but the last return the columns of ``documents``, with ``n_chars`` kept true.

Every stage takes nulls in any column, empty and very long texts, repeated rows, ties and empty tables, as its operator's
docstring says: documents without an id or a text pass all stages but the last, which packs neither; rows that repeat a
doc_id stay or go together; an empty table gives an empty one. Extra columns are kept up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skeinlake.llm import decontaminate, doubling_dedup, jobs, packing, quality, setsketch


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, with the length of the text as it is now."""
    return docs.select(*(F.length("text").cast("bigint").alias(c) if c == "n_chars" else F.col(c) for c in columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop robust outliers of their language and source."""
    return quality.filter_quality(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    return setsketch.dedup_near(docs, copies_col=None).select(*docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut later copies of passages of 50 tokens or more."""
    return _measured(doubling_dedup.dedup_doubling(docs, longest_col=None), docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _measured(decontaminate.decontaminate(docs, benchmark), docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Robust estimates, components and greedy packing are not expressible in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with jobs.Scratch(spark) as tmp:
        for _, stage in STAGES[:-1]:
            docs = tmp.save(stage(spark, docs, sf_dir))
        return STAGES[-1][1](spark, docs, sf_dir)
