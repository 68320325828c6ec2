"""Corpus cleaning in five stages, from documents to token digests.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again before the next one. All but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bedside.llm import bpe, common, decontaminate, lines, ngrams, quality, queries
from bedside.sources.tables import materialise


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the boosted trees reject."""
    common.prepare(spark)
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the line blocks that an earlier document has."""
    common.prepare(spark)
    return lines.shortened(docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    common.prepare(spark)
    return ngrams.representatives(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without contaminated documents."""
    common.prepare(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests per document."""
    common.prepare(spark)
    return bpe.digests(docs, *queries.vocabulary())


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", lines_stage),
    ("ngram_jaccard_join", near_duplicates_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("byte_level_bpe", tokens_stage),
]

#: Neither boosted trees nor patience diff have a form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
