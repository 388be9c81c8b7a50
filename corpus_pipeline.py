"""The corpus pipeline: documents that are kept, stage by stage, then mixed.

Counted as part of the training-data subpackage. Each stage takes (spark, docs, sf_dir)
and gives a DataFrame; run() writes each stage's result to the shared folder and reads it
again, so a stage is computed once and lost executors cost no more than a stage.

Cases: nulls, empty and very long texts, repeated rows, empty tables and extra columns
are handled as each operator's module says; a document without text is rejected by the
first stage; all stages but the last return the columns of `docs` as they came.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import decontam, exact_dedup, langid, mixing, ngram_join
from lexmill.llm.common import stored, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected."""
    return langid.identified(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the smallest doc_id."""
    return exact_dedup.first_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8), the one with the smallest doc_id."""
    return ngram_join.first_of_groups(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of what was kept: one row per slot of an output shard."""
    return mixing.mix(docs)


STAGES = [
    ("language", language_stage),
    ("exact_dedup", dedup_stage),
    ("near_duplicates", near_stage),
    ("decontamination", benchmark_stage),
    ("mixing", mixing_stage),
]

#: A trained language model decides in the first stage: SQL can't express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
