"""A training-data pipeline over ``documents``: toxicity, line dedup, near
copies, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before
kept, and returns a DataFrame; all but the last return the columns of docs.
Stages handle empty tables, nulls and repeated rows as their operators in
``bazaar/llm`` define.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from bazaar.llm import decontam, jaccard_join, line_dedup, mixing, toxicity
from bazaar.session import scratch_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain holds for toxic go."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go; documents stay, ``n_chars`` follows.
    Copies count once: dropping them is the next stage's task, which needs
    their lines."""
    return line_dedup.drop_boilerplate_lines(docs, copies=False).select(*docs.columns)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return jaccard_join.drop_near_copies(docs).select(*docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many copies of each document the mix takes."""
    return mixing.mix_sources(docs, mixing.weights_by_position(docs, (3, 1, 2)))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("near_copies", near_copy_stage),
    ("decontamination", benchmark_stage),
    ("mixing", mixing_stage),
]

#: The classifier chain and the alignment have no SQL form; the tests hold the
#: pipeline against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared
    checkpoint folder and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = scratch_path(spark, f"pipeline-{uuid.uuid4().hex}")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{i}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{i}-{name}")
    return docs
