"""Registered queries of the training-data operators: name -> (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaar.llm import (
    chunk_dedup,
    decontam,
    exact_dedup,
    hard_negatives,
    jaccard_join,
    licenses,
    line_dedup,
    mixing,
    nbsvm,
    prefix_parse,
    secrets,
    token_align,
    toxicity,
)
from bazaar.llm.oracles import ORACLE_SQL  # noqa: F401 - read by the driver contract

#: Folder of the public vocabulary files on the driver.
TOKENIZERS = "/opt/tokenizers"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    mix = mixing.mix_sources(docs, mixing.weights_by_position(docs, (3, 1, 2)))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_copies(_documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op4_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    out = chunk_dedup.dedup_substrings(docs.withColumn("_before", F.length("text")))
    spans = F.transform("_passages", lambda p: F.concat_ws(":", p["start"].cast("string"), p["end"].cast("string")))
    return out.select("doc_id", F.coalesce("_before", F.lit(0)).alias("n_chars"),
                      F.col("_n_repeated").alias("n_repeated"),
                      F.coalesce(F.col("_before") - F.length("text"), F.lit(0)).alias("n_dropped_chars"),
                      F.coalesce(F.array_join(spans, ","), F.lit("")).alias("passages"),
                      F.coalesce("_first_ids", F.array().cast("array<long>")).alias("first_ids"), "text")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_boilerplate(_documents(spark, sf_dir))
    return out.select("doc_id", "source", F.col("_lines_in").alias("n_lines"),
                      F.col("_lines_dropped").alias("n_dropped"), "text")


def op6_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.score_quality(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_documents(spark, sf_dir))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(_documents(spark, sf_dir))
    base = F.concat("assign", "access", "hex")
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secrets.joined(base), 256).alias("base_sha256"),
        secrets.joined(F.concat(base, F.col("entropy"))).alias("spans"))


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_documents(spark, sf_dir))


def op11_prefix_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prefix_parse.remove_repeats(_documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def query_label() -> Column:
    """The label of a row of ``embeddings``: the next one for every seventh."""
    return F.expr("CASE WHEN vec_id % 7 = 0 THEN (bigint(label) + 1) % 10 ELSE label END")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = hard_negatives.integer_vectors(rows, "vec_id", "embedding", query_label())
    return hard_negatives.mine(vectors, F.col("id") % 100 == 0)


def op13_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = token_align.read_vocabularies(f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model")
    aligned = token_align.digest_columns(token_align.align(_documents(spark, sf_dir), v))
    return token_align.agreement(aligned).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_toxicity": op2_toxicity,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_chunk_dedup": op4_chunk_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_nbsvm": op6_nbsvm,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_secrets": op8_secrets,
    "op9_decontam": op9_decontam,
    "op10_licenses": op10_licenses,
    "op11_prefix_parse": op11_prefix_parse,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_token_align": op13_token_align,
}
