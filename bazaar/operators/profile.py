"""Profiling (P1..P7): the notebook's look-at-the-data steps as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def head(df: DataFrame, n: int = 5, order: list[str] | None = None) -> DataFrame:
    """First ``n`` rows, by source order when given (else any n rows)."""
    return (df.orderBy(*order) if order else df).limit(n)


def columns(df: DataFrame) -> list[str]:
    """P2 (metadata only, no job)."""
    return list(df.columns)


def shape(df: DataFrame) -> DataFrame:
    """One row (rows, columns)."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def info(df: DataFrame) -> DataFrame:
    """P3 + P4: per column its type, non-missing count and the row count.

    All counts come from one aggregation pass; the wide one-row result is
    turned into one row per column with ``unpivot``.
    """
    names = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("__rows"),
                  *[F.count(F.col(c)).alias(f"c{i}") for i, c in enumerate(names)])
    long = wide.unpivot("__rows", [f"c{i}" for i in range(len(names))], "_slot", "non_null")
    name_map = F.create_map(*[x for i, c in enumerate(names) for x in (F.lit(f"c{i}"), F.lit(c))])
    type_map = F.create_map(*[x for i, f in enumerate(df.schema.fields)
                              for x in (F.lit(f"c{i}"), F.lit(f.dataType.simpleString()))])
    pos_map = F.create_map(*[x for i in range(len(names)) for x in (F.lit(f"c{i}"), F.lit(i))])
    return long.select(
        F.element_at(pos_map, F.col("_slot")).alias("position"),
        F.element_at(name_map, F.col("_slot")).alias("column_name"),
        F.element_at(type_map, F.col("_slot")).alias("data_type"),
        F.col("non_null"), F.col("__rows").alias("total_rows"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """P5: frequency of each non-missing value, most frequent first."""
    return (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
              .orderBy(F.desc("count"), F.asc(col)))


def nunique(df: DataFrame, col: str, approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """Number of distinct non-missing values (exact; HyperLogLog++ if ``approx``)."""
    agg = F.approx_count_distinct(col, rsd) if approx else F.count_distinct(col)
    return df.agg(agg.alias("nunique"))


def distinct_frequencies(df: DataFrame, col: str) -> DataFrame:
    """How many different frequencies P5 shows."""
    return (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
              .agg(F.count_distinct("n").alias("distinct_frequencies")))
