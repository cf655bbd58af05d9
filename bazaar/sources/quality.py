"""Quality figures gathered while silver is written.

``DataFrame.observe`` counts in the very tasks that write the rows, so the
figures cost no pass of their own. They are those of the rows written: rows,
non-missing values a column, and any conditions the caller names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from bazaar.sources.sinks import write_parquet

SCHEMA = "measure string, column_name string, value long, total_rows long"


def write_with_quality(df: DataFrame, path: str, quality_path: str, conditions: dict[str, Column] | None = None,
                       partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` like ``write_parquet`` and a quality table to
    ``quality_path``: (measure, column_name, value, total_rows), where measure
    is 'non_null' for each column, or a name of ``conditions`` with the number
    of rows for which it holds (NULL counts as not holding)."""
    conditions = conditions or {}
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("rows")]
    counts += [F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]
    counts += [F.count_if(cond).alias(f"x{i}") for i, cond in enumerate(conditions.values())]
    write_parquet(df.observe(seen, *counts), path, partition_by)
    got = seen.get
    rows = [("non_null", c, got[f"c{i}"], got["rows"]) for i, c in enumerate(df.columns)]
    rows += [(name, None, got[f"x{i}"], got["rows"]) for i, name in enumerate(conditions)]
    spark = df.sparkSession
    # A row a column: one small file.
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(quality_path)
    return read_quality(spark, quality_path)


def read_quality(spark: SparkSession, quality_path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(quality_path)
