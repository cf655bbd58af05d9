"""Exact quantiles (linear interpolation) without one task holding all values.

``percentile()`` merges a map of every distinct value into one final task
for a global quantile. Here instead, at every size:

1. values are counted per distinct value (map-side combine, one shuffle);
2. the counts are range-partitioned by value and written to the shared
   checkpoint folder, one folder per range; a range's total (one row per
   column and range on the driver) gives its first rank;
3. only the ranges holding the wanted ranks are read again and ranked, each
   in its own task.

Several columns are handled together: their value counts share the shuffles
and the final job. Ranges are as many as shuffle partitions, so they grow with
the data.

The result is the number DuckDB's ``quantile_cont`` gives: with ``n``
values and ``pos = (n - 1) * p``, value[floor] + (value[ceil] -
value[floor]) * (pos - floor). (Spark's ``percentile`` computes the same
interpolation in a different floating-point form, which can differ in the
last bit.)
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaar.session import scratch_path


def _value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(m, v, c): for column index m, each distinct value v and its count c."""
    if len(cols) == 1:
        pairs = df.select(F.lit(0).alias("m"), F.col(cols[0]).cast("double").alias("v"))
    else:
        tagged = F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col(c).cast("double").alias("v"))
                                     for i, c in enumerate(cols)]))
        pairs = df.select(tagged.alias("p")).select("p.m", "p.v")
    return (pairs.where(F.col("v").isNotNull() & ~F.isnan("v"))
              .groupBy("m", "v").agg(F.count(F.lit(1)).alias("c")))


def _staged_ranges(df: DataFrame, cols: list[str]) -> DataFrame:
    """Value counts in ranges: (m, v, c) with the range number ``r`` as folder.
    Ranges follow one another in the order of (m, v)."""
    spark = df.sparkSession
    path = scratch_path(spark, f"ranges-{uuid.uuid4().hex}")
    (_value_counts(df, cols).repartitionByRange("m", "v")
     .withColumn("r", F.spark_partition_id()).write.partitionBy("r").parquet(path))
    return spark.read.schema("m int, v double, c long, r int").parquet(path)


def _rank_plan(n: int, probs: list[float]) -> list[tuple[int, int, float]]:
    """(lower rank, upper rank, fraction between them) for each probability."""
    out = []
    for p in probs:
        pos = (n - 1) * p
        out.append((math.floor(pos), math.ceil(pos), pos - math.floor(pos)))
    return out


def _names(probs: list[float], names: list[str] | None) -> list[str]:
    return names or [f"q{int(round(p * 100))}" for p in probs]


def _quantiles(df: DataFrame, cols: list[str], probs: list[float], names: list[list[str]]) -> DataFrame:
    """One row with the quantiles of all columns, named by ``names``."""
    ranges = _staged_ranges(df, cols)
    totals = ranges.groupBy("m", "r").agg(F.sum("c").alias("t")).collect()
    first, n = {}, dict.fromkeys(range(len(cols)), 0)
    for row in sorted(totals, key=lambda x: (x["m"], x["r"])):
        first[row["m"], row["r"]] = n[row["m"]]
        n[row["m"]] += row["t"]

    def range_of(m: int, rank: int) -> int:
        return max(r for (k, r), start in first.items() if k == m and start <= rank)

    wanted: dict[tuple[int, int], set[int]] = {}
    for m in range(len(cols)):
        for lo, hi, _ in _rank_plan(n[m], probs) if n[m] else []:
            for rank in (lo, hi):
                wanted.setdefault((m, range_of(m, rank)), set()).add(rank)

    offset = F.lit(None).cast("long")
    for m, r in sorted(wanted):
        offset = F.when((F.col("m") == m) & (F.col("r") == r), F.lit(first[m, r]).cast("long")).otherwise(offset)
    running = Window.partitionBy("m", "r").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (ranges.where(F.col("r").isin(*sorted({r for _, r in wanted})))
              .withColumn("start", offset).where("start is not null")
              .withColumn("end", F.col("start") + F.sum("c").over(running))
              .withColumn("start", F.col("end") - F.col("c")))
    aggs, picks = [], []
    for m, col_names in enumerate(names):
        for (lo, hi, frac), name in zip(_rank_plan(n[m], probs), col_names, strict=True):
            if not n[m]:
                picks.append(F.lit(None).cast("double").alias(name))
                continue
            k = len(aggs)
            for rank in (lo, hi):
                hit = (F.col("m") == m) & (F.col("start") <= rank) & (F.col("end") > rank)
                aggs.append(F.max(F.when(hit, F.col("v"))).alias(f"_a{len(aggs)}"))
            lo_v, hi_v = F.col(f"_a{k}"), F.col(f"_a{k + 1}")
            picks.append((lo_v if lo == hi else lo_v + (hi_v - lo_v) * F.lit(frac)).alias(name))
    if not aggs:
        return df.sparkSession.range(1).select(*picks)
    return ranked.agg(*aggs).select(*picks)


def quantile_frame(df: DataFrame, col: str, probs: list[float], names: list[str] | None = None) -> DataFrame:
    """One-row DataFrame with the exact quantiles of ``col`` (NULL/NaN ignored).

    The value counts are staged now; reading the wanted ranges stays lazy.
    """
    return _quantiles(df, [col], probs, [_names(probs, names)])


def quantiles_multi(df: DataFrame, cols: list[str], probs: list[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of several columns as Python floats, in one pass."""
    names = [[f"_c{i}_{j}" for j in range(len(probs))] for i in range(len(cols))]
    row = _quantiles(df, cols, probs, names).first()
    return {c: [row[x] for x in names[i]] for i, c in enumerate(cols)}


def quantiles(df: DataFrame, col: str, probs: list[float]) -> list[float | None]:
    """The exact quantiles of one column as Python floats."""
    return quantiles_multi(df, [col], probs)[col]
