"""Gold tables (S8): what reports need, summed by month, without the fact rows.

A gold folder has one table a grain: months, months by subcategory, months by
state. A row holds exact partial sums (money as an exact decimal, and as a
double what has no exact form) and mergeable sketches: theta sketches of
customers and orders, a KLL sketch of the delivery days. The month table also
holds the exact distinct customers and orders of each month. Reports merge
rows of gold, so they read kilobytes where the fact table has terabytes:

* sums, counts, newest dates and monthly distinct counts are exact;
* distinct counts over several months, and medians, are estimates (theta with
  2**14 entries: about 0.8 % standard error; KLL: a rank error of about 1 %).

Tables are partitioned by ``order_year``; ``write_gold`` with ``years`` rewrites
those partitions alone, so a refresh costs what the touched years hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaar.operators.agg import growth_of
from bazaar.operators.common import decimal_total, money, plain_number, ratio, require_columns, top_k
from bazaar.operators.monitor import with_targets
from bazaar.plans.joins import attach_scalars

REV = "final_amount_inr"
GRAINS = {"month": [], "subcategory": ["subcategory"], "state": ["customer_state"]}
#: Log2 of the entries of a theta sketch; K of a KLL sketch.
THETA_LG, KLL_K = 14, 200


def gold_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of one grain. Lines without a date have a NULL month. All sums and
    sketches are merged on the map side: one row a key and task is shuffled."""
    exact, plain = money(REV), plain_number(REV)
    month = F.trunc("order_date", "MM")
    group = [F.year("order_date").alias("order_year"), month.alias("month"), *keys]
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum(exact).cast("decimal(38,4)").alias("revenue_exact"),
        F.sum(F.when(exact.isNull(), plain)).alias("revenue_rest"),
        F.sum(plain_number("quantity")).alias("quantity"),
        F.max("order_date").alias("last_date"),
        F.theta_sketch_agg("customer_id", THETA_LG).alias("customers_sketch"),
        F.theta_sketch_agg("transaction_id", THETA_LG).alias("orders_sketch"),
        F.kll_sketch_agg_double(F.col("delivery_days").cast("double"), KLL_K).alias("delivery_sketch"))


def month_rows(df: DataFrame) -> DataFrame:
    """The month grain, with the exact distinct counts of each month."""
    counts = df.groupBy(F.trunc("order_date", "MM").alias("_month")).agg(
        F.count_distinct("customer_id").alias("customers"), F.count_distinct("transaction_id").alias("orders"))
    rows = gold_rows(df, [])
    return rows.join(counts, rows.month.eqNullSafe(counts._month)).drop("_month")


def write_gold(facts: DataFrame, path: str, years: list[int | None] | None = None) -> None:
    """Write all grains of ``facts``; with ``years`` only those years' partitions
    (a year without rows any more is left as it is)."""
    require_columns(facts, ["order_date", REV, "customer_id", "transaction_id", "quantity", "delivery_days"], "gold")
    if years is not None:
        facts = facts.where(in_years("order_year" if "order_year" in facts.columns else F.year("order_date"), years))
    for grain, keys in GRAINS.items():
        if all(k in facts.columns for k in keys):
            rows = month_rows(facts) if grain == "month" else gold_rows(facts, keys)
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("order_year").parquet(f"{path}/{grain}")


def in_years(year: str | Column, years: list[int | None]) -> Column:
    """Rows of the years; None stands for rows without one."""
    y = F.col(year) if isinstance(year, str) else year
    cond = y.isin(*[x for x in years if x is not None])
    return F.coalesce(cond, F.lit(False)) | y.isNull() if None in years else F.coalesce(cond, F.lit(False))


def read_gold(spark: SparkSession, path: str, grain: str = "month") -> DataFrame:
    return spark.read.parquet(f"{path}/{grain}")


# ---- reports -----------------------------------------------------------------

def _revenue() -> Column:
    return decimal_total(F.sum("revenue_exact")) + F.coalesce(F.sum("revenue_rest"), F.lit(0.0))


def _estimate(sketch: str) -> Column:
    return F.coalesce(F.theta_sketch_estimate(F.theta_union_agg(sketch, THETA_LG)), F.lit(0)).cast("long")


def revenue_by_year(gold: DataFrame) -> DataFrame:
    """A5, exact."""
    return gold.where("order_year is not null").groupBy(F.col("order_year").cast("int")).agg(
        _revenue().alias("revenue")).withColumnsRenamed({"CAST(order_year AS INT)": "order_year"}).orderBy("order_year")


def kpis(gold: DataFrame) -> DataFrame:
    """A1..A4 and A6 in one row: revenue and growth exact, customers and orders
    estimated over all months."""
    base = gold.agg(_revenue().alias("total_revenue"), _estimate("customers_sketch").alias("active_customers"),
                    _estimate("orders_sketch").alias("orders"))
    base = base.withColumn("aov", F.coalesce(ratio(F.col("total_revenue"), F.col("orders")), F.lit(0.0)))
    return attach_scalars(base, growth_of(revenue_by_year(gold)).select("yoy_growth"))


def monthly_customers(gold: DataFrame) -> DataFrame:
    """T3, exact (month table)."""
    return gold.where("month is not null").select(F.col("month").alias("month_start"), "customers").orderBy("month_start")


def month_monitor(gold: DataFrame, rev_target: int | None = None, cust_target: int = 1000) -> DataFrame:
    """M1..M3 of the newest month, exact (month table)."""
    last = gold.where(F.col("month") == gold.agg(F.max("month")).scalar())
    base = last.agg(_revenue().alias("revenue"), F.coalesce(F.sum("customers"), F.lit(0)).alias("new_customers"),
                    F.coalesce(F.sum("orders"), F.lit(0)).alias("orders"), F.max("last_date").alias("latest_date"))
    return with_targets(base, rev_target, cust_target)


def ranked(gold: DataFrame, key: str, n: int | None = 10) -> DataFrame:
    """K1, K2: revenue a key over all months, exact; with the customers' estimate."""
    out = gold.where(F.col(key).isNotNull()).groupBy(key).agg(
        _revenue().alias("revenue"), _estimate("customers_sketch").alias("customers_estimate"))
    return top_k(out, "revenue", [key], n)


def median_delivery(gold: DataFrame, key: str = "customer_state", first: str | None = None,
                    last: str | None = None) -> DataFrame:
    """A14 estimated from merged sketches, over the months from ``first`` to ``last``."""
    if first is not None:
        gold = gold.where(F.col("month") >= F.lit(first).cast("date"))
    if last is not None:
        gold = gold.where(F.col("month") <= F.lit(last).cast("date"))
    sketch = F.kll_merge_agg_double("delivery_sketch")
    # A key without delivery days has an empty sketch, which has no median.
    out = gold.where(F.col(key).isNotNull()).groupBy(key).agg(sketch.alias("_sketch"))
    median = F.when(F.kll_sketch_get_n_double("_sketch") > 0, F.kll_sketch_get_quantile_double("_sketch", F.lit(0.5)))
    return out.select(key, median.alias("median_delivery_days")).orderBy(key)
