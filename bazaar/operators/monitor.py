"""Current-month monitoring (M1..M6).

"Current month" is the calendar month of the newest order date. Its first day
is a scalar subquery on that date, so the month filter compares the bare date
column and runs right at the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaar.operators.agg import kpi_bundle
from bazaar.operators.common import distinct_count, money_sum, present_means, require_columns

REV = "final_amount_inr"
DATE = "order_date"


def current_month(df: DataFrame) -> DataFrame:
    """rows of the newest date's calendar month.

    The month's first day is computed inside a scalar subquery, so the filter
    compares the bare date column with a ready value and reaches the Parquet
    scan; no date is beyond the newest, so it needs no upper bound. On a table
    with ``order_year`` the newest year is found first (from partition values,
    no column data), and only that year's folder is read, by the subquery too.
    """
    if "order_year" in df.columns:
        df = df.where(F.col("order_year") == df.agg(F.max("order_year")).scalar())
    return df.where(F.col(DATE) >= df.agg(F.trunc(F.max(DATE), "MM")).scalar())


def month_monitor(df: DataFrame, rev_target: int | None = None,
                  cust_target: int = 1000, approx: bool = False) -> DataFrame:
    """M1..M3: month revenue, customers, orders, targets, deltas and run-rate (one row).

    The default revenue target is the integer part of 1.1 x month revenue.
    Customers are distinct buyers of the month (not checked against history).
    """
    require_columns(df, [DATE, REV, "customer_id"], "month_monitor")
    orders = (distinct_count("transaction_id", approx) if "transaction_id" in df.columns
              else F.count(F.lit(1)))
    base = current_month(df).agg(
        money_sum(REV).alias("revenue"),
        distinct_count("customer_id", approx).alias("new_customers"),
        orders.alias("orders"),
        F.max(DATE).alias("latest_date"))
    return with_targets(base, rev_target, cust_target)


def with_targets(base: DataFrame, rev_target: int | None = None, cust_target: int = 1000) -> DataFrame:
    """M2, M3: targets, distances to them and run-rate of a month's row
    (revenue, new_customers, orders, latest_date)."""
    latest = F.col("latest_date")
    target = (F.lit(int(rev_target)).cast("bigint") if rev_target is not None
              else (F.col("revenue") * 1.1).cast("bigint"))
    return (base
            .withColumn("month_label", F.date_format(latest, "MMM yyyy"))
            .withColumn("rev_target", target)
            .withColumn("cust_target", F.lit(int(cust_target)).cast("bigint"))
            .withColumn("revenue_delta", F.round(F.col("revenue") - F.col("rev_target"), 4))
            .withColumn("customers_delta", F.col("new_customers") - F.col("cust_target"))
            .withColumn("run_rate", F.round(
                F.col("revenue") / F.dayofmonth(latest).cast("double")
                * F.dayofmonth(F.last_day(latest)), 4)))


def month_alerts(df: DataFrame, rev_target: int | None = None,
                 cust_target: int = 1000, approx: bool = False) -> DataFrame:
    """M4: one row per KPI below a positive target: (kpi, target, actual, shortfall)."""
    return alerts_of(month_monitor(df, rev_target, cust_target, approx))


def alerts_of(m: DataFrame) -> DataFrame:
    """M4 of a row of ``month_monitor``."""
    rev = F.when((F.col("rev_target") > 0) & (F.col("revenue") < F.col("rev_target")),
                 F.struct(F.lit("revenue").alias("kpi"),
                          F.col("rev_target").cast("double").alias("target"),
                          F.col("revenue").alias("actual"),
                          F.round(F.col("rev_target") - F.col("revenue"), 4).alias("shortfall")))
    cust = F.when((F.col("cust_target") > 0) & (F.col("new_customers") < F.col("cust_target")),
                  F.struct(F.lit("new_customers").alias("kpi"),
                           F.col("cust_target").cast("double").alias("target"),
                           F.col("new_customers").cast("double").alias("actual"),
                           (F.col("cust_target") - F.col("new_customers")).cast("double")
                           .alias("shortfall")))
    return (m.select(F.explode(F.array_compact(F.array(rev, cust))).alias("a"))
             .select("a.kpi", "a.target", "a.actual", "a.shortfall"))


def month_operations(df: DataFrame) -> DataFrame:
    """M5: mean delivery days and mean customer rating of the current month, of
    those of the two columns that exist."""
    require_columns(df, [DATE], "month_operations")
    return current_month(df).agg(*present_means(df, "month_operations", ["delivery_days", "customer_rating"]))


def command_center(df: DataFrame, approx: bool = False) -> DataFrame:
    """M6: KPI bundle plus a status: ``alert`` when growth is known and negative."""
    k = kpi_bundle(df, approx)
    status = F.when(F.col("yoy_growth").isNotNull() & (F.col("yoy_growth") < 0), F.lit("alert")) \
              .otherwise(F.lit("ok"))
    return k.select("total_revenue", "active_customers", "yoy_growth", status.alias("status"))
