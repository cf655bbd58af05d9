"""Calendar series (T1..T6): gap-filled period sums, rolling and running measures.

Aggregation happens first (one row per period); spines, rolling windows and
running sums then work on that short series, never on fact rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaar.operators.common import RATIO_PLACES, distinct_count, money_sum, require_columns

REV = "final_amount_inr"
DATE = "order_date"

# freq -> (trunc unit, months per step)
FREQS = {"month": ("MM", 1), "quarter": ("QUARTER", 3), "year": ("YEAR", 12)}


def period_start(d: Column, freq: str) -> Column:
    unit, _ = FREQS[freq]
    return F.trunc(d, unit)


def period_end(start: Column, freq: str) -> Column:
    """Last day of the period that begins at ``start`` (pandas period-end label)."""
    _, step = FREQS[freq]
    if step == 1:
        return F.last_day(start)
    return F.date_sub(F.add_months(start, step), 1)


def resample_sum(df: DataFrame, freq: str = "month", value: str = REV,
                 date_col: str = DATE, out: str = "revenue") -> DataFrame:
    """Sum of ``value`` per calendar period, labelled by the period's last
    day, in time order.

    Periods between the first and the last dated row with no rows are
    present with 0; rows without a date are ignored.
    """
    return _resample(df, freq, value, date_col, out).orderBy("period_end")


def _resample(df: DataFrame, freq: str = "month", value: str = REV,
              date_col: str = DATE, out: str = "revenue") -> DataFrame:
    if freq not in FREQS:
        raise ValueError(f"freq must be one of {sorted(FREQS)}")
    require_columns(df, [date_col, value], "resample_sum")
    _, step = FREQS[freq]
    per = (df.where(F.col(date_col).isNotNull())
             .groupBy(period_start(F.col(date_col), freq).alias("_p"))
             .agg(money_sum(value).alias(out)))
    spine = (per.agg(F.min("_p").alias("lo"), F.max("_p").alias("hi"))
                .where(F.col("lo").isNotNull())
                .select(F.explode(F.sequence("lo", "hi", F.expr(f"INTERVAL {step} MONTH"))).alias("_p")))
    return (spine.join(per, "_p", "left")
                 .select(period_end(F.col("_p"), freq).alias("period_end"),
                         F.coalesce(F.col(out), F.lit(0.0)).alias(out)))


def rolling_mean(series: DataFrame, value: str = "revenue", rows: int = 12,
                 order: str = "period_end", out: str | None = None) -> DataFrame:
    """Trailing mean over ``rows`` rows (at least one row)."""
    w = Window.orderBy(order).rowsBetween(-(rows - 1), Window.currentRow)
    return series.withColumn(out or f"rolling{rows}", F.round(F.avg(value).over(w), RATIO_PLACES))


def revenue_rolling12(df: DataFrame) -> DataFrame:
    """T1 monthly + T2."""
    return rolling_mean(_resample(df, "month"))


def monthly_distinct(df: DataFrame, id_col: str, date_col: str = DATE,
                     out: str | None = None, approx: bool = False) -> DataFrame:
    """Distinct ``id_col`` per month, labelled by the month's first day, in
    time order.

    Months without rows are absent. Spark pre-aggregates (month, id) pairs on
    the map side, so a busy month is spread over many tasks.
    """
    return _monthly(df, id_col, date_col, out, approx).orderBy("month_start")


def _monthly(df: DataFrame, id_col: str, date_col: str = DATE,
             out: str | None = None, approx: bool = False) -> DataFrame:
    require_columns(df, [date_col, id_col], "monthly_distinct")
    return (df.where(F.col(date_col).isNotNull())
              .groupBy(F.trunc(F.col(date_col), "MM").alias("month_start"))
              .agg(distinct_count(id_col, approx).alias(out or f"distinct_{id_col}")))


def monthly_customers(df: DataFrame, approx: bool = False) -> DataFrame:
    return monthly_distinct(df, "customer_id", out="customers", approx=approx)


def monthly_skus(df: DataFrame, approx: bool = False) -> DataFrame:
    return monthly_distinct(df, "product_id", out="skus", approx=approx)


def cumulative_customers(df: DataFrame, approx: bool = False) -> DataFrame:
    """T5: running total of T3 monthly customers (repeat customers recount)."""
    w = Window.orderBy("month_start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _monthly(df, "customer_id", out="customers", approx=approx).withColumn("cumulative", F.sum("customers").over(w))


def last_months_filter(df: DataFrame, months: int = 12, date_col: str = DATE) -> DataFrame:
    """F8: rows of the ``months`` calendar months ending with the newest date's month.

    The cut-off is a scalar subquery on the newest date. With ``order_year``
    (which must hold the year of ``order_date``) the newest date is looked for
    in the newest year alone, and the year is filtered too, which prunes the
    folders of a table partitioned by it.
    """
    newest = df
    if date_col == DATE and "order_year" in df.columns:
        year = df.agg(F.max("order_year")).scalar()
        newest = df.where(F.col("order_year") == year)
        df = df.where(F.col("order_year") >= year - F.lit((months + 10) // 12))
    return df.where(F.col(date_col) >= newest.agg(
        F.add_months(F.trunc(F.max(date_col), "MM"), -(months - 1))).scalar())


def revenue_last12(df: DataFrame) -> DataFrame:
    """T4: monthly revenue over the last 12 calendar months (defined on sorted dates)."""
    return resample_sum(last_months_filter(df, 12), "month")


def seasonality(df: DataFrame) -> DataFrame:
    """Mean monthly revenue per calendar month 1..12 (zero months count)."""
    monthly = _resample(df, "month")
    return (monthly.groupBy(F.month("period_end").alias("month"))
                   .agg(F.round(F.avg("revenue"), RATIO_PLACES).alias("avg_revenue"))
                   .orderBy("month"))
