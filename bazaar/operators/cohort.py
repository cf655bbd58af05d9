"""Launch cohort (J1, H1) and churn proxy (H2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaar.operators.common import (
    RATIO_PLACES, decimal_total, money, num_sum, plain_number, require_columns, top_k,
)

REV = "final_amount_inr"
DATE = "order_date"


def with_first_sale(df: DataFrame) -> DataFrame:
    """Every row with its product's first sale date (left join).

    The right side has one row per product. It grows with the catalogue, so
    no broadcast is forced: AQE broadcasts it when its runtime size is under
    the threshold and otherwise splits skewed product partitions.
    """
    require_columns(df, ["product_id", DATE], "with_first_sale")
    first = (df.where(F.col("product_id").isNotNull())
               .groupBy("product_id").agg(F.min(DATE).alias("first_sale_date")))
    return df.join(first, "product_id", "left")


def launch_performance(df: DataFrame, window_days: int = 90, n: int | None = 200) -> DataFrame:
    """H1/K7: revenue and units per product within ``window_days`` of its first sale.

    Fact rows are first summed per (product, day), so the later window and
    aggregation see at most one row per product and day: a best-selling
    product no longer lands whole in one task.
    """
    require_columns(df, ["product_id", DATE, REV, "quantity"], "launch_performance")
    daily = (df.where(F.col("product_id").isNotNull() & F.col(DATE).isNotNull())
               .groupBy("product_id", DATE)
               .agg(F.sum(money(REV)).alias("_rev"), F.sum("quantity").alias("_qty"),
                    F.sum(F.when(money(REV).isNull(), plain_number(REV))).alias("_large")))
    first = F.min(DATE).over(Window.partitionBy("product_id"))
    within = (daily.withColumn("first_sale_date", first)
                   .where(F.datediff(F.col(DATE), F.col("first_sale_date")) <= window_days))
    agg = within.groupBy("product_id").agg(
        (decimal_total(F.sum("_rev")) + num_sum("_large")).alias("revenue"), num_sum("_qty").alias("quantity"))
    return top_k(agg, "revenue", ["product_id"], n)


def churn_proxy(df: DataFrame, days: int = 90) -> DataFrame:
    """H2: share of customers whose last order is more than ``days`` before the newest date.

    Customers whose dates are all missing stay in the denominator.
    """
    require_columns(df, ["customer_id", DATE], "churn_proxy")
    now = df.agg(F.max(DATE)).scalar()
    last = (df.where(F.col("customer_id").isNotNull())
              .groupBy("customer_id").agg(F.max(DATE).alias("last_order")))
    gone = F.when(F.datediff(now, F.col("last_order")) > days, F.lit(1.0)).otherwise(F.lit(0.0))
    return last.agg(F.count(F.lit(1)).alias("customers"),
                    F.round(F.avg(gone), RATIO_PLACES).alias("churn_proxy"))
