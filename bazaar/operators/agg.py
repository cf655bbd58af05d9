"""KPI aggregates (A1..A19) and ranked reports (K1..K8).

Every function takes the order-line fact table (clean, typed) and returns a
lazy DataFrame. Money sums go through exact decimals (``money_sum``), NULL
group keys are dropped and empty sums are 0, as the reference does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaar.operators.common import (
    distinct_count, exact_sum, group_agg, is_true, money, money_sum, num_sum, plain_number,
    present_means, ratio, require_columns, require_date, top_k,
)
from bazaar.plans.joins import attach_scalars

REV = "final_amount_inr"


def _with_year(df: DataFrame) -> DataFrame:
    require_date(df)
    return df if "order_year" in df.columns else df.withColumn("order_year", F.year("order_date"))


def _order_count(df: DataFrame, approx: bool = False) -> Column:
    """A3: distinct transactions, or the row count without that column."""
    if "transaction_id" in df.columns:
        return distinct_count("transaction_id", approx)
    return F.count(F.lit(1))


# ---- A1..A7 -----------------------------------------------------------------

def _by_year(df: DataFrame) -> DataFrame:
    require_columns(df, [REV], "revenue_by_year")
    return group_agg(_with_year(df), ["order_year"], money_sum(REV).alias("revenue"))


def revenue_by_year(df: DataFrame) -> DataFrame:
    """A5: revenue per order year, oldest first."""
    return _by_year(df).orderBy("order_year")


def yoy_growth(df: DataFrame) -> DataFrame:
    """Last listed year against the previous listed year (one row).

    The window has no partition key on purpose: it runs on the per-year
    series (one row per year), after the aggregation.
    """
    return growth_of(_by_year(df))


def growth_of(by_year: DataFrame) -> DataFrame:
    """A6 of a table with one row a year: order_year, revenue."""
    w = Window.orderBy("order_year")
    ranked = (by_year
              .withColumn("prev_year", F.lag("order_year").over(w))
              .withColumn("prev_revenue", F.lag("revenue").over(w))
              .withColumn("is_last", F.lead("order_year").over(w).isNull()))
    growth = F.when(F.col("prev_revenue") != 0,
                    F.round((F.col("revenue") - F.col("prev_revenue")) / F.col("prev_revenue"), 6))
    # A global aggregate over the (at most one) last row: always one row out.
    return ranked.where("is_last").agg(
        F.max("order_year").alias("last_year"), F.max("revenue").alias("last_revenue"),
        F.max("prev_year").alias("prev_year"), F.max("prev_revenue").alias("prev_revenue"),
        F.max(growth).alias("yoy_growth"))


def kpi_bundle(df: DataFrame, approx: bool = False) -> DataFrame:
    """A1..A4 + A6 in one row: revenue, customers, orders, AOV, growth.

    ``approx`` counts customers and orders with HyperLogLog++ instead of
    exactly (for very large tables; the reference counts exactly).
    """
    require_columns(df, [REV, "customer_id"], "kpi_bundle")
    require_date(df, "kpi_bundle")
    base = df.agg(
        money_sum(REV).alias("total_revenue"),
        distinct_count("customer_id", approx).alias("active_customers"),
        _order_count(df, approx).alias("orders"),
    ).withColumn("aov", F.coalesce(ratio(F.col("total_revenue"), F.col("orders")), F.lit(0.0)))
    growth = yoy_growth(df).select("yoy_growth")
    return attach_scalars(base, growth)


# ---- A8..A19 ----------------------------------------------------------------

def subcategory_share(df: DataFrame) -> DataFrame:
    """Revenue per subcategory and its share of the total, highest first."""
    require_columns(df, ["subcategory", REV], "subcategory_share")
    rev = group_agg(df, ["subcategory"], money_sum(REV).alias("revenue"))
    # The total is a one-row aggregate of the grouped result (the grouping
    # exchange is reused), attached by broadcast: no step gathers the
    # groups into one partition.
    total = rev.agg(F.sum("revenue").alias("_total"))
    out = (attach_scalars(rev, total)
           .select("subcategory", "revenue", ratio(F.col("revenue"), F.col("_total")).alias("share")))
    return top_k(out, "revenue", ["subcategory"], None)


def profit_margin(df: DataFrame, cost_pct: float = 70, n: int | None = 20) -> DataFrame:
    """Assumed cost = price * cost_pct/100 * quantity; profit and margin.

    A row without price or quantity adds nothing to cost or profit but still
    to revenue; a row without revenue still adds to cost.
    """
    require_columns(df, ["subcategory", REV, "original_price_inr", "quantity"], "profit_margin")
    if not 0 <= cost_pct <= 1000:
        raise ValueError("cost_pct out of range")
    pq = money("original_price_inr") * money("quantity")
    plain_pq = plain_number("original_price_inr") * plain_number("quantity")
    fin, plain_fin = money(REV), plain_number(REV)
    agg = group_agg(
        df, ["subcategory"],
        money_sum(REV).alias("revenue"),
        exact_sum(pq, plain_pq).alias("_pq"),
        exact_sum(fin, plain_fin, plain_pq.isNotNull()).alias("_fin_both"),
        exact_sum(pq, plain_pq, plain_fin.isNotNull()).alias("_pq_both"),
    )
    pct = F.lit(float(cost_pct))
    out = agg.select(
        "subcategory", "revenue",
        F.round(F.col("_pq") * pct / 100.0, 4).alias("assumed_cost"),
        F.round(F.col("_fin_both") - F.col("_pq_both") * pct / 100.0, 4).alias("profit"),
    ).withColumn("margin_pct", ratio(F.col("profit"), F.col("revenue")))
    return top_k(out, "revenue", ["subcategory"], n)


def subcategory_year(df: DataFrame) -> DataFrame:
    """A10: revenue per subcategory and year, in key order."""
    require_columns(df, ["subcategory", REV], "subcategory_year")
    keys = ["subcategory", "order_year"]
    return group_agg(_with_year(df), keys, money_sum(REV).alias("revenue")).orderBy(*keys)


def subcategory_list(df: DataFrame) -> DataFrame:
    """The distinct subcategories, in key order."""
    require_columns(df, ["subcategory"], "subcategory_list")
    return df.select("subcategory").where(F.col("subcategory").isNotNull()).distinct().orderBy("subcategory")


def festival_revenue(df: DataFrame) -> DataFrame:
    """Revenue per festival over festival-sale rows, highest first."""
    require_columns(df, ["is_festival_sale", "festival_name", REV], "festival_revenue")
    fest = df.where(is_true(df, "is_festival_sale"))
    return top_k(group_agg(fest, ["festival_name"], money_sum(REV).alias("revenue")),
                 "revenue", ["festival_name"], None)


def discount_response(df: DataFrame, n: int | None = None) -> DataFrame:
    """Quantity and revenue per discount level, lowest discounts first.

    All levels by default (the curve); ``n`` keeps the first ones (K8, the
    reference's side table shows 50)."""
    require_columns(df, ["discount_percent", "quantity", REV], "discount_response")
    agg = group_agg(df, ["discount_percent"],
                    num_sum("quantity").alias("quantity"), money_sum(REV).alias("revenue"))
    return top_k(agg, "discount_percent", [], n, ascending=True)


def median_delivery_by_state(df: DataFrame, n: int | None = 30) -> DataFrame:
    """Exact median delivery days per state, fastest first.

    Values are first counted per (state, days) so the shuffle carries one row
    per distinct pair; the median then weighs each distinct value by its
    count (its buffer holds distinct values only, a handful of day counts).
    """
    require_columns(df, ["customer_state", "delivery_days"], "median_delivery_by_state")
    counted = (df.where(F.col("customer_state").isNotNull())
                 .groupBy("customer_state", "delivery_days").agg(F.count(F.lit(1)).alias("_n")))
    # percentile skips NULL values: a state with no known days gets NULL.
    med = counted.groupBy("customer_state").agg(
        F.round(F.percentile(F.col("delivery_days").cast("double"), F.lit(0.5), F.col("_n")), 6)
        .alias("median_delivery_days"))
    return top_k(med, "median_delivery_days", ["customer_state"], n, ascending=True)


def payment_summary(df: DataFrame, approx: bool = False) -> DataFrame:
    """Distinct transactions and revenue per payment method, in key order."""
    require_columns(df, ["payment_method", "transaction_id", REV], "payment_summary")
    return group_agg(df, ["payment_method"],
                     distinct_count("transaction_id", approx).alias("orders"),
                     money_sum(REV).alias("revenue")).orderBy("payment_method")


def avg_rating_delivery(df: DataFrame) -> DataFrame:
    """Mean customer rating and mean delivery days (missing ignored), of
    those of the two columns that exist; at least one must."""
    return df.agg(*present_means(df, "avg_rating_delivery", ["customer_rating", "delivery_days"]))


def return_rate(df: DataFrame, returned_values: list | None = None,
                approx: bool = False) -> DataFrame:
    """A17 + A18: orders, returned rows, return rate and active SKUs.

    Default counts rows whose ``return_status`` is boolean true (text such as
    ``Returned`` never matches, as in the reference); ``returned_values``
    widens the match.
    """
    require_columns(df, ["return_status", "product_id"], "return_rate")
    if returned_values is None:
        is_ret = is_true(df, "return_status")
    else:
        is_ret = F.col("return_status").cast("string").isin(*[str(v) for v in returned_values])
    return df.agg(
        _order_count(df, approx).alias("orders"),
        F.count_if(is_ret).alias("returns"),
        distinct_count("product_id", approx).alias("active_skus"),
    ).withColumn("return_rate", ratio(F.col("returns"), F.col("orders")))


def first_last_dates(df: DataFrame) -> DataFrame:
    """First and newest order date."""
    require_columns(df, ["order_date"], "first_last_dates")
    return df.agg(F.min("order_date").alias("first_date"), F.max("order_date").alias("last_date"))


# ---- K1..K6 -----------------------------------------------------------------

def top_by_revenue(df: DataFrame, key: str, n: int | None) -> DataFrame:
    require_columns(df, [key, REV], f"top {key}")
    return top_k(group_agg(df, [key], money_sum(REV).alias("revenue")), "revenue", [key], n)


def top_subcategories(df: DataFrame, n: int = 5) -> DataFrame:
    """K1."""
    return top_by_revenue(df, "subcategory", n)


def top_states(df: DataFrame, n: int = 10) -> DataFrame:
    """K2 (10 on the strategic page, 20 on the geographic page)."""
    return top_by_revenue(df, "customer_state", n)


def top_brands(df: DataFrame, n: int = 30) -> DataFrame:
    """K5."""
    return top_by_revenue(df, "brand", n)


def top_products_in_subcategory(df: DataFrame, subcategory: str | None = None,
                                n: int = 50) -> DataFrame:
    """K3: products of one subcategory by revenue (sums of revenue, quantity).

    Without a choice the first subcategory in key order is used, like the
    reference's default selection; it is a scalar subquery, so the plan
    stays lazy.
    """
    require_columns(df, ["subcategory", "product_id", "quantity", REV], "top_products_in_subcategory")
    if subcategory is None:
        chosen = df.agg(F.min("subcategory")).scalar()
    else:
        chosen = F.lit(subcategory)
    sel = df.where(F.col("subcategory") == chosen)
    agg = group_agg(sel, ["product_id"], money_sum(REV).alias("revenue"),
                    num_sum("quantity").alias("quantity"))
    return top_k(agg, "revenue", ["product_id"], n)


def top_products(df: DataFrame, n: int = 200) -> DataFrame:
    """K4: revenue and quantity per (product_id, product_name)."""
    require_columns(df, ["product_id", "product_name", "quantity", REV], "top_products")
    agg = group_agg(df, ["product_id", "product_name"], money_sum(REV).alias("revenue"),
                    num_sum("quantity").alias("quantity"))
    return top_k(agg, "revenue", ["product_id", "product_name"], n)


def inventory_by_quantity(df: DataFrame, n: int = 200) -> DataFrame:
    """K6: SKUs by units sold."""
    require_columns(df, ["product_id", "quantity", REV], "inventory_by_quantity")
    agg = group_agg(df, ["product_id"], num_sum("quantity").alias("quantity"),
                    money_sum(REV).alias("revenue"))
    return top_k(agg, "quantity", ["product_id"], n)
