"""Customer segments and star tables (X1, X2, X4, X5 of SURVEY §2.17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaar.functions.parsing import coerce_boolean
from bazaar.operators.clean import dedup_keep_first, materialise
from bazaar.operators.common import distinct_count, group_agg, money_sum, ratio, require_columns
from bazaar.operators.quantiles import quantiles_multi
from bazaar.schema import WIDE_FALSE_TOKENS, WIDE_TRUE_TOKENS

REV = "final_amount_inr"
DATE = "order_date"


def _score(value: Column, cuts: list[float | None], higher_is_better: bool = True) -> Column:
    """1 + number of cut points strictly below ``value`` (reversed for recency)."""
    score = F.lit(1)
    for c in cuts:
        if c is not None:
            score = score + F.when(value > F.lit(c), 1).otherwise(0)
    top = len(cuts) + 1
    return score if higher_is_better else (F.lit(top + 1) - score)


def rfm(df: DataFrame, bins: int = 5, approx: bool = False) -> DataFrame:
    """Per customer recency (days before the newest date), frequency
    (distinct orders), monetary (revenue), each scored 1..``bins``.

    Scores come from exact quantile cut points of each measure over all
    customers (computed distributed, see ``quantiles.py``), not from a
    global ``ntile`` window, which would sort every customer in one task. The
    per-customer table is staged, so the facts are aggregated once; ``approx``
    counts orders with HyperLogLog++.
    """
    require_columns(df, ["customer_id", "transaction_id", DATE, REV], "rfm")
    now = df.agg(F.max(DATE)).scalar()
    per = materialise(group_agg(
        df, ["customer_id"], F.datediff(now, F.max(DATE)).alias("recency_days"),
        distinct_count("transaction_id", approx).alias("frequency"),
        money_sum(REV).alias("monetary")), "rfm")
    # one pass over the per-customer table for all three sets of cut points
    probs = [i / bins for i in range(1, bins)]
    cuts = quantiles_multi(per, ["recency_days", "frequency", "monetary"], probs)
    return per.select(
        "customer_id", "recency_days", "frequency", "monetary",
        _score(F.col("recency_days"), cuts["recency_days"], higher_is_better=False).alias("r_score"),
        _score(F.col("frequency"), cuts["frequency"]).alias("f_score"),
        _score(F.col("monetary"), cuts["monetary"]).alias("m_score"))


def payment_mix(df: DataFrame) -> DataFrame:
    """Revenue per (year, payment method) and its share of the year.

    The share window is partitioned by year and runs on the aggregated rows.
    """
    require_columns(df, [DATE, "payment_method", REV], "payment_mix")
    per = group_agg(df.withColumn("order_year", F.year(DATE)), ["order_year", "payment_method"],
                    money_sum(REV).alias("revenue"))
    year_total = F.sum("revenue").over(Window.partitionBy("order_year"))
    return per.withColumn("share", ratio(F.col("revenue"), year_total))


def prime_value(df: DataFrame, approx: bool = False, true_tokens: list[str] | None = None,
                false_tokens: list[str] | None = None) -> DataFrame:
    """Customers, orders, revenue and order value, prime against non-prime.

    Flags may be real booleans, numbers or text (``WIDE_TRUE_TOKENS`` and
    ``WIDE_FALSE_TOKENS`` unless others are given); text that is neither, like
    a missing flag, is left out.
    """
    require_columns(df, ["is_prime_member", "customer_id", "transaction_id", REV], "prime_value")
    flag = F.col("is_prime_member")
    if df.schema["is_prime_member"].dataType.simpleString() != "boolean":
        flag = coerce_boolean(flag, true_tokens or WIDE_TRUE_TOKENS, false_tokens or WIDE_FALSE_TOKENS)
    out = group_agg(df.withColumn("is_prime", flag), ["is_prime"],
                    distinct_count("customer_id", approx).alias("customers"),
                    distinct_count("transaction_id", approx).alias("orders"),
                    money_sum(REV).alias("revenue"))
    return out.withColumn("aov", ratio(F.col("revenue"), F.col("orders")))


def star_tables(df: DataFrame, order: list[str]) -> dict[str, DataFrame]:
    """The fact table split into transactions, products, customers and a
    time dimension. Dimension attributes come from each key's first row in
    source order (keep-first, pruned before the shuffle)."""
    require_columns(df, ["transaction_id", "customer_id", "product_id", DATE], "star_tables")
    has = set(df.columns)
    prod_cols = [c for c in ("product_name", "category", "subcategory", "brand",
                             "original_price_inr") if c in has]
    cust_cols = [c for c in ("customer_state", "customer_city", "customer_age_group",
                             "is_prime_member") if c in has]
    fact_cols = [c for c in ("transaction_id", "customer_id", "product_id", DATE, "quantity",
                             "discount_percent", REV, "payment_method", "delivery_days",
                             "return_status") if c in has]
    dates = df.select(DATE).where(F.col(DATE).isNotNull()).distinct()
    time_dim = dates.select(
        DATE, F.year(DATE).alias("year"), F.quarter(DATE).alias("quarter"),
        F.month(DATE).alias("month"), F.dayofmonth(DATE).alias("day"),
        F.dayofweek(DATE).alias("day_of_week"))
    return {"transactions": df.select(*fact_cols),
            "products": _dimension(df, "product_id", prod_cols, order),
            "customers": _dimension(df, "customer_id", cust_cols, order),
            "time_dimension": time_dim}


def _dimension(df: DataFrame, key: str, attrs: list[str], order: list[str]) -> DataFrame:
    cols = list(dict.fromkeys([key, *attrs, *order]))
    kept = dedup_keep_first(df.where(F.col(key).isNotNull()).select(*cols), [key], order)
    return kept.select(key, *attrs)
