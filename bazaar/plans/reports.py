"""Report registry, name -> ``DataFrame -> DataFrame`` over the clean fact table."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame

from bazaar.operators import agg, cohort, monitor, timeseries as ts

REPORTS: dict[str, Callable[..., DataFrame]] = {
    # A1..A19
    "kpi_bundle": agg.kpi_bundle,
    "revenue_by_year": agg.revenue_by_year,
    "yoy_growth": agg.yoy_growth,
    "subcategory_share": agg.subcategory_share,
    "profit_margin": agg.profit_margin,
    "subcategory_year": agg.subcategory_year,
    "subcategory_list": agg.subcategory_list,
    "festival_revenue": agg.festival_revenue,
    "discount_response": agg.discount_response,
    "median_delivery_by_state": agg.median_delivery_by_state,
    "payment_summary": agg.payment_summary,
    "avg_rating_delivery": agg.avg_rating_delivery,
    "return_rate": agg.return_rate,
    "first_last_dates": agg.first_last_dates,
    # K1..K7
    "top_subcategories": agg.top_subcategories,
    "top_states": agg.top_states,
    "top_products_in_subcategory": agg.top_products_in_subcategory,
    "top_products": agg.top_products,
    "top_brands": agg.top_brands,
    "inventory_by_quantity": agg.inventory_by_quantity,
    "launch_performance": cohort.launch_performance,
    # T1..T6
    "revenue_monthly": partial(ts.resample_sum, freq="month"),
    "revenue_quarterly": partial(ts.resample_sum, freq="quarter"),
    "revenue_yearly": partial(ts.resample_sum, freq="year"),
    "revenue_rolling12": ts.revenue_rolling12,
    "monthly_customers": ts.monthly_customers,
    "monthly_skus": ts.monthly_skus,
    "revenue_last12": ts.revenue_last12,
    "cumulative_customers": ts.cumulative_customers,
    "seasonality": ts.seasonality,
    # H2, M1..M6
    "churn_proxy": cohort.churn_proxy,
    "month_monitor": monitor.month_monitor,
    "month_alerts": monitor.month_alerts,
    "month_operations": monitor.month_operations,
    "command_center": monitor.command_center,
}


def report(name: str, df: DataFrame, **params) -> DataFrame:
    """Build one named report over ``df``; unknown names raise ``KeyError``."""
    try:
        fn = REPORTS[name]
    except KeyError:
        raise KeyError(f"unknown report {name!r}; known: {', '.join(sorted(REPORTS))}") from None
    return fn(df, **params)
