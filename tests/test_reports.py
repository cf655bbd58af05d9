"""Aggregates, time series, cohort and monitor operators on tiny frames (FIXTURES §6)."""

import datetime as dt

import pytest

from bazaar.operators import agg, cohort, monitor, timeseries as ts
from bazaar.operators.common import MissingColumnsError, group_agg, mean, money_sum
from bazaar.plans.reports import REPORTS, report

D = dt.date


def facts(spark, rows, cols="order_date date, final_amount_inr double"):
    return spark.createDataFrame(rows, cols)


def test_group_agg_rules(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), (None, 3.0), ("b", None)], "k string, v double")
    out = {r.k: (r.s, r.m) for r in group_agg(df, ["k"], money_sum("v").alias("s"),
                                             mean("v").alias("m")).collect()}
    assert out == {"a": (1.0, 1.0), "b": (0.0, None)}


def test_yoy_growth_cases(spark):
    two = facts(spark, [(D(2018, 1, 1), 100.0), (D(2020, 5, 1), 150.0)])
    assert agg.yoy_growth(two).first().yoy_growth == pytest.approx(0.5)
    one = facts(spark, [(D(2018, 1, 1), 100.0)])
    assert agg.yoy_growth(one).first().yoy_growth is None
    zero = facts(spark, [(D(2018, 1, 1), 0.0), (D(2019, 1, 1), 5.0)])
    assert agg.yoy_growth(zero).first().yoy_growth is None


def test_resample_month_quarter_year(spark):
    df = facts(spark, [(D(2020, 1, 15), 1.0), (D(2020, 3, 10), None), (D(2021, 1, 20), 4.0), (None, 9.0)])
    m = ts.resample_sum(df, "month").orderBy("period_end").collect()
    assert len(m) == 13 and m[0].period_end == D(2020, 1, 31) and m[-1].period_end == D(2021, 1, 31)
    assert [r.revenue for r in m[1:12]] == [0.0] * 11 and m[0].revenue == 1.0 and m[-1].revenue == 4.0
    q = ts.resample_sum(df, "quarter").orderBy("period_end").collect()
    assert len(q) == 5 and q[0].period_end == D(2020, 3, 31)
    y = ts.resample_sum(df, "year").orderBy("period_end").collect()
    assert [(r.period_end, r.revenue) for r in y] == [(D(2020, 12, 31), 1.0), (D(2021, 12, 31), 4.0)]


def test_rolling_mean(spark):
    s = spark.createDataFrame([(D(2020, 1, 31), 1.0), (D(2020, 2, 29), 3.0), (D(2020, 3, 31), 5.0)],
                              "period_end date, revenue double")
    assert [r.rolling12 for r in ts.rolling_mean(s).orderBy("period_end").collect()] == [1.0, 2.0, 3.0]


def test_last_12_months(spark):
    df = facts(spark, [(D(2020, 1, 15), 1.0), (D(2020, 3, 10), 2.0), (D(2021, 1, 20), 4.0)])
    kept = ts.last_months_filter(df).collect()
    assert sorted(r.order_date for r in kept) == [D(2020, 3, 10), D(2021, 1, 20)]


def test_churn_proxy_case(spark):
    df = spark.createDataFrame([(1, D(2020, 1, 1)), (1, D(2020, 1, 2)), (2, None), (3, D(2020, 4, 11))],
                               "customer_id int, order_date date")
    r = cohort.churn_proxy(df).first()
    # newest 2020-04-11: customer 1 is 100 days ago, 2 unknown, 3 current
    assert r.customers == 3 and r.churn_proxy == pytest.approx(1 / 3, abs=1e-6)


def test_launch_performance_window(spark):
    df = spark.createDataFrame([(1, D(2020, 1, 1), 10.0, 1.0), (1, D(2020, 3, 31), 5.0, 1.0),
                                (1, D(2020, 4, 1), 7.0, 1.0), (2, D(2021, 1, 1), 1.0, 2.0)],
                               "product_id int, order_date date, final_amount_inr double, quantity double")
    out = {r.product_id: (r.revenue, r.quantity) for r in cohort.launch_performance(df).collect()}
    assert out == {1: (15.0, 2.0), 2: (1.0, 2.0)}
    joined = cohort.with_first_sale(df).where("product_id = 2").first()
    assert joined.first_sale_date == D(2021, 1, 1)


def test_month_monitor_and_alerts(spark):
    df = spark.createDataFrame([(1, 1, D(2021, 2, 10), 100.0), (2, 2, D(2021, 2, 14), 50.0),
                                (3, 1, D(2021, 1, 5), 999.0)],
                               "transaction_id int, customer_id int, order_date date, final_amount_inr double")
    m = monitor.month_monitor(df).first()
    assert (m.revenue, m.new_customers, m.orders) == (150.0, 2, 2)
    assert m.rev_target == 165 and m.month_label == "Feb 2021"
    assert m.run_rate == pytest.approx(150.0 / 14 * 28, abs=1e-4)
    alerts = {r.kpi: r.shortfall for r in monitor.month_alerts(df).collect()}
    assert alerts == {"revenue": pytest.approx(15.0), "new_customers": 998.0}
    assert monitor.month_alerts(df, rev_target=100, cust_target=0).count() == 0


def test_return_rate_text_never_matches(spark):
    df = spark.createDataFrame([(1, 1, "Returned"), (2, 1, "False"), (3, 2, None)],
                               "transaction_id int, product_id int, return_status string")
    r = agg.return_rate(df).first()
    assert r.returns == 0 and r.orders == 3 and r.active_skus == 2
    assert agg.return_rate(df, returned_values=["Returned"]).first().returns == 1
    # text pandas reads as a boolean counts
    t = spark.createDataFrame([(1, 1, "True")], "transaction_id int, product_id int, return_status string")
    assert agg.return_rate(t).first().returns == 1


def test_require_columns_and_registry(spark):
    df = spark.createDataFrame([(1,)], "x int")
    with pytest.raises(MissingColumnsError):
        agg.top_subcategories(df)
    with pytest.raises(KeyError):
        report("no_such_report", df)
    assert {"kpi_bundle", "launch_performance", "seasonality"} <= set(REPORTS)


def test_profit_margin_missing_values(spark):
    df = spark.createDataFrame([("s", 100.0, 10.0, 2.0), ("s", 50.0, None, 1.0), ("s", None, 10.0, 1.0)],
                               "subcategory string, final_amount_inr double, original_price_inr double, quantity double")
    r = agg.profit_margin(df).first()
    assert r.revenue == 150.0 and r.assumed_cost == pytest.approx(21.0)
    assert r.profit == pytest.approx(100.0 - 14.0) and r.margin_pct == pytest.approx(86.0 / 150.0, abs=1e-6)


def test_approximate_distinct_counts(spark):
    from conftest import SF_SMALL
    from bazaar.sources.tables import fact_table
    facts = fact_table(spark, SF_SMALL)
    exact, approx = agg.kpi_bundle(facts).first(), agg.kpi_bundle(facts, approx=True)
    a = approx.first()
    assert abs(a.active_customers - exact.active_customers) <= 0.03 * exact.active_customers
    assert abs(a.orders - exact.orders) <= 0.03 * exact.orders
    assert a.total_revenue == exact.total_revenue
    plan = approx._jdf.queryExecution().executedPlan().toString()
    assert "approx_count_distinct" in plan and "Expand" not in plan
    months = {r.month_start: r.customers for r in ts.monthly_customers(facts, approx=True).collect()}
    exact_m = {r.month_start: r.customers for r in ts.monthly_customers(facts).collect()}
    assert months.keys() == exact_m.keys()
    assert all(abs(months[k] - exact_m[k]) <= max(1, 0.05 * exact_m[k]) for k in months)
