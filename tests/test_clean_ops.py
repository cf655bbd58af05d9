"""Cleaning DataFrame steps: dedup, quantiles, decimal repair, fills, pipeline properties."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bazaar.operators import clean as C
from bazaar.operators import quantiles as Q


def test_dedup_keep_first_null_keys_match(spark):
    df = spark.createDataFrame([(1, 1, None, "d"), (2, 1, None, "d"), (3, 1, "x", "d")],
                               "pos int, customer_id int, product_name string, order_date string")
    out = C.dedup_keep_first(df, order=["pos"]).orderBy("pos").collect()
    assert [r.pos for r in out] == [1, 3]


def test_dedup_plan_limits_before_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("customer_id"),
                                  F.lit("p").alias("product_name"),
                                  F.lit("d").alias("order_date"), F.col("id").alias("pos"))
    out = C.dedup_keep_first(df, order=["pos"])
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    # one limit after the exchange and one before it (the partial, map-side one)
    exchange_at = plan.find("Exchange hashpartitioning(customer_id")
    assert exchange_at > 0
    assert "WindowGroupLimit" in plan[:exchange_at] and "WindowGroupLimit" in plan[exchange_at:]


def test_iqr_bounds_literal_case(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "original_price_inr double")
    b = C.iqr_bounds(df).first()
    assert b.q1 == pytest.approx(1.75) and b.q3 == pytest.approx(4.75)
    assert Q.quantiles(df, "original_price_inr", [0.5]) == [pytest.approx(2.5)]


def _with_partitions(spark, n, run):
    """``run()`` with ``n`` shuffle partitions, left apart: so many ranges."""
    keys = {"spark.sql.shuffle.partitions": n, "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        return run()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("ranges", ["1", "3", "16"])
def test_exact_quantiles_match_numpy(spark, ranges):
    rnd = random.Random(7)
    vals = [float(rnd.choice([rnd.randint(0, 50), rnd.random() * 1000])) for _ in range(3000)]
    vals += [42.0] * 1000  # one value holds a quarter of the rows
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = _with_partitions(spark, ranges, lambda: Q.quantiles(df, "x", probs))
    want = np.quantile(np.array(vals), probs, method="linear")
    assert got == pytest.approx(list(want), rel=1e-12, abs=1e-9)


def test_quantiles_empty(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert Q.quantiles(df, "x", [0.25, 0.75]) == [None, None]


def test_correct_decimal_cases(spark):
    rows = [(9.995, 1.0), (10.004, 1.0), (100.005, 1.0), (500.0, 0.0), (500.0, None), (50.0, 10.0)]
    df = spark.createDataFrame(rows, "original_price_inr double, expected_price double")
    got = [r[0] for r in df.select(C.correct_decimal()).collect()]
    # 9.995 stays (numpy rounding to 9.99); 10.004 -> /10; 100.005 -> /100; 0 / NULL keep
    assert got == pytest.approx([9.995, 1.0004, 1.00005, 500.0, 500.0, 50.0])


def test_repair_fixes_shifted_prices_and_drops_rest(spark):
    base = [(i, 100.0 + (i % 10), 1.0) for i in range(200)]
    rows = [(i, p * (100 if i == 5 else 10 if i == 6 else 7 if i == 7 else 1), q, p * q)
            for i, p, q in base]
    df = spark.createDataFrame(rows, "i int, original_price_inr double, quantity double, final_amount_inr double")
    out = {r.i: r.original_price_inr for r in C.repair_price_outliers(df).collect()}
    assert out[5] == pytest.approx(105.0) and out[6] == pytest.approx(106.0)
    assert 7 not in out and len(out) == 199


def test_mode_and_fills(spark):
    df = spark.createDataFrame([("b", None, None), ("a", 5.0, "Diwali"), (None, None, None),
                                ("a", 1.0, None), ("b", None, None)],
                               "customer_age_group string, delivery_charges double, festival_name string")
    out = C.fill_missing(df).collect()
    assert [r.customer_age_group for r in out] == ["b", "a", "a", "a", "b"]
    assert [r.delivery_charges for r in out] == [0.0, 5.0, 0.0, 1.0, 0.0]
    assert [r.festival_name for r in out][:3] == ["Normal Day", "Diwali", "Normal Day"]
    assert C.mode_frame(spark.createDataFrame([("b",), ("a",), (None,)], "x string"), "x").first()[0] == "a"


def test_pipeline_properties(spark):
    from bazaar.sources.fixtures import DIRTY_ORDER, dirty_sales
    out = C.clean_pipeline(dirty_sales(spark, "/root/testdata/sf0.001"), DIRTY_ORDER).cache()
    n = out.count()
    assert n > 0
    # keys unique after keep-first
    assert out.select("customer_id", "product_name", "order_date").distinct().count() == n
    # no helper columns left
    for c in ["expected_price", "is_valid_date", "original_order_date", "before_parse_price"]:
        assert c not in out.columns
    # fills done, prices present
    assert out.where(F.col("customer_age_group").isNull() | F.col("festival_name").isNull()
                     | F.col("delivery_charges").isNull() | F.col("original_price_inr").isNull()).count() == 0
    # re-running the outlier step on its own output changes nothing outside the new bounds
    lo, hi = C.iqr_bound_values(out)
    assert lo is not None and hi is not None
    out.unpersist()


@pytest.mark.parametrize("ranges", ["1", "8"])
def test_quantiles_multi_columns(spark, ranges):
    rnd = random.Random(11)
    rows = [(float(rnd.randint(0, 30)), rnd.random() * 50 if i % 3 else None, None)
            for i in range(2000)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    probs = [0.2, 0.4, 0.6, 0.8]
    got = _with_partitions(spark, ranges, lambda: Q.quantiles_multi(df, ["a", "b", "c"], probs))
    for i, name in enumerate(["a", "b"]):
        vals = np.array([r[i] for r in rows if r[i] is not None])
        assert got[name] == pytest.approx(list(np.quantile(vals, probs)), rel=1e-12, abs=1e-9)
    assert got["c"] == [None] * 4
