"""Operators stay exact when one key holds a third of all rows."""

import datetime as dt

from pyspark.sql import functions as F

from bazaar.operators import agg, clean as C, cohort


def hot_frame(spark, n=3000):
    # rows 0..n-1; every third row belongs to the hot key (customer 0, product 0)
    return spark.range(n).select(
        F.col("id").alias("pos"),
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 50).alias("customer_id"),
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 40 + 1).alias("product_id"),
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.lit("p")).alias("product_name"),
        F.date_add(F.lit(dt.date(2020, 1, 1)), (F.col("id") % 200).cast("int")).alias("order_date"),
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("S"), (F.col("id") % 5).cast("string")))
        .alias("customer_state"),
        (F.col("id") % 8).cast("int").alias("delivery_days"),
        F.lit(1.5).alias("final_amount_inr"), F.lit(1.0).alias("quantity")).repartition(8)


def test_dedup_hot_null_key(spark):
    df = hot_frame(spark).withColumn("order_date", F.when(F.col("pos") % 3 == 0, F.lit(None))
                                     .otherwise(F.col("order_date")))
    out = C.dedup_keep_first(df, order=["pos"])
    hot = out.where(F.col("customer_id").isNull() & F.col("product_name").isNull()).collect()
    assert len(hot) == 1 and hot[0].pos == 0
    want = df.select("customer_id", "product_name", "order_date").distinct().count()
    assert out.count() == want


def test_median_with_hot_state(spark):
    df = hot_frame(spark)
    rows = {r.customer_state: r.median_delivery_days
            for r in agg.median_delivery_by_state(df, n=None).collect()}
    import statistics
    hot_days = [(i % 8) for i in range(0, 3000, 3)]
    assert rows["HOT"] == statistics.median(hot_days)


def test_launch_cohort_with_hot_product(spark):
    df = hot_frame(spark)
    out = {r.product_id: r.revenue for r in cohort.launch_performance(df, n=None).collect()}
    hot_rows = [i for i in range(0, 3000, 3) if i % 200 <= 90]
    assert out[0] == 1.5 * len(hot_rows)
