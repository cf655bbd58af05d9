"""Streaming daily KPIs over order-line files."""

import os

from pyspark.sql import functions as F

from bazaar.sources.tables import sales_view
from bazaar.streaming.live_month import ORDER_LINE_SCHEMA, daily_kpis, read_order_stream


def test_daily_kpis_stream_matches_batch(spark, tmpdir_path):
    from conftest import SF_SMALL
    src = os.path.join(tmpdir_path, "in")
    lines = sales_view(spark, SF_SMALL).select(*[f.name for f in ORDER_LINE_SCHEMA.fields])
    lines.write.mode("overwrite").parquet(src)
    q = (daily_kpis(read_order_stream(spark, src), lateness="0 days").writeStream
         .outputMode("update").format("memory").queryName("daily_kpis_test").start())
    q.processAllAvailable()
    q.stop()
    got = {r.day: (round(r.revenue, 4), r.lines) for r in spark.sql("SELECT * FROM daily_kpis_test").collect()}
    want = {r.d: (round(float(r.rev), 4), r.n) for r in lines.groupBy(F.col("order_date").alias("d"))
            .agg(F.sum("final_amount_inr").alias("rev"), F.count(F.lit(1)).alias("n")).collect()}
    assert got == want


def test_append_mode_emits_closed_days_once(spark, tmpdir_path):
    """Parquet sink + checkpoint: each finished day is written once; the day
    the watermark has not passed yet stays in state."""
    from conftest import SF_SMALL
    from bazaar.streaming.live_month import start_daily_kpis
    src = os.path.join(tmpdir_path, "in")
    lines = sales_view(spark, SF_SMALL).select(*[f.name for f in ORDER_LINE_SCHEMA.fields])
    lines.write.mode("overwrite").parquet(src)
    out, ckpt = os.path.join(tmpdir_path, "out"), os.path.join(tmpdir_path, "ckpt")
    q = start_daily_kpis(read_order_stream(spark, src), out, ckpt, lateness="0 days")
    q.processAllAvailable()
    q.stop()
    days = [r.day for r in spark.read.parquet(out).collect()]
    all_days = sorted(r[0] for r in lines.select("order_date").distinct().collect())
    assert len(days) == len(set(days))
    assert sorted(days) == all_days[:-1]


def test_live_month_equals_the_batch_rows(spark, tmpdir_path):
    """Files sent twice, out of order and late; the job is stopped between files."""
    from conftest import SF_SMALL
    from bazaar.operators import monitor
    from bazaar.streaming import live_month as L
    src, out, ckpt = (os.path.join(tmpdir_path, d) for d in ("in", "out", "ckpt"))
    from bazaar.sources.tables import SALES_SOURCE_ORDER
    lines = sales_view(spark, SF_SMALL).withColumn("line_no", F.xxhash64(*SALES_SOURCE_ORDER))
    lines = lines.select("k", *[F.col(f.name).cast(f.dataType).alias(f.name) for f in L.LIVE_LINE_SCHEMA.fields])
    part = lambda i: lines.where(F.col("k") % 3 == i).drop("k")
    seen = None
    for i in (2, 0, 2, 1, 0):
        part(i).coalesce(1).write.mode("append").parquet(src)
        L.start_live_lines(L.read_order_stream(spark, src, L.LIVE_LINE_SCHEMA), out, ckpt, until_done=True).awaitTermination()
        seen = {i} if seen is None else seen | {i}
        want = monitor.month_monitor(lines.where((F.col("k") % 3).isin(*seen)))
        assert L.live_monitor(spark, out).collect() == want.collect()
    want = monitor.month_alerts(lines, 10**9, 10**6).collect()
    assert L.live_alerts(spark, out, 10**9, 10**6).collect() == want and len(want) == 2
    # Of the live month, each line once.
    month = lines.agg(F.max(F.trunc("order_date", "MM"))).first()[0]
    assert L.live_month(spark, out).count() == lines.where(F.trunc("order_date", "MM") == F.lit(month)).count()
    # A query that starts again with nothing new adds nothing.
    L.start_live_lines(L.read_order_stream(spark, src, L.LIVE_LINE_SCHEMA), out, ckpt, until_done=True).awaitTermination()
    assert L.live_alerts(spark, out, 10**9, 10**6).collect() == want


def test_live_month_reads_one_folder(spark, tmpdir_path):
    import datetime as dt
    from bazaar.streaming import live_month as L
    src, out = os.path.join(tmpdir_path, "in"), os.path.join(tmpdir_path, "out")
    rows = [(1, 1, 7, dt.date(2021, 7, 30)), (2, 1, 7, dt.date(2021, 8, 1)), (2, 1, 7, dt.date(2021, 8, 1)), (3, 1, None, dt.date(2021, 8, 3)),
            (4, 1, 8, None)]
    spark.createDataFrame([(*r, None) for r in rows], L.LIVE_LINE_SCHEMA).write.parquet(src)
    L.start_live_lines(L.read_order_stream(spark, src, L.LIVE_LINE_SCHEMA), out, os.path.join(tmpdir_path, "c"), until_done=True).awaitTermination()
    r = L.live_monitor(spark, out, cust_target=5).first()
    assert (r.revenue, r.new_customers, r.orders, r.month_label, r.customers_delta) == (0.0, 1, 2, "Aug 2021", -4)
    plan = L.live_month(spark, out)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month_no" in plan
