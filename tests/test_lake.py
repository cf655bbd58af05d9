"""Gold tables, new files only, and keep-first over loads."""

import os

import pytest
from pyspark.sql import functions as F

from bazaar.operators import agg, clean, monitor, timeseries
from bazaar.operators.common import MissingColumnsError
from bazaar.sources import gold, lake, sinks
from bazaar.sources.tables import SALES_SOURCE_ORDER, fact_table
from conftest import SF_SMALL


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def facts(spark):
    return fact_table(spark, SF_SMALL)


@pytest.fixture(scope="module")
def gold_path(spark, facts):
    import tempfile
    path = tempfile.mkdtemp(prefix="bazaar-test-") + "/gold"
    gold.write_gold(facts, path)
    return path


def test_exact_reports_equal_those_of_the_facts(spark, facts, gold_path):
    month, state = gold.read_gold(spark, gold_path), gold.read_gold(spark, gold_path, "state")
    assert rows(gold.revenue_by_year(month)) == rows(agg.revenue_by_year(facts))
    assert rows(gold.monthly_customers(month)) == rows(timeseries.monthly_customers(facts))
    assert rows(gold.month_monitor(month)) == rows(monitor.month_monitor(facts))
    assert rows(monitor.alerts_of(gold.month_monitor(month, 10**9))) == rows(monitor.month_alerts(facts, 10**9))
    assert rows(gold.ranked(state, "customer_state").select("customer_state", "revenue")) == \
        rows(agg.top_states(facts).select("customer_state", "revenue"))
    a, b = gold.kpis(month).first(), agg.kpi_bundle(facts).first()
    assert (a.total_revenue, a.yoy_growth) == (b.total_revenue, b.yoy_growth)


def test_sketches_are_near(spark, facts, gold_path):
    a, b = gold.kpis(gold.read_gold(spark, gold_path)).first(), agg.kpi_bundle(facts).first()
    assert abs(a.active_customers / b.active_customers - 1) < 0.03 and abs(a.orders / b.orders - 1) < 0.03
    # More ids than a sketch has entries.
    many = spark.range(200_000).select(
        F.col("id").alias("customer_id"), (F.col("id") % 90_000).alias("transaction_id"), F.lit(1.0).alias("quantity"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 300).cast("int")).alias("order_date"),
        F.lit(1).cast("decimal(18,4)").alias("final_amount_inr"), (F.col("id") % 1000).cast("double").alias("delivery_days"),
        F.concat(F.lit("s"), F.col("id") % 3).alias("customer_state"))
    month, state = gold.gold_rows(many, []), gold.gold_rows(many, ["customer_state"])
    k = gold.kpis(month).first()
    assert abs(k.active_customers / 200_000 - 1) < 0.03 and abs(k.orders / 90_000 - 1) < 0.03
    for first, last in ((None, None), ("2020-02-01", "2020-04-01")):
        for r in gold.median_delivery(state, first=first, last=last).collect():
            part = many.where(F.col("customer_state") == r.customer_state)
            if first:
                part = part.where(F.trunc("order_date", "MM").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
            below = part.agg(F.avg((F.col("delivery_days") < r.median_delivery_days).cast("int"))).first()[0]
            assert abs(below - 0.5) < 0.03


def test_reports_read_gold_only(spark, gold_path):
    month = gold.read_gold(spark, gold_path)
    for df in (gold.kpis(month), gold.month_monitor(month), gold.revenue_by_year(month)):
        assert all(f"{gold_path}/month/" in f for f in df.inputFiles())
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_rows_without_a_date_empty_tables_and_missing_columns(spark, facts, tmpdir_path):
    odd = facts.limit(50).withColumn("order_date", F.when(F.col("k") % 3 > 0, F.col("order_date"))).drop("order_year") \
        .withColumn("delivery_days", F.lit(None).cast("int"))
    gold.write_gold(odd, f"{tmpdir_path}/g")
    month = gold.read_gold(spark, f"{tmpdir_path}/g")
    assert gold.kpis(month).first().total_revenue == agg.kpi_bundle(odd).first().total_revenue
    assert rows(gold.revenue_by_year(month)) == rows(agg.revenue_by_year(odd))
    assert {r.median_delivery_days for r in gold.median_delivery(gold.read_gold(spark, f"{tmpdir_path}/g", "state")).collect()} == {None}
    none = gold.gold_rows(odd.limit(0), [])
    assert gold.kpis(none).first().total_revenue == 0.0 and gold.ranked(gold.gold_rows(odd.limit(0), ["brand"]), "brand").count() == 0
    with pytest.raises(MissingColumnsError):
        gold.write_gold(odd.drop("customer_id"), f"{tmpdir_path}/h")


def yearly(facts, source, year, name=None, drop=()):
    part = facts.where(F.year("order_date") == year).select(
        "k", "customer_id", "transaction_id", "product_name", F.date_format("order_date", "dd/MM/yyyy").alias("order_date"),
        F.col("final_amount_inr").cast("string"), F.col("quantity").cast("string"), F.col("delivery_days").cast("string"), "customer_state")
    sinks.write_csv(part.drop(*drop).coalesce(1), f"{source}/{name or year}")


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_a_new_file_rewrites_its_year_only(spark, facts, tmpdir_path):
    source, home = f"{tmpdir_path}/in", f"{tmpdir_path}/lake"
    os.makedirs(source)
    assert lake.take_in(spark, source, home) == 0 and lake.refresh(spark, home) == []
    yearly(facts, source, 1996)
    yearly(facts, source, 1997)
    assert lake.take_in(spark, source, home) == 2
    assert lake.refresh(spark, home) == [1996, 1997]
    before = {k: files(f"{home}/{k}") for k in ("silver", "gold")}
    # Nothing new: nothing changes.
    assert lake.take_in(spark, source, home) == 0 and lake.refresh(spark, home) == []
    assert {k: files(f"{home}/{k}") for k in before} == before
    # Another year, with one column less, and more rows of an old year, all known.
    yearly(facts, source, 1998, drop=["customer_state"])
    yearly(facts.where("k % 5 = 0"), source, 1997, "late")
    assert lake.take_in(spark, source, home) == 2
    assert lake.refresh(spark, home) == [1997, 1998]
    for k, old in before.items():
        now = files(f"{home}/{k}")
        assert {f: t for f, t in now.items() if "order_year=1996" in f} == {f: t for f, t in old.items() if "order_year=1996" in f}
        assert not {f for f in now if "order_year=1997" in f} & set(old)
    silver = spark.read.option("mergeSchema", "true").parquet(f"{home}/silver")
    keys = ["customer_id", "product_name", "order_date"]
    want = facts.where(F.year("order_date").between(1996, 1998)).select(*keys).distinct()
    assert silver.count() == want.count()
    assert sorted(r[0] for r in silver.select("order_year").distinct().collect()) == [1996, 1997, 1998]
    month = gold.read_gold(spark, f"{home}/gold")
    assert rows(gold.revenue_by_year(month)) == rows(agg.revenue_by_year(silver))


def test_a_broken_off_refresh_is_done_again(spark, facts, tmpdir_path):
    source, home = f"{tmpdir_path}/in", f"{tmpdir_path}/lake"
    yearly(facts, source, 1999)
    lake.take_in(spark, source, home)

    def breaks(bronze):
        lake.clean_rows(bronze).limit(5).write.mode("overwrite").partitionBy("order_year").parquet(f"{home}/silver")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        lake.refresh(spark, home, breaks)
    assert lake.refresh(spark, home) == [1999]
    assert spark.read.parquet(f"{home}/silver").count() > 5


def test_keep_first_holds_between_loads(spark, facts, tmpdir_path):
    keys = ["customer_id", "product_name", "order_date"]
    odd = facts.withColumn("customer_id", F.when(F.col("k") % 7 > 0, F.col("customer_id") % 40)).withColumn(
        "product_name", F.substring("product_name", 1, 3)).withColumn("order_date", F.trunc("order_date", "YEAR"))
    index = lake.KeyIndex(spark, f"{tmpdir_path}/index", keys, buckets=8)
    loads = [odd.where(F.col("k") % 4 == i) for i in range(4)]
    for i, rows_ in enumerate(loads):
        index.append(rows_, i, SALES_SOURCE_ORDER)
        if i != 2:
            index.append(rows_, i, SALES_SOURCE_ORDER)  # a repeated load changes nothing
    got = index.rows().select("k", "_load", *keys)
    whole = odd.withColumn("_load", (F.col("k") % 4).cast("int"))
    want = clean.dedup_keep_first(whole, keys, ["_load", *SALES_SOURCE_ORDER]).select("k", "_load", *keys)
    assert rows(got) == rows(want) and got.where("_load = 3").count() < loads[3].count()
    # A load of few keys reads its buckets of the index only.
    assert spark.read.parquet(f"{tmpdir_path}/index/keys").select("_bucket").distinct().count() == 8
