"""Edge values, order of results, CSV dialect, file sizes and the command line."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from bazaar import __main__ as cli
from bazaar.functions import parsing as P
from bazaar.operators import agg, clean, monitor, segments
from bazaar.operators.common import MissingColumnsError, money_sum
from bazaar.plans.reports import report
from bazaar.sources import csv_io, sinks
from bazaar.sources.fixtures import DIRTY_ORDER, dirty_sales
from bazaar.sources.tables import fact_table
from conftest import SF_SMALL


def test_money_keeps_large_amounts(spark):
    df = spark.createDataFrame([(2e14,), (5.0,), (None,), (float("nan"),)], "x double")
    assert df.agg(money_sum("x").alias("s")).first().s == 200000000000005.0
    text = spark.createDataFrame([("1e30",), ("1.25",), ("x",)], "x string")
    assert text.agg(money_sum("x").alias("s")).first().s == 1e30 + 1.25


def test_profit_keeps_large_amounts(spark):
    df = spark.createDataFrame([("a", 3e14, 2.0, 2.0), ("a", 10.0, 5.0, 1.0)],
                               "subcategory string, final_amount_inr double, original_price_inr double, quantity double")
    r = agg.profit_margin(df, cost_pct=100).first()
    assert (r.revenue, r.assumed_cost, r.profit) == (3e14 + 10, 9.0, 3e14 + 10 - 9)


def test_discount_curve_has_every_level(spark):
    df = spark.range(200).select((F.col("id") / 4).alias("discount_percent"), F.lit(1.0).alias("quantity"),
                                 F.lit(2.0).alias("final_amount_inr"))
    got = [r.discount_percent for r in agg.discount_response(df).collect()]
    assert got == [i / 4 for i in range(200)]
    assert len(agg.discount_response(df, n=50).collect()) == 50


ORDERED = {
    "revenue_by_year": ["order_year"], "subcategory_year": ["subcategory", "order_year"],
    "subcategory_list": ["subcategory"], "payment_summary": ["payment_method"],
    "revenue_monthly": ["period_end"], "revenue_quarterly": ["period_end"], "revenue_yearly": ["period_end"],
    "revenue_rolling12": ["period_end"], "revenue_last12": ["period_end"], "monthly_customers": ["month_start"],
    "monthly_skus": ["month_start"], "cumulative_customers": ["month_start"], "seasonality": ["month"],
    "discount_response": ["discount_percent"], "median_delivery_by_state": ["median_delivery_days", "customer_state"],
}
FALLING = {"subcategory_share": "revenue", "festival_revenue": "revenue", "top_subcategories": "revenue",
           "top_states": "revenue", "top_brands": "revenue", "top_products": "revenue",
           "inventory_by_quantity": "quantity", "launch_performance": "revenue", "profit_margin": "revenue"}


@pytest.mark.parametrize("name", [*ORDERED, *FALLING])
def test_reports_come_in_their_stated_order(spark, name):
    rows = report(name, fact_table(spark, SF_SMALL)).collect()
    if name in ORDERED:
        keys = [tuple(r[c] for c in ORDERED[name]) for r in rows]
        assert keys == sorted(keys) and len(keys) > 1
    else:
        values = [r[FALLING[name]] for r in rows]
        assert values == sorted(values, reverse=True) and len(values) > 1


def test_date_guard_names_the_column(spark):
    df = fact_table(spark, SF_SMALL).drop("order_date", "order_year")
    for fn in (agg.kpi_bundle, agg.revenue_by_year, agg.subcategory_year):
        with pytest.raises(MissingColumnsError, match="order_date"):
            fn(df)


def test_reports_of_one_measure(spark):
    df = fact_table(spark, SF_SMALL)
    assert agg.avg_rating_delivery(df.drop("delivery_days")).columns == ["avg_customer_rating"]
    assert monitor.month_operations(df.drop("customer_rating")).columns == ["avg_delivery_days"]
    with pytest.raises(MissingColumnsError):
        agg.avg_rating_delivery(df.drop("delivery_days", "customer_rating"))


def test_unicode_space_and_digits(spark):
    df = spark.createDataFrame([(" 2020-01-05 ", "Rs १२.5", "　 7 \x1f")], "d string, p string, n string")
    r = df.select(P.parse_order_date("d").alias("d"), P.parse_price("p").alias("p"), P.coerce_numeric("n").alias("n")).first()
    assert (r.d, r.p, r.n) == (dt.date(2020, 1, 5), 12.5, 7.0)


def test_dates_with_month_names(spark):
    texts = ["5 Jan 2020", "05-January-2020", "Jan 5, 2020", "sept 1 1999", "31st Dec 2001", "30 Feb 2020", "5 Foo 2020"]
    got = [r.d for r in spark.createDataFrame([(t,) for t in texts], "t string").select(P.coerce_date("t").alias("d")).collect()]
    day = dt.date(2020, 1, 5)
    assert got == [day, day, day, dt.date(1999, 9, 1), dt.date(2001, 12, 31), None, None]


def test_prime_value_reads_text_flags(spark):
    rows = [(f, i, i, 1.0) for i, f in enumerate(["Y", "1", "True", "yes ", "N", "0", "false", None, "maybe"])]
    df = spark.createDataFrame(rows, "is_prime_member string, customer_id int, transaction_id int, final_amount_inr double")
    got = {r.is_prime: r.customers for r in segments.prime_value(df).collect()}
    assert got == {True: 4, False: 3}
    assert {r.is_prime for r in segments.prime_value(df, approx=True).collect()} == {True, False}


def test_payment_mapping_is_a_parameter(spark):
    df = spark.createDataFrame([("Zap!",), (" other ",), (None,)], "p string")
    got = [r.x for r in df.select(P.standardise_payment("p", {"Zapper": ["zap"]}).alias("x")).collect()]
    assert got == ["Zapper", "other", None]


# ---- CSV --------------------------------------------------------------------------

def test_csv_quotes_commas_and_breaks(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "a.csv")
    with open(path, "w") as f:
        f.write('id,product,amount\n1,"Dell 15.6"" Laptop, black",100\n2,"two\nlines",200\n')
    got = csv_io.read_csv(spark, path, with_order=False, multiline=True).drop("_corrupt_row").collect()
    assert [tuple(r) for r in got] == [("1", 'Dell 15.6" Laptop, black', "100"), ("2", "two\nlines", "200")]


def test_csv_round_trip_doubles_quotes(spark, tmpdir_path):
    rows = [("1", 'a "b", c'), ("2", "back\\slash"), ("3", ' pad "')]
    out = os.path.join(tmpdir_path, "out")
    sinks.write_csv(spark.createDataFrame(rows, "id string, t string").coalesce(1), out)
    text = "".join(open(os.path.join(out, f)).read() for f in os.listdir(out) if f.endswith(".csv"))
    assert '"a ""b"", c"' in text
    got = csv_io.read_csv(spark, out, with_order=False)
    assert sorted(tuple(r)[:2] for r in got.collect()) == rows


def test_csv_folder_of_mixed_headers_fails_and_a_list_works(spark, tmpdir_path):
    for name, text in (("x.csv", "a,b\nx,1\n"), ("y.csv", "b,a\n2,y\n")):
        with open(os.path.join(tmpdir_path, name), "w") as f:
            f.write(text)
    with pytest.raises(Exception, match="(?i)header"):
        csv_io.read_csv(spark, tmpdir_path).collect()
    got = csv_io.read_yearly_csv(spark, [f"{tmpdir_path}/x.csv", f"{tmpdir_path}/y.csv"])
    assert sorted((r.a, r.b) for r in got.collect()) == [("x", "1"), ("y", "2")]


def test_csv_malformed_rows_are_counted_or_fail(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "a.csv")
    with open(path, "w") as f:
        f.write("a,b\n1,2\n3\n4,5,6\n")
    df = csv_io.read_csv(spark, path)
    assert df.agg(csv_io.corrupt_rows(df)).first().corrupt_rows == 2
    assert [r.a for r in df.where("_corrupt_row is null").collect()] == ["1"]
    with pytest.raises(Exception, match="(?i)malformed"):
        csv_io.read_csv(spark, path, options={"mode": "FAILFAST"}).collect()


# ---- files, staging, command line --------------------------------------------------

def test_year_files_follow_the_data(spark, tmpdir_path):
    df = spark.range(0, 40_000, 1, 40).select("id", (2000 + F.col("id") % 11).cast("int").alias("order_year"))
    sinks.write_parquet(df, tmpdir_path + "/t")
    files = [f for _, _, fs in os.walk(tmpdir_path + "/t") for f in fs if f.endswith(".parquet")]
    assert 11 <= len(files) <= 22
    assert spark.read.parquet(tmpdir_path + "/t").count() == 40_000


def test_staged_rows_carry_no_audit_columns(spark, monkeypatch):
    staged = {}
    real = clean.materialise
    monkeypatch.setattr(clean, "materialise", lambda df, name: staged.setdefault(name, real(df, name)))
    out = clean.clean_pipeline(dirty_sales(spark, SF_SMALL).withColumn("_src_path", F.lit("x")), DIRTY_ORDER)
    extra = {"original_order_date", "before_parse_price", "original_customer_rating", "original_delivery_days",
             "is_valid_date", "_src_path"}
    assert not extra & set(staged["dedup"].columns) and not extra & set(out.columns)
    staged.clear()
    audited = clean.clean_pipeline(dirty_sales(spark, SF_SMALL), DIRTY_ORDER, audit=True)
    assert {"original_order_date", "is_valid_date"} <= set(audited.columns)
    assert "BroadcastNestedLoopJoin" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_rfm_aggregates_the_facts_once(spark):
    plan = segments.rfm(fact_table(spark, SF_SMALL))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan


def test_delivery_charges_text_does_not_raise(spark):
    df = spark.createDataFrame([("40",), ("free",), (None,)], "delivery_charges string")
    assert [r[0] for r in clean.fill_missing(df).collect()] == [40.0, 0.0, 0.0]


def test_command_line_clean_leaves_no_staged_table(spark, tmpdir_path, monkeypatch, capsys):
    src = tmpdir_path + "/in"
    rows = [(str(i), f"c{i}", f"2020-01-{1 + i % 28:02d}", f'p "{i}"', "100", "100", "1", "n") for i in range(60)]
    cols = "transaction_id, customer_id, order_date, product_name, original_price_inr, final_amount_inr, quantity, is_prime_member"
    sinks.write_csv(spark.createDataFrame(rows, ", ".join(f"{c.strip()} string" for c in cols.split(","))), src)
    cleared = []
    import bazaar.session
    monkeypatch.setattr(bazaar.session, "clear_scratch", lambda s: cleared.append(s))
    assert cli.main(["clean", "--input", src, "--output", tmpdir_path + "/out", "--csv-output", tmpdir_path + "/csv"]) == 0
    assert len(cleared) == 1
    assert "wrong number of fields: 0" in capsys.readouterr().out
    assert spark.read.parquet(tmpdir_path + "/out").count() == 60
    back = csv_io.read_csv(spark, tmpdir_path + "/csv", with_order=False)
    assert set(back.columns) == {c.strip() for c in cols.split(",")} | {"_corrupt_row"}


def test_command_line_prints_every_row(spark, tmpdir_path, capsys):
    sinks.write_parquet(fact_table(spark, SF_SMALL), tmpdir_path + "/facts")
    cli.main(["report", "top_products", "--input", tmpdir_path + "/facts", "--param", "n=90"])
    out = capsys.readouterr().out
    assert out.count("\n|") == 91 and "only showing" not in out
