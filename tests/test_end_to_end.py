"""The README usage path: raw CSV -> clean -> Parquet by year -> load -> reports."""

import os

from pyspark.sql import functions as F

from bazaar.operators import clean, typing
from bazaar.plans.reports import REPORTS, report
from bazaar.sources import csv_io, sinks
from bazaar.sources.fixtures import dirty_sales


def raw_text(spark):
    from conftest import SF_SMALL
    dirty = dirty_sales(spark, SF_SMALL)
    text = dirty.select(*[F.col(c).cast("string").alias(c) for c in dirty.columns])
    # the fixture has no subcategory / state / payment columns; add text ones
    text = text.withColumns({
        "subcategory": F.concat(F.lit("S"), (F.col("k").cast("bigint") % 4).cast("string")),
        "customer_state": F.concat(F.lit("ST"), (F.col("k").cast("bigint") % 5).cast("string")),
        "brand": F.lit("B1"), "payment_method": F.lit("UPI"), "discount_percent": F.lit("10"),
        "is_festival_sale": F.when(F.col("festival_name").isNotNull(), "True").otherwise("False"),
        "return_status": F.lit("False")})
    return text


def test_readme_flow(spark, tmpdir_path):
    text = raw_text(spark)
    raw = os.path.join(tmpdir_path, "raw_2020")
    sinks.write_csv(text.coalesce(1), raw)
    bronze = csv_io.read_yearly_csv(spark, [raw])
    silver = clean.clean_pipeline(bronze, csv_io.source_order(bronze))
    lake = os.path.join(tmpdir_path, "silver")
    sinks.write_parquet(typing.derive_calendar(silver), lake)
    assert any(n.startswith("order_year=") for n in os.listdir(lake))

    facts = typing.load_view(spark.read.parquet(lake))
    assert dict(facts.dtypes)["is_prime_member"] == "boolean"
    assert dict(facts.dtypes)["order_date"] == "date"
    kpi = report("kpi_bundle", facts).first()
    assert kpi.total_revenue > 0 and kpi.orders > 0
    assert report("top_states", facts, n=3).count() == 3
    # every report runs on the loaded file (reports needing missing columns raise up front)
    ran = 0
    for name in REPORTS:
        try:
            report(name, facts).collect()
            ran += 1
        except Exception as e:  # noqa: BLE001
            assert "missing column" in str(e), (name, e)
    assert ran >= 30


def test_command_line(spark, tmpdir_path, capsys):
    from bazaar.__main__ import main
    assert main(["list"]) == 0 and "kpi_bundle" in capsys.readouterr().out
    raw = os.path.join(tmpdir_path, "raw_2021")
    sinks.write_csv(raw_text(spark).coalesce(1), raw)
    lake, out = os.path.join(tmpdir_path, "lake"), os.path.join(tmpdir_path, "top")
    assert main(["clean", "--input", raw, "--output", lake]) == 0
    assert main(["report", "top_states", "--input", lake, "--param", "n=2", "--output", out]) == 0
    rows = csv_io.read_csv(spark, out, with_order=False).collect()
    assert len(rows) == 2 and float(rows[0].revenue) >= float(rows[1].revenue)
    from bazaar.__main__ import _params
    assert _params(["approx=true", "n=3", "cost_pct=65.5", "subcategory=S1"]) == \
        {"approx": True, "n": 3, "cost_pct": 65.5, "subcategory": "S1"}
