"""The fact table and the test views, built from tables that grow with the data (findings of round 3)."""

import pytest
from pyspark.sql import DataFrameWriter

from bazaar.plans.registry import QUERIES
from bazaar.sources import fixtures, tables
from conftest import SF_SMALL


@pytest.fixture
def writes(spark, monkeypatch):
    """Executed plans of the Parquet writes of a session that has staged nothing."""
    monkeypatch.setattr(tables, "_FACTS", {})
    monkeypatch.setattr(fixtures, "_STAGED", {})
    seen, parquet = [], DataFrameWriter.parquet

    def record(self, path, *args, **kw):
        seen.append(self._df._jdf.queryExecution().executedPlan().toString())
        return parquet(self, path, *args, **kw)

    monkeypatch.setattr(DataFrameWriter, "parquet", record)
    return seen


def test_facts_are_written_by_the_last_join(spark, writes):
    df = tables.fact_table(spark, SF_SMALL)
    assert len(writes) == 1 and "REBALANCE" not in writes[0] and "hashpartitioning(order_year" not in writes[0]
    assert df.count() == tables.read_table(spark, SF_SMALL, "lineitem").count()
    assert tables.fact_table(spark, SF_SMALL) is df and len(writes) == 1


@pytest.mark.parametrize("name", ["coerce_dates", "clean_booleans", "table_shape", "value_counts", "nunique"])
def test_the_dirty_view_is_not_written_and_reads_few_columns(spark, writes, name):
    plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert writes == []
    assert "l_orderkey" in plan and "l_extendedprice" not in plan and "p_name" not in plan


def test_the_priced_view_takes_no_shuffle_of_its_own(spark, writes):
    fixtures.priced_sales(spark, SF_SMALL)
    assert len(writes) == 1 and "RoundRobin" not in writes[0] and "REPARTITION" not in writes[0]


def test_the_dirty_view_reads_facts_that_are_written(spark):
    facts = tables.fact_table(spark, SF_SMALL)
    view = fixtures.dirty_sales(spark, SF_SMALL)
    assert "lineitem.parquet" not in view._jdf.queryExecution().executedPlan().toString()
    assert view.count() == facts.count()


def test_increments_carry_few_columns_and_find_buckets_without_a_window(spark, writes, monkeypatch):
    frame = type(spark.range(1))
    collected, collect = [], frame.collect

    def record(self):
        collected.append(self._jdf.queryExecution().executedPlan().toString())
        return collect(self)

    monkeypatch.setattr(frame, "collect", record)
    QUERIES["dedup_increments"](spark, SF_SMALL)
    loads = [p for p in writes if "lineitem.parquet" not in p]
    assert len(loads) == 6 and not [p for p in loads if "product_rating" in p or "brand" in p]
    assert len(collected) == 2 and not [p for p in collected if "Window" in p]


def test_free_dates_read_two_columns_in_methods_that_are_compiled(spark, writes):
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    df = QUERIES["coerce_dates_free"](spark, SF_SMALL)
    assert len(writes) == 1 and "p_name" not in writes[0] and "l_extendedprice" not in writes[0]
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
    assert df.count() == tables.read_table(spark, SF_SMALL, "lineitem").count()


def test_live_lines_are_staged_in_few_columns(spark, writes):
    QUERIES["live_month_stream"](spark, SF_SMALL)
    assert "p_name" not in writes[0] and "l_returnflag" not in writes[0]


def test_silver_is_deduplicated_without_the_file_path():
    from bazaar.sources import lake
    assert "_src_path" not in lake.ORDER and lake.ORDER == ["_load", "_src_file", "_src_block", "_src_row"]


def test_facts_are_written_with_the_codec_of_tables(spark, writes):
    df = tables.fact_table(spark, SF_SMALL)
    assert all(".zstd." in f for f in df.inputFiles())
