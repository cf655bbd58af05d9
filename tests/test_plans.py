"""Plan properties of the registered queries."""

import pytest

from bazaar.plans.registry import QUERIES
from bazaar.operators import typing
from bazaar.plans.reports import report
from bazaar.sources import sinks
from bazaar.sources.tables import fact_table
from conftest import SF_SMALL

PY_NODES = ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas",
            "MapInPandas", "PythonMapInArrow")


def executed(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_in_plan(spark, name):
    plan = executed(QUERIES[name](spark, SF_SMALL))
    assert not [n for n in PY_NODES if n in plan]


def test_silver_scan_reads_only_needed_columns(spark):
    plan = executed(QUERIES["top_brands"](spark, SF_SMALL))
    scans = [ln for ln in plan.splitlines() if "ReadSchema" in ln]
    assert scans and all("struct<brand:string,final_amount_inr:decimal(18,4)>" in ln for ln in scans)


def _silver(spark, tmp):
    """The README flow: a year-partitioned table, read and typed by load_view."""
    sinks.write_parquet(fact_table(spark, SF_SMALL), tmp)
    return typing.load_view(spark.read.parquet(tmp))


@pytest.mark.parametrize("name", ["month_operations", "month_monitor", "revenue_last12"])
def test_month_filters_prune_and_push_after_load_view(spark, tmpdir_path, name):
    facts = _silver(spark, tmpdir_path + "/silver")
    plan = executed(report(name, facts))
    scans = [ln for ln in plan.splitlines() if "ReadSchema: struct<" in ln and "order_date" in ln]
    # Every scan that reads dates reads them from pruned years, the one for the
    # newest date included.
    assert scans and all("PartitionFilters: [isnotnull(order_year" in ln for ln in scans)
    assert any("GreaterThanOrEqual(order_date," in ln for ln in scans)


def test_newest_year_comes_from_partition_values(spark, tmpdir_path):
    plan = executed(report("month_operations", _silver(spark, tmpdir_path + "/silver")))
    assert "ReadSchema: struct<>" in plan


def test_launch_cohort_pre_aggregates_before_window(spark):
    plan = executed(QUERIES["launch_performance"](spark, SF_SMALL))
    window_at = plan.find("Window [min(order_date")
    agg_at = plan.find("HashAggregate(keys=[product_id", window_at)
    assert window_at >= 0 and agg_at > window_at  # aggregate sits below (after, in text) the window


def test_global_bounds_attach_by_broadcast(spark):
    plan = executed(QUERIES["kpi_bundle"](spark, SF_SMALL))
    assert "BroadcastNestedLoopJoin" in plan and "CartesianProduct" not in plan
