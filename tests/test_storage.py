"""Tables stored for joins, and figures gathered while writing."""

import uuid

from pyspark.sql import functions as F

from bazaar.operators import profile
from bazaar.operators.cohort import with_first_sale
from bazaar.sources import buckets, clusters, quality
from bazaar.sources.tables import fact_table, sales_view
from conftest import SF_SMALL


def exchanges(df):
    """Exchanges of the plan as at scale: nothing is broadcast."""
    spark = df.sparkSession
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = spark.conf.get(keys[0])
    spark.conf.set(keys[0], "-1")
    try:
        return [x.strip() for x in df.select("*")._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange " in x]
    finally:
        spark.conf.set(keys[0], before)


def test_joins_of_bucketed_tables_need_no_exchange(spark, tmpdir_path):
    name = f"t{uuid.uuid4().hex}"
    tables = buckets.bucketed_orders(spark, SF_SMALL, f"{tmpdir_path}/a", 4, name)
    li, od = tables["lineitem"].select("l_orderkey", "l_quantity"), tables["orders"].select("o_orderkey", "o_orderdate")
    assert exchanges(li.join(od, li.l_orderkey == od.o_orderkey)) == []
    facts = buckets.bucketed_facts(spark, SF_SMALL, f"{tmpdir_path}/b", 4, name + "f")
    first = with_first_sale(facts.select("k", "product_id", "order_date"))
    assert exchanges(first) == []
    # The same on files without buckets shuffles the facts twice.
    plain = fact_table(spark, SF_SMALL).select("k", "product_id", "order_date")
    assert len(exchanges(with_first_sale(plain))) == 2
    assert sorted(map(tuple, first.collect()), key=str) == sorted(map(tuple, with_first_sale(plain).collect()), key=str)
    for t in (f"{name}_lineitem", f"{name}_orders", f"{name}f_lineitem", f"{name}f_orders", f"{name}f_facts"):
        spark.sql(f"DROP TABLE {t}")


def test_the_fact_build_does_not_shuffle_bucketed_lines_by_order(spark, tmpdir_path):
    name = f"t{uuid.uuid4().hex}"
    tables = buckets.bucketed_orders(spark, SF_SMALL, f"{tmpdir_path}/a", 4, name)
    stored = [x for x in exchanges(sales_view(spark, SF_SMALL, tables)) if "l_orderkey" in x]
    plain = [x for x in exchanges(sales_view(spark, SF_SMALL)) if "l_orderkey" in x]
    assert stored == [] and len(plain) == 1
    for t in tables:
        spark.sql(f"DROP TABLE {name}_{t}")


def test_quality_equals_the_profile(spark, tmpdir_path):
    df = fact_table(spark, SF_SMALL).select("k", "order_date", "product_name", "order_year").withColumn(
        "order_date", F.when(F.col("k") % 3 > 0, F.col("order_date"))).withColumn("empty", F.lit(None).cast("int"))
    got = quality.write_with_quality(df, f"{tmpdir_path}/s", f"{tmpdir_path}/q", {"odd": F.col("k") % 2 == 1, "never": F.lit(None).cast("boolean")})
    rows = {(r.measure, r.column_name): (r.value, r.total_rows) for r in got.collect()}
    written = spark.read.parquet(f"{tmpdir_path}/s")
    want = {("non_null", r.column_name): (r.non_null, r.total_rows) for r in profile.info(written).collect()}
    want[("odd", None)] = (df.where("k % 2 = 1").count(), df.count())
    want[("never", None)] = (0, df.count())
    assert rows == want


def test_quality_takes_no_job_of_its_own(spark, tmpdir_path):
    df = spark.range(100).withColumn("x", F.lit("a"))
    sc, group = spark.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(group, "quality")
    df.write.parquet(f"{tmpdir_path}/plain")
    alone = len(sc.statusTracker().getJobIdsForGroup(group))
    sc.setJobGroup(group + "q", "quality")
    quality.write_with_quality(df, f"{tmpdir_path}/s", f"{tmpdir_path}/q")
    # One job writes the rows, one the quality table.
    assert len(sc.statusTracker().getJobIdsForGroup(group + "q")) == alone + 1
    assert quality.write_with_quality(df.limit(0), f"{tmpdir_path}/e", f"{tmpdir_path}/f").first().total_rows == 0


def rows_scanned(df):
    """(result rows, rows that the file scan gave after skipping row groups and pages)."""
    n = len(df.collect())
    todo, read = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif node.nodeName().startswith("Scan"):
            read += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
    return n, read


def test_filters_on_any_cluster_column_skip_most_rows(spark, tmpdir_path):
    df = spark.range(200_000).select(
        F.concat(F.lit("sub "), F.pmod(F.xxhash64("id"), F.lit(60)).cast("string")).alias("subcategory"),
        F.date_add(F.lit("2015-01-01").cast("date"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3650)).cast("int")).alias("order_date"),
        F.rand(3).alias("final_amount_inr"), F.lit("mine").alias("_cluster"))
    clusters.write_clustered(df, f"{tmpdir_path}/z", ["subcategory", "order_date"], files=64, row_group_bytes=1 << 14)
    df.repartition(64).write.parquet(f"{tmpdir_path}/plain")
    z, plain = spark.read.parquet(f"{tmpdir_path}/z"), spark.read.parquet(f"{tmpdir_path}/plain")
    assert z.columns == df.columns and z.count() == 200_000
    for cond in (F.col("subcategory") == "sub 7", F.col("order_date") >= F.lit("2024-10-01").cast("date")):
        n, read = rows_scanned(z.where(cond))
        m, all_read = rows_scanned(plain.where(cond))
        assert n == m > 1000
        assert read < 0.3 * all_read, (read, all_read)
    # A name that is not there, between the others: the Bloom filters know.
    assert rows_scanned(z.where("subcategory = 'sub 7x'")) == (0, 0)


def test_clustered_nulls_and_empty(spark, tmpdir_path):
    df = spark.createDataFrame([("a", 1.0), (None, None), ("b", None)], "s string, x double")
    clusters.write_clustered(df, f"{tmpdir_path}/n", ["s", "x"], 2)
    assert sorted(map(tuple, spark.read.parquet(f"{tmpdir_path}/n").collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    clusters.write_clustered(df.limit(0), f"{tmpdir_path}/e", ["s", "x"], 2)
    assert spark.read.schema(df.schema).parquet(f"{tmpdir_path}/e").count() == 0
