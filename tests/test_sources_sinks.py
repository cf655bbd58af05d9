"""Sources (S1..S3, S6, S7), sinks (S4, S5) and profiling (P1..P7)."""

import os

from pyspark.sql import functions as F

from bazaar.operators import clean as C, profile as PR
from bazaar.sources import csv_io, sinks
from bazaar.sources.tables import sales_view


def write(path, text):
    with open(path, "w") as f:
        f.write(text)


def test_yearly_csv_union_and_source_order(spark, tmpdir_path):
    a = os.path.join(tmpdir_path, "y2015.csv")
    b = os.path.join(tmpdir_path, "y2016.csv")
    write(a, " customer_id ,product_name,order_date,extra\n1,p,2015-01-01,x\n1,p,2015-01-01,y\n2,NA,None,z\n")
    write(b, "customer_id,product_name,order_date\n1,p,2015-01-01\n3,q,2016-02-02\n")
    df = csv_io.read_yearly_csv(spark, [a, b])
    assert {"customer_id", "product_name", "order_date", "extra"} <= set(df.columns)
    rows = df.orderBy(*csv_io.source_order(df)).collect()
    assert [r.customer_id for r in rows] == ["1", "1", "2", "1", "3"]
    assert rows[2].product_name is None and rows[2].order_date is None  # NA / None -> NULL
    assert rows[3].extra is None  # column absent in the second file
    kept = C.dedup_keep_first(df, order=csv_io.source_order(df)).orderBy(*csv_io.source_order(df))
    assert [r.extra for r in kept.collect()] == ["x", "z", None]


def test_csv_and_parquet_round_trip(spark, tmpdir_path):
    df = spark.createDataFrame([(2020, "a", 1.5), (2021, "b", None)], "order_year int, k string, v double")
    out = os.path.join(tmpdir_path, "csv")
    sinks.write_csv(df, out)
    back = csv_io.read_csv(spark, out, with_order=False)
    assert sorted((r.k, r.v) for r in back.collect()) == [("a", "1.5"), ("b", None)]
    pq = os.path.join(tmpdir_path, "pq")
    sinks.write_parquet(df, pq)
    assert sorted(os.listdir(pq)) [:2] == ["_SUCCESS", "order_year=2020"] or "order_year=2020" in os.listdir(pq)
    assert spark.read.parquet(pq).where("order_year = 2021").count() == 1


def test_jdbc_options():
    o = sinks.jdbc_options("jdbc:mysql://h:3306/db", "orders_clean", user="u", password="p")
    assert o["batchsize"] == "1000" and o["dbtable"] == "orders_clean"
    assert o["url"].endswith("?rewriteBatchedStatements=true")
    o2 = sinks.jdbc_options("jdbc:postgresql://h/db", "t", batchsize=500)
    assert o2["url"] == "jdbc:postgresql://h/db" and "user" not in o2 and o2["batchsize"] == "500"


def test_profile(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2), (None, 3)], "c string, n int")
    assert [tuple(r) for r in PR.value_counts(df, "c").collect()] == [("a", 2), ("b", 1)]
    assert PR.nunique(df, "c").first()[0] == 2
    assert PR.distinct_frequencies(df, "c").first()[0] == 2
    info = {r.column_name: (r.data_type, r.non_null, r.total_rows) for r in PR.info(df).collect()}
    assert info == {"c": ("string", 3, 4), "n": ("int", 3, 4)}
    assert PR.shape(df).first() == (4, 2)
    assert PR.head(df, 2, ["n"]).count() == 2 and PR.columns(df) == ["c", "n"]


def test_sales_view_plan_prunes_and_broadcasts_nation(spark):
    from conftest import SF_SMALL
    plan = sales_view(spark, SF_SMALL).select("customer_state", "final_amount_inr") \
        ._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    # only the referenced columns are read from lineitem
    assert "l_returnflag" not in plan and "l_shipdate" not in plan


def test_csv_ingest_then_pipeline_matches_parquet_fixture(spark, tmpdir_path):
    """S1..S7 + C1..C21 on text files give the same clean rows as the fixture."""
    from conftest import SF_SMALL
    from bazaar.sources.fixtures import DIRTY_ORDER, dirty_sales
    dirty = dirty_sales(spark, SF_SMALL)
    as_text = dirty.select(*[F.col(c).cast("string").alias(c) for c in dirty.columns])
    # two "yearly" files, each in source order, the first holding the earlier orders
    first = as_text.where(F.col("transaction_id").cast("bigint") < 3000)
    second = as_text.where(F.col("transaction_id").cast("bigint") >= 3000)
    order = [F.col(c).cast("double") for c in DIRTY_ORDER]
    paths = []
    for i, part in enumerate([first, second]):
        p = os.path.join(tmpdir_path, f"orders_{2015 + i}")
        sinks.write_csv(part.coalesce(1).sortWithinPartitions(*order), p)
        paths.append(p)
    bronze = csv_io.read_yearly_csv(spark, paths)
    from_csv = C.clean_pipeline(bronze, csv_io.source_order(bronze))
    from_pq = C.clean_pipeline(dirty, DIRTY_ORDER)
    cols = ["k", "order_date", "original_price_inr", "customer_rating", "delivery_days",
            "customer_city", "is_prime_member", "category", "customer_age_group",
            "delivery_charges", "festival_name"]
    a = sorted(tuple(r) for r in from_csv.select(F.col("k").cast("bigint").alias("k"), *cols[1:]).collect())
    b = sorted(tuple(r) for r in from_pq.select(*cols).collect())
    assert len(a) == len(b) > 0
    assert a == b
    assert not [c for c in from_csv.columns if c.startswith("_src_")]


def test_clear_scratch_removes_staged_tables(spark):
    """Staged tables are deleted and forgotten; the next use rebuilds them."""
    from bazaar.session import clear_scratch, scratch_path
    from bazaar.sources import tables
    from conftest import SF_SMALL
    n = tables.fact_table(spark, SF_SMALL).count()
    base = os.path.dirname(scratch_path(spark, "x")).replace("file:", "", 1)
    assert n > 0 and os.path.isdir(base)
    clear_scratch(spark)
    app = spark.sparkContext.applicationId
    assert not os.path.exists(base)
    assert not [k for k in tables._FACTS if k[0] == app]
    assert tables.fact_table(spark, SF_SMALL).count() == n
