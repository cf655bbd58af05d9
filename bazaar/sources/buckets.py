"""Tables stored for their joins: bucketed and sorted by key (J1, fact joins).

Two tables in the same number of buckets of one key join without an exchange,
and so does a table with sums of its own by that key. The shuffle is paid once,
when a table is written, and not by every report.

Buckets are a catalog matter: tables get a name, and their files the folder
that the caller names (shared by all executors).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaar.sources.tables import read_table, sales_view


#: Rows of a bucket at most, about, for keys without a large share of all rows.
ROWS_PER_BUCKET = 2_000_000


def buckets_for(rows: int, least: int) -> int:
    """``least`` buckets, doubled until one holds at most ``ROWS_PER_BUCKET`` of
    ``rows``: one task writes and reads a bucket, so it must not grow with the
    table."""
    while rows > least * ROWS_PER_BUCKET:
        least *= 2
    return least


def write_bucketed(df: DataFrame, name: str, path: str, keys: list[str], buckets: int) -> DataFrame:
    """Save ``df`` as table ``name`` in ``buckets`` buckets of ``keys``, each
    sorted by them. One task writes one bucket, so there is one file a bucket:
    choose buckets (``buckets_for``) so that one holds a few hundred MB. A key with a large share
    of all rows makes one large file, which is read in splits."""
    (df.repartition(buckets, *keys).sortWithinPartitions(*keys)
     .write.mode("overwrite").format("parquet").option("path", path)
     .bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name))
    return df.sparkSession.table(name)


def bucketed_orders(spark: SparkSession, sf_dir: str, base: str, buckets: int, prefix: str) -> dict[str, DataFrame]:
    """``lineitem`` and ``orders`` by order key, both in the number of buckets
    (``buckets`` or more) that the lines need."""
    buckets = buckets_for(read_table(spark, sf_dir, "lineitem").count(), buckets)
    keys = {"lineitem": ["l_orderkey"], "orders": ["o_orderkey"]}
    return {t: write_bucketed(read_table(spark, sf_dir, t), f"{prefix}_{t}", f"{base}/{t}", k, buckets) for t, k in keys.items()}


def bucketed_facts(spark: SparkSession, sf_dir: str, base: str, buckets: int, prefix: str) -> DataFrame:
    """The fact view by product key, made from bucketed orders and lines; in
    ``buckets`` buckets, or more if its lines need them."""
    tables = bucketed_orders(spark, sf_dir, base, buckets, prefix)
    facts = sales_view(spark, sf_dir, tables).withColumn("order_year", F.year("order_date"))
    buckets = buckets_for(tables["lineitem"].count(), buckets)
    return write_bucketed(facts, f"{prefix}_facts", f"{base}/facts", ["product_id"], buckets)
