"""Dirty test views over the fact view (FIXTURES.md §3, §4).

The same SQL text runs in Spark and in DuckDB; only the date-format
function and the format strings differ per engine. ``dirty_sales`` here
also carries the money/quantity text and the source-order columns so the
whole cleaning pipeline can run on it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaar.session import TABLE_CODEC, scratch_path
from bazaar.sources.tables import sales_view, written_facts

DIRTY_SQL = """
SELECT k, transaction_id, line_no, product_id, supplier_id, line_price,
  customer_id, product_name, product_rating,
  CAST(final_amount_inr AS STRING) AS final_amount_inr,
  CAST(quantity AS STRING) AS quantity,
  CASE k % 11 WHEN 0 THEN {fmt}(order_date,'{f0}') WHEN 1 THEN {fmt}(order_date,'{f1}')
    WHEN 2 THEN {fmt}(order_date,'{f2}') WHEN 3 THEN {fmt}(order_date,'{f3}')
    WHEN 4 THEN {fmt}(order_date,'{f4}') WHEN 5 THEN {fmt}(order_date,'{f5}')
    WHEN 6 THEN {fmt}(order_date,'{f6}') WHEN 7 THEN {fmt}(order_date,'{f7}')
    WHEN 8 THEN {fmt}(order_date,'{f8}') WHEN 9 THEN 'not a date' ELSE '2020-02-30' END AS order_date,
  CASE k % 6 WHEN 0 THEN concat('₹', CAST(CAST(original_price_inr AS DECIMAL(12,2)) AS STRING))
    WHEN 1 THEN concat('1,', CAST(100000 + k % 900 AS STRING), '.50') WHEN 2 THEN 'Price on Request'
    WHEN 3 THEN CAST(CAST(original_price_inr AS DECIMAL(12,2)) AS STRING)
    WHEN 4 THEN '1.2.3' ELSE NULL END AS original_price_inr,
  CASE k % 8 WHEN 0 THEN '4.0 stars' WHEN 1 THEN '3/5' WHEN 2 THEN '2.5/5.0' WHEN 3 THEN '4 stars'
    WHEN 4 THEN '4.25' WHEN 5 THEN ' 5.0 ' WHEN 6 THEN 'nan' ELSE NULL END AS customer_rating,
  CASE k % 12 WHEN 0 THEN '-1' WHEN 1 THEN '1-2 days' WHEN 2 THEN 'Express' WHEN 3 THEN 'Same Day'
    WHEN 4 THEN '15' WHEN 5 THEN '8' WHEN 6 THEN NULL ELSE CAST(k % 8 AS STRING) END AS delivery_days,
  CASE k % 3 WHEN 0 THEN 'Same Day' WHEN 1 THEN 'Standard' ELSE 'Express' END AS delivery_type,
  CASE k % 10 WHEN 0 THEN '0' WHEN 1 THEN 'No' WHEN 2 THEN 'False ' WHEN 3 THEN 'FALSE'
    WHEN 4 THEN '1' WHEN 5 THEN 'Yes' WHEN 6 THEN 'True ' WHEN 7 THEN 'TRUE' WHEN 8 THEN 'Y'
    ELSE NULL END AS is_prime_member,
  CASE k % 7 WHEN 0 THEN 'DELHI' WHEN 1 THEN 'Kolkata ' WHEN 2 THEN 'Madras' WHEN 3 THEN 'Bombay'
    WHEN 4 THEN 'Bengaluru' WHEN 5 THEN 'Pune' ELSE NULL END AS customer_city,
  CASE k % 5 WHEN 0 THEN 'Electronic' WHEN 1 THEN 'ELECTRONICS' WHEN 2 THEN 'Electronicss'
    WHEN 3 THEN 'Electronics & Accessories' ELSE category END AS category,
  CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN '18-25' WHEN 2 THEN '26-35' WHEN 3 THEN '26-35'
    WHEN 4 THEN '36-45' ELSE '46-55' END AS customer_age_group,
  CASE WHEN k % 4 = 0 THEN NULL ELSE k % 90 END AS delivery_charges,
  CASE WHEN is_festival_sale THEN festival_name END AS festival_name
FROM {sales}
"""

PRICED_SQL = """
SELECT k, quantity, original_price_inr * quantity AS final_amount_inr,
  original_price_inr * (CASE WHEN k % 97 = 0 THEN 100 WHEN k % 89 = 0 THEN 10
    WHEN k % 83 = 0 THEN 7 WHEN k % 101 = 0 THEN 1000 ELSE 1 END) AS original_price_inr
FROM {sales}
"""

SPARK_DATE_FORMATS = ["yyyy-MM-dd", "dd-MM-yyyy", "MM-dd-yyyy", "yyyy/MM/dd", "dd/MM/yyyy",
                      "MM/dd/yyyy", "yyyy.MM.dd", "dd.MM.yyyy", "MM.dd.yyyy"]
DUCKDB_DATE_FORMATS = ["%Y-%m-%d", "%d-%m-%Y", "%m-%d-%Y", "%Y/%m/%d", "%d/%m/%Y",
                       "%m/%d/%Y", "%Y.%m.%d", "%d.%m.%Y", "%m.%d.%Y"]

# Source order of the dirty view (stands in for file order in keep-first dedup).
DIRTY_ORDER = ["transaction_id", "line_no", "product_id", "supplier_id", "line_price"]


def dirty_sql(engine: str) -> str:
    fmts = SPARK_DATE_FORMATS if engine == "spark" else DUCKDB_DATE_FORMATS
    fn = "date_format" if engine == "spark" else "strftime"
    sales = "{sales}" if engine == "spark" else "sales"
    return DIRTY_SQL.format(fmt=fn, sales=sales, **{f"f{i}": f for i, f in enumerate(fmts)})


def priced_sql(engine: str) -> str:
    return PRICED_SQL.format(sales="{sales}" if engine == "spark" else "sales")


_STAGED: dict[tuple[str, str, str], DataFrame] = {}


def _sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact rows: from the fact table if this session has written it, else
    from the joins, which then carry only the columns that are read."""
    written = written_facts(spark, sf_dir)
    return sales_view(spark, sf_dir) if written is None else written


def dirty_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dirty view, not written: a query makes the columns it reads, and its
    joins shuffle no others. (All its columns as a file are several times the
    input.) Catalyst keeps the projection that makes the text apart from rules
    that read a column many times."""
    return spark.sql(dirty_sql("spark"), sales=_sales(spark, sf_dir))


def sales_columns(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Some columns of every line, for queries that read them in several passes:
    written once per session, so the joins shuffle no other columns; facts that
    are written are read."""
    if written_facts(spark, sf_dir) is not None:
        return written_facts(spark, sf_dir).select(*columns)
    key = (spark.sparkContext.applicationId, sf_dir, ",".join(columns))
    df = _STAGED.get(key)
    if df is None or df.sparkSession is not spark:
        path = scratch_path(spark, f"fixture-columns-{uuid.uuid4().hex}")
        rows = sales_view(spark, sf_dir).withColumn("order_year", F.year("order_date")).select(*columns)
        rows.write.mode("overwrite").option("compression", TABLE_CODEC).parquet(path)
        df = spark.read.parquet(path)
        _STAGED[key] = df
    return df


def priced_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The priced view, four columns: written once per session as Parquet by the
    tasks that make it, as the quantiles read it in several passes."""
    key = (spark.sparkContext.applicationId, sf_dir, "priced")
    df = _STAGED.get(key)
    if df is None or df.sparkSession is not spark:
        path = scratch_path(spark, f"fixture-priced-{uuid.uuid4().hex}")
        spark.sql(priced_sql("spark"), sales=_sales(spark, sf_dir)).write.mode("overwrite").parquet(path)
        df = spark.read.parquet(path)
        _STAGED[key] = df
    return df
