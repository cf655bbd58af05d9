"""The current-month monitor as a Structured Streaming job.

Order lines arrive as files. Two jobs read them:

* ``daily_kpis``: revenue, lines and approximate customers of each event-time
  day. A day is final, and its state dropped, once event time has moved
  ``lateness`` past its end.
* ``live_lines``: the current month, exactly. Lines that arrive again (a file
  sent twice, a retried sender) are dropped by their key within the watermark,
  which is also what bounds the state; the others are appended to a table by
  month. The sink's log makes each micro-batch count once, also after a failure.
  Targets, run-rate and alerts (M1..M4) then are the batch reports over the
  newest month's folder, so they equal the batch rows, distinct counts included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaar.operators import monitor
from bazaar.operators.common import money
from bazaar.session import TABLE_CODEC

ORDER_LINE_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.LongType()),
    T.StructField("customer_id", T.LongType()),
    T.StructField("order_date", T.DateType()),
    T.StructField("final_amount_inr", T.DecimalType(18, 4)),
])


def read_order_stream(spark: SparkSession, path: str,
                      schema: T.StructType = ORDER_LINE_SCHEMA,
                      max_files_per_trigger: int | None = None) -> DataFrame:
    """File source of order-line Parquet files (schema given, no inference)."""
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.parquet(path)


def daily_kpis(stream: DataFrame, lateness: str = "2 days",
               date_col: str = "order_date") -> DataFrame:
    """Per event-time day: revenue, order lines, approximate distinct customers."""
    ts = F.col(date_col).cast("timestamp")
    return (stream.withColumn("_ts", ts)
            .withWatermark("_ts", lateness)
            .groupBy(F.window("_ts", "1 day").alias("day"))
            .agg(F.sum(money("final_amount_inr")).cast("double").alias("revenue"),
                 F.count(F.lit(1)).alias("lines"),
                 F.approx_count_distinct("customer_id").alias("customers_approx"))
            .select(F.col("day.start").cast("date").alias("day"), "revenue", "lines",
                    "customers_approx"))


def start_daily_kpis(stream: DataFrame, sink_path: str, checkpoint: str,
                     lateness: str = "2 days", trigger_seconds: int | None = None):
    """Write finished days as Parquet (append mode: each day once, after the watermark)."""
    q = (daily_kpis(stream, lateness).writeStream.outputMode("append")
         .format("parquet").option("path", sink_path).option("checkpointLocation", checkpoint))
    if trigger_seconds:
        q = q.trigger(processingTime=f"{trigger_seconds} seconds")
    return q.start()


LIVE_LINE_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.LongType()),
    T.StructField("line_no", T.LongType()),
    T.StructField("customer_id", T.LongType()),
    T.StructField("order_date", T.DateType()),
    T.StructField("final_amount_inr", T.DecimalType(18, 4)),
])
#: A line is known again, and taken if it comes late, for so long after the
#: newest date: the whole current month and some days of the one before.
LIVE_LATENESS = "40 days"


def live_lines(stream: DataFrame, lateness: str = LIVE_LATENESS, key: tuple[str, ...] = ("transaction_id", "line_no"),
               date_col: str = "order_date") -> DataFrame:
    """Each line once, with its month as a number (202108). Lines without a
    date, and those older than the watermark, are left out."""
    return (stream.where(F.col(date_col).isNotNull()).withColumn("_ts", F.col(date_col).cast("timestamp"))
            .withWatermark("_ts", lateness).dropDuplicatesWithinWatermark([*key])
            .withColumn("month_no", F.year(date_col) * 100 + F.month(date_col)).drop("_ts"))


def start_live_lines(stream: DataFrame, path: str, checkpoint: str, lateness: str = LIVE_LATENESS,
                     trigger_seconds: int | None = None, until_done: bool = False):
    """Append the lines to the table at ``path``, partitioned by month.
    ``until_done`` stops when all files that are there have been read."""
    q = (live_lines(stream, lateness).writeStream.outputMode("append").format("parquet").partitionBy("month_no")
         .option("path", path).option("compression", TABLE_CODEC).option("checkpointLocation", checkpoint))
    if until_done:
        q = q.trigger(availableNow=True)
    elif trigger_seconds:
        q = q.trigger(processingTime=f"{trigger_seconds} seconds")
    return q.start()


def live_month(spark: SparkSession, path: str) -> DataFrame:
    """The newest month's lines; other months' folders are not read."""
    lines = spark.read.parquet(path)
    return lines.where(F.col("month_no") == lines.agg(F.max("month_no")).scalar())


def live_monitor(spark: SparkSession, path: str, rev_target: int | None = None, cust_target: int = 1000) -> DataFrame:
    """M1..M3 of the live month."""
    return monitor.month_monitor(live_month(spark, path), rev_target, cust_target)


def live_alerts(spark: SparkSession, path: str, rev_target: int | None = None, cust_target: int = 1000) -> DataFrame:
    """M4 of the live month."""
    return monitor.alerts_of(live_monitor(spark, path, rev_target, cust_target))
