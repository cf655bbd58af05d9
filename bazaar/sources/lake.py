"""Increments (S1, S8, C11): a lake folder that takes in new files only.

``take_in``   new CSV files of a folder -> bronze. A Structured Streaming query
              over the folder is the file ledger: it runs until it has seen all
              files, then stops, and gives each path once, also when a run
              breaks off. Only those files are read.
``refresh``   bronze -> silver and gold, of the years that rows have come for
              since the last refresh; other years are not read or rewritten.
``KeyIndex``  the other way to grow: loads are appended, and an index of all
              keys ever kept says which rows of a load are new (keep-first
              holds between loads), without reading the earlier rows.

All steps can be repeated: a step writes its mark last, and one that broke off
before is done again in full, over the partitions it left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaar.functions import parsing as P
from bazaar.operators import clean as C
from bazaar.operators.typing import derive_calendar
from bazaar.schema import DEDUP_KEYS
from bazaar.sources.csv_io import CORRUPT, SOURCE_ORDER, read_yearly_csv
from bazaar.session import TABLE_CODEC
from bazaar.sources.gold import in_years, write_gold

#: Order of rows over all loads: the load, then the place in its files. Each file
#: of a load has a number of its own, so its path, a long text, is not compared
#: or shuffled.
ORDER = ["_load", *[c for c in SOURCE_ORDER if c != "_src_path"]]
_FILE = "path string, modificationTime timestamp, length long, content binary"


def _exists(spark: SparkSession, pattern: str) -> bool:
    """Whether a path, or any path of a pattern, is there (on any file system)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))


def _last(spark: SparkSession, log: str, column: str):
    return spark.read.parquet(log).agg(F.max(column)).first()[0] if _exists(spark, log) else None


def _mark(spark: SparkSession, log: str, row: tuple, schema: str) -> None:
    spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(log)


def find_files(spark: SparkSession, source: str, lake: str, pattern: str = "*.csv") -> DataFrame:
    """The ledger: (path, length, found) of all files seen so far. The contents
    are not read."""
    query = (spark.readStream.format("binaryFile").schema(_FILE).option("pathGlobFilter", pattern)
             .option("recursiveFileLookup", "true").load(source)
             .select("path", "length", F.current_timestamp().alias("found"))
             .writeStream.format("parquet").outputMode("append").option("path", f"{lake}/_files")
             .option("checkpointLocation", f"{lake}/_ledger").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema("path string, length long, found timestamp").parquet(f"{lake}/_files")


def take_in(spark: SparkSession, source: str, lake: str, date_col: str = "order_date", pattern: str = "*.csv") -> int:
    """Append the files below ``source`` that are not taken in yet to
    ``lake``/bronze, as text, by the year of the parsed date and the load; the
    number of files. Files may differ in columns (each is read by its own
    header); only their paths, one a file, reach the driver."""
    files, log = find_files(spark, source, lake, pattern), f"{lake}/_loads"
    last = _last(spark, log, "up_to")
    new = (files if last is None else files.where(F.col("found") > F.lit(last))).orderBy("found", "path").collect()
    if not new:
        return 0
    load = (_last(spark, log, "load") if last is not None else -1) + 1
    rows = read_yearly_csv(spark, [r.path for r in new])
    parsed = C.stage_dates(rows.withColumn("_date", F.col(date_col)), "_date", P.DATE_FORMATS)
    parsed = parsed.withColumn("bronze_year", F.year("_date")).drop("_date").withColumn("_load", F.lit(load))
    (parsed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", TABLE_CODEC)
     .partitionBy("bronze_year", "_load").parquet(f"{lake}/bronze"))
    _mark(spark, log, (load, max(r.found for r in new)), "load int, up_to timestamp")
    return len(new)


def clean_rows(bronze: DataFrame) -> DataFrame:
    """Silver rows: C1..C10 and C11 within the years at hand: rows of one key have one date,
    so keep-first over whole years is keep-first over all."""
    rows = C.standardise(bronze.drop("_src_path"), audit=False)
    keys = [k for k in DEDUP_KEYS if k in rows.columns]
    return derive_calendar(C.dedup_keep_first(rows, keys, ORDER)).drop(*ORDER, CORRUPT, "bronze_year")


def refresh(spark: SparkSession, lake: str, prepare: Callable[[DataFrame], DataFrame] = clean_rows,
            gold: bool = True) -> list[int | None]:
    """Rewrite the years of silver (and gold) for which bronze has rows of
    loads after the last refresh; the years rewritten (None: rows without a
    date). ``prepare`` turns bronze rows of whole years into silver rows with
    ``order_year``."""
    if not _exists(spark, f"{lake}/bronze/bronze_year=*"):
        return []
    bronze = spark.read.option("mergeSchema", "true").parquet(f"{lake}/bronze")
    log, loaded = f"{lake}/_refreshed", _last(spark, f"{lake}/_loads", "load")
    done = _last(spark, log, "load")
    new = bronze.where(F.col("_load") <= loaded)
    if done is not None:
        new = new.where(F.col("_load") > done)
    # Partition values alone: no rows are read for this.
    years = sorted((r[0] for r in new.select("bronze_year").distinct().collect()), key=lambda y: (y is None, y or 0))
    if not years:
        return []
    silver = prepare(bronze.where(in_years("bronze_year", years) & (F.col("_load") <= loaded)))
    write = silver.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", TABLE_CODEC)
    write.partitionBy("order_year").parquet(f"{lake}/silver")
    if gold:
        write_gold(spark.read.parquet(f"{lake}/silver"), f"{lake}/gold", years)
    _mark(spark, log, (loaded, years), "load int, years array<int>")
    return years


class KeyIndex:
    """All keys ever kept, in ``path``/keys, and the rows kept, in ``path``/rows.

    Both are partitioned by load; keys also by ``buckets`` ranges of their
    hash, so a load reads the buckets that it has keys of. Keys are compared
    themselves, not by hash, and NULL keys match each other (C11).
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def append(self, rows: DataFrame, load: int, order: list[str]) -> None:
        """Keep the first row (by ``order``) of each key that no other load
        has kept. The same load again replaces itself; loads are taken in
        rising order, and a load is not repeated after a later one."""
        first = self._bucketed(C.dedup_keep_first(rows, self.keys, order))
        if _exists(self.spark, f"{self.path}/keys/_load=*"):
            known = self.spark.read.parquet(f"{self.path}/keys").where(F.col("_load") < load)
            # At most `buckets`; all rows have the buckets of the first ones, which a shuffle would find.
            touched = [r[0] for r in self._bucketed(rows).select("_bucket").distinct().collect()]
            if len(touched) < self.buckets:
                known = known.where(F.col("_bucket").isin(*touched))
            known = known.select(*[F.col(k).alias(f"_known_{k}") for k in self.keys], F.col("_bucket").alias("_in"))
            same = F.col("_bucket") == F.col("_in")
            for k in self.keys:
                same = same & F.col(k).eqNullSafe(F.col(f"_known_{k}"))
            first = first.join(known, same, "left_anti")
        kept = first.withColumn("_load", F.lit(load).cast("int"))

        def write(df: DataFrame, name: str, by: list[str]) -> None:
            df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{self.path}/{name}")

        write(kept.drop("_bucket"), "rows", ["_load"])
        if not _exists(self.spark, f"{self.path}/rows/_load={load}"):
            return
        # The index is made from what was written, so the two cannot differ.
        written = self.rows().where(F.col("_load") == load)
        write(self._bucketed(written.select(*self.keys, "_load")), "keys", ["_load", "_bucket"])

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")
