"""Sinks (S4, S5) and reuse of a loaded table."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header CSV, no index column; one file per task (no single-file funnel).

    Quotes inside text are doubled, as ``csv_io`` and other tools read them.
    Text is written as is: Spark's CSV writer trims spaces by default, which
    would turn 'Kolkata ' into 'Kolkata' before the cleaning rules see it.
    """
    (df.write.mode(mode).option("header", "true").option("quote", '"').option("escape", '"')
       .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
       .csv(path))


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None,
                  mode: str = "overwrite", max_records_per_file: int | None = None) -> None:
    """S4, native form: Parquet, by default partitioned by ``order_year`` when present.

    Year partitions let month and last-12-month filters skip whole folders.
    A rebalance on those columns lets Spark bring the rows of a year together
    and then size the writing tasks by bytes: large years are split over many
    tasks, small ones share one, and the number of files follows the data and
    not tasks x years.
    """
    if partition_by is None:
        partition_by = ["order_year"] if "order_year" in df.columns else []
    out = df
    if partition_by:
        out = df.hint("rebalance", *[F.col(c) for c in partition_by]).sortWithinPartitions(*partition_by)
    w = out.write.mode(mode)
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", str(int(max_records_per_file)))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def jdbc_options(url: str, table: str, user: str | None = None, password: str | None = None,
                 batchsize: int = 1000, driver: str | None = None,
                 extra: dict | None = None) -> dict:
    """Options of the JDBC writer. Credentials are passed in, never stored here.

    For MySQL, ``rewriteBatchedStatements=true`` on the URL turns each batch
    into multi-row inserts (what the reference does with method='multi').
    """
    opts = {"url": url, "dbtable": table, "batchsize": str(int(batchsize))}
    if user is not None:
        opts["user"] = user
    if password is not None:
        opts["password"] = password
    if driver is not None:
        opts["driver"] = driver
    if url.startswith("jdbc:mysql:") and "rewriteBatchedStatements" not in url:
        opts["url"] = url + ("&" if "?" in url else "?") + "rewriteBatchedStatements=true"
    opts.update(extra or {})
    return opts


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append",
               max_connections: int | None = None, **kw) -> None:
    """Append (or replace: mode='overwrite' with truncate) into a database table.

    Each task opens one connection; ``max_connections`` narrows the number of
    writing tasks with ``coalesce`` (no shuffle).
    """
    opts = jdbc_options(url, table, **kw)
    if mode == "overwrite":
        opts.setdefault("truncate", "true")
    out = df.coalesce(max_connections) if max_connections else df
    out.write.format("jdbc").options(**opts).mode(mode).save()


def persist_table(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> DataFrame:
    """Keep a loaded table for several reports; lost blocks are recomputed."""
    return df.persist(level)
