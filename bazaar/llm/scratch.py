"""Tables staged in the shared checkpoint folder, to cut lineage; batch sizes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from bazaar.session import TABLE_CODEC, scratch_path

#: Spark deletes a job's shuffle files when the job ends; else they stay until
#: the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the folder of ``spark.checkpoint.dir`` and
    read it back. Every executor sees the copy, so losing one loses nothing,
    and the read-back table has its real size for the optimizer. The shuffle
    files of the write go when it is done: nothing reads them again."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}-{uuid.uuid4().hex}")
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", TABLE_CODEC).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of one Arrow batch: texts are long, and a batch is held whole on both sides.
BATCH_ROWS = 500


def small_batches(df: DataFrame) -> None:
    """Bound the Arrow batches of texts on their way to Python workers, unless
    the session has set fewer rows already."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    while name in df.columns:
        name = f"_{name}"
    return name
