import os
import time

from pyspark.sql import functions as F

from bazaar.llm.scratch import CLEANUP, stage


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().endswith(".data")}


def test_a_staged_write_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    df = spark.range(20_000).groupBy((F.col("id") % 997).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    out = stage(df, "test-cleanup")
    for _ in range(50):  # Spark deletes them in the background
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left
    assert spark.conf.get(CLEANUP) == "false"
    assert out.agg(F.sum("n"), F.count("k")).first() == (20_000, 997)
    assert all(f.endswith(".zstd.parquet") for p in out.inputFiles() for f in [os.path.basename(p)])


def test_the_setting_of_the_session_stays(spark):
    spark.conf.set(CLEANUP, "true")
    try:
        stage(spark.range(3).toDF("x"), "test-setting")
        assert spark.conf.get(CLEANUP) == "true"
    finally:
        spark.conf.unset(CLEANUP)
