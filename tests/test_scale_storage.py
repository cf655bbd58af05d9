"""Clustered and bucketed tables whose tasks do not grow with the table."""

import glob
import uuid

from pyspark.sql import functions as F

from bazaar.sources import buckets, clusters, tables
from conftest import SF_SMALL


def test_clustered_files_grow_with_the_rows(spark, tmpdir_path, monkeypatch):
    monkeypatch.setattr(clusters, "ROWS_PER_FILE", 1000)
    df = spark.range(10_000).select("id", (F.col("id") % 300).alias("x"))
    clusters.write_clustered(df, f"{tmpdir_path}/c", ["x"], files=2)
    files = glob.glob(f"{tmpdir_path}/c/*.parquet")
    assert len(files) >= 10
    assert max(spark.read.parquet(f).count() for f in files) < 2000
    assert spark.read.parquet(f"{tmpdir_path}/c").count() == 10_000


def test_buckets_grow_with_the_rows(spark, tmpdir_path, monkeypatch):
    lines = tables.read_table(spark, SF_SMALL, "lineitem").count()
    monkeypatch.setattr(buckets, "ROWS_PER_BUCKET", lines // 7)
    name = f"t{uuid.uuid4().hex}"
    facts = buckets.bucketed_facts(spark, SF_SMALL, f"{tmpdir_path}/b", 2, name)
    assert facts.count() == lines
    for t in ("lineitem", "orders", "facts"):
        rows = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {name}_{t}").collect()}
        assert rows["Num Buckets"] == "8"
        spark.sql(f"DROP TABLE {name}_{t}")
    assert buckets.buckets_for(0, 8) == 8 and buckets.buckets_for(lines // 7 * 8, 8) == 8
