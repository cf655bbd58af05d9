"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the library depends on. AQE re-plans joins from runtime sizes,
# coalesces small shuffle partitions and splits skewed join partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "bazaar",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the library defaults.

    On a cluster leave ``master`` unset and size ``shuffle_partitions`` so a
    shuffle partition holds a few hundred MB (AQE coalesces small ones and
    splits skewed ones); locally use about the number of cores.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder for this session.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that is
    used as is. Only in local mode with nothing configured (tests) a private
    folder under the system temp dir is created; on a cluster a missing
    setting is an error, never a machine-local folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        conf_dir = tempfile.mkdtemp(prefix="bazaar-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def compiled_methods(spark: SparkSession) -> None:
    """Hold Spark's generated methods to the size that HotSpot compiles. Many
    steps on one row make a method above it, which then is interpreted; Spark
    runs such a step in smaller methods. A limit that is set stays."""
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


#: Codec of tables written for later steps: a third fewer bytes than Spark's
#: default, for some more CPU time.
TABLE_CODEC = "zstd"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for an intermediate table inside the shared checkpoint folder, in
    this application's own part of it."""
    return os.path.join(_scratch_base(spark), name)


def _scratch_base(spark: SparkSession) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "tables", spark.sparkContext.applicationId)


def clear_scratch(spark: SparkSession) -> None:
    """Delete the intermediate tables this session staged (silver fact table,
    fixtures, pipeline stages) and forget them.

    Uses the Hadoop file system of the checkpoint folder, so it works for
    shared stores as well as local paths. DataFrames built on the staged
    tables must not be used afterwards.
    """
    base = _scratch_base(spark)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path):
        fs.delete(path, True)
    from bazaar.sources import fixtures, tables
    app = spark.sparkContext.applicationId
    for cache in (tables._READS, tables._FACTS, fixtures._STAGED):
        for key in [k for k in cache if k[0] == app]:
            del cache[key]
