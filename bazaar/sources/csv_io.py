"""Reading the yearly order files (S1, S2, S3, S6, S7) with a source-order key.

Every column is read as text (no schema inference: inference costs a full
extra pass and would let one odd value change a column's type); typing is
the job of the cleaning step.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaar.functions.parsing import null_tokens

# Source-order key columns: file position in the list, file path (a folder
# or glob can hold several files), byte offset of the split inside the
# file, row position inside the split.
SOURCE_ORDER = ["_src_file", "_src_path", "_src_block", "_src_row"]


def strip_column_names(df: DataFrame) -> DataFrame:
    """Trim whitespace around header names."""
    return df.toDF(*[c.strip() for c in df.columns])


def nullify_missing_tokens(df: DataFrame, tokens: list[str] | None = None) -> DataFrame:
    """The pandas reader's missing markers ('NA', 'null', 'None', ...) -> NULL."""
    return df.withColumns({f.name: null_tokens(f.name, tokens) for f in df.schema.fields
                           if f.dataType.simpleString() == "string" and f.name not in (*SOURCE_ORDER, CORRUPT)})


# Rows whose number of fields is not the header's land here as raw text.
CORRUPT = "_corrupt_row"
# Quotes inside quoted text are doubled, as pandas and spreadsheets write them.
DIALECT = {"quote": '"', "escape": '"'}


def read_csv(spark: SparkSession, path: str, file_index: int = 0,
             with_order: bool = True, options: dict | None = None, multiline: bool = False) -> DataFrame:
    """S3: one header CSV (file, folder or glob), all columns text.

    The files of a folder must have one header: one whose columns differ or
    stand in another order fails the read (list such files for
    ``read_yearly_csv``, which stacks them by name). A row of too few or too
    many fields keeps what could be read and its raw text in ``_corrupt_row``,
    which ``corrupt_rows`` counts; ``options={"mode": "FAILFAST"}`` fails instead.

    ``multiline`` allows line breaks inside quoted text. It reads each file
    whole in one task, so leave it off for large files without such text.

    The source-order key is taken at the scan: split start offset from the
    file metadata and ``monotonically_increasing_id`` (increasing within a
    split). Together they give the file order, whatever the split packing.
    """
    opts = {"header": "true", "inferSchema": "false", "mode": "PERMISSIVE", **DIALECT,
            "multiLine": str(multiline).lower(), **(options or {})}
    header = spark.read.options(**opts).csv(path).columns
    fail = opts["mode"].upper() == "FAILFAST"
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header]
                          + ([] if fail else [T.StructField(CORRUPT, T.StringType())]))
    df = spark.read.options(**opts, enforceSchema="false", columnNameOfCorruptRecord=CORRUPT,
                            columnPruning="false").schema(schema).csv(path)
    df = strip_column_names(df)
    if with_order:
        df = df.select("*",
                       F.lit(file_index).alias("_src_file"),
                       F.col("_metadata.file_path").alias("_src_path"),
                       F.col("_metadata.file_block_start").alias("_src_block"),
                       F.monotonically_increasing_id().alias("_src_row"))
    return nullify_missing_tokens(df)


def corrupt_rows(df: DataFrame) -> Column:
    """Aggregate: the rows of a CSV read that had the wrong number of fields.
    (Spark refuses a query on that column alone, so it looks at another too.)"""
    bad = F.lit(False)
    if CORRUPT in df.columns:
        other = next((F.col(c) for c in df.columns if c != CORRUPT), F.lit(None))
        bad = F.col(CORRUPT).isNotNull() & (other.isNull() | other.isNotNull())
    return F.count_if(bad).alias("corrupt_rows")


def union_years(dfs: Sequence[DataFrame]) -> DataFrame:
    """Stack frames by column name; a column missing in one frame is NULL there."""
    if not dfs:
        raise ValueError("nothing to union")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def read_yearly_csv(spark: SparkSession, paths: Sequence[str],
                    options: dict | None = None, multiline: bool = False) -> DataFrame:
    """S1 + S2: read each yearly file by its own header, stack in list order.

    Each path is read separately because the files' headers may differ: a
    single multi-path read would bind columns by position.
    """
    frames = [read_csv(spark, p, i, True, options, multiline) for i, p in enumerate(paths)]
    return union_years(frames)


def source_order(df: DataFrame) -> list[str]:
    """The order columns ``read_csv`` attached (file index, path, split, row)."""
    return [c for c in SOURCE_ORDER if c in df.columns]


def drop_source_order(df: DataFrame) -> DataFrame:
    return df.drop(*SOURCE_ORDER)
