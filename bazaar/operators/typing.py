"""Load-time typing of a cleaned file for reporting (L1..L4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaar.functions import parsing as P
from bazaar.functions.dates import free_prefix, inferred_order, parse_free_dates
from bazaar.operators.clean import stage_dates
from bazaar.schema import BOOLEAN_COLUMNS, NUMERIC_COLUMNS
from bazaar.session import compiled_methods


def _is_string(df: DataFrame, c: str) -> bool:
    return df.schema[c].dataType.simpleString() == "string"


def derive_calendar(df: DataFrame, date_col: str = "order_date", keep: bool = False) -> DataFrame:
    """L2: order_year, order_month and order_quarter ('2021Q2'); NULL without a
    date. ``keep`` leaves those alone that the table already has."""
    d = F.col(date_col)
    derived = {
        "order_year": F.year(d),
        "order_month": F.month(d),
        "order_quarter": F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string")),
    }
    return df.withColumns({k: v for k, v in derived.items() if not (keep and k in df.columns)})


def load_dates(df: DataFrame, col: str, order: str = "month_first") -> DataFrame:
    """L1 as a DataFrame step: text ``col`` becomes its date.

    Dates of three numbers with a four-digit year, with or without a time of
    day, are cut apart as in C1 (ISO first, then month before day, then the
    other order). All other text goes through the free-form grammar of
    ``functions.dates``: names of months and weekdays, ISO 'T' and zones,
    compact digits, two-digit years, missing days. ``order='day_first'`` reads
    ambiguous numbers the other way; ``order='infer'`` asks the whole column
    first (one aggregation, a job before the result).
    """
    compiled_methods(df.sparkSession)
    if order == "infer":
        order = inferred_order(df, col)
    prefix = free_prefix(df)
    text, free, plain = f"{prefix}load", f"{prefix}free", f"{prefix}plain"
    formats = P.LOAD_DATE_FORMATS if order == "month_first" else P.DAY_FIRST_LOAD_FORMATS
    staged = df.withColumn(text, P.py_strip(col))
    staged = staged.withColumn(plain, F.col(text).rlike(P.PLAIN_DATE_RE))
    # Each text takes one way; the other sees NULL and does nothing.
    staged = staged.withColumn(col, F.when(F.col(plain), F.regexp_replace(text, r"\s.*$", "")))
    staged = stage_dates(staged, col, formats)
    staged = staged.withColumn(free, F.when(~F.col(plain), F.col(text)))
    staged = parse_free_dates(staged, free, free, order)
    return staged.withColumn(col, F.coalesce(col, free)).drop(text, free, plain)


def load_view(df: DataFrame, date_col: str = "order_date") -> DataFrame:
    """L1..L4 together: what the report layer expects from a loaded file.

    Dates (L1) and numbers (L3) are parsed only when still text; booleans
    (L4) accept text or real booleans.
    """
    if date_col in df.columns:
        if _is_string(df, date_col):
            df = load_dates(df, date_col)
        else:
            df = df.withColumn(date_col, F.to_date(date_col))
        # Columns that are there stay: order_year may be the partition column,
        # and a derived one in its place could prune no folder.
        df = derive_calendar(df, date_col, keep=True)
    nums = {c: (P.coerce_numeric(c) if _is_string(df, c) else F.col(c).cast("double"))
            for c in NUMERIC_COLUMNS if c in df.columns}
    bools = {c: P.coerce_boolean(c) for c in BOOLEAN_COLUMNS if c in df.columns}
    return df.withColumns({**nums, **bools})
