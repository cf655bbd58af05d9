"""DataFrame-level cleaning steps (C1..C21) and the whole cleaning pipeline.

Plan of ``clean_pipeline`` (three barriers, no driver-side row work):

    bronze scan -> narrow projection C1..C10 -> shuffle: keep-first dedup C11
      -> written to the shared checkpoint folder as Parquet (lineage cut)
      -> exact quantiles of the price (C14) -> conditional repair C16
      -> exact quantiles again -> range filter C17
      -> mode of the age group (C20) -> fills C19..C21 -> drop helpers C18
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bazaar.functions import parsing as P
from bazaar.operators.quantiles import quantile_frame, quantiles
from bazaar.schema import (
    AUDIT_COPIES, BOOLEAN_COLUMNS, DEDUP_KEYS, DELIVERY_CHARGES_FILL, FESTIVAL_FILL, NUMERIC_COLUMNS,
)
from bazaar.session import TABLE_CODEC, scratch_path


def _has(df: DataFrame, c: str) -> bool:
    return c in df.columns


def _is_string(df: DataFrame, c: str) -> bool:
    return df.schema[c].dataType.simpleString() == "string"


def _number(df: DataFrame, c: str) -> F.Column:
    return P.coerce_numeric(c) if _is_string(df, c) else F.col(c).cast("double")


# ---- narrow steps -------------------------------------------------------------

def add_audit_copies(df: DataFrame) -> DataFrame:
    """Keep the raw text of the four columns the cleaning rewrites."""
    return df.select("*", *[F.col(src).alias(dst) for src, dst in AUDIT_COPIES.items()
                            if _has(df, src)])


def clean_dates(df: DataFrame, col: str = "order_date") -> DataFrame:
    """C1 + C2.

    The trimmed text and the parsed date are staged as helper columns: each
    is used many times by the next step, and Catalyst keeps a projection of
    a non-trivial expression separate when it is used more than once, so the
    (possibly costly) input expression is evaluated once per row, not once
    per format tried.
    """
    return stage_dates(df, col, P.DATE_FORMATS).withColumn(
        "is_valid_date", F.col(col).isNotNull())


def stage_dates(df: DataFrame, col: str, formats: list[str]) -> DataFrame:
    """Replace text ``col`` by its date, trying ``formats`` in order."""
    staged = df.withColumn("_s", P.py_strip(col))
    staged = staged.withColumns({f"_{k}": v for k, v in P.date_text(F.col("_s")).items()})
    fields = P.date_fields(F.col("_s"), F.col("_t"), F.col("_ok"))
    staged = staged.withColumns({f"_{k}": v for k, v in fields.items()})
    d = P.date_from_fields({k: F.col(f"_{k}") for k in fields}, formats)
    staged = staged.withColumn("_d", d)
    return (staged.withColumn(col, P.in_date_range(F.col("_d")))
                  .drop("_s", "_t", "_ok", "_d", *[f"_{k}" for k in fields]))


def clean_prices(df: DataFrame, col: str = "original_price_inr") -> DataFrame:
    """C4 (numeric input keeps its magnitude: the text rule drops the sign)."""
    if _is_string(df, col):
        return df.withColumn(col, P.parse_price(col))
    return df.withColumn(col, F.abs(F.col(col).cast("double")))


def clean_ratings(df: DataFrame, col: str = "customer_rating",
                  fallback: str = "product_rating") -> DataFrame:
    """C5 + C6: parse the rating; fill gaps from the product rating."""
    r = P.parse_rating(col)
    if _has(df, fallback):
        r = F.coalesce(r, _number(df, fallback))
    return df.withColumn(col, r)


def clean_cities(df: DataFrame, col: str = "customer_city") -> DataFrame:
    """C7."""
    return df.withColumn(col, P.standardise_city(col))


def clean_booleans(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """C8 on the boolean-like text columns that exist."""
    cols = [c for c in (cols or BOOLEAN_COLUMNS) if _has(df, c)]
    return df.withColumns({c: P.standardise_bool_text(c) for c in cols})


def clean_categories(df: DataFrame, col: str = "category") -> DataFrame:
    """C9."""
    return df.withColumn(col, P.standardise_category(col))


def clean_delivery(df: DataFrame, mode: str = "observed") -> DataFrame:
    """C10."""
    t = "delivery_type" if _has(df, "delivery_type") else None
    pr = "is_prime_member" if _has(df, "is_prime_member") else None
    if mode == "intended" and (t is None or pr is None):
        raise ValueError("intended mode needs delivery_type and is_prime_member")
    return df.withColumn("delivery_days",
                         P.normalise_delivery_days("delivery_days", t, pr, mode=mode))


def type_numbers(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """L3 on numeric text columns (price and delivery days have their own rules)."""
    skip = {"original_price_inr", "delivery_days"}
    cols = [c for c in (cols or NUMERIC_COLUMNS) if _has(df, c) and c not in skip]
    return df.withColumns({c: _number(df, c) for c in cols})


def standardise(df: DataFrame, delivery_mode: str = "observed", audit: bool = True) -> DataFrame:
    """C1..C10 in the reference's order, all narrow (no shuffle). Without
    ``audit`` the copies of C3 and the validity flag of C2 are left out."""
    if audit:
        df = add_audit_copies(df)
    if _has(df, "order_date"):
        df = clean_dates(df) if audit else stage_dates(df, "order_date", P.DATE_FORMATS)
    if _has(df, "original_price_inr"):
        df = clean_prices(df)
    if _has(df, "customer_rating"):
        df = clean_ratings(df)
    if _has(df, "customer_city"):
        df = clean_cities(df)
    df = clean_booleans(df)
    if _has(df, "category"):
        df = clean_categories(df)
    if _has(df, "delivery_days"):
        df = clean_delivery(df, delivery_mode)
    return type_numbers(df)


# ---- keep-first dedup ------------------------------------------------------------

def dedup_keep_first(df: DataFrame, keys: list[str] | None = None,
                     order: list[str] | None = None) -> DataFrame:
    """C11: one row per key tuple, the first in source order; NULL keys match.

    ``row_number() == 1`` is planned with a partial WindowGroupLimit before the
    shuffle, so each input partition sends at most one row per key: a key
    holding a third of the data does not arrive whole in one task.
    """
    keys = keys or DEDUP_KEYS
    if not order:
        raise ValueError("keep-first needs a source order (column list)")
    w = Window.partitionBy(*keys).orderBy(*[F.asc_nulls_first(c) for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


# ---- price outliers ------------------------------------------------------------------

def iqr_bounds(df: DataFrame, col: str = "original_price_inr", k: float = 1.5) -> DataFrame:
    """C14: one row (q1, q3, iqr, lower, upper) from exact quartiles."""
    q = quantile_frame(df, col, [0.25, 0.75], ["q1", "q3"])
    iqr = F.col("q3") - F.col("q1")
    return q.select("q1", "q3", iqr.alias("iqr"),
                    (F.col("q1") - F.lit(k) * iqr).alias("lower"),
                    (F.col("q3") + F.lit(k) * iqr).alias("upper"))


def iqr_bound_values(df: DataFrame, col: str = "original_price_inr",
                     k: float = 1.5) -> tuple[float | None, float | None]:
    """C14 as two numbers (lower, upper): the only values that reach the driver."""
    q1, q3 = quantiles(df, col, [0.25, 0.75])
    if q1 is None or q3 is None:
        return None, None
    iqr = q3 - q1
    return q1 - k * iqr, q3 + k * iqr


def _ratio2(price: F.Column, expected: F.Column) -> F.Column:
    # numpy's round(x, 2): rint(x * 100) / 100 (Spark round/bround differ at .xx5)
    return F.rint(F.try_divide(price, expected) * 100) / 100


def correct_decimal(price: str = "original_price_inr",
                    expected: str = "expected_price") -> F.Column:
    """C16 for one row: divide by 10/100/1000 when price/expected is exactly that."""
    p, e = F.col(price), F.col(expected)
    r = _ratio2(p, e)
    fixed = (F.when(r == 10, p / 10).when(r == 100, p / 100).when(r == 1000, p / 1000)
              .otherwise(p))
    return F.when(e.isNull() | (e == 0) | F.isnan(e), p).otherwise(fixed)


def repair_price_outliers(df: DataFrame, price: str = "original_price_inr",
                          k: float = 1.5) -> DataFrame:
    """C13..C17: fix decimal-shift outliers, then drop what is still outside.

    The two bound pairs are computed eagerly (exact, distributed) and enter
    the plan as literals, so the final range test is a plain predicate that
    reaches the Parquet scan of a staged table. Rows with no price are
    dropped by that test, as in the reference.
    """
    df = df.withColumn("expected_price",
                       F.try_divide(F.col("final_amount_inr").cast("double"),
                                    F.col("quantity").cast("double")))
    lo1, hi1 = iqr_bound_values(df, price, k)
    if lo1 is None:
        return df.where(F.lit(False))
    outlier = (F.col(price) < F.lit(lo1)) | (F.col(price) > F.lit(hi1))
    fixed = df.withColumn(price, F.when(outlier, correct_decimal(price)).otherwise(F.col(price)))
    lo2, hi2 = iqr_bound_values(fixed, price, k)
    return fixed.where(F.col(price).between(F.lit(lo2), F.lit(hi2)))


# ---- fills ------------------------------------------------------------------------------

def mode_frame(df: DataFrame, col: str) -> DataFrame:
    """Most frequent non-NULL value (ties: smallest) as a one-row frame.

    Counted per value with map-side combine, then a top-1 ordered take; no
    task holds more than one partition's value counts.
    """
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    top = counts.orderBy(F.desc("_n"), F.asc(col)).limit(1)
    return top.agg(F.max(col).alias("mode"))


def fill_missing(df: DataFrame) -> DataFrame:
    """C19..C21: delivery charges 0.0, age group by its mode, festival 'Normal Day'."""
    if _has(df, "delivery_charges"):
        df = df.withColumn("delivery_charges",
                           F.coalesce(_number(df, "delivery_charges"), F.lit(DELIVERY_CHARGES_FILL)))
    if _has(df, "customer_age_group"):
        mode = mode_frame(df, "customer_age_group").scalar()
        df = df.withColumn("customer_age_group", F.coalesce(F.col("customer_age_group"), mode))
    if _has(df, "festival_name"):
        df = df.withColumn("festival_name", F.coalesce("festival_name", F.lit(FESTIVAL_FILL)))
    return df


#: The source-order key of a CSV read and its column of malformed rows.
READ_COLUMNS = ("_src_file", "_src_path", "_src_block", "_src_row", "_corrupt_row")


def drop_helpers(df: DataFrame) -> DataFrame:
    """C18 (expected price, audit copies, validity flag) and C12 (the source-order
    key of a CSV read: the output has no row numbers, like a reset index)."""
    return df.drop("expected_price", "is_valid_date", *AUDIT_COPIES.values(), *READ_COLUMNS)


# ---- pipeline --------------------------------------------------------------------------------

def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage at a shuffle boundary (a lost executor re-reads files
    instead of recomputing the dedup) and lets the later passes read only the
    columns they need. ``bazaar.session.clear_scratch`` removes such tables
    once the results are written.
    """
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").option("compression", TABLE_CODEC).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean_pipeline(bronze: DataFrame, order: list[str], delivery_mode: str = "observed",
                   stage: bool = True, audit: bool = False) -> DataFrame:
    """C1..C21 over a bronze table; ``order`` is the source-order column list.

    The audit copies (C3) are dropped at the end in any case (C18), so they
    are made only for ``audit``, which stages them with the deduplicated rows
    and keeps them in the result. Source-order columns of a CSV read are not
    staged: nothing after the dedup reads them.
    """
    df = standardise(bronze, delivery_mode, audit)
    df = dedup_keep_first(df, DEDUP_KEYS, order).drop(*READ_COLUMNS)
    if stage:
        df = materialise(df, "dedup")
    df = repair_price_outliers(df)
    df = fill_missing(df)
    return df.drop("expected_price") if audit else drop_helpers(df)
