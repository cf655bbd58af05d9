"""Shared aggregation rules (G0) and the column guard."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Money is summed as an exact decimal so results do not depend on row order.
MONEY_TYPE = "decimal(18,4)"
# Ratios and means are rounded to this many places.
RATIO_PLACES = 6


class MissingColumnsError(ValueError):
    """A report was asked for on a table that lacks columns it needs."""


def require_columns(df: DataFrame, cols: Iterable[str], report: str = "") -> None:
    """Fail fast, before any job, when a needed column is absent."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        where = f" for {report}" if report else ""
        raise MissingColumnsError(f"missing column(s){where}: {', '.join(missing)}")


def require_date(df: DataFrame, report: str = "") -> None:
    """U1 for reports by year: an ``order_year`` or an ``order_date`` to take it from."""
    if "order_year" not in df.columns:
        require_columns(df, ["order_date"], report)


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Relative standard deviation of approximate distinct counts (HyperLogLog++).
APPROX_RSD = 0.01


def distinct_count(c: str | Column, approx: bool = False) -> Column:
    """Distinct non-NULL values: exact by default; ``approx`` uses
    HyperLogLog++ (fixed-size sketches merged map-side, no shuffle of ids)."""
    return F.approx_count_distinct(col_of(c), APPROX_RSD) if approx else F.count_distinct(col_of(c))


def money(c: str | Column) -> Column:
    """A money value as exact decimal; NULL beyond its range, see ``exact_sum``."""
    return col_of(c).try_cast(MONEY_TYPE)


def decimal_total(sum_expr: Column) -> Column:
    """An exact decimal sum as double, 4 places, 0 when there were no values.

    Rounding after the cast gives the double nearest to the exact decimal in
    any engine, whatever rounding its decimal-to-double cast does.
    """
    return F.coalesce(F.round(sum_expr.cast("double"), 4), F.lit(0.0))


def exact_sum(exact: Column, plain: Column, when: Column | None = None) -> Column:
    """Sum of ``exact`` (decimals), plus that of ``plain`` (doubles) over the
    rows whose value has no exact form: no amount is lost, however large, and
    ordinary ones keep the fast exact path. Missing values (and NaN) add 0."""
    rest = exact.isNull() & plain.isNotNull()
    if when is not None:
        exact, rest = F.when(when, exact), rest & when
    return decimal_total(F.sum(exact)) + F.coalesce(F.sum(F.when(rest, plain)), F.lit(0.0))


def plain_number(c: str | Column) -> Column:
    """A value as double; NaN counts as missing."""
    x = col_of(c).try_cast("double")
    return F.when(~F.isnan(x), x)


# Types whose every value is an exact money value.
EXACT_TYPES = ["tinyint", "smallint", "int", *(f"decimal({p},{s})" for s in range(5) for p in range(max(s, 1), s + 15))]


def money_sum(c: str | Column) -> Column:
    """Sum of money; a group with no values sums to 0, as in the reference.

    The type is known when the plan is made: for a column of exact values the
    sum of doubles beside the exact one folds away.
    """
    rest = F.when(~F.typeof(col_of(c)).isin(*EXACT_TYPES), plain_number(c))
    return exact_sum(money(c), rest)


def num_sum(c: str | Column) -> Column:
    """Sum of a plain number; no values sum to 0."""
    return F.coalesce(F.sum(col_of(c)).cast("double"), F.lit(0.0))


def ratio(num: Column, den: Column) -> Column:
    """num / den rounded, NULL when den is 0 or NULL."""
    return F.round(F.try_divide(num, den), RATIO_PLACES)


def mean(c: str | Column) -> Column:
    return F.round(F.avg(col_of(c)), RATIO_PLACES)


def present_means(df: DataFrame, report: str, cols: list[str]) -> list[Column]:
    """``avg_<column>`` of the columns that exist; none of them is an error."""
    found = [c for c in cols if c in df.columns]
    if not found:
        require_columns(df, cols, report)
    return [mean(c).alias(f"avg_{c}") for c in found]


# Text pandas' reader turns into boolean true (public pandas default).
TRUE_TEXT = ["True", "TRUE", "true"]


def is_true(df: DataFrame, c: str) -> Column:
    """boolean equality with True that never raises; missing is not a match.

    A boolean column is compared directly; a text column matches only the
    words pandas would have read as true, so text such as 'Returned' never
    matches (as in the reference).
    """
    dtype = df.schema[c].dataType.simpleString()
    if dtype == "boolean":
        return F.coalesce(F.col(c), F.lit(False))
    if dtype == "string":
        return F.coalesce(F.col(c).isin(*TRUE_TEXT), F.lit(False))
    return F.coalesce(F.col(c).cast("double") == 1.0, F.lit(False))


def group_agg(df: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    """Group with NULL keys dropped (pandas ``groupby`` default).

    Spark runs it as partial (map-side) plus final hash aggregation, so only
    one row per key and input partition crosses the shuffle.
    """
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    src = df.where(cond) if cond is not None else df
    return src.groupBy(*keys).agg(*aggs)


def top_k(df: DataFrame, by: str, keys: list[str], n: int | None,
          ascending: bool = False) -> DataFrame:
    """Sort by ``by`` (NULL last), key columns as tie-break, keep ``n`` rows.

    ``orderBy(...).limit(n)`` is planned as TakeOrderedAndProject: each task
    keeps its own n best rows, so only n rows per task reach the final merge.
    """
    first = F.asc_nulls_last(by) if ascending else F.desc_nulls_last(by)
    out = df.orderBy(first, *[F.asc_nulls_last(k) for k in keys])
    return out.limit(n) if n is not None else out
