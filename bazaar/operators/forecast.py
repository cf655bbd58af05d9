"""Growth forecast: triple exponential smoothing of monthly series.

Facts are summed by key and month first; a series then is one row with a short
sorted array (one value a month, gaps as 0). The smoothing is a fold over that
array (level, trend, one seasonal term a month of the year), in expressions.
Each series is folded once for every parameter triple of a small grid; the
triple with the least squared one-step error is kept and carried on.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaar.operators.common import money_sum, require_columns
from bazaar.plans.joins import attach_scalars

SEASON = 12
ALPHAS, BETAS, GAMMAS = (0.2, 0.5, 0.8), (0.0, 0.1, 0.3), (0.1, 0.4)
PLACES = 2


def monthly_series(df: DataFrame, key: str, value: str = "final_amount_inr", date_col: str = "order_date") -> DataFrame:
    """(key, first, values): a value for every month from the key's first to
    the last of all, 0 where there are no rows. Rows without key or date are
    left out."""
    require_columns(df, [key, value, date_col], "monthly_series")
    months = df.where(F.col(key).isNotNull() & F.col(date_col).isNotNull()).groupBy(
        key, F.trunc(date_col, "MM").alias("month")).agg(money_sum(value).alias("value"))
    each = months.groupBy(key).agg(F.min("month").alias("first"), F.map_from_entries(F.collect_list(F.struct("month", "value"))).alias("by_month"))
    each = attach_scalars(each, months.agg(F.max("month").alias("last")))
    spine = F.sequence(F.col("first"), F.col("last"), F.expr("INTERVAL 1 MONTH"))
    return each.select(key, "first", F.transform(spine, lambda m: F.coalesce(F.element_at("by_month", m), F.lit(0.0))).alias("values"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _start(values: Column) -> Column:
    """Level, trend and seasonal terms of the first two years."""
    first, second = (_sum(F.slice(values, 1 + i * SEASON, SEASON)) / SEASON for i in (0, 1))
    return F.struct(first.alias("level"), ((second - first) / SEASON).alias("trend"),
                    F.transform(F.slice(values, 1, SEASON), lambda x: x - first).alias("season"),
                    F.lit(0.0).alias("error"), F.lit(0).alias("t"))


def _step(alpha: Column, beta: Column, gamma: Column):
    def step(s: Column, y: Column) -> Column:
        place = s["t"] % SEASON
        term = F.get(s["season"], place)
        level = alpha * (y - term) + (1 - alpha) * (s["level"] + s["trend"])
        trend = beta * (level - s["level"]) + (1 - beta) * s["trend"]
        miss = y - (s["level"] + s["trend"] + term)
        now = gamma * (y - level) + (1 - gamma) * term
        season = F.transform(s["season"], lambda x, i: F.when(i == place, now).otherwise(x))
        return F.struct(level.alias("level"), trend.alias("trend"), season.alias("season"),
                        (s["error"] + miss * miss).alias("error"), (s["t"] + 1).alias("t"))
    return step


def smooth(series: DataFrame, key: str) -> DataFrame:
    """(key, first, values, alpha, beta, gamma, state) of series of two years
    or more, with the best triple of the grid (of equal ones the smallest)."""
    grid = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("alpha", "beta", "gamma"), t, strict=True)])
                     for t in product(ALPHAS, BETAS, GAMMAS)])
    long = series.where(F.size("values") >= 2 * SEASON)
    each = long.select(key, "first", "values", F.explode(grid).alias("g"))
    folded = each.withColumn("state", F.aggregate(
        F.slice("values", SEASON + 1, F.size("values") - SEASON), _start(F.col("values")),
        _step(F.col("g.alpha"), F.col("g.beta"), F.col("g.gamma"))))
    best = F.min(F.struct(F.col("state.error").alias("error"), "g", "first", "values", "state")).alias("best")
    return folded.groupBy(key).agg(best).select(key, "best.first", "best.values", "best.g.*", "best.state")


def forecast(df: DataFrame, key: str, months: int = 6, value: str = "final_amount_inr", date_col: str = "order_date") -> DataFrame:
    """Per key and step 1 to ``months`` after the newest month: key, step,
    period_end, forecast (rounded, not below 0), alpha, beta, gamma. Keys with
    less than two years of months have no forecast."""
    best = smooth(monthly_series(df, key, value, date_col), key)
    out = best.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(int(months)))))
    place = (F.size("values") + F.col("step") - 1) % SEASON
    # The fold began after the first year, so its counter is a whole year behind.
    value_ = F.col("state.level") + F.col("step") * F.col("state.trend") + F.get(F.col("state.season"), place)
    return out.select(key, "step", F.last_day(F.add_months("first", F.size("values") + F.col("step") - 1)).alias("period_end"),
                      F.round(F.greatest(value_, F.lit(0.0)), PLACES).alias("forecast"), "alpha", "beta", "gamma").orderBy(key, "step")
