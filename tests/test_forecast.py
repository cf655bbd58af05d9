"""Triple exponential smoothing against a plain loop, and on series that it must continue."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from bazaar.operators import forecast as FC


def table(spark, series, start=dt.date(2018, 3, 1)):
    rows = []
    for key, values in series.items():
        for i, v in enumerate(values):
            if v is not None:
                y, m = divmod(start.year * 12 + start.month - 1 + i, 12)
                rows.append((key, dt.date(y, m + 1, 1 + i % 27), float(v)))
    return spark.createDataFrame(rows, "k string, order_date date, final_amount_inr double")


def plain(values, steps=6):
    best = None
    for a in FC.ALPHAS:
        for b in FC.BETAS:
            for g in FC.GAMMAS:
                level, second = sum(values[:12]) / 12, sum(values[12:24]) / 12
                trend, season, error = (second - level) / 12, [v - level for v in values[:12]], 0.0
                for t, y in enumerate(values[12:]):
                    s = season[t % 12]
                    error += (y - (level + trend + s)) ** 2
                    new = a * (y - s) + (1 - a) * (level + trend)
                    trend = b * (new - level) + (1 - b) * trend
                    season[t % 12] = g * (y - new) + (1 - g) * s
                    level = new
                out = [max(level + h * trend + season[(len(values) + h - 1) % 12], 0.0) for h in range(1, steps + 1)]
                best = min(best or (error, a, b, g, out), (error, a, b, g, out))
    return best


def test_matches_a_plain_loop(spark):
    rng = random.Random(1)
    series = {f"s{i}": [round(rng.uniform(0, 1000), 2) for _ in range(rng.choice([24, 25, 40, 61]))] for i in range(4)}
    longest = max(map(len, series.values()))
    # A series that ends earlier goes on with zeros to the newest month.
    padded = {k: v + [0.0] * (longest - len(v)) for k, v in series.items()}
    got = {}
    for r in FC.forecast(table(spark, series), "k").collect():
        got.setdefault(r.k, []).append(r)
    for k, v in padded.items():
        _, a, b, g, out = plain(v)
        assert [(r.alpha, r.beta, r.gamma) for r in got[k]] == [(a, b, g)] * 6
        assert [r.forecast for r in got[k]] == pytest.approx(out, abs=0.011)
        assert [r.step for r in got[k]] == list(range(1, 7))


def test_continues_trend_and_season(spark):
    values = [1000 + 10 * t + 200 * ((t % 12) in (8, 9)) for t in range(60)]
    rows = FC.forecast(table(spark, {"a": values}), "k", months=12).collect()
    want = [1000 + 10 * t + 200 * ((t % 12) in (8, 9)) for t in range(60, 72)]
    assert [r.forecast for r in rows] == pytest.approx(want, rel=0.03)
    assert rows[0].period_end == dt.date(2023, 3, 31) and rows[11].period_end == dt.date(2024, 2, 29)


def test_short_empty_and_missing(spark):
    df = table(spark, {"short": [None] + [1.0] * 23, "gap": [5.0] + [None] * 22 + [5.0]})
    assert {r.k for r in FC.forecast(df, "k").collect()} == {"gap"}
    assert FC.forecast(df.limit(0), "k").collect() == []
    odd = df.unionByName(df.withColumn("k", F.lit(None).cast("string"))).unionByName(df.withColumn("order_date", F.lit(None).cast("date")))
    assert FC.forecast(odd, "k").collect() == FC.forecast(df, "k").collect()
