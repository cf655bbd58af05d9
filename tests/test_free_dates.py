"""Dates in free form (L1) against a public free-form parser and literal cases."""

import datetime as dt
import random

import pytest
from dateutil import parser as free_parser
from pyspark.sql import functions as F

from bazaar.functions import dates as D
from bazaar.operators.typing import load_dates, load_view

DAY = dt.date(2020, 1, 5)
CASES = [
    ("2020-01-05T10:00:00", DAY), ("2020-01-05T10:00:00Z", DAY), ("2020-01-05T10:00:00.123+05:30", DAY),
    ("2020-01-05 10:00:00 UTC", DAY), ("20200105", DAY), ("20200105T100000", DAY), ("202001051000", DAY),
    ("5/1/20", dt.date(2020, 5, 1)), ("25/1/20", dt.date(2020, 1, 25)), ("Jan 2020", dt.date(2020, 1, 1)),
    ("2020 Jan 5", DAY), ("Monday, January 5, 2020", DAY), ("Sun 5 Jan 2020 10:00 AM", DAY), ("10:00 AM", None),
    ("10:00 AM Jan 5 2020", DAY), ("5 Jan 2020", DAY), ("05-January-2020", DAY), ("Jan 5, 2020", DAY), ("5jan2020", DAY),
    ("5th of January 2020", DAY), ("Jan-20-2020", dt.date(2020, 1, 20)), ("2020/01", dt.date(2020, 1, 1)), ("01/2020", dt.date(2020, 1, 1)),
    ("2020", dt.date(2020, 1, 1)), ("sept 1 1999", dt.date(1999, 9, 1)), ("31.12.99", dt.date(1999, 12, 31)), ("1/2/75", dt.date(1975, 1, 2)),
    ("1/2/74", dt.date(2074, 1, 2)), ("200105", DAY), ("2020-01-05", DAY), ("  2020.01.05 ", DAY),
    ("2020-02-30", None), ("30 Feb 2020", None), ("Jan 5", None), ("5 Foo 2020", None), ("not a date", None), ("", None),
    (None, None), ("1.5", None), ("25:00 Jan 5 2020", None), ("2020-13-01", None), ("1-2-3-4", None), ("9" * 50, None),
    ("x" * 5000 + "2020-01-05", None), ("1/1/1500", None), ("Price 2020", None),
]


def read(spark, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.t for r in load_dates(df, "t", **kw).orderBy("i").collect()]


def test_literal_cases(spark):
    assert read(spark, [t for t, _ in CASES]) == [d for _, d in CASES]


FORMS = ["%Y-%m-%d", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%S.%fZ", "%Y-%m-%d %H:%M:%S+00:00", "%Y%m%d", "%Y%m%dT%H%M%S", "%m/%d/%Y",
         "%m/%d/%y", "%d/%m/%Y", "%d.%m.%y", "%d %b %Y", "%d-%B-%Y", "%b %d, %Y", "%B %d %Y %I:%M %p", "%A, %d %B %Y", "%a %b %d %H:%M:%S %Y",
         "%I:%M %p %d %b %Y", "%Y %b %d", "%Y/%m/%d %H:%M", "%d%b%Y", "%b-%d-%Y", "%y-%m-%d %H:%M", "%H:%M:%S %d/%m/%Y", "%m-%d-%Y %I %p"]


def model(text):
    try:
        return free_parser.parse(text, default=dt.datetime(2025, 1, 1)).date()
    except (ValueError, OverflowError):
        return None


def test_agrees_with_a_free_form_parser(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(700):
        day = dt.datetime(1980, 1, 1) + dt.timedelta(seconds=rng.randrange(60 * 365 * 86400))
        texts.append(day.strftime(rng.choice(FORMS)))
    got = read(spark, texts)
    wrong = [(t, g, model(t)) for t, g in zip(texts, got, strict=True) if g != model(t)]
    assert wrong == []
    # Some two-digit years first are no date for either.
    assert sum(g is None for g in got) < 30


def test_order_of_a_whole_column(spark):
    mixed = ["03/04/2020", "13/04/2020", "5/6/20", "1 Feb 2020"]
    df = spark.createDataFrame([(t,) for t in mixed], "t string")
    assert D.inferred_order(df, "t") == "day_first"
    assert read(spark, mixed, order="infer") == [dt.date(2020, 4, 3), dt.date(2020, 4, 13), dt.date(2020, 6, 5), dt.date(2020, 2, 1)]
    assert read(spark, mixed)[:3] == [dt.date(2020, 3, 4), dt.date(2020, 4, 13), dt.date(2020, 5, 6)]
    both = [*mixed, "04/25/2020"]
    assert read(spark, both, order="infer")[0] == dt.date(2020, 3, 4)
    assert D.inferred_order(df.limit(0), "t") == "month_first"
    with pytest.raises(ValueError):
        load_dates(df, "t", order="year_first")


def test_shapes(spark):
    df = spark.createDataFrame([(t,) for t in ["13/04/2020", "01/02/2020", "04/25/2020", "5 Jan 2020", None, "y" * 80]], "t string")
    got = {r.shape: (r.n, r.day_first, r.month_first) for r in D.date_shapes(df, "t").collect()}
    assert got == {"99/99/9999": (3, 1, 1), "9 a 9999": (1, 0, 0), "long text": (1, 0, 0)}


def test_timestamps_are_loaded_and_other_columns_stay(spark):
    df = spark.createDataFrame([("2021-03-04T10:11:12Z", "a", "b")], "order_date string, _date_text string, _date_low string")
    r = load_view(df).first()
    assert (r.order_date, r.order_year, r._date_text, r._date_low) == (dt.date(2021, 3, 4), 2021, "a", "b")


def test_native_and_staged_once(spark):
    df = load_dates(spark.createDataFrame([("1 Jan 2020",)], "t string"), "t")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan
    assert plan.count("split(") <= 2
