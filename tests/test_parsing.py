"""Literal cases of FIXTURES.md §6 for the column functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bazaar.functions import parsing as P
from bazaar.operators import clean as C


def one_col(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


DATE_CASES = [
    ("1-2-2020", dt.date(2020, 2, 1)), ("2020-1-5", dt.date(2020, 1, 5)),
    ("05/06/2020", dt.date(2020, 6, 5)), ("06/13/2020", dt.date(2020, 6, 13)),
    ("2020.12.31", dt.date(2020, 12, 31)), ("31.12.2020", dt.date(2020, 12, 31)),
    ("12.31.2020", dt.date(2020, 12, 31)), (" 2020/02/29 ", dt.date(2020, 2, 29)),
    ("20-13-2020", None), ("2020-02-30", None), ("2020-01-05 00:00:00", None),
    ("05-06-20", None), ("9999-01-01", None), ("1600-01-01", None), ("2020-01", None),
    ("nan", None), ("003-4-2020", None), ("2020-1/5", None), (None, None),
    ("1677-09-22", dt.date(1677, 9, 22)), ("1677-09-21", None),
    ("2262-04-11", dt.date(2262, 4, 11)), ("2262-04-12", None),
]


def test_parse_order_date_column(spark):
    got = one_col(spark, [c for c, _ in DATE_CASES], P.parse_order_date)
    assert got == [e for _, e in DATE_CASES]


def test_clean_dates_step_matches_column_function(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(DATE_CASES)], "i int, order_date string")
    rows = C.clean_dates(df).orderBy("i").collect()
    assert [r.order_date for r in rows] == [e for _, e in DATE_CASES]
    assert [r.is_valid_date for r in rows] == [e is not None for _, e in DATE_CASES]


def test_parse_price(spark):
    cases = [("₹1,25,000.50", 125000.5), ("-500", 500.0), ("Rs.500", 0.5), ("Price on Request", None),
             ("", None), ("1.2.3", None), (".", None), ("5.", 5.0), (".5", 0.5), (None, None)]
    assert one_col(spark, [c for c, _ in cases], P.parse_price) == [e for _, e in cases]


def test_parse_rating_and_fallback(spark):
    cases = [("3/5", 3.0), ("2.5/5.0", 2.5), ("4.0 stars", 4.0), ("4.25", 4.2), (" 5.0 ", 5.0),
             ("5.", 5.0), ("4 stars", None), ("nan", None), (None, None), ("inf", None), ("4e1", 40.0)]
    assert one_col(spark, [c for c, _ in cases], P.parse_rating) == [e for _, e in cases]
    df = spark.createDataFrame([("4 stars", 3.5), ("3/5", 1.0), (None, 2.0)],
                               "customer_rating string, product_rating double")
    assert [r[0] for r in C.clean_ratings(df).collect()] == [3.5, 3.0, 2.0]


def test_bool_text_and_coercion(spark):
    assert one_col(spark, ["False ", "1", "Y", "No", "TRUE", None], P.standardise_bool_text) == \
        ["False", "True", "Y", "False", "True", None]
    assert one_col(spark, [" YES ", "0", "Y", "true", "No", None], P.coerce_boolean) == \
        [True, False, None, True, False, None]


def test_city_and_category_maps(spark):
    assert one_col(spark, ["DELHI", "Kolkata ", "Madras", "Bombay", "Bengaluru", "Pune", "delhi ", None],
                   P.standardise_city) == \
        ["Delhi", "Kolkata", "Chennai", "Mumbai", "Bangalore", "Pune", "delhi ", None]
    assert one_col(spark, ["Electronicss", "Books", "ELECTRONICS"], P.standardise_category) == \
        ["Electronics", "Books", "Electronics"]


@pytest.mark.parametrize("mode,expected", [
    ("observed", [3, 0, 1, 0, 0, 1, None, None, 0, 1, 0]),
    # Same Day / Express -> fast value; Standard + prime -> middle; else -> slow
    ("intended", [3, 0, 2, 1, 2, 5, None, None, 0, 1, 2]),
])
def test_delivery_days(spark, mode, expected):
    rows = [("3", "Standard", "False"), ("-1", "Express", "True"), ("1-2 days", "Standard", "True"),
            ("Express", "Standard", "True"), ("Same Day", "Standard", "False"), ("15", "Standard", "No"),
            ("8", "Express", "True"), (None, "Express", "True"), ("-1", "Same Day", None),
            ("1-2 days", "Same Day", "True"), ("Express", "Other", "True")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                               "i int, delivery_days string, delivery_type string, is_prime_member string")
    got = [r[0] for r in C.clean_delivery(df, mode).orderBy("i").select("delivery_days").collect()]
    assert got == expected


def test_coerce_numeric(spark):
    cases = [(" 12 ", 12.0), ("1e3", 1000.0), ("1,000", None), ("inf", None), ("-5", -5.0),
             ("+.5", 0.5), ("abc", None), (None, None), ("4f", None)]
    assert one_col(spark, [c for c, _ in cases], P.coerce_numeric) == [e for _, e in cases]


def test_coerce_date_load_time(spark):
    cases = [("2021-03-04", dt.date(2021, 3, 4)), ("03/04/2021", dt.date(2021, 3, 4)),
             ("13/04/2021", dt.date(2021, 4, 13)), ("2021-03-04 10:11:12", dt.date(2021, 3, 4)),
             ("junk", None)]
    assert one_col(spark, [c for c, _ in cases], P.coerce_date) == [e for _, e in cases]


def test_missing_tokens(spark):
    assert one_col(spark, ["NA", "None", "null", "", "x", " NA"], P.null_tokens) == \
        [None, None, None, None, "x", " NA"]


def test_no_python_udf_in_cleaning_plans(spark):
    df = spark.createDataFrame([("1-2-2020", "3/5", "₹5", "15")],
                               "order_date string, customer_rating string, original_price_inr string, delivery_days string")
    plan = C.standardise(df)._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_load_view_types_a_text_file(spark):
    from bazaar.operators.typing import load_view
    df = spark.createDataFrame(
        [("2021-04-05", "1,200", "3", " Yes ", "0", "2"), ("04/13/2021 10:00", "15.5", "x", "no", "TRUE", None),
         ("junk", "1e3", None, "maybe", None, "7")],
        "order_date string, final_amount_inr string, quantity string, is_prime_member string, "
        "is_festival_sale string, delivery_days string")
    rows = load_view(df).collect()
    assert [r.order_date for r in rows] == [dt.date(2021, 4, 5), dt.date(2021, 4, 13), None]
    assert [r.order_quarter for r in rows] == ["2021Q2", "2021Q2", None]
    assert [r.order_year for r in rows] == [2021, 2021, None]
    assert [r.final_amount_inr for r in rows] == [None, 15.5, 1000.0]
    assert [r.quantity for r in rows] == [3.0, None, None]
    assert [r.is_prime_member for r in rows] == [True, False, None]
    assert [r.is_festival_sale for r in rows] == [False, True, None]
    assert [r.delivery_days for r in rows] == [2.0, None, 7.0]
