"""Dates in free form (L1): a small token grammar in Spark expressions.

A text is read in stages, each a step over the columns of the one before, so
nothing is computed twice a row:

1. ``rest``: the text in lower case without its time of day and zone, weekday,
   ordinal endings and punctuation; the tokens that are left.
2. Each token's number and length, or its month if it is a name.
3. Which token is day, month and year, by the places of the month's name and of
   the year (a number of more than two digits, or above 31); otherwise by
   ``order``. Two-digit years fall within 50 years of ``BASE_YEAR``.

A missing day or month is the first; a text without a year has no date. Text
that is no date, or names an impossible day, is NULL; nothing raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaar.functions.parsing import FULL_MONTHS, checked_date, in_date_range, py_strip
from bazaar.schema import MONTH_NAMES

MONTH_NUMBERS = {n: i % 12 + 1 for i, n in enumerate([*MONTH_NAMES, *FULL_MONTHS])} | {"sept": 9}

#: Two-digit years are those from 50 years before this one to 49 after it.
BASE_YEAR = 2025

WEEKDAY_RE = r"\b(?:mon|tue|tues|wed|weds|thu|thur|thurs|fri|sat|sun|monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b"
#: A time of day, its zone included, alone or after a date's 'T' or space.
ZONE = r"(?:z|utc|gmt|ist|[ecmp][sd]t|bst|ces?t|[+-](?:0\d|1[0-4]):?(?:[0-5]\d)?)"
HOUR, MINUTE = r"(?:[01]?\d|2[0-3])", r"[0-5]\d"
TIME_RE = (rf"(?:(?<=\d)t|(?<![\d:.a-z]))(?:{HOUR}:{MINUTE}(?::{MINUTE}(?:[.,]\d+)?)?(?:\s*[ap]\.?m\b\.?)?"
           rf"|(?:0?\d|1[0-2])\s*[ap]\.?m\b\.?)(?![\d:])(?:\s*{ZONE}(?![a-z\d]))?")
#: The time of day of compact text: 20200105T101500.
COMPACT_TIME_RE = rf"(?<=^\d{{8}})t(?:[01]\d|2[0-3]){MINUTE}(?:{MINUTE}(?:[.,]\d+)?)?{ZONE}?$"
TOKENS_RE = r"^(?:\d{1,14}|[a-z]{3,9})(?: (?:\d{1,4}|[a-z]{3,9})){0,2}$"


def _staged(df: DataFrame, prefix: str, stages: list[dict[str, Column]]) -> DataFrame:
    """``stages`` one after the other; each one's names get ``prefix``."""
    for stage in stages:
        df = df.withColumns({f"{prefix}{k}": v for k, v in stage.items()})
    return df


def free_prefix(df: DataFrame) -> str:
    """A start of names that no column of ``df`` has."""
    prefix = "_date_"
    while any(c.startswith(prefix) for c in df.columns):
        prefix = "_" + prefix
    return prefix


def _text_stages(text: Column, col) -> list[dict[str, Column]]:
    """Stage 1. Only text that is likely a date is taken apart."""
    likely = F.length(text).between(4, 60) & text.rlike(r"\d")
    # Text without capitals or letters beyond ASCII is in lower case as it is.
    low = F.when(likely, F.when(text.rlike(r"[^ -@\[-~]"), F.lower(text)).otherwise(text))
    low = F.when(low.rlike(r"^\d{8}t"), F.regexp_replace(low, COMPACT_TIME_RE, "")).otherwise(low)
    # Each part is taken out only of text that may have it: a search costs less
    # than a replacement.
    def without(c: str, hint: str, *patterns: str) -> Column:
        out = F.col(col(c))
        for p in patterns:
            out = F.regexp_replace(out, p, " ")
        return F.when(F.col(col(c)).rlike(hint), out).otherwise(F.col(col(c)))

    timed = without("low", r":|\d\s?[ap]\.?m", TIME_RE)
    named = without("timed", r"mon|tue|wed|thu|fri|sat|sun|\d(?:st|nd|rd|th)|of", WEEKDAY_RE, r"(?<=\d)(?:st|nd|rd|th)\b|\bof\b")
    # Letters and digits that touch (5jan2020) are tokens of their own.
    split = F.btrim(F.regexp_replace(col("named"), r"[\s,./'-]+|(?<=\d)(?=[a-z])|(?<=[a-z])(?=\d)", " "))
    parts = F.when(F.col(col("rest")).rlike(TOKENS_RE), F.split(col("rest"), " "))
    return [{"low": low}, {"timed": timed}, {"named": named}, {"rest": split}, {"parts": parts}]


def _token_stages(col) -> list[dict[str, Column]]:
    """Stage 2."""
    months = F.create_map(*[F.lit(x) for pair in MONTH_NUMBERS.items() for x in pair])
    token = {f"t{i}": F.get(col("parts"), F.lit(i - 1)) for i in (1, 2, 3)}
    out: dict[str, Column] = {"n": F.size(col("parts"))}
    for i in (1, 2, 3):
        t = F.col(col(f"t{i}"))
        digits = t.rlike(r"^\d{1,4}$")
        out[f"d{i}"] = F.when(digits, t.cast("int"))
        # More than two digits, or no day of a month: a year.
        out[f"y{i}"] = digits & ((F.length(t) > 2) | (t.cast("int") > 31))
        out[f"m{i}"] = F.when(~digits, F.element_at(months, t))
    return [token, out]


def _order_stages(col, order: str) -> list[dict[str, Column]]:
    """Stage 3: year, its digits, month and day of each row."""
    d1, d2, d3, m1, m2, m3, y1, y2, y3 = (F.col(col(f"{x}{i}")) for x in "dmy" for i in (1, 2, 3))
    n, t1 = F.col(col("n")), F.col(col("t1"))
    size = [F.length(F.col(col(f"t{i}"))) for i in (1, 2, 3)]
    one = F.lit(1)

    def date(y, digits, m, d):
        return F.struct(y.alias("y"), digits.alias("digits"), m.alias("m"), d.alias("d"))

    day_first = F.lit(order == "day_first") & (d2 <= 12) | (d1 > 12)
    number = m1.isNull() & m2.isNull() & m3.isNull()
    three = (F.when(number & y1, date(d1, size[0], d2, d3))
             .when(number & ~y2 & day_first, date(d3, size[2], d2, d1))
             .when(number & ~y2, date(d3, size[2], d1, d2))
             .when(m1.isNotNull() & y2, date(d2, size[1], m1, d3))
             .when(m1.isNotNull(), date(d3, size[2], m1, d2))
             .when(m2.isNotNull() & y1, date(d1, size[0], m2, d3))
             .when(m2.isNotNull(), date(d3, size[2], m2, d1))
             .when(m3.isNotNull() & y2, date(d2, size[1], m3, d1))
             .when(m3.isNotNull(), date(d1, size[0], m3, d2)))
    two = (F.when(m1.isNotNull() & y2, date(d2, size[1], m1, one))
           .when(m2.isNotNull() & y1, date(d1, size[0], m2, one))
           .when(number & y1, date(d1, size[0], d2, one))
           .when(number & y2, date(d2, size[1], d1, one)))
    cut = lambda at, k: F.substring(t1, at, k).try_cast("int")
    # 20200105, with hours and minutes or not; 200105; 2020.
    single = (F.when(t1.rlike(r"^\d{8}(?:\d{4}(?:\d{2})?)?$"), date(cut(1, 4), F.lit(4), cut(5, 2), cut(7, 2)))
              .when(t1.rlike(r"^\d{6}$"), date(cut(1, 2), F.lit(2), cut(3, 2), cut(5, 2)))
              .when(t1.rlike(r"^\d{4}$"), date(cut(1, 4), F.lit(4), one, one)))
    ymd = F.when(n == 3, three).when(n == 2, two).when(n == 1, single)
    y, digits = F.col(col("ymd")).getField("y"), F.col(col("ymd")).getField("digits")
    low = F.lit(BASE_YEAR - 50)
    year = F.when(digits == 4, y).when(digits <= 2, low + F.pmod(y - low, F.lit(100)))
    return [{"ymd": ymd}, {"year": year}]


def parse_free_dates(df: DataFrame, source: str, target: str, order: str = "month_first") -> DataFrame:
    """``df`` with ``target``: the date of text column ``source`` in free form.
    ``order`` says which of two numbers up to 12 before the year is the month:
    'month_first' or 'day_first'. A number above 12 is always the day."""
    if order not in ("month_first", "day_first"):
        raise ValueError("order must be 'month_first' or 'day_first'")
    prefix = free_prefix(df)
    col = lambda name: f"{prefix}{name}"
    stages = [{"text": py_strip(source)}, *_text_stages(F.col(col("text")), col), *_token_stages(col),
              *_order_stages(col, order)]
    out = _staged(df, prefix, stages)
    ymd = F.col(col("ymd"))
    out = out.withColumn(target, in_date_range(checked_date(F.col(col("year")), ymd.getField("m"), ymd.getField("d"))))
    return out.drop(*[f"{prefix}{k}" for s in stages for k in s])


#: Numbers before a year, or the two numbers after one: what tells the order.
AMBIGUOUS_RE = r"^\s*(\d{1,2})([-/. ])(\d{1,2})\2\d{2,4}(?:$|[\sTt,])"


def date_shapes(df: DataFrame, col: str) -> DataFrame:
    """The shapes of a text column's dates in one pass: shape (digits as 9,
    letters as a), n, and how many of its texts can only be day-first or only
    month-first. Groups are summed on the map side; texts of over 60
    characters count as one shape."""
    text = py_strip(col)
    shape = F.when(F.length(text) > 60, F.lit("long text")).otherwise(
        F.regexp_replace(F.regexp_replace(text, r"\d", "9"), r"\p{L}+", "a"))
    first, second = (F.regexp_extract(text, AMBIGUOUS_RE, g).try_cast("int") for g in (1, 3))
    return df.where(F.col(col).isNotNull()).select(
        shape.alias("shape"), first.alias("first"), second.alias("second")).groupBy("shape").agg(
        F.count(F.lit(1)).alias("n"), F.count_if((F.col("first") > 12) & (F.col("second") <= 12)).alias("day_first"),
        F.count_if((F.col("second") > 12) & (F.col("first") <= 12)).alias("month_first"))


def inferred_order(df: DataFrame, col: str) -> str:
    """The order that a whole column's texts tell: 'day_first' if some can only
    be read so and none only the other way, else 'month_first' (as a free-form
    parser reads each text by itself). One aggregation, one row to the driver."""
    found = date_shapes(df, col).agg(F.sum("day_first").alias("day"), F.sum("month_first").alias("month")).first()
    return "day_first" if (found["day"] or 0) > 0 and not found["month"] else "month_first"
