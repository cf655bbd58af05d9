"""Column -> Column cleaning and coercion functions.

All are native Spark expressions (no Python UDF): they stay inside
whole-stage codegen and run as narrow projections next to the scan.
Where the reference would raise on a value, these return NULL instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bazaar.schema import (
    BOOL_TEXT_MAP, CATEGORY_MAP, CITY_MAP, DATE_FORMATS, DELIVERY_TEXT_DAYS, FALSE_TOKENS, MAX_DATE,
    MIN_DATE, MISSING_TOKENS, MONTH_NAMES, PAYMENT_MAP, PLAIN_DELIVERY_DAYS, STRIP_CHARS, TRUE_TOKENS,
)

# A number as Python's float() reads it (after trimming): no inf/nan words,
# no type suffixes, which Spark's cast would otherwise accept.
NUMBER_RE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"



def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: str | Column) -> Column:
    """Python ``str.strip()`` on text: trims all Unicode whitespace, not only spaces."""
    return F.btrim(_c(c).cast("string"), F.lit(STRIP_CHARS))


def null_tokens(c: str | Column, tokens: list[str] | None = None) -> Column:
    """Text the pandas reader treats as missing becomes NULL."""
    col = _c(c)
    return F.when(col.isin(*(tokens if tokens is not None else MISSING_TOKENS)), F.lit(None)) \
            .otherwise(col)


def checked_date(y: Column, m: Column, d: Column) -> Column:
    """make_date only for a real calendar day, else NULL; never raises.

    The day is compared with the month's length first, so impossible dates
    (2020-02-30) cost a comparison, not a failed parse.
    """
    month_ok = m.between(1, 12) & y.between(1, 9999)
    days_in_month = F.dayofmonth(F.last_day(F.make_date(y, m, F.lit(1))))
    return F.when(month_ok, F.when(d.between(F.lit(1), days_in_month), F.make_date(y, m, d)))


# Shape of a date text: three numbers, one separator used twice.
DATE_SHAPE_RE = r"^\d{1,4}([-/.])\d{1,2}\1\d{1,4}$"


def date_text(s: Column) -> dict[str, Column]:
    """First-stage facts of a date text (stage these as columns): ``t``, the
    text with every separator turned into '-', and ``ok``, whether it has the
    shape of three numbers with one separator used twice."""
    return {"t": F.translate(s, "/.", "--"), "ok": s.rlike(DATE_SHAPE_RE)}


def date_fields(s: Column, t: Column | None = None, ok: Column | None = None) -> dict[str, Column]:
    """Per-row facts a date text is parsed from (stage these as columns).

    ``shape``: 'first' / 'last' (position of the 4-digit year) or NULL when
    the text has neither form; ``sep``: the separator; ``f1..f3``: the three
    numbers in text order. ``t`` and ``ok`` are :func:`date_text` of ``s``.
    The fields are cut with ``substring_index`` on the literal '-' (no
    regular expression, no cast of text that is not digits).
    """
    if t is None or ok is None:
        first = date_text(s)
        t, ok = first["t"], first["ok"]
    a = F.substring_index(t, "-", 1)
    b = F.substring_index(F.substring_index(t, "-", 2), "-", -1)
    c = F.substring_index(t, "-", -1)
    n1, n3 = F.length(a), F.length(c)
    shape = (F.when(ok & (n1 == 4) & (n3 <= 2), F.lit("first"))
              .when(ok & (n3 == 4) & (n1 <= 2), F.lit("last")))
    return {
        "shape": shape,
        "sep": F.when(ok, F.substring(s, n1 + 1, F.lit(1))),
        "f1": F.when(ok, a.cast("int")),
        "f2": F.when(ok, b.cast("int")),
        "f3": F.when(ok, c.cast("int")),
    }


def date_from_fields(fields: dict[str, Column], formats: list[str]) -> Column:
    """First format (in list order) whose shape and separator match and that
    gives a real calendar date; no parser exception is ever thrown.

    ``fields`` are the (staged) columns of :func:`date_fields`.
    """
    tries = []
    for fmt in formats:
        sep, order = fmt[1], fmt.split(fmt[1])
        if order[0] == "Y":
            shape = "first"
        elif order[2] == "Y":
            shape = "last"
        else:
            raise ValueError(f"year must come first or last: {fmt}")
        pos = {f: fields[f"f{i + 1}"] for i, f in enumerate(order)}
        cond = (fields["shape"] == shape) & (fields["sep"] == sep)
        tries.append(F.when(cond, checked_date(pos["Y"], pos["m"], pos["d"])))
    return F.coalesce(*tries)


def in_date_range(d: Column) -> Column:
    """Dates a nanosecond timestamp can hold; others become NULL."""
    return F.when(d.between(F.lit(MIN_DATE).cast("date"), F.lit(MAX_DATE).cast("date")), d)


def parse_date_formats(c: str | Column, formats: list[str]) -> Column:
    """Trim, parse by the first matching format, range check (one expression).

    Convenient on a plain column; on large data prefer the DataFrame step
    ``clean_dates``, which stages the trimmed text and its fields once.
    """
    return in_date_range(date_from_fields(date_fields(py_strip(c)), formats))


def parse_order_date(c: str | Column) -> Column:
    """Nine day/month/year orders, day-first before month-first; else NULL."""
    return parse_date_formats(c, DATE_FORMATS)


# What float() accepts once only digits and dots are left.
DIGITS_DOT_RE = r"^(\d+\.?\d*|\.\d+)$"


# First code points of the runs of ten decimal digits of other scripts (basic plane).
DIGIT_ZEROS = [
    0x0660, 0x06F0, 0x07C0, 0x0966, 0x09E6, 0x0A66, 0x0AE6, 0x0B66, 0x0BE6, 0x0C66, 0x0CE6, 0x0D66,
    0x0DE6, 0x0E50, 0x0ED0, 0x0F20, 0x1040, 0x1090, 0x17E0, 0x1810, 0x1946, 0x19D0, 0x1A80, 0x1A90,
    0x1B50, 0x1BB0, 0x1C40, 0x1C50, 0xA620, 0xA8D0, 0xA900, 0xA9D0, 0xA9F0, 0xAA50, 0xABF0, 0xFF10,
]


def ascii_digits(c: str | Column) -> Column:
    """Decimal digits of any script as 0-9, other characters unchanged. Text of
    plain ASCII, the usual case, is passed on as it is."""
    col = _c(c).cast("string")
    other = "".join(chr(z + i) for z in DIGIT_ZEROS for i in range(10))
    return F.when(F.length(col) == F.octet_length(col), col).otherwise(
        F.translate(col, other, "0123456789" * len(DIGIT_ZEROS)))


def parse_price(c: str | Column) -> Column:
    """C4: keep digits and dots, read as a number; the sign is lost, junk is
    NULL. Digits of other scripts count."""
    kept = F.regexp_replace(ascii_digits(c), r"[^0-9.]", "")
    return F.when(kept.rlike(DIGITS_DOT_RE), kept.cast("double"))


def parse_rating(c: str | Column) -> Column:
    """Drop '/5', trim, read the first three characters as a number.

    ``4.25`` gives 4.2 (cut, not rounded); ``4 stars`` (which stops the
    reference) and ``nan`` give NULL.
    """
    cut = F.substring(py_strip(F.replace(_c(c).cast("string"), F.lit("/5"), F.lit(""))), 1, 3)
    s = py_strip(cut)  # float() itself ignores spaces around the cut text ('4. 5' -> '4. ')
    return F.when(s.rlike(NUMBER_RE), s.cast("double"))


# A number, optionally 'out of' another, optionally followed by a word for stars.
WIDE_RATING_RE = r"(?i)^(\d+(?:\.\d+)?)\s*(?:(?:/|out of)\s*(\d+(?:\.\d+)?))?\s*(?:stars?|\*+)?$"


def parse_rating_wide(c: str | Column, words: dict[str, float] | None = None, top: float = 5.0) -> Column:
    """Ratings in more spellings: '4 stars', '4.5', '8/10' and '3 out of 5'
    (scaled to ``top``), and any spelling of ``words`` (lower case -> rating).
    NULL for other text and for ratings beyond ``top``. C5 stays as it is."""
    s = py_strip(ascii_digits(c))
    value = F.regexp_extract(s, WIDE_RATING_RE, 1).try_cast("double")
    scale = F.regexp_extract(s, WIDE_RATING_RE, 2).try_cast("double")
    scaled = F.when(scale.isNull(), value).otherwise(F.try_divide(value * F.lit(float(top)), scale))
    out = F.when(s.rlike(WIDE_RATING_RE) & (scaled <= top), scaled)
    for word, rating in (words or {}).items():
        out = F.when(F.lower(s) == word, F.lit(float(rating))).otherwise(out)
    return out


def standardise_payment(c: str | Column, mapping: dict[str, list[str]] | None = None) -> Column:
    """Spellings of a payment method -> one name. Compared after trim,
    lower-case and with runs of anything but letters and digits as one space;
    a method that the mapping does not know keeps its trimmed text."""
    spellings = {s: target for target, sources in (PAYMENT_MAP if mapping is None else mapping).items()
                 for s in [target.lower(), *sources]}
    s = py_strip(c)
    if not spellings:
        return s
    # The key is computed once, and looked up in one table.
    key = F.btrim(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]+", " "))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in spellings.items() for x in pair]), key), s)


def map_values(c: str | Column, mapping: dict[str, list[str]]) -> Column:
    """Exact replacement: any source spelling -> its target; others unchanged."""
    col = _c(c)
    out = None
    for target, sources in mapping.items():
        cond = col.isin(*sources)
        out = F.when(cond, F.lit(target)) if out is None else out.when(cond, F.lit(target))
    return out.otherwise(col) if out is not None else col


def standardise_city(c: str | Column) -> Column:
    """C7."""
    return map_values(c, CITY_MAP)


def standardise_bool_text(c: str | Column) -> Column:
    """C8: '0','No','False ','FALSE' -> 'False'; '1','Yes','True ','TRUE' -> 'True'."""
    return map_values(c, BOOL_TEXT_MAP)


def standardise_category(c: str | Column) -> Column:
    """C9."""
    return map_values(c, CATEGORY_MAP)


def normalise_delivery_days(days: str | Column, delivery_type: str | Column | None = None,
                            prime: str | Column | None = None,
                            mode: str = "observed") -> Column:
    """Delivery text -> whole days (see SURVEY §2.3.1).

    ``observed`` reproduces what the reference computes (its type test is
    always true, so type and prime status never matter). ``intended`` uses
    the three-way rule its code spells out: Same Day/Express, Standard for
    prime members, otherwise.
    """
    d = _c(days).cast("string")
    table = DELIVERY_TEXT_DAYS
    out = F.when(d.isin(*PLAIN_DELIVERY_DAYS), d.cast("int"))
    if mode == "observed":
        for text, (fast, _, _) in table.items():
            out = out.when(d == text, F.lit(fast))
        return out
    if mode != "intended":
        raise ValueError("mode must be 'observed' or 'intended'")
    if delivery_type is None or prime is None:
        raise ValueError("intended mode needs delivery_type and prime columns")
    t = _c(delivery_type)
    is_prime = F.lower(py_strip(prime)) == "true"
    fast_type = t.isin("Same Day", "Express")
    std_prime = (t == "Standard") & F.coalesce(is_prime, F.lit(False))
    for text, (fast, std, other) in table.items():
        out = out.when(d == text, F.when(fast_type, F.lit(fast))
                                   .when(std_prime, F.lit(std)).otherwise(F.lit(other)))
    return out


def coerce_numeric(c: str | Column) -> Column:
    """L3: text -> double the way ``pd.to_numeric(errors='coerce')`` reads it.

    Thousands separators are not accepted; '1e3' is 1000; inf/nan words are
    NULL here.
    """
    s = py_strip(c)
    return F.when(s.rlike(NUMBER_RE), s.cast("double"))


def coerce_boolean(c: str | Column, true_tokens: list[str] | None = None,
                   false_tokens: list[str] | None = None) -> Column:
    """L4: trimmed, lower-cased text in {true,1,yes} / {false,0,no}; else NULL.

    Token lists can be widened (e.g. 'y' / 'n'); give them in lower case.
    """
    s = F.lower(py_strip(c))
    t = true_tokens if true_tokens is not None else TRUE_TOKENS
    f = false_tokens if false_tokens is not None else FALSE_TOKENS
    return F.when(s.isin(*t), F.lit(True)).when(s.isin(*f), F.lit(False))


# Load-time order (L1): ISO first, then month-first like a free-form parser.
LOAD_DATE_FORMATS = ["Y-m-d", "Y/m/d", "Y.m.d", "m/d/Y", "m-d-Y", "m.d.Y",
                     "d/m/Y", "d-m-Y", "d.m.Y"]


#: The same with day before month.
DAY_FIRST_LOAD_FORMATS = [*LOAD_DATE_FORMATS[:3], *LOAD_DATE_FORMATS[6:], *LOAD_DATE_FORMATS[3:6]]

# Three numbers, the year of four digits first or last, perhaps with a time of day.
PLAIN_DATE_RE = (r"^(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})"
                 r"(?:\s+\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?)?$")


def coerce_date(c: str | Column) -> Column:
    """L1 as one expression: text (optionally with a time part) -> date, ISO
    then month-first, then with the month's name. The DataFrame step
    ``typing.load_dates`` reads dates in free form, and stages their parts."""
    s = py_strip(c)
    return F.coalesce(parse_date_formats(day_part(s), LOAD_DATE_FORMATS), in_date_range(named_month_date(s)))


def day_part(s: Column) -> Column:
    """The date of a text that may go on with a time of day; '' for other text."""
    return F.regexp_extract(s, r"^(\S+)(\s+\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?)?$", 1)


# Dates with the month in letters: '5 Jan 2020', '05-January-2020', 'Jan 5, 2020'.
DAY_FIRST_RE = r"^(\d{1,2})(?:st|nd|rd|th)?[\s,.-]+([A-Za-z]{3,9})\.?[\s,.-]+(\d{4})$"
MONTH_FIRST_RE = r"^([A-Za-z]{3,9})\.?[\s,.-]+(\d{1,2})(?:st|nd|rd|th)?[\s,.-]+(\d{4})$"
FULL_MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september",
               "october", "november", "december"]


def named_month_date(s: Column) -> Column:
    """Date text with the month's name or its first three letters; else NULL."""
    day_first = s.rlike(DAY_FIRST_RE)
    pattern = [(DAY_FIRST_RE, 1, 2), (MONTH_FIRST_RE, 2, 1)]
    (d1, m1), (d2, m2) = [(F.regexp_extract(s, r, d), F.regexp_extract(s, r, m)) for r, d, m in pattern]
    name = F.lower(F.when(day_first, m1).otherwise(m2))
    numbers = {n: i % 12 + 1 for i, n in enumerate([*MONTH_NAMES, *FULL_MONTHS])} | {"sept": 9}
    number = F.element_at(F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair]), name)
    day = F.when(day_first, d1).otherwise(d2).try_cast("int")
    year = F.regexp_extract(s, r"(\d{4})$", 1).try_cast("int")
    return F.when(number.isNotNull(), checked_date(year, number, day))
