"""Registered queries: name -> (spark, sf_dir) -> DataFrame over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaar.functions import parsing as P
from bazaar.functions.dates import date_shapes as date_shapes_of
from bazaar.operators import clean as C
from bazaar.operators import forecast as FC
from bazaar.operators import fuzzy as FZ
from bazaar.operators import profile as PR
from bazaar.operators import segments as SG
from bazaar.operators.cohort import with_first_sale
from bazaar.operators.typing import load_dates
from bazaar.plans.joins import attach_scalars
from bazaar.plans.reports import REPORTS
from bazaar.schema import AUDIT_COPIES, DEDUP_KEYS, WIDE_FALSE_TOKENS, WIDE_TRUE_TOKENS
from bazaar.session import TABLE_CODEC, scratch_path
from bazaar.sources import buckets, clusters, csv_io, gold, lake, quality, sinks
from bazaar.sources.fixtures import DIRTY_ORDER, dirty_sales, priced_sales, sales_columns
from bazaar.sources.tables import SALES_SOURCE_ORDER, fact_table, read_table
from bazaar.streaming import live_month as LM

Query = Callable[[SparkSession, str], DataFrame]

# Spellings that queries deal out over the rows (their oracles list them too).
PAYMENT_TEXT = [" UPI", "PhonePe", "google-pay", "CREDIT  card", "Credit_Card", "debit card", "C.O.D", "cash on delivery ",
                "Net-Banking", "PayTM", "emi", "Barter", "123", "Gift Voucher "]
RATING_TEXT = ["4 stars", "5 star", "3/5", "8/10", "3 out of 5", "4.5", "Five", "good", "bad", "11/10", "***", "7", "", "2.5 Stars"]
# Spellings of a date: patterns (True) and other text (False), joined.
FREE_DATE_FORMS = [
    [(True, "yyyy-MM-dd'T'HH:mm:ss")], [(True, "yyyy-MM-dd"), (False, "T10:00:00Z")], [(True, "yyyy-MM-dd"), (False, "T09:15:00.250+05:30")],
    [(True, "yyyyMMdd")], [(True, "yyyyMMdd"), (False, "T101500")], [(True, "M/d/yy")], [(True, "MMM yyyy")], [(True, "yyyy MMM d")],
    [(True, "EEEE, MMMM d, yyyy")], [(False, "10:00 AM")], [(True, "EEE d MMM yyyy"), (False, " 10:00 AM")], [(False, "23:59 "), (True, "MMMM d yyyy")],
    [(True, "dMMMyyyy")], [(True, "d"), (False, "th of "), (True, "MMMM yyyy")], [(True, "yyyy/MM")], [(True, "MM.yyyy")], [(True, "yyyy")],
    [(True, "d MMM yy")], [(True, "MM/dd/yyyy"), (False, " 7 pm")], [(True, "yyyy-MM-dd HH:mm"), (False, " UTC")],
    [(False, "25:00 "), (True, "d MMM yyyy")], [(True, "d MMM")], [(False, " "), (True, "yyyy.M.d"), (False, " ")], [(False, "Order "), (True, "yyyy")],
]
EDGE_SPACES = ["\u00a0", "\u2003", "\u3000 ", "\u2028", "\x1f", "\x85", " \t", ""]
EDGE_DIGITS = "".join(chr(0x0966 + i) for i in range(10))


def _over_sales(name: str) -> Query:
    fn = REPORTS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(fact_table(spark, sf_dir))

    run.__name__ = name
    return run


QUERIES: dict[str, Query] = {name: _over_sales(name) for name in REPORTS}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# ---- cleaning steps on the dirty view ---------------------------------------------

@query
def clean_dates(spark, sf_dir):
    """C1 + C2."""
    return C.clean_dates(dirty_sales(spark, sf_dir)).select("k", "order_date", "is_valid_date")


@query
def clean_prices(spark, sf_dir):
    """C4."""
    return C.clean_prices(dirty_sales(spark, sf_dir)).select("k", "original_price_inr")


@query
def clean_ratings(spark, sf_dir):
    """C5 + C6."""
    return C.clean_ratings(dirty_sales(spark, sf_dir)).select("k", "customer_rating")


@query
def clean_cities(spark, sf_dir):
    """C7."""
    return C.clean_cities(dirty_sales(spark, sf_dir)).select("k", "customer_city")


@query
def clean_booleans(spark, sf_dir):
    """C8, then L4 on its output."""
    df = C.clean_booleans(dirty_sales(spark, sf_dir))
    return df.select("k", "is_prime_member",
                     P.coerce_boolean("is_prime_member").alias("is_prime_member_bool"))


@query
def clean_categories(spark, sf_dir):
    """C9."""
    return C.clean_categories(dirty_sales(spark, sf_dir)).select("k", "category")


@query
def clean_delivery(spark, sf_dir):
    """C10, both modes."""
    d = dirty_sales(spark, sf_dir)
    return d.select(
        "k",
        P.normalise_delivery_days("delivery_days").alias("delivery_days"),
        P.normalise_delivery_days("delivery_days", "delivery_type",
                                  P.standardise_bool_text("is_prime_member"),
                                  mode="intended").alias("delivery_days_intended"))


@query
def dedup(spark, sf_dir):
    """C11 keep-first on the fact view in its source order."""
    out = C.dedup_keep_first(fact_table(spark, sf_dir), order=SALES_SOURCE_ORDER)
    return out.select(*SALES_SOURCE_ORDER, "customer_id", "product_name", "order_date")


@query
def iqr_bounds(spark, sf_dir):
    """C14 on the priced view."""
    b = C.iqr_bounds(priced_sales(spark, sf_dir))
    return b.select(*[F.round(c, 6).alias(c) for c in b.columns])


@query
def outlier_repair(spark, sf_dir):
    """C13..C17 on the priced view."""
    return C.repair_price_outliers(priced_sales(spark, sf_dir)).select("k", "original_price_inr")


@query
def fill_missing(spark, sf_dir):
    """C19..C21 on the dirty view."""
    return C.fill_missing(dirty_sales(spark, sf_dir)).select(
        "k", "delivery_charges", "customer_age_group", "festival_name")


@query
def derive_calendar(spark, sf_dir):
    """L2."""
    from bazaar.operators.typing import derive_calendar as L2
    return L2(fact_table(spark, sf_dir).drop("order_year")).select("k", "order_year", "order_month", "order_quarter")


@query
def coerce_numeric(spark, sf_dir):
    """L3 on raw text columns."""
    d = dirty_sales(spark, sf_dir)
    return d.select("k", P.coerce_numeric("original_price_inr").alias("price_num"),
                    P.coerce_numeric("delivery_days").alias("days_num"),
                    P.coerce_numeric("quantity").alias("quantity_num"))


@query
def value_counts(spark, sf_dir):
    """P5 on the raw city text."""
    return PR.value_counts(dirty_sales(spark, sf_dir), "customer_city")


@query
def nunique(spark, sf_dir):
    """P6."""
    return PR.nunique(dirty_sales(spark, sf_dir), "customer_city")


@query
def distinct_frequencies(spark, sf_dir):
    """P7 over product names of the fact view."""
    return PR.distinct_frequencies(fact_table(spark, sf_dir), "product_name")


@query
def column_info(spark, sf_dir):
    """P3 + P4 (non-missing counts per column) of the dirty view."""
    return PR.info(dirty_sales(spark, sf_dir)).select("column_name", "non_null", "total_rows")


@query
def union_years(spark, sf_dir):
    """Yearly slices with different column sets, stacked by name."""
    s = fact_table(spark, sf_dir).select("k", "order_date", "brand", "festival_name")
    early = s.where(F.year("order_date") < 1998)
    late = s.where(F.year("order_date") >= 1998).drop("brand")
    return csv_io.union_years([early, late]).select("k", "order_date", "brand", "festival_name")


@query
def clean_pipeline(spark, sf_dir):
    """C1..C21 end to end on the dirty view."""
    return C.clean_pipeline(dirty_sales(spark, sf_dir), DIRTY_ORDER)


# ---- README-advertised segments -------------------------------------

@query
def rfm(spark, sf_dir):
    """X1."""
    return SG.rfm(fact_table(spark, sf_dir))


@query
def payment_mix(spark, sf_dir):
    """X4."""
    return SG.payment_mix(fact_table(spark, sf_dir))


@query
def prime_value(spark, sf_dir):
    """X5."""
    return SG.prime_value(fact_table(spark, sf_dir))


@query
def prime_value_text(spark, sf_dir):
    """X5 over text flags in many spellings (the dirty view's, before C8)."""
    d = dirty_sales(spark, sf_dir)
    return SG.prime_value(d.withColumn("final_amount_inr", P.coerce_numeric("final_amount_inr")))


@query
def clean_payments(spark, sf_dir):
    """Spellings dealt out over the lines by ``k`` (a fixture of literals, as
    the tables hold no payment names), and the priority text, which stays."""
    f = fact_table(spark, sf_dir)
    text = F.element_at(F.array(*[F.lit(x) for x in PAYMENT_TEXT]), (F.col("k") % len(PAYMENT_TEXT) + 1).cast("int"))
    return f.select("k", P.standardise_payment(text).alias("payment_method"),
                    P.standardise_payment("payment_method").alias("unknown_method"))


@query
def clean_ratings_wide(spark, sf_dir):
    """The dirty view's ratings with the wider reading, and more spellings."""
    text = F.element_at(F.array(*[F.lit(x) for x in RATING_TEXT]), (F.col("k") % len(RATING_TEXT) + 1).cast("int"))
    return dirty_sales(spark, sf_dir).select(
        "k", P.parse_rating_wide("customer_rating").alias("customer_rating"),
        P.parse_rating_wide(text, {"five": 5, "good": 4}).alias("other_rating"),
        P.coerce_boolean("is_prime_member", WIDE_TRUE_TOKENS, WIDE_FALSE_TOKENS).alias("is_prime_member"))


def _misspelt(c, n):
    """Ways to misspell a text, one for each value of ``n`` up to 11."""
    cut = lambda a, k=1: F.concat(F.substring(c, F.lit(1), F.lit(a - 1)), F.substring(c, F.lit(a + k), F.length(c)))
    ways = [c, F.upper(c), F.lower(c), cut(3), F.concat(F.substring(c, 1, 1), F.substring(c, 3, 1), F.substring(c, 2, 1), F.substring(c, F.lit(4), F.length(c))),
            F.concat(F.substring(c, 1, 2), F.substring(c, F.lit(2), F.length(c))), F.concat(F.substring(c, F.lit(1), F.length(c) - 1), F.lit("x")),
            F.concat(F.lit("  "), c, F.lit(".")), cut(2, 2), F.regexp_replace(c, "(?i)a", "e"), F.concat(c, F.lit(" st")), F.lit("Atlantis")]
    return F.coalesce(*[F.when(n == i, w) for i, w in enumerate(ways)])


@query
def fuzzy_states(spark, sf_dir):
    """State names misspelt in ways dealt out by ``k``, repaired by the
    names of the nation table."""
    names = read_table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_name").alias("spelling"))
    f = fact_table(spark, sf_dir).select("k", "customer_state")
    f = f.withColumn("customer_state", _misspelt(F.col("customer_state"), F.col("k") % 12)).withColumn("text", F.col("customer_state"))
    return FZ.repair_names(f, "customer_state", names).select("k", "text", "customer_state")


@query
def fuzzy_products(spark, sf_dir):
    """C7, X3 by the nearest name: misspelt product names, and how far they are."""
    p = read_table(spark, sf_dir, "part").select("p_name", "p_partkey")
    values = p.select(_misspelt(F.col("p_name"), F.col("p_partkey") % 12).alias("value"))
    names = p.select(F.col("p_name").alias("name"), F.col("p_name").alias("spelling"))
    return FZ.match_names(values, names).select("value", "name", "edits", "score")


@query
def star_transactions(spark, sf_dir):
    """Transaction table."""
    return SG.star_tables(fact_table(spark, sf_dir), SALES_SOURCE_ORDER)["transactions"]


@query
def first_sale(spark, sf_dir):
    """Each line with the first sale date of its product."""
    f = fact_table(spark, sf_dir).select("k", "transaction_id", "line_no", "product_id", "order_date")
    return with_first_sale(f)


@query
def coerce_dates(spark, sf_dir):
    """L1 on the raw date text, and on dates with the month's name (made from ``k``)."""
    d = dirty_sales(spark, sf_dir).select("k", "order_date")
    day = F.date_add(F.lit("1999-11-25").cast("date"), (F.col("k") % 700).cast("int"))
    named = F.when(F.col("k") % 3 == 0, F.date_format(day, "d MMM yyyy")).when(
        F.col("k") % 3 == 1, F.date_format(day, "MMMM d, yyyy")).otherwise(F.date_format(day, "dd-MMM-yyyy"))
    return load_dates(load_dates(d.withColumn("named_date", named), "order_date"), "named_date")


@query
def coerce_dates_free(spark, sf_dir):
    """L1 in free form: the order date of every line, spelled in 24 ways (the
    spelling is dealt out by ``k``), read value by value, and read in the order
    that the whole column tells."""
    f = sales_columns(spark, sf_dir, "k", "order_date")
    n = F.col("k") % len(FREE_DATE_FORMS)
    text = F.coalesce(*[F.when(n == i, F.concat(*[F.date_format("order_date", p) if fmt else F.lit(p) for fmt, p in form]))
                        for i, form in enumerate(FREE_DATE_FORMS)])
    f = f.select("k", text.alias("free_date"), F.date_format("order_date", "d/M/yy").alias("short_date"))
    return load_dates(load_dates(f, "free_date"), "short_date", order="infer")


@query
def date_shapes(spark, sf_dir):
    """L1: the shapes of the dirty view's date text, and what tells their order."""
    return date_shapes_of(dirty_sales(spark, sf_dir), "order_date")


@query
def head_rows(spark, sf_dir):
    """The first rows in a stated order."""
    f = fact_table(spark, sf_dir).select(*SALES_SOURCE_ORDER, "product_name")
    return PR.head(f.orderBy(*SALES_SOURCE_ORDER), 25)


@query
def discount_levels(spark, sf_dir):
    """A13 over more than 50 discount levels."""
    f = fact_table(spark, sf_dir)
    return REPORTS["discount_response"](f.withColumn(
        "discount_percent", F.col("discount_percent") + (F.col("k") % 13) / F.lit(16.0)))


@query
def large_amounts(spark, sf_dir):
    """Money sums with amounts beyond the exact decimal's range (a literal
    for every 5000th ``k``)."""
    f = fact_table(spark, sf_dir)
    return REPORTS["revenue_by_year"](f.withColumn("final_amount_inr", F.when(
        F.col("k") % 5000 == 0, F.lit(2e14)).otherwise(F.round("quantity", 0).cast("double"))))


@query
def edge_text(spark, sf_dir):
    """C1, C4, L3 on text with whitespace and digits beyond ASCII (literals dealt
    out by ``k``)."""
    pad = F.element_at(F.array(*[F.lit(x) for x in EDGE_SPACES]), (F.col("k") % len(EDGE_SPACES) + 1).cast("int"))
    day = F.date_format(F.date_add(F.lit("2003-01-31").cast("date"), (F.col("k") % 900).cast("int")), "yyyy-MM-dd")
    whole = (F.col("k") % 100000).cast("string")
    f = fact_table(spark, sf_dir).select(
        "k", F.concat(pad, day, pad).alias("order_date"), F.concat(pad, whole, pad).alias("number"),
        F.when(F.col("k") % 2 == 0, F.translate(whole, "0123456789", EDGE_DIGITS)).otherwise(
            F.concat(F.lit("Rs "), whole)).alias("original_price_inr"))
    out = C.clean_prices(C.clean_dates(f))
    return out.select("k", "order_date", P.coerce_numeric("number").alias("number"), "original_price_inr")


@query
def top_states_20(spark, sf_dir):
    """K2 on the geographic page: 20 states."""
    return REPORTS["top_states"](fact_table(spark, sf_dir), n=20)


@query
def csv_ingest(spark, sf_dir):
    """S4, then S1/S2/S3/S6/S7: yearly CSV files with quotes, commas and
    padded headers, read back by header."""
    f = fact_table(spark, sf_dir).select(
        "k", F.concat(F.col("product_name"), F.lit(' 15.6"", "'), F.col("brand"), F.lit('", x')).alias("product_name"),
        F.when(F.col("k") % 7 == 0, "NA").when(F.col("k") % 11 == 0, " n ").otherwise(F.col("customer_state")).alias("customer_state"),
        F.year("order_date").alias("y"))
    paths = []
    for i, cols in enumerate((["k", "product_name", "customer_state"], ["customer_state", "k", "product_name"])):
        path = scratch_path(spark, f"csv-{uuid.uuid4().hex}")
        part = f.where((F.col("y") < 1998) if i == 0 else (F.col("y") >= 1998) | F.col("y").isNull())
        part = part.select(*cols)
        sinks.write_csv(part.toDF(*[f" {c} " for c in cols]), path)
        paths.append(path)
    read = csv_io.read_yearly_csv(spark, paths)
    return read.select(F.col("k").cast("long").alias("k"), "product_name", "customer_state",
                       F.col("_corrupt_row").isNotNull().alias("malformed"))


_GOLD: dict[tuple[str, str], str] = {}


def _gold(spark, sf_dir, grain="month"):
    """A gold table of the fact view, written once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _GOLD:
        _GOLD[key] = scratch_path(spark, f"gold-{uuid.uuid4().hex}")
        gold.write_gold(fact_table(spark, sf_dir), _GOLD[key])
    return gold.read_gold(spark, _GOLD[key], grain)


@query
def gold_revenue_by_year(spark, sf_dir):
    """S8, A5 from gold."""
    return gold.revenue_by_year(_gold(spark, sf_dir))


@query
def gold_month_monitor(spark, sf_dir):
    """S8, M1..M3 from gold."""
    return gold.month_monitor(_gold(spark, sf_dir))


@query
def gold_monthly_customers(spark, sf_dir):
    """S8, T3 from gold."""
    return gold.monthly_customers(_gold(spark, sf_dir))


@query
def gold_top_states(spark, sf_dir):
    """S8, K2 from gold, and whether each state's customers, estimated from
    sketches, are within 5 % of the exact number."""
    exact = fact_table(spark, sf_dir).groupBy("customer_state").agg(F.count_distinct("customer_id").alias("exact"))
    near = gold.ranked(_gold(spark, sf_dir, "state"), "customer_state").join(exact, "customer_state")
    ok = F.abs(F.col("customers_estimate") - F.col("exact")) <= F.greatest(F.lit(1.0), F.col("exact") * 0.05)
    return near.select("customer_state", "revenue", ok.alias("customers_near"))


@query
def dedup_increments(spark, sf_dir):
    """C11 over three loads (dealt by ``k``) through the key index: the rows
    that all loads together keep, and the load that each came with."""
    f = fact_table(spark, sf_dir).select("k", *SALES_SOURCE_ORDER, *DEDUP_KEYS).withColumn("order_date", F.trunc("order_date", "MM")) \
        .withColumn("customer_id", F.when(F.col("customer_id") % 50 > 0, F.col("customer_id")))
    index = lake.KeyIndex(spark, scratch_path(spark, f"index-{uuid.uuid4().hex}"), DEDUP_KEYS)
    for i in range(3):
        index.append(f.where(F.col("k") % 3 == i), i, SALES_SOURCE_ORDER)
    return index.rows().select("k", *SALES_SOURCE_ORDER, *DEDUP_KEYS, F.col("_load").alias("load"))


@query
def yearly_refresh(spark, sf_dir):
    """Yearly CSV files taken in through the ledger, the last year's
    after a first refresh; per year the silver rows (each key once), and
    whether the second refresh rewrote it."""
    f = sales_columns(spark, sf_dir, "k", "customer_id", "transaction_id", "product_name", "order_date", "final_amount_inr",
                      "quantity", "delivery_days", "customer_state", "order_year")
    home = scratch_path(spark, f"lake-{uuid.uuid4().hex}")
    lines = f.where("order_year is not null").select(
        "k", "customer_id", "transaction_id", "product_name", F.date_format("order_date", "yyyy-MM-dd").alias("order_date"),
        F.col("final_amount_inr").cast("string").alias("final_amount_inr"), F.col("quantity").cast("string").alias("quantity"),
        F.col("delivery_days").cast("string").alias("delivery_days"), "customer_state", F.col("order_year").alias("file_year"))
    last = F.col("file_year") == f.agg(F.max("order_year")).scalar()
    rewritten = []
    for part in (lines.where(~last), lines.where(last)):
        sinks.write_csv(part.drop("file_year"), f"{home}/in", mode="append")
        lake.take_in(spark, f"{home}/in", f"{home}/lake")
        rewritten = lake.refresh(spark, f"{home}/lake")
    silver = spark.read.parquet(f"{home}/lake/silver")
    return silver.groupBy("order_year").agg(F.count(F.lit(1)).alias("lines")).withColumn(
        "rewritten", F.col("order_year").isin(*[y for y in rewritten if y is not None]))


@query
def live_month_stream(spark, sf_dir):
    """M1..M3 of the live month from a stream of five files' worth of lines
    in no order, one of them sent twice."""
    home = scratch_path(spark, f"live-{uuid.uuid4().hex}")
    # The line's number alone is not its key in these tables.
    f = sales_columns(spark, sf_dir, "k", *SALES_SOURCE_ORDER, "customer_id", "order_date", "final_amount_inr") \
        .withColumn("line_no", F.xxhash64(*SALES_SOURCE_ORDER))
    lines = f.select("k", *[F.col(c.name).cast(c.dataType).alias(c.name) for c in LM.LIVE_LINE_SCHEMA.fields])
    for i in (3, 0, 4, 1, 3, 2):
        lines.where(F.col("k") % 5 == i).drop("k").write.mode("append").option("compression", TABLE_CODEC).parquet(f"{home}/in")
    stream = LM.read_order_stream(spark, f"{home}/in", LM.LIVE_LINE_SCHEMA, max_files_per_trigger=16)
    LM.start_live_lines(stream, f"{home}/out", f"{home}/checkpoint", until_done=True).awaitTermination()
    return LM.live_monitor(spark, f"{home}/out")


@query
def revenue_forecast(spark, sf_dir):
    """Growth forecast of T1's series: six months of revenue a category."""
    return FC.forecast(fact_table(spark, sf_dir), "category")


@query
def first_sale_bucketed(spark, sf_dir):
    """J1 on the fact table bucketed by product: no exchange."""
    name = f"b{uuid.uuid4().hex}"
    facts = buckets.bucketed_facts(spark, sf_dir, scratch_path(spark, name), 8, name)
    return with_first_sale(facts.select("k", "transaction_id", "line_no", "product_id", "order_date"))


@query
def silver_quality(spark, sf_dir):
    """P3, P4, C2 without a pass: figures of the cleaned dirty view, gathered
    while it is written."""
    rows = C.clean_prices(C.clean_dates(dirty_sales(spark, sf_dir))).select(
        "k", "order_date", "is_valid_date", "original_price_inr", "customer_city", "delivery_days")
    base = scratch_path(spark, f"quality-{uuid.uuid4().hex}")
    return quality.write_with_quality(rows, f"{base}/silver", f"{base}/quality", {
        "invalid_dates": ~F.col("is_valid_date"), "prices_above_1000": F.col("original_price_inr") > 1000})


@query
def audit_copies(spark, sf_dir):
    """The raw text kept beside what C1..C10 make of it, on the dirty view."""
    out = C.standardise(dirty_sales(spark, sf_dir), audit=True)
    return out.select("k", *AUDIT_COPIES.values(), "is_valid_date", "original_price_inr")


@query
def table_shape(spark, sf_dir):
    """The dirty view's column names in order, with its rows and columns."""
    d = dirty_sales(spark, sf_dir)
    names = spark.createDataFrame(list(enumerate(PR.columns(d))), "position int, column_name string")
    return attach_scalars(names, PR.shape(d))


@query
def gold_median_delivery(spark, sf_dir):
    """A14 from merged sketches: per state, whether the share of lines below
    and up to the estimated median leaves it within 3 % of the middle."""
    near = gold.median_delivery(_gold(spark, sf_dir, "state"))
    f = fact_table(spark, sf_dir).select("customer_state", "delivery_days")
    rank = f.join(near, "customer_state").groupBy("customer_state").agg(
        F.avg((F.col("delivery_days") < F.col("median_delivery_days")).cast("int")).alias("below"),
        F.avg((F.col("delivery_days") <= F.col("median_delivery_days")).cast("int")).alias("up_to"))
    return rank.select("customer_state", ((F.col("below") <= 0.53) & (F.col("up_to") >= 0.47)).alias("median_near"))


@query
def top_products_clustered(spark, sf_dir):
    """F3, K3 over files clustered by subcategory and date."""
    path = scratch_path(spark, f"clustered-{uuid.uuid4().hex}")
    clusters.write_clustered(fact_table(spark, sf_dir), path, ["subcategory", "order_date"], files=8)
    return REPORTS["top_products_in_subcategory"](spark.read.parquet(path))


@query
def star_products(spark, sf_dir):
    """Product dimension."""
    return SG.star_tables(fact_table(spark, sf_dir), SALES_SOURCE_ORDER)["products"]


@query
def star_customers(spark, sf_dir):
    """Customer dimension."""
    return SG.star_tables(fact_table(spark, sf_dir), SALES_SOURCE_ORDER)["customers"]


@query
def star_time_dimension(spark, sf_dir):
    """Time dimension."""
    return SG.star_tables(fact_table(spark, sf_dir), SALES_SOURCE_ORDER)["time_dimension"]
