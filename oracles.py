"""DuckDB SQL for every registered query (the correctness oracle).

Written independently of the Spark code: plain SQL over the driver's
tables, with the fact view of FIXTURES.md inlined as a CTE.
"""

from __future__ import annotations

SALES_SQL = """
SELECT l.l_orderkey AS transaction_id, l.l_linenumber AS line_no, l.l_suppkey AS supplier_id,
  l.l_extendedprice AS line_price, l.l_orderkey * 31 + l.l_partkey * 7 + l.l_linenumber AS k,
  o.o_custkey AS customer_id, l.l_partkey AS product_id, p.p_name AS product_name,
  c.c_mktsegment AS category, p.p_type AS subcategory, p.p_brand AS brand,
  n.n_name AS customer_state, CAST(o.o_orderdate AS DATE) AS order_date,
  p.p_retailprice AS original_price_inr, l.l_quantity AS quantity,
  round(l.l_discount * 100, 0) AS discount_percent,
  CAST(l.l_extendedprice * (1 - l.l_discount) AS DECIMAL(18,4)) AS final_amount_inr,
  o.o_orderpriority AS payment_method,
  month(o.o_orderdate) IN (10, 11) AS is_festival_sale,
  CASE month(o.o_orderdate) WHEN 10 THEN 'Festival A' WHEN 11 THEN 'Festival B'
       ELSE 'Normal Day' END AS festival_name,
  o.o_custkey % 3 = 0 AS is_prime_member, l.l_returnflag = 'R' AS return_status,
  CAST((l.l_orderkey * 7 + l.l_linenumber) % 8 AS INT) AS delivery_days,
  1 + (l.l_orderkey % 9) * CAST(0.5 AS DOUBLE) AS customer_rating,
  1 + (l.l_partkey % 9) * CAST(0.5 AS DOUBLE) AS product_rating
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN part p ON l.l_partkey = p.p_partkey
"""


def msum(x: str) -> str:
    """Money sum: exact decimal, then double rounded to 4 places; empty -> 0."""
    return f"COALESCE(round(CAST(SUM(CAST({x} AS DECIMAL(18,4))) AS DOUBLE), 4), 0.0)"


def nsum(x: str) -> str:
    return f"COALESCE(CAST(SUM({x}) AS DOUBLE), 0.0)"


def with_sales(body: str, *ctes: str) -> str:
    extra = "".join(f",\n{c}" for c in ctes)
    return f"WITH sales AS ({SALES_SQL}){extra}\n{body}"


REV = msum("final_amount_inr")

YEARS_CTE = f"""years AS (
  SELECT CAST(year(order_date) AS INTEGER) AS order_year, {REV} AS revenue
  FROM sales WHERE order_date IS NOT NULL GROUP BY 1)"""

YOY_CTE = """yoy AS (
  SELECT max(order_year) AS last_year, max(revenue) AS last_revenue,
         max(prev_year) AS prev_year, max(prev_revenue) AS prev_revenue,
         max(CASE WHEN prev_revenue <> 0 THEN round((revenue - prev_revenue) / prev_revenue, 6) END)
           AS yoy_growth
  FROM (SELECT order_year, revenue,
               lag(order_year) OVER (ORDER BY order_year) AS prev_year,
               lag(revenue) OVER (ORDER BY order_year) AS prev_revenue,
               lead(order_year) OVER (ORDER BY order_year) IS NULL AS is_last
        FROM years) r
  WHERE is_last)"""

KPI_CTE = f"""kpi AS (
  SELECT b.total_revenue, b.active_customers, b.orders,
         COALESCE(round(b.total_revenue / NULLIF(b.orders, 0), 6), 0.0) AS aov, yoy.yoy_growth
  FROM (SELECT {REV} AS total_revenue, count(DISTINCT customer_id) AS active_customers,
               count(DISTINCT transaction_id) AS orders FROM sales) b, yoy)"""


def top_by(key: str, n: int) -> str:
    return with_sales(
        f"SELECT {key}, {REV} AS revenue FROM sales WHERE {key} IS NOT NULL GROUP BY 1 "
        f"ORDER BY revenue DESC NULLS LAST, {key} LIMIT {n}")


FREQ = {"month": ("month", 1), "quarter": ("quarter", 3), "year": ("year", 12)}


def series_cte(freq: str, src: str = "sales", name: str = "series") -> str:
    unit, step = FREQ[freq]
    return f"""per AS (
  SELECT CAST(date_trunc('{unit}', order_date) AS DATE) AS p, {REV} AS revenue
  FROM {src} WHERE order_date IS NOT NULL GROUP BY 1),
spine AS (
  SELECT CAST(unnest(generate_series(min(p), max(p), INTERVAL {step} MONTH)) AS DATE) AS p
  FROM per HAVING min(p) IS NOT NULL),
{name} AS (
  SELECT CAST(spine.p + INTERVAL {step} MONTH - INTERVAL 1 DAY AS DATE) AS period_end,
         COALESCE(per.revenue, 0.0) AS revenue
  FROM spine LEFT JOIN per USING (p))"""


MONTH_CTE = """mx AS (SELECT max(order_date) AS latest FROM sales),
cur AS (
  SELECT s.* FROM sales s, mx
  WHERE s.order_date >= CAST(date_trunc('month', mx.latest) AS DATE)
    AND s.order_date < CAST(date_trunc('month', mx.latest) + INTERVAL 1 MONTH AS DATE))"""

MONITOR_CTE = f"""mon AS (
  SELECT b.revenue, b.new_customers, b.orders, mx.latest AS latest_date,
         strftime(mx.latest, '%b %Y') AS month_label,
         CAST(trunc(b.revenue * 1.1) AS BIGINT) AS rev_target,
         CAST(1000 AS BIGINT) AS cust_target,
         round(b.revenue - CAST(trunc(b.revenue * 1.1) AS BIGINT), 4) AS revenue_delta,
         b.new_customers - CAST(1000 AS BIGINT) AS customers_delta,
         round(b.revenue / CAST(dayofmonth(mx.latest) AS DOUBLE) * dayofmonth(last_day(mx.latest)), 4)
           AS run_rate
  FROM (SELECT {REV} AS revenue, count(DISTINCT customer_id) AS new_customers,
               count(DISTINCT transaction_id) AS orders FROM cur) b, mx)"""


def _analytics() -> dict[str, str]:
    q: dict[str, str] = {}
    q["revenue_by_year"] = with_sales("SELECT * FROM years", YEARS_CTE)
    q["yoy_growth"] = with_sales("SELECT * FROM yoy", YEARS_CTE, YOY_CTE)
    q["kpi_bundle"] = with_sales("SELECT * FROM kpi", YEARS_CTE, YOY_CTE, KPI_CTE)
    q["command_center"] = with_sales(
        "SELECT total_revenue, active_customers, yoy_growth, "
        "CASE WHEN yoy_growth IS NOT NULL AND yoy_growth < 0 THEN 'alert' ELSE 'ok' END AS status "
        "FROM kpi", YEARS_CTE, YOY_CTE, KPI_CTE)
    q["subcategory_share"] = with_sales(
        "SELECT subcategory, revenue, round(revenue / NULLIF(sum(revenue) OVER (), 0), 6) AS share "
        "FROM r", f"r AS (SELECT subcategory, {REV} AS revenue FROM sales "
                  "WHERE subcategory IS NOT NULL GROUP BY 1)")
    pq = "CAST(original_price_inr AS DECIMAL(18,4)) * CAST(quantity AS DECIMAL(18,4))"
    fin = "CAST(final_amount_inr AS DECIMAL(18,4))"
    dt = "COALESCE(round(CAST(SUM({}) AS DOUBLE), 4), 0.0)"
    q["profit_margin"] = with_sales(
        "SELECT subcategory, revenue, assumed_cost, profit, "
        "round(profit / NULLIF(revenue, 0), 6) AS margin_pct FROM ("
        "  SELECT subcategory, revenue, round(_pq * 70.0 / 100.0, 4) AS assumed_cost,"
        "         round(_fin_both - _pq_both * 70.0 / 100.0, 4) AS profit FROM a) t "
        "ORDER BY revenue DESC NULLS LAST, subcategory LIMIT 20",
        f"a AS (SELECT subcategory, {REV} AS revenue, {dt.format(pq)} AS _pq, "
        f"{dt.format(f'CASE WHEN {pq} IS NOT NULL THEN {fin} END')} AS _fin_both, "
        f"{dt.format(f'CASE WHEN {fin} IS NOT NULL THEN {pq} END')} AS _pq_both "
        "FROM sales WHERE subcategory IS NOT NULL GROUP BY 1)")
    q["subcategory_year"] = with_sales(
        f"SELECT subcategory, CAST(year(order_date) AS INTEGER) AS order_year, {REV} AS revenue "
        "FROM sales WHERE subcategory IS NOT NULL AND order_date IS NOT NULL GROUP BY 1, 2")
    q["subcategory_list"] = with_sales(
        "SELECT DISTINCT subcategory FROM sales WHERE subcategory IS NOT NULL")
    q["festival_revenue"] = with_sales(
        f"SELECT festival_name, {REV} AS revenue FROM sales "
        "WHERE is_festival_sale = TRUE AND festival_name IS NOT NULL GROUP BY 1")
    q["discount_response"] = with_sales(
        f"SELECT discount_percent, {nsum('quantity')} AS quantity, {REV} AS revenue FROM sales "
        "WHERE discount_percent IS NOT NULL GROUP BY 1")
    q["median_delivery_by_state"] = with_sales(
        "SELECT customer_state, round(quantile_cont(CAST(delivery_days AS DOUBLE), 0.5), 6) "
        "AS median_delivery_days FROM sales WHERE customer_state IS NOT NULL GROUP BY 1 "
        "ORDER BY median_delivery_days ASC NULLS LAST, customer_state LIMIT 30")
    q["payment_summary"] = with_sales(
        f"SELECT payment_method, count(DISTINCT transaction_id) AS orders, {REV} AS revenue "
        "FROM sales WHERE payment_method IS NOT NULL GROUP BY 1")
    q["avg_rating_delivery"] = with_sales(
        "SELECT round(avg(customer_rating), 6) AS avg_customer_rating, "
        "round(avg(delivery_days), 6) AS avg_delivery_days FROM sales")
    q["return_rate"] = with_sales(
        "SELECT orders, returns, active_skus, round(returns / NULLIF(orders, 0), 6) AS return_rate "
        "FROM (SELECT count(DISTINCT transaction_id) AS orders, "
        "count(*) FILTER (WHERE return_status = TRUE) AS returns, "
        "count(DISTINCT product_id) AS active_skus FROM sales) t")
    q["first_last_dates"] = with_sales(
        "SELECT min(order_date) AS first_date, max(order_date) AS last_date FROM sales")
    q["top_subcategories"] = top_by("subcategory", 5)
    q["top_states"] = top_by("customer_state", 10)
    q["top_brands"] = top_by("brand", 30)
    q["top_products_in_subcategory"] = with_sales(
        f"SELECT product_id, {REV} AS revenue, {nsum('quantity')} AS quantity FROM sales "
        "WHERE subcategory = (SELECT min(subcategory) FROM sales) AND product_id IS NOT NULL "
        "GROUP BY 1 ORDER BY revenue DESC NULLS LAST, product_id LIMIT 50")
    q["top_products"] = with_sales(
        f"SELECT product_id, product_name, {REV} AS revenue, {nsum('quantity')} AS quantity "
        "FROM sales WHERE product_id IS NOT NULL AND product_name IS NOT NULL GROUP BY 1, 2 "
        "ORDER BY revenue DESC NULLS LAST, product_id, product_name LIMIT 200")
    q["inventory_by_quantity"] = with_sales(
        f"SELECT product_id, {nsum('quantity')} AS quantity, {REV} AS revenue FROM sales "
        "WHERE product_id IS NOT NULL GROUP BY 1 "
        "ORDER BY quantity DESC NULLS LAST, product_id LIMIT 200")
    # Straight join of every fact row with its product's first sale (no pre-aggregation).
    q["launch_performance"] = with_sales(
        f"SELECT s.product_id, {msum('s.final_amount_inr')} AS revenue, "
        f"{nsum('s.quantity')} AS quantity FROM sales s LEFT JOIN f USING (product_id) "
        "WHERE s.product_id IS NOT NULL AND datediff('day', f.first_sale_date, s.order_date) <= 90 "
        "GROUP BY 1 ORDER BY revenue DESC NULLS LAST, product_id LIMIT 200",
        "f AS (SELECT product_id, min(order_date) AS first_sale_date FROM sales "
        "WHERE product_id IS NOT NULL GROUP BY 1)")
    for freq in ("month", "quarter", "year"):
        name = {"month": "revenue_monthly", "quarter": "revenue_quarterly",
                "year": "revenue_yearly"}[freq]
        q[name] = with_sales("SELECT * FROM series", series_cte(freq))
    q["revenue_rolling12"] = with_sales(
        "SELECT period_end, revenue, round(avg(revenue) OVER (ORDER BY period_end "
        "ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), 6) AS rolling12 FROM series",
        series_cte("month"))
    q["revenue_last12"] = with_sales(
        "SELECT * FROM series",
        "recent AS (SELECT * FROM sales WHERE order_date >= (SELECT CAST(date_trunc('month', "
        "max(order_date)) - INTERVAL 11 MONTH AS DATE) FROM sales))",
        series_cte("month", src="recent"))
    q["seasonality"] = with_sales(
        "SELECT CAST(month(period_end) AS INTEGER) AS month, round(avg(revenue), 6) AS avg_revenue "
        "FROM series GROUP BY 1", series_cte("month"))
    mc = ("SELECT CAST(date_trunc('month', order_date) AS DATE) AS month_start, "
          "count(DISTINCT {c}) AS {a} FROM sales WHERE order_date IS NOT NULL GROUP BY 1")
    q["monthly_customers"] = with_sales(mc.format(c="customer_id", a="customers"))
    q["monthly_skus"] = with_sales(mc.format(c="product_id", a="skus"))
    q["cumulative_customers"] = with_sales(
        "SELECT month_start, customers, CAST(sum(customers) OVER (ORDER BY month_start "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cumulative FROM m",
        "m AS (" + mc.format(c="customer_id", a="customers") + ")")
    q["churn_proxy"] = with_sales(
        "SELECT count(*) AS customers, round(avg(CASE WHEN datediff('day', last_order, "
        "(SELECT max(order_date) FROM sales)) > 90 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) "
        "AS churn_proxy FROM l",
        "l AS (SELECT customer_id, max(order_date) AS last_order FROM sales "
        "WHERE customer_id IS NOT NULL GROUP BY 1)")
    q["month_monitor"] = with_sales("SELECT * FROM mon", MONTH_CTE, MONITOR_CTE)
    q["month_alerts"] = with_sales(
        "SELECT 'revenue' AS kpi, CAST(rev_target AS DOUBLE) AS target, revenue AS actual, "
        "round(rev_target - revenue, 4) AS shortfall FROM mon "
        "WHERE rev_target > 0 AND revenue < rev_target "
        "UNION ALL SELECT 'new_customers', CAST(cust_target AS DOUBLE), "
        "CAST(new_customers AS DOUBLE), CAST(cust_target - new_customers AS DOUBLE) FROM mon "
        "WHERE cust_target > 0 AND new_customers < cust_target", MONTH_CTE, MONITOR_CTE)
    q["month_operations"] = with_sales(
        "SELECT round(avg(delivery_days), 6) AS avg_delivery_days, "
        "round(avg(customer_rating), 6) AS avg_customer_rating FROM cur", MONTH_CTE)
    return q


# ---- cleaning oracles -----------------------------------------------------------

WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
NUM_RE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def d_strip(c: str) -> str:
    return f"trim(CAST({c} AS STRING), {WS})"


def d_date(c: str) -> str:
    """Nine formats in order; guard regex; strptime; pandas timestamp range."""
    fmts = [("Y", "m", "d"), ("d", "m", "Y"), ("m", "d", "Y")]
    parts = []
    s = d_strip(c)
    for sep in ("-", "/", "."):
        rsep = "\\." if sep == "." else sep
        for f in fmts:
            guard = "^" + rsep.join(r"\d{4}" if x == "Y" else r"\d{1,2}" for x in f) + "$"
            fmt = sep.join("%" + x for x in f)
            parts.append(f"CASE WHEN regexp_matches({s}, '{guard}') "
                         f"THEN CAST(try_strptime({s}, '{fmt}') AS DATE) END")
    d = "COALESCE(" + ", ".join(parts) + ")"
    return f"CASE WHEN {d} BETWEEN DATE '1677-09-22' AND DATE '2262-04-11' THEN {d} END"


def d_price(c: str) -> str:
    return f"TRY_CAST(regexp_replace(CAST({c} AS STRING), '[^0-9.]', '', 'g') AS DOUBLE)"


def d_num(c: str) -> str:
    s = d_strip(c)
    return f"CASE WHEN regexp_matches({s}, '{NUM_RE}') THEN TRY_CAST({s} AS DOUBLE) END"


def d_rating(c: str, fallback: str) -> str:
    s3 = f"trim(substr(trim(replace(CAST({c} AS STRING), '/5', ''), {WS}), 1, 3), {WS})"
    return (f"COALESCE(CASE WHEN regexp_matches({s3}, '{NUM_RE}') THEN TRY_CAST({s3} AS DOUBLE) END, "
            f"CAST({fallback} AS DOUBLE))")


def d_map(c: str, mapping: dict[str, list[str]]) -> str:
    arms = " ".join(f"WHEN {c} IN ({', '.join(repr(v) for v in vs)}) THEN '{t}'"
                    for t, vs in mapping.items())
    return f"CASE {arms} ELSE {c} END"


# ---- Fixed values: these must equal the reference behaviour for equal results. ----
CITY = {"Delhi": ["DELHI", "Delhi NCR", "delhi", "New Delhi"],
        "Kolkata": ["Kolkata ", "KOLKATA", "Calcutta", "kolkata"],
        "Chennai": ["Madras", "Chennai ", "chenai", "CHENNAI"],
        "Mumbai": ["Mumbai ", "MUMBAI", "mumba", "Bombay"],
        "Bangalore": ["Bengaluru", "BANGALORE", "Bengalore", "Banglore"]}
BOOLTXT = {"False": ["0", "No", "False ", "FALSE"], "True": ["1", "Yes", "True ", "TRUE"]}
CATEGORY = {"Electronics": ["Electronic", "ELECTRONICS", "Electronics & Accessories",
                            "Electronicss"]}


def d_delivery(days: str, dtype: str | None = None, prime: str | None = None) -> str:
    d = f"CAST({days} AS STRING)"
    table = {"-1": (0, 1, 2), "1-2 days": (1, 2, 3), "Express": (0, 1, 2),
             "Same Day": (0, 1, 2), "15": (1, 3, 5)}
    arms = [f"WHEN {d} IN ('0','1','2','3','4','5','6','7') THEN CAST({d} AS INTEGER)"]
    for text, (fast, std, other) in table.items():
        if dtype is None:
            arms.append(f"WHEN {d} = '{text}' THEN {fast}")
        else:
            arms.append(f"WHEN {d} = '{text}' THEN CASE WHEN {dtype} IN ('Same Day', 'Express') "
                        f"THEN {fast} WHEN {dtype} = 'Standard' AND COALESCE(lower({d_strip(prime)}) "
                        f"= 'true', FALSE) THEN {std} ELSE {other} END")
    return "CAST(CASE " + " ".join(arms) + " END AS INTEGER)"


def d_bool(c: str) -> str:
    s = f"lower({d_strip(c)})"
    return (f"CASE WHEN {s} IN ('true','1','yes') THEN TRUE "
            f"WHEN {s} IN ('false','0','no') THEN FALSE END")


def with_dirty(body: str, *ctes: str) -> str:
    from bazaar.sources.fixtures import dirty_sql
    return with_sales(body, f"dirty AS ({dirty_sql('duckdb')})", *ctes)


def with_priced(body: str, *ctes: str) -> str:
    from bazaar.sources.fixtures import priced_sql
    return with_sales(body, f"priced AS ({priced_sql('duckdb')})", *ctes)


def bounds_cte(name: str, src: str, col: str = "original_price_inr") -> str:
    return (f"{name} AS (SELECT q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower, "
            f"q3 + 1.5 * (q3 - q1) AS upper FROM (SELECT quantile_cont({col}, 0.25) AS q1, "
            f"quantile_cont({col}, 0.75) AS q3 FROM {src}) t)")


def repair_ctes(src: str) -> list[str]:
    """C13..C17 over ``src`` (needs original_price_inr, final_amount_inr, quantity)."""
    p, e = "original_price_inr", "expected_price"
    ratio = f"round_even({p} / {e} * 100, 0) / 100"
    fixed = (f"CASE WHEN ({p} < b1.lower OR {p} > b1.upper) AND {e} IS NOT NULL AND {e} <> 0 "
             f"AND NOT isnan({e}) THEN CASE WHEN {ratio} = 10 THEN {p} / 10 "
             f"WHEN {ratio} = 100 THEN {p} / 100 WHEN {ratio} = 1000 THEN {p} / 1000 "
             f"ELSE {p} END ELSE {p} END")
    return [
        f"ex AS (SELECT *, CAST(final_amount_inr AS DOUBLE) / NULLIF(CAST(quantity AS DOUBLE), 0) "
        f"AS expected_price FROM {src})",
        bounds_cte("b1", "ex"),
        f"fx AS (SELECT ex.* REPLACE ({fixed} AS {p}) FROM ex, b1)",
        bounds_cte("b2", "fx"),
        f"kept AS (SELECT fx.* FROM fx, b2 WHERE {p} BETWEEN b2.lower AND b2.upper)",
    ]


def _cleaning() -> dict[str, str]:
    q: dict[str, str] = {}
    dt = d_date("order_date")
    q["clean_dates"] = with_dirty(
        f"SELECT k, {dt} AS order_date, ({dt}) IS NOT NULL AS is_valid_date FROM dirty")
    q["clean_prices"] = with_dirty(
        f"SELECT k, {d_price('original_price_inr')} AS original_price_inr FROM dirty")
    q["clean_ratings"] = with_dirty(
        f"SELECT k, {d_rating('customer_rating', 'product_rating')} AS customer_rating FROM dirty")
    q["clean_cities"] = with_dirty(f"SELECT k, {d_map('customer_city', CITY)} AS customer_city FROM dirty")
    c8 = d_map("is_prime_member", BOOLTXT)
    q["clean_booleans"] = with_dirty(
        f"SELECT k, {c8} AS is_prime_member, {d_bool(c8)} AS is_prime_member_bool FROM dirty")
    q["clean_categories"] = with_dirty(f"SELECT k, {d_map('category', CATEGORY)} AS category FROM dirty")
    q["clean_delivery"] = with_dirty(
        f"SELECT k, {d_delivery('delivery_days')} AS delivery_days, "
        f"{d_delivery('delivery_days', 'delivery_type', c8)} AS delivery_days_intended FROM dirty")
    order = "transaction_id, line_no, product_id, supplier_id, line_price"
    q["dedup"] = with_sales(
        f"SELECT {order}, customer_id, product_name, order_date FROM ("
        f"SELECT *, row_number() OVER (PARTITION BY customer_id, product_name, order_date "
        f"ORDER BY {order}) AS rn FROM sales) t WHERE rn = 1")
    q["iqr_bounds"] = with_priced(
        "SELECT round(q1, 6) AS q1, round(q3, 6) AS q3, round(iqr, 6) AS iqr, "
        "round(lower, 6) AS lower, round(upper, 6) AS upper FROM b", bounds_cte("b", "priced"))
    q["outlier_repair"] = with_priced("SELECT k, original_price_inr FROM kept", *repair_ctes("priced"))
    mode = ("(SELECT customer_age_group FROM {src} WHERE customer_age_group IS NOT NULL "
            "GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)")
    q["fill_missing"] = with_dirty(
        "SELECT k, COALESCE(CAST(delivery_charges AS DOUBLE), 0.0) AS delivery_charges, "
        f"COALESCE(customer_age_group, {mode.format(src='dirty')}) AS customer_age_group, "
        "COALESCE(festival_name, 'Normal Day') AS festival_name FROM dirty")
    q["derive_calendar"] = with_sales(
        "SELECT k, CAST(year(order_date) AS INTEGER) AS order_year, "
        "CAST(month(order_date) AS INTEGER) AS order_month, "
        "CAST(year(order_date) AS STRING) || 'Q' || CAST(quarter(order_date) AS STRING) "
        "AS order_quarter FROM sales")
    q["coerce_numeric"] = with_dirty(
        f"SELECT k, {d_num('original_price_inr')} AS price_num, {d_num('delivery_days')} AS days_num, "
        f"{d_num('quantity')} AS quantity_num FROM dirty")
    q["value_counts"] = with_dirty(
        "SELECT customer_city, count(*) AS count FROM dirty WHERE customer_city IS NOT NULL "
        "GROUP BY 1")
    q["nunique"] = with_dirty("SELECT count(DISTINCT customer_city) AS nunique FROM dirty")
    q["distinct_frequencies"] = with_sales(
        "SELECT count(DISTINCT n) AS distinct_frequencies FROM (SELECT product_name, count(*) AS n "
        "FROM sales WHERE product_name IS NOT NULL GROUP BY 1) t")
    cols = ["k", "transaction_id", "line_no", "product_id", "supplier_id", "line_price",
            "customer_id", "product_name", "product_rating", "final_amount_inr", "quantity",
            "order_date", "original_price_inr", "customer_rating", "delivery_days",
            "delivery_type", "is_prime_member", "customer_city", "category",
            "customer_age_group", "delivery_charges", "festival_name"]
    q["column_info"] = with_dirty(" UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS non_null, count(*) AS total_rows FROM dirty"
        for c in cols))
    q["union_years"] = with_sales(
        "SELECT k, order_date, brand, festival_name FROM sales WHERE year(order_date) < 1998 "
        "UNION ALL SELECT k, order_date, NULL AS brand, festival_name FROM sales "
        "WHERE year(order_date) >= 1998")
    std = (f"SELECT k, transaction_id, line_no, product_id, supplier_id, line_price, customer_id, "
           f"product_name, product_rating, {d_num('final_amount_inr')} AS final_amount_inr, "
           f"{d_num('quantity')} AS quantity, {dt} AS order_date, "
           f"{d_price('original_price_inr')} AS original_price_inr, "
           f"{d_rating('customer_rating', 'product_rating')} AS customer_rating, "
           f"{d_delivery('delivery_days')} AS delivery_days, delivery_type, "
           f"{c8} AS is_prime_member, {d_map('customer_city', CITY)} AS customer_city, "
           f"{d_map('category', CATEGORY)} AS category, customer_age_group, "
           f"CAST(delivery_charges AS DOUBLE) AS delivery_charges, festival_name FROM dirty")
    dd = (f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY customer_id, "
          f"product_name, order_date ORDER BY {order}) AS rn FROM std) t WHERE rn = 1")
    out = ", ".join(
        "COALESCE(delivery_charges, 0.0) AS delivery_charges" if c == "delivery_charges" else
        f"COALESCE(customer_age_group, {mode.format(src='kept')}) AS customer_age_group"
        if c == "customer_age_group" else
        "COALESCE(festival_name, 'Normal Day') AS festival_name" if c == "festival_name" else c
        for c in cols)
    q["clean_pipeline"] = with_dirty(
        f"SELECT {out} FROM kept", f"std AS ({std})", f"dd AS ({dd})", *repair_ctes("dd"))
    return q


def _segments() -> dict[str, str]:
    q: dict[str, str] = {}
    probs = "[0.2, 0.4, 0.6, 0.8]"

    def score(v: str, cut: str, reverse: bool = False) -> str:
        s = "1 + " + " + ".join(f"CASE WHEN {v} > {cut}[{i}] THEN 1 ELSE 0 END" for i in range(1, 5))
        return f"CAST({'6 - (' + s + ')' if reverse else s} AS INTEGER)"

    q["rfm"] = with_sales(
        f"SELECT customer_id, recency_days, frequency, monetary, "
        f"{score('recency_days', 'rc', True)} AS r_score, {score('frequency', 'fc')} AS f_score, "
        f"{score('monetary', 'mc')} AS m_score FROM per, cuts",
        "per AS (SELECT customer_id, CAST(datediff('day', max(order_date), "
        "(SELECT max(order_date) FROM sales)) AS INTEGER) AS recency_days, "
        f"count(DISTINCT transaction_id) AS frequency, {REV} AS monetary FROM sales "
        "WHERE customer_id IS NOT NULL GROUP BY 1)",
        f"cuts AS (SELECT quantile_cont(CAST(recency_days AS DOUBLE), {probs}) AS rc, "
        f"quantile_cont(CAST(frequency AS DOUBLE), {probs}) AS fc, "
        f"quantile_cont(CAST(monetary AS DOUBLE), {probs}) AS mc FROM per)")
    q["payment_mix"] = with_sales(
        "SELECT order_year, payment_method, revenue, round(revenue / NULLIF(sum(revenue) "
        "OVER (PARTITION BY order_year), 0), 6) AS share FROM per",
        f"per AS (SELECT CAST(year(order_date) AS INTEGER) AS order_year, payment_method, "
        f"{REV} AS revenue FROM sales WHERE order_date IS NOT NULL AND payment_method IS NOT NULL "
        "GROUP BY 1, 2)")
    q["prime_value"] = with_sales(
        "SELECT is_prime, customers, orders, revenue, round(revenue / NULLIF(orders, 0), 6) AS aov "
        f"FROM (SELECT COALESCE(is_prime_member, FALSE) AS is_prime, "
        f"count(DISTINCT customer_id) AS customers, count(DISTINCT transaction_id) AS orders, "
        f"{REV} AS revenue FROM sales WHERE is_prime_member IS NOT NULL GROUP BY 1) t")
    order = "transaction_id, line_no, product_id, supplier_id, line_price"

    def first_per(key: str, cols: str) -> str:
        return with_sales(
            f"SELECT {key}, {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {key} "
            f"ORDER BY {order}) AS rn FROM sales WHERE {key} IS NOT NULL) t WHERE rn = 1")

    q["star_products"] = first_per(
        "product_id", "product_name, category, subcategory, brand, original_price_inr")
    q["star_customers"] = first_per("customer_id", "customer_state, is_prime_member")
    q["star_time_dimension"] = with_sales(
        "SELECT order_date, CAST(year(order_date) AS INTEGER) AS year, "
        "CAST(quarter(order_date) AS INTEGER) AS quarter, CAST(month(order_date) AS INTEGER) AS month, "
        "CAST(day(order_date) AS INTEGER) AS day, CAST(dayofweek(order_date) + 1 AS INTEGER) AS day_of_week "
        "FROM (SELECT DISTINCT order_date FROM sales WHERE order_date IS NOT NULL) t")
    return q


def _case(pairs: list[tuple[int, str]], n: int) -> str:
    """CASE over k % n; other remainders are NULL."""
    return f"CASE k % {n} " + " ".join(f"WHEN {i} THEN {v}" for i, v in pairs) + " END"


def _round_two() -> dict[str, str]:
    q: dict[str, str] = {}
    paid = ["UPI"] * 3 + ["Credit Card"] * 2 + ["Debit Card"] + ["Cash on Delivery"] * 2 + [
        "Net Banking", "Wallet", "EMI", "Barter", "123", "Gift Voucher"]
    q["clean_payments"] = with_sales(
        f"SELECT k, {_case([(i, repr(p)) for i, p in enumerate(paid)], len(paid))} AS payment_method, "
        "payment_method AS unknown_method FROM sales")
    own = [(0, "4.0"), (1, "3.0"), (2, "2.5"), (3, "4.0"), (4, "4.25"), (5, "5.0")]
    other = [(0, "4.0"), (1, "5.0"), (2, "3.0"), (3, "4.0"), (4, "3.0"), (5, "4.5"), (6, "5.0"), (7, "4.0"), (13, "2.5")]
    prime = "CASE WHEN k % 10 < 4 THEN FALSE WHEN k % 10 < 9 THEN TRUE END"
    q["clean_ratings_wide"] = with_dirty(
        f"SELECT k, CAST({_case(own, 8)} AS DOUBLE) AS customer_rating, "
        f"CAST({_case(other, 14)} AS DOUBLE) AS other_rating, {prime} AS is_prime_member FROM dirty")
    q["prime_value_text"] = with_dirty(
        "SELECT is_prime, customers, orders, revenue, round(revenue / NULLIF(orders, 0), 6) AS aov "
        f"FROM (SELECT {prime} AS is_prime, count(DISTINCT customer_id) AS customers, "
        f"count(DISTINCT transaction_id) AS orders, {msum('CAST(final_amount_inr AS DOUBLE)')} AS revenue "
        "FROM dirty WHERE k % 10 < 9 GROUP BY 1) t")
    q["star_transactions"] = with_sales(
        "SELECT transaction_id, customer_id, product_id, order_date, quantity, discount_percent, "
        "final_amount_inr, payment_method, delivery_days, return_status FROM sales")
    q["first_sale"] = with_sales(
        "SELECT product_id, k, transaction_id, line_no, order_date, "
        "min(order_date) OVER (PARTITION BY product_id) AS first_sale_date FROM sales")
    swapped = "CASE WHEN day(order_date) <= 12 THEN make_date(year(order_date), day(order_date), month(order_date)) ELSE order_date END"
    q["coerce_dates"] = with_sales(
        f"SELECT k, CASE WHEN k % 11 > 8 THEN NULL WHEN k % 11 IN (1, 4, 7) THEN {swapped} ELSE order_date END AS order_date, "
        "CAST(DATE '1999-11-25' + CAST(k % 700 AS INTEGER) AS DATE) AS named_date FROM sales")
    q["coerce_dates_free"] = with_sales(
        "SELECT k, CASE WHEN k % 24 IN (9, 20, 21, 23) THEN NULL "
        "WHEN k % 24 IN (6, 14, 15) THEN CAST(date_trunc('month', order_date) AS DATE) "
        "WHEN k % 24 = 16 THEN CAST(date_trunc('year', order_date) AS DATE) ELSE order_date END AS free_date, "
        "order_date AS short_date FROM sales")
    field = r"TRY_CAST(regexp_extract(t, '^(\d{1,2})[-/.](\d{1,2})[-/.]\d{4}$', _n) AS INTEGER)"
    q["date_shapes"] = with_dirty(
        "SELECT shape, count(*) AS n, count(*) FILTER (a > 12 AND b <= 12) AS day_first, "
        "count(*) FILTER (b > 12 AND a <= 12) AS month_first FROM ("
        "  SELECT regexp_replace(regexp_replace(t, '[0-9]', '9', 'g'), '[a-z]+', 'a', 'g') AS shape, "
        + field.replace("_n", "1") + " AS a, " + field.replace("_n", "2") + " AS b "
        "FROM (SELECT order_date AS t FROM dirty) u) v WHERE shape IS NOT NULL GROUP BY 1")
    def misspelt(c: str, n: str) -> str:
        ways = [c, f"upper({c})", f"lower({c})", f"{c}[1:2] || {c}[4:]", f"{c}[1] || {c}[3] || {c}[2] || {c}[4:]",
                f"{c}[1:2] || {c}[2:]", f"{c}[1:-2] || 'x'", f"'  ' || {c} || '.'", f"{c}[1] || {c}[4:]",
                f"regexp_replace({c}, '[aA]', 'e', 'g')", f"{c} || ' st'", "'Atlantis'"]
        return f"CASE {n} " + " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(ways)) + " END"

    def key(c: str) -> str:
        return f"trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"

    # Every distinct value against every spelling, by the engine's edit distance.
    near = ("pairs AS (SELECT value, name, key, known, levenshtein(key, known) AS edits FROM "
            f"(SELECT DISTINCT value, {key('value')} AS key FROM texts WHERE value IS NOT NULL) v, "
            f"(SELECT DISTINCT name, {key('spelling')} AS known FROM names) n WHERE key <> '' AND known <> ''),\n"
            "scored AS (SELECT value, name, min(struct_pack(score := edits + 0.5::DOUBLE * levenshtein("
            "regexp_replace(key, '[aeiou ]', '', 'g'), regexp_replace(known, '[aeiou ]', '', 'g')), edits := edits)) AS near FROM pairs "
            "WHERE edits <= CASE WHEN length(known) < 4 THEN 0 WHEN length(known) < 7 THEN 1 ELSE 2 END GROUP BY 1, 2),\n"
            "best AS (SELECT value, name, near.edits AS edits, near.score AS score FROM scored "
            "QUALIFY rank() OVER (PARTITION BY value ORDER BY near.score) = 1),\n"
            "nearest AS (SELECT * FROM best QUALIFY count(*) OVER (PARTITION BY value) = 1)")
    q["fuzzy_states"] = with_sales(
        f"SELECT k, text, coalesce(name, trim(text, {WS})) AS customer_state FROM spelt LEFT JOIN nearest ON text = value",
        f"spelt AS (SELECT k, {misspelt('customer_state', 'k % 12')} AS text FROM sales)",
        "texts AS (SELECT DISTINCT text AS value FROM spelt)", "names AS (SELECT n_name AS name, n_name AS spelling FROM nation)", near)
    q["fuzzy_products"] = (
        f"WITH texts AS (SELECT {misspelt('p_name', 'p_partkey % 12')} AS value FROM part), "
        f"names AS (SELECT DISTINCT p_name AS name, p_name AS spelling FROM part), {near} "
        "SELECT value, name, CAST(edits AS INTEGER) AS edits, score FROM nearest")
    order = "transaction_id, line_no, product_id, supplier_id, line_price"
    q["head_rows"] = with_sales(f"SELECT {order}, product_name FROM sales ORDER BY {order} LIMIT 25")
    q["discount_levels"] = with_sales(
        f"SELECT discount_percent + (k % 13) / 16.0::DOUBLE AS discount_percent, {nsum('quantity')} AS quantity, "
        f"{REV} AS revenue FROM sales WHERE discount_percent IS NOT NULL GROUP BY 1")
    q["large_amounts"] = with_sales(
        f"SELECT CAST(year(order_date) AS INTEGER) AS order_year, "
        f"{msum('CASE WHEN k % 5000 <> 0 THEN round(quantity, 0) END')} "
        "+ COALESCE(sum(CASE WHEN k % 5000 = 0 THEN 2e14::DOUBLE END), 0.0) AS revenue "
        "FROM sales WHERE order_date IS NOT NULL GROUP BY 1")
    q["edge_text"] = with_sales(
        "SELECT k, CAST(DATE '2003-01-31' + CAST(k % 900 AS INTEGER) AS DATE) AS order_date, "
        "CAST(k % 100000 AS DOUBLE) AS number, CAST(k % 100000 AS DOUBLE) AS original_price_inr FROM sales")
    q["top_states_20"] = top_by("customer_state", 20)
    q["csv_ingest"] = with_sales(
        "SELECT k, product_name || ' 15.6\"\", \"' || brand || '\", x' AS product_name, "
        "CASE WHEN k % 7 = 0 THEN NULL WHEN k % 11 = 0 THEN ' n ' ELSE customer_state END AS customer_state, "
        "FALSE AS malformed FROM sales")
    return q


def _lake(known: dict[str, str]) -> dict[str, str]:
    """Gold, increments and the live month: the same rows as from the facts."""
    q = {"gold_revenue_by_year": known["revenue_by_year"], "gold_month_monitor": known["month_monitor"],
         "gold_monthly_customers": known["monthly_customers"], "live_month_stream": known["month_monitor"]}
    q["first_sale_bucketed"] = known["first_sale"]
    q["top_products_clustered"] = known["top_products_in_subcategory"]
    dates, prices = known["clean_dates"].strip(), known["clean_prices"].strip()
    counts = " UNION ALL ".join(
        [f"SELECT 'non_null' AS measure, '{c}' AS column_name, count({e}) AS value, count(*) AS total_rows FROM {t}"
         for c, e, t in [("k", "k", "d"), ("order_date", "order_date", "d"), ("is_valid_date", "is_valid_date", "d"),
                         ("original_price_inr", "original_price_inr", "p"), ("customer_city", "customer_city", "x"), ("delivery_days", "delivery_days", "x")]]
        + ["SELECT 'invalid_dates', NULL, count(*) FILTER (NOT is_valid_date), count(*) FROM d",
           "SELECT 'prices_above_1000', NULL, count(*) FILTER (original_price_inr > 1000), count(*) FROM p"])
    q["silver_quality"] = f"WITH d AS ({dates}), p AS ({prices}), x AS ({with_dirty('SELECT * FROM dirty')}) {counts}"
    q["gold_median_delivery"] = with_sales("SELECT DISTINCT customer_state, TRUE AS median_near FROM sales WHERE customer_state IS NOT NULL")
    q["audit_copies"] = with_dirty(
        "SELECT k, order_date AS original_order_date, original_price_inr AS before_parse_price, "
        "customer_rating AS original_customer_rating, delivery_days AS original_delivery_days, "
        f"({d_date('order_date')}) IS NOT NULL AS is_valid_date, {d_price('original_price_inr')} AS original_price_inr FROM dirty")
    names = [n.strip() for n in """k, transaction_id, line_no, product_id, supplier_id, line_price, customer_id, product_name,
        product_rating, final_amount_inr, quantity, order_date, original_price_inr, customer_rating, delivery_days,
        delivery_type, is_prime_member, customer_city, category, customer_age_group, delivery_charges, festival_name""".split(",")]
    values = ", ".join(f"({i}, '{n}')" for i, n in enumerate(names))
    q["table_shape"] = with_dirty(
        "SELECT CAST(position AS INTEGER) AS position, column_name, (SELECT count(*) FROM dirty) AS rows, "
        f"{len(names)} AS columns FROM (VALUES {values}) v(position, column_name)")
    q["gold_top_states"] = f"SELECT customer_state, revenue, TRUE AS customers_near FROM ({known['top_states']}) t"
    order = "transaction_id, line_no, product_id, supplier_id, line_price"
    q["dedup_increments"] = with_sales(
        f"SELECT k, {order}, customer_id, product_name, order_date, CAST(load AS INTEGER) AS load FROM l "
        f"QUALIFY row_number() OVER (PARTITION BY customer_id, product_name, order_date ORDER BY load, {order}) = 1",
        "l AS (SELECT k, transaction_id, line_no, product_id, supplier_id, line_price, product_name, k % 3 AS load, "
        "CASE WHEN customer_id % 50 > 0 THEN customer_id END AS customer_id, CAST(date_trunc('month', order_date) AS DATE) AS order_date FROM sales)")
    q["yearly_refresh"] = with_sales(
        "SELECT CAST(year(order_date) AS INTEGER) AS order_year, count(DISTINCT (customer_id, product_name, order_date)) AS lines, "
        "year(order_date) = (SELECT max(year(order_date)) FROM sales) AS rewritten FROM sales WHERE order_date IS NOT NULL GROUP BY 1, 3")
    return q


def _forecast() -> dict[str, str]:
    """Triple exponential smoothing by a recursive query over months."""
    def total(a: int) -> str:
        return f"list_reduce(list_prepend(0.0::DOUBLE, v[{a}:{a + 11}]), lambda x, y: x + y) / 12"

    return {"revenue_forecast": f"""
WITH RECURSIVE sales AS ({SALES_SQL}),
months AS (SELECT category, CAST(date_trunc('month', order_date) AS DATE) AS m, {REV} AS revenue FROM sales
  WHERE category IS NOT NULL AND order_date IS NOT NULL GROUP BY 1, 2),
spine AS (SELECT category, CAST(unnest(generate_series(first, (SELECT max(m) FROM months), INTERVAL 1 MONTH)) AS DATE) AS m, first
  FROM (SELECT category, min(m) AS first FROM months GROUP BY 1) f),
series AS (SELECT s.category, s.first, list(coalesce(revenue, 0.0) ORDER BY s.m) AS v
  FROM spine s LEFT JOIN months m ON s.category = m.category AND s.m = m.m GROUP BY 1, 2),
starts AS (SELECT category, first, v, {total(1)} AS one, {total(13)} AS two FROM series WHERE len(v) >= 24),
grid AS (SELECT a::DOUBLE AS alpha, b::DOUBLE AS beta, g::DOUBLE AS gamma FROM (VALUES (0.2), (0.5), (0.8)) x(a), (VALUES (0.0), (0.1), (0.3)) y(b), (VALUES (0.1), (0.4)) z(g)),
walk AS (
  SELECT category, first, v, alpha, beta, gamma, one AS level, (two - one) / 12 AS trend,
         list_transform(v[1:12], lambda x: x - one) AS season, 0.0::DOUBLE AS error, 0 AS t FROM starts, grid
  UNION ALL
  SELECT category, first, v, alpha, beta, gamma, new_level, beta * (new_level - level) + (1 - beta) * trend,
         season[:t % 12] || [gamma * (y - new_level) + (1 - gamma) * term] || season[t % 12 + 2:],
         error + (y - (level + trend + term)) * (y - (level + trend + term)), t + 1
  FROM (SELECT *, alpha * (y - term) + (1 - alpha) * (level + trend) AS new_level
        FROM (SELECT *, v[t + 13] AS y, season[t % 12 + 1] AS term FROM walk WHERE t + 12 < len(v)) a) b),
best AS (SELECT * FROM walk WHERE t + 12 = len(v)
  QUALIFY row_number() OVER (PARTITION BY category ORDER BY error, alpha, beta, gamma) = 1)
SELECT category, CAST(step AS INTEGER) AS step, CAST(last_day(first + to_months(CAST(len(v) + step - 1 AS INTEGER))) AS DATE) AS period_end,
  round(greatest(level + step * trend + season[(len(v) + step - 1) % 12 + 1], 0.0), 2) AS forecast, alpha, beta, gamma
FROM best, (SELECT unnest(generate_series(1, 6)) AS step) s
"""}


def oracle_queries() -> dict[str, str]:
    q = _analytics()
    q.update(_cleaning())
    q.update(_segments())
    q.update(_round_two())
    q.update(_lake(q))
    q.update(_forecast())
    return q
