"""Column names, types and the fixed token lists of the cleaning rules."""

from __future__ import annotations

# ---------------------------------------------------------------------------
# These must equal the reference behaviour for equal results.
# ---------------------------------------------------------------------------

# Bronze: every column of the order-line file, read as text.
BRONZE_COLUMNS = [
    "transaction_id", "order_date", "customer_id", "product_id", "product_name",
    "category", "subcategory", "brand", "original_price_inr", "discount_percent",
    "discounted_price_inr", "quantity", "subtotal_inr", "delivery_charges",
    "final_amount_inr", "product_weight_kg", "delivery_days", "delivery_type",
    "customer_city", "customer_state", "customer_age_group", "customer_rating",
    "product_rating", "payment_method", "festival_name", "is_prime_member",
    "is_prime_eligible", "is_festival_sale", "return_status",
]

# Columns coerced to numbers when a file is loaded for reporting (L3).
NUMERIC_COLUMNS = [
    "original_price_inr", "discount_percent", "discounted_price_inr", "quantity",
    "subtotal_inr", "delivery_charges", "final_amount_inr", "product_weight_kg",
    "delivery_days",
]

# Columns coerced to nullable booleans when a file is loaded for reporting (L4).
BOOLEAN_COLUMNS = ["is_prime_member", "is_festival_sale", "is_prime_eligible"]

# Text the pandas CSV reader treats as missing by default (public pandas docs).
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Order-date formats, tried in this order; the first full match wins.
DATE_FORMATS = [
    "Y-m-d", "d-m-Y", "m-d-Y",
    "Y/m/d", "d/m/Y", "m/d/Y",
    "Y.m.d", "d.m.Y", "m.d.Y",
]

# Range of dates a nanosecond timestamp can hold; parsed dates outside are missing.
MIN_DATE = "1677-09-22"
MAX_DATE = "2262-04-11"

# City spellings mapped to one name (exact, case- and space-sensitive).
CITY_MAP = {
    "Delhi": ["DELHI", "Delhi NCR", "delhi", "New Delhi"],
    "Kolkata": ["Kolkata ", "KOLKATA", "Calcutta", "kolkata"],
    "Chennai": ["Madras", "Chennai ", "chenai", "CHENNAI"],
    "Mumbai": ["Mumbai ", "MUMBAI", "mumba", "Bombay"],
    "Bangalore": ["Bengaluru", "BANGALORE", "Bengalore", "Banglore"],
}

# Boolean text standardisation of the cleaning step.
BOOL_TEXT_MAP = {
    "False": ["0", "No", "False ", "FALSE"],
    "True": ["1", "Yes", "True ", "TRUE"],
}

# Category spellings mapped to one name.
CATEGORY_MAP = {
    "Electronics": ["Electronic", "ELECTRONICS", "Electronics & Accessories", "Electronicss"],
}

# Load-time boolean coercion (L4), compared after trim and lower-case.
TRUE_TOKENS = ["true", "1", "yes"]
FALSE_TOKENS = ["false", "0", "no"]

# Delivery-day text accepted as a plain integer.
PLAIN_DELIVERY_DAYS = ["0", "1", "2", "3", "4", "5", "6", "7"]

# Other delivery-day text (C10) -> days for (Same Day or Express delivery,
# Standard delivery of a prime member, any other case).
DELIVERY_TEXT_DAYS = {
    "-1": (0, 1, 2),
    "1-2 days": (1, 2, 3),
    "Express": (0, 1, 2),
    "Same Day": (0, 1, 2),
    "15": (1, 3, 5),
}

# Fill values of the cleaning step.
DELIVERY_CHARGES_FILL = 0.0
FESTIVAL_FILL = "Normal Day"

# Whitespace removed by a Python str.strip().
STRIP_CHARS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Columns the cleaning step keeps as audit copies and removes at the end.
AUDIT_COPIES = {
    "order_date": "original_order_date",
    "original_price_inr": "before_parse_price",
    "customer_rating": "original_customer_rating",
    "delivery_days": "original_delivery_days",
}

# Keys of keep-first deduplication (C11).
DEDUP_KEYS = ["customer_id", "product_name", "order_date"]

# ---------------------------------------------------------------------------
# Defaults of our own, for wider readings that the callers can replace.
# ---------------------------------------------------------------------------

# Boolean words of the wider reading (X6), compared after trim and lower-case.
WIDE_TRUE_TOKENS = ["true", "1", "1.0", "yes", "y", "t"]
WIDE_FALSE_TOKENS = ["false", "0", "0.0", "no", "n", "f"]

# Payment-method spellings mapped to one name (X3), compared after trim,
# lower-case and with runs of other characters as one space.
PAYMENT_MAP = {
    "UPI": ["upi", "phonepe", "phone pe", "google pay", "googlepay", "gpay", "g pay", "paytm upi", "bhim"],
    "Credit Card": ["credit card", "creditcard", "cc", "credit"],
    "Debit Card": ["debit card", "debitcard", "dc", "debit"],
    "Cash on Delivery": ["cash on delivery", "cod", "c o d", "cash"],
    "Net Banking": ["net banking", "netbanking", "internet banking"],
    "Wallet": ["wallet", "e wallet", "ewallet", "paytm", "paytm wallet"],
    "EMI": ["emi", "bajaj emi", "bnpl", "pay later"],
}

# States and union territories of India with former and short names.
STATE_MAP = {
    "Andhra Pradesh": ["AP"], "Arunachal Pradesh": [], "Assam": [], "Bihar": [], "Chhattisgarh": ["Chattisgarh"], "Goa": [],
    "Gujarat": [], "Haryana": [], "Himachal Pradesh": ["HP"], "Jharkhand": [], "Karnataka": ["Mysore State"], "Kerala": [],
    "Madhya Pradesh": ["MP"], "Maharashtra": ["MH"], "Manipur": [], "Meghalaya": [], "Mizoram": [], "Nagaland": [],
    "Odisha": ["Orissa"], "Punjab": [], "Rajasthan": [], "Sikkim": [], "Tamil Nadu": ["TN", "Madras State"], "Telangana": ["TS"],
    "Tripura": [], "Uttar Pradesh": ["UP"], "Uttarakhand": ["Uttaranchal"], "West Bengal": ["WB"],
    "Andaman and Nicobar Islands": ["Andaman & Nicobar"], "Chandigarh": [],
    "Dadra and Nagar Haveli and Daman and Diu": ["Dadra and Nagar Haveli", "Daman and Diu"], "Delhi": ["NCT of Delhi", "New Delhi"],
    "Jammu and Kashmir": ["Jammu & Kashmir", "J and K"], "Ladakh": [], "Lakshadweep": [], "Puducherry": ["Pondicherry"],
}

# Three-letter month names of dates such as '5 Jan 2020' (L1).
MONTH_NAMES = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
