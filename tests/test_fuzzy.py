"""Nearest known names against edit distances computed pair by pair."""

import random

from pyspark.sql import functions as F

from bazaar.operators import fuzzy as FZ
from bazaar.schema import CITY_MAP, PAYMENT_MAP, STATE_MAP


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def bare(s):
    return "".join(c for c in s if c not in "aeiou ")


def nearest(value, names):
    """Brute force: (name, edits, score) or None."""
    best = {}
    for name in names:
        key, known = value.lower(), name.lower()
        d = distance(key, known)
        if d <= (0 if len(known) < 4 else 1 if len(known) < 7 else 2):
            best[name] = (d + 0.5 * distance(bare(key), bare(known)), d)
    if not best:
        return None
    least = min(best.values())[0]
    found = [n for n, s in best.items() if s[0] == least]
    return (found[0], best[found[0]][1], least) if len(found) == 1 else None


def edited(rng, text, n):
    for _ in range(n):
        i = rng.randrange(len(text) + 1)
        how = rng.randrange(3)
        text = text[:i] + ("" if how == 0 else rng.choice("abcdefgh")) + text[i + (how != 1):]
    return text


def test_no_pair_is_lost(spark):
    rng = random.Random(2)
    names = sorted({"".join(rng.choice("abcde") for _ in range(rng.randrange(3, 11))) for _ in range(60)})
    values = sorted({edited(rng, rng.choice(names), rng.randrange(4)) for _ in range(500)} - {""})
    got = FZ.match_names(spark.createDataFrame([(v,) for v in values], "value string"),
                         spark.createDataFrame([(n, n) for n in names], "name string, spelling string"))
    want = {(v, *nearest(v, names)) for v in values if nearest(v, names)}
    assert {tuple(r) for r in got.collect()} == want
    assert len(want) > 100 and any(e == 2 for *_, e, _ in want)


def test_deletions(spark):
    got = spark.range(1).select(FZ.deletions(F.lit("abca"), 2).alias("a"), FZ.deletions(F.lit(""), 2).alias("e")).first()
    assert sorted(got.a) == sorted({"abca", "bca", "aca", "aba", "abc", "ca", "ba", "bc", "aa", "ac", "ab"})
    assert got.e == [""]


def test_states_cities_payments(spark):
    cases = [("karnatka", "Karnataka"), ("MAHARASTRA", "Maharashtra"), ("Orisa", "Odisha"), ("Tamilnadu", "Tamil Nadu"),
             ("Uttar Pradesh ", "Uttar Pradesh"), ("Uttarpradesh", "Uttar Pradesh"), ("Jammu & Kashmir", "Jammu and Kashmir"), ("UP", "Uttar Pradesh"),
             ("UQ", "UQ"), ("Pondichery", "Puducherry"), ("West Bengol", "West Bengal"), ("Atlantis ", "Atlantis"), (None, None), ("", ""),
             ("Gao", "Gao"), ("x" * 20000, "x" * 20000)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, s string")
    got = FZ.repair_names(df, "s", FZ.names_table(spark, STATE_MAP)).orderBy("i").collect()
    assert [r.s for r in got] == [w for _, w in cases]
    city = spark.createDataFrame([("Bangalor", ), ("mumbay",), ("Kolkatta",), ("Pune",)], "c string")
    assert {r.c for r in FZ.repair_names(city, "c", FZ.names_table(spark, CITY_MAP)).collect()} == {"Bangalore", "Mumbai", "Kolkata", "Pune"}
    pay = spark.createDataFrame([("Credt Card",), ("net bankng",), ("cod",), ("cox",)], "p string")
    assert {r.p for r in FZ.repair_names(pay, "p", FZ.names_table(spark, PAYMENT_MAP)).collect()} == \
        {"Credit Card", "Net Banking", "Cash on Delivery", "cox"}


def test_recall_of_planted_typos(spark):
    # One edit each in names of seven letters or more: of the README's figure.
    rng = random.Random(7)
    names = [n for n in STATE_MAP if len(n) >= 7]
    rows = [(i, n, edited(rng, n.lower(), 1 + i % 2)) for i, n in enumerate(names * 20)]
    df = spark.createDataFrame(rows, "i int, name string, text string")
    out = FZ.repair_names(df, "text", FZ.names_table(spark, STATE_MAP)).collect()
    hit = sum(r.text == r.name for r in out)
    other = sum(r.text != r.name and r.text in STATE_MAP for r in out)
    assert hit >= 0.98 * len(rows) and other == 0


def test_hot_value_clashing_columns_and_empty(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "Keralla").otherwise(F.concat(F.lit("v"), F.col("id").cast("string"))).alias("s"),
                                  F.lit("mine").alias("_value"), F.lit(1).alias("_name"))
    out = FZ.repair_names(df, "s", FZ.names_table(spark, STATE_MAP))
    assert out.columns == ["s", "_value", "_name"]
    assert out.where("s = 'Kerala' and _value = 'mine' and _name = 1").count() == 1000 and out.count() == 3000
    assert FZ.repair_names(df.limit(0), "s", FZ.names_table(spark, STATE_MAP)).count() == 0
    assert FZ.match_names(df.select(F.col("s").alias("value")), FZ.names_table(spark, {"Goa": []}).limit(0)).count() == 0


def test_plan_compares_no_rows(spark):
    v = spark.createDataFrame([("a",)], "value string")
    plan = FZ.match_names(v, FZ.names_table(spark, STATE_MAP))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Cross" not in plan
