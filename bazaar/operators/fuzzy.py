"""Misspelt names (X3, X6, C7): the nearest known name by an index of deletions.

Two texts within ``n`` edits have a common text among those made by deleting
up to ``n`` characters of each. So known names and the *distinct* unknown
values are blown up to these variants and joined by their hashes: every pair
within ``MAX_EDITS`` meets, no other pair is compared but by chance, and rows
are never compared at all. Pairs that meet are decided by an edit distance in
which vowels (and the spaces between words) count less than consonants.

All steps are Spark expressions. The values are reduced to distinct ones on
the map side, so a value that a third of the rows hold is one value; the
repaired names come back by a join with one row a value.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bazaar.functions.parsing import py_strip
from bazaar.plans.joins import broadcast_if_small
from bazaar.session import scratch_path

#: Edits (one character added, left out or replaced) up to which names are found.
MAX_EDITS = 2
#: What an edit of a consonant costs more than one of a vowel or space.
CONSONANT = 0.5


def name_key(c: str | Column) -> Column:
    """A name as it is compared: lower case, other than letters and digits one space."""
    text = F.col(c) if isinstance(c, str) else c
    return F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def consonants(key: Column) -> Column:
    return F.regexp_replace(key, "[aeiou ]", "")


def edits_allowed(key: Column, most: int = MAX_EDITS) -> Column:
    """Short names have no room for misspellings: none below four characters,
    one below seven."""
    size = F.length(key)
    return F.least(F.lit(most), F.when(size < 4, 0).when(size < 7, 1).otherwise(most))


def deletions(key: Column, most: int = MAX_EDITS) -> Column:
    """All texts that leave out up to ``most`` characters of ``key``, once each."""
    def shorter(s: Column) -> Column:
        places = F.when(F.length(s) > 0, F.sequence(F.lit(1), F.length(s))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))

    level = out = F.array(key)
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(level, shorter)))
        out = F.concat(out, level)
    return F.array_distinct(out)


def names_table(spark: SparkSession, mapping: dict[str, list[str]]) -> DataFrame:
    """(name, spelling) of a mapping name -> other spellings; names spell themselves."""
    rows = [(name, s) for name, others in mapping.items() for s in [name, *others]]
    return spark.createDataFrame(rows, "name string, spelling string")


def match_names(values: DataFrame, names: DataFrame, most: int = MAX_EDITS) -> DataFrame:
    """The nearest name of each distinct value.

    ``values`` has a column ``value``, ``names`` has ``name`` and ``spelling``.
    Result: value, name, edits, score, one row for each value that has a
    nearest name. A value as near to two names as to each other's has none;
    values without a name within the allowed edits, NULL and blank ones are
    not in the result.
    """
    known = names.select("name", name_key("spelling").alias("known")).where("known <> ''").distinct()
    keys = values.select("value").where(F.col("value").isNotNull()).distinct() \
        .withColumn("key", name_key("value")).where("key <> ''")
    distinct = keys.select("key").distinct()
    # Longer texts than any name and its edits can match none, and would be blown up.
    longest = known.agg(F.coalesce(F.max(F.length("known")), F.lit(0)) + most).scalar()
    variant = lambda df, c: df.withColumn("variant", F.explode(deletions(F.col(c), most))).withColumn(
        "variant", F.xxhash64("variant"))
    pairs = variant(distinct.where(F.length("key") <= longest), "key").join(variant(known, "known"), "variant") \
        .select("key", "name", "known").distinct()
    edits = F.levenshtein("key", "known", most)
    scored = pairs.withColumn("edits", edits).where((F.col("edits") >= 0) & (F.col("edits") <= edits_allowed(F.col("known"), most)))
    score = F.col("edits") + F.lit(CONSONANT) * F.levenshtein(consonants(F.col("key")), consonants(F.col("known")))
    best = scored.withColumn("score", score).groupBy("key", "name").agg(F.min(F.struct("score", "edits")).alias("near"))
    # Few names are near a value, so these groups are small.
    by_key = Window.partitionBy("key")
    nearest = best.withColumn("least", F.min("near.score").over(by_key)).where(F.col("near.score") == F.col("least")) \
        .withColumn("ties", F.count(F.lit(1)).over(by_key)).where("ties = 1")
    return keys.join(nearest.select("key", "name", "near.edits", "near.score"), "key").select("value", "name", "edits", "score")


def repair_names(df: DataFrame, col: str, names: DataFrame, most: int = MAX_EDITS) -> DataFrame:
    """``df`` with ``col`` as its nearest known name; text without one is only
    trimmed. The matches are staged (one row a distinct value), and broadcast
    only if they are small."""
    spark = df.sparkSession
    path = scratch_path(spark, f"names-{uuid.uuid4().hex}")
    match_names(df.select(F.col(col).alias("value")), names, most).write.parquet(path)
    found = spark.read.parquet(path).select(F.col("value").alias("_value"), F.col("name").alias("_name"))
    shared = [c for c in ("_value", "_name") if c in df.columns]
    names_of = {c: f"{c}_{uuid.uuid4().hex}" for c in shared}
    found = found.withColumnsRenamed(names_of)
    value, name = (names_of.get(c, c) for c in ("_value", "_name"))
    out = df.join(broadcast_if_small(found), F.col(col) == F.col(value), "left")
    return out.withColumn(col, F.coalesce(F.col(name), py_strip(col))).drop(value, name)
