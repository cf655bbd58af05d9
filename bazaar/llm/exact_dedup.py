"""Exact dedup by two-pass Bloom filtering, in DataFrame functions only.

Pass one sets bits for every text hash and keeps those positions that two
rows or more have set; pass two tests each row against them. Only rows whose
positions are all set twice can have a copy, and only those are grouped (a
shuffle); the others are unique for certain and pass straight through. A
false positive costs a little shuffle, never a wrong result.

Defined cases: null text counts as empty text; a null id sorts after every
other id, and a group of null ids keeps one row with ``keep_id`` null; rows
that repeat an id and a text are copies of each other, of which one stays;
an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaar.llm.scratch import stage

# Runs of white space other than one plain space; replacing just these by a
# space equals replacing every run, with far fewer matches.
ODD_SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"

MIN_BITS, MAX_BITS = 1 << 16, 1 << 28
BITS_PER_ROW = 16
PROBES = 2


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), ODD_SPACE, " ")


def filter_bits(rows: int) -> int:
    """Filter size: a power of two near 16 bits a row. ``MAX_BITS`` bounds the
    broadcast to 2**22 words (64 MB); beyond about 17 million rows the filter
    is fuller and lets more unique rows into the shuffle, results unchanged."""
    bits = MIN_BITS
    while bits < min(MAX_BITS, BITS_PER_ROW * rows):
        bits *= 2
    return bits


def _positions(sha: str, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.col(sha), F.lit(i)), F.lit(bits)) for i in range(PROBES)]


def repeat_filter(hashes: DataFrame, sha: str, bits: int) -> DataFrame:
    """The second filter: 64-bit words (``word``, ``bits``) of the positions
    set by at least two probes. At most ``bits / 64`` rows."""
    positions = hashes.select(F.explode(F.array(*_positions(sha, bits))).alias("pos"))
    return (positions.groupBy("pos").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            .groupBy(F.shiftright("pos", 6).alias("word"))
            .agg(F.expr("bit_or(shiftleft(1L, cast(pos & 63 as int)))").alias("bits")))


def mark_possible(df: DataFrame, sha: str, words: DataFrame, bits: int, flag: str) -> DataFrame:
    """Add ``flag``: true if the row may have a copy. The filter is broadcast:
    its rows are bounded by ``bits / 64`` whatever the data."""
    for i, pos in enumerate(_positions(sha, bits)):
        w = words.select(F.col("word").alias(f"_word{i}"), F.col("bits").alias(f"_bits{i}"))
        df = (df.withColumn(f"_pos{i}", pos)
              .join(F.broadcast(w), F.shiftright(F.col(f"_pos{i}"), 6) == F.col(f"_word{i}"), "left"))
    hit = F.lit(True)
    for i in range(PROBES):
        hit = hit & F.expr(f"coalesce(shiftright(_bits{i}, cast(_pos{i} & 63 as int)) & 1L, 0L) = 1L")
    return df.withColumn(flag, hit).drop(*[f"{c}{i}" for i in range(PROBES)
                                           for c in ("_pos", "_word", "_bits")])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept,
    text_sha256 (of the normalised text)."""
    hashes = stage(docs.select(
        F.col(id_col).alias("id"),
        F.sha2(normalised(F.col(text_col)), 256).alias("sha"),
        F.monotonically_increasing_id().alias("row")), "exact-hashes")
    bits = filter_bits(hashes.count())
    words = stage(repeat_filter(hashes, "sha", bits), "exact-filter")
    marked = mark_possible(hashes, "sha", words, bits, "possible")

    possible = marked.where("possible").drop("possible")
    # One row per repeated text, pre-aggregated on the map side; staged, so
    # that the join below sees its size and can split a hot text's rows.
    groups = stage(possible.groupBy("sha").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first"))
        .where("n > 1"), "exact-groups")
    unique = marked.where("not possible").select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "sha")
    grouped = possible.join(groups, "sha", "left").select(
        "id",
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | (F.col("row") == F.col("first.row"))).alias("kept"), "sha")
    return unique.unionByName(grouped).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept",
        F.col("sha").alias("text_sha256"))
