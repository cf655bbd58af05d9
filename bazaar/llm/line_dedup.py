"""Line dedup by site-relative frequency, in DataFrame functions.

A line is boilerplate of a host if the share of the host's pages that hold it
exceeds ``max_ratio``, and at least ``min_pages`` pages hold it: so few that
hosts of a handful of pages are cleaned too. All pages count. With
``copies=False`` pages of a host with one and the same text count once, on both
sides of the ratio, so that a mirrored page does not turn its own content into
boilerplate: for pipelines that drop copies afterwards. Boilerplate lines go
from every page of the host.

Defined cases: lines compare without white space at their ends, empty lines
always stay; null text stays null with no lines; a null host is a host of its
own; repeated rows give repeated results; an empty table gives an empty
result; extra columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaar.llm.scratch import stage, unused

MAX_RATIO = 0.05
MIN_PAGES = 3


def host_of(url: Column) -> Column:
    """Host of a web address, for tables of pages."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _bare(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\r\x0b\x0c"))


def boilerplate(docs: DataFrame, text_col: str, host: Column, max_ratio: float = MAX_RATIO,
                min_pages: int = MIN_PAGES, copies: bool = True) -> DataFrame:
    """(host, lines): per host the hashes of its boilerplate lines. A host has
    at most its mean number of lines a page / ``max_ratio`` of them. Counts
    are pre-aggregated, so a host with a third of all pages is no hot key."""
    pages = docs.where(F.col(text_col).isNotNull()).select(
        host.alias("host"), F.xxhash64(text_col).alias("page"),
        F.col(text_col).alias("text"))
    counted = pages.select("host", "page")
    totals = (counted if copies else counted.distinct()).groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    kept = F.filter(_lines(F.col("text")), lambda x: _bare(x) != "")
    lines = pages.select("host", "page", F.explode(F.array_distinct(
        F.transform(kept, lambda x: F.xxhash64(_bare(x))))).alias("line"))
    # One row for each page and line, or distinct page and line; then counts of those.
    held = ((lines if copies else lines.distinct()).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= min_pages))
    t = totals.select(F.col("host").alias("_h"), "pages")
    return (held.join(t, held.host.eqNullSafe(t._h))
            .where(F.col("n") > F.col("pages") * F.lit(float(max_ratio)))
            .groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("lines")))


def drop_boilerplate(docs: DataFrame, text_col: str = "text", host: Column | None = None,
                     max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, copies: bool = True) -> DataFrame:
    """``docs`` with ``text_col`` rid of boilerplate lines, plus the columns
    _lines_in and _lines_dropped (in place of any of those names). The table of boilerplate is staged, so that
    Spark broadcasts it only when its real size allows and otherwise joins by
    host, splitting large hosts."""
    host = F.col("source") if host is None else host
    found = stage(boilerplate(docs, text_col, host, max_ratio, min_pages, copies), "line-boilerplate")
    # Names that no column has.
    at, bad, kept = (unused(docs, c) for c in ("_host", "_boilerplate", "_stays"))
    found = found.select(F.col("host").alias(at), F.col("lines").alias(bad))
    out = docs.join(found, host.eqNullSafe(F.col(at)), "left")
    lines = _lines(F.col(text_col))
    stays = F.filter(lines, lambda x: ~F.array_contains(F.col(bad), F.xxhash64(_bare(x)))
                     | (_bare(x) == ""))
    out = out.withColumn("_lines_in", F.coalesce(F.size(lines), F.lit(0)).cast("long"))
    out = out.withColumn(kept, F.when(F.col(bad).isNotNull() & F.col(text_col).isNotNull(), stays))
    out = out.withColumn("_lines_dropped", F.when(
        F.col(kept).isNotNull(), F.col("_lines_in") - F.size(kept)).otherwise(0).cast("long"))
    out = out.withColumn(text_col, F.when(F.col("_lines_dropped") > 0, F.array_join(kept, "\n"))
                         .otherwise(F.col(text_col)))
    return out.drop(at, bad, kept)


def drop_boilerplate_lines(docs: DataFrame, text_col: str = "text", host: Column | None = None,
                           chars_col: str = "n_chars", copies: bool = True) -> DataFrame:
    """As ``drop_boilerplate`` without the extra columns, all columns of
    ``docs`` kept; ``chars_col``, if there, follows where lines went."""
    counts = ("_lines_in", "_lines_dropped")
    taken = {c: unused(docs, c) for c in counts if c in docs.columns}
    out = drop_boilerplate(docs.withColumns({new: F.col(c) for c, new in taken.items()}), text_col, host, copies=copies)
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.when(F.col("_lines_dropped") > 0, F.length(text_col).cast(
            docs.schema[chars_col].dataType)).otherwise(F.col(chars_col)))
    out = out.drop(*counts).withColumnsRenamed({new: c for c, new in taken.items()})
    return out.select(*docs.columns)
