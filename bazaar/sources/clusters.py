"""Files clustered for filters on several columns.

Rows are placed by one key that interleaves the bits of all filter columns
(a Z-order): each column keeps a share of the order, so the min and max values
that Parquet keeps for row groups and pages rule most of them out for a filter
on any of the columns, not only on the first of a sort order. Text columns get
a Bloom filter in each row group besides, which rules out values that lie
between min and max.

Where a column's values fall is taken from a bounded number of quantiles (dates
and numbers) or from their hash (text), so neither needs the sorted column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits a column has in the key: 2**BITS ranges of it.
BITS = 6
ROW_GROUP_BYTES = 32 << 20
#: Rows of a file at most, about: what one task sorts and writes.
ROWS_PER_FILE = 2_000_000


def _range_of(df: DataFrame, c: str) -> Column:
    """The number of a row's range of column ``c``, 0 to 2**BITS - 1; NULL in the first."""
    if df.schema[c].dataType.simpleString() == "string":
        place = F.pmod(F.xxhash64(c), F.lit(1 << BITS))
    else:
        value = F.unix_date(F.col(c)) if df.schema[c].dataType.simpleString() == "date" else F.col(c)
        value = value.cast("double")
        # At most 2**BITS numbers, by a sketch merged on the map side.
        cuts = df.agg(F.percentile_approx(value, [i / (1 << BITS) for i in range(1, 1 << BITS)], 10_000)).first()[0] or []
        place = F.size(F.filter(F.array(*[F.lit(float(x)) for x in sorted(set(cuts))]).cast("array<double>"), lambda x: x <= value))
    return F.coalesce(place.cast("long"), F.lit(0).cast("long"))


def interleaved(df: DataFrame, columns: list[str]) -> Column:
    """One number whose bits are those of the columns' ranges in turn, the
    highest first."""
    places = [_range_of(df, c) for c in columns]
    key = F.lit(0).cast("long")
    for bit in reversed(range(BITS)):
        for place in places:
            key = F.shiftleft(key, 1).bitwiseOR(F.shiftright(place, bit).bitwiseAND(F.lit(1).cast("long")))
    return key


def write_clustered(df: DataFrame, path: str, columns: list[str], files: int, row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Write ``df`` in ranges of the interleaved key, in its order, with Bloom
    filters on the text columns among ``columns``. There are ``files`` ranges,
    or as many as keep one at ``ROWS_PER_FILE`` rows (a few row groups), so the
    task that sorts a range does not grow with the table; a range is split by
    the columns themselves where many rows share a key."""
    files = max(files, -(-df.count() // ROWS_PER_FILE))
    key = "_cluster"
    while key in df.columns:
        key = f"_{key}"
    keyed = df.withColumn(key, interleaved(df, columns))
    out = keyed.repartitionByRange(files, key, *columns).sortWithinPartitions(key, *columns).drop(key)
    write = out.write.mode("overwrite").option("parquet.block.size", str(row_group_bytes))
    for c in columns:
        if df.schema[c].dataType.simpleString() == "string":
            write = write.option(f"parquet.bloom.filter.enabled#{c}", "true")
    write.parquet(path)
