"""Join helpers: size-checked broadcasts and one-row scalar attachments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest side (estimated bytes) the library hints for broadcast by itself.
DEFAULT_BROADCAST_BYTES = 8 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int | None:
    """Optimizer size estimate of ``df`` (from file sizes; runs no job)."""
    try:
        stats = df._jdf.queryExecution().optimizedPlan().stats()
        return int(stats.sizeInBytes().toString())
    except Exception:  # noqa: BLE001 - estimate unavailable (e.g. remote session)
        return None


def broadcast_if_small(df: DataFrame, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only when the estimate proves the side is small.

    Without a usable estimate the side is returned unchanged and the planner
    (with AQE's runtime statistics) decides.
    """
    size = estimated_bytes(df)
    if size is not None and size <= max_bytes:
        return F.broadcast(df)
    return df


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row of ``df``.

    ``one_row`` must be a global aggregate (no grouping keys), so its size is
    one row by construction and broadcasting it is always safe.
    """
    return df.crossJoin(F.broadcast(one_row))
