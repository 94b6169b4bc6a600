"""Broadcast a caller's table only after looking at its size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# A calendar of days over several centuries stays below this.
BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else unchanged.

    The count stops at the limit. Without the hint Spark joins by shuffle, or
    decides from run-time sizes. Tables this library derives from a calendar
    (one row per day, month or lookback) are hinted directly instead.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
