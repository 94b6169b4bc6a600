"""Subperiods and agreement across lookbacks (RB1, RB3, JOIN8)."""

from __future__ import annotations

import datetime as dt
from itertools import combinations

from pyspark.sql import DataFrame, Window, functions as F

from ..schemas import LONG_SHORT
from .performance import performance

MIN_ROWS = 12  # fixed value: a half or a pair needs more months than this


def midpoint(start: dt.date, end: dt.date) -> dt.date:
    return start + dt.timedelta(days=(end - start).days // 2)


def subperiod_performance(
    long: DataFrame, start: dt.date, end: dt.date, keys: list[str] | None = None
) -> DataFrame:
    """Full performance set of each half of the period (RB1)."""
    keys = [*(keys or ["lookback", "portfolio"]), "half"]
    half = F.when(F.col("date") <= F.lit(midpoint(start, end)), "first_half").otherwise("second_half")
    rows = long.withColumn("half", half)
    months = F.count(F.lit(1)).over(Window.partitionBy(*keys))  # rows of one half: months
    return performance(rows.withColumn("_m", months).filter(F.col("_m") > MIN_ROWS), keys)


def lookback_correlations(long: DataFrame, lookbacks: list[int]) -> DataFrame:
    """Correlation of the long-short return for every two lookbacks on common dates (RB3).

    One pass sets the lookbacks side by side per date, so no rows are paired.
    """
    names = {lookback: f"lb{lookback}" for lookback in sorted(lookbacks)}
    wide = (
        long.filter(F.col("portfolio") == LONG_SHORT)
        .withColumn("_name", F.concat(F.lit("lb"), F.col("lookback").cast("string")))
        .groupBy("date").pivot("_name", list(names.values())).agg(F.first("ret"))
    )
    pairs = []
    for a, b in combinations(names, 2):
        common = F.col(names[a]).isNotNull() & F.col(names[b]).isNotNull()
        pairs.append(F.struct(
            F.lit(a).alias("lb1"), F.lit(b).alias("lb2"),
            F.count_if(common).alias("n_common"),
            F.corr(names[a], names[b]).alias("correlation"),
        ))
    return (
        wide.agg(F.array(*pairs).alias("pairs"))
        .select(F.inline("pairs"))
        .filter(F.col("n_common") > MIN_ROWS)
    )
