"""Volatility signals (VOL1-4, FLT5)."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.dates import first_of_month, month_grid, shift_months
from ..functions.stats import at_least
from ..staging import stage
from .returns import daily_returns, trading_calendar

# Volatilities are compared at this many decimals, so that the order of a
# cross-section does not depend on the order in which sums were formed.
VOL_DECIMALS = 9


def trailing_vol(panel: DataFrame, first: int, last: int) -> DataFrame:
    """Add ``vol`` and ``n_obs`` over months ``[i+first, i+last]`` of a dense panel."""
    frame = Window.partitionBy("ticker").orderBy("month_idx").rangeBetween(first, last)
    return panel.withColumn("vol", F.round(F.stddev_samp("ret").over(frame), VOL_DECIMALS)).withColumn(
        "n_obs", F.count("ret").over(frame).cast("int")
    )


def vol_monthly(
    panel: DataFrame, start: dt.date, window: int = 12, min_obs: int | None = None
) -> DataFrame:
    """Deviation of the ``window`` months before each month (VOL1; VOL2 with ``min_obs``).

    Kept from the first month that has a full window behind it on the grid, and
    where at least 70 % of ``min_obs`` (by default of ``window``) are observed.
    """
    needed = (window if min_obs is None else min_obs) * 0.7
    return trailing_vol(panel, -window, -1).filter(
        (F.col("month") >= F.lit(shift_months(start, window)))
        & (F.col("n_obs") >= needed)
        & F.col("vol").isNotNull()
    )


def vol_at_formation(
    panel: DataFrame, start: dt.date, end: dt.date, lookbacks: list[int], min_coverage: float
) -> DataFrame:
    """Signal, holding return and history test per lookback and formation month (VOL3, JOIN3, JOIN5).

    The window is the formation month and ``lookback`` months before it. ``vol``
    is NULL below ``ceil(lookback * min_coverage)`` observations. ``hold_ret`` is
    the return of the next month. Rows lack tickers whose prices start too late.
    All lookbacks share one pass over the panel.
    """
    ordered = Window.partitionBy("ticker").orderBy("month_idx")
    hold = F.lead("ret").over(ordered)
    signals = []
    for lookback in lookbacks:
        frame = ordered.rangeBetween(-lookback, 0)
        n_obs = F.count("ret").over(frame).cast("int")
        enough = n_obs >= at_least(lookback, min_coverage)
        vol = F.when(enough, F.round(F.stddev_samp("ret").over(frame), VOL_DECIMALS))
        panel = panel.withColumn(f"_vol{lookback}", vol).withColumn(f"_n{lookback}", n_obs)
        signals.append(F.struct(
            F.lit(lookback).alias("lookback"),
            F.col(f"_vol{lookback}").alias("vol"),
            F.col(f"_n{lookback}").alias("n_obs"),
            F.lit(shift_months(start, lookback)).alias("first_formation"),
        ))
    return (
        panel.withColumn("hold_ret", hold)
        .filter(
            (F.col("month") < F.lit(first_of_month(end)))
            & (F.col("data_end") >= F.col("month"))
        )
        .withColumn("signal", F.explode(F.array(*signals)))
        .select(
            F.col("signal.lookback").alias("lookback"), F.col("month").alias("formation"),
            "ticker", F.col("signal.vol").alias("vol"), F.col("signal.n_obs").alias("n_obs"),
            "hold_ret", "data_start", "data_end", "signal.first_formation",
        )
        .filter(
            (F.col("formation") >= F.col("first_formation"))
            & (F.col("data_start") <= F.add_months("formation", -F.col("lookback")))
        )
        .drop("first_formation")
    )


def formation_blocks(
    calendar: DataFrame, formations: DataFrame, window_days: int
) -> tuple[DataFrame, DataFrame]:
    """The calendar cut into blocks at the edges of all windows, and the formations of each block.

    A formation is anchored at its first trading day on or after it, and counts
    only when more than ``window_days`` trading days precede the anchor. Its window
    is a run of whole blocks. Returns ``(date, cal_idx, block)`` and ``(block,
    formations)``, both as small as a calendar.
    """
    marks = formations.select(F.col("formation").alias("date"), "formation", F.lit(0).alias("kind"))
    days = calendar.select(
        "date", F.lit(None).cast("date").alias("formation"), F.lit(1).alias("kind"), "cal_idx"
    )
    onward = Window.orderBy("date", "kind").rowsBetween(0, Window.unboundedFollowing)
    anchors = (
        marks.withColumn("cal_idx", F.lit(None).cast("int")).unionByName(days)
        .withColumn("anchor", F.first("cal_idx", ignorenulls=True).over(onward))
        .filter((F.col("kind") == 0) & (F.col("anchor") > window_days))
        .select("formation", "anchor").distinct()
    )
    edges = anchors.select(
        F.explode(F.array(F.col("anchor") - window_days, F.col("anchor"))).alias("cal_idx")
    ).distinct().withColumn("edge", F.row_number().over(Window.orderBy("cal_idx")))
    so_far = Window.orderBy("cal_idx").rowsBetween(Window.unboundedPreceding, 0)
    blocked = calendar.join(F.broadcast(edges), "cal_idx", "left").withColumn(
        "block", F.coalesce(F.last("edge", ignorenulls=True).over(so_far), F.lit(0))
    ).select("date", "cal_idx", "block")
    begins = edges.select((F.col("cal_idx") + window_days).alias("anchor"), F.col("edge").alias("low"))
    ends = edges.select(F.col("cal_idx").alias("anchor"), (F.col("edge") - 1).alias("high"))
    inside = anchors.join(begins, "anchor").join(ends, "anchor").select(
        "formation", F.explode(F.sequence("low", "high")).alias("block")
    )
    return blocked, inside.groupBy("block").agg(F.collect_list("formation").alias("formations"))


def vol_daily(
    prices: DataFrame, formations: DataFrame, window_days: int = 252, min_obs: int = 180
) -> DataFrame:
    """Annualised deviation of the ``window_days`` trading days before each formation (VOL4).

    In two levels: count, mean and squared deviations of each ticker and block of
    days between window edges, then the blocks of a window merged by the parallel
    variance formula. A daily row is read once, and only its block (about two a
    month) is sent to the windows it belongs to. Tickers that do not trade on the
    anchor day still count.
    """
    calendar, inside = formation_blocks(stage(trading_calendar(prices), "calendar"), formations, window_days)
    blocks = (
        daily_returns(prices, calendar)
        .filter(F.col("ret").isNotNull())
        .groupBy("ticker", "block")
        .agg(
            F.count("ret").alias("n"), F.avg("ret").alias("mean"),
            (F.var_pop("ret") * F.count("ret")).alias("squares"),
        )
    )
    merged = (
        blocks.join(F.broadcast(inside), "block")  # one row per block of the calendar
        .select("ticker", "n", "mean", "squares", F.explode("formations").alias("formation"))
        .groupBy("ticker", "formation")
        .agg(F.sum("n").alias("n"), F.collect_list(F.struct("n", "mean", "squares")).alias("parts"))
    )
    centre = F.aggregate("parts", F.lit(0.0), lambda total, p: total + p["n"] * p["mean"]) / F.col("n")
    squares = F.aggregate(
        "parts", F.lit(0.0),
        lambda total, p: total + p["squares"] + p["n"] * (p["mean"] - F.col("centre")) * (p["mean"] - F.col("centre")),
    )
    return (
        merged.withColumn("centre", centre)
        .select(
            "ticker", "formation",
            F.round(F.sqrt(F.try_divide(squares, F.col("n") - 1)) * math.sqrt(252), VOL_DECIMALS).alias("vol"),
            F.col("n").cast("int").alias("n_obs"),
        )
        .filter((F.col("n_obs") >= min_obs) & F.col("vol").isNotNull())
    )


def formation_months(spark: SparkSession, start: dt.date, end: dt.date, skip: int) -> DataFrame:
    """Formation months of the grid, from ``skip`` months in, the last month excluded."""
    return month_grid(spark, start, end).filter(
        (F.col("month") >= F.lit(shift_months(start, skip)))
        & (F.col("month") < F.lit(first_of_month(end)))
    ).select(F.col("month").alias("formation"))
