"""Monthly and daily returns on long price panels (RET1-2, AGG1, JOIN6-7, SC6, RSH1)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ..functions.dates import (
    first_of_month, in_period, month_floor, month_grid, month_index,
)
from ..functions.stats import pct_change

def _by_month() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("month_idx")


def month_buckets(
    prices: DataFrame, start: dt.date, end: dt.date, carry: list[Column] | None = None
) -> DataFrame:
    """Days, first and last price of each ticker and month (AGG1, FLT2), one row a day given.

    Months combine before they shuffle: a store sorted by ticker sends about one
    row per ticker and month, and no ticker can crowd a task. ``carry`` adds
    aggregates of other columns of the price table to the same pass.
    :func:`factorlab.sources.prices.stored_months` is for panels with repeated days.
    """
    return (
        prices.filter(in_period(start, end))
        .groupBy("ticker", month_floor("date").alias("month"))
        .agg(
            F.count("price").cast("int").alias("n_days"),
            F.min_by("price", "date").alias("first_price"),
            F.max_by("price", "date").alias("last_price"),
            F.min("date").alias("first_day"),
            F.max("date").alias("last_day"),
            *(carry or []),
        )
        .withColumn("month_idx", month_index("month"))
    )


def monthly_returns(
    prices: DataFrame,
    start: dt.date,
    end: dt.date,
    min_days: int = 5,
    drop_last_month: bool = True,
    carry: list[Column] | None = None,
) -> DataFrame:
    """Percent return of each traded month (RET1).

    A month with fewer than ``min_days`` days has no return, and neither has the
    last month of the grid while ``drop_last_month`` holds. The base is the last
    price of the calendar month before, else the month's own first price.
    """
    return returns_of_months(month_buckets(prices, start, end, carry), end, min_days, drop_last_month)


def returns_of_months(
    buckets: DataFrame, end: dt.date, min_days: int = 5, drop_last_month: bool = True
) -> DataFrame:
    """:func:`monthly_returns` of ready month buckets."""
    adjacent = F.lag("month_idx").over(_by_month()) == F.col("month_idx") - 1
    base = F.coalesce(
        F.when(adjacent, F.lag("last_price").over(_by_month())), F.col("first_price")
    )
    has_return = F.col("n_days") >= min_days
    if drop_last_month:
        has_return &= F.col("month") < F.lit(first_of_month(end))
    return buckets.withColumn("ret", F.when(has_return, pct_change(F.col("last_price"), base)))


def dense_months(monthly: DataFrame, end: dt.date, tail: int = 0) -> DataFrame:
    """Fill the months a ticker skips with NULL returns, without a join.

    Each row unpacks the months up to the ticker's next one. The last row goes on
    for ``tail`` months, at most to the end of the grid.
    """
    final = end.year * 12 + end.month - 1
    whole = Window.partitionBy("ticker")
    until = F.coalesce(
        F.lead("month_idx").over(_by_month()),
        F.least(F.col("month_idx") + tail, F.lit(final)) + 1,
    )
    return (
        monthly
        .withColumn("data_start", F.min("first_day").over(whole))
        .withColumn("data_end", F.max("last_day").over(whole))
        .withColumn("_until", until)
        .withColumn("_step", F.explode(F.sequence(F.lit(0), F.col("_until") - F.col("month_idx") - 1)))
        .select(
            "ticker",
            F.add_months("month", F.col("_step")).alias("month"),
            (F.col("month_idx") + F.col("_step")).alias("month_idx"),
            F.when(F.col("_step") == 0, F.col("ret")).alias("ret"),
            "data_start", "data_end",
        )
    )


def trading_calendar(prices: DataFrame) -> DataFrame:
    """Distinct trading days numbered from 1 (SET5); one row per calendar day."""
    days = prices.select("date").distinct()
    return days.withColumn("cal_idx", F.row_number().over(Window.orderBy("date")))


def daily_returns(prices: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """Percent return against the trading day right before, else NULL (RET2, JOIN7)."""
    calendar = trading_calendar(prices) if calendar is None else calendar
    by_day = Window.partitionBy("ticker").orderBy("cal_idx")
    adjacent = F.lag("cal_idx").over(by_day) == F.col("cal_idx") - 1
    before = F.when(adjacent, F.lag("price").over(by_day))
    return (
        prices.select("ticker", "date", "price")
        .join(F.broadcast(calendar), "date")  # one row per day of history
        .withColumn("ret", pct_change(F.col("price"), before))
        .select("ticker", *calendar.columns, "price", "ret")
    )


def returns_wide(monthly: DataFrame, tickers: list[str], start: dt.date, end: dt.date) -> DataFrame:
    """One row per month of the grid, one column per named ticker (RSH1)."""
    grid = month_grid(monthly.sparkSession, start, end).select("month")
    wide = monthly.groupBy("month").pivot("ticker", tickers).agg(F.first("ret", ignorenulls=True))
    return grid.join(wide, "month", "left").withColumnRenamed("month", "date")


def returns_long(wide: DataFrame) -> DataFrame:
    """Inverse of :func:`returns_wide`: every column but the first is a ticker (RSH1)."""
    date, *tickers = wide.columns
    return wide.unpivot([date], tickers, "ticker", "ret").withColumnRenamed(date, "month")

