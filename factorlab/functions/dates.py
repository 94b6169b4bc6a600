"""Month arithmetic on DATE columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def month_floor(day: str | Column) -> Column:
    return F.trunc(day, "month").cast("date")


def month_index(day: str | Column) -> Column:
    """Months since year 0, so that frames can say ``RANGE BETWEEN -12 AND -1``."""
    return F.year(day) * 12 + F.month(day) - 1


def day_bit(day: str | Column) -> Column:
    """The day of the month as one bit, so that OR collects the different days of a month."""
    return F.call_function("shiftleft", F.lit(1), F.dayofmonth(day) - 1)


def months_before(day: str | Column, months: int) -> Column:
    return F.add_months(day, -months)


def first_of_month(day: dt.date) -> dt.date:
    return day.replace(day=1)


def shift_months(day: dt.date, months: int) -> dt.date:
    """First of the month ``months`` after the month of ``day``."""
    index = day.year * 12 + day.month - 1 + months
    return dt.date(index // 12, index % 12 + 1, 1)


def in_period(start: dt.date, end: dt.date, column: str = "date") -> Column:
    """Both ends included."""
    return F.col(column).between(F.lit(start), F.lit(end))


def month_grid(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    """One row per month that ``[start, end]`` touches: ``month``, ``month_idx``."""
    grid = F.sequence(
        F.lit(first_of_month(start)), F.lit(first_of_month(end)), F.expr("interval 1 month")
    )
    return (
        spark.range(0, 1, 1, 1)
        .select(F.explode(grid).alias("month"))
        .withColumn("month_idx", month_index("month"))
    )
