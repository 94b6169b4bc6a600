"""Performance, drawdown and rolling series of monthly portfolio returns (PERF, WIN, SH, SER, RB5).

Inputs are long ``(keys, portfolio, date, ret)`` tables with one row per month,
so windows by portfolio are bounded by the calendar.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.stats import (
    annual_return, annual_vol, compound, kurtosis_sample_sd, monthly_sharpe, ratio,
    skewness_sample_sd,
)
from ..schemas import LONG_SHORT
from .sizing import broadcast_if_small

MIN_MONTHS = 12  # fixed value: fewer months give no ratio


def _path(keys: list[str]):
    return (
        Window.partitionBy(*keys).orderBy("date")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def growth_path(long: DataFrame, keys: list[str]) -> DataFrame:
    """Add compounded growth and cumulative percent return (WIN2, WIN3)."""
    growth = F.product(compound(F.col("ret"))).over(_path(keys))
    return long.withColumn("growth", growth).withColumn("cum_ret", (F.col("growth") - 1) * 100)


def drawdown_series(long: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Distance from the running peak of growth (WIN1, SER4). The peak starts at the first month."""
    keys = keys or ["portfolio"]
    peak = F.max("growth").over(_path(keys))
    path = growth_path(long.filter(F.col("ret").isNotNull()), keys)
    return path.withColumn("drawdown", (F.col("growth") - peak) / peak)


def performance(long: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The full set of measures per group (PERF1-9, AGG6)."""
    keys = keys or ["portfolio"]
    ret = F.col("ret")
    deviation = ret - F.avg("ret").over(Window.partitionBy(*keys))
    rows = drawdown_series(long, keys).withColumn("_below", F.when(deviation < 0, deviation))
    return (
        rows.groupBy(*keys).agg(
            annual_return(ret).alias("annual_return"),
            annual_vol(ret).alias("annual_vol"),
            (F.stddev_samp("_below") * math.sqrt(12)).alias("_below_vol"),
            F.min("drawdown").alias("max_drawdown"),
            skewness_sample_sd(ret).alias("skewness"),
            kurtosis_sample_sd(ret).alias("kurtosis"),
            F.count("ret").alias("n_months"),
        )
        .withColumn("sharpe_ratio", ratio(F.col("annual_return"), F.col("annual_vol")))
        .withColumn("sortino_ratio", ratio(F.col("annual_return"), F.col("_below_vol")))
        .withColumn("calmar_ratio", ratio(F.col("annual_return"), F.abs("max_drawdown")))
        .select(
            *keys, "annual_return", "annual_vol", "sharpe_ratio", "sortino_ratio",
            "max_drawdown", "calmar_ratio", "skewness", "kurtosis", "n_months",
        )
    )


def risk_return_table(long: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Return, volatility and their ratio (SER2, PERF10)."""
    keys = keys or ["portfolio"]
    ret = F.col("ret")
    return long.groupBy(*keys).agg(
        annual_return(ret).alias("annual_return"),
        annual_vol(ret).alias("annual_vol"),
        ratio(annual_return(ret), annual_vol(ret)).alias("sharpe_ratio"),
    )


def dashboard(long: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Monthly mean, deviation and their ratio (RB5)."""
    keys = keys or ["portfolio"]
    ret = F.col("ret")
    return long.groupBy(*keys).agg(
        F.avg(ret).alias("mean_ret"),
        F.stddev_samp(ret).alias("std_ret"),
        monthly_sharpe(ret).alias("sharpe_month"),
    )


def excess_sharpe(long: DataFrame, factors: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sharpe ratio of the return over RF, aligned by date (SH1, SH2).

    NaN below twelve complete months.
    """
    keys = keys or ["portfolio"]
    rf = factors.select("date", "RF")
    excess = (F.col("ret") - F.col("RF")) / 100
    complete = F.col("ret").isNotNull() & F.col("RF").isNotNull()
    rows = long.join(broadcast_if_small(rf), "date").withColumn("_ex", F.when(complete, excess))
    enough = F.count("_ex") >= MIN_MONTHS
    sharpe = monthly_sharpe(F.col("_ex"))

    def gated(value: Column) -> Column:
        return F.when(enough, value).otherwise(F.lit(float("nan")))

    return rows.groupBy(*keys).agg(
        F.count("_ex").alias("n_obs"),
        gated(sharpe).alias("sharpe_monthly"),
        gated(sharpe * math.sqrt(12)).alias("sharpe_annual"),
    )


def rolling_metrics(
    long: DataFrame,
    keys: list[str] | None = None,
    window: int = 12,
    min_values: int = 6,
    min_rows: int = 36,
    skip_first: int = 0,
) -> DataFrame:
    """Annualised Sharpe and volatility of the trailing ``window`` rows (WIN5, SER1).

    Only full windows, and only series with at least ``min_rows`` rows.
    ``skip_first`` drops that many of the earliest full windows; 11 reproduces
    the original's start.
    """
    keys = keys or ["portfolio"]
    ordered = Window.partitionBy(*keys).orderBy("date")
    frame = ordered.rowsBetween(1 - window, 0)
    vol = F.stddev_samp("ret").over(frame) * math.sqrt(12)
    return (
        long
        .withColumn("_row", F.row_number().over(ordered))
        .withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
        .withColumn("_n", F.count("ret").over(frame))
        .withColumn("rolling_vol", vol)
        .withColumn("rolling_sharpe", ratio(F.avg("ret").over(frame) * 12, F.col("rolling_vol")))
        .filter(
            (F.col("_rows") >= min_rows) & (F.col("_row") >= window + skip_first)
            & (F.col("_n") >= min_values)
        )
        .select(*keys, "date", "rolling_sharpe", "rolling_vol")
    )


def rolling_summary(rolling: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean, deviation and range of the rolling Sharpe ratio (RB4)."""
    return rolling.groupBy(*(keys or ["portfolio"])).agg(
        F.count("rolling_sharpe").alias("n_windows"),
        F.avg("rolling_sharpe").alias("mean"),
        F.stddev_samp("rolling_sharpe").alias("std"),
        F.min("rolling_sharpe").alias("min"),
        F.max("rolling_sharpe").alias("max"),
    )


def rolling_long_short(long: DataFrame, keys: list[str], **options) -> DataFrame:
    """Rolling metrics of the long-short series only (RB4)."""
    return rolling_metrics(long.filter(F.col("portfolio") == LONG_SHORT), keys, **options)


def residual_growth(residuals: DataFrame, keys: list[str]) -> DataFrame:
    """Cumulative percent of compounded residuals (WIN4)."""
    series = residuals.withColumnRenamed("resid", "ret")
    return growth_path(series, keys).select(*keys, "date", F.col("ret").alias("resid"), "cum_ret")
