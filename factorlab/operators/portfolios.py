"""Volatility-sorted portfolios (PF1-3, AGG2, AGG12-13, TOPK1, SORT2)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import first_of_month, month_grid, shift_months
from ..functions.stats import annual_return, annual_vol, at_least, ratio
from ..schemas import LONG_SHORT, PORTFOLIOS, QUINTILES
from ..sources.constituents import first_symbols, universe_for_period, universe_in_order
from ..sources.prices import sound_prices, stored_months
from ..staging import stage
from .ranking import rank_within
from .returns import dense_months, month_buckets, returns_of_months
from .signals import vol_at_formation, vol_daily, vol_monthly, formation_months
from .universe import asof_snapshots, snapshots_of_ticker

BY_VOL = ["vol", "ticker"]  # ticker settles equal volatilities


# ---- lowest and highest n (PF1) -------------------------------------------

def extreme_portfolios(
    monthly: DataFrame, start: dt.date, end: dt.date, window: int = 12, size: int = 20
) -> DataFrame:
    """Equal-weighted return of the ``size`` calmest and wildest tickers per month (PF1).

    Every grid month with a full window behind it appears. Its values are NULL
    when fewer than ``2 * size`` tickers have a signal or a side has no return.
    """
    spark = monthly.sparkSession
    signals = stage(
        vol_monthly(dense_months(monthly, end, tail=window), start, window)
        .select("month", "ticker", "vol", "ret"),
        "extremes",
    )
    counts = signals.groupBy("month").agg(F.count("*").alias("n"))  # one row per month
    placed = (
        rank_within(signals, ["month"], BY_VOL)
        .join(F.broadcast(counts), "month")
        .filter(F.col("n") >= 2 * size)
    )
    low = F.avg(F.when(F.col("rn") <= size, F.col("ret")))
    high = F.avg(F.when(F.col("rn") > F.col("n") - size, F.col("ret")))
    sides = placed.groupBy("month").agg(low.alias("_low"), high.alias("_high"))
    both = F.col("_low").isNotNull() & F.col("_high").isNotNull()
    months = month_grid(spark, start, end).filter(F.col("month") >= F.lit(shift_months(start, window)))
    return (
        months.join(sides, "month", "left")
        .select(
            F.col("month").alias("date"),
            F.when(both, F.col("_low")).alias("LOW"),
            F.when(both, F.col("_high")).alias("HIGH"),
            (F.col("_low") - F.col("_high")).alias("LONG_SHORT"),
        )
    )


# ---- quintiles ------------------------------------------------------------

def quintile(rank: Column, n: Column) -> Column:
    """Equal groups of ``n // 5``; the remainder, the highest ranks, gets no group."""
    group = F.floor((rank - 1) / F.floor(n / 5)) + 1
    return F.when(group <= 5, group.cast("int"))


def assign_quintiles(
    signals: DataFrame, sizes: DataFrame, keys: list[str], min_per_quintile: int
) -> DataFrame:
    """Rows of staged ``signals`` that fall in a quintile, with ``quintile`` 1..5 (SORT2).

    ``sizes`` holds ``n_vol`` per key: one row per month and lookback.
    """
    return (
        rank_within(signals, keys, BY_VOL)
        .join(F.broadcast(sizes), keys)
        .filter(F.col("n_vol") >= 5 * min_per_quintile)
        .withColumn("quintile", quintile(F.col("rn"), F.col("n_vol")))
        .filter(F.col("quintile").isNotNull())
    )


def quintile_means(members: DataFrame, keys: list[str], ret: str) -> DataFrame:
    """Equal-weighted return over members that have one, with counts (AGG2)."""
    return members.groupBy(*keys, "quintile").agg(
        F.avg(ret).alias("ret"),
        F.count("*").alias("n_members"),
        F.count(ret).alias("n_valid"),
    )


def side_by_side(means: DataFrame, keys: list[str], keep: Column | bool = True) -> DataFrame:
    """P1..P5 and the long-short return on one row per key, only if all five are kept."""
    kept = F.when(F.lit(True) if keep is True else keep, F.col("ret"))
    wide = means.groupBy(*keys).agg(*[
        F.max(F.when(F.col("quintile") == q, kept)).alias(name)
        for q, name in enumerate(QUINTILES, start=1)
    ])
    return wide.dropna(subset=QUINTILES).withColumn(LONG_SHORT, F.col("P1") - F.col("P5"))


def portfolios_long(wide: DataFrame) -> DataFrame:
    """``(keys, date, portfolio, ret)`` from the wide form (D8)."""
    keys = [c for c in wide.columns if c not in PORTFOLIOS]
    return wide.unpivot(keys, PORTFOLIOS, "portfolio", "ret")


def portfolios_wide(long: DataFrame) -> DataFrame:
    """The six series side by side, for files and charts."""
    keys = [c for c in long.columns if c not in ("portfolio", "ret")]
    return long.groupBy(*keys).pivot("portfolio", PORTFOLIOS).agg(F.first("ret"))


def quintiles_basic(
    monthly: DataFrame,
    start: dt.date,
    end: dt.date,
    method: str = "monthly12",
    prices: DataFrame | None = None,
    min_obs: int = 12,
    min_per_quintile: int = 5,
    window_days: int = 252,
) -> DataFrame:
    """Quintiles over all tickers that have a signal (PF2), wide.

    ``monthly12`` uses the twelve months before the return's month; ``daily252``
    the trading days before its first day, and needs ``prices``.
    """
    if method == "daily252":
        if prices is None:
            raise ValueError("method daily252 needs prices")
        months = month_grid(monthly.sparkSession, start, end).select(F.col("month").alias("formation"))
        signals = vol_daily(prices, months, window_days, min_obs).join(
            monthly.select("ticker", F.col("month").alias("formation"), "ret"),
            ["ticker", "formation"], "left",
        ).withColumnRenamed("formation", "month")
    elif method == "monthly12":
        signals = vol_monthly(dense_months(monthly, end, tail=12), start, 12, min_obs)
    else:
        raise ValueError(f"unknown method {method}")
    signals = stage(signals.select("month", "ticker", "vol", "ret"), "quintiles")
    sizes = signals.groupBy("month").agg(F.count("*").alias("n_vol"))
    members = assign_quintiles(signals, sizes, ["month"], min_per_quintile)
    means = quintile_means(members, ["month"], "ret")
    return side_by_side(means, ["month"]).withColumnRenamed("month", "date")


# ---- point-in-time quintiles (PF3) ----------------------------------------

def eligible_signals(
    monthly: DataFrame,
    start: dt.date,
    end: dt.date,
    membership: DataFrame | None,
    lookbacks: list[int],
    min_coverage: float,
    method: str = "monthly12",
    prices: DataFrame | None = None,
    window_days: int = 252,
) -> DataFrame:
    """Every eligible ticker per lookback and formation with its signal, or NULL (ELG3, VOL3, JOIN4).

    Membership joins on ticker, where the panel already is, and the as-of snapshot
    is looked up on the formation calendar.
    """
    spark = monthly.sparkSession
    formations = formation_months(spark, start, end, min(lookbacks))
    history = vol_at_formation(dense_months(monthly, end), start, end, lookbacks, min_coverage)
    if method == "daily252":
        if prices is None:
            raise ValueError("method daily252 needs prices")
        daily = vol_daily(prices, formations, window_days, at_least(window_days, min_coverage))
        history = history.drop("vol", "n_obs").join(daily, ["ticker", "formation"], "left")
    elif method != "monthly12":
        raise ValueError(f"unknown method {method}")
    if membership is not None:
        calendar = F.broadcast(asof_snapshots(membership, formations))  # one row per formation
        history = (
            history.join(calendar, "formation")
            .join(snapshots_of_ticker(membership, formations), "ticker")
            .filter(F.array_contains("member_of", F.col("snapshot_date")))
        )
    return history.select("lookback", "formation", "ticker", "vol", "n_obs", "hold_ret")


def pti_outcomes(
    monthly: DataFrame,
    start: dt.date,
    end: dt.date,
    membership: DataFrame | None = None,
    lookbacks: list[int] | None = None,
    min_coverage: float = 0.7,
    min_per_quintile: int = 5,
    method: str = "monthly12",
    prices: DataFrame | None = None,
    window_days: int = 252,
) -> DataFrame:
    """One row per lookback and holding month with its ``outcome`` and, if processed, the returns.

    Outcomes: ``processed``, ``few_eligible``, ``few_volatilities``,
    ``low_coverage`` (AGG12). The table has a row per calendar month, so all
    later steps work on a handful of rows.
    """
    lookbacks = lookbacks or [12]
    keys = ["lookback", "formation"]
    spark = monthly.sparkSession
    eligible = stage(
        eligible_signals(
            monthly, start, end, membership, lookbacks, min_coverage, method, prices, window_days
        ).drop("n_obs"),
        "eligible",
    )
    sizes = eligible.groupBy(*keys).agg(
        F.count("*").alias("n_eligible"), F.count("vol").alias("n_vol")
    )
    # A month with too few eligible tickers forms nothing, whatever its signals.
    enough = sizes.filter(F.col("n_eligible") >= 5 * min_per_quintile)
    members = assign_quintiles(
        eligible.filter(F.col("vol").isNotNull()), enough, keys, min_per_quintile
    )
    means = quintile_means(members, keys, "hold_ret")
    covered = F.col("n_valid") >= F.ceil(F.col("n_members") * min_coverage)
    wide = side_by_side(means, keys, covered)

    grid = formation_months(spark, start, end, min(lookbacks)).withColumn(
        "lookback", F.explode(F.array(*map(F.lit, lookbacks)))
    ).filter(
        F.col("formation") >= F.add_months(F.lit(first_of_month(start)), F.col("lookback"))
    )
    n_eligible = F.coalesce("n_eligible", F.lit(0))
    n_vol = F.coalesce("n_vol", F.lit(0))
    outcome = (
        F.when(n_eligible < 5 * min_per_quintile, "few_eligible")
        .when(n_vol < 5 * min_per_quintile, "few_volatilities")
        .when(F.col("P1").isNull(), "low_coverage")
        .otherwise("processed")
    )
    return (
        grid.join(sizes, keys, "left").join(wide, keys, "left")
        .select(
            "lookback", F.add_months("formation", 1).alias("date"), outcome.alias("outcome"),
            n_eligible.alias("n_eligible"), n_vol.alias("n_vol"), *PORTFOLIOS,
        )
    )


def quintiles_pti(monthly: DataFrame, start: dt.date, end: dt.date, **options) -> DataFrame:
    """Point-in-time quintiles (PF3), wide: lookback, date, P1..P5, LowMinusHigh."""
    return processed_months(pti_outcomes(monthly, start, end, **options))


def processed_months(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter(F.col("outcome") == "processed").select("lookback", "date", *PORTFOLIOS)


def skip_reasons(outcomes: DataFrame) -> DataFrame:
    """Months per outcome (AGG12)."""
    return outcomes.groupBy("lookback", "outcome").agg(F.count("*").alias("n_months"))


def processing_rate(outcomes: DataFrame) -> DataFrame:
    """Processed over all months in percent (AGG12)."""
    done = F.count_if(F.col("outcome") == "processed")
    return outcomes.groupBy("lookback").agg(
        done.alias("processed"),
        F.count_if(F.col("outcome") != "processed").alias("skipped"),
        F.bround(F.try_divide(done, F.count("*")) * 100, 1).alias("success_rate"),
    )


def quintile_statistics(long: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Monthly and annualised mean and deviation per portfolio (AGG13)."""
    ret = F.col("ret")
    return long.groupBy(*(keys or []), "portfolio").agg(
        F.avg(ret).alias("mean_month"),
        F.stddev_samp(ret).alias("vol_month"),
        annual_return(ret).alias("mean_year"),
        annual_vol(ret).alias("vol_year"),
        ratio(annual_return(ret), annual_vol(ret)).alias("sharpe"),
    )


# ---- from prices to portfolios (PF4, PF5) ---------------------------------

def quintiles_from_prices(
    prices: DataFrame,
    membership: DataFrame,
    start: dt.date,
    end: dt.date,
    min_coverage: float = 0.7,
    min_per_quintile: int = 8,
    max_tickers: int | None = None,
    method: str = "monthly12",
    one_a_day: bool = False,
    **options,
) -> DataFrame:
    """Universe, returns and point-in-time quintiles in one call (PF4).

    All symbols take part; ``max_tickers`` keeps the first of the sorted universe.
    ``one_a_day`` is the promise of :func:`factorlab.sources.prices.stored_months`.
    """
    universe = universe_for_period(membership, start, end)
    if max_tickers is not None:
        universe = first_symbols(universe, max_tickers)
    chosen = prices.join(universe.select(F.col("symbol").alias("ticker")), "ticker", "left_semi")
    daily = None if method == "monthly12" else stage(sound_prices(chosen), "chosen")
    buckets = stored_months(chosen, start, end, one_a_day) if daily is None else month_buckets(daily, start, end)
    return quintiles_pti(
        returns_of_months(buckets, end), start, end, membership=membership, prices=daily,
        min_coverage=min_coverage, min_per_quintile=min_per_quintile, method=method, **options,
    )


def extremes_from_prices(
    prices: DataFrame,
    membership: DataFrame,
    start: dt.date,
    end: dt.date,
    max_tickers: int | None = None,
    size: int = 20,
    one_a_day: bool = False,
) -> DataFrame:
    """Universe, returns and extreme portfolios in one call (PF5).

    All symbols take part; ``max_tickers`` keeps the first in order of appearance.
    ``one_a_day`` is the promise of :func:`factorlab.sources.prices.stored_months`.
    """
    universe = universe_in_order(membership, start, end)
    if max_tickers is not None:
        universe = universe.limit(max_tickers)
    chosen = prices.join(universe.select(F.col("symbol").alias("ticker")), "ticker", "left_semi")
    return extreme_portfolios(returns_of_months(stored_months(chosen, start, end, one_a_day), end), start, end, size=size)
