"""Point-in-time membership and eligibility for all formation dates at once (JOIN2-3, ELG, AGG4-5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.dates import day_bit, month_floor, months_before
from ..sources.prices import validity
from .sizing import broadcast_if_small


def asof_snapshots(membership: DataFrame, formations: DataFrame) -> DataFrame:
    """Latest snapshot dated on or before each formation (JOIN2, TOPK2).

    Works on the two calendars only: a few thousand rows whatever the panel is.
    Formations before the first snapshot are absent from the result.
    """
    snapshots = membership.select(
        F.col("date").alias("day"), F.lit(0).alias("kind"), F.col("date").alias("snapshot_date")
    ).distinct()
    wanted = formations.select(
        F.col("formation").alias("day"), F.lit(1).alias("kind"),
        F.lit(None).cast("date").alias("snapshot_date"),
    ).distinct()
    so_far = Window.orderBy("day", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return (
        snapshots.unionByName(wanted)
        .withColumn("snapshot_date", F.last("snapshot_date", ignorenulls=True).over(so_far))
        .filter((F.col("kind") == 1) & F.col("snapshot_date").isNotNull())
        .select(F.col("day").alias("formation"), "snapshot_date")
    )


def members_asof(
    membership: DataFrame, formations: DataFrame, available: DataFrame | None = None
) -> DataFrame:
    """Members at each formation, kept where ``available`` has the ticker (ELG1, SET2)."""
    calendar = F.broadcast(asof_snapshots(membership, formations))  # one row per formation
    members = (
        membership.withColumnRenamed("date", "snapshot_date")
        .join(calendar, "snapshot_date")
        .select("formation", "snapshot_date", F.col("symbol").alias("ticker"))
    )
    if available is not None:
        members = members.join(available.select("ticker"), "ticker", "left_semi")
    return members.select("formation", "snapshot_date", "ticker")


def snapshots_of_ticker(membership: DataFrame, formations: DataFrame) -> DataFrame:
    """Per ticker the set of snapshots it belongs to, among those some formation uses.

    The set holds at most one date per formation, so the panel can be matched to
    its membership by a join on ticker alone, which keeps it where it is.
    """
    used = F.broadcast(asof_snapshots(membership, formations).select("snapshot_date").distinct())
    return (
        membership.withColumnRenamed("date", "snapshot_date")
        .join(used, "snapshot_date", "left_semi")
        .groupBy(F.col("symbol").alias("ticker"))
        .agg(F.collect_set("snapshot_date").alias("member_of"))
    )


def valid_tickers(
    prices: DataFrame,
    formations: DataFrame,
    membership: DataFrame | None = None,
    min_lookback_months: int = 6,
) -> DataFrame:
    """Tickers with enough history at each formation, and members if asked (ELG2, ELG3, JOIN3).

    History: the first price is at least ``min_lookback_months`` before the
    formation and the last price is not before the formation's month.
    """
    spans = validity(prices).drop("n_rows")
    enough = (
        (F.col("data_start") <= months_before("formation", min_lookback_months))
        & (F.col("data_end") >= month_floor("formation"))
    )
    if membership is not None:
        return (
            members_asof(membership, formations).join(spans, "ticker").filter(enough)
            .select("formation", "ticker", "data_start", "data_end")
        )
    # Months a ticker can qualify for, then matched to the formations by month.
    months = F.sequence(
        F.add_months(month_floor("data_start"), min_lookback_months),
        month_floor("data_end"), F.expr("interval 1 month"),
    )
    reachable = F.add_months(month_floor("data_start"), min_lookback_months) <= F.col("data_end")
    calendar = formations.select("formation", month_floor("formation").alias("month"))
    return (
        spans.filter(reachable).withColumn("month", F.explode(months))
        .join(broadcast_if_small(calendar), "month")
        .filter(enough)
        .select("formation", "ticker", "data_start", "data_end")
    )


def gap_summaries(prices: DataFrame) -> DataFrame:
    """Per ticker and month: rows, first and last day, largest gap between days inside (WIN6).

    The days of a month are bits of one number, which merges by OR; so months
    combine before they shuffle and repeated days fall together by themselves.
    """
    months = prices.filter(F.col("date").isNotNull()).groupBy("ticker", month_floor("date").alias("month")).agg(
        F.count("*").alias("n"), F.bit_or(day_bit("date")).alias("days")
    )
    traded = F.filter(
        F.sequence(F.lit(1), F.lit(31)), lambda d: F.col("days").bitwiseAND(F.call_function("shiftleft", F.lit(1), d - 1)) != 0
    )
    return months.withColumn("traded", traded).select(
        "ticker", "month", "n",
        F.date_add("month", F.element_at("traded", 1) - 1).alias("first_day"),
        F.date_add("month", F.element_at("traded", -1) - 1).alias("last_day"),
        F.array_max(F.zip_with(
            F.slice("traded", 2, 31), F.slice("traded", 1, F.size("traded") - 1), lambda later, day: later - day
        )).alias("gap"),
    )


def validity_metadata(prices: DataFrame) -> DataFrame:
    """Span, observations and gaps of each ticker (AGG4, WIN6); gaps NULL for one row.

    Month summaries are combined in order: the window sees a row per ticker and
    month, however many days or rows a ticker has. The mean gap needs no window: the
    gaps add up to the span.
    """
    between = F.datediff("first_day", F.lag("last_day").over(Window.partitionBy("ticker").orderBy("month")))
    spans = gap_summaries(prices).withColumn("gap", F.greatest("gap", between)).groupBy("ticker").agg(
        F.min("first_day").alias("data_start"),
        F.max("last_day").alias("data_end"),
        F.sum("n").alias("total_observations"),
        F.max("gap").alias("max_gap"),
    )
    duration = F.datediff("data_end", "data_start")
    repeated = F.when(F.col("total_observations") > 1, F.coalesce("max_gap", F.lit(0)))
    return spans.select(
        "ticker", "data_start", "data_end", "total_observations",
        duration.alias("duration_days"),
        F.bround(duration / 365.25, 2).alias("duration_years"),
        repeated.alias("max_gap_days"),
        F.bround(F.try_divide(duration, F.col("total_observations") - 1), 1).alias("avg_gap_days"),
    )


def ticker_validity(prices: DataFrame, ticker: str) -> DataFrame:
    """First and last day of one ticker; no row when it has no prices (AGG5)."""
    return validity(prices.filter(F.col("ticker") == ticker)).drop("n_rows")
