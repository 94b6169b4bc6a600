"""Index constituents: comma-joined snapshots in, long membership out (SRC1-2, AGG8, UNI)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.dates import in_period
from ..functions.symbols import clean_symbol, looks_extinct
from ..schemas import CONSTITUENTS_FILE, require_columns


def read_constituents(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Read a ``date,tickers`` file as snapshots ``(date, tickers array)``.

    A missing path fails in the reader; wrong column names fail here.
    """
    raw = (
        spark.read.option("header", True).option("multiLine", True).option("escape", '"')
        .csv(path)
    )
    require_columns(raw, CONSTITUENTS_FILE.names, "constituents file")
    return parse_constituents(raw) if strict else split_constituents(raw)


def split_constituents(raw: DataFrame) -> DataFrame:
    """Plain split on commas, untrimmed (SRC1)."""
    return raw.withColumn("date", F.to_date("date")).withColumn(
        "tickers_array", F.split("tickers", ",")
    )


def parse_constituents(raw: DataFrame) -> DataFrame:
    """Quotes dropped, items trimmed, empty items removed (SRC2)."""
    require_columns(raw, CONSTITUENTS_FILE.names, "constituents table")
    items = F.split(F.regexp_replace("tickers", '"', ""), ",")
    trimmed = F.transform(items, lambda item: F.regexp_replace(item, r"^\s+|\s+$", ""))
    return raw.select(
        F.to_date("date").alias("date"),
        F.filter(trimmed, lambda item: item != "").alias("tickers"),
    )


def constituent_profile(snapshots: DataFrame) -> DataFrame:
    """Period, number of snapshots and mean tickers per snapshot (AGG8)."""
    return snapshots.agg(
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.count("*").alias("n_snapshots"),
        F.bround(F.avg(F.size("tickers")), 1).alias("mean_tickers"),
    )


def explode_members(snapshots: DataFrame, clean: bool = True, cut: bool = False) -> DataFrame:
    """Long membership ``(date, symbol)`` under canonical symbols, without duplicates.

    Long symbols stay whole unless ``cut``: two of them must not become one member.
    """
    raw = snapshots.select("date", F.explode("tickers").alias("symbol"))
    if clean:
        raw = raw.withColumn("symbol", clean_symbol("symbol", cut))
    return raw.distinct()


def universe_for_period(
    membership: DataFrame, start: dt.date, end: dt.date, require_rows: bool = True
) -> DataFrame:
    """Distinct members of any snapshot in the period, sorted (UNI2, SET1, SORT3)."""
    inside = membership.filter(in_period(start, end))
    if require_rows and inside.isEmpty():
        raise ValueError(f"no constituents between {start} and {end}")
    return (
        inside.select("symbol").distinct()
        .withColumn("looks_extinct", looks_extinct("symbol"))
        .orderBy("symbol")
    )


def universe_in_order(membership: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Distinct members with the snapshot they first appear in (UNI1)."""
    return (
        membership.filter(in_period(start, end))
        .groupBy("symbol").agg(F.min("date").alias("first_seen"))
        .orderBy("first_seen", "symbol")
    )


def universe_from_raw(raw: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Universe straight from comma-joined text; NULL lists are skipped (UNI3)."""
    return (
        raw.withColumn("date", F.to_date("date"))
        .filter(in_period(start, end) & F.col("tickers").isNotNull())
        .select(F.explode(F.split("tickers", ",")).alias("symbol"))
        .select(F.regexp_replace("symbol", r"^\s+|\s+$", "").alias("symbol"))
        .distinct().orderBy("symbol")
    )


def custom_universe(symbols: DataFrame, clean: bool = True, cut: bool = False) -> DataFrame:
    """A caller's own one-column list in place of the index (UNI4); long symbols stay whole unless ``cut``."""
    column = symbols.columns[0]
    chosen = clean_symbol(column, cut) if clean else F.col(column)
    return symbols.select(chosen.alias("symbol")).distinct()


def first_symbols(universe: DataFrame, max_tickers: int) -> DataFrame:
    """The first ``max_tickers`` symbols in sorted order (LIM1)."""
    return universe.orderBy("symbol").limit(max_tickers)


def snapshot_intervals(membership: DataFrame) -> DataFrame:
    """Each snapshot date with the next one: valid from ``snapshot_date`` until ``next_date``.

    One row per snapshot date, so the window holds a calendar, not the panel.
    """
    dates = membership.select(F.col("date").alias("snapshot_date")).distinct()
    return dates.withColumn(
        "next_date", F.lead("snapshot_date").over(Window.orderBy("snapshot_date"))
    )
