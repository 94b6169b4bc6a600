"""Price store: file sources, ingest rules, coverage and source priority (SRC3-6, SNK1, DED1, JOIN11).

A study on monthly returns never moves daily rows: stored symbols are reduced to one
row a month first (:func:`stored_months`, whose aggregates need no row twice and drop
repeated quotes by themselves), and which symbol serves which ticker is decided
on those rows (:func:`acquire_months`).
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.dates import day_bit, in_period, month_floor, month_index
from ..functions.symbols import resolve_symbols
from ..operators.returns import month_buckets
from ..operators.sizing import BROADCAST_ROWS
from ..schemas import PRICE_FILE
from ..staging import release, stage


def read_price_files(spark: SparkSession, directory: str) -> DataFrame:
    """All ``<ticker>.csv`` files of a directory in one scan (SRC3)."""
    ticker = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1)
    return (
        spark.read.schema(PRICE_FILE).option("header", True)
        .option("pathGlobFilter", "*.csv").csv(directory)
        .select(F.url_decode(ticker).alias("ticker"), "date", "price")
    )


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet price store that :func:`write_prices` leaves behind."""
    return spark.read.parquet(path).select("ticker", "date", "price")


def write_prices(prices: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Persist the store (SNK1): ranges of tickers per file, sorted inside.

    Row-group statistics on ``ticker`` and ``date`` then prune by symbol and by
    period, and the number of files follows the data, not the symbol count.
    """
    (
        prices.repartitionByRange("ticker", "date")
        .sortWithinPartitions("ticker", "date")
        .write.mode(mode).parquet(path)
    )


def write_price_directories(prices: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One directory per ticker, as CSV, for tools that look symbols up by name (SNK1).

    Ranges of tickers and days share the writing: small tickers go out together, a
    large one from several tasks, each adding a file to its directory.
    """
    (
        prices.select("ticker", "date", "price").repartitionByRange("ticker", "date").sortWithinPartitions("ticker", "date")
        .write.mode(mode).option("header", True).partitionBy("ticker").csv(path)
    )


def read_price_directories(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`write_price_directories` leaves; a filter on ``ticker`` reads its directory only (SRC3)."""
    prices = spark.read.schema("date date, price double, ticker string").option("header", True).csv(path)
    return prices.select("ticker", "date", "price")


def one_price_per_day(prices: DataFrame, arrival: str | None = None) -> DataFrame:
    """One row per ticker and day (DED1): the earliest by ``arrival``, else the lowest price.

    The aggregate combines before it shuffles, so a ticker with a large share of
    the rows reaches the next stage as at most one row per calendar day.
    """
    first = F.min_by("price", arrival) if arrival else F.min("price")
    return prices.groupBy("ticker", "date").agg(first.alias("price"))


def sound_prices(prices: DataFrame) -> DataFrame:
    """What every study reads: a price of each ticker and day, without missing ones (DED1).

    A day without a price is as if it had not been delivered, so that a month's
    last day may lack one without the month losing its return.
    """
    return one_price_per_day(prices.where(F.col("price").isNotNull()))


def stored_months(prices: DataFrame, start: dt.date, end: dt.date, one_a_day: bool = False) -> DataFrame:
    """Month buckets of a panel in which days may repeat or lack a price (AGG1, DED1, FLT2).

    The price of a day is its lowest, as in :func:`sound_prices`. Every column is a
    mergeable aggregate (days are a bit each), so months combine before the only
    exchange, and no exchange holds daily rows. Same columns as
    :func:`factorlab.operators.returns.month_buckets`.

    The lowest price of a day is found by ordering days and prices as structs, which
    Spark aggregates by sorting all rows. ``one_a_day`` promises a price a day at most:
    then plain columns order them, in hash tables. The promise is checked against
    the days' bits; a month that breaks it raises an error.
    """
    if one_a_day:
        sound = prices.where(F.col("price").isNotNull())
        days = F.bit_count(F.bit_or(day_bit("date"))).cast("int")
        broken = F.raise_error(F.concat(F.lit("several prices a day: "), "ticker", F.lit(" in "), F.col("month").cast("string")))
        return (
            month_buckets(sound, start, end, [days.alias("_days")])
            .withColumn("n_days", F.when(F.col("n_days") == F.col("_days"), F.col("n_days")).otherwise(broken))
            .drop("_days")
        )
    day = F.struct("date", "price")
    late = F.struct(-F.datediff("date", F.lit(start)), F.col("price"))
    return (
        prices.filter(in_period(start, end) & F.col("price").isNotNull())
        .groupBy("ticker", month_floor("date").alias("month"))
        .agg(
            F.bit_count(F.bit_or(day_bit("date"))).cast("int").alias("n_days"),
            F.min_by("price", day).alias("first_price"),
            F.min_by("price", late).alias("last_price"),
            F.min("date").alias("first_day"),
            F.max("date").alias("last_day"),
        )
        .withColumn("month_idx", month_index("month"))
    )


def validity(prices: DataFrame) -> DataFrame:
    """First and last day and row count of each ticker (D4)."""
    return prices.groupBy("ticker").agg(
        F.min("date").alias("data_start"),
        F.max("date").alias("data_end"),
        F.count("*").alias("n_rows"),
    )


def coverage(requests: DataFrame, prices: DataFrame) -> DataFrame:
    """Does the stored range of each ``(ticker, start, end)`` enclose the request? (SRC5)"""
    enclosed = (F.col("data_start") <= F.col("start")) & (F.col("data_end") >= F.col("end"))
    return (
        requests.join(validity(prices), "ticker", "left")
        .withColumn(
            "status",
            F.when(F.col("data_start").isNull(), "missing")
            .when(enclosed, "covered").otherwise("partial"),
        )
    )


def load_success(statuses: DataFrame) -> DataFrame:
    """Obtained over requested, in percent (AGG11)."""
    obtained = F.count_if(F.col("status") != "missing")
    return statuses.agg(
        F.count("*").alias("requested"),
        obtained.alias("obtained"),
        F.count_if(F.col("status") == "missing").alias("failed"),
        F.bround(F.try_divide(obtained, F.count("*")) * 100, 1).alias("success_rate"),
    )


def choose_sources(
    tickers: DataFrame,
    prices: DataFrame,
    start: dt.date,
    end: dt.date,
    mappings: DataFrame | None = None,
    extinct: DataFrame | None = None,
) -> DataFrame:
    """Which stored symbol serves each requested ticker, and from when to when.

    The resolved symbol comes first; a mapped ticker falls back to its own
    symbol. A symbol counts when it has at least one price in the period.
    """
    candidates = source_candidates(tickers, mappings, extinct)
    stored = validity(prices.filter(in_period(start, end))).withColumnRenamed("ticker", "symbol")
    return _best_source(candidates, stored, ["data_start", "data_end", "n_rows"])


def source_candidates(
    tickers: DataFrame, mappings: DataFrame | None = None, extinct: DataFrame | None = None
) -> DataFrame:
    """``(ticker, priority, symbol)``: the stored symbols that may serve each requested ticker."""
    resolved = resolve_symbols(tickers.select("ticker").distinct(), "ticker", mappings, extinct)
    choices = F.array(
        F.struct(F.lit(1).alias("priority"), F.col("resolution.symbol").alias("symbol")),
        F.when(
            (F.col("resolution.status") == "mapped")
            & (F.col("resolution.symbol") != F.col("ticker")),
            F.struct(F.lit(2).alias("priority"), F.col("ticker").alias("symbol")),
        ),
    )
    return (
        resolved.select("ticker", F.explode(F.array_compact(choices)).alias("choice"))
        .select("ticker", "choice.*")
    )


def _best_source(candidates: DataFrame, stored: DataFrame, columns: list[str]) -> DataFrame:
    best = F.min_by(F.struct("symbol", *columns), "priority")
    return (
        candidates.join(stored, "symbol")
        .groupBy("ticker").agg(best.alias("best"))
        .select("ticker", F.col("best.symbol").alias("source_symbol"), *[f"best.{c}" for c in columns])
    )


def acquire_months(
    tickers: DataFrame, prices: DataFrame, start: dt.date, end: dt.date, one_a_day: bool = False,
    **dimensions: DataFrame,
) -> DataFrame:
    """Month buckets of the requested tickers, each from its best source, in one scan (SRC4, SRC6, PIPE3).

    The source is bound late: buckets are made and staged by stored symbol, the
    choice looks at their spans, and the chosen buckets take their ticker's name
    last. A symbol counts when it has at least one price in the period. Symbols that
    nobody may ask for are left out before the aggregate while the list of
    candidates is small enough to broadcast, and after it otherwise. ``one_a_day`` is
    the promise of :func:`stored_months`.
    """
    candidates = stage(source_candidates(tickers, **dimensions), "candidates")
    asked = candidates.select(F.col("symbol").alias("ticker")).distinct()
    if asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        prices = prices.join(F.broadcast(asked), "ticker", "left_semi")
    months = stage(
        stored_months(prices, start, end, one_a_day).withColumnRenamed("ticker", "source_symbol"), "stored-months"
    )
    spans = months.groupBy(F.col("source_symbol").alias("symbol")).agg(
        F.min("first_day").alias("data_start"), F.max("last_day").alias("data_end")
    )
    sources = _best_source(candidates, spans, ["data_start", "data_end"])
    return months.join(sources, "source_symbol").select(
        "ticker", "source_symbol", "month", "n_days", "first_price", "last_price",
        "first_day", "last_day", "month_idx", "data_start", "data_end",
    )


def acquire_prices(
    tickers: DataFrame, prices: DataFrame, start: dt.date, end: dt.date, **dimensions: DataFrame
) -> DataFrame:
    """Prices of the requested tickers in the period, from the best source of each (SRC4, SRC6).

    Any ticker with at least one row is kept and carries its validity columns.
    """
    sources = choose_sources(tickers, prices, start, end, **dimensions)
    rows = prices.filter(in_period(start, end)).select(
        F.col("ticker").alias("source_symbol"), "date", "price"
    )
    return rows.join(sources.drop("n_rows"), "source_symbol").select(
        "ticker", "source_symbol", "date", "price", "data_start", "data_end"
    )


# ---- bucketed store: whole tickers replaced in place ----------------------

BUCKETS = 64


def price_bucket(ticker: str = "ticker", buckets: int = BUCKETS) -> Column:
    """Partition of the bucketed store that holds a ticker."""
    return F.pmod(F.xxhash64(ticker), F.lit(buckets)).cast("int")


def _by_bucket(prices: DataFrame, buckets: int) -> DataFrame:
    """Rows in ranges of bucket, ticker and day, so that a hot ticker spreads over tasks and files."""
    placed = prices.select("ticker", "date", "price", price_bucket(buckets=buckets).alias("bucket"))
    return placed.repartitionByRange("bucket", "ticker", "date").sortWithinPartitions("bucket", "ticker", "date")


def write_price_buckets(prices: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Persist the store in hash buckets of tickers (SNK1), which :func:`replace_tickers` can renew singly."""
    _by_bucket(prices, buckets).write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_price_buckets(spark: SparkSession, path: str, tickers: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The bucketed store; with ``tickers`` only their buckets are read."""
    store = spark.read.schema("ticker string, date date, price double, bucket int").parquet(path)
    if tickers is not None:
        named = spark.createDataFrame([(t,) for t in tickers], "ticker string")
        touched = [r.bucket for r in named.select(price_bucket(buckets=buckets).alias("bucket")).distinct().collect()]
        store = store.where(F.col("bucket").isin(touched) & F.col("ticker").isin(tickers))
    return store.select("ticker", "date", "price")


def replace_tickers(batch: DataFrame, path: str, buckets: int = BUCKETS) -> list[int]:
    """Put a batch into the bucketed store; its tickers are replaced whole (JOIN11, SET6).

    Only the buckets that the batch touches are read, merged and overwritten; returns
    their numbers (at most ``buckets``). The merged rows are staged before anything
    is overwritten, so that a lost executor, or the same call again, gives the same store.
    """
    spark = batch.sparkSession
    batch = stage(batch.select("ticker", "date", "price"), "batch")
    touched = sorted(r.bucket for r in batch.select(price_bucket(buckets=buckets).alias("bucket")).distinct().collect())
    if not touched:
        return []
    store = spark.read.schema("ticker string, date date, price double, bucket int").parquet(path)
    old = store.where(F.col("bucket").isin(touched)).select("ticker", "date", "price")
    kept = old.join(batch.select("ticker").distinct(), "ticker", "left_anti")
    merged = stage(kept.unionByName(batch), "merged")
    (
        _by_bucket(merged, buckets).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    )
    release(batch, merged)
    return touched


def upsert_batches(batches: list[DataFrame]) -> DataFrame:
    """Union of price batches in which a later batch replaces a ticker whole (JOIN11, SET6)."""
    numbered = reduce(
        DataFrame.unionByName,
        [batch.withColumn("_batch", F.lit(number)) for number, batch in enumerate(batches)],
    )
    latest = numbered.groupBy("ticker").agg(F.max("_batch").alias("_batch"))
    return numbered.join(latest, ["ticker", "_batch"], "left_semi").drop("_batch")
