"""Panels derived by Spark from the star-schema tables.

A supplier plays the ticker, a ship day the trading day. Sums are over whole
numbers (cents, percent points, units), so a price is the same double in every
engine. All groupings combine before they shuffle; a supplier with a third of
all lines contributes one row per day to whatever follows.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from factorlab.operators.portfolios import portfolios_long, quintiles_pti
from factorlab.operators.returns import monthly_returns
from factorlab.staging import stage

START = dt.date(1995, 1, 1)
END = dt.date(2001, 11, 30)

# One raw symbol per nation: every cleaning rule and resolution status occurs.
RAW_SYMBOLS = [
    "BRK.B", "FB", "GOOG", "ABC.X", "ACME INC.", "FOO CLASS A", "TWTR", "CELG", "UTX",
    "DIS", " aapl ", "LONGSYMBOL", "bf.a", "NBL", "MSFT", "GE", "WIDGET CO", "A.B", "AAMRQ",
    "BERKSHIRE HATHAWAY B", "PBCT", "peak", "CTL", "T&T LLC", "SIVB",
]

SUMS = ["n", "tax", "disc", "qty", "cents"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _whole(column: str, scale: int = 100) -> Column:
    """Sum of a non-negative column in whole units, rounding each value half up."""
    return F.sum(F.floor(F.col(column) * scale + 0.5))


def _line_sums() -> list[Column]:
    return [
        F.count("*").alias("n"),
        _whole("l_tax").alias("tax"),
        _whole("l_discount").alias("disc"),
        _whole("l_quantity", 1).alias("qty"),
        _whole("l_extendedprice").alias("cents"),
    ]


def daily_sums(spark: SparkSession, sf_dir: str, keys: list[str], ticker: Column) -> DataFrame:
    """Sums per ticker and day, grouped by the raw ``keys``; the ticker is spelled out afterwards."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(*keys, F.to_date("l_shipdate").alias("date"))
        .agg(*_line_sums())
        .withColumn("ticker", ticker)
    )


def _supplier() -> Column:
    return F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))


def _price() -> Column:
    return F.lit(100.0) + (F.col("tax") - F.col("disc")) / F.col("n")


def supplier_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums per supplier (``l_suppkey``) and day, the days of a supplier's month together in one task.

    A supplier has hardly two lines a day, so days combine nothing before they
    shuffle. Lines move once, by supplier and month; days form where they arrive, and
    months formed from them combine in the same task before their own exchange. A
    busy supplier is spread over its months.
    """
    day = F.to_date("l_shipdate")
    return (
        table(spark, sf_dir, "lineitem")
        .select(
            "l_suppkey", day.alias("date"), F.trunc(day, "month").alias("month"),
            "l_tax", "l_discount", "l_quantity", "l_extendedprice",
        )
        .repartition("l_suppkey", "month")
        .groupBy("l_suppkey", "month", "date")
        .agg(*_line_sums())
        .drop("month")
    )


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, date, price): one row per supplier and ship day."""
    return day_prices(supplier_days(spark, sf_dir))


def day_prices(days: DataFrame) -> DataFrame:
    return days.select(_supplier().alias("ticker"), "date", _price().alias("price"))


def daily_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense panel of few tickers: line flags and status as the ticker."""
    keys = ["l_returnflag", "l_linestatus"]
    return daily_sums(spark, sf_dir, keys, F.concat(*keys)).select("ticker", "date", _price().alias("price"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw quotes with several rows per ticker and day, in order of arrival."""
    arrival = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        _supplier().alias("ticker"), F.to_date("l_shipdate").alias("date"),
        arrival.alias("arrival"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
    )


def raw_constituents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comma-joined snapshots as text: the priorities seen among each month's orders.

    A list holds at most the five priorities of the schema. Quotes, blanks and
    empty items are added for the parser to remove.
    """
    seen = table(spark, sf_dir, "orders").select(
        F.trunc("o_orderdate", "month").alias("month"), "o_orderpriority"
    ).distinct()
    joined = F.array_join(F.sort_array(F.collect_list("o_orderpriority")), ", ")
    return seen.groupBy("month").agg(joined.alias("names")).select(
        F.date_format("month", "yyyy-MM-dd").alias("date"),
        F.concat(F.lit('"'), "names", F.lit(', ,"')).alias("tickers"),
    )


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(listing, raw_symbol): a raw symbol for each customer, and the customer's own name as one."""
    customer = table(spark, sf_dir, "customer")
    by_nation = F.get(F.array(*map(F.lit, RAW_SYMBOLS)), F.col("c_nationkey"))
    # Suffixes by market segment.
    suffix = (
        F.when(F.col("c_mktsegment") == "BUILDING", " CORP")
        .when(F.col("c_mktsegment") == "MACHINERY", " LTD.")
        .otherwise("")
    )
    return customer.select(
        F.col("c_custkey").alias("listing"),
        F.explode(F.array(F.concat(by_nation, suffix), F.col("c_name"))).alias("raw_symbol"),
    )


def part_groups(spark: SparkSession, sf_dir: str, groups: int = 50) -> DataFrame:
    """(side, portfolio, date, ret): monthly returns of ``groups`` groups of parts, on two sides of an order."""
    keys = [(F.col("l_linenumber") % 2).alias("side"), (F.col("l_partkey") % groups).alias("g"),
            F.trunc("l_shipdate", "month").cast("date").alias("date")]
    monthly = table(spark, sf_dir, "lineitem").groupBy(*keys).agg(
        F.count("*").alias("n"), _whole("l_tax").alias("tax"), _whole("l_discount").alias("disc")
    ).withColumn("price", _price())
    before = F.lag("price").over(Window.partitionBy("side", "g").orderBy("date"))
    return monthly.select(
        "side", F.concat(F.lit("G"), F.col("g").cast("string")).alias("portfolio"), "date",
        ((F.col("price") / before - 1) * 100).alias("ret"),
    )


class Tables:
    """The derived tables one query needs, each built once and kept for that query."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._portfolios: dict[tuple[int, ...], DataFrame] = {}

    def source(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def days(self) -> DataFrame:
        """Sums per supplier and day."""
        return supplier_days(self.spark, self.sf_dir)

    def keep_days(self) -> Tables:
        """Store the days first, for queries that form both the panel and prices from them:
        lines are read and moved once, and a supplier's months combine as its files are read."""
        if not hasattr(self.days, "_staged_at"):
            self.days = stage(self.days, "days")
        return self

    @property
    def prices(self) -> DataFrame:
        return day_prices(self.days)

    @property
    def daily_panel(self) -> DataFrame:
        return daily_panel(self.spark, self.sf_dir)

    @property
    def debtor_prices(self) -> DataFrame:
        """A second quotation, in units a line, of the suppliers in debt: whole histories."""
        debt = self.source("supplier").filter(F.col("s_acctbal") < 0).select(
            F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker")
        )
        days = self.days.withColumn("ticker", _supplier()).join(debt, "ticker", "left_semi")
        return days.select("ticker", "date", (F.col("qty") / F.col("n")).alias("price"))

    @property
    def part_groups(self) -> DataFrame:
        return part_groups(self.spark, self.sf_dir)

    @property
    def quotes(self) -> DataFrame:
        return quotes(self.spark, self.sf_dir)

    @property
    def raw_constituents(self) -> DataFrame:
        return raw_constituents(self.spark, self.sf_dir)

    @property
    def listings(self) -> DataFrame:
        return listings(self.spark, self.sf_dir)

    @cached_property
    def price_store(self) -> DataFrame:
        """Prices as a stored table, for queries that go through them twice."""
        return stage(self.prices, "price-store")

    @cached_property
    def panel(self) -> DataFrame:
        """Monthly returns beside the month's sums: one scan of the lines, two shuffles, one write."""
        daily = self.days.withColumn("ticker", _supplier()).withColumn("price", _price())
        carry = [F.sum(c).alias(c) for c in SUMS]
        return stage(monthly_returns(daily, START, END, carry=carry), "panel")

    @property
    def monthly(self) -> DataFrame:
        return self.panel.drop(*SUMS)

    @cached_property
    def characteristics(self) -> DataFrame:
        """Monthly sums and return per ticker beside the totals of their month."""
        rows = self.panel.select("ticker", "month", "ret", *SUMS)
        totals = rows.groupBy("month").agg(
            F.count("*").alias("tickers"), *[F.sum(c).alias(f"all_{c}") for c in SUMS]
        )
        return rows.join(F.broadcast(totals), "month")  # one row per month

    @cached_property
    def membership(self) -> DataFrame:
        """(date, symbol): on each first of a month the tickers that made at least half
        of the mean revenue in the month before. Stored, as an index file would be."""
        members = self.characteristics.filter(
            F.col("cents") >= 0.5 * (F.col("all_cents") / F.col("tickers"))
        )
        return stage(
            members.select(F.add_months("month", 1).alias("date"), F.col("ticker").alias("symbol")),
            "membership",
        )

    @cached_property
    def factors(self) -> DataFrame:
        """Monthly factor table from sorts on size, discount, quantity and tax; a row per month."""
        ret = F.col("ret")
        size = F.col("cents") < F.col("all_cents") / F.col("tickers")
        value = F.col("disc") / F.col("n") > F.col("all_disc") / F.col("all_n")
        profit = F.col("qty") / F.col("n") > F.col("all_qty") / F.col("all_n")
        invest = F.col("tax") / F.col("n") < F.col("all_tax") / F.col("all_n")

        def spread(flag: Column) -> Column:
            return F.avg(F.when(flag, ret)) - F.avg(F.when(~flag, ret))

        rf = F.max(F.col("all_tax") / F.col("all_n")) / 12
        return stage(
            self.characteristics.groupBy(F.col("month").alias("date")).agg(
                (F.avg(ret) - rf).alias("MKT_RF"),
                spread(size).alias("SMB"), spread(value).alias("HML"),
                spread(profit).alias("RMW"), spread(invest).alias("CMA"),
                rf.alias("RF"),
            ),
            "factors",
        )

    def portfolios(self, lookbacks: tuple[int, ...] = (12,)) -> DataFrame:
        """(lookback, date, portfolio, ret) of the point-in-time quintiles; a few rows per month."""
        if lookbacks not in self._portfolios:
            wide = quintiles_pti(
                self.monthly, START, END, membership=self.membership,
                lookbacks=list(lookbacks), min_coverage=0.6, min_per_quintile=1,
            )
            self._portfolios[lookbacks] = stage(portfolios_long(wide), "portfolios")
        return self._portfolios[lookbacks]
