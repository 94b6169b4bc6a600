"""One Spark query per operator group; keys match :mod:`catalog.oracles`."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from factorlab.functions import symbols as S
from factorlab.functions.dates import month_grid
from factorlab.operators import (
    inference, performance as P, portfolios as PF, regression as R, returns as RET,
    robustness as RB, signals as V, universe as U,
)
from factorlab.plans import analysis as A, reports as REP
from factorlab.schemas import FACTORS, MODELS, QUINTILES
from factorlab.sources import constituents as C, factors as FAC, prices as PR
from factorlab.staging import stage, staging_root

from .views import END, START, Tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ON_TABLES: dict[str, Callable[[Tables], DataFrame]] = {}

MID_START, MID_END = dt.date(1997, 1, 1), dt.date(1999, 12, 31)
LOOKBACKS = (6, 12, 24)


def query(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    """Register ``fn``; each call gets tables of its own, so queries share nothing."""
    ON_TABLES[fn.__name__] = fn
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
    return fn


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    doubles = {f.name for f in df.schema.fields if f.dataType.simpleString() == "double"}
    return df.select(*[F.round(c, digits).alias(c) if c in doubles else F.col(c) for c in df.columns])


# ---- constituents and universe --------------------------------------------

@query
def constituents_split(t):
    """SRC1: untrimmed split."""
    return C.split_constituents(t.raw_constituents).select(
        "date", F.size("tickers_array").alias("n_items"),
        F.get("tickers_array", F.lit(0)).alias("first_item"),
    )


@query
def constituents_parsed(t):
    """SRC2: strict parse."""
    return C.parse_constituents(t.raw_constituents).select(
        "date", F.size("tickers").alias("n_tickers"), F.array_join("tickers", "|").alias("tickers")
    )


@query
def constituent_profile(t):
    """AGG8."""
    return C.constituent_profile(C.parse_constituents(t.raw_constituents))


@query
def universe_raw(t):
    """UNI3."""
    return C.universe_from_raw(t.raw_constituents, MID_START, MID_END)


@query
def universe_cleaned(t):
    """UNI2 on exploded, cleaned snapshots (AGG3, SET1)."""
    members = C.explode_members(C.parse_constituents(t.raw_constituents))
    return C.universe_for_period(members, MID_START, MID_END)


@query
def universe_period(t):
    """UNI2, FLT1, SC5, SORT3."""
    return C.universe_for_period(t.membership, MID_START, MID_END)


@query
def universe_in_order(t):
    """UNI1."""
    return C.universe_in_order(t.membership, MID_START, MID_END)


@query
def universe_limited(t):
    """LIM1: the first 25 symbols."""
    return C.first_symbols(C.universe_for_period(t.membership, START, END).select("symbol"), 25)


@query
def universe_custom(t):
    """UNI4: a list of the suppliers in credit instead of the index, with their price spans."""
    own = t.source("supplier").filter(F.col("s_acctbal") > 0).select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol")
    )
    universe = C.custom_universe(own, clean=False).withColumnRenamed("symbol", "ticker")
    return U.validity(t.prices.join(universe, "ticker", "left_semi"))


@query
def snapshot_intervals(t):
    """JOIN2: the life of each snapshot."""
    return C.snapshot_intervals(t.membership)


def _formations(t):
    return V.formation_months(t.spark, START, END, 12)


@query
def membership_asof(t):
    """JOIN2, TOPK2, ELG1, SET2: members at each formation that have prices."""
    return U.members_asof(
        t.membership, _formations(t), t.panel.select("ticker").distinct()
    )


@query
def eligible_members(t):
    """ELG3, JOIN3."""
    return U.valid_tickers(t.prices, _formations(t), t.membership, 12)


@query
def eligible_without_index(t):
    """ELG2, SC7."""
    return U.valid_tickers(t.prices, _formations(t), None, 6)


@query
def validity_metadata(t):
    """AGG4, WIN6, SC11."""
    return U.validity_metadata(t.quotes)


@query
def validity_single(t):
    """AGG5."""
    return U.ticker_validity(t.prices, "S3")


# ---- price sources --------------------------------------------------------

def _requests(t):
    """Each customer asks for the prices of a supplier, for a window of its own."""
    customer = t.source("customer")
    return customer.select(
        F.concat(F.lit("S"), F.col("c_custkey").cast("string")).alias("ticker"),
        F.add_months(F.lit(START), F.col("c_nationkey")).alias("start"),
        F.add_months(F.lit(END), -F.col("c_nationkey")).alias("end"),
    )


@query
def price_one_per_day(t):
    """DED1: first quote of the day."""
    return rounded(PR.one_price_per_day(t.quotes, "arrival"), 8)


@query
def coverage_status(t):
    """SRC5."""
    return PR.coverage(_requests(t), t.prices)


@query
def load_success(t):
    """AGG11."""
    return PR.load_success(PR.coverage(_requests(t), t.prices))


def _ticker_dimensions(t):
    """A mapping and an extinct dimension over the tickers, from supplier attributes."""
    supplier = t.source("supplier")
    own = F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))
    other = F.concat(F.lit("S"), (F.col("s_suppkey") + F.col("s_nationkey")).cast("string"))
    rich = F.col("s_acctbal") > 5000
    mapping = supplier.filter(rich).select(
        own.alias("symbol"), other.alias("target"), F.lit("renamed").alias("kind")
    )
    extinct = supplier.filter(F.col("s_acctbal") < 0).select(
        own.alias("symbol"), F.when(F.col("s_nationkey") < 12, other).alias("replacement")
    )
    return {"mappings": mapping, "extinct": extinct}


@query
def source_choice(t):
    """SRC4: which stored symbol serves each ticker."""
    wanted = t.source("supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker")
    )
    return PR.choose_sources(
        wanted, t.price_store, MID_START, MID_END, **_ticker_dimensions(t)
    )


@query
def acquired_prices(t):
    """SRC4, SRC6: rows from the chosen source with validity columns."""
    wanted = t.source("supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker")
    )
    return rounded(PR.acquire_prices(
        wanted, t.price_store, MID_START, MID_END, **_ticker_dimensions(t)
    ))


@query
def acquired_months(t):
    """SRC4, SRC6: month buckets of the chosen source, bound after one scan of the store."""
    wanted = t.source("supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker")
    )
    return rounded(PR.acquire_months(
        wanted, t.prices, START, END, one_a_day=True, **_ticker_dimensions(t)
    ).drop("month_idx"))


@query
def price_upsert(t):
    """JOIN11, SET6: a later batch replaces its tickers whole."""
    return rounded(PR.upsert_batches([t.prices, t.debtor_prices]))


def _folder(t, name):
    return f"{staging_root(t.spark)}/{name}-{uuid.uuid4().hex}"


@query
def price_store_round_trip(t):
    """SNK1, JOIN11, SET6: the bucketed store written, some buckets renewed, and read back."""
    path = _folder(t, "price-buckets")
    PR.write_price_buckets(t.prices, path)
    PR.replace_tickers(t.debtor_prices, path)
    return rounded(PR.read_price_buckets(t.spark, path))


@query
def price_directories_round_trip(t):
    """SRC3, SNK1: a directory of CSV for each ticker, written and scanned."""
    path = _folder(t, "price-directories")
    PR.write_price_directories(t.daily_panel, path)
    return rounded(PR.read_price_directories(t.spark, path))


@query
def factor_store_round_trip(t):
    """SNK2: the factor table stored whole and read back."""
    path = _folder(t, "factors")
    FAC.write_factors(t.factors, path)
    return rounded(FAC.read_factors(t.spark, path))


# ---- symbols --------------------------------------------------------------

@query
def symbol_clean(t):
    """SC1."""
    return t.listings.withColumn("symbol", S.clean_symbol("raw_symbol"))


@query
def symbol_resolve(t):
    """SC2, JOIN10."""
    resolved = S.resolve_symbols(t.listings, "raw_symbol")
    return resolved.select("listing", "raw_symbol", "resolution.*")


@query
def symbol_resolve_keep_extinct(t):
    """SC2 without the extinct check."""
    resolved = S.resolve_symbols(t.listings, "raw_symbol", check_extinct=False)
    return resolved.groupBy("resolution.symbol", "resolution.status").agg(F.count("*").alias("n"))


@query
def symbol_resolve_without_proxies(t):
    """SC2: stand-ins of other companies do not count as mappings."""
    resolved = S.resolve_symbols(t.listings, "raw_symbol", leave_out=("proxy",))
    return resolved.select("listing", "raw_symbol", "resolution.*")


@query
def symbol_resolve_dated(t):
    """SC2, DIM1: each price under the symbol that its ticker stood for on its day."""
    supplier = t.source("supplier").filter(F.col("s_acctbal") > 3000)
    own = F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol")

    def mapped(step, kind, months):
        target = F.concat(F.lit("S"), (F.col("s_suppkey") + step).cast("string")).alias("target")
        since = F.add_months(F.lit(START), F.col("s_nationkey") + months).alias("valid_from")
        return supplier.select(own, target, F.lit(kind).alias("kind"), since)

    mappings = mapped(F.col("s_nationkey"), "renamed", 12).unionByName(mapped(F.lit(1), "proxy", 36))
    resolved = S.resolve_symbols_asof(t.prices, "ticker", "date", mappings)
    return resolved.groupBy("ticker", "resolved", "mapping_kind").agg(
        F.count("*").alias("n_days"), F.min("date").alias("first_day"), F.max("date").alias("last_day")
    )


@query
def resolution_stats(t):
    """AGG10."""
    return S.resolution_stats(S.resolve_symbols(t.listings, "raw_symbol"))


@query
def symbol_extinct(t):
    """SC3."""
    return S.with_extinct_flag(t.listings, "raw_symbol")


@query
def symbol_metadata(t):
    """SC4."""
    return S.with_metadata(t.listings, "raw_symbol")


@query
def mapping_upsert(t):
    """DIM1: customers' corrections upserted into the mapping dimension."""
    customer = t.source("customer")
    additions = customer.select(
        F.concat(F.lit(" fb"), F.when(F.col("c_nationkey") > 4, F.col("c_nationkey").cast("string"))
                 .otherwise("")).alias("symbol"),
        F.lower("c_name").alias("target"), F.lit("renamed").alias("kind"),
        F.col("c_custkey").alias("seq"),
    )
    return S.add_mappings(S.mapping_dimension(t.spark), additions)


@query
def extinct_upsert(t):
    """DIM2: suppliers in debt marked extinct."""
    gone = t.source("supplier").filter(F.col("s_acctbal") < 0).select(
        F.lower("s_name").alias("symbol")
    )
    return S.mark_extinct(S.extinct_dimension(t.spark), gone)


@query
def mapping_listing(t):
    """DIM3: the listing, with how many of the customers' symbols each entry concerns."""
    used = t.listings.groupBy(S.normal("raw_symbol").alias("symbol")).agg(
        F.count("*").alias("n_listings")
    )
    entries = S.list_mappings(S.mapping_dimension(t.spark), S.extinct_dimension(t.spark))
    return entries.join(used, "symbol", "left").withColumn(
        "n_listings", F.coalesce("n_listings", F.lit(0))
    )


# ---- returns and signals --------------------------------------------------

def _monthly(t):
    return RET.monthly_returns(t.prices, START, END)


@query
def month_grid_counts(t):
    """SC6: every month of the grid with its trading tickers."""
    traded = RET.month_buckets(t.prices, START, END).groupBy("month").agg(
        F.count("*").alias("n")
    )
    grid = month_grid(t.spark, START, END).select("month")
    return grid.join(traded, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n_tickers"))


@query
def month_buckets(t):
    """AGG1, FLT2."""
    return rounded(RET.month_buckets(t.prices, START, END)).drop("month_idx")


@query
def monthly_returns(t):
    """RET1, JOIN6."""
    return rounded(_monthly(t).select("ticker", "month", "n_days", "ret"))


@query
def monthly_returns_dense(t):
    """RET1 on every month between a ticker's first and last."""
    return rounded(RET.dense_months(_monthly(t), END).select("ticker", "month", "ret"))


@query
def daily_returns(t):
    """RET2, JOIN7, SET5."""
    return rounded(RET.daily_returns(t.daily_panel).select("ticker", "date", "cal_idx", "ret"))


FLAGS = ["AF", "AO", "NF", "NO", "RF", "RO"]


@query
def returns_wide(t):
    """RSH1: one column per ticker of the dense panel."""
    panel = RET.monthly_returns(t.daily_panel, START, END)
    return rounded(RET.returns_wide(panel, FLAGS, START, END))


@query
def returns_long(t):
    """RSH1: back from wide to long."""
    panel = RET.monthly_returns(t.daily_panel, START, END)
    return rounded(RET.returns_long(RET.returns_wide(panel, FLAGS, START, END)))


@query
def vol_monthly(t):
    """VOL1, FLT5."""
    dense = RET.dense_months(_monthly(t), END, tail=12)
    return rounded(V.vol_monthly(dense, START, 12).select("ticker", "month", "vol", "n_obs"), 9)


@query
def vol_monthly_min_obs(t):
    """VOL2."""
    dense = RET.dense_months(_monthly(t), END, tail=12)
    return rounded(V.vol_monthly(dense, START, 12, min_obs=8).select("ticker", "month", "vol", "n_obs"), 9)


@query
def vol_point_in_time(t):
    """VOL3, JOIN5: three lookbacks in one pass."""
    dense = RET.dense_months(_monthly(t), END)
    signals = V.vol_at_formation(dense, START, END, list(LOOKBACKS), 0.6)
    return rounded(signals.select("lookback", "formation", "ticker", "vol", "n_obs", "hold_ret"), 9)


@query
def vol_daily(t):
    """VOL4."""
    months = month_grid(t.spark, START, END).select(F.col("month").alias("formation"))
    return rounded(V.vol_daily(t.daily_panel, months), 9)


# ---- portfolios -----------------------------------------------------------

@query
def extreme_portfolios(t):
    """PF1, TOPK1."""
    return rounded(PF.extreme_portfolios(_monthly(t), START, END, 12, 4))


@query
def quintiles_basic(t):
    """PF2, SORT2."""
    return rounded(PF.quintiles_basic(_monthly(t), START, END, min_per_quintile=1))


@query
def quintiles_basic_daily(t):
    """PF2 on the daily signal."""
    panel = t.daily_panel
    return rounded(PF.quintiles_basic(
        RET.monthly_returns(panel, START, END), START, END, method="daily252", prices=panel,
        min_obs=180, min_per_quintile=1,
    ))


@query
def quintiles_pti(t):
    """PF3, AGG2, JOIN4, JOIN5."""
    return rounded(PF.quintiles_pti(
        t.monthly, START, END, membership=t.membership, min_coverage=0.6,
        min_per_quintile=1,
    ))


@query
def quintiles_pti_daily(t):
    """PF3 on the daily signal, without an index (ELG2)."""
    panel = t.daily_panel
    return rounded(PF.quintiles_pti(
        RET.monthly_returns(panel, START, END), START, END, method="daily252", prices=panel,
        min_coverage=0.6, min_per_quintile=1,
    ))


@query
def quintiles_pti_lookbacks(t):
    """RB2: three lookbacks in one plan."""
    return rounded(t.portfolios(LOOKBACKS))


def _outcomes(t):
    return PF.pti_outcomes(
        t.monthly, START, END, membership=t.membership,
        lookbacks=list(LOOKBACKS), min_coverage=0.7, min_per_quintile=5,
    )


@query
def pti_outcomes(t):
    """AGG12: what became of every holding month."""
    return _outcomes(t).select("lookback", "date", "outcome", "n_eligible", "n_vol")


@query
def pti_skip_reasons(t):
    """AGG12."""
    return PF.skip_reasons(_outcomes(t))


@query
def pti_processing_rate(t):
    """AGG12."""
    return PF.processing_rate(_outcomes(t))


@query
def quintile_statistics(t):
    """AGG13."""
    return rounded(PF.quintile_statistics(t.portfolios(), ["lookback"]))


@query
def quintiles_from_prices(t):
    """PF4."""
    return rounded(PF.quintiles_from_prices(
        t.price_store, t.membership, START, END, min_coverage=0.6,
        min_per_quintile=1, one_a_day=True,
    ))


@query
def extremes_from_prices(t):
    """PF5."""
    return rounded(PF.extremes_from_prices(
        t.price_store, t.membership, START, END, one_a_day=True
    ))


# ---- performance ----------------------------------------------------------

SERIES = ["lookback", "portfolio"]


@query
def performance(t):
    """PERF1-9, AGG6."""
    return rounded(P.performance(t.portfolios(), SERIES))


@query
def drawdown_series(t):
    """WIN1, SER4."""
    return rounded(P.drawdown_series(t.portfolios(), SERIES).select(*SERIES, "date", "drawdown"))


@query
def cumulative_returns(t):
    """WIN2, WIN3."""
    return rounded(P.growth_path(t.portfolios(), SERIES).select(*SERIES, "date", "cum_ret"))


@query
def rolling_metrics(t):
    """WIN5, SER1."""
    return rounded(P.rolling_metrics(t.portfolios(), SERIES))


@query
def rolling_sharpe_skipping(t):
    """WIN5 from the original's later start."""
    return rounded(P.rolling_long_short(t.portfolios(), ["lookback"], skip_first=11))


@query
def rolling_summary(t):
    """RB4."""
    rolling = P.rolling_long_short(t.portfolios(LOOKBACKS), ["lookback"])
    return rounded(P.rolling_summary(rolling, ["lookback"]))


@query
def risk_return_table(t):
    """SER2, PERF10."""
    return rounded(P.risk_return_table(t.portfolios(), SERIES))


@query
def dashboard(t):
    """RB5."""
    return rounded(P.dashboard(t.portfolios(), SERIES))


@query
def sharpe_excess(t):
    """SH1, SH2, FLT4."""
    return rounded(P.excess_sharpe(t.portfolios(), t.factors, SERIES))


# ---- factors --------------------------------------------------------------

@query
def factor_table(t):
    """SRC9 over the derived factors."""
    return rounded(FAC.factors_for_period(t.factors, MID_START, MID_END))


@query
def factor_summary(t):
    """AGG7."""
    return rounded(FAC.factor_summary(t.factors))


@query
def factor_correlations(t):
    """AGG7."""
    return rounded(FAC.factor_correlations(t.factors))


@query
def factor_validation(t):
    """AGG9."""
    return rounded(FAC.factor_validation(t.factors))


@query
def factor_coverage(t):
    """SRC8."""
    return FAC.factors_cover(t.factors, START, dt.date(2001, 10, 31))


def _factor_lines(t):
    """The factor table printed as a factor file: preamble, header, months, years, notice."""
    names = FACTORS + ["RF"]
    cells = F.concat_ws(",", *[F.format_string("%8.2f", F.round(n, 2)) for n in names])
    months = t.factors.dropna()
    monthly_lines = months.select(
        (F.year("date") * 100 + F.month("date")).alias("line_no"),
        F.concat(F.date_format("date", "yyyyMM"), F.lit(","), cells).alias("value"),
    )
    broken = months.groupBy().agg(F.max("date").alias("date")).select(
        (F.year("date") * 100 + 13).alias("line_no"),
        F.concat(F.date_format("date", "yyyyMM"), F.lit(",  n/a,  1.00,  1.00,  1.00,  1.00,  0.10")).alias("value"),
    )
    yearly = months.groupBy(F.year("date").alias("y")).agg(
        F.concat_ws(",", *[F.format_string("%8.2f", F.round(F.sum(n), 2)) for n in names]).alias("c")
    ).select((F.lit(900000) + F.col("y")).alias("line_no"),
             F.concat(F.col("y").cast("string"), F.lit(","), "c").alias("value"))
    fixed = months.groupBy().agg(F.count("*").alias("n")).select(F.inline(F.array(
        F.struct(F.lit(1).alias("line_no"), F.concat(F.lit("Made from "), F.col("n").cast("string"),
                                                     F.lit(" months")).alias("value")),
        F.struct(F.lit(2).alias("line_no"), F.lit("").alias("value")),
        F.struct(F.lit(3).alias("line_no"), F.lit(",Mkt-RF,SMB,HML,RMW,CMA,RF").alias("value")),
        F.struct(F.lit(999999).alias("line_no"), F.lit("Copyright notice").alias("value")),
    )))
    lines = fixed.unionByName(monthly_lines).unionByName(broken).unionByName(yearly)
    return lines.withColumn("file", F.lit("factors"))


@query
def factor_file_ingest(t):
    """SRC7."""
    return rounded(FAC.parse_factor_lines(_factor_lines(t)))


# ---- regressions ----------------------------------------------------------

def _flat(results: DataFrame, keys: list[str], model: str) -> DataFrame:
    """One column per factor for its beta, t and p."""
    cells = []
    for i, name in enumerate(MODELS[model]):
        cell = F.get("loadings", F.lit(i))
        cells += [cell["beta"].alias(f"b_{name}"), cell["tstat"].alias(f"t_{name}"),
                  cell["pvalue"].alias(f"p_{name}")]
    return results.filter(F.col("model") == model).select(
        *keys, "alpha", "alpha_tstat", "alpha_pvalue", "r2", "adj_r2", "n_obs",
        "period_start", "period_end", *cells,
    )


def _aligned(t, model, **options):
    rows = R.align_by_date(t.portfolios(), t.factors)
    design = R.design_rows(rows, ["portfolio"], [model])
    return rounded(_flat(R.regressions(design, ["portfolio"], **options), ["portfolio"], model))


@query
def capm_ols(t):
    """REG7, REG4, JOIN1, FLT3."""
    return _aligned(t, "CAPM")


@query
def ff3_ols(t):
    """REG8."""
    return _aligned(t, "FF3")


@query
def ff5_ols(t):
    """REG9."""
    return _aligned(t, "FF5")


def _positional(t, model):
    rows = R.align_by_position(t.portfolios(), t.factors.dropna(), ["portfolio"])
    design = R.design_rows(rows, ["portfolio"], [model])
    return rounded(_flat(R.regressions(design, ["portfolio"]), ["portfolio"], model))


@query
def capm_positional(t):
    """REG1, JOIN9."""
    return _positional(t, "CAPM")


@query
def ff3_positional(t):
    """REG2."""
    return _positional(t, "FF3")


@query
def ff5_positional(t):
    """REG3."""
    return _positional(t, "FF5")


@query
def capm_newey_west(t):
    """REG5."""
    return _aligned(t, "CAPM", robust=True)


@query
def ff5_newey_west(t):
    """REG5 with five factors."""
    return _aligned(t, "FF5", robust=True)


@query
def ff3_newey_west_reference_scale(t):
    """REG5 with the original's extra division by n."""
    return _aligned(t, "FF3", robust=True, nw_scale="reference")


def _excess(t):
    return R.align_by_date(t.portfolios(), t.factors).withColumn(
        "excess", F.col("ret") - F.col("RF")
    )


@query
def custom_regression(t):
    """REG11, PRJ2."""
    fitted = R.custom_regression(_excess(t), ["portfolio"], ["Mkt_RF", "hml", "CMA"])
    return rounded(fitted.withColumns({
        f"b{i}": F.get("coefficients", F.lit(i)) for i in range(3)
    }).drop("coefficients"), 8)


@query
def custom_regression_robust(t):
    """REG12."""
    fitted = R.custom_regression(
        _excess(t), ["portfolio"], ["MKT_RF", "HML", "CMA"], robust=True, lags=4
    )
    return rounded(fitted.select("portfolio", "alpha", "alpha_t", "alpha_pval"), 8)


@query
def models_all(t):
    """REG13, REG14, SC10: every model for every portfolio and lookback at once."""
    rows = R.align_by_date(t.portfolios(LOOKBACKS), t.factors)
    results = R.regressions(R.design_rows(rows, SERIES), SERIES)
    return rounded(results.drop("loadings", "period_start", "period_end"))


@query
def capm_by_ticker(t):
    """REG7 over all single tickers: groups by the thousand instead of six."""
    own = t.monthly.select("ticker", F.col("month").alias("date"), "ret")
    design = R.design_rows(R.align_by_date(own, t.factors), ["ticker"], ["CAPM"])
    return rounded(_flat(R.regressions(design, ["ticker"]), ["ticker"], "CAPM"))


@query
def factor_loadings(t):
    """SER3."""
    rows = R.align_by_date(t.portfolios(), t.factors)
    results = R.regressions(R.design_rows(rows, ["portfolio"], ["FF3"]), ["portfolio"])
    return rounded(R.factor_loadings(results, ["portfolio"]))


def _alpha_columns(analysis: DataFrame) -> DataFrame:
    cells = [F.col(f"{m}.{c}").alias(f"{m}_{c}") for m in ("capm", "ff3", "ff5")
             for c in ("alpha", "alpha_pvalue", "r2")]
    return rounded(analysis.select(
        "portfolio", "n_obs", "raw_return", "raw_volatility", "raw_sharpe", *cells,
        "best_model", "verdict", "supports",
    ))


@query
def alpha_analysis(t):
    """REG10, ANA2, BEST1, SC9, SC12."""
    return _alpha_columns(A.analyze_anomaly_aligned(t.portfolios(), t.factors, keys=["portfolio"]))


@query
def alpha_analysis_positional(t):
    """REG6, ANA1."""
    return _alpha_columns(A.analyze_anomaly(
        t.portfolios(), t.factors.dropna(), START, END, keys=["portfolio"]
    ))


@query
def best_models(t):
    """BEST1."""
    rows = R.align_by_date(t.portfolios(), t.factors)
    return rounded(R.best_models(R.regressions(R.design_rows(rows, ["portfolio"]), ["portfolio"]), ["portfolio"]))


def _fitted(t, model):
    months = t.factors
    rows = R.align_by_date(t.portfolios(), months)
    design = R.design_rows(rows, ["portfolio"], [model])
    # A row for each portfolio, solved once for results and residuals.
    fit = stage(R.fit(design, ["portfolio", "model"]), "fitted")
    return R.describe(fit, ["portfolio"]), R.residuals(design, fit, ["portfolio", "model"]), months


@query
def residual_series(t):
    """D11, WIN4."""
    _, resid, _ = _fitted(t, "FF3")
    return rounded(P.residual_growth(resid, ["portfolio", "model"]))


@query
def residuals_wide(t):
    """RSH2."""
    _, resid, _ = _fitted(t, "CAPM")
    return rounded(inference.residuals_wide(resid, ["model"], QUINTILES))


def _grs(t, model, names, variant="full"):
    results, resid, months = _fitted(t, model)
    test = inference.grs_test(results, resid, months, names, model, variant=variant)
    return rounded(test.select(
        "status", "n_portfolios", "n_factors", "n_obs", "df2", "f_statistic", "critical_value", "p_value",
        "term1", "term2", "term3", "is_significant", "conclusion",
    ))


@query
def grs_alphas(t):
    """GRS2: the alphas, their tests and the factor means that entered the joint test."""
    results, resid, months = _fitted(t, "FF3")
    test = inference.grs_test(results, resid, months, QUINTILES, "FF3")
    entered = F.arrays_zip(F.array(*map(F.lit, QUINTILES)).alias("name"), "alphas", "alpha_pvalues")
    means = F.arrays_zip(F.array(*map(F.lit, MODELS["FF3"])).alias("name"), "factor_means")
    own = test.select(F.inline(entered)).toDF("name", "alpha", "alpha_pvalue").withColumn("factor_mean", F.lit(None).cast("double"))
    moves = test.select(F.inline(means)).toDF("name", "factor_mean")
    return rounded(own.unionByName(moves, allowMissingColumns=True), 8)


@query
def grs_fifty_portfolios(t):
    """GRS1 with fifty portfolios on each of two sides of an order: keys and cross products in long form."""
    keys = ["side", "portfolio"]
    long = stage(t.part_groups, "part-groups")
    design = R.design_rows(R.align_by_date(long, t.factors), keys, ["CAPM"])
    fit = stage(R.fit(design, [*keys, "model"]), "fitted")
    test = inference.grs_test(
        R.describe(fit, keys), R.residuals(design, fit, [*keys, "model"]), t.factors,
        [f"G{i}" for i in range(50)], "CAPM", ["side"], variant="simple",
    )
    return rounded(test.select(
        F.col("side").cast("int").alias("side"), "status", "n_portfolios", "n_factors", "n_obs", "df2",
        "f_statistic", "critical_value", "p_value", "is_significant",
    ), 5)


@query
def grs_capm_two_portfolios(t):
    """GRS2 with two portfolios."""
    return _grs(t, "CAPM", ["P1", "P5"])


@query
def grs_ff3(t):
    """GRS2, AGG15, AGG16."""
    return _grs(t, "FF3", QUINTILES)


@query
def grs_ff5(t):
    """GRS2 with five factors."""
    return _grs(t, "FF5", QUINTILES)


@query
def grs_simple(t):
    """GRS1, GRS3."""
    return _grs(t, "FF5", QUINTILES, "simple")


@query
def grs_singular(t):
    """GRS2 with a portfolio and its copy: a status instead of a statistic."""
    long = t.portfolios()
    doubled = long.unionByName(
        long.filter(F.col("portfolio") == "P1").withColumn("portfolio", F.lit("COPY"))
    )
    design = R.design_rows(R.align_by_date(doubled, t.factors), ["portfolio"], ["CAPM"])
    fit = R.fit(design, ["portfolio", "model"])
    resid = R.residuals(design, fit, ["portfolio", "model"])
    test = inference.grs_test(R.describe(fit, ["portfolio"]), resid, t.factors, ["P1", "COPY"], "CAPM")
    return test.select("status", "n_portfolios", "n_factors")


# ---- robustness and reports -----------------------------------------------

@query
def subperiods(t):
    """RB1."""
    return rounded(RB.subperiod_performance(t.portfolios(LOOKBACKS), START, END))


@query
def lookback_correlations(t):
    """RB3, JOIN8, SET3."""
    return rounded(RB.lookback_correlations(t.portfolios(LOOKBACKS), list(LOOKBACKS)))


@query
def report_table(t):
    """SNK7, SC8, SC11."""
    return REP.report_table(P.performance(t.portfolios(LOOKBACKS), SERIES))


@query
def results_document(t):
    """SNK4: the nested documents written as JSON, read back by their schema and unpacked."""
    long = t.portfolios(LOOKBACKS)
    results = stage(R.regressions(R.design_rows(R.align_by_date(long, t.factors), SERIES), SERIES), "results")
    document = REP.results_document(P.performance(long, SERIES), results, START, END)
    path = _folder(t, "documents")
    REP.write_json(document, path)
    found = REP.read_documents(t.spark, path, document)
    rows = found.select("lookback", "period", "factor_results", F.explode("performance").alias("p"))
    own = F.filter("factor_results", lambda x: x["portfolio"] == F.col("p.portfolio"))
    rows = rows.select("lookback", "period", "p", F.explode(own).alias("r"))
    return rounded(rows.select(
        "lookback", F.col("period.start").alias("period_start"), F.col("period.end").alias("period_end"),
        "p.portfolio", "p.annual_return", "p.sharpe_ratio", "p.max_drawdown", "p.n_months",
        "r.model", "r.alpha", "r.alpha_pvalue", "r.r2", "r.n_obs", F.size("r.loadings").cast("int").alias("n_loadings"),
    ))


@query
def final_summary(t):
    """SNK6: the long-short line beside period, lookbacks and models."""
    performance = P.performance(t.portfolios(LOOKBACKS), SERIES)
    return rounded(REP.final_summary(performance, START, END, LOOKBACKS, list(MODELS)))


@query
def portfolios_side_by_side(t):
    """SNK3: the table the CSV sink writes."""
    return rounded(PF.portfolios_wide(t.portfolios()))


def _study(t, prices=None, factors=None, **options):
    config = A.AnalysisConfig(**{
        "start": START, "end": END, "lookbacks": (12,), "min_per_quintile": 1, "run_series": False,
        "run_subperiods": False, "run_robustness": False, "one_a_day": prices is None, **options})
    return A.run_analysis(config, t.prices if prices is None else prices, factors, t.membership)


@query
def study_summary(t):
    """PIPE1, PIPE3: the whole study, its long-short line."""
    return rounded(_study(t.keep_days(), factors=t.factors, lookbacks=(12, 24))["summary"])


@query
def study_repeated_quotes(t):
    """PIPE3, DED1: a study over raw quotes, several a day, of which the lowest counts."""
    return rounded(_study(t, t.quotes.select("ticker", "date", "price"))["summary"])


@query
def study_regressions(t):
    """PIPE1: every model of every portfolio and lookback of a study."""
    results = _study(t.keep_days(), factors=t.factors, lookbacks=(12, 24))["regressions"]
    return rounded(results.drop("loadings", "period_start", "period_end"))


@query
def study_alphas(t):
    """PIPE1, REG10: the alpha analysis of a study, from the regressions solved once."""
    tables = _study(t.keep_days(), factors=t.factors)
    return _alpha_columns(tables["alphas"])


@query
def study_three_factors(t):
    """PIPE1, FLT6, SET4: joint tests of a study whose factor table lacks two factors."""
    tests = _study(t.keep_days(), factors=t.factors.drop("RMW", "CMA"))["joint_test"]
    return rounded(tests.select(
        "lookback", "model", "status", "n_portfolios", "n_factors", "n_obs", "df2", "f_statistic",
        "critical_value", "p_value", "is_significant",
    ))


@query
def study_files(t):
    """SNK5: a study written to its folder, its subperiods read back."""
    folder = _folder(t, "study")
    tables = _study(t.keep_days(), output_dir=folder, run_subperiods=True)
    path = f"{folder}/{START}_to_{END}/subperiods"
    return rounded(t.spark.read.schema(tables["subperiods"].schema).json(path))


@query
def quick_study(t):
    """PIPE2: CAPM alphas of the quick preset, beside the performance."""
    tables = A.quick_analysis(START, END, t.keep_days().prices, one_a_day=True, factors=t.factors, membership=t.membership)
    measures = tables["performance"].select(*SERIES, "annual_return", "sharpe_ratio", "n_months")
    alphas = tables["regressions"].select(*SERIES, "model", "alpha", "alpha_tstat", "alpha_pvalue", "r2", "n_obs")
    return rounded(measures.join(alphas, SERIES))
