"""The whole study as one plan over staged tables (PIPE1-3, RB2, ANA1-2, GRS3)."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, functions as F

from ..functions.dates import in_period
from ..operators.inference import grs_test, joint_tests
from ..operators.performance import (
    drawdown_series, growth_path, performance, risk_return_table, rolling_long_short,
    rolling_metrics, rolling_summary,
)
from ..operators.portfolios import portfolios_long, processed_months, pti_outcomes, skip_reasons
from ..operators.regression import (
    alpha_analysis, align_by_date, design_rows, factor_loadings, fit, describe, residuals,
)
from ..operators.returns import monthly_returns, returns_of_months
from ..operators.robustness import lookback_correlations, subperiod_performance
from ..schemas import MODELS, QUINTILES, missing_columns, require_columns
from ..sources.constituents import custom_universe, universe_for_period
from ..sources.factors import factors_for_period
from ..sources.prices import acquire_months, acquire_prices, sound_prices
from ..staging import stage
from .reports import (
    final_summary, report_table, results_document, write_json, write_portfolio_csv,
)

SERIES = ["lookback", "portfolio"]


@dataclass(frozen=True)
class AnalysisConfig:
    """Parameters of a study; the defaults are fixed values of the original."""

    start: dt.date = dt.date(2020, 1, 1)
    end: dt.date = dt.date(2024, 10, 31)
    lookbacks: tuple[int, ...] = (12,)
    min_coverage: float = 0.6
    min_per_quintile: int = 5
    method: str = "monthly12"
    one_a_day: bool = False  # the store has one price per ticker and day; checked, and faster
    clean_symbols: bool = True  # bring a custom list of tickers to canonical symbols
    models: tuple[str, ...] = ("CAPM", "FF3", "FF5")
    output_dir: str | None = None
    output_formats: tuple[str, ...] = ("csv", "json", "report")
    run_series: bool = True
    run_subperiods: bool = True
    run_robustness: bool = True
    thesis: str = "the risk explanation"
    portfolio_options: dict = field(default_factory=dict)


def study_universe(
    config: AnalysisConfig, membership: DataFrame | None = None, tickers: DataFrame | None = None
) -> DataFrame:
    """``(ticker)``: the index membership of the period, or a custom list."""
    if tickers is not None:
        universe = custom_universe(tickers, config.clean_symbols)
    elif membership is not None:
        universe = universe_for_period(membership, config.start, config.end).select("symbol")
    else:
        raise ValueError("give an index membership or a list of tickers")
    return universe.select(F.col("symbol").alias("ticker"))


def load_universe_months(
    config: AnalysisConfig,
    prices: DataFrame,
    membership: DataFrame | None = None,
    tickers: DataFrame | None = None,
) -> DataFrame:
    """Month buckets of the study's universe: one scan, no daily row moved (PIPE3)."""
    wanted = study_universe(config, membership, tickers)
    return acquire_months(wanted, prices, config.start, config.end, config.one_a_day).drop(
        "source_symbol", "data_start", "data_end"
    )


def load_universe_prices(
    config: AnalysisConfig,
    prices: DataFrame,
    membership: DataFrame | None = None,
    tickers: DataFrame | None = None,
) -> DataFrame:
    """Daily prices of the study's universe, staged once, for signals from daily returns (PIPE3)."""
    wanted = study_universe(config, membership, tickers)
    return stage(
        sound_prices(acquire_prices(wanted, prices, config.start, config.end).select("ticker", "date", "price")),
        "prices",
    )


def run_analysis(
    config: AnalysisConfig,
    prices: DataFrame,
    factors: DataFrame | None = None,
    membership: DataFrame | None = None,
    tickers: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """All tables of the study (PIPE1): portfolios, performance, regressions and checks.

    The panel is reduced to monthly portfolio returns once and staged; what
    follows works on a row per lookback, portfolio and month.
    """
    if config.method == "monthly12":
        universe_prices = None
        monthly = returns_of_months(load_universe_months(config, prices, membership, tickers), config.end)
    else:
        universe_prices = load_universe_prices(config, prices, membership, tickers)
        monthly = monthly_returns(universe_prices, config.start, config.end)
    outcomes = stage(
        pti_outcomes(
            monthly, config.start, config.end, membership=membership,
            lookbacks=list(config.lookbacks), min_coverage=config.min_coverage,
            min_per_quintile=config.min_per_quintile, method=config.method,
            prices=universe_prices, **config.portfolio_options,
        ),
        "outcomes",
    )
    wide = processed_months(outcomes)
    long = portfolios_long(wide)
    tables = {
        "portfolios": wide,
        "skip_reasons": skip_reasons(outcomes),
        "performance": performance(long, SERIES),
    }
    results = None
    if factors is not None and config.models:
        in_range = factors_for_period(factors, config.start, config.end)
        design = design_rows(align_by_date(long, in_range), SERIES, list(config.models))
        # A row for each series and model, solved once for all that reads it.
        fitted = stage(fit(design, [*SERIES, "model"]), "fitted")
        results = describe(fitted, SERIES)
        resid = residuals(design, fitted, [*SERIES, "model"])
        tables["regressions"] = results
        tables["residuals"] = resid
        tables["loadings"] = factor_loadings(results, SERIES)
        tables["alphas"] = alpha_analysis(
            long, in_range, SERIES, models=list(config.models), thesis=config.thesis, results=results
        )
        tables["joint_test"] = joint_test_table(results, resid, in_range, config)
    if config.run_series:
        tables["cumulative"] = growth_path(long, SERIES)
        tables["drawdowns"] = drawdown_series(long, SERIES)
        tables["rolling"] = rolling_metrics(long, SERIES)
        tables["risk_return"] = risk_return_table(long, SERIES)
    if config.run_subperiods:
        tables["subperiods"] = subperiod_performance(long, config.start, config.end)
    if config.run_robustness:
        tables["rolling_summary"] = rolling_summary(rolling_long_short(long, ["lookback"]), ["lookback"])
        if len(config.lookbacks) > 1:
            tables["lookback_correlations"] = lookback_correlations(long, list(config.lookbacks))
    tables["report"] = report_table(tables["performance"])
    tables["summary"] = final_summary(
        tables["performance"], config.start, config.end, config.lookbacks, config.models
    )
    tables["document"] = results_document(
        tables["performance"], results, config.start, config.end
    )
    if config.output_dir:
        save(tables, config)
    return tables


def joint_test_table(
    results: DataFrame, resid: DataFrame, factors: DataFrame, config: AnalysisConfig
) -> DataFrame:
    """The joint test of every model, by lookback and model, in one plan.

    A model that lacks a factor has a row with status ``missing_factors`` and no
    figures, as it has no fit; the others are tested.
    """
    usable = [m for m in config.models if not missing_columns(factors, MODELS[m])]
    tests = joint_tests(results, resid, factors, QUINTILES, usable, ["lookback"])
    lacking = [(x, "missing_factors", m) for x in config.lookbacks for m in config.models if m not in usable]
    if not lacking:
        return tests
    rows = results.sparkSession.createDataFrame(lacking, "lookback int, status string, model string")
    return tests.unionByName(rows.withColumn("lookback", F.col("lookback").cast(results.schema["lookback"].dataType)), allowMissingColumns=True)


def save(tables: dict[str, DataFrame], config: AnalysisConfig) -> None:
    """Write the study under ``output_dir/<start>_to_<end>`` (SNK3-SNK7)."""
    base = f"{config.output_dir}/{config.start}_to_{config.end}"
    if "csv" in config.output_formats:
        write_portfolio_csv(tables["portfolios"], f"{base}/portfolios")
    if "json" in config.output_formats:
        write_json(tables["document"], f"{base}/results")
    if "report" in config.output_formats:
        write_json(tables["report"], f"{base}/report")
    for name in ("subperiods", "rolling", "rolling_summary", "lookback_correlations", "summary"):
        if name in tables:
            write_json(tables[name], f"{base}/{name}")


def quick_analysis(
    start: dt.date, end: dt.date, prices: DataFrame, one_a_day: bool = False, **inputs
) -> dict[str, DataFrame]:
    """Lookback 12, CAPM only, no extras (PIPE2)."""
    config = replace(
        AnalysisConfig(), start=start, end=end, lookbacks=(12,), models=("CAPM",),
        run_series=False, run_subperiods=False, run_robustness=False, one_a_day=one_a_day,
    )
    return run_analysis(config, prices, **inputs)


def analyze_anomaly(
    portfolios: DataFrame, factors: DataFrame, start: dt.date, end: dt.date, **options
) -> DataFrame:
    """Alpha analysis by position over the factors of a period (ANA1); needs twelve months."""
    months = factors.filter(in_period(start, end))
    available = months.agg(F.count("*")).first()[0]
    if available < 12:
        raise ValueError(f"need at least 12 factor months, got {available}")
    return alpha_analysis(portfolios, months, align="position", **options)


def analyze_anomaly_aligned(portfolios: DataFrame, factors: DataFrame, **options) -> DataFrame:
    """Alpha analysis joined by month, the preferred form (ANA2)."""
    require_columns(portfolios, ["date"], "portfolio table")
    require_columns(factors, ["date"], "factor table")
    return alpha_analysis(portfolios, factors, align="date", **options)


def joint_significance(results: DataFrame, resid: DataFrame, factors: DataFrame,
                       portfolios: list[str], **options) -> DataFrame:
    """The simple joint test (GRS3)."""
    return grs_test(results, resid, factors, portfolios, variant="simple", **options)
