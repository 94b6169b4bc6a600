import datetime as dt
import json
import os
import re
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog import views as views_module
from catalog.queries import ON_TABLES
from catalog.views import Tables, END as CAT_END, START as CAT_START
from factorlab.operators import portfolios as portfolios_module
from factorlab.operators.portfolios import (
    eligible_signals, extreme_portfolios, extremes_from_prices, quintiles_pti,
)
from factorlab.operators.returns import monthly_returns
from factorlab.operators.sizing import broadcast_if_small
from factorlab.plans import analysis as analysis_module
from factorlab.plans.analysis import (
    AnalysisConfig, joint_significance, quick_analysis, run_analysis,
)
from factorlab.schemas import FACTOR_TABLE
from factorlab.sources import prices as prices_module
from factorlab.sources.constituents import explode_members
from tests.panels import END, START, months, random_prices

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def inputs(spark):
    rows = random_prices(25, seed=8, gap=0.0, steps=(3, 4))
    prices = spark.createDataFrame(rows, "ticker string, date date, price double").cache()
    members = spark.createDataFrame([(START, t) for t in sorted({r[0] for r in rows})], "date date, symbol string")
    rng = np.random.default_rng(0)
    factors = spark.createDataFrame(
        [(m, *map(float, rng.normal(0, 2, 5)), 0.1) for m in months()], FACTOR_TABLE).cache()
    return prices, members, factors


def test_whole_study(spark, inputs, tmp_path):
    prices, members, factors = inputs
    config = AnalysisConfig(start=START, end=END, lookbacks=(4, 6), min_per_quintile=1, output_dir=str(tmp_path))
    tables = run_analysis(config, prices, factors, members)
    direct = quintiles_pti(monthly_returns(prices, START, END), START, END, membership=members,
                           lookbacks=[4, 6], min_coverage=0.6, min_per_quintile=1)
    assert sorted(map(tuple, tables["portfolios"].collect())) == sorted(map(tuple, direct.collect()))
    assert tables["performance"].count() == 12 and tables["regressions"].count() == 36
    assert tables["alphas"].count() == 12 and tables["joint_test"].count() == 2 * 3
    assert tables["lookback_correlations"].first()["lb1"] == 4
    assert {r["status"] for r in tables["joint_test"].collect()} == {"ok"}
    for name in ("cumulative", "drawdowns", "rolling", "risk_return", "subperiods", "rolling_summary",
                 "loadings", "residuals", "report", "summary", "skip_reasons"):
        tables[name].collect()
    simple = joint_significance(
        tables["regressions"].filter("lookback = 6"), tables["residuals"].filter("lookback = 6"), factors, ["P1", "P5"])
    assert simple.first()["status"] == "ok"

    base = tmp_path / f"{START}_to_{END}"
    assert {"portfolios", "results", "report", "subperiods", "rolling_summary", "lookback_correlations", "summary"} <= set(os.listdir(base))
    assert os.path.isdir(base / "portfolios" / "lookback=4")
    text = spark.read.text(str(base / "results")).first()[0]
    document = json.loads(text)
    assert document["period"] == {"start": str(START), "end": str(END)}
    assert len(document["performance"]) == 6 and len(document["factor_results"]) == 18


def test_quick_study_and_custom_list(spark, inputs):
    prices, _, factors = inputs
    own = prices.select("ticker").distinct()
    tables = quick_analysis(START, END, prices, factors=factors, tickers=own)
    assert "rolling" not in tables and "subperiods" not in tables
    assert {r["model"] for r in tables["regressions"].collect()} <= {"CAPM"}
    with pytest.raises(ValueError):
        run_analysis(replace(AnalysisConfig(), start=START, end=END), prices)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_panel_is_shuffled_by_day_month_and_ticker_only(spark):
    tables = Tables(spark, SF)
    plan = plan_of(eligible_signals(
        monthly_returns(tables.prices, CAT_START, CAT_END), CAT_START, CAT_END, None, [6, 12, 24], 0.6))
    # Days and months are pre-aggregated; all windows of all lookbacks share the third exchange.
    assert plan.count("Exchange hashpartitioning") == 3
    assert plan.count("partial_min_by") == 1 and plan.count("partial_sum") >= 1
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_scan_reads_few_columns_and_pushes_the_period(spark):
    plan = plan_of(monthly_returns(Tables(spark, SF).prices, dt.date(1997, 1, 1), dt.date(1998, 12, 31)))
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line)
    assert "l_extendedprice" not in scan and "l_orderkey" not in scan
    assert "GreaterThanOrEqual(l_shipdate" in scan and "LessThan(l_shipdate" in scan


def test_membership_join_leaves_the_panel_in_place(spark):
    tables = Tables(spark, SF)
    monthly, membership = tables.monthly, tables.membership
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = plan_of(eligible_signals(monthly, CAT_START, CAT_END, membership, [12], 0.6))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # The stored panel moves once, by ticker, for its windows; the join on ticker reuses that.
    join = plan[plan.index("Join [ticker"):]
    panel_side = join[:join.index("collect_set")]
    assert panel_side.count("Exchange hashpartitioning(ticker") == 1


def test_broadcast_depends_on_size(spark):
    small = spark.range(10)
    assert "ResolvedHint" in broadcast_if_small(small)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in broadcast_if_small(small, 5)._jdf.queryExecution().analyzed().toString()
    assert broadcast_if_small(small, 5).agg(F.count("*")).first()[0] == 10


def test_study_without_five_factors(spark, inputs):
    """Models whose factors lack are skipped with a status; the others are tested."""
    prices, members, factors = inputs
    config = AnalysisConfig(start=START, end=END, lookbacks=(4,), min_per_quintile=1)
    tables = run_analysis(config, prices, factors.drop("RMW", "CMA"), members)
    assert {r["model"]: r["status"] for r in tables["joint_test"].collect()} == {
        "CAPM": "ok", "FF3": "ok", "FF5": "missing_factors"}
    assert {r["model"] for r in tables["regressions"].select("model").distinct().collect()} == {"CAPM", "FF3"}


def test_repeated_and_missing_prices_change_nothing(spark, inputs):
    prices, members, _ = inputs
    config = AnalysisConfig(start=START, end=END, lookbacks=(4,), min_per_quintile=1, run_series=False, run_subperiods=False, run_robustness=False)
    twice = prices.unionByName(prices).unionByName(prices.selectExpr("ticker", "date", "CAST(NULL AS DOUBLE) AS price"))
    once = run_analysis(config, prices, None, members)["portfolios"].collect()
    assert sorted(map(tuple, run_analysis(config, twice, None, members)["portfolios"].collect())) == sorted(map(tuple, once))


def test_a_universe_of_more_than_a_hundred_is_whole(spark):
    rows = random_prices(130, seed=3, gap=0.0, steps=(3, 4))
    prices = spark.createDataFrame(rows, "ticker string, date date, price double")
    members = spark.createDataFrame([(START, t) for t in sorted({r[0] for r in rows})], "date date, symbol string")
    capped = extremes_from_prices(prices, members, START, END, max_tickers=100, size=20)
    whole = extremes_from_prices(prices, members, START, END, size=20)
    direct = extreme_portfolios(monthly_returns(prices, START, END), START, END, size=20)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, direct.collect())) != sorted(map(tuple, capped.collect()))


def test_long_symbols_do_not_merge(spark):
    snapshots = spark.createDataFrame([(START, ["ABCDEFGHIJ", "ABCDEFGHIK"])], "date date, tickers array<string>")
    assert explode_members(snapshots).count() == 2 and explode_members(snapshots, cut=True).count() == 1


def test_a_monthly_study_scans_the_prices_once_and_stages_no_days(spark, monkeypatch, tmp_path):
    rows = random_prices(25, seed=8, gap=0.0, steps=(3, 4))
    prices = spark.createDataFrame(rows, "ticker string, date date, price double")
    prices.unionByName(prices).write.parquet(str(tmp_path / "each-quote-twice"))
    store = spark.read.parquet(str(tmp_path / "each-quote-twice"))
    members = spark.createDataFrame([(START, t) for t in sorted({r[0] for r in rows})], "date date, symbol string")
    seen = []

    def noted(df, name):
        out = real(df, name)
        seen.append((name, plan_of(df), out.count(), any("each-quote-twice" in f for f in df.inputFiles())))
        return out

    real = prices_module.stage
    for module in (prices_module, analysis_module, portfolios_module):
        monkeypatch.setattr(module, "stage", noted)
    config = AnalysisConfig(start=START, end=END, lookbacks=(4,), min_per_quintile=1, run_series=False, run_subperiods=False, run_robustness=False)
    run_analysis(config, store, None, members)["portfolios"].collect()
    scans = [name for name, _, _, from_store in seen if from_store]
    assert scans == ["stored-months"]
    months_plan = next(plan for name, plan, *_ in seen if name == "stored-months")
    # One exchange of month buckets and one of the names asked for; none by day.
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", months_plan)
    assert [k.count("#") for k in keys] == [2, 1] and keys[0].startswith("ticker#") and "_groupingexpression" in keys[0]
    assert not any("date#" in k for k in keys)
    assert all(count < len(rows) for _, _, count, _ in seen)


def test_joint_tests_of_all_models_have_one_plan(spark, inputs):
    prices, members, factors = inputs
    tables = run_analysis(AnalysisConfig(start=START, end=END, lookbacks=(4, 6), min_per_quintile=1), prices, factors, members)
    plan = plan_of(tables["joint_test"])
    assert plan.count("MapInPandas") == 1 and "Union" not in plan


def test_a_study_reads_the_lines_once_and_never_sorts_days(spark, monkeypatch):
    """Days form in the task that their supplier's month was sent to; panel and prices share them."""
    seen = {}

    def noted(df, name):
        from_lines = any("lineitem" in f for f in df.inputFiles())
        seen[name] = (plan_of(df), from_lines)
        return real(df, name)

    real = prices_module.stage
    for module in (views_module, prices_module, analysis_module, portfolios_module):
        monkeypatch.setattr(module, "stage", noted)
    assert ON_TABLES["study_three_factors"](Tables(spark, SF)).count() == 3
    assert [name for name, (_, from_lines) in seen.items() if from_lines] == ["days"]
    plan = seen["days"][0]
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert len(keys) == 1 and re.match(r"l_suppkey#\w+, month#\w+,", keys[0])
    assert "SortAggregate" not in seen["panel"][0] and "SortAggregate" not in seen["stored-months"][0]


def test_the_quick_study_reads_the_lines_once(spark, monkeypatch):
    read = []

    def noted(df, name):
        read.extend([name] if any("lineitem" in f for f in df.inputFiles()) else [])
        return real(df, name)

    real = prices_module.stage
    for module in (views_module, prices_module, analysis_module, portfolios_module):
        monkeypatch.setattr(module, "stage", noted)
    assert ON_TABLES["quick_study"](Tables(spark, SF)).count() >= 0
    assert read == ["days"]
