import datetime as dt

import pytest
from pyspark.sql import functions as F

from factorlab.operators.performance import (
    dashboard, drawdown_series, excess_sharpe, growth_path, performance, risk_return_table,
    rolling_long_short, rolling_metrics, rolling_summary,
)
from tests.panels import shift

# 46 months of the calmest quintile and of the long-short return,
# from 2021-02 on, percent.
MONTHS = [
    (-1.436211, -17.732787), (8.827159, 5.068865), (4.356315, 0.373190), (2.211934, -1.182855),
    (-0.111268, 0.412346), (2.827658, 6.504315), (2.744327, 0.621230), (-5.359413, -5.536512),
    (5.869201, 0.213009), (-1.815071, 0.780664), (8.828258, 3.963338), (-4.548240, -1.340365),
    (-0.769141, -1.926151), (2.853085, 0.313218), (-3.956349, 6.115268), (1.118338, -1.585812),
    (-6.527338, 7.010706), (5.014993, -7.195805), (-1.823080, 2.316088), (-7.830281, 3.274477),
    (9.572919, -2.625761), (4.881200, -2.694526), (-2.995698, 4.528042), (2.222209, -11.325000),
    (-3.277421, -0.229648), (0.235822, 0.356949), (3.260941, 5.884136), (-5.221361, -4.741135),
    (3.567985, -7.630236), (1.370002, -4.843744), (-2.976153, 1.953598), (-4.694073, 2.356360),
    (-1.163644, 7.452621), (5.874363, -6.170768), (1.918465, -10.538277), (0.839992, 4.223745),
    (2.192593, -2.196103), (3.544558, -1.190241), (-2.551850, 3.911252), (3.096508, 0.899897),
    (-0.126255, 2.224905), (4.629640, 0.073968), (4.945537, 5.633243), (1.066515, -2.547483),
    (-0.951326, 1.383163), (5.284678, -1.365824)
]
FIRST = dt.date(2021, 2, 1)


@pytest.fixture(scope="module")
def long(spark):
    rows = []
    for i, (p1, spread) in enumerate(MONTHS):
        day = shift(FIRST, i)
        rows += [("P1", day, p1), ("P5", day, p1 - spread), ("LowMinusHigh", day, spread)]
    return spark.createDataFrame(rows, "portfolio string, date date, ret double").cache()


# Annual return, volatility, Sharpe, Sortino, drawdown, skewness, kurtosis, cumulative.
EXPECTED = {
    "P1": (11.7446, 14.3445, 0.8188, 1.4414, -0.15961, -0.0394, -0.6490, 50.692),
    "P5": (16.1143, 24.0500, 0.6700, 1.1956, -0.23640, 0.0998, -0.5516, 66.176),
    "LowMinusHigh": (-4.3697, 17.8218, -0.2452, -0.2869, -0.28041, -1.0014, 1.3532, -20.571),
}


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_golden_performance(long, name):
    row = performance(long).filter(F.col("portfolio") == name).first()
    final = growth_path(long, ["portfolio"]).filter(
        (F.col("portfolio") == name) & (F.col("date") == F.lit(shift(FIRST, 45)))
    ).first()["cum_ret"]
    got = (row["annual_return"], row["annual_vol"], row["sharpe_ratio"], row["sortino_ratio"],
           row["max_drawdown"], row["skewness"], row["kurtosis"], final)
    assert got == pytest.approx(EXPECTED[name], abs=6e-4)
    assert row["n_months"] == 46
    assert row["calmar_ratio"] == pytest.approx(row["annual_return"] / abs(row["max_drawdown"]))


def test_golden_rolling_sharpe(long):
    rolling = rolling_long_short(long, ["portfolio"], skip_first=11).cache()
    summary = rolling_summary(rolling).first()
    assert summary["n_windows"] == 24
    assert rolling.agg(F.min("date")).first()[0] == dt.date(2022, 12, 1)
    assert (summary["mean"], summary["std"], summary["min"], summary["max"]) == pytest.approx(
        (-0.427351, 0.491145, -1.286093, 0.425455), abs=2e-6)
    assert rolling_long_short(long, ["portfolio"]).count() == 35


def test_short_series_have_no_rolling_metrics(long):
    assert rolling_metrics(long.filter(F.col("date") < F.lit(shift(FIRST, 35)))).count() == 0


def test_tables_agree(long):
    table = {r["portfolio"]: r for r in risk_return_table(long).collect()}
    board = {r["portfolio"]: r for r in dashboard(long).collect()}
    for name in table:
        assert table[name]["annual_return"] == pytest.approx(board[name]["mean_ret"] * 12)
        assert table[name]["sharpe_ratio"] == pytest.approx(board[name]["sharpe_month"] * 12 ** 0.5)


def test_drawdown_starts_at_the_first_month(spark):
    rows = [("A", shift(FIRST, i), r) for i, r in enumerate([-50.0, 10.0, -10.0])]
    path = drawdown_series(spark.createDataFrame(rows, "portfolio string, date date, ret double"))
    assert [r["drawdown"] for r in path.orderBy("date").collect()] == pytest.approx([0.0, 0.0, -0.1])


def test_degenerate_series_yield_null(spark):
    rows = [("A", shift(FIRST, i), 1.0) for i in range(5)] + [("B", FIRST, 1.0)]
    got = {r["portfolio"]: r for r in performance(
        spark.createDataFrame(rows, "portfolio string, date date, ret double")).collect()}
    assert got["A"]["sharpe_ratio"] is None and got["A"]["calmar_ratio"] is None
    assert got["A"]["sortino_ratio"] is None and got["A"]["max_drawdown"] == 0.0
    assert got["B"]["annual_vol"] is None and got["B"]["skewness"] is None


def test_excess_sharpe_needs_twelve_months(spark, long):
    factors = spark.createDataFrame(
        [(shift(FIRST, i), 0.1 + 0.01 * i if i != 3 else None) for i in range(46)], "date date, RF double")
    full = excess_sharpe(long, factors).filter("portfolio = 'P1'").first()
    assert full["n_obs"] == 45 and full["sharpe_annual"] == pytest.approx(full["sharpe_monthly"] * 12 ** 0.5)
    few = excess_sharpe(long, factors.filter(F.col("date") < F.lit(shift(FIRST, 12)))).first()
    assert few["n_obs"] == 11 and few["sharpe_monthly"] != few["sharpe_monthly"]
