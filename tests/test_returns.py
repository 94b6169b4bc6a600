import datetime as dt
import math
import random
import statistics

import pytest

from factorlab.functions.dates import month_grid
from factorlab.operators.returns import (
    daily_returns, dense_months, monthly_returns, returns_long, returns_wide, trading_calendar,
)
from factorlab.operators.signals import formation_blocks, vol_daily, vol_monthly
from factorlab.operators.universe import gap_summaries, validity_metadata
from factorlab.sources.prices import one_price_per_day
from tests.panels import END, START, brute_monthly, months, random_prices

SCHEMA = "ticker string, date date, price double"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def days(month, prices, ticker="A"):
    return [(ticker, month.replace(day=2 + i), float(p)) for i, p in enumerate(prices)]


def test_four_days_give_no_return_but_still_a_base(spark):
    jan, feb, mar, apr = (dt.date(2020, m, 1) for m in (1, 2, 3, 4))
    rows = days(jan, [100, 1, 1, 1, 110]) + days(feb, [120, 1, 1, 99]) + days(mar, [1, 1, 1, 1, 198])
    got = {r["month"]: r["ret"] for r in monthly_returns(frame(spark, rows), jan, apr).collect()}
    assert got[jan] == pytest.approx(10.0)        # first grid month: own first price
    assert got[feb] is None                       # four days
    assert got[mar] == pytest.approx(100.0)       # base is February's last price


def test_gap_month_uses_own_first_price_and_last_month_is_empty(spark):
    jan, mar = dt.date(2020, 1, 1), dt.date(2020, 3, 1)
    rows = days(jan, [100] * 5) + days(mar, [50, 1, 1, 1, 55]) + days(dt.date(2020, 4, 1), [1] * 6)
    monthly = monthly_returns(frame(spark, rows), jan, dt.date(2020, 4, 30))
    got = {r["month"]: r["ret"] for r in dense_months(monthly, dt.date(2020, 4, 30)).collect()}
    assert got[mar] == pytest.approx(10.0)
    assert got[dt.date(2020, 2, 1)] is None and dt.date(2020, 2, 1) in got
    assert got[dt.date(2020, 4, 1)] is None
    kept = monthly_returns(frame(spark, rows), jan, dt.date(2020, 4, 30), drop_last_month=False)
    assert kept.filter("month = DATE'2020-04-01'").first()["ret"] is not None


def test_monthly_returns_match_brute_force(spark):
    rows = random_prices()
    got = {(r["ticker"], r["month"]): r["ret"]
           for r in monthly_returns(frame(spark, rows), START, END).collect()}
    expected = {k: v for k, v in brute_monthly(rows).items() if k in got}
    assert set(got) == set(expected)
    for key, value in expected.items():
        assert got[key] == (None if value is None else pytest.approx(value, abs=1e-10)), key
    assert all(v is None for k, v in brute_monthly(rows).items() if k not in got)


def test_daily_return_needs_the_trading_day_before(spark):
    d = [dt.date(2020, 1, i) for i in (2, 3, 6, 7)]
    rows = [("A", d[0], 100.0), ("A", d[1], 110.0), ("A", d[3], 121.0)] + [("B", x, 10.0) for x in d]
    got = {(r["ticker"], r["date"]): r["ret"] for r in daily_returns(frame(spark, rows)).collect()}
    assert got["A", d[0]] is None and got["A", d[1]] == pytest.approx(10.0)
    assert got["A", d[3]] is None                 # 6 January is a trading day A missed
    assert got["B", d[3]] == 0.0


def test_daily_vol_window_is_strictly_before_the_anchor(spark):
    first = dt.date(2020, 1, 1)
    rows, price = [], 100.0
    for i in range(60):
        price *= 1.01 if i % 2 else 0.99
        if i == 31:
            price *= 3                            # the anchor day itself, 1 February
        rows.append(("A", first + dt.timedelta(days=i), price))
    formations = spark.sql("SELECT DATE'2020-02-01' AS formation UNION ALL SELECT DATE'2020-01-10'")
    got = vol_daily(frame(spark, rows), formations, window_days=20, min_obs=15).collect()
    assert [r["formation"] for r in got] == [dt.date(2020, 2, 1)]   # January has too little history
    assert got[0]["n_obs"] == 20 and got[0]["vol"] < 20


def test_vol_survives_a_tickers_last_month(spark):
    rows = []
    for m in range(1, 13):
        rows += days(dt.date(2020, m, 1), [100 + m, 1, 1, 1, 100 + m * m])
    monthly = monthly_returns(frame(spark, rows), dt.date(2020, 1, 1), dt.date(2021, 12, 1))
    vols = vol_monthly(dense_months(monthly, dt.date(2021, 12, 1), tail=12), dt.date(2020, 1, 1), 12)
    # 12 * 0.7 = 8.4: windows that still hold nine of the twelve returns.
    assert sorted(r["n_obs"] for r in vols.collect()) == [9, 10, 11, 12]


def test_wide_and_long_are_inverse(spark):
    monthly = monthly_returns(frame(spark, random_prices(3)), START, END)
    wide = returns_wide(monthly, ["T00", "T01", "T02"], START, END)
    assert wide.count() == 24 and wide.columns == ["date", "T00", "T01", "T02"]
    long = {(r["ticker"], r["month"]): r["ret"] for r in returns_long(wide).collect()}
    for r in monthly.collect():
        assert long[r["ticker"], r["month"]] == r["ret"]


def test_one_price_per_day(spark):
    day = dt.date(2020, 1, 2)
    rows = spark.createDataFrame([("A", day, 5.0, 2), ("A", day, 7.0, 1)], SCHEMA + ", seq int")
    assert one_price_per_day(rows, "seq").first()["price"] == 7.0
    assert one_price_per_day(rows.drop("seq")).first()["price"] == 5.0


def test_month_grid(spark):
    got = [r["month"] for r in month_grid(spark, dt.date(2020, 1, 15), dt.date(2020, 3, 2)).collect()]
    assert got == [dt.date(2020, 1, 1), dt.date(2020, 2, 1), dt.date(2020, 3, 1)]


def test_blocks_reduce_before_they_meet_windows(spark):
    """Daily volatility by blocks equals the deviation over each window, and sends fewer rows than it reads."""
    rng = random.Random(5)
    rows = [(f"T{k}", START + dt.timedelta(days=i), 100 * math.exp(rng.gauss(0, 0.2))) for k in range(4) for i in range(400) if rng.random() < 0.9]
    prices = spark.createDataFrame(rows, "ticker string, date date, price double")
    formations = spark.createDataFrame([(m,) for m in months(START, END)], "formation date")
    got = {(r.ticker, r.formation): (r.vol, r.n_obs) for r in vol_daily(prices, formations, 60, 20).collect()}
    calendar = sorted({d for _, d, _ in rows})
    at, by = {d: i + 1 for i, d in enumerate(calendar)}, {}
    for t, d, p in rows:
        by.setdefault(t, {})[at[d]] = p
    want = {}
    for m in months(START, END):
        anchor = next((at[d] for d in calendar if d >= m), None)
        if anchor is None or anchor <= 60:
            continue
        for t, own in by.items():
            moves = [(own[i] / own[i - 1] - 1) * 100 for i in range(anchor - 60, anchor) if i in own and i - 1 in own]
            if len(moves) >= 20:
                want[t, m] = (round(statistics.stdev(moves) * math.sqrt(252), 9), len(moves))
    assert got.keys() == want.keys() and all(abs(got[k][0] - want[k][0]) < 2e-9 and got[k][1] == want[k][1] for k in want)
    blocks, inside = formation_blocks(trading_calendar(prices), formations, 60)
    assert blocks.count() == len(calendar)
    sent = prices.join(blocks, "date").groupBy("ticker", "block").count().join(inside, "block").selectExpr("sum(size(formations)) AS n").first()["n"]
    assert sent < len(rows)


def test_gaps_of_a_hot_ticker_need_no_daily_window(spark):
    hot = spark.range(200_000).selectExpr("'HOT' AS ticker", "date_add(DATE'2000-01-03', CAST(id % 2000 * 3 AS INT)) AS date", "1.0D AS price")
    few = spark.createDataFrame([("ONE", dt.date(2020, 2, 29), 1.0), ("TWO", dt.date(2019, 12, 31), 1.0), ("TWO", dt.date(2020, 3, 1), 1.0),
                                 ("TWO", dt.date(2020, 3, 1), 2.0)], "ticker string, date date, price double")
    prices = hot.unionByName(few)
    got = {r.ticker: (r.total_observations, r.max_gap_days, r.duration_days) for r in validity_metadata(prices).collect()}
    assert got == {"HOT": (200_000, 3, 1999 * 3), "ONE": (1, None, 0), "TWO": (3, 61, 61)}
    assert gap_summaries(prices).count() < 400  # what the window sees
    plan = validity_metadata(prices)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Window") < plan.index("partial_bit_or") and plan.count("Exchange hashpartitioning") == 2
