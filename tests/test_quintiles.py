import datetime as dt

import pytest
from pyspark.sql import functions as F

from factorlab.operators.portfolios import (
    extreme_portfolios, portfolios_long, portfolios_wide, pti_outcomes, quintiles_basic,
    quintiles_from_prices, quintiles_pti,
)
from factorlab.operators.returns import monthly_returns
from factorlab.operators.universe import asof_snapshots, members_asof, valid_tickers, validity_metadata
from factorlab.schemas import QUINTILES
from tests.panels import END, START, brute_monthly, brute_pti, months, random_prices, shift

SCHEMA = "ticker string, date date, price double"


@pytest.fixture(scope="module")
def rows():
    return random_prices(23)


@pytest.fixture(scope="module")
def prices(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).cache()


def index_of(rows):
    """Quarterly snapshots that each leave out some tickers."""
    tickers = sorted({r[0] for r in rows})
    return {m: [t for j, t in enumerate(tickers) if (j + i) % 7] for i, m in enumerate(months()[::3])}


def membership_frame(spark, index):
    pairs = [(day, t) for day, members in index.items() for t in members]
    return spark.createDataFrame(pairs, "date date, symbol string")


def latest(index):
    def members(day):
        past = [d for d in index if d <= day]
        return set(index[max(past)]) if past else set()
    return members


def as_dict(wide):
    return {r["date"]: [r[p] for p in QUINTILES] for r in wide.collect()}


def check(got, expected):
    assert set(got) == set(expected) and got
    for day in got:
        assert got[day] == pytest.approx(expected[day], abs=1e-9)


@pytest.mark.parametrize("lookback, coverage, minimum", [(6, 0.6, 1), (6, 0.7, 2), (12, 0.5, 1)])
def test_pti_matches_brute_force(spark, rows, prices, lookback, coverage, minimum):
    index = index_of(rows)
    got = quintiles_pti(
        monthly_returns(prices, START, END), START, END, membership=membership_frame(spark, index),
        lookbacks=[lookback], min_coverage=coverage, min_per_quintile=minimum,
    )
    check(as_dict(got), brute_pti(rows, latest(index), lookback, coverage, minimum))


def test_pti_without_index_and_two_lookbacks_at_once(spark, rows, prices):
    both = quintiles_pti(
        monthly_returns(prices, START, END), START, END, lookbacks=[6, 9], min_coverage=0.6,
        min_per_quintile=1,
    ).cache()
    for lookback in (6, 9):
        check(as_dict(both.filter(F.col("lookback") == lookback)),
              brute_pti(rows, lambda day: None, lookback, 0.6, 1))


def test_sliced_ranking_gives_the_same_quintiles(spark, rows, prices, monkeypatch):
    import factorlab.operators.portfolios as module

    plain = module.rank_within
    monkeypatch.setattr(module, "rank_within", lambda *a: plain(*a, single_task_rows=5))
    got = quintiles_pti(monthly_returns(prices, START, END), START, END, lookbacks=[6],
                        min_coverage=0.6, min_per_quintile=1)
    check(as_dict(got), brute_pti(rows, lambda day: None, 6, 0.6, 1))


def test_no_look_ahead(spark, rows):
    """Prices after the formation month change returns but never who is in a quintile."""
    cut = dt.date(2021, 1, 1)
    bent = [(t, d, p * (1 + (int(t[1:]) % 5)) if d >= cut else p) for t, d, p in rows]
    from factorlab.operators.portfolios import assign_quintiles, eligible_signals
    from factorlab.staging import stage

    def members(data):
        prices = spark.createDataFrame(data, SCHEMA)
        signals = stage(eligible_signals(monthly_returns(prices, START, END), START, END, None, [6], 0.6), "nla")
        known = signals.filter("vol IS NOT NULL")
        sizes = known.groupBy("lookback", "formation").agg(F.count("*").alias("n_vol"))
        placed = assign_quintiles(known, sizes, ["lookback", "formation"], 1)
        return {(r["formation"], r["ticker"]): r["quintile"]
                for r in placed.filter(F.col("formation") < F.lit(cut)).collect()}

    first = members(rows)
    assert first and first == members(bent)


def test_remainder_gets_no_quintile_and_ties_go_by_ticker(spark):
    from factorlab.operators.portfolios import assign_quintiles
    from factorlab.staging import stage

    signals = stage(spark.createDataFrame(
        [("m", f"T{i:02d}", 1.0 if i < 8 else 2.0) for i in range(13)], "month string, ticker string, vol double"
    ), "ties")
    sizes = signals.groupBy("month").agg(F.count("*").alias("n_vol"))
    placed = {r["ticker"]: r["quintile"] for r in assign_quintiles(signals, sizes, ["month"], 2).collect()}
    assert placed == {f"T{i:02d}": i // 2 + 1 for i in range(10)}   # 13 // 5 = 2, three left over
    assert assign_quintiles(signals, sizes, ["month"], 3).count() == 0


def test_outcomes_name_the_reason(spark, rows, prices):
    monthly = monthly_returns(prices, START, END)
    out = {r["date"]: r["outcome"] for r in pti_outcomes(monthly, START, END, lookbacks=[6], min_per_quintile=4).collect()}
    assert set(out) == set(months()[7:])
    assert "few_eligible" in out.values()
    last = pti_outcomes(monthly, START, END, lookbacks=[6], min_per_quintile=1).filter(
        F.col("date") == F.lit(END.replace(day=1))).first()
    assert last["outcome"] == "low_coverage" and last["P1"] is None


def test_basic_quintiles_and_extremes_match_brute_force(spark, rows, prices):
    import statistics

    monthly, returns, grid = monthly_returns(prices, START, END), brute_monthly(rows), months()
    tickers = sorted({t for t, _ in returns})
    quintiles, ends = {}, {}
    for i in range(12, len(grid)):
        vols = {}
        for t in tickers:
            window = [v for m in grid[i - 12:i] if (v := returns[t, m]) is not None]
            if len(window) >= 12 * 0.7:
                vols[t] = round(statistics.stdev(window), 9)
        order = sorted(vols, key=lambda t: (vols[t], t))

        def mean(names):
            values = [v for t in names if (v := returns[t, grid[i]]) is not None]
            return sum(values) / len(values) if values else None

        size = len(order) // 5
        if size >= 2 and len(order) >= 10:
            means = [mean(order[q * size:(q + 1) * size]) for q in range(5)]
            if None not in means:
                quintiles[grid[i]] = means
        low, high = (mean(order[:4]), mean(order[-4:])) if len(order) >= 8 else (None, None)
        ends[grid[i]] = (low, high) if None not in (low, high) else (None, None)
    check(as_dict(quintiles_basic(monthly, START, END, min_per_quintile=2)), quintiles)
    got = {r["date"]: r for r in extreme_portfolios(monthly, START, END, 12, 4).collect()}
    assert set(got) == set(ends)
    for day, (low, high) in ends.items():
        row = got[day]
        if low is None:
            assert row["LOW"] is None and row["HIGH"] is None and row["LONG_SHORT"] is None
        else:
            assert (row["LOW"], row["HIGH"], row["LONG_SHORT"]) == pytest.approx((low, high, low - high))


def test_unknown_method_and_missing_prices(spark, prices):
    monthly = monthly_returns(prices, START, END)
    with pytest.raises(ValueError):
        quintiles_pti(monthly, START, END, method="weekly")
    with pytest.raises(ValueError):
        quintiles_basic(monthly, START, END, method="daily252")


def test_end_to_end_limits_the_universe(spark, rows, prices):
    index = {START: sorted({r[0] for r in rows})}
    wide = quintiles_from_prices(prices, membership_frame(spark, index), START, END, min_coverage=0.6,
                                 min_per_quintile=1, max_tickers=19, lookbacks=[6])
    kept = set(index[START][:19])
    check(as_dict(wide), brute_pti([r for r in rows if r[0] in kept], latest(index), 6, 0.6, 1))


def test_long_and_wide_portfolios(spark, prices):
    wide = quintiles_pti(monthly_returns(prices, START, END), START, END, lookbacks=[6], min_per_quintile=1).cache()
    again = portfolios_wide(portfolios_long(wide)).select(wide.columns)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, wide.collect()))


def test_snapshot_on_the_formation_date_counts(spark):
    d = dt.date
    membership = spark.createDataFrame(
        [(d(2020, 1, 1), "A"), (d(2020, 2, 1), "B"), (d(2020, 3, 5), "A")], "date date, symbol string")
    formations = spark.createDataFrame([(d(2019, 12, 1),), (d(2020, 2, 1),), (d(2020, 3, 1),), (d(2020, 4, 1),)], "formation date")
    got = {r["formation"]: r["snapshot_date"] for r in asof_snapshots(membership, formations).collect()}
    assert got == {d(2020, 2, 1): d(2020, 2, 1), d(2020, 3, 1): d(2020, 2, 1), d(2020, 4, 1): d(2020, 3, 5)}
    members = {(r["formation"], r["ticker"]) for r in members_asof(membership, formations).collect()}
    assert members == {(d(2020, 2, 1), "B"), (d(2020, 3, 1), "B"), (d(2020, 4, 1), "A")}


def test_valid_tickers_match_definition(spark, rows, prices):
    formations = spark.createDataFrame([(m,) for m in months()], "formation date")
    spans = {}
    for t, day, _ in rows:
        low, high = spans.get(t, (day, day))
        spans[t] = (min(low, day), max(high, day))
    expected = {(f, t) for f in months() for t, (low, high) in spans.items() if low <= shift(f, -6) and high >= f}
    got = {(r["formation"], r["ticker"]) for r in valid_tickers(prices, formations).collect()}
    assert got == expected and got


def test_validity_metadata_of_single_rows(spark):
    d = dt.date
    rows = [("A", d(2020, 1, 1), 1.0), ("A", d(2020, 1, 4), 1.0), ("A", d(2020, 1, 5), 1.0), ("B", d(2020, 1, 1), 1.0)]
    got = {r["ticker"]: r for r in validity_metadata(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got["A"]["max_gap_days"], got["A"]["avg_gap_days"], got["A"]["duration_days"]) == (3, 2.0, 4)
    assert got["B"]["max_gap_days"] is None and got["B"]["avg_gap_days"] is None
