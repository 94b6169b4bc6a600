import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from factorlab.operators.returns import month_buckets
from factorlab.schemas import CONSTITUENTS_FILE, FACTOR_TABLE
from factorlab.sources import constituents as C, factors as FAC, prices as PR
from factorlab.staging import stage

D = dt.date
PRICES = "ticker string, date date, price double"


def test_constituent_files(spark, tmp_path):
    path = tmp_path / "members.csv"
    path.write_text('date,tickers\n2020-02-01,"AAPL, MSFT ,,BRK.B"\n2020-01-02,"AAPL,AAMRQ"\n')
    strict = {r["date"]: r["tickers"] for r in C.read_constituents(spark, str(path)).collect()}
    assert strict == {D(2020, 2, 1): ["AAPL", "MSFT", "BRK.B"], D(2020, 1, 2): ["AAPL", "AAMRQ"]}
    loose = C.read_constituents(spark, str(path), strict=False).orderBy("date").collect()
    assert loose[1]["tickers_array"] == ["AAPL", " MSFT ", "", "BRK.B"]
    snapshots = C.read_constituents(spark, str(path))
    profile = C.constituent_profile(snapshots).first()
    assert (profile["n_snapshots"], profile["mean_tickers"]) == (2, 2.5)
    members = C.explode_members(snapshots)
    universe = C.universe_for_period(members, D(2020, 1, 1), D(2020, 1, 31)).collect()
    assert [(r["symbol"], r["looks_extinct"]) for r in universe] == [("AAMRQ", True), ("AAPL", False)]
    with pytest.raises(ValueError):
        C.universe_for_period(members, D(2019, 1, 1), D(2019, 1, 31))
    order = C.universe_in_order(members, D(2020, 1, 1), D(2020, 12, 31)).collect()
    assert [r["symbol"] for r in order] == ["AAMRQ", "AAPL", "BRK-B", "MSFT"]
    bad = tmp_path / "bad.csv"
    bad.write_text("day,names\n2020-01-01,A\n")
    with pytest.raises(ValueError):
        C.read_constituents(spark, str(bad))
    with pytest.raises(Exception):
        C.read_constituents(spark, str(tmp_path / "absent.csv"))


def test_raw_universe_skips_null_lists(spark):
    raw = spark.createDataFrame([("2020-01-01", "B, A"), ("2020-01-02", None)], CONSTITUENTS_FILE)
    got = C.universe_from_raw(raw, D(2020, 1, 1), D(2020, 1, 5)).collect()
    assert [r["symbol"] for r in got] == ["A", "B"]
    own = spark.createDataFrame([("fb",), ("META",)], "s string")
    assert [r["symbol"] for r in C.custom_universe(own).collect()] == ["META"]


def test_price_files_round_trip(spark, tmp_path):
    for name, price in (("AAPL", 1.5), ("BF-B", 2.5)):
        (tmp_path / f"{name}.csv").write_text(f"date,price\n2020-01-02,{price}\n2020-01-03,{price}\n")
    prices = PR.read_price_files(spark, str(tmp_path))
    assert {(r["ticker"], r["price"]) for r in prices.collect()} == {("AAPL", 1.5), ("BF-B", 2.5)}
    PR.write_prices(prices, str(tmp_path / "store"))
    assert PR.read_prices(spark, str(tmp_path / "store")).count() == 4
    PR.write_price_directories(prices, str(tmp_path / "dirs"))
    assert os.path.isdir(tmp_path / "dirs" / "ticker=AAPL")


def test_coverage_and_success(spark):
    prices = spark.createDataFrame([("A", D(2020, 1, 1), 1.0), ("A", D(2020, 6, 1), 1.0)], PRICES)
    asks = spark.createDataFrame(
        [("A", D(2020, 1, 1), D(2020, 6, 1)), ("A", D(2019, 1, 1), D(2020, 2, 1)), ("B", D(2020, 1, 1), D(2020, 2, 1))],
        'ticker string, start date, `end` date')
    rows = PR.coverage(asks, prices)
    assert sorted(r["status"] for r in rows.collect()) == ["covered", "missing", "partial"]
    got = PR.load_success(rows).first()
    assert (got["requested"], got["obtained"], got["failed"], got["success_rate"]) == (3, 2, 1, 66.7)


def test_sources_prefer_the_resolved_symbol_and_fall_back(spark):
    day = D(2020, 1, 2)
    prices = spark.createDataFrame(
        [("RTX", day, 1.0), ("UTX", day, 2.0), ("FB", day, 3.0), ("TWTR", day, 4.0), ("MS", D(2019, 1, 1), 5.0)], PRICES)
    wanted = spark.createDataFrame([("UTX",), ("RTN",), ("FB",), ("TWTR",), ("ETFC",), ("NONE",)], "ticker string")
    got = {r["ticker"]: (r["source_symbol"], r["price"], r["data_start"])
           for r in PR.acquire_prices(wanted, prices, D(2020, 1, 1), D(2020, 12, 31)).collect()}
    assert got == {"UTX": ("RTX", 1.0, day), "RTN": ("RTX", 1.0, day), "FB": ("FB", 3.0, day), "TWTR": ("TWTR", 4.0, day)}


def test_later_batches_replace_a_ticker_whole(spark):
    one = spark.createDataFrame([("A", D(2020, 1, 1), 1.0), ("A", D(2020, 1, 2), 1.0), ("B", D(2020, 1, 1), 1.0)], PRICES)
    two = spark.createDataFrame([("A", D(2020, 1, 1), 9.0)], PRICES)
    got = {(r["ticker"], r["price"]) for r in PR.upsert_batches([one, two]).collect()}
    assert got == {("A", 9.0), ("B", 1.0)}


FILE = """Preamble line
202001 is not data here

,Mkt-RF,SMB,HML,RMW,CMA,RF
202001,   -0.11,  -3.11,  -6.25,  -1.20,  -2.31,   0.13
202002,   -8.13,   1.07,  -3.80,  -1.49,  -2.52,   0.12
202003,  -13.39,  -4.88,  -13.97, oops,  1.59,   0.13
20200,1,2,3,4,5,6
202004,   13.65,   2.45,  -1.33,   2.75,  -1.02, -99.99

 Annual Factors: January-December
,Mkt-RF,SMB,HML,RMW,CMA,RF
2020,   23.66,  13.18, -46.57, -21.05, -11.39,   0.45
202105,1,1,1,1,1,1
Copyright 2025
"""


def test_factor_files(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text(FILE.replace("\n", "\r\n"))
    lines = FAC.read_factor_lines(spark, str(path))
    got = FAC.parse_factor_lines(lines).orderBy("date").collect()
    assert [r["date"] for r in got] == [D(2020, 1, 1), D(2020, 2, 1), D(2020, 4, 1)]
    assert (got[0]["MKT_RF"], got[0]["CMA"], got[2]["RF"]) == (-0.11, -2.31, -99.99)
    cleaned = FAC.parse_factor_lines(lines, null_sentinels=[-99.99]).orderBy("date").collect()
    assert cleaned[2]["RF"] is None and cleaned[2]["MKT_RF"] == 13.65


def test_factor_store_is_used_only_when_it_covers(spark, tmp_path):
    source, store = tmp_path / "f.csv", str(tmp_path / "store")
    source.write_text(FILE)
    first = FAC.get_factors(spark, str(source), store, D(2020, 1, 1), D(2020, 2, 29))
    assert first.count() == 2 and FAC.read_factors(spark, store).count() == 3   # the store is whole
    source.write_text(FILE.replace("202004", "202005"))
    # A month-end request is covered by the same month.
    assert FAC.get_factors(spark, str(source), store, D(2020, 1, 1), D(2020, 4, 30)).count() == 3
    assert FAC.get_factors(spark, str(source), store, D(2020, 1, 1), D(2020, 5, 31)).count() == 3
    assert FAC.read_factors(spark, store).agg(F.max("date")).first()[0] == D(2020, 5, 1)
    source.write_text(FILE)
    assert FAC.get_factors(spark, str(source), store, D(2020, 1, 1), D(2020, 3, 1), force_refresh=True).count() == 2
    assert FAC.read_factors(spark, store).agg(F.max("date")).first()[0] == D(2020, 4, 1)


def test_factor_summaries(spark):
    rows = [(D(2020, m, 1), float(m), 2.0 * m, -1.0 * m, 1.0, 0.0, 0.1) for m in range(1, 5)]
    factors = stage(spark.createDataFrame(rows, FACTOR_TABLE), "factors")
    summary = {r["factor"]: r for r in FAC.factor_summary(factors).collect()}
    assert summary["MKT_RF"]["mean"] == 2.5 and summary["SMB"]["max"] == 8.0 and len(summary) == 6
    corr = FAC.factor_correlations(factors).first()
    assert (corr["mkt_smb"], corr["mkt_hml"]) == (pytest.approx(1), pytest.approx(-1))
    assert FAC.factor_validation(factors).first()["n_months"] == 4


def test_hot_ticker_combines_before_it_shuffles(spark):
    hot = spark.range(3000).selectExpr(
        "'HOT' AS ticker", "date_add(DATE'2020-01-01', CAST(id % 20 AS INT)) AS date", "double(1 + id % 7) AS price")
    rest = spark.range(6000).selectExpr(
        "concat('T', id % 300) AS ticker", "date_add(DATE'2020-01-01', CAST(id % 20 AS INT)) AS date", "2.0D AS price")
    daily = PR.one_price_per_day(hot.unionByName(rest))
    plan = daily._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and plan.index("partial_min") > plan.index("Exchange hashpartitioning")
    got = {r["ticker"]: r["n"] for r in daily.groupBy("ticker").agg(F.count("*").alias("n")).collect()}
    assert got["HOT"] == 20 and len(got) == 301


def test_stored_months_equal_buckets_of_sound_prices(spark):
    rows = [("A", D(2020, 1, d), float(p)) for d, p in ((2, 5), (2, 3), (2, 4), (9, 7), (31, 8), (31, 6), (31, 9))]
    rows += [("A", D(2020, 2, 3), None), ("A", D(2020, 2, 4), 2.0), ("B", D(2020, 1, 1), None)]
    prices = spark.createDataFrame(rows, PRICES)
    got = sorted(map(tuple, PR.stored_months(prices, D(2020, 1, 1), D(2020, 12, 31)).collect()))
    want = sorted(map(tuple, month_buckets(PR.sound_prices(prices), D(2020, 1, 1), D(2020, 12, 31)).collect()))
    assert got == want and got[0][2:5] == (3, 3.0, 6.0) and len(got) == 2


def test_late_binding_equals_early_binding(spark):
    days = [(D(2020, m, d), float(m + d)) for m in (1, 2) for d in (3, 10, 20)]
    rows = [(t, day, p + k) for k, t in enumerate(("RTX", "UTX", "FB", "TWTR")) for day, p in days] + [("META", D(2019, 1, 1), 5.0)]
    prices = spark.createDataFrame(rows, PRICES)
    wanted = spark.createDataFrame([("UTX",), ("RTN",), ("FB",), ("TWTR",), ("NONE",)], "ticker string")
    first, last = D(2020, 1, 1), D(2020, 12, 31)
    early = PR.acquire_prices(wanted, prices, first, last)
    late = PR.acquire_months(wanted, prices, first, last)
    columns = ["ticker", "month", "n_days", "first_price", "last_price", "first_day", "last_day"]
    assert sorted(map(tuple, late.select(columns).collect())) == sorted(map(tuple, month_buckets(early, first, last).select(columns).collect()))
    assert {(r.ticker, r.source_symbol) for r in late.collect()} == {("UTX", "RTX"), ("RTN", "RTX"), ("FB", "FB"), ("TWTR", "TWTR")}


def test_only_touched_buckets_are_renewed(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [(f"T{k}", D(2020, 1, d), float(d)) for k in range(40) for d in (1, 2, 3)]
    PR.write_price_buckets(spark.createDataFrame(rows, PRICES), path, buckets=8)
    before = {p: os.stat(os.path.join(folder, p)).st_mtime_ns for folder, _, names in os.walk(path) for p in names}
    batch = spark.createDataFrame([("T3", D(2020, 1, 9), 9.0), ("NEW", D(2020, 1, 9), 1.0)], PRICES)
    touched = PR.replace_tickers(batch, path, buckets=8)
    again = PR.replace_tickers(batch, path, buckets=8)  # the same call once more changes nothing
    got = {(r.ticker, r.date.day, r.price) for r in PR.read_price_buckets(spark, path).collect()}
    assert got == {(t, d.day, p) for t, d, p in rows if t != "T3"} | {("T3", 9, 9.0), ("NEW", 9, 1.0)}
    assert touched == again and 1 <= len(touched) <= 2
    for folder, _, names in os.walk(path):
        for name in names:
            if name.endswith(".parquet"):
                assert (name in before) == (int(folder.rsplit("=", 1)[1]) not in touched)
    named = PR.read_price_buckets(spark, path, ["T3"], buckets=8)
    assert [(r.ticker, r.price) for r in named.collect()] == [("T3", 9.0)]
    assert "PartitionFilters: [isnotnull(bucket" in named._jdf.queryExecution().executedPlan().toString() or "bucket#" in named._jdf.queryExecution().executedPlan().toString()
    assert PR.replace_tickers(batch.limit(0), path, buckets=8) == []


def test_price_directories_split_a_large_ticker(spark, tmp_path):
    hot = spark.range(20_000).selectExpr("'HOT' AS ticker", "date_add(DATE'1960-01-01', CAST(id AS INT)) AS date", "double(id) AS price")
    PR.write_price_directories(hot.unionByName(hot.limit(1).withColumn("ticker", F.lit("ONE"))), str(tmp_path / "d"))
    back = PR.read_price_directories(spark, str(tmp_path / "d"))
    assert back.where("ticker = 'HOT'").count() == 20_000 and back.where("ticker = 'ONE'").count() == 1


def test_months_of_one_price_a_day_need_no_sort_and_are_checked(spark):
    period = D(2020, 1, 1), D(2020, 12, 31)
    rows = [("A", D(2020, 1, d), float(p)) for d, p in ((2, 5), (9, 7), (31, 8))]
    rows += [("A", D(2020, 2, 3), None), ("A", D(2020, 2, 4), 2.0), ("B", D(2020, 1, 1), None)]
    prices = spark.createDataFrame(rows, PRICES)
    fast, general = PR.stored_months(prices, *period, one_a_day=True), PR.stored_months(prices, *period)
    plan = fast._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert fast.columns == general.columns
    assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, general.collect()))
    again = prices.unionByName(spark.createDataFrame([("A", D(2020, 1, 9), 6.0)], PRICES))
    with pytest.raises(Exception, match="several prices a day: A in 2020-01-01"):
        PR.stored_months(again, *period, one_a_day=True).collect()
