import datetime as dt

import pytest

from factorlab.functions import symbols as S

D = dt.date


def symbols(spark, names):
    return spark.createDataFrame([(n,) for n in names], "raw string")


@pytest.mark.parametrize("raw, clean", [
    ("BRK.B", "BRK-B"), (" bf.a ", "BF-A"), ("FB", "META"), ("GOOG", "GOOGL"), ("ABC.X", "ABC-X"), ("XYZ.A", "XYZ-A"),
    ("ACME INC.", "ACME"), ("ACME CORP", "ACME"), ("FOO CLASS A", "FOO"), ("FOO CLASS B INC", "FOO"),
    ("AT&T", "ATT"), ("BERKSHIRE HATHAWAY B", "BRK-B"), ("NINECHARS", "NINEC"), ("EIGHTCHR", "EIGHTCHR"), ("AAMRQ", "AAMRQ"),
])
def test_cleaning(spark, raw, clean):
    assert symbols(spark, [raw]).select(S.clean_symbol("raw")).first()[0] == clean


def test_resolution_precedence(spark):
    names = ["CELG", "twtr", "UTX", "DIS", "BRK.B", "ABC.X", " aapl "]
    got = {r["raw"]: tuple(r["resolution"]) for r in S.resolve_symbols(symbols(spark, names), "raw").collect()}
    assert got == {
        "CELG": ("BMY", "replaced", "extinct_with_replacement", "CELG"),
        "twtr": ("TWTR", "extinct", "extinct_no_replacement", "TWTR"),
        "UTX": ("RTX", "mapped", "symbol_change", "UTX"),
        "DIS": ("DIS", "mapped", "symbol_change", "DIS"),
        "BRK.B": ("BRK-B", "mapped", "symbol_change", "BRK.B"),
        "ABC.X": ("ABC-X", "format_corrected", "dot_to_hyphen", "ABC.X"),
        " aapl ": ("AAPL", "original", "no_changes_needed", "AAPL"),
    }
    loose = {r["raw"]: r["resolution"]["status"] for r in
             S.resolve_symbols(symbols(spark, names), "raw", check_extinct=False).collect()}
    assert loose["CELG"] == loose["twtr"] == "original"
    stats = S.resolution_stats(S.resolve_symbols(symbols(spark, names), "raw")).first()
    assert (stats["total"], stats["extinct"], stats["resolvable"], stats["success_rate"]) == (7, 1, 6, 85.7)


def test_flags_and_metadata(spark):
    df = symbols(spark, ["aapl", "TWTR", "XYZ"])
    assert {r["raw"]: r["is_extinct"] for r in S.with_extinct_flag(df, "raw").collect()} == {
        "aapl": False, "TWTR": True, "XYZ": False}
    assert {r["raw"]: r["metadata_status"] for r in S.with_metadata(df, "raw").collect()} == {
        "aapl": "active", "TWTR": "unknown", "XYZ": "unknown"}


def test_dimensions_can_grow(spark):
    added = spark.createDataFrame([(" fb ", "x1", "renamed", 1), ("FB", "x2", "renamed", 2), ("NEW", "old", "renamed", 1)],
                                  "symbol string, target string, kind string, seq int")
    mappings = S.add_mappings(S.mapping_dimension(spark), added)
    got = {r["symbol"]: r["target"] for r in mappings.collect()}
    assert got["FB"] == "X2" and got["NEW"] == "OLD" and got["UTX"] == "RTX"
    gone = S.mark_extinct(S.extinct_dimension(spark), spark.createDataFrame([("zzz",), ("CELG",)], "symbol string"))
    assert {r["symbol"]: r["replacement"] for r in gone.collect()}.items() >= {"ZZZ": None, "CELG": "BMY"}.items()
    listing = S.list_mappings(mappings, gone).collect()
    assert [r["symbol"] for r in listing] == sorted(r["symbol"] for r in listing if r["entry"] == "extinct") + sorted(
        r["symbol"] for r in listing if r["entry"] == "mapping")
    resolved = S.resolve_symbols(symbols(spark, ["FB", "ZZZ"]), "raw", mappings, gone)
    assert {r["raw"]: r["resolution"]["symbol"] for r in resolved.collect()} == {"FB": "X2", "ZZZ": "ZZZ"}
    # Dimensions are local relations: small enough for Spark to broadcast unasked.
    plan = S.resolve_symbols(symbols(spark, ["FB"]), "raw")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan


def test_dated_mappings(spark):
    mappings = spark.createDataFrame(
        [("OLD", "MID", "renamed", D(2010, 1, 1)), ("old", "new", "renamed", D(2015, 6, 1)), ("OLD", "NEWER", "proxy", D(2015, 6, 1)),
         ("ALW", "ALWAYS", "merged", None)],
        "symbol string, target string, kind string, valid_from date")
    rows = spark.createDataFrame(
        [("OLD", D(2009, 12, 31)), ("OLD", D(2010, 1, 1)), ("old ", D(2015, 5, 31)), ("OLD", D(2020, 1, 1)), ("ALW", D(1900, 1, 1)), ("X", D(2020, 1, 1)), ("OLD", None)],
        "raw string, day date")
    got = sorted(((r.raw, str(r.day), r.resolved, r.mapping_kind) for r in S.resolve_symbols_asof(rows, "raw", "day", mappings).collect()))
    assert got == sorted([
        ("OLD", "2009-12-31", "OLD", None), ("OLD", "2010-01-01", "MID", "renamed"), ("old ", "2015-05-31", "MID", "renamed"),
        ("OLD", "2020-01-01", "NEWER", "proxy"), ("ALW", "1900-01-01", "ALWAYS", "merged"), ("X", "2020-01-01", "X", None), ("OLD", "None", "OLD", None)])


def test_proxies_can_be_left_out(spark):
    rows = spark.createDataFrame([("PEAK",), ("FB",)], "raw string")
    got = {r.raw: (r.resolution.symbol, r.resolution.status) for r in S.resolve_symbols(rows, "raw", leave_out=("proxy",)).collect()}
    assert got == {"PEAK": ("PEAK", "original"), "FB": ("META", "mapped")}
