import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorlab.functions.distributions import t_two_sided
from factorlab.operators.inference import grs_test, residuals_wide
from factorlab.operators.regression import (
    align_by_date, align_by_position, alpha_analysis, best_models, custom_regression, describe,
    design_rows, factor_loadings, fit, regressions, residuals,
)
from factorlab.plans.analysis import analyze_anomaly
from factorlab.schemas import FACTOR_TABLE, FACTORS, MODELS
from tests.panels import shift

FIRST, T = dt.date(2018, 1, 1), 60
BETAS = {"A": (0.8, 0.2, 0.3, 0.1, -0.4), "B": (1.2, -0.2, -0.3, 0.0, 0.5), "C": (1.0, 0.4, 0.1, -0.2, 0.2)}
ALPHA = {"A": 0.4, "B": -0.1, "C": 0.02}
LONG = "portfolio string, date date, ret double"


@pytest.fixture(scope="module")
def raw():
    rng = np.random.default_rng(42)
    f = rng.normal(0.5, 3.0, (T, 5))
    rf = np.abs(rng.normal(0.15, 0.05, T))
    noise = {p: rng.normal(0, 2.0, T) for p in BETAS}
    return f, rf, noise


@pytest.fixture(scope="module")
def factors(spark, raw):
    f, rf, _ = raw
    rows = [(shift(FIRST, i), *map(float, f[i]), float(rf[i])) for i in range(T)]
    return spark.createDataFrame(rows, FACTOR_TABLE).cache()


def returns(raw, noise_scale):
    f, rf, noise = raw
    return {p: ALPHA[p] + f @ np.array(b) + rf + noise_scale * noise[p] for p, b in BETAS.items()}


def frame(spark, series):
    rows = [(p, shift(FIRST, i), None if v != v else float(v)) for p, values in series.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, LONG)


def lstsq(y, xs):
    x = np.column_stack([np.ones(len(y)), xs])
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ beta
    n, k = x.shape
    bread = np.linalg.inv(x.T @ x)
    se = np.sqrt(np.diag(bread) * (e @ e) / (n - k))
    r2 = 1 - e @ e / ((y - y.mean()) @ (y - y.mean()))
    return beta, se, e, r2, x, bread


def newey_west(x, e, bread, lags):
    s = x * e[:, None]
    meat = s.T @ s
    for j in range(1, lags + 1):
        g = s[j:].T @ s[:-j]
        meat += (1 - j / (lags + 1)) * (g + g.T)
    return np.sqrt(np.diag(bread @ meat @ bread))


def test_noise_free_loadings_come_back(spark, raw, factors):
    design = design_rows(align_by_date(frame(spark, returns(raw, 0.0)), factors), ["portfolio"], ["FF5"])
    loads = {(r["portfolio"], r["factor"]): r["beta"]
             for r in factor_loadings(regressions(design, ["portfolio"]), ["portfolio"]).collect()}
    for p, betas in BETAS.items():
        for name, beta in zip(FACTORS, betas):
            assert loads[p, name] == pytest.approx(beta, abs=1e-9)
    for r in regressions(design, ["portfolio"]).collect():
        assert r["alpha"] == pytest.approx(ALPHA[r["portfolio"]] * 12, abs=1e-8) and r["r2"] == pytest.approx(1.0)


@pytest.mark.parametrize("robust, scale", [(False, "textbook"), (True, "textbook"), (True, "reference")])
def test_all_models_match_numpy(spark, raw, factors, robust, scale):
    f, rf, _ = raw
    series = returns(raw, 1.0)
    design = design_rows(align_by_date(frame(spark, series), factors), ["portfolio"])
    got = {(r["portfolio"], r["model"]): r for r in regressions(design, ["portfolio"], robust, 3, scale).collect()}
    assert len(got) == 9
    for (p, model), r in got.items():
        k = len(MODELS[model])
        y = (series[p] - rf) / 100
        beta, se, e, r2, x, bread = lstsq(y, f[:, :k] / 100)
        if robust:
            se = newey_west(x, e, bread, 3) / (np.sqrt(T) if scale == "reference" else 1)
        assert r["alpha"] == pytest.approx(beta[0] * 1200)
        assert r["alpha_tstat"] == pytest.approx(beta[0] / se[0], rel=1e-7)
        assert r["alpha_pvalue"] == pytest.approx(float(t_two_sided(beta[0] / se[0], T - k - 1)), abs=1e-9)
        assert [c["factor"] for c in r["loadings"]] == MODELS[model]
        assert [c["tstat"] for c in r["loadings"]] == pytest.approx(list(beta[1:] / se[1:]), rel=1e-7)
        assert r["r2"] == pytest.approx(r2)
        assert r["adj_r2"] == pytest.approx(1 - (1 - r2) * (T - 1) / (T - k - 1))
        assert (r["n_obs"], r["period_start"], r["period_end"]) == (T, FIRST, shift(FIRST, T - 1))


def test_missing_values_drop_per_model(spark, raw, factors):
    series = returns(raw, 1.0)
    series["A"][5] = float("nan")
    holed = factors.withColumn("RMW", F.when(F.col("date") != F.lit(shift(FIRST, 9)), F.col("RMW")))
    design = design_rows(align_by_date(frame(spark, series), holed), ["portfolio"])
    n = {(r["portfolio"], r["model"]): r["n_obs"] for r in regressions(design, ["portfolio"]).collect()}
    assert (n["A", "CAPM"], n["A", "FF3"], n["A", "FF5"], n["B", "CAPM"], n["B", "FF5"]) == (59, 59, 58, 60, 59)


def test_models_without_their_factors_are_left_out(spark, raw, factors):
    few = factors.drop("RMW")
    design = design_rows(align_by_date(frame(spark, returns(raw, 1.0)), few), ["portfolio"])
    assert {r["model"] for r in regressions(design, ["portfolio"]).collect()} == {"CAPM", "FF3"}
    with pytest.raises(ValueError):
        design_rows(align_by_date(frame(spark, returns(raw, 1.0)), few), ["portfolio"], ["FF5"])


def test_eleven_months_give_nothing_and_collinear_factors_are_flagged(spark, raw, factors):
    long = frame(spark, returns(raw, 1.0))
    short = long.filter(F.col("date") < F.lit(shift(FIRST, 11)))
    assert regressions(design_rows(align_by_date(short, factors), ["portfolio"]), ["portfolio"]).count() == 0
    twin = factors.withColumn("SMB", F.col("MKT_RF") * 2)
    design = design_rows(align_by_date(long, twin), ["portfolio"], ["FF3"])
    fitted = fit(design, ["portfolio", "model"], robust=True)
    assert {r["status"] for r in fitted.collect()} == {"singular"}
    assert describe(fitted, ["portfolio"]).count() == 0


def test_position_pairs_rows_and_cuts_to_the_shorter(spark, raw, factors):
    series = returns(raw, 1.0)
    late = frame(spark, series).withColumn("date", F.add_months("date", 600)).filter(
        F.col("date") < F.lit(shift(FIRST, 650)))
    design = design_rows(align_by_position(late, factors, ["portfolio"]), ["portfolio"], ["CAPM"])
    f, rf, _ = raw
    for r in regressions(design, ["portfolio"]).collect():
        beta, *_ = lstsq((series[r["portfolio"]][:50] - rf[:50]) / 100, f[:50, :1] / 100)
        assert r["n_obs"] == 50 and r["alpha"] == pytest.approx(beta[0] * 1200)


def test_custom_regression(spark, raw, factors):
    f, rf, _ = raw
    series = returns(raw, 1.0)
    rows = align_by_date(frame(spark, series), factors).withColumn("excess", F.col("ret") - F.col("RF"))
    for robust in (False, True):
        for r in custom_regression(rows, ["portfolio"], ["Mkt_RF", "CMA"], robust=robust, lags=2).collect():
            beta, se, e, r2, x, bread = lstsq((series[r["portfolio"]] - rf) / 100, f[:, [0, 4]] / 100)
            if robust:
                se = newey_west(x, e, bread, 2)
            assert r["alpha"] == pytest.approx(beta[0]) and r["alpha_se"] == pytest.approx(se[0])
            assert list(r["coefficients"]) == pytest.approx(list(beta[1:])) and r["r2"] == pytest.approx(r2)
    with pytest.raises(ValueError):
        custom_regression(rows, ["portfolio"], ["MOM"])


def test_alpha_analysis_and_verdict(spark, raw, factors):
    long = frame(spark, returns(raw, 1.0))
    got = {r["portfolio"]: r for r in alpha_analysis(long, factors, thesis="the thesis").collect()}
    best = {r["portfolio"]: r for r in best_models(
        regressions(design_rows(align_by_date(long, factors), ["portfolio"]), ["portfolio"]), ["portfolio"]).collect()}
    for p, r in got.items():
        assert r["best_model"] == best[p]["best_model"] == "FF5"      # nested models cannot lose R2
        expected = "VERY STRONGLY SUPPORTS the thesis: No alpha after FF5" if best[p]["best_pvalue"] > 0.05 \
            else "STRONGLY CONTRADICTS the thesis: Alpha after FF5"
        assert r["verdict"] == expected and r["supports"] == ("SUPPORTS" in expected)
    only = alpha_analysis(long, factors.select("date", "MKT_RF", "RF")).first()
    assert only["best_model"] == "CAPM" and only["ff3"] is None and only["capm"]["n_obs"] == T
    positional = alpha_analysis(long, factors, align="position", thesis="X").first()
    assert "after FF5 adjustment" in positional["verdict"]
    with pytest.raises(ValueError):
        analyze_anomaly(long, factors, FIRST, shift(FIRST, 5))


@pytest.fixture(scope="module")
def fits(spark, raw, factors):
    design = design_rows(align_by_date(frame(spark, returns(raw, 1.0)), factors), ["portfolio"])
    fitted = fit(design, ["portfolio", "model"]).cache()
    return describe(fitted, ["portfolio"]).cache(), residuals(design, fitted, ["portfolio", "model"]).cache()


@pytest.mark.parametrize("model", ["CAPM", "FF3", "FF5"])
@pytest.mark.parametrize("variant", ["full", "simple"])
def test_grs_matches_numpy(raw, factors, fits, model, variant):
    f, rf, _ = raw
    k, names = len(MODELS[model]), sorted(BETAS)
    series = returns(raw, 1.0)
    solved = [lstsq((series[p] - rf) / 100, f[:, :k] / 100) for p in names]
    alpha = np.array([s[0][0] for s in solved])
    cov_e = np.cov(np.column_stack([s[2] for s in solved]), rowvar=False)
    mu, cov_f = (f[:, :k] / 100).mean(axis=0), np.atleast_2d(np.cov(f[:, :k] / 100, rowvar=False))
    term2 = 1 / (1 + mu @ np.linalg.inv(cov_f) @ mu) if variant == "full" else 1.0
    expected = (T - 3 - k) / 3 * term2 * (alpha @ np.linalg.inv(cov_e) @ alpha)
    r = grs_test(*fits, factors, names, model, variant=variant).first()
    assert r["status"] == "ok" and r["f_statistic"] == pytest.approx(expected)
    assert r["df2"] == T - 3 - k and r["n_obs"] == T
    assert r["is_significant"] == (r["p_value"] < 0.05) == (r["f_statistic"] > r["critical_value"])


def test_grs_says_why_it_has_no_statistic(spark, raw, factors, fits):
    results, resid = fits
    status = lambda *a, **k: grs_test(*a, **k).first()["status"]
    assert status(results, resid, factors, ["A"], "CAPM", variant="simple") == "too_few_portfolios"
    assert status(results, resid, factors, ["A", "Z"], "CAPM") in ("missing_portfolio",)
    shorter = resid.filter(~((F.col("portfolio") == "A") & (F.col("date") == F.lit(FIRST))))
    assert status(results, shorter, factors, ["A", "B"], "CAPM") == "unequal_n"
    assert status(results, shorter, factors, ["A", "B"], "CAPM", variant="simple") == "ok"
    few = resid.filter(F.col("date") < F.lit(shift(FIRST, 7)))
    assert status(results, few, factors, ["A", "B"], "FF5", variant="simple") == "no_degrees_of_freedom"
    doubled = results.unionByName(results.filter("portfolio = 'A'").withColumn("portfolio", F.lit("A2")))
    doubled_e = resid.unionByName(resid.filter("portfolio = 'A'").withColumn("portfolio", F.lit("A2")))
    assert status(doubled, doubled_e, factors, ["A", "A2"], "CAPM") == "singular"
    assert residuals_wide(resid, ["model"], ["A", "B"]).count() == 3 * T
