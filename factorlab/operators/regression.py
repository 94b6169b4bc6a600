"""Factor regressions of any number of groups at once (REG, AGG14, JOIN1, JOIN9, FLT3-4, SC9-10).

Per group, Spark's mergeable ``avg`` and ``covar_samp`` aggregates reduce the
rows to one row of centred moments, whatever the group's length. A batched
numpy solve turns moment rows into coefficients; residuals and Newey-West sums
are again plain Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.distributions import t_two_sided
from ..functions.stats import monthly_sharpe, significance, verdict
from ..schemas import FACTORS, MODELS, missing_columns, require_columns
from ..staging import stage
from .sizing import broadcast_if_small

MIN_MONTHS = 12  # fixed value: fewer complete months give no regression
SINGULAR = 1e14  # condition number of the factor covariance


# ---- design rows ----------------------------------------------------------

def align_by_date(portfolios: DataFrame, factors: DataFrame) -> DataFrame:
    """Portfolio rows with the factors of their month (JOIN1)."""
    return portfolios.join(broadcast_if_small(factors), "date", "inner")


def align_by_position(portfolios: DataFrame, factors: DataFrame, keys: list[str]) -> DataFrame:
    """The n-th return of a group with the n-th factor month, cut to the shorter (JOIN9)."""
    returns = portfolios.filter(F.col("ret").isNotNull()).withColumn(
        "_pos", F.row_number().over(Window.partitionBy(*keys).orderBy("date"))
    )
    months = factors.withColumn("_pos", F.row_number().over(Window.orderBy("date"))).drop("date")
    return returns.join(broadcast_if_small(months), "_pos").drop("_pos")


def design_rows(aligned: DataFrame, keys: list[str], models: list[str] | None = None) -> DataFrame:
    """``(keys, model, date, y, x1..xk)`` in decimals, complete cases per model (PRJ1, FLT3).

    A model whose factors the table lacks is left out (FLT6). Factors a model
    does not use are 0, so all models share one schema and one aggregate.
    """
    require_columns(aligned, ["date", "ret", "RF"], "aligned returns")
    usable = [m for m in (models or list(MODELS)) if not missing_columns(aligned, MODELS[m])]
    if not usable:
        raise ValueError("no requested model has its factors")
    width = max(len(MODELS[m]) for m in usable)

    def one(model: str) -> Column:
        names = MODELS[model]
        xs = [F.col(n) / 100 for n in names] + [F.lit(0.0)] * (width - len(names))
        complete = F.col("ret").isNotNull() & F.col("RF").isNotNull()
        for name in names:
            complete &= F.col(name).isNotNull()
        return F.when(complete, F.struct(
            F.lit(model).alias("model"),
            F.lit(len(names)).alias("k"),
            ((F.col("ret") - F.col("RF")) / 100).alias("y"),
            *[x.alias(f"x{i}") for i, x in enumerate(xs, start=1)],
        ))

    rows = aligned.select(
        *keys, "date", F.explode(F.array_compact(F.array(*map(one, usable)))).alias("d")
    )
    return rows.select(*keys, "date", "d.*")


# ---- moments and solve ----------------------------------------------------

def _regressors(df: DataFrame) -> list[str]:
    return sorted((c for c in df.columns if c[0] == "x" and c[1:].isdigit()), key=lambda c: int(c[1:]))


def moments(design: DataFrame, by: list[str], min_obs: int = MIN_MONTHS) -> DataFrame:
    """One row of means and sample covariances per group (AGG14), gated on length (FLT4)."""
    xs = _regressors(design)
    sums = [
        "count(*) AS n", "min(date) AS period_start", "max(date) AS period_end",
        "avg(y) AS my", "var_samp(y) AS vy",
        *[f"avg({x}) AS m{x}" for x in xs],
        *[f"covar_samp({x}, y) AS c{x}y" for x in xs],
        *[f"covar_samp({a}, {b}) AS c{a}{b}" for a, b in combinations_with_replacement(xs, 2)],
    ]
    return design.groupBy(*by).agg(*map(F.expr, sums)).filter(F.col("n") >= min_obs)


COEFFICIENTS = [
    T.StructField("n_obs", T.LongType()),
    T.StructField("period_start", T.DateType()),
    T.StructField("period_end", T.DateType()),
    T.StructField("beta", T.ArrayType(T.DoubleType())),      # intercept first, monthly decimals
    T.StructField("se", T.ArrayType(T.DoubleType())),
    T.StructField("tstat", T.ArrayType(T.DoubleType())),
    T.StructField("pvalue", T.ArrayType(T.DoubleType())),
    T.StructField("bread", T.ArrayType(T.DoubleType())),     # inverse of X'X, row by row
    T.StructField("r2", T.DoubleType()),
    T.StructField("adj_r2", T.DoubleType()),
    T.StructField("status", T.StringType()),
]


def _solve_batch(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    """OLS from moment rows, all with ``k`` regressors, as stacked k-by-k systems."""
    xs = [f"x{i}" for i in range(1, k + 1)]
    count = len(pdf)
    n = pdf["n"].to_numpy(float)
    mean_x = pdf[[f"m{x}" for x in xs]].to_numpy(float)
    cov_xy = pdf[[f"c{x}y" for x in xs]].to_numpy(float)
    cov = np.empty((count, k, k))
    for i, a in enumerate(xs):
        for j in range(i, k):
            cov[:, i, j] = cov[:, j, i] = pdf[f"c{a}{xs[j]}"].to_numpy(float)
    # Judge collinearity on correlations, so that units of factors do not matter.
    scale = np.sqrt(np.einsum("gii->gi", cov))
    safe = np.where(scale > 0, scale, 1.0)
    corr = cov / (safe[:, :, None] * safe[:, None, :])
    sound = (scale > 0).all(axis=1) & (n > k + 1)
    sound[sound] = np.linalg.cond(corr[sound]) < SINGULAR
    corr[~sound] = np.eye(k)
    inverse = np.linalg.inv(corr) / (safe[:, :, None] * safe[:, None, :])

    slopes = np.einsum("gij,gj->gi", inverse, cov_xy)
    alpha = pdf["my"].to_numpy(float) - (slopes * mean_x).sum(axis=1)
    beta = np.column_stack([alpha, slopes])
    tss = pdf["vy"].to_numpy(float) * (n - 1)
    rss = np.maximum(tss - (n - 1) * (slopes * cov_xy).sum(axis=1), 0.0)
    df = n - k - 1
    bread = np.empty((count, k + 1, k + 1))
    core = inverse / (n - 1)[:, None, None]
    pull = np.einsum("gij,gj->gi", core, mean_x)
    bread[:, 1:, 1:] = core
    bread[:, 0, 1:] = bread[:, 1:, 0] = -pull
    bread[:, 0, 0] = 1.0 / n + (pull * mean_x).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        se = np.sqrt(np.einsum("gii->gi", bread) * (rss / df)[:, None])
        tstat = beta / se
        r2 = 1.0 - rss / tss
        adj_r2 = 1.0 - (rss / df) / (tss / (n - 1))
    pvalue = t_two_sided(tstat, df[:, None])
    for values in (beta, se, tstat, pvalue, bread, r2, adj_r2):
        values[~sound] = np.nan
    return pdf.assign(
        n_obs=pdf["n"], beta=list(beta), se=list(se), tstat=list(tstat), pvalue=list(pvalue),
        bread=list(bread.reshape(count, -1)), r2=r2, adj_r2=adj_r2,
        status=np.where(sound, "ok", "singular"),
    )


def solve(moment_rows: DataFrame, by: list[str]) -> DataFrame:
    """Coefficients, standard errors, tests and fit per moment row (REG4, DIST1).

    ``by`` includes ``k``, the number of regressors.
    """
    fields = {f.name: f for f in moment_rows.schema.fields}
    schema = T.StructType([fields[c] for c in by] + COEFFICIENTS)
    names = schema.names

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for k, rows in part.groupby("k", sort=False):
                yield _solve_batch(rows, int(k))[names]

    return moment_rows.mapInPandas(batches, schema)


def fit(design: DataFrame, keys: list[str], robust: bool = False, lags: int = 3,
        nw_scale: str = "textbook", min_obs: int = MIN_MONTHS) -> DataFrame:
    """OLS per ``keys``; with ``robust`` the errors are Newey-West (REG4, REG5)."""
    by = [*keys, "k"]
    fitted = solve(moments(design, by, min_obs), by)
    return newey_west(design, fitted, keys, lags, nw_scale) if robust else fitted


def residuals(design: DataFrame, fitted: DataFrame, keys: list[str]) -> DataFrame:
    """Residual of each design row in percent (D11)."""
    joined = _with_residual(design, fitted, keys)
    return joined.select(*keys, "date", (F.col("_e") * 100).alias("resid"))


def _with_residual(design: DataFrame, fitted: DataFrame, keys: list[str]) -> DataFrame:
    xs = _regressors(design)
    prediction = F.get("beta", F.lit(0))
    for i, x in enumerate(xs, start=1):
        prediction += F.col(x) * F.coalesce(F.get("beta", F.lit(i)), F.lit(0.0))
    sound = fitted.filter(F.col("status") == "ok").select(*keys, "beta")
    return design.join(sound, keys).withColumn("_e", F.col("y") - prediction)


# ---- Newey-West (REG5) ----------------------------------------------------

def newey_west(design: DataFrame, fitted: DataFrame, keys: list[str], lags: int = 3,
               nw_scale: str = "textbook") -> DataFrame:
    """Replace errors and tests by Bartlett-weighted robust ones; lags count rows in date order.

    With scores s and their weighted lags u, the long-run sum is
    ``sum(s s' + s u' + u s')``: one lag window and one aggregate for all lags.
    ``nw_scale="reference"`` divides the sandwich by n once more.
    """
    if nw_scale not in ("textbook", "reference"):
        raise ValueError(f"unknown nw_scale {nw_scale}")
    xs = _regressors(design)
    fitted = stage(fitted, "fitted")  # a row for each fit; residuals and the last join read it
    ordered = Window.partitionBy(*keys).orderBy("date")
    rows = _with_residual(design, fitted, keys).withColumn("s0", F.col("_e"))
    for i, x in enumerate(xs, start=1):
        rows = rows.withColumn(f"s{i}", F.col(x) * F.col("_e"))
    scores = [f"s{i}" for i in range(len(xs) + 1)]
    weights = {j: 1 - j / (lags + 1) for j in range(1, lags + 1)}
    lagged = [
        sum((F.lag(s, j, 0.0).over(ordered) * w for j, w in weights.items()), F.lit(0.0))
        .alias(s.replace("s", "u"))
        for s in scores
    ]
    rows = rows.select(*keys, *scores, *lagged)
    sums = [
        F.expr(f"sum(s{i} * s{j} + s{i} * u{j} + u{i} * s{j}) AS w{i}_{j}")
        for i, j in combinations_with_replacement(range(len(scores)), 2)
    ]
    meat = rows.groupBy(*keys).agg(*sums)

    joined = fitted.join(meat, keys, "left")
    names = fitted.columns

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for k, rows_k in part.groupby("k", sort=False):
                yield _sandwich_batch(rows_k, int(k), nw_scale)[names]

    return joined.mapInPandas(batches, fitted.schema)


def _sandwich_batch(pdf: pd.DataFrame, k: int, nw_scale: str) -> pd.DataFrame:
    size, count = k + 1, len(pdf)
    bread = np.stack(pdf["bread"].to_numpy()).astype(float).reshape(count, size, size)
    meat = np.empty((count, size, size))
    for i, j in combinations_with_replacement(range(size), 2):
        meat[:, i, j] = meat[:, j, i] = pdf[f"w{i}_{j}"].to_numpy(float)
    n = pdf["n_obs"].to_numpy(float)
    cov = bread @ meat @ bread
    if nw_scale == "reference":
        cov = cov / n[:, None, None]
    beta = np.stack(pdf["beta"].to_numpy()).astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        se = np.sqrt(np.einsum("gii->gi", cov))
        tstat = beta / se
    pvalue = t_two_sided(tstat, (n - size)[:, None])
    return pdf.assign(se=list(se), tstat=list(tstat), pvalue=list(pvalue))


# ---- public results -------------------------------------------------------

def regressions(design: DataFrame, keys: list[str], robust: bool = False, lags: int = 3,
                nw_scale: str = "textbook") -> DataFrame:
    """Result table of the named models (D11): alpha in percent a year, loadings by factor.

    ``keys`` are the grouping keys without ``model``. Serves CAPM, FF3 and FF5
    for every portfolio at once (REG1-3, REG7-9, REG13-14).
    """
    fitted = fit(design, [*keys, "model"], robust, lags, nw_scale)
    return describe(fitted, keys)


def describe(fitted: DataFrame, keys: list[str]) -> DataFrame:
    at = lambda column, i: F.get(column, F.lit(i))
    names = F.array(*map(F.lit, FACTORS))
    loadings = F.transform(
        F.sequence(F.lit(1), F.col("k")),
        lambda i: F.struct(
            F.get(names, i - 1).alias("factor"),
            F.get("beta", i).alias("beta"),
            F.get("tstat", i).alias("tstat"),
            F.get("pvalue", i).alias("pvalue"),
        ),
    )
    return fitted.filter(F.col("status") == "ok").select(
        *keys, "model",
        (at("beta", 0) * 1200).alias("alpha"),
        at("tstat", 0).alias("alpha_tstat"),
        at("pvalue", 0).alias("alpha_pvalue"),
        loadings.alias("loadings"),
        "r2", "adj_r2", "n_obs", "period_start", "period_end",
        significance(at("pvalue", 0)).alias("significance"),
    )


def factor_loadings(results: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group, model and factor (SER3)."""
    return results.select(*keys, "model", F.inline("loadings"))


def factor_names(columns: list[str], wanted: list[str]) -> list[str]:
    """Spelling of the wanted factors in the table: exact, else upper case (PRJ2)."""
    found = []
    for name in wanted:
        match = next((c for c in (name, name.upper()) if c in columns), None)
        if match is None:
            raise ValueError(f"factor {name} not among {', '.join(columns)}")
        found.append(match)
    return found


def custom_regression(
    rows: DataFrame,
    keys: list[str],
    factor_cols: list[str],
    y: str = "excess",
    robust: bool = False,
    lags: int = 3,
    nw_scale: str = "textbook",
) -> DataFrame:
    """OLS of a percent excess return on any factor columns, not annualised (REG11, REG12)."""
    names = factor_names(rows.columns, factor_cols)
    design = rows.dropna(subset=[y, *names]).select(
        *keys, "date", F.lit(len(names)).alias("k"), (F.col(y) / 100).alias("y"),
        *[(F.col(name) / 100).alias(f"x{i}") for i, name in enumerate(names, start=1)],
    )
    fitted = fit(design, keys, robust, lags, nw_scale, min_obs=len(names) + 2)
    at = lambda column, i: F.get(column, F.lit(i))
    return fitted.filter(F.col("status") == "ok").select(
        *keys,
        at("beta", 0).alias("alpha"),
        at("se", 0).alias("alpha_se"),
        at("tstat", 0).alias("alpha_t"),
        at("pvalue", 0).alias("alpha_pval"),
        F.slice("beta", 2, len(names)).alias("coefficients"),
        "r2", "n_obs",
    )


def best_models(results: DataFrame, keys: list[str]) -> DataFrame:
    """Model with the highest R-squared per group, the smaller model on ties (BEST1)."""
    order = F.struct("r2", (-F.size("loadings")).alias("smaller"))
    best = F.max_by(F.struct("model", "alpha_pvalue", "alpha"), order)
    return results.groupBy(*keys).agg(best.alias("best")).select(
        *keys, F.col("best.model").alias("best_model"),
        F.col("best.alpha").alias("best_alpha"),
        F.col("best.alpha_pvalue").alias("best_pvalue"),
    )


def alpha_analysis(
    portfolios: DataFrame,
    factors: DataFrame,
    keys: list[str] | None = None,
    align: str = "date",
    models: list[str] | None = None,
    thesis: str = "the risk explanation",
    results: DataFrame | None = None,
) -> DataFrame:
    """One row per group: raw performance, the models side by side, best model and verdict.

    ``align="date"`` joins by month (REG10, ANA2); ``align="position"`` pairs
    the n-th return with the n-th factor month (REG6). ``thesis`` names the
    claim in the verdict text (SC9); ``supports`` says whether it holds (SC12).
    ``results`` are the regressions of these rows, if the caller has them already.
    """
    keys = keys or ["portfolio"]
    if align == "date":
        aligned = align_by_date(portfolios, factors)
    elif align == "position":
        aligned = align_by_position(portfolios, factors, keys)
    else:
        raise ValueError(f"unknown alignment {align}")
    complete = aligned.filter(F.col("ret").isNotNull() & F.col("RF").isNotNull())
    sharpe = complete.groupBy(*keys).agg(
        F.count("*").alias("n_obs"),
        (monthly_sharpe((F.col("ret") - F.col("RF")) / 100) * F.sqrt(F.lit(12.0))).alias("raw_sharpe"),
    ).filter(F.col("n_obs") >= MIN_MONTHS)
    # By position, return and volatility describe the whole series, paired or not.
    described = complete if align == "date" else portfolios.filter(F.col("ret").isNotNull())
    raw = described.groupBy(*keys).agg(
        F.min("date").alias("period_start"),
        F.max("date").alias("period_end"),
        (F.avg("ret") * 12).alias("raw_return"),
        (F.stddev_samp("ret") * F.sqrt(F.lit(12.0))).alias("raw_volatility"),
    ).join(sharpe, keys)
    if results is None:
        results = stage(regressions(design_rows(aligned, keys, models), keys), "results")
    detail = F.struct("alpha", "alpha_tstat", "alpha_pvalue", "loadings", "r2", "adj_r2", "n_obs")
    order = F.struct("r2", (-F.size("loadings")).alias("smaller"))
    by_model = results.groupBy(*keys).agg(
        *[F.max(F.when(F.col("model") == m, detail)).alias(m.lower()) for m in MODELS],
        F.max_by(F.struct("model", "alpha_pvalue"), order).alias("best"),
    )
    text = verdict(F.col("best.model"), F.col("best.alpha_pvalue"), thesis, align == "position")
    return (
        raw.join(by_model, keys)
        .withColumn("best_model", F.col("best.model"))
        .withColumn("verdict", text)
        .withColumn("supports", F.contains("verdict", F.lit("SUPPORTS")))
        .drop("best")
    )
