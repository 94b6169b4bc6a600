"""Joint test that all alphas are zero (GRS1-3, AGG15-16, RSH2, DIST2).

All lookbacks, models and whatever else keys the results are tested in one plan. Cross
products are long: a row for each two series of a month, which ``covar_samp`` combines
before it shuffles, so that more portfolios mean more rows, not more columns. What
remains, a row of covariances per test, is solved as stacked systems.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.distributions import f_critical, f_upper_tail
from ..schemas import MODELS, require_columns
from .regression import SINGULAR
from .sizing import broadcast_if_small

RESULT = [
    T.StructField("status", T.StringType()),
    T.StructField("n_portfolios", T.IntegerType()),
    T.StructField("n_factors", T.IntegerType()),
    T.StructField("n_obs", T.LongType()),
    T.StructField("df2", T.LongType()),
    T.StructField("f_statistic", T.DoubleType()),
    T.StructField("critical_value", T.DoubleType()),
    T.StructField("p_value", T.DoubleType()),
    T.StructField("is_significant", T.BooleanType()),
    T.StructField("term1", T.DoubleType()),
    T.StructField("term2", T.DoubleType()),
    T.StructField("term3", T.DoubleType()),
    T.StructField("alphas", T.ArrayType(T.DoubleType())),        # monthly decimals
    T.StructField("alpha_pvalues", T.ArrayType(T.DoubleType())),
    T.StructField("factor_means", T.ArrayType(T.DoubleType())),
]


def residuals_wide(residuals: DataFrame, keys: list[str], portfolios: list[str]) -> DataFrame:
    """Residual series of the named portfolios side by side per date (RSH2).

    The date joins them; a date that one of them lacks is left out.
    """
    wide = residuals.groupBy(*keys, "date").pivot("portfolio", portfolios).agg(F.first("resid"))
    return wide.dropna(subset=portfolios)


def joint_tests(
    results: DataFrame,
    residuals: DataFrame,
    factors: DataFrame,
    portfolios: list[str],
    models: list[str],
    keys: list[str] | None = None,
    alpha_level: float = 0.05,
    variant: str = "full",
) -> DataFrame:
    """Gibbons-Ross-Shanken test over the named portfolios, one row per ``keys`` and model.

    ``variant="full"`` (GRS2) includes the factor-mean term and wants the same
    months for all portfolios; ``"simple"`` (GRS1, GRS3) omits the term and uses
    the months they share. ``status`` is ``ok`` or tells why there is no
    statistic: ``too_few_portfolios``, ``missing_portfolio``, ``unequal_n``,
    ``no_degrees_of_freedom`` or ``singular``. A portfolio has one residual a month.
    """
    if variant not in ("full", "simple"):
        raise ValueError(f"unknown variant {variant}")
    for model in models:
        require_columns(factors, MODELS[model], "factor table")
    spark, width = results.sparkSession, len(portfolios)
    by = [*(keys or []), "model"]
    place = F.array_position(F.array(*map(F.lit, portfolios)), F.col("portfolio")).cast("int") - 1
    wanted = F.col("model").isin(models) & F.col("portfolio").isin(portfolios)

    found = F.collect_list(F.struct(place.alias("i"), (F.col("alpha") / 1200).alias("alpha"), "alpha_pvalue"))
    alphas = results.filter(wanted).groupBy(*by).agg(
        F.min("n_obs").alias("n_min"), F.max("n_obs").alias("n_max"), found.alias("found")
    )
    if not keys:  # a model without any result is still a row
        alphas = spark.createDataFrame([(m,) for m in models], "model string").join(alphas, "model", "left")
    slots = F.sequence(F.lit(0), F.lit(width - 1))

    def slot(name: str) -> Column:
        return F.transform(slots, lambda k: F.get(F.filter("found", lambda x: x["i"] == k), F.lit(0))[name])

    alphas = alphas.select(*by, "n_min", "n_max", slot("alpha").alias("alphas"), slot("alpha_pvalue").alias("alpha_pvalues"))

    # The months that all portfolios share, each with its residuals and factors as one array.
    shared = residuals.filter(wanted).groupBy(*by, "date").agg(
        F.sort_array(F.collect_list(F.struct(place.alias("i"), (F.col("resid") / 100).alias("e")))).alias("e")
    ).filter(F.size("e") == width)
    moves = F.coalesce(*[
        F.when(F.col("model") == m, F.array(*[F.col(n) / 100 for n in MODELS[m]])) for m in models
    ])
    names = list(dict.fromkeys(n for m in models for n in MODELS[m]))
    rows = shared.join(broadcast_if_small(factors.select("date", *names)), "date").select(
        *by, F.concat(F.transform("e", lambda x: x["e"]), moves).alias("z")
    )
    pairs = rows.select(*by, "z", F.posexplode("z").alias("i", "a")).select(
        *by, "i", "a", F.posexplode(F.slice("z", F.col("i") + 1, F.size("z") - F.col("i"))).alias("step", "b")
    ).withColumn("j", F.col("i") + F.col("step"))
    cells = pairs.filter((F.col("i") < width) == (F.col("j") < width)).groupBy(*by, "i", "j").agg(
        F.count("*").alias("n"), F.covar_samp("a", "b").alias("c"), F.avg("a").alias("m")
    )
    of_factor = (F.col("i") == F.col("j")) & (F.col("i") >= width)
    gathered = cells.groupBy(*by).agg(
        F.max("n").alias("n"),
        F.sort_array(F.collect_list(F.struct("i", "j", "c"))).alias("cells"),
        F.sort_array(F.collect_list(F.when(of_factor, F.struct("i", "m")))).alias("means"),
    ).select(*by, "n", F.transform("cells", lambda x: x["c"]).alias("cells"), F.transform("means", lambda x: x["m"]).alias("factor_means"))

    joined = alphas.join(gathered, by, "left")
    schema = T.StructType([joined.schema[c] for c in by] + RESULT)

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for model, tests in part.groupby("model", sort=False):
                yield _tests(tests, width, len(MODELS[model]), variant, alpha_level)[schema.names]

    return joined.mapInPandas(batches, schema).withColumn("alpha_level", F.lit(alpha_level)).withColumn(
        "conclusion",
        F.when(F.col("is_significant"), "REJECT H0: at least one alpha differs from zero")
        .when(F.col("status") == "ok", "FAIL TO REJECT H0: all alphas are statistically zero"),
    )


def grs_test(
    results: DataFrame,
    residuals: DataFrame,
    factors: DataFrame,
    portfolios: list[str],
    model: str = "FF5",
    keys: list[str] | None = None,
    alpha_level: float = 0.05,
    variant: str = "full",
) -> DataFrame:
    """:func:`joint_tests` of one model, one row per ``keys``."""
    return joint_tests(results, residuals, factors, portfolios, [model], keys, alpha_level, variant).drop("model")


def _symmetric(cells: np.ndarray, size: int) -> np.ndarray:
    """Stacked symmetric matrices from their upper triangles, row by row."""
    out = np.empty((len(cells), size, size))
    i, j = np.triu_indices(size)
    out[:, i, j] = out[:, j, i] = cells
    return out


def _sound(matrices: np.ndarray) -> np.ndarray:
    """Which matrices can be solved, judged on correlations."""
    scale = np.sqrt(np.einsum("gii->gi", matrices))
    sound = (scale > 0).all(axis=1) & np.isfinite(matrices).all(axis=(1, 2))
    corr = matrices[sound] / (scale[sound][:, :, None] * scale[sound][:, None, :])
    sound[sound] = np.linalg.cond(corr) < SINGULAR
    return sound


def _tests(pdf: pd.DataFrame, width: int, depth: int, variant: str, level: float) -> pd.DataFrame:
    """The tests of rows of one model, as stacked systems."""
    count, errors_in = len(pdf), width * (width + 1) // 2
    months = pdf["n"].fillna(0).to_numpy().astype(np.int64)
    df2 = months - width - depth
    alphas = np.array([list(a) for a in pdf["alphas"]], float).reshape(count, width)
    missing = np.isnan(alphas).any(axis=1)
    unequal = (variant == "full") & ~((pdf["n_min"] == pdf["n_max"]) & (pdf["n_max"] == months)).to_numpy()
    ready = ~missing & ~unequal & (df2 > 0) & ((width >= 2) | (variant == "full"))
    term2, term3 = np.ones(count), np.full(count, np.nan)
    solved = ready.copy()
    if ready.any():
        cells = np.stack(pdf["cells"].to_numpy()[ready]).astype(float)
        errors, moves = _symmetric(cells[:, :errors_in], width), _symmetric(cells[:, errors_in:], depth)
        sound = _sound(errors) & (_sound(moves) | (variant == "simple"))
        solved[ready] = sound
        a = alphas[solved]
        term3[solved] = np.einsum("gi,gi->g", a, np.linalg.solve(errors[sound], a[:, :, None])[:, :, 0])
        if variant == "full":
            mu = np.stack(pdf["factor_means"].to_numpy()[solved]).astype(float) if solved.any() else np.zeros((0, depth))
            term2[solved] = 1 / (1 + np.einsum("gi,gi->g", mu, np.linalg.solve(moves[sound], mu[:, :, None])[:, :, 0]))
    term1 = df2 / width
    statistic = np.where(solved, term1 * term2 * term3, np.nan)
    critical = np.full(count, np.nan)
    critical[solved] = f_critical(level, float(width), df2[solved].astype(float))
    status = np.select(
        [np.full(count, width < 2 and variant == "simple"), missing, unequal, df2 <= 0, ~solved],
        ["too_few_portfolios", "missing_portfolio", "unequal_n", "no_degrees_of_freedom", "singular"], "ok",
    )

    def if_solved(values: np.ndarray) -> list:
        return [v.item() if s else None for v, s in zip(values, solved)]

    return pdf.assign(
        status=status, n_portfolios=width, n_factors=depth, n_obs=months, df2=df2,
        f_statistic=if_solved(statistic), critical_value=if_solved(critical),
        p_value=if_solved(f_upper_tail(statistic, float(width), df2.astype(float))),
        is_significant=pd.Series(if_solved(statistic > critical), index=pdf.index, dtype=object),
        term1=if_solved(term1), term2=if_solved(term2), term3=if_solved(term3),
    )
