"""Column expressions shared by the performance and regression operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields NULL on a zero denominator."""
    return F.try_divide(numerator, denominator)


def pct_change(new: Column, old: Column) -> Column:
    return (ratio(new, old) - 1) * 100


def compound(pct: Column) -> Column:
    """Growth factor of a percent return."""
    return 1 + pct / 100


def at_least(n: int, share: float) -> int:
    """Smallest whole count covering ``share`` of ``n``."""
    return math.ceil(n * share)


def annual_return(pct: Column) -> Column:
    return F.avg(pct) * 12


def annual_vol(pct: Column) -> Column:
    return F.stddev_samp(pct) * math.sqrt(12)


def monthly_sharpe(excess: Column) -> Column:
    return ratio(F.avg(excess), F.stddev_samp(excess))


def skewness_sample_sd(x: Column) -> Column:
    """Third standardised moment with the n-1 standard deviation; NULL up to n = 3."""
    n = F.count(x)
    return F.when(n > 3, F.skewness(x) * F.pow((n - 1) / n, F.lit(1.5)))


def kurtosis_sample_sd(x: Column) -> Column:
    """Excess fourth moment with the n-1 standard deviation; NULL up to n = 3."""
    n = F.count(x)
    return F.when(n > 3, (F.kurtosis(x) + 3) * F.pow((n - 1) / n, F.lit(2.0)) - 3)


def anomaly_status(annual_long_short: Column) -> Column:
    # Thresholds and labels of the report.
    return (
        F.when(annual_long_short > 2.0, "STRONG ANOMALY DETECTED")
        .when(annual_long_short > 0.0, "WEAK ANOMALY DETECTED")
        .otherwise("ANOMALY REVERSED")
    )


def significance(pvalue: Column) -> Column:
    # Significance levels of the regression summary.
    return (
        F.when(pvalue < 0.01, "highly significant")
        .when(pvalue < 0.05, "significant")
        .when(pvalue < 0.10, "marginally significant")
        .otherwise("not significant")
    )


def verdict(model: Column, pvalue: Column, thesis: str, long_form: bool = False) -> Column:
    """What the best model's alpha says about ``thesis``.

    ``thesis`` is the name printed in the sentence, for example the author of
    the critique that risk factors explain the anomaly away.
    """
    tail = " adjustment" if long_form else ""
    no_alpha = "No significant alpha" if long_form else "No alpha"
    alpha = "Significant alpha remains" if long_form else "Alpha"
    capm_tail = tail if long_form else ""
    # The six outcomes.
    supported = {
        "CAPM": f"SUPPORTS {thesis}: No significant alpha after CAPM{capm_tail}",
        "FF3": f"STRONGLY SUPPORTS {thesis}: {no_alpha} after FF3{tail}",
        "FF5": f"VERY STRONGLY SUPPORTS {thesis}: {no_alpha} after FF5{tail}",
    }
    opposed = {
        "CAPM": f"WEAK EVIDENCE against {thesis}: {alpha} after CAPM",
        "FF3": f"CONTRADICTS {thesis}: {alpha} after FF3{tail}",
        "FF5": f"STRONGLY CONTRADICTS {thesis}: {alpha} after FF5{tail}",
    }

    def pick(texts: dict[str, str]) -> Column:
        return (
            F.when(model == "CAPM", texts["CAPM"])
            .when(model == "FF3", texts["FF3"])
            .otherwise(texts["FF5"])
        )

    return F.when(pvalue > 0.05, pick(supported)).when(pvalue.isNotNull(), pick(opposed))
