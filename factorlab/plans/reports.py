"""Report tables and file sinks (SNK3-7, SC8, SC11)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.stats import anomaly_status
from ..schemas import LONG_SHORT, PORTFOLIOS


def report_table(performance: DataFrame) -> DataFrame:
    """Rounded figures per portfolio and lookback with the anomaly status (SNK7, SC8)."""
    status = F.when(F.col("portfolio") == LONG_SHORT, anomaly_status(F.col("annual_return")))
    return performance.select(
        "lookback", "portfolio",
        F.bround("annual_return", 2).alias("annual_return"),
        F.bround("annual_vol", 2).alias("annual_vol"),
        F.bround("sharpe_ratio", 3).alias("sharpe_ratio"),
        F.bround(F.col("max_drawdown") * 100, 2).alias("max_drawdown"),
        status.alias("anomaly_status"),
    )


def final_summary(
    performance: DataFrame,
    start: dt.date | None = None,
    end: dt.date | None = None,
    lookbacks: Sequence[int] | None = None,
    models: Sequence[str] | None = None,
) -> DataFrame:
    """Long-short return, Sharpe ratio and months per lookback, beside what was asked of the study (SNK6)."""
    asked = []
    if start is not None:
        asked = [
            F.concat_ws(" to ", F.lit(str(start)), F.lit(str(end))).alias("period"),
            F.concat_ws(",", *map(F.lit, map(str, lookbacks or []))).alias("lookbacks"),
            F.concat_ws(",", *map(F.lit, models or [])).alias("models"),
        ]
    return performance.filter(F.col("portfolio") == LONG_SHORT).select(
        "lookback", "annual_return", "sharpe_ratio", "n_months", *asked
    )


PER_DOCUMENT = 64  # portfolios about


def results_document(
    performance: DataFrame, results: DataFrame | None, start, end, per_document: int = PER_DOCUMENT
) -> DataFrame:
    """Nested rows of period, performance and regressions (SNK4): one per lookback and chunk of portfolios.

    A chunk holds about ``per_document`` portfolios, chosen by a hash of the name,
    so that a document's size does not grow with the study. Six portfolios are one chunk.
    """
    chunks = performance.groupBy("lookback").agg(
        F.ceil(F.count_distinct("portfolio") / per_document).cast("int").alias("chunks")
    )

    def chunked(table: DataFrame) -> DataFrame:
        number = F.pmod(F.xxhash64("portfolio"), F.col("chunks")).cast("int")
        return table.join(chunks, "lookback").withColumn("chunk", number).drop("chunks")

    keys = ["lookback", "chunk"]
    measures = [c for c in performance.columns if c not in ("lookback", "portfolio")]
    document = chunked(performance).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("portfolio", *measures))).alias("performance")
    ).withColumn("period", F.struct(
        F.lit(str(start)).alias("start"), F.lit(str(end)).alias("end")
    ))
    if results is None:
        return document
    columns = [c for c in results.columns if c != "lookback"]
    fits = chunked(results).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(*columns))).alias("factor_results")
    )
    return document.join(fits, keys, "left")


def read_documents(spark: SparkSession, path: str, document: DataFrame) -> DataFrame:
    """The documents of a folder that :func:`write_json` left, in the shape of ``document``."""
    return spark.read.schema(document.schema).json(path)


def write_portfolio_csv(wide: DataFrame, path: str) -> None:
    """A CSV folder per lookback; a lookback has one row per month (SNK3)."""
    (
        wide.select("lookback", "date", *PORTFOLIOS)
        .repartition("lookback").sortWithinPartitions("lookback", "date")
        .write.mode("overwrite").option("header", True).partitionBy("lookback").csv(path)
    )


def write_json(table: DataFrame, path: str) -> None:
    """Any result table as JSON lines (SNK4, SNK5, SNK6)."""
    table.write.mode("overwrite").json(path)
