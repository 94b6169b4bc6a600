"""Factor files: text ingest, table cache, period access, summaries (SRC7-9, SNK2, AGG7, AGG9)."""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.dates import first_of_month, in_period, month_floor
from ..schemas import FACTOR_TABLE, FACTORS, require_columns

COLUMNS = FACTORS + ["RF"]


def read_factor_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of one or many factor files as ``(file, line_no, value)``.

    A factor file holds one line per month and year, so a file fits in a row;
    many files spread over the executors.
    """
    return (
        spark.read.text(path, wholetext=True)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "value"),
        )
    )


def parse_factor_lines(lines: DataFrame, null_sentinels: list[float] | None = None) -> DataFrame:
    """Monthly block of factor text as a factor table (SRC7).

    The block starts after the header that names the factors and ends before
    the first line with a copyright note or a bare four-digit year. Rows whose
    values do not parse are skipped.
    """
    text = F.trim("value")
    # Words of the header and line patterns.
    is_header = (
        F.contains("value", F.lit("Mkt-RF"))
        & F.contains("value", F.lit("SMB"))
        & F.contains("value", F.lit("HML"))
    )
    is_end = F.contains(F.lower(text), F.lit("copyright")) | text.rlike(r"^\d{4}[^0-9]")
    per_file = Window.partitionBy("file")
    header = F.min(F.when(is_header, F.col("line_no"))).over(per_file)
    end = F.min(F.when(is_end & (F.col("line_no") > F.col("_header")), F.col("line_no")))
    inside = (F.col("line_no") > F.col("_header")) & (
        F.col("_end").isNull() | (F.col("line_no") < F.col("_end"))
    )
    fields = F.split(text, r"\s*,\s*")
    values = [
        F.get(fields, F.lit(i + 1)).try_cast("double").alias(name)
        for i, name in enumerate(COLUMNS)
    ]
    parsed = (
        lines.withColumn("_header", header)
        .withColumn("_end", end.over(per_file))
        .filter(inside & text.rlike(r"^\d{6}\s*,"))
        .select(
            F.try_to_date(F.concat(F.substring(text, 1, 6), F.lit("01")), "yyyyMMdd").alias("date"),
            *values,
        )
        .dropna()
    )
    if null_sentinels:
        for name in COLUMNS:
            parsed = parsed.withColumn(
                name, F.when(~F.col(name).isin(null_sentinels), F.col(name))
            )
    return parsed


def write_factors(factors: DataFrame, path: str) -> None:
    """Store the full parsed history, not a clipped one (SNK2)."""
    require_columns(factors, FACTOR_TABLE.names, "factor table")
    factors.select(*FACTOR_TABLE.names).orderBy("date").write.mode("overwrite").parquet(path)


def read_factors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FACTOR_TABLE).parquet(path)


def factors_cover(factors: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """One row: the stored range and whether its months enclose the request (SRC8)."""
    first, last = F.min(month_floor("date")), F.max(month_floor("date"))
    return factors.agg(
        first.alias("first_month"),
        last.alias("last_month"),
        F.coalesce(
            (first <= F.lit(first_of_month(start))) & (last >= F.lit(first_of_month(end))),
            F.lit(False),
        ).alias("covered"),
    )


def factors_for_period(factors: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Factor months inside the period (SRC9)."""
    return factors.filter(in_period(start, end))


def get_factors(
    spark: SparkSession,
    source: str,
    store: str,
    start: dt.date,
    end: dt.date,
    use_cache: bool = True,
    force_refresh: bool = False,
) -> DataFrame:
    """Factors of a period: from the store when it covers the request, else re-ingested.

    Ingest parses the text at ``source``, rewrites the store in full and reads
    the period back (SRC7-SRC9, SNK2).
    """
    if use_cache and not force_refresh:
        try:
            stored = read_factors(spark, store)
            if factors_cover(stored, start, end).first()["covered"]:
                return factors_for_period(stored, start, end)
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":  # no store yet is the normal first call
                raise
    write_factors(parse_factor_lines(read_factor_lines(spark, source)), store)
    return factors_for_period(read_factors(spark, store), start, end)


def factor_summary(factors: DataFrame) -> DataFrame:
    """Mean, deviation, range and count per factor (AGG7)."""
    long = factors.unpivot(["date"], COLUMNS, "factor", "value")
    return long.groupBy("factor").agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.count("value").alias("n_obs"),
    )


def factor_correlations(factors: DataFrame) -> DataFrame:
    """The three correlations of the summary, with period and months (AGG7)."""
    return factors.agg(
        F.min("date").alias("period_start"),
        F.max("date").alias("period_end"),
        F.count("*").alias("n_months"),
        F.corr("MKT_RF", "SMB").alias("mkt_smb"),
        F.corr("MKT_RF", "HML").alias("mkt_hml"),
        F.corr("SMB", "HML").alias("smb_hml"),
    )


def factor_validation(factors: DataFrame) -> DataFrame:
    """Means shown after a load (AGG9)."""
    return factors.agg(
        F.avg("MKT_RF").alias("mean_mkt_rf"),
        F.avg("RF").alias("mean_rf"),
        F.count("*").alias("n_months"),
    )
