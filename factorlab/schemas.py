"""Fixed schemas of the tables the library reads and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T

# Names of factors, portfolios and columns that tables and files must have.
FACTORS = ["MKT_RF", "SMB", "HML", "RMW", "CMA"]
QUINTILES = ["P1", "P2", "P3", "P4", "P5"]
LONG_SHORT = "LowMinusHigh"
PORTFOLIOS = QUINTILES + [LONG_SHORT]

# Factors each model regresses on. Names and members are fixed values.
MODELS = {
    "CAPM": ["MKT_RF"],
    "FF3": ["MKT_RF", "SMB", "HML"],
    "FF5": ["MKT_RF", "SMB", "HML", "RMW", "CMA"],
}

PRICES = T.StructType([
    T.StructField("ticker", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("price", T.DoubleType()),
])

PRICE_FILE = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("price", T.DoubleType()),
])

CONSTITUENTS_FILE = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("tickers", T.StringType()),
])

# The factor table's columns.
FACTOR_TABLE = T.StructType(
    [T.StructField("date", T.DateType())]
    + [T.StructField(name, T.DoubleType()) for name in FACTORS + ["RF"]]
)


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    """Required names that ``df`` lacks, in the order they were asked for."""
    present = set(df.columns)
    return [name for name in required if name not in present]


def require_columns(df: DataFrame, required: list[str], what: str) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"{what} lacks columns: {', '.join(missing)}")
    return df
