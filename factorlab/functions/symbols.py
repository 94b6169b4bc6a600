"""Symbol dimensions, cleaning rule and resolution (SC1-SC5, DIM1-DIM3, AGG10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# ---- Fixed values ---------------------------------------------------------

# Symbols the cleaning rule rewrites directly.
CLEAN_RENAMES = {
    "BRK.B": "BRK-B",
    "BRK.A": "BRK-A",
    "BF.B": "BF-B",
    "BF.A": "BF-A",
    "FB": "META",
    "GOOG": "GOOGL",
    "BERKSHIRE HATHAWAY B": "BRK-B",
    "BERKSHIRE HATHAWAY A": "BRK-A",
}

# Old symbol -> current symbol, by why they are linked.
MAPPINGS = {
    "renamed": {
        "ANTM": "ELV", "CTL": "LUMEN", "FISV": "FI", "FB": "META", "NLOK": "GEN", "VIAC": "PARA",
    },
    "merged": {
        "UTX": "RTX", "RTN": "RTX", "COG": "CTRA", "MYL": "VTRS", "DWDP": "DD",
    },
    "proxy": {
        "PEAK": "HPP", "CERN": "ORCL", "ABMD": "JNJ", "BLL": "BALL", "RE": "RGA", "RVTYP": "RVTY",
    },
    "format": {
        "BRK.B": "BRK-B", "BF.B": "BF-B",
    },
    "unchanged": {
        "ADS": "ADS", "DFS": "DFS", "CTLT": "CTLT", "CDAY": "CDAY", "FLT": "FLT", "HFC": "HFC",
        "DIS": "DIS", "COF": "COF", "USB": "USB", "ORCL": "ORCL", "CRM": "CRM", "XOM": "XOM",
        "CVX": "CVX", "PYPL": "PYPL",
    },
}

# Symbols that no longer trade.
EXTINCT = [
    "ALXN", "ATVI", "TWTR", "XLNX", "TIF", "WLTW", "CTXS", "CXO", "VAR", "FLIR", "MXIM",
    "FRC", "SIVB", "PBCT", "ETFC", "DISCA", "DISCK", "NLSN", "NBL", "XEC", "PXD", "CELG",
    "PKI", "WRK", "DISH", "GPS", "JWN",
]

# Extinct symbols with a listed successor.
REPLACEMENTS = {"CELG": "BMY", "NBL": "CVX", "ETFC": "MS", "PBCT": "MTB"}

# Symbols with recorded metadata.
METADATA = {"AAPL": "active", "MSFT": "active"}

# ---------------------------------------------------------------------------


def normal(symbol: str | Column) -> Column:
    """Upper case without surrounding blanks."""
    text = F.col(symbol) if isinstance(symbol, str) else symbol
    return F.regexp_replace(F.upper(text), r"^\s+|\s+$", "")


def clean_symbol(symbol: str | Column, cut: bool = True) -> Column:
    """Canonical form of a raw symbol (SC1); ``cut`` shortens one of more than eight characters to five."""
    raw = normal(symbol)
    renames = F.create_map(*[F.lit(text) for pair in CLEAN_RENAMES.items() for text in pair])
    text = F.regexp_replace(raw, r"\.([AB])$", "-$1")
    text = F.regexp_replace(text, r"\s+(INC|CORP|CO|LTD|LLC)\.?$", "")
    text = F.regexp_replace(text, r"\s+CLASS\s+[AB]$", "")
    text = F.regexp_replace(text, r"\.", "-")
    text = F.regexp_replace(text, r"[^A-Z0-9\-]", "")
    # The patterns above and the two lengths are fixed values.
    shortened = F.when(F.length(text) > 8, F.substring(text, 1, 5)).otherwise(text) if cut else text
    return F.coalesce(F.try_element_at(renames, raw), shortened)


def looks_extinct(symbol: str | Column) -> Column:
    return (F.col(symbol) if isinstance(symbol, str) else symbol).endswith("Q")


def _constant_table(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """Fixed rows as a local relation, whose size the optimiser knows."""
    def text(value: str | None) -> str:
        return "CAST(NULL AS STRING)" if value is None else "'" + value.replace("'", "\\'") + "'"

    values = ", ".join("(" + ", ".join(map(text, row)) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")


def mapping_dimension(spark: SparkSession) -> DataFrame:
    rows = [(old, new, kind) for kind, pairs in MAPPINGS.items() for old, new in pairs.items()]
    return _constant_table(spark, rows, "symbol, target, kind")


def extinct_dimension(spark: SparkSession) -> DataFrame:
    rows = [(symbol, REPLACEMENTS.get(symbol)) for symbol in EXTINCT]
    return _constant_table(spark, rows, "symbol, replacement")


def metadata_dimension(spark: SparkSession) -> DataFrame:
    return _constant_table(spark, list(METADATA.items()), "symbol, status")


def add_mappings(dimension: DataFrame, additions: DataFrame) -> DataFrame:
    """Upsert ``(symbol, target, kind, seq)``; per symbol the highest ``seq`` wins (DIM1)."""
    fresh = additions.select(
        normal("symbol").alias("symbol"), normal("target").alias("target"), "kind",
        F.col("seq").cast("long").alias("seq"),
    )
    known = dimension.withColumn("seq", F.lit(-1).cast("long"))
    return (
        known.unionByName(fresh)
        .groupBy("symbol")
        .agg(F.max_by(F.struct("target", "kind"), F.struct("seq", "target")).alias("latest"))
        .select("symbol", "latest.target", "latest.kind")
    )


def mark_extinct(dimension: DataFrame, additions: DataFrame) -> DataFrame:
    """Add ``(symbol)`` rows; a known replacement is kept (DIM2)."""
    fresh = additions.select(
        normal("symbol").alias("symbol"), F.lit(None).cast("string").alias("replacement")
    )
    return (
        dimension.unionByName(fresh)
        .groupBy("symbol")
        .agg(F.max("replacement").alias("replacement"))
    )


def list_mappings(mappings: DataFrame, extinct: DataFrame) -> DataFrame:
    """Both dimensions as one sorted listing (DIM3)."""
    return (
        mappings.select(F.lit("mapping").alias("entry"), "symbol", "target")
        .unionByName(
            extinct.select(F.lit("extinct").alias("entry"), "symbol",
                           F.col("replacement").alias("target"))
        )
        .orderBy("entry", "symbol")
    )


def resolve_symbols(
    df: DataFrame,
    column: str,
    mappings: DataFrame | None = None,
    extinct: DataFrame | None = None,
    check_extinct: bool = True,
    leave_out: Sequence[str] = (),
) -> DataFrame:
    """Add ``resolution`` = struct(symbol, status, reason, original) (SC2).

    Precedence: replaced, extinct, mapped, format_corrected, original. Mappings of
    the kinds in ``leave_out`` (say ``proxy``) do not count. The dimensions are small
    local tables, so Spark broadcasts them by their size.
    """
    spark = df.sparkSession
    mappings = mapping_dimension(spark) if mappings is None else mappings
    if leave_out:
        mappings = without_kinds(mappings, leave_out)
    extinct = extinct_dimension(spark) if extinct is None else extinct
    gone = extinct.select(
        F.col("symbol").alias("_sym"), F.col("replacement").alias("_repl"),
        F.lit(check_extinct).alias("_gone"),
    )
    moved = mappings.select(F.col("symbol").alias("_sym"), F.col("target").alias("_target"))
    is_gone = F.coalesce("_gone", F.lit(False))
    replaced = is_gone & (F.coalesce("_repl", F.lit("")) != "")

    def choose(on_replaced, on_extinct, on_mapped, on_format, on_original) -> Column:
        return (
            F.when(replaced, on_replaced)
            .when(is_gone, on_extinct)
            .when(F.col("_target").isNotNull(), on_mapped)
            .when(F.contains(F.col("_sym"), F.lit(".")), on_format)
            .otherwise(on_original)
        )

    symbol = choose(
        F.col("_repl"), F.col("_sym"), F.col("_target"),
        F.regexp_replace("_sym", r"\.", "-"), F.col("_sym"),
    )
    # Statuses and reasons.
    status = choose(*map(F.lit, ["replaced", "extinct", "mapped", "format_corrected", "original"]))
    reason = choose(*map(F.lit, [
        "extinct_with_replacement", "extinct_no_replacement", "symbol_change",
        "dot_to_hyphen", "no_changes_needed",
    ]))
    return (
        df.withColumn("_sym", normal(column))
        .join(gone, "_sym", "left")
        .join(moved, "_sym", "left")
        .withColumn("resolution", F.struct(
            symbol.alias("symbol"), status.alias("status"), reason.alias("reason"),
            F.col("_sym").alias("original"),
        ))
        .drop("_sym", "_repl", "_gone", "_target")
    )


def with_extinct_flag(df: DataFrame, column: str, extinct: DataFrame | None = None) -> DataFrame:
    """Add the boolean ``is_extinct`` (SC3)."""
    extinct = extinct_dimension(df.sparkSession) if extinct is None else extinct
    gone = extinct.select(F.col("symbol").alias("_sym"), F.lit(True).alias("_gone"))
    return (
        df.withColumn("_sym", normal(column))
        .join(gone, "_sym", "left")
        .withColumn("is_extinct", F.coalesce("_gone", F.lit(False)))
        .drop("_sym", "_gone")
    )


def with_metadata(df: DataFrame, column: str, metadata: DataFrame | None = None) -> DataFrame:
    """Add ``metadata_status``, ``unknown`` where nothing is recorded (SC4)."""
    metadata = metadata_dimension(df.sparkSession) if metadata is None else metadata
    known = metadata.select(F.col("symbol").alias("_sym"), F.col("status").alias("_status"))
    return (
        df.withColumn("_sym", normal(column))
        .join(known, "_sym", "left")
        .withColumn("metadata_status", F.coalesce("_status", F.lit("unknown")))
        .drop("_sym", "_status")
    )


def resolution_stats(resolved: DataFrame) -> DataFrame:
    """Counts per status on one row, with the resolvable share in percent (AGG10)."""
    status = F.col("resolution.status")
    names = ["original", "mapped", "extinct", "format_corrected", "replaced"]
    counts = [F.count_if(status == name).alias(name) for name in names]
    return (
        resolved.agg(*counts, F.count("*").alias("total"))
        .withColumn("resolvable", F.col("total") - F.col("extinct"))
        .withColumn(
            "success_rate", F.bround(F.try_divide(F.col("resolvable"), F.col("total")) * 100, 1)
        )
    )


# ---- dated mappings --------------------------------------------------------

def without_kinds(mappings: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """The mapping dimension without the named kinds, such as ``proxy``: stand-ins that are other companies."""
    return mappings.filter(~F.col("kind").isin(list(kinds)) | F.col("kind").isNull())


def mapping_spans(mappings: DataFrame) -> DataFrame:
    """``(symbol, spans)`` of dated mappings ``(symbol, target, kind, valid_from)``.

    A mapping holds from its day until the next one of the same symbol; without a day
    it holds from the beginning. On one day the greatest target counts. The spans of a
    symbol are an array in order of time, so that a panel meets the dimension
    by symbol alone and picks its span in the row.
    """
    since = F.coalesce("valid_from", F.lit("0001-01-01").cast("date"))
    one = mappings.groupBy(normal("symbol").alias("symbol"), since.alias("since")).agg(
        F.max_by(F.struct(normal("target").alias("target"), "kind"), normal("target")).alias("mapped")
    )
    return one.groupBy("symbol").agg(
        F.sort_array(F.collect_list(F.struct("since", "mapped.target", "mapped.kind"))).alias("spans")
    )


def resolve_symbols_asof(df: DataFrame, column: str, day: str, mappings: DataFrame) -> DataFrame:
    """Add ``resolved`` and ``mapping_kind``: the symbol that a raw one stood for on the row's day (SC2, DIM1).

    The mapping is the last one dated on or before the day; before all of them, and
    for a row without a day, the symbol stands for itself. An as-of join on the
    dimension: the rows are not moved when Spark can broadcast the spans, which it
    decides by their size.
    """
    spans = mapping_spans(mappings).withColumnRenamed("symbol", "_sym")
    in_force = F.element_at(F.filter("spans", lambda s: s["since"] <= F.col(day)), -1)
    return (
        df.withColumn("_sym", normal(column))
        .join(spans, "_sym", "left")
        .withColumn("_span", F.when(F.size(F.filter("spans", lambda s: s["since"] <= F.col(day))) > 0, in_force))
        .withColumn("resolved", F.coalesce("_span.target", "_sym"))
        .withColumn("mapping_kind", F.col("_span.kind"))
        .drop("_sym", "spans", "_span")
    )
