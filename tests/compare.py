"""Run registered queries against their SQL and report differences.

    python -m tests.compare SF_DIR [--shared] [query ...]

With --shared the derived tables are built once for all queries.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or value is pd.NaT:
        return None
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if hasattr(value, "item"):
        return plain(value.item())
    if hasattr(value, "isoformat"):
        return value.isoformat()[:10]
    return str(value)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=str)


def difference(spark_df, con, sql: str) -> str | None:
    ours = rows_of(spark_df.columns, spark_df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    theirs = rows_of(names, cursor.fetchall())
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)}"
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(ours)} rows differ; {sorted(names)}\n  {wrong[0][0]}\n  {wrong[0][1]}"
    return None if ours else "EMPTY"


def session(shuffle: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").appName("factorlab")
        .config("spark.sql.shuffle.partitions", shuffle)
        .config("spark.ui.enabled", "false").config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(sf_dir: str, wanted: list[str]) -> int:
    import __spark_entry__ as entry

    spark, con, bad = session(), connect(sf_dir), 0
    queries, oracles = entry.queries(), entry.oracle_sql()
    if "--shared" in wanted:
        from catalog.queries import ON_TABLES
        from catalog.views import Tables

        tables = Tables(spark, sf_dir)
        queries = {name: lambda *_, fn=fn: fn(tables) for name, fn in ON_TABLES.items()}
        wanted = [name for name in wanted if name != "--shared"]
    for name in wanted or queries:
        began = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                problem = difference(df, con, oracles[name])
            else:
                problem = None if df.count() else "EMPTY"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {time.time() - began:6.1f}s {name} {problem or ''}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
