"""Exact cross-sectional position when a cross-section may outgrow one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from ..staging import stage

# A group of this many narrow rows sorts comfortably inside one task.
SINGLE_TASK_ROWS = 4_000_000


def rank_within(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    rank: str = "rn",
    single_task_rows: int = SINGLE_TASK_ROWS,
) -> DataFrame:
    """Add the 1-based position of each row within ``keys`` by ascending ``order``.

    ``df`` should be staged: it is counted first. While the largest group fits
    in a task this is a plain window. Beyond that, the rows are range-partitioned
    on keys and order together, which balances any mix of group sizes and ties;
    each slice is numbered on its own and shifted by the rows of its group in
    earlier slices. ``order`` must be unique within ``keys``.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    largest, total = sizes.agg(F.max("_rows"), F.sum("_rows")).first()
    if (largest or 0) <= single_task_rows:
        return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))

    slices = math.ceil(total / single_task_rows)
    # Range bounds come from a sample, so the slice numbers are staged: both uses
    # below must see the same ones.
    sliced = stage(
        df.repartitionByRange(slices, *keys, *order).withColumn("_slice", F.spark_partition_id()),
        "slices",
    )
    earlier = (
        Window.partitionBy(*keys).orderBy("_slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # At most one row per slice and group boundary: slices + groups rows in all.
    offsets = (
        sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .drop("_rows")
    )
    within = Window.partitionBy(*keys, "_slice").orderBy(*order)
    return (
        sliced.withColumn("_local", F.row_number().over(within))
        .join(F.broadcast(offsets), [*keys, "_slice"])
        .withColumn(rank, (F.col("_local") + F.col("_before")).cast("int"))
        .drop("_local", "_before", "_slice")
    )
