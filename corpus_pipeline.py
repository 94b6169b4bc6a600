"""A corpus pipeline in five stages, each an operator of ``factorlab.llm``.

A stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
Its result is written as Parquet and read again as the next one's documents. All
stages but the last return the columns of ``docs``; the last adds shard, slot,
size and text_crc32.

Nulls, empty and long texts, repeated rows, empty tables and extra columns are
treated as the operators' docstrings say. Rows without a text fail the quality
rules and go in the first stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factorlab.llm import decontamination, mixing, near_duplicates, quality_rules, sharding
from factorlab.staging import release, staging_root

# No source is repeated more than twice, so that small sources gain weight while every document stays.
MIXTURE = mixing.Target(entropy=None, max_repeats=2.0)


# Bytes of texts that a task holds back before it writes them.
ROW_GROUP = 16 << 20


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.filtered(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one of the smallest id."""
    return near_duplicates.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; longer passages of the benchmark are cut from the others."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, those of smaller sources up to twice, to the mixture's weights."""
    return mixing.mixed(docs, MIXTURE)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and slot."""
    return sharding.laid_out(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

# Near duplicates are found by random sketches, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, from the documents of ``sf_dir``; returns the last one's rows.

    A stage's rows are deleted when those of the next one are written, but for the last
    written, which the result reads.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{staging_root(spark)}/corpus-{uuid.uuid4().hex}"
    before = docs  # not staged: nothing to delete
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{root}/{k}-{name}"
            docs.write.option("parquet.block.size", ROW_GROUP).parquet(path)
            release(before)
            docs = before = spark.read.parquet(path)
            before._staged_at = path
    return docs
