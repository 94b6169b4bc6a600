"""Sharding by sampled splitters: shards of near equal bytes, cut from one order of all rows.

Rows are ordered by (md5 of the text, doc_id), so that equal texts stand
together. Keys are drawn with a probability in proportion to the rows' sizes;
quantiles of the draw split the order into ranges, which different tasks sort.
As a splitter is a text hash with an id, a large group of copies is split
inside. A range that still is overfull is drawn from and split again. Range
totals then give every row its exact place in bytes, and with it the shard:
draws only decide who sorts what, never where a row ends up.

The law is ``bytes``: a shard begins at each eighth of all bytes (with eight
shards), so that shards differ by less than one row's size.

Defined results for odd input: a null text has size 1 and the crc32 of the empty
text; null ids come first among equal texts; rows that repeat in full follow each
other and take one slot each; a very long text is a range of its own; an empty table gives an empty one; fewer rows than
shards leave shards empty. Extra columns pass through ``laid_out`` unread.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..staging import stage
from .words import fresh

SHARDS = 8
# Ranges for each shard at least; more where ranges would outgrow RANGE_BYTES, which is what a task sorts.
RANGES_PER_SHARD, RANGE_BYTES = 16, 1 << 29
# Keys drawn for each range.
DRAWS = 32
# A range of so many times the mean bytes is split again.
OVERFULL = 3.0
LOWEST_ID = -(1 << 63)


def _keys(text: str, doc_id: str) -> dict[str, Column]:
    body = F.coalesce(F.col(text), F.lit(""))
    return {
        "size": F.octet_length(body).cast("long") + 1,
        "hash": F.conv(F.substring(F.md5(body), 1, 15), 16, 10).cast("long"),
        "id": F.coalesce(F.col(doc_id).cast("long"), F.lit(LOWEST_ID)),
    }


def _drawn(keys: DataFrame, count: int) -> pd.DataFrame:
    """``count`` keys, drawn without replacement by size: the first arrivals of clocks that tick at a rate of size."""
    uniform = (F.pmod(F.xxhash64("hash", "id", F.lit("draw")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    first = keys.select("hash", "id", (-F.ln(uniform) / F.col("size")).alias("_t")).orderBy("_t").limit(count)
    return first.select("hash", "id").toPandas()


def _quantiles(drawn: pd.DataFrame, ranges: int) -> list[tuple[int, int]]:
    ordered = sorted(set(zip(drawn["hash"].tolist(), drawn["id"].tolist(), strict=True)))
    at = {ordered[k * len(ordered) // ranges] for k in range(1, ranges)} if ordered else set()
    return sorted(at)


def range_of(splitters: list[tuple[int, int]], hash_: Column, id_: Column) -> Column:
    """Number of the range of a key: how many splitters are not above it."""
    hashes = np.array([h for h, _ in splitters], np.int64)
    ids = np.array([i for _, i in splitters], np.int64)

    @F.pandas_udf("int")
    def found(h: pd.Series, i: pd.Series) -> pd.Series:
        key, doc = h.to_numpy(), i.to_numpy()
        low, high = np.searchsorted(hashes, key, "left"), np.searchsorted(hashes, key, "right")
        out = low.copy()
        inside = np.flatnonzero(low < high)  # keys whose hash is a splitter's: their ids decide
        for a, b in set(zip(low[inside].tolist(), high[inside].tolist(), strict=True)):
            rows = inside[(low[inside] == a)]
            out[rows] = a + np.searchsorted(ids[a:b], doc[rows], "right")
        return pd.Series(out.astype(np.int32))

    return found(hash_, id_)


def splitters(keys: DataFrame, shards: int) -> tuple[list[tuple[int, int]], pd.DataFrame]:
    """Splitters of ranges that none is overfull, and the totals of each range."""
    total = keys.agg(F.sum("size")).first()[0]
    ranges = max(shards * RANGES_PER_SHARD, math.ceil((total or 0) / RANGE_BYTES))
    found = _quantiles(_drawn(keys, ranges * DRAWS), ranges)
    while True:
        ranged = keys.withColumn("range", range_of(found, F.col("hash"), F.col("id")))
        sums = ranged.groupBy("range").agg(
            F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"),
            F.min(F.struct("hash", "id")).alias("first"), F.max(F.struct("hash", "id")).alias("last"))
        totals = sums.select("range", "bytes", "rows", (F.col("first") != F.col("last")).alias("splits")).toPandas()
        totals = totals.sort_values("range", ignore_index=True)
        full = totals[(totals["bytes"] > OVERFULL * (total or 0) / ranges) & totals["splits"]]
        more = set(found)
        for r, size in zip(full["range"].tolist(), full["bytes"].tolist(), strict=True):
            parts = max(2, math.ceil(size * ranges / total))
            more |= set(_quantiles(_drawn(ranged.where(F.col("range") == r), parts * DRAWS), parts))
        if len(more) == len(found):
            return found, totals
        found = sorted(more)


def _placed(rows: DataFrame, shards: int, totals: pd.DataFrame, range_: str, hash_: str, id_: str, size: str, tie: list[str]) -> tuple[DataFrame, str, str]:
    """``rows`` with their shard and their number in the whole order; returns the names of the two columns."""
    names = {n: fresh(rows, f"_{n}") for n in ("bytes_before", "rows_before", "shard", "number")}
    total = int(totals["bytes"].sum())
    before = totals.assign(b=totals["bytes"].cumsum() - totals["bytes"], r=totals["rows"].cumsum() - totals["rows"])
    # One row for each range, of RANGE_BYTES about: some 200,000 for 100 TB.
    small = rows.sparkSession.createDataFrame(
        list(before[["range", "b", "r"]].itertuples(index=False, name=None)),
        f"`{range_}` int, `{names['bytes_before']}` long, `{names['rows_before']}` long")
    order = Window.partitionBy(range_).orderBy(hash_, id_, *tie)
    out = rows.join(F.broadcast(small), range_)
    at = F.col(names["bytes_before"]) + F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col(size)
    out = out.withColumns({names["shard"]: at, names["number"]: F.col(names["rows_before"]) + F.row_number().over(order) - 1})
    # In decimals: bytes times shards outgrow a long.
    shard = F.expr(f"cast(cast(`{names['shard']}` as decimal(20,0)) * {shards} div cast({max(1, total)} as decimal(20,0)) as int)")
    out = out.withColumn(names["shard"], shard)
    return out.drop(names["bytes_before"], names["rows_before"]), names["shard"], names["number"]


def _first_numbers(keys: DataFrame, found: list[tuple[int, int]], totals: pd.DataFrame, shards: int) -> dict[int, int]:
    """Number of each shard's first row. Only the ranges in which a shard begins are sorted for it."""
    total = int(totals["bytes"].sum())
    end = totals["bytes"].cumsum().to_numpy()
    # A shard's first row is the first that begins at or after byte ceil(k * total / shards): it holds
    # that byte or follows the row that does, so it is in the byte's range or the one after.
    holds = {int(np.searchsorted(end, -(-k * total // shards), "right")) for k in range(shards)}
    wanted = sorted({x for r in holds for x in (r, r + 1) if x in totals.index})
    ranges = totals.loc[wanted, "range"].tolist()
    ranged = keys.withColumn("range", range_of(found, F.col("hash"), F.col("id"))).where(F.col("range").isin(ranges))
    placed, shard, number = _placed(ranged, shards, totals, "range", "hash", "id", "size", ["size"])
    return {r[0]: r[1] for r in placed.groupBy(shard).agg(F.min(number)).collect()}


def _slot(number: Column, first: str) -> Column:
    """Number of a row within its shard; a shard without a first number is an error, never a lost row."""
    return number - F.coalesce(F.col(first), F.raise_error(F.lit("a shard has no first row")).cast("long"))


def laid_out(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``docs`` with ``shard``, ``slot`` (0, 1, ... within the shard), ``size`` and ``text_crc32``.

    The rows move once, to the task that sorts their range. A column of ``docs``
    of one of these names keeps its place; the new one's name is then lengthened.
    """
    keys = stage(docs.select(*(c.alias(n) for n, c in _keys("text", "doc_id").items())), "shard-keys")
    found, totals = splitters(keys, shards)
    firsts = _first_numbers(keys, found, totals, shards)
    names = {n: fresh(docs, n) for n in ("shard", "slot", "size", "text_crc32")}
    inner = {n: fresh(docs, f"_{n}") for n in ("range", "hash", "id", "first")}
    key = _keys("text", "doc_id")
    rows = docs.withColumns({
        names["size"]: key["size"], names["text_crc32"]: F.crc32(F.coalesce("text", F.lit("")).cast("binary")),
        inner["hash"]: key["hash"], inner["id"]: key["id"]})
    rows = rows.withColumn(inner["range"], range_of(found, F.col(inner["hash"]), F.col(inner["id"])))
    placed, shard, number = _placed(rows, shards, totals, inner["range"], inner["hash"], inner["id"], names["size"], [names["size"], names["text_crc32"]])
    starts = rows.sparkSession.createDataFrame(list(firsts.items()), f"`{shard}` int, `{inner['first']}` long")
    out = placed.join(F.broadcast(starts), shard, "left")  # a row for each shard
    out = out.withColumns({names["shard"]: F.col(shard), names["slot"]: _slot(F.col(number), inner["first"])})
    return out.select(*docs.columns, *names.values())


def assigned(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: its shard and slot, with size and checksum, without the text."""
    # The text goes no further than to its size, hash and checksum.
    key = _keys("text", "doc_id")
    narrow = stage(docs.select(
        "doc_id", key["size"].alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        key["hash"].alias("hash"), key["id"].alias("id")), "shard-rows")
    found, totals = splitters(narrow, shards)
    firsts = _first_numbers(narrow, found, totals, shards)
    rows = narrow.withColumn("range", range_of(found, F.col("hash"), F.col("id")))
    placed, shard, number = _placed(rows, shards, totals, "range", "hash", "id", "size", ["size", "text_crc32"])
    starts = narrow.sparkSession.createDataFrame(list(firsts.items()), f"`{shard}` int, first long")
    return placed.join(F.broadcast(starts), shard, "left").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col(shard).alias("shard"),
        _slot(F.col(number), "first").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
