"""Mixing sources to target weights by temperature, with DataFrame operations only.

Token shares are raised to an exponent between 0 (all sources alike) and 1 (as
they are) and normalised. The exponent is found by bisection: the largest whose
mixture reaches the wanted entropy, raised further where a source would be
repeated more often than allowed. Each source gets its weight of the budget in
tokens and spends it on permutations of its documents, one for each epoch; the
last permutation is left where the quota is used up. The mixture is cut into
blocks of equal share, in each of which every source has its weight; the
documents of a block are permuted again.

Without a budget of its own the mixture is as large as it must be for the source
that is repeated least to be used just once, so that no document is left out.

Defined results for odd input: a null source is a source of its own; a text that
is null or empty has no tokens and goes along with its epoch; a source without
tokens is used once; rows of one source with the same id share a place in
every permutation and go in together; an empty table gives an empty mixture.
Extra columns pass through ``mixed`` unread.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.sizing import broadcast_if_small
from ..staging import stage
from .words import fresh

WORD = r"[^\x20\x09-\x0D]+"
# The exponent is a multiple of 2 ** -STEPS; each pass over the sources halves the bracket PER_PASS times.
STEPS, PER_PASS = 20, 5
# Rows that a slice of a permutation holds on average.
SLICE_ROWS = 4_000


@dataclass(frozen=True)
class Target:
    """entropy: share of the largest possible entropy that the mixture must reach. max_repeats: of any source."""

    entropy: float | None = 0.95
    max_repeats: float | None = 4.0
    block_tokens: int = 1_000_000
    seed: str = "mix"


def source_key(source: Column) -> Column:
    """A key that is never null and different for every source."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source.cast("string")))


def place(seed: str, epoch: Column, doc_id: Column) -> Column:
    """A document's place in the permutation of an epoch: text that sorts like a random number."""
    return F.md5(F.concat_ws("/", F.lit(seed), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def exponent(sources: DataFrame, target: Target) -> float:
    """The exponent for ``sources`` (one row each, ``tokens`` above 0), as ``target`` wants it."""
    top, count = sources.agg(F.max("tokens"), F.count(F.lit(1))).first()
    if not count:
        return 1.0
    flat = math.log(count)

    def measured(values: list[float]) -> dict[float, tuple[float, float]]:
        """Entropy of the mixture, and how often its most repeated source is used, by exponent."""
        share = F.col("tokens") / F.lit(top)
        rows = sources.select(share.alias("share"), F.explode(F.array(*map(F.lit, values))).alias("a"))
        mass = F.pow("share", "a")
        sums = rows.groupBy("a").agg(
            F.sum(mass).alias("z"), F.sum(mass * F.ln(mass)).alias("m"), F.max(mass / F.col("share")).alias("repeats"))
        return {r.a: (math.log(r.z) - r.m / r.z, r.repeats) for r in sums.collect()}

    def bisected(holds, rising: bool) -> float:
        """The least exponent (or the largest, if not ``rising``) that ``holds``; the end of the range if none does."""
        low, high = 0, 1 << STEPS  # bracket in units of the resolution
        good = high if rising else low
        while high - low > 1:
            step = max(1, (high - low) >> PER_PASS)
            inner = list(range(low + step, high, step))
            found = measured([x / (1 << STEPS) for x in inner])
            yes = [x for x in inner if holds(found[x / (1 << STEPS)])]
            if rising:
                good = min(yes, default=high)
                low, high = good - step, good
            else:
                good = max(yes, default=low)
                low, high = good, good + step
        ends = measured([0.0, 1.0])
        if rising and holds(ends[0.0]):
            good = 0
        if not rising and holds(ends[1.0]):
            good = 1 << STEPS
        return good / (1 << STEPS)

    found = 1.0
    if target.entropy is not None:
        found = bisected(lambda x: x[0] >= target.entropy * flat - 1e-12, rising=False)
    if target.max_repeats is not None:
        found_repeats = bisected(lambda x: x[1] <= target.max_repeats + 1e-12, rising=True)
        found = max(found, found_repeats) if target.entropy is not None else found_repeats
    return found


def budgets(docs: DataFrame, target: Target = Target(), token_budget: int | None = None) -> DataFrame:
    """One row per source: tokens, weight, budget in tokens, whole epochs and the quota of the last one."""
    key = source_key(F.col("source"))
    counted = docs.select("source", key.alias("source_key"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).alias("n"))
    per_source = stage(counted.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("n").alias("tokens")), "sources")
    filled = per_source.where("tokens > 0")
    a = exponent(filled, target)
    top, z = filled.agg(F.max("tokens"), F.sum(F.pow("tokens", F.lit(a)))).first()
    z = z or 1.0
    weight = F.when(F.col("tokens") > 0, F.pow("tokens", F.lit(a)) / F.lit(z)).otherwise(0.0)
    if token_budget is None:
        budget = F.lit(top) * F.pow(F.col("tokens") / F.lit(top), F.lit(a))
    else:
        budget = weight * token_budget
    out = per_source.select(
        "source_key", "source", "tokens", F.lit(a).alias("exponent"), weight.alias("weight"),
        F.when(F.col("tokens") > 0, F.round(budget)).otherwise(0).cast("long").alias("budget"))
    whole = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(1)
    return out.withColumn("epochs", whole).withColumn("quota", F.col("budget") - F.col("epochs") * F.col("tokens"))


def _before(rows: DataFrame, digits: int) -> DataFrame:
    """``before``: tokens of the same source and epoch at smaller places.

    Places are cut into slices by their first digits. Slices are summed before
    anything is ordered, so that a source of any size is spread over as many
    tasks as it has slices.
    """
    group = ["source_key", "epoch", "slice"]
    sliced = rows.withColumn("slice", F.substring("place", 1, digits))
    sums = sliced.groupBy(*group).agg(F.sum("n_tokens").alias("_sum"))
    earlier = Window.partitionBy("source_key", "epoch").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_earlier", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    within = Window.partitionBy(*group).orderBy("place", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    return (
        sliced.withColumn("_within", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
        .join(sums, group).withColumn("before", F.col("_within") + F.col("_earlier"))
        .drop("slice", "_within", "_earlier")
    )


def plan(docs: DataFrame, target: Target = Target(), token_budget: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(documents without their texts, sources with the last place that each one's last epoch takes, digits of a slice)."""
    rows = stage(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), source_key(F.col("source")).alias("source_key"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("n_tokens")), "mix-rows")
    sources = stage(budgets(docs, target, token_budget), "budgets")
    digits = max(1, math.ceil(math.log(max(1, rows.count() / SLICE_ROWS), 16)))
    last = rows.join(broadcast_if_small(sources.where("quota > 0").select("source_key", "epochs", "quota")), "source_key")
    last = last.withColumn("epoch", F.col("epochs")).withColumn("place", place(target.seed, F.col("epoch"), F.col("doc_id")))
    taken = _before(last, digits).where("before < quota").groupBy("source_key").agg(F.max("place").alias("last_place"))
    return rows, stage(sources.join(taken, "source_key", "left"), "mix-sources"), digits


def _epochs(rows: DataFrame, sources: DataFrame, seed: str, doc_id: str, key: Column, epoch: str) -> DataFrame:
    """``rows`` once for every epoch that takes them, as column ``epoch``."""
    names = {c: fresh(rows, f"_{c}") for c in ("source_key", "epochs", "last_place")}
    small = sources.select(*(F.col(c).alias(n) for c, n in names.items()))
    joined = rows.join(broadcast_if_small(small), key == F.col(names["source_key"]))
    epochs = F.col(names["epochs"])
    in_last = F.coalesce(place(seed, epochs, F.col(doc_id)) <= F.col(names["last_place"]), F.lit(False))
    times = epochs + in_last.cast("long")
    repeated = F.when(times > 0, F.sequence(F.lit(0).cast("long"), times - 1)).otherwise(F.array().cast("array<long>"))
    return joined.withColumn(epoch, F.explode(repeated)).drop(*names.values())


def ordered(docs: DataFrame, target: Target = Target(), token_budget: int | None = None) -> DataFrame:
    """The mixture as an order: one row per document and epoch, with its block and its slot in the block."""
    rows, sources, digits = plan(docs, target, token_budget)
    copies = _epochs(rows, sources, target.seed, "doc_id", F.col("source_key"), "epoch")
    copies = copies.withColumn("place", place(target.seed, F.col("epoch"), F.col("doc_id")))
    total = sources.agg(F.sum("budget")).first()[0] or 0
    blocks = max(1, math.ceil(total / target.block_tokens))
    known = broadcast_if_small(sources.select("source_key", "source", "tokens", "budget"))
    at = F.col("epoch") * F.col("tokens") + F.col("before")
    # As decimals: tokens times blocks outgrow a long.
    out = _before(copies, digits).join(known, "source_key").withColumn("_at", at.cast("decimal(20,0)"))
    block = F.expr(f"least(_at * cast({blocks} as decimal(18,0)) div cast(budget as decimal(20,0)), {blocks - 1})")
    out = out.withColumn("block", F.when(F.col("budget") > 0, block).otherwise(0).cast("long"))
    shuffled = place(f"{target.seed}/block", F.col("epoch"), F.col("doc_id"))
    slot = F.row_number().over(Window.partitionBy("block").orderBy(shuffled, "doc_id", "source_key", "n_tokens")) - 1
    return out.select("doc_id", "source", "epoch", "n_tokens", "block", slot.cast("long").alias("slot"))


def mixed(docs: DataFrame, target: Target = Target(), token_budget: int | None = None) -> DataFrame:
    """The mixture itself: the rows of ``docs``, each as often as the mixture takes it, with its columns.

    The texts are not shuffled: a document finds out from its source's row (the
    last place taken) how often it goes in.
    """
    _, sources, _ = plan(docs, target, token_budget)
    epoch = fresh(docs, "_epoch")
    return _epochs(docs, sources, target.seed, "doc_id", source_key(F.col("source")), epoch).drop(epoch)
