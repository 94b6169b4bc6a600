import math
import zlib
from collections import Counter

import pytest

from factorlab.llm import mixing, sharding
from tests.llm.rows import ODD, odd, prose, wide


def corpus(spark):
    return odd(spark, [*ODD, *((1000 + k, prose(k, 40), "big") for k in range(120)), *((2000 + k, prose(k, 40), "small") for k in range(12))])


def test_mixture_meets_its_target(spark):
    docs = corpus(spark)
    target = mixing.Target(entropy=None, max_repeats=3.0, block_tokens=1_000)
    rows = mixing.ordered(docs, target).collect()
    tokens = Counter()
    for r in docs.collect():
        tokens[r.source] += len(wide(r.text))
    spent = Counter()
    for r in rows:
        spent[r.source] += r.n_tokens
    repeats = {s: spent[s] / tokens[s] for s in tokens if tokens[s]}
    assert max(repeats.values()) <= 3.0 + 0.35  # a quota ends within a document
    assert min(repeats.values()) >= 1.0
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    # Slots of a block are gapless, and blocks hold about the same.
    blocks = Counter(r.block for r in rows)
    assert all(sorted(r.slot for r in rows if r.block == b) == list(range(n)) for b, n in blocks.items())
    copies = Counter((r.doc_id, r.source, r.n_tokens) for r in rows)
    mixed = mixing.mixed(docs, target)
    assert mixed.columns == docs.columns
    assert Counter((r.doc_id, r.source, len(wide(r.text))) for r in mixed.collect()) == copies


def test_exponent(spark):
    sources = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 10)], "source_key string, tokens long")

    def entropy(a):
        mass = [x ** a for x in (1000, 100, 10)]
        return -sum(m / sum(mass) * math.log(m / sum(mass)) for m in mass)

    a = mixing.exponent(sources, mixing.Target(entropy=0.9, max_repeats=None))
    assert entropy(a) >= 0.9 * math.log(3) > entropy(a + 2e-6)
    a = mixing.exponent(sources, mixing.Target(entropy=None, max_repeats=4.0))
    assert 100 ** (1 - a) == pytest.approx(4.0, rel=1e-4) and 100 ** (1 - a) <= 4.0 + 1e-9
    assert mixing.exponent(sources, mixing.Target(entropy=0.1, max_repeats=None)) == 1.0
    assert mixing.exponent(sources, mixing.Target(entropy=None, max_repeats=1e9)) == 0.0


def test_token_budget(spark):
    rows = mixing.ordered(corpus(spark), mixing.Target(entropy=1.0, max_repeats=None), token_budget=2_000).collect()
    assert 2_000 <= sum(r.n_tokens for r in rows) <= 2_000 + 5 * 30_100


def test_shards(spark):
    copies = [(5000 + k, "the same text " * 20, "a") for k in range(300)]
    docs = odd(spark, [*ODD[:6], *ODD[7:], *copies, *((1000 + k, prose(k, 30), "b") for k in range(200))])
    rows = sharding.assigned(docs, 8).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.size
    largest = max(r.size for r in rows)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 2 * largest
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in [*ODD[:6], *ODD[7:], *copies, *((1000 + k, prose(k, 30), "b") for k in range(200))])
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want

    out = sharding.laid_out(docs, 8)
    assert out.columns[:len(docs.columns)] == docs.columns and out.count() == docs.count()
    placed = Counter((r.doc_id, r["shard_"], r["slot_"]) for r in out.collect())
    assert placed == Counter((r.doc_id, r.shard, r.slot) for r in rows)


def test_overfull_ranges_are_split(spark, monkeypatch):
    monkeypatch.setattr(sharding, "DRAWS", 2)  # few draws: ranges of very different size
    keys = odd(spark, [(k, "one hot text", "a") for k in range(2000)]).select(*(c.alias(n) for n, c in sharding._keys("text", "doc_id").items()))
    found, totals = sharding.splitters(keys, 4)
    ranges = 4 * sharding.RANGES_PER_SHARD
    assert totals["bytes"].max() <= sharding.OVERFULL * totals["bytes"].sum() / ranges and totals["rows"].sum() == 2000


def test_ranges_are_sized_by_bytes(spark, monkeypatch):
    """A few long texts and many short ones: ranges follow the bytes, without a ceiling on their number."""
    monkeypatch.setattr(sharding, "RANGE_BYTES", 2_000)
    docs = odd(spark, [*((k, prose(k, 400), "a") for k in range(60)), *((1000 + k, f"short {k}", "a") for k in range(600))])
    keys = docs.select(*(c.alias(n) for n, c in sharding._keys("text", "doc_id").items()))
    found, totals = sharding.splitters(keys, 2)
    largest = keys.agg({"size": "max"}).first()[0]
    assert len(found) > 2 * sharding.RANGES_PER_SHARD and totals["rows"].sum() == 660
    assert totals["bytes"].max() <= sharding.OVERFULL * 2_000 + largest


def test_fewer_rows_than_shards(spark):
    rows = sharding.assigned(odd(spark, ODD[:3]), 8).collect()
    assert len(rows) == 3 and all(0 <= r.shard < 8 for r in rows)


@pytest.mark.parametrize("texts", [[""] * 3, [None] * 12, ["", None] * 50, [prose(k, 1)[:k % 9] for k in range(100)]])
def test_short_texts_keep_every_row_and_slot(spark, texts):
    docs = odd(spark, [(k, t, "a") for k, t in enumerate(texts)])
    total, at = sum(len(t or "") + 1 for t in texts), 0
    rows = sharding.assigned(docs, 8).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    for r in sorted(rows, key=lambda r: (r.shard, r.slot)):
        assert r.shard == at * 8 // total
        at += r.size
    out = sharding.laid_out(docs, 8)
    assert Counter((r.doc_id, r["shard_"], r["slot_"]) for r in out.collect()) == Counter((r.doc_id, r.shard, r.slot) for r in rows)
