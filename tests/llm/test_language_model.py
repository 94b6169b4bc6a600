import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from factorlab.llm import language_model as lm
from tests.llm.rows import FOLD, MEDIUM, ODD, odd, wide


def check(rows, got):
    tokens = [(i, [*(w for w in wide((t or "").translate(FOLD))), None]) for i, t in rows]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter(w for i, ws in tokens if not held(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), held(i), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 4)) for i, ws in tokens)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want


def test_documents(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    got = lm.scored(docs).collect()
    check([(r.doc_id, r.text) for r in docs.collect()], got)
    held = [r for r in got if r.held_out]
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens)) for r in got)


def test_odd_rows(spark):
    got = lm.scored(odd(spark, ODD)).collect()
    check([(i, t) for i, t, _ in ODD], got)
    by_text = {}
    for (i, t, _), r in zip(sorted(ODD, key=lambda x: str(x[0])), sorted(got, key=lambda r: str(r.doc_id)), strict=True):
        if i is not None:
            by_text.setdefault(" ".join(wide((t or "").translate(FOLD))), set()).add(round(r.score, 9))
    assert all(len(s) == 1 for s in by_text.values())  # equal words, equal score


def test_slots_do_not_change_scores(spark, monkeypatch):
    docs = odd(spark, [(i, t, s) for i, t, s in ODD if i is not None])
    monkeypatch.setattr(lm, "CHUNK_BYTES", 20_000)
    whole = sorted((r.doc_id, round(r.score, 3)) for r in lm.scored(docs).collect())
    monkeypatch.setattr(lm, "SLOT_CHUNKS", 1)
    assert sorted((r.doc_id, round(r.score, 3)) for r in lm.scored(docs).collect()) == whole


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tabZé東", max_size=12), max_size=6))
def test_symbols_and_grams(texts):
    text, predicted, offsets = lm.symbols(pa.array(texts, pa.string()))
    plain = [" ".join([*wide(t.translate(FOLD)), ""]).encode() + b"\n" for t in texts]
    assert bytes(text) == b"".join(b" " * 6 + t for t in plain)
    assert bytes(text[predicted]) == b"".join(plain) and np.diff(offsets).tolist() == [len(t) for t in plain]
    want = [int.from_bytes((b" " * 6 + t)[k:k + 7], "big") for t in plain for k in range(len(t))]
    assert lm.grams(text, predicted).tolist() == want


def model_of(spark, texts, groups=3):
    text, predicted, _ = lm.symbols(pa.array(texts))
    grams, n = np.unique(lm.grams(text, predicted), return_counts=True)
    of = lm.groups_of(grams, groups)
    rows = []
    for g in np.unique(of):  # two rows for each group, as two slots would give
        own, counts = grams[of == g], n[of == g]
        rows += [(int(g), bytearray(lm._rising(own)), bytearray(lm._packed(counts // 2))), (int(g), bytearray(lm._rising(own)), bytearray(lm._packed(counts - counts // 2)))]
    state, upper = lm.trained(spark.createDataFrame(rows, "group int, grams binary, counts binary"))
    found = {r.group: r.asDict(recursive=True) for r in state.collect()}

    def log10(keys):
        g = lm.groups_of(keys, groups)
        out = np.empty(len(keys))
        for k in np.unique(g):
            out[g == k] = lm.Model(found.get(int(k)), upper).log10(keys[g == k])
        return out

    return log10, found, upper


CORPUS = ["the cat sat on the mat", "", "the hat", "the cat sat on the hat " * 40]


def test_probabilities_sum_to_one(spark):
    text, places, offsets = lm.symbols(pa.array(CORPUS[:3]))
    assert bytes(text[places]) == b"the cat sat on the mat \n\nthe hat \n" and offsets.tolist() == [0, 24, 25, 34]
    log10, _, _ = model_of(spark, CORPUS)
    for context in (b"      ", b"e cat ", b"cat sa", b"zzzzzz", b"zx the", b"at\n   ", b"n the "):
        after = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], np.int64)
        assert np.sum(10 ** log10(after)) == pytest.approx(1.0, abs=1e-5)


def test_scores_equal_a_plain_recursion(spark):
    """Probabilities from the kept seatings, restaurant by restaurant, in dictionaries."""
    log10, found, upper = model_of(spark, CORPUS)
    states = []
    for k in range(lm.SAMPLES):
        rooms = {}
        for row in found.values():
            for room in lm._rooms_of(row, row["kept"][k])[0]:
                for dish, c, t in zip(room.dishes.tolist(), room.customers.tolist(), room.tables.tolist()):
                    assert 1 <= t <= c
                    rooms.setdefault((room.length, dish >> 8), {})[dish & 255] = (c, t)
        states.append(rooms)

    def probability(rooms, k, gram, length):
        if length < 2:
            return upper[gram & 0xFFFF, k]
        below = probability(rooms, k, gram & ((1 << 8 * length) - 1), length - 1)
        room = rooms.get((length, gram >> 8))
        if room is None:
            return below
        d, s = lm.DISCOUNT[length], lm.STRENGTH[length]
        c, t = room.get(gram & 255, (0, 0))
        total, tables = sum(x for x, _ in room.values()), sum(x for _, x in room.values())
        return (max(c - d * t, 0) + (s + d * tables) * below) / (s + total)

    text, predicted, _ = lm.symbols(pa.array([*CORPUS[:3], "a dog sat on the cat 東"]))
    keys = lm.grams(text, predicted)
    want = [math.log10(np.mean([probability(rooms, k, g, 6) for k, rooms in enumerate(states)])) for g in keys.tolist()]
    assert np.allclose(log10(keys), want, atol=1e-9)


def test_packing():
    for numbers in ([], [0], [5, 5, 9, 1 << 55], list(range(0, 9000, 3))):
        a = np.array(numbers, np.int64)
        assert lm._unpacked(lm._packed(a)).tolist() == numbers and lm._risen(lm._rising(a)).tolist() == numbers


def test_number_of_tables_follows_its_distribution():
    """Draws for four customers against the exact weights of 1 to 4 tables."""
    n, d, s, base, others = 40_000, 0.5, 1.0, 0.3, 2
    drawn = lm.seated(np.full(n, 4), np.full(n, others), np.full(n, base), d, s, np.random.default_rng(0))
    stirling = {1: (1 - d) * (2 - d) * (3 - d), 4: 1.0, 3: 6 - 6 * d}
    stirling[2] = (1 - d) * (2 - d) + (3 - 2 * d) * ((1 - d) + (2 - 2 * d))
    weight = [stirling[t] * base ** t * math.prod(s + d * (others + i) for i in range(t)) for t in range(1, 5)]
    want = np.array(weight) / sum(weight)
    assert np.allclose(np.bincount(drawn, minlength=5)[1:] / n, want, atol=0.01)
    many = lm.seated(np.array([10_000]), np.array([0]), np.array([0.5]), d, s, np.random.default_rng(0))
    assert 1 < many[0] < 10_000


def test_contexts_reach_back_six_bytes():
    text, places, offsets = lm.symbols(pa.array(["a12345x", "b12345x"]))
    keys = lm.grams(text, places)
    assert keys[offsets[0] + 6] != keys[offsets[1] + 6]  # of x, after texts that differ six bytes before it


def peak(call, *args):
    tracemalloc.start()
    try:
        return call(*args), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_chunk_is_worked_on_in_bounded_memory():
    """Nine bytes for each of its symbols, besides what a turn of PART_BYTES and the different grams take."""
    rng = np.random.default_rng(0)
    words = ["".join(w) for w in rng.choice(list("abcdeé"), (300, 5))]
    texts = pa.array([" ".join(rng.choice(words, 5000)) for _ in range(500)], pa.string())
    size = len(lm.text_bytes(texts)[0])
    (keys, n), most = peak(lm.chunk_grams, texts, np.ones(len(texts), bool))
    assert most < 9 * size + 64 * lm.PART_BYTES and n.sum() == sum(len(lm.grams(*lm.symbols(part)[:2])) for part in lm._parts(texts))
    of = lm.groups_of(keys, 7)
    answers = np.log10(n / n.sum()).astype(np.float32)
    got, most = peak(lm.gram_scores, texts, answers[np.argsort(of, kind="stable")], 7)
    assert most < 9 * size + 64 * lm.PART_BYTES
    for k in (0, 57, 499):
        own = lm.grams(*lm.symbols(texts[k:k + 1])[:2])
        assert got[k] == pytest.approx(answers[np.searchsorted(keys, own)].astype(np.float64).sum())


def test_chunks_are_staged_deflated(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text")
    given = [(r.doc_id, r.doc_id % 3 == 0, r.text or "") for r in docs.collect()]
    rows = lm.chunked(docs, docs.doc_id % 3 == 0).toArrow()
    opened = [x for cell in rows.column("docs") for x in zip(*(c.to_pylist() for c in lm._opened(cell).columns), strict=True)]
    assert sorted(opened) == sorted(given)
    assert sum(len(cell.as_buffer()) for cell in rows.column("docs")) < 0.6 * sum(len(t.encode()) for _, _, t in given)
