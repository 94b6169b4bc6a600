from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from factorlab.llm import near_duplicates as nd
from tests.llm.rows import LONG, MEDIUM, ODD, narrow, odd, prose


def brute(rows):
    """Classes by comparing the sets of five-word shingles of all pairs."""
    shingles = {}
    for i, text in rows:
        w = narrow(text)
        shingles[i] = frozenset(tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset([text or ""])
    holders, root = defaultdict(set), {i: i for i in shingles}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in shingles.items():
        for j in set().union(*(holders[g] for g in s)):
            common = len(s & shingles[j])
            if common >= 0.8 * (len(s) + len(shingles[j]) - common) - 1e-9:
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for g in s:
            holders[g].add(i)
    return {i: find(i) for i in shingles}


def test_documents_against_all_pairs(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    want = brute(sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()))
    assert {r.doc_id: r.class_id for r in nd.classes(docs).collect()} == want


def edited(text, k, step):
    words = text.split()
    return " ".join(f"new{k}{i}" if i % step == k % step and i else w for i, w in enumerate(words))


def test_odd_rows_and_a_large_group(spark):
    base, shared = prose(7, 400), prose(8, 120)
    near = [(100 + k, edited(base, k, 150), "a") for k in range(40)]  # some two edits of 400 words
    passage = [(200 + k, f"{shared} {prose(300 + k, 150)}", "a") for k in range(60)]  # a passage in common, no more
    docs = odd(spark, [*ODD, *near, *passage, (300, LONG + " end", "a")])
    got = defaultdict(list)
    for r in nd.classes(docs).collect():
        got[r.class_id].append(r.doc_id)
    assert sorted(got[100]) == [k for k, _, _ in near]
    assert all(got[k] == [k] for k, _, _ in passage)
    assert sorted(got[1]) == [1, 8, 8] and sorted(got[7]) == [7, 300]
    assert got[2] == [2, 3, None] or sorted(map(str, got[2])) == ["2", "3", "None"]  # empty, like null
    assert got[4] == [4] and got[5] == [5] and got[None] == [None] and got[10] == [10]

    kept = nd.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, got))


@pytest.mark.parametrize("seed", range(5))
def test_alignment_is_the_longest_common_subsequence(seed):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 50, 60).astype(np.uint32)
    b = np.delete(a, rng.integers(0, 60, 2))
    b[rng.integers(0, len(b), 2)] = 99
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    m = table[-1, -1]
    assert nd.aligned(a, b) == pytest.approx(m / (len(a) + len(b) - m))


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(50, 60), (60, 70), (50, 80)]
    got = nd.components(spark.createDataFrame(chain, "a int, b int")).collect()
    assert {r.node: r.root for r in got} == {**{i: 1 for i in range(1, 41)}, 50: 50, 60: 50, 70: 50, 80: 50}


def all_pairs(texts):
    """Classes (sorted lists of places) by aligning all pairs."""
    kmers, offsets = nd.kmer_sequences(pa.array(texts))
    k = [kmers[a:b].astype(np.uint32) for a, b in zip(offsets, offsets[1:])]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and nd.aligned(k[i], k[j]) >= nd.SIMILARITY:
                root = [root[j] if r == root[i] else r for r in root]
    return sorted([i for i in range(len(texts)) if root[i] == r] for r in set(root))


def found(spark, texts):
    got = defaultdict(list)
    for r in nd.classes(odd(spark, [(k, t, "a") for k, t in enumerate(texts)])).collect():
        got[r.class_id].append(r.doc_id)
    return sorted(sorted(x) for x in got.values())


def changed(text, seed, edits):
    words = text.split()
    for i in np.random.default_rng(seed).choice(len(words), edits, replace=False):
        words[i] = f"new{seed}w{i}"
    return " ".join(words)


def test_a_text_above_095_with_the_centre_keeps_its_links(spark):
    # Copies of one edit that are just below 0.8 with the text that all others are edits of.
    base = prose(11, 300)
    one = [changed(base, k, 1) for k in range(10)]
    texts = [base, *one, *(changed(x, 50 + 10 * k + j, 6) for k, x in enumerate(one) for j in range(4))]
    assert found(spark, texts) == all_pairs(texts)


@pytest.mark.parametrize("block", [1024, 16])
def test_a_large_group_below_the_threshold_loses_no_link(spark, monkeypatch, block):
    # More than 24 copies share the edits that set them apart from others; few are at 0.8 with each other.
    monkeypatch.setattr(nd, "BLOCK", block)
    base = prose(12, 300)
    far = [changed(base, 200 + k, 6 + k % 9) for k in range(60)]
    texts = [*far, *(changed(x, 400 + k, 4) for k, x in enumerate(far[:30]))]
    want = all_pairs(texts)
    assert len(want) > 10 and found(spark, texts) == want


def test_what_texts_have_in_common():
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 40, n).astype(np.uint32) for n in rng.integers(5, 60, 50)]
    got = nd.in_common(texts)
    for i in range(50):
        for j in range(i):
            assert got[i, j] == sum(min((texts[i] == v).sum(), (texts[j] == v).sum()) for v in range(40))
