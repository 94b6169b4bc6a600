"""The pipeline against a plain version of its stages, on the smallest documents and on odd rows."""

import zlib
from collections import Counter

import corpus_pipeline
from factorlab.llm import decontamination, mixing
from factorlab.llm.oracles import ORACLES
from tests.compare import connect
from tests.llm.rows import ODD, SMALL, odd
from tests.llm.test_decontamination import brute as brute_hits
from tests.llm.test_near_duplicates import brute as brute_classes
from tests.llm.rows import narrow, wide


def plain(spark, sf_dir):
    """(doc_id, text, copies) of the mixture, and the order of sharding."""
    con = connect(sf_dir)
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({ORACLES['op7_quality_rules']}) WHERE kept").fetchall()}
    rows = [r for r in con.execute("SELECT doc_id, text, source FROM documents ORDER BY doc_id").fetchall() if r[0] in kept]
    classes = brute_classes([(i, t) for i, t, _ in rows])
    rows = [r for r in rows if classes[r[0]] == r[0]]
    items = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    clean = []
    for i, text, source in rows:
        hit, _ = brute_hits(text, items)
        if hit and 20 * len(hit) >= len(narrow(text)):
            continue
        runs = []
        for p in sorted(hit):
            if runs and runs[-1][1] == p:
                runs[-1][1] = p + 1
            else:
                runs.append([p, p + 1])
        long = [(a, b) for a, b in runs if b - a >= 13]
        clean.append((i, decontamination.cut_words(text, long) if long else text, source))
    tokens = Counter()
    for _, text, source in clean:
        tokens[source] += len(wide(text))
    top, low = max(tokens.values()), min(tokens.values())
    return clean, tokens, top, low


def test_against_a_plain_version(spark):
    out = corpus_pipeline.run(spark, SMALL).collect()
    clean, tokens, top, low = plain(spark, SMALL)
    texts = {i: t for i, t, _ in clean}
    assert {r.doc_id for r in out} == set(texts) and all(texts[r.doc_id] == r.text for r in out)
    # The largest source once, the smallest up to twice, to within a document of the quota.
    spent = Counter()
    for r in out:
        spent[r.source] += len(wide(r.text))
    longest = max(len(wide(t)) for t in texts.values())
    import math
    a = max(0.0, 1 - math.log(2) / math.log(top / low))
    for source, t in tokens.items():
        assert 0 <= spent[source] - top * (t / top) ** a + 1 <= longest + 2
    # Shards: eighths of the bytes in the order of text hash and id.
    sizes = Counter()
    for r in out:
        sizes[r.shard] += r.size
        assert r.size == len(r.text.encode()) + 1 and r.text_crc32 == zlib.crc32(r.text.encode())
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r.size for r in out)
    for s in sizes:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


def test_stages_on_odd_rows(spark):
    docs = odd(spark, ODD)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert out.columns[:len(docs.columns)] == docs.columns, name
        assert name == "sharding" or out.columns == docs.columns
        assert out.count() >= 1, name


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "mixing", "sharding"]
    assert corpus_pipeline.MIXTURE == mixing.Target(entropy=None, max_repeats=2.0)
