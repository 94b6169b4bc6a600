import pytest

from factorlab.llm import decontamination as dc
from tests.llm.rows import ODD, narrow, odd, prose

ITEM = prose(5, 40)
SHORT = "alpha beta gamma"


def brute(text, items, window=13):
    """(hit words, items found), by looking for every window everywhere."""
    words, hit, found = narrow(text), set(), set()
    for name, body in items:
        own = narrow(body)
        n = min(window, len(own))
        for s in range(len(own) - n + 1) if n else ():
            for p in range(len(words) - n + 1):
                if words[p:p + n] == own[s:s + n]:
                    hit |= set(range(p, p + n))
                    found |= {str(name)} if name is not None else set()
    return hit, found


ITEMS = [(1, ITEM), (2, SHORT), (3, None), (4, ""), (5, "gamma"), (None, "delta epsilon"), (6, ITEM), (7, "beta gamma delta"),
         (8, " ".join(["na"] * 15)), (9, "na na")]
TEXTS = [*ODD, (20, f"x {ITEM} y", "a"), (21, "Alpha, BETA; gamma! delta epsilon", "a"), (22, "na " * 40, "a"),
         (23, " ".join(ITEM.split()[3:20]) + " alpha beta " + SHORT, "a"), (24, prose(6, 3000) + " " + ITEM[:200], "a")]


@pytest.mark.parametrize("block_words", [2_000_000, 30])
def test_against_brute_force(spark, block_words):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = dc.report(odd(spark, TEXTS), items, block_words=block_words).collect()
    assert len(got) == len(TEXTS)
    want = []
    for i, text, _ in TEXTS:
        hit, found = brute(text, ITEMS) if text is None or len(text) < 50_000 else (set(), set())
        n = len(narrow(text))
        want.append((i, n, len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= n))
    key = lambda r: str(r)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, sorted(r["items"]), r.contaminated) for r in got), key=key) == sorted(want, key=key)


def test_clean_drops_and_cuts(spark):
    body = prose(6, 3000)
    docs = odd(spark, [(1, f"{ITEM} tail", "a"), (2, f"{body}. {ITEM}! {body}", "a"), (3, body, "a"), (4, None, "a"), (5, f"{body} {SHORT}", "a")])
    items = spark.createDataFrame([(1, ITEM), (2, SHORT)], "item_id long, text string")
    out = dc.clean(docs, items)
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == {2, 3, 4, 5}
    assert got[2].text == f"{body}. ! {body}" and got[2].n_chars == len(got[2].text)
    assert got[3].text == body and got[4].text is None and got[5].text == f"{body} {SHORT}"


def test_empty_benchmark(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = odd(spark, ODD)
    assert dc.report(docs, none).where("n_hit > 0 or contaminated").count() == 0
    assert dc.clean(docs, none).count() == len(ODD)
