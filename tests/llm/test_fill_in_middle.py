"""Fill-in-middle outputs against a restatement on whole strings, and round trips."""

import hashlib
import re

from hypothesis import given, settings, strategies as st

from factorlab.llm import fill_in_middle as fim
from tests.llm.rows import LONG, ODD, odd, prose

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plainly(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[k:k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [*ODD, *((100 + k, prose(k, 40) + " \n" * (k % 3), "a") for k in range(60)), (200, "x" * 900_000, "a"), (201, "é" * 600_000 + " b", "a"),
         (202, "a <P> b", "a"), (203, " lead  and trail ", "a"), (204, "a b c", "a"), (205, LONG * 3, "a"), (206, "< P><M ><<S", "a"), (207, "<" * 3000, "a")]


def test_outputs_and_digests(spark):
    docs = odd(spark, TEXTS)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted(((i, *plainly(i, t)) for i, t, _ in TEXTS), key=str)
    got = sorted(map(tuple, fim.transformed(docs).collect()), key=str)
    assert got == want and {w[2] for w in want} == {"plain", "psm", "spm"}
    digests = sorted(map(tuple, fim.digested(docs).collect()), key=str)
    assert digests == sorted(((i, *plainly(i, t)[:4], sha(plainly(i, t)[4]), sha(t or "")) for i, t, _ in TEXTS), key=str)
    assert all(fim.restored(output, form) == text for (_, _, form, _, _, output), text in zip(want, [t or "" for _, t, _ in sorted(
        TEXTS, key=lambda x: str((x[0], *plainly(x[0], x[1]))))], strict=True))


def test_copies_of_one_row(spark):
    docs = spark.range(0, 30_000, 1, 8).selectExpr("CAST(NULL AS long) AS doc_id", f"'{prose(5, 30)}' AS text")
    found = fim.digested(docs).groupBy("doc_id", "form", "output_sha256", "restored_sha256").count().collect()
    assert len(found) == 1 and found[0]["count"] == 30_000


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=" \n\tab<>PSMé東", max_size=60), st.integers(0, 5000), st.integers(1, 9))
def test_marks_are_found_wherever_pieces_end(text, doc_id, size):
    n, form, _, _, output = plainly(doc_id, text)
    head, ends, _ = fim.planned(doc_id, text.encode())
    assert (head.n, head.form) == (n, form) and [text.encode()[a:b].decode() for a, b in zip(ends, ends[1:])] == UNIT.findall(text)
    if form != "plain":
        raw = output.encode()
        chunks = [raw[k:k + size] for k in range(0, len(raw), size)]
        assert b"".join(p for _, p in sorted(fim.placed(chunks, form))).decode() == text
