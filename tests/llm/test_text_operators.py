"""Quality rules, license scans and the quality classifier."""

import numpy as np
import pyarrow as pa
import pytest

from factorlab.llm import licenses, quality_model, quality_rules
from tests.llm.rows import MEDIUM, ODD, narrow, odd, prose, wide


def test_rules_on_odd_rows(spark):
    texts = [*ODD, (30, "a b c a b c d\n\n  \na b c a b c d\nx", "a"), (31, prose(3, 60) + " *** ### |" * 30, "a"), (32, prose(3, 60), "a")]
    docs = odd(spark, texts)
    got = sorted(quality_rules.judged(docs).collect(), key=str)
    want = []
    for i, text, _ in texts:
        w, lines = wide(text), [x for x in (text or "").split("\n") if wide(x)]
        grams = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
        many = {g for g in grams if grams.count(g) > 1} if len(grams) < 5000 else set()
        hit = {k + j for k, g in enumerate(grams) if g in many for j in range(3)}
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        want.append((i, len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), failed))
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=str) == sorted(want, key=str)
    kept = {r.doc_id for r in got if r.kept}
    assert 32 in kept and not kept & {2, 3, 4, 31, 10}
    out = quality_rules.filtered(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == kept


def test_no_user_functions(spark):
    plan = quality_rules.judged(odd(spark, ODD))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


# Public license wording.
MIT = ("Copyright (c) 2020 A\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
       "documentation files (the \"Work\"), to deal in the software without restriction, including without limitation the rights to use, copy, "
       "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
       "to do so, subject to the following conditions: the above copyright notice and this permission notice (including the next paragraph) shall "
       "be included in all copies or substantial portions of the Software.")


def test_licenses(spark):
    texts = [*ODD, (40, MIT, "a"), (41, MIT.replace("free of charge", "for a charge"), "a"), (42, MIT.replace("(including the next paragraph) ", ""), "a"),
             (43, "the MIT-License; mit license apache  LICENSE", "a"), (44, "mit", "a"), (45, "license mit", "a"),
             (46, "Neither the name of Some Owner Ltd. nor the names of its contributors may be used to endorse or promote products derived from "
                  "this software without specific prior written permission", "a"),
             (47, "Neither the name of nor the names of its contributors", "a"),
             (48, "licensed under " * 3000 + "the Apache License, Version 2.0", "a")]
    got = {str(r.doc_id): r for r in licenses.report(odd(spark, texts)).collect()}
    assert len(got) == len({str(i) for i, _, _ in texts})
    assert (got["40"].labels, got["40"].score, got["40"].n_base) == ("mit", 1.0, 0)
    assert (got["41"].labels, got["41"].score) == ("", 0.0)
    assert got["42"].labels == "mit"
    assert (got["43"].n_base, got["43"].first_word, got["43"].last_word, got["43"].base_labels, got["43"].score) == (3, 1, 5, "apache,mit", 0.5)
    assert got["44"].n_base == got["45"].n_base == 0 and got["44"].first_word is None
    assert got["46"].labels == "bsd-3-clause" and got["47"].labels == ""
    assert got["48"].labels == "apache,apache-2.0"
    assert all(got[str(i)].n_words == len(narrow(t)) for i, t, _ in texts if i not in (None, 8))
    assert (got["2"].labels, got["2"].score, got["2"].n_words) == ("", 0.0, 0)
    out = licenses.scanned(odd(spark, texts))
    assert out.columns[-2:] == ["labels_", "score"] and out.count() == len(texts)


# Wording written out here by hand, not made from the templates.
BSD = ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n"
       "1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n"
       "2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n"
       "   and/or other materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS")
GPL = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
       "Free Software Foundation, either version 3 of the License, or (at your option) any later version.")
NAMES = [
    (60, "GNU Lesser General Public License version 2.1", "gpl,lgpl-2.1", 0.75), (61, "the GNU Affero General Public License, version 3", "agpl-3.0,gpl", 0.75),
    (62, "This is not licensed under CC BY-NC 4 0", "", 0.0), (63, "This is licensed under CC BY-NC 4.0", "cc-by-nc", 0.75),
    (64, "under the GNU General Public License, version 3.", "gpl,gpl-3.0", 0.75), (65, "a General Public License version 2", "gpl", 0.5),
    (66, GPL, "gpl,gpl-3.0", 1.0), (67, GPL.replace("General", "Lesser General"), "gpl,lgpl-3.0", 1.0), (68, GPL.replace("version 3", "version 2"), "gpl,gpl-2.0", 1.0),
    (69, BSD, "bsd,bsd-2-clause", 1.0), (70, BSD.replace("binary form must", "binary form need not"), "bsd", 0.75),
    (71, "never Released under the MIT License", "mit", 0.5), (72, MIT + ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY', "mit", 1.0),
]


def test_names_of_licenses_are_told_apart(spark):
    got = {r.doc_id: (r.labels, r.score) for r in licenses.report(odd(spark, [(i, t, "a") for i, t, _, _ in NAMES])).collect()}
    assert got == {i: (labels, score) for i, _, labels, score in NAMES}


def test_sql_of_licenses_on_the_same_names(spark, tmp_path):
    """The query's SQL, too, on wording that the tables do not hold."""
    import duckdb

    from factorlab.llm.oracles import ORACLES

    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, t, _, _ in NAMES])
    found = con.execute(f"SELECT doc_id, labels, score FROM ({ORACLES['op2_licenses']})").fetchall()
    assert {i: (labels, score) for i, labels, score in found} == {i: (labels, score) for i, _, labels, score in NAMES}


def test_unknown_markup():
    with pytest.raises(ValueError):
        licenses.Machine.of((("x", "some <<strange>> text"),))


@pytest.fixture(scope="module")
def quality(spark):
    docs, labels = (spark.read.parquet(f"{MEDIUM}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, quality_model.fitted(docs, labels)


def test_held_out_ranking(spark, quality):
    docs, labels, _ = quality
    found = quality_model.scored(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = found[found.quality == 1].score.to_numpy(), found[found.quality == 0].score.to_numpy()
    assert len(bad) and np.mean(good[:, None] > bad[None, :]) > 0.95
    assert (found.predicted == (found.score >= 0.3)).all() and (found.predicted == found.quality).mean() > 0.9


def test_scores_of_odd_rows(spark, quality):
    _, _, net = quality
    texts = [t or "" for _, t, _ in ODD]
    together = net.scores(pa.array(texts))
    alone = np.array([net.scores(pa.array([t]))[0] for t in texts])
    assert np.allclose(together, alone, atol=1e-5) and ((together >= 0) & (together <= 1)).all()


def direct(net, text):
    """The score of one text, window by window: no shared array, no neighbour."""
    raw = text.encode()
    segments = (len(raw) + quality_model.WIDTH) // quality_model.SEGMENT + 1
    data = raw + bytes(segments * quality_model.SEGMENT - len(raw))
    tops = np.full((segments, quality_model.FILTERS), -np.inf)
    for at in range(0, len(data) - quality_model.WIDTH + 1, quality_model.STEP):
        window = net.embedding[list(data[at:at + quality_model.WIDTH])].astype(np.float64).reshape(-1)
        tops[at // quality_model.SEGMENT] = np.maximum(tops[at // quality_model.SEGMENT], window @ net.filters)
    logits, first = [], 0
    while True:
        last = min(first + quality_model.CHUNK, segments)
        h = np.maximum(tops[first:last].max(axis=0) + net.bias, 0) @ net.hidden + net.hidden_bias
        logits.append(np.maximum(h, 0) @ net.out + net.out_bias[0])
        if last == segments:
            return 1 / (1 + np.exp(-np.mean(logits)))
        first += quality_model.HOP


def test_scores_equal_a_direct_convolution(quality):
    _, _, net = quality
    texts = ["", "a", "x" * 120, "y" * 127, "z" * 128, prose(4, 90), "Grüße 東京 " * 60, prose(5, 700)]
    assert np.allclose(net.scores(pa.array(texts)), [direct(net, t) for t in texts], atol=1e-5)


def test_scores_do_not_depend_on_order(quality):
    docs, _, net = quality
    texts = [r.text for r in docs.select("text").collect()]
    back = net.scores(pa.array(texts[::-1]))[::-1]
    assert np.allclose(net.scores(pa.array(texts)), back, atol=1e-5)
    alone = np.concatenate([net.scores(pa.array([t])) for t in texts[:60]])
    assert np.allclose(alone, back[:60], atol=1e-5)


def test_every_byte_is_read(quality):
    _, _, net = quality
    data, before = quality_model.padded(np.arange(1, 1000, dtype=np.int64).astype(np.uint8), np.array([0, 300, 300, 999]))
    first, last, chunks = quality_model.chunk_starts(before)
    for row in range(3):
        own = range(chunks[row], chunks[row + 1])
        assert first[own[0]] == before[row] and last[own[-1]] == before[row + 1] - 1
        assert all(first[b] == last[a] for a, b in zip(own, own[1:]))  # a segment in common


def test_no_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_model.scored(odd(spark, ODD), none).collect()} == {0.5}
