import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from factorlab.llm import token_files as tf
from tests.llm.rows import LONG, ODD, SMALL, odd

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("top", [1, 255, 256, 70_000, 1 << 31])
def test_codes_give_any_id(top):
    rng = np.random.default_rng(top)
    ids = (rng.random(5_000) ** 4 * (top + 1)).astype(np.uint32)
    starts = np.array([0, 0, 1, 700, 5_000])
    file = tf.TokenFile(tf.encoded(np.array([3, 4, 5, 6]), np.zeros(4), starts, ids))
    assert (file.tokens(0, 5_000) == ids).all() and (file.document(2) == ids[1:700]).all() and len(file.document(0)) == 0
    assert [file.token(i) for i in range(0, 5_000, 37)] == ids[::37].tolist()
    for begin in (0, 1, 511, 512, 513, 4_999):
        assert (file.tokens(begin, min(begin + 600, 5_000)) == ids[begin:begin + 600]).all()
    with pytest.raises(IndexError):
        file.token(5_000)


def expected(rows):
    tokenizer, start, out = Tokenizer.from_file(PATH), 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, tf.END_ID]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = sorted(tuple(r) for r in tf.round_trip(docs, PATH).collect())
    assert got == expected([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows_in_small_files(spark, tmp_path):
    blanks = ["a\u00a0 b", "a \u00a0b", "x  y   z", " lead", "trail ", "a \u2003 b", "\u3000 c", "it's  <|endoftext|> so", "tab\t x", "é è", "\x1c d", "a \x85b", "\ud7ff \ue000"]
    texts = [*ODD, *((50 + k, t, "a") for k, t in enumerate(blanks))]
    docs = odd(spark, texts)
    manifest = tf.stage(tf.write(docs, f"file://{tmp_path}/tokens", PATH, file_ids=40), "manifest")
    assert manifest.count() >= 1 and manifest.agg({"n_docs": "sum"}).first()[0] == len(texts)
    got = sorted((tuple(r) for r in tf.read(spark, f"file://{tmp_path}/tokens", manifest).collect()), key=lambda r: r[1])
    assert got == expected([(i, t) for i, t, _ in texts])
    assert max(r[2] for r in got) > len(LONG.split())


def test_rows_without_ids_spread(spark):
    rows = spark.range(0, 100_000, 1, 8).selectExpr("CAST(NULL AS long) AS doc_id", "concat('text ', id * 7919 % 100003) AS text")
    found = tf.in_order(rows.unionByName(rows.limit(5).selectExpr("CAST(3 AS long) AS doc_id", "text")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows become one task again
    try:
        sizes = found.selectExpr("spark_partition_id() AS p", "doc_id", "text").toPandas()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sizes.groupby("p").size().max() < 60_000
    assert sizes["text"].tolist()[:100_000] == sorted(sizes["text"].tolist()[:100_000]) and sizes["doc_id"].notna().sum() == 5
