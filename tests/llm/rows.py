"""Small tables of odd rows, and plain restatements of definitions, for the tests of this folder."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NARROW = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WIDE = re.compile(r"[^\x20\x09-\x0D]+")

# Extra columns of the names that operators use themselves.
CLASHES = "n_words string, kept string, shard string, slot string, size string, labels string, _text_key string, _range string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"


def narrow(text: str | None) -> list[str]:
    return NARROW.findall((text or "").translate(FOLD))


def wide(text: str | None) -> list[str]:
    return WIDE.findall(text or "")


def prose(k: int, n: int) -> str:
    """``n`` words of which no five in a row come twice, different for every ``k``."""
    return " ".join(f"the word{k}x{i} of" if i % 2 else f"a{k}thing{i} and" for i in range(n // 2 + 1))


def odd(spark: SparkSession, texts: list[tuple]) -> DataFrame:
    """documents of (doc_id, text, source), with extra columns that clash."""
    rows = [(i, t, "en", s, len(t or ""), *["x"] * 8) for i, t, s in texts]
    return spark.createDataFrame(rows, SCHEMA)


LONG = prose(99, 30_000)
ODD = [
    (1, prose(1, 80), "a"), (2, None, "a"), (3, "", None), (4, "   \n\t ", "b"), (5, "!?! ...", "b"), (6, "one", None),
    (7, LONG, "a"), (8, prose(1, 80), "a"), (8, prose(1, 80), "a"), (None, prose(2, 60), None), (None, None, "c"),
    (9, "Grüße ÄÖ naïve 東京 \x00 end", "c"), (10, "same same " * 400, "a"),
]
