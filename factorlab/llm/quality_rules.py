"""Quality rules: a table of thresholds compiled into Spark columns, without user functions.

Words are runs of anything but blanks. The measures of a text are counts; a rule
bounds one measure against another, so that every verdict is integer arithmetic.

Defined results for odd input: a null text has no words and fails the base
rule; an empty text likewise. Rows are judged one by one, so repeated rows,
ties and null ids change nothing, and an empty table gives an empty one.
Extra columns, whatever their names, pass through ``filtered`` unread.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .words import fresh

BLANKS = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

# Frequent function words of the corpus's languages.
STOP_WORDS = (
    "the of and to in a is that for it was on are be with as this by from at or an have not they which you but his her "
    "der die das und ist von zu den mit sich des auf für im dem nicht ein eine als auch es an werden aus er hat dass sie nach bei um "
    "le la les de des et un une du en que qui pour dans pas sur par au ce il avec sont ne se plus est être avec nous "
    "el los las del y que en un una por con no para es al lo como más su se sus pero le ya este si porque"
).split()


@dataclass(frozen=True)
class Rule:
    """Holds where ``low`` * base <= 100 * measure <= ``high`` * base; None is no bound."""

    measure: str
    base: str
    low: int | None = None
    high: int | None = None


# Bounds are hundredths: word_chars at 200..1500 means two to fifteen characters a word.
RULES = (
    Rule("word_chars", "n_words", low=200, high=1500),
    Rule("n_symbols", "n_words", high=20),
    Rule("n_stop_words", "n_words", low=2),
    Rule("n_dup_lines", "n_lines", high=50),
    Rule("n_ellipsis_lines", "n_lines", high=50),
    Rule("n_bullet_lines", "n_lines", high=90),
)

MIN_WORDS = 50
MAX_REPEATED = 50  # hundredths of the words in repeated three-word windows


def _long(column: Column) -> Column:
    return column.cast("long")


def _without(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def measures(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the measures of each text; the second value says under which names.

    A projection for each level, as later columns read earlier ones several
    times: words and lines; a number for each three-word window, hash above and
    place below, sorted so that equal windows are neighbours; the counts. Windows
    count as equal when their words are; the hash only brings them together.
    """
    names = {n: fresh(docs, n) for n in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines",
        "n_ellipsis_lines", "n_bullet_lines")}
    body, bare, words, lines, low, windows, repeated = (
        fresh(docs, f"_{n}") for n in ("body", "bare", "words", "lines", "low", "windows", "repeated"))
    gap = F.lit(BLANKS)

    out = docs.withColumn(body, F.coalesce(F.col(text), F.lit("")))
    out = out.withColumn(bare, F.trim(body, gap))
    out = out.withColumns({
        words: F.when(F.col(bare) == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP)),
        lines: F.filter(F.split(body, "\n"), lambda x: F.trim(x, gap) != ""),
    })
    w, x, m = F.col(words), F.col(lines), F.col(low)
    # As many low bits as the number of words has.
    out = out.withColumn(low, F.expr(f"shiftleft(1L, length(bin(size(`{words}`)))) - 1"))
    high = F.bitwise_not(m)
    number = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(high).bitwiseOR(i.cast("long"))
    numbers = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.coalesce(number(i), F.lit(0).cast("long")))
    out = out.withColumn(windows, F.when(F.size(w) >= 4, F.sort_array(numbers)))
    v = F.col(windows)

    def equal(one: Column, other: Column) -> Column:
        i, j = one.bitwiseAND(m).cast("int"), other.bitwiseAND(m).cast("int")
        alike = (F.get(w, i + k) == F.get(w, j + k) for k in range(3))
        return reduce(Column.__and__, alike, one.bitwiseXOR(other).bitwiseAND(high) == 0)

    found = F.filter(v, lambda one, i: equal(one, F.get(v, i - 1)) | equal(one, F.get(v, i + 1)))
    out = out.withColumn(repeated, F.transform(found, lambda one: one.bitwiseAND(m)))
    covered = F.flatten(F.transform(F.col(repeated), lambda i: F.array(i, i + 1, i + 2)))
    out = out.withColumns({
        names["n_words"]: _long(F.size(w)),
        names["word_chars"]: _long(F.length(F.translate(body, BLANKS, ""))),
        names["n_symbols"]: _long(_without(F.col(body), SYMBOLS)),
        names["n_dup_lines"]: _long(F.size(x) - F.size(F.array_distinct(x))),
        names["n_repeat_words"]: _long(F.coalesce(F.size(F.array_distinct(covered)), F.lit(0))),
        names["n_stop_words"]: _long(F.size(F.filter(w, lambda s: s.isin(*sorted(set(STOP_WORDS)))))),
        names["n_lines"]: _long(F.size(x)),
        names["n_ellipsis_lines"]: _long(F.size(F.filter(x, lambda s: F.rtrim(s, gap).endswith("...") | F.rtrim(s, gap).endswith("…")))),
        names["n_bullet_lines"]: _long(F.size(F.filter(x, lambda s: F.substring(F.ltrim(s, gap), 1, 1).isin("-", "•", "*")))),
    })
    return out.drop(body, bare, words, lines, low, windows, repeated), names


def base_failed(names: dict[str, str]) -> Column:
    n = F.col(names["n_words"])
    return (n < MIN_WORDS) | (100 * F.col(names["n_repeat_words"]) > MAX_REPEATED * n)


def compiled(rules: tuple[Rule, ...], names: dict[str, str]) -> Column:
    """All rules as one boolean column."""
    def holds(rule: Rule) -> Column:
        value, base = 100 * F.col(names[rule.measure]), F.col(names[rule.base])
        bounds = [value >= rule.low * base] if rule.low is not None else []
        bounds += [value <= rule.high * base] if rule.high is not None else []
        return reduce(Column.__and__, bounds)

    return reduce(Column.__and__, (holds(r) for r in rules), F.lit(True))


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the measures, whether the base rule fails, and whether the document is kept."""
    out, names = measures(docs.select("doc_id", "text"))
    failed = base_failed(names)
    return out.drop("text").withColumns({"base_failed": failed, "kept": ~failed & compiled(rules, names)})


def filtered(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that are kept, with its columns and no others."""
    out, names = measures(docs)
    kept, row = fresh(out, "_kept"), fresh(out, "_row")
    # A filter is not moved below a column like the row number. Else it would be written out in terms of
    # the text, each measure as often as it occurs in the rules, and in each of its own parts.
    out = out.withColumns({kept: ~base_failed(names) & compiled(rules, names), row: F.monotonically_increasing_id()})
    return out.where(F.col(kept) & (F.col(row) >= 0)).drop(kept, row, *names.values())
