"""Benchmark decontamination by a generalised suffix automaton of the test items.

The items' words become one automaton that accepts every run of words of any
item. A document streams through it word by word; after each word the automaton
knows the longest run of item words that ends there. Windows are read off the
states: a window that ends at this word is an ancestor of the current state.

A window is ``window`` consecutive words of an item; an item with fewer words,
but not none, is one window. A document word inside any occurrence of a window
is hit.

Defined results for odd input: a null or empty text has no words and no hits; an
item without words has no window; items with a null id give hits but do not
count as items; equal ids of several rows are one item; an empty benchmark gives
no hits. Documents may repeat and ids may be null: every row is judged on its
own. Columns other than ``doc_id`` and ``text`` pass through unread.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..staging import stage
from .words import ALNUM, fresh, hashed_words, list_column, pieces, spans, text_bytes

WINDOW = 13
# A document is contaminated when a hit word is found and hits * MIN_COVERAGE reach its words.
MIN_COVERAGE = 20
# Words of one automaton. A larger benchmark is worked off in several.
BLOCK_WORDS = 2_000_000


@dataclass
class Automaton:
    """Generalised suffix automaton over word numbers; state 0 is the empty run."""

    window: int
    vocabulary: np.ndarray  # sorted word hashes; a word's number is its place
    moves: list[dict[int, int]] = field(default_factory=lambda: [{}])
    parent: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    items: list[set[str]] = field(default_factory=list)  # whose windows a state stands for
    ends_window: list[int] = field(default_factory=list)  # nearest state up the parents, or this one, with a window
    shortest: int = 0

    @classmethod
    def of(cls, items: list[tuple[str | None, np.ndarray]], window: int) -> Automaton:
        rows = [(name, words) for name, words in items if len(words)]
        every = np.concatenate([w for _, w in rows]) if rows else np.zeros(0, np.uint64)
        self = cls(window, np.unique(every))
        numbered = [(name, np.searchsorted(self.vocabulary, w).tolist()) for name, w in rows]
        for _, words in numbered:
            last = 0
            for word in words:
                last = self._extend(last, word)
        self.items = [set() for _ in self.moves]
        marked = [False] * len(self.moves)
        for name, words in numbered:
            size = min(window, len(words))
            state = matched = 0
            for word in words:
                state, matched = self.step(state, matched, word)
                if matched >= size:
                    at = self._holding(state, size)
                    marked[at] = True
                    if name is not None:
                        self.items[at].add(name)
        # Parents are shorter, so that they come first in this order.
        self.ends_window = [-1] * len(self.moves)
        for state in sorted(range(1, len(self.moves)), key=self.length.__getitem__):
            self.ends_window[state] = state if marked[state] else self.ends_window[self.parent[state]]
        self.shortest = min((min(window, len(w)) for _, w in numbered), default=0)
        return self

    def _new(self, length: int) -> int:
        self.moves.append({})
        self.parent.append(0)
        self.length.append(length)
        return len(self.moves) - 1

    def _split(self, above: int, word: int, old: int) -> int:
        """A state of its own for the runs of ``old`` that ``above`` and ``word`` make."""
        copy = self._new(self.length[above] + 1)
        self.moves[copy] = dict(self.moves[old])
        self.parent[copy], self.parent[old] = self.parent[old], copy
        while above >= 0 and self.moves[above].get(word) == old:
            self.moves[above][word] = copy
            above = self.parent[above]
        return copy

    def _extend(self, last: int, word: int) -> int:
        there = self.moves[last].get(word)
        if there is not None:
            return there if self.length[there] == self.length[last] + 1 else self._split(last, word, there)
        new, above = self._new(self.length[last] + 1), last
        while above >= 0 and word not in self.moves[above]:
            self.moves[above][word] = new
            above = self.parent[above]
        if above >= 0:
            there = self.moves[above][word]
            self.parent[new] = there if self.length[there] == self.length[above] + 1 else self._split(above, word, there)
        return new

    def step(self, state: int, matched: int, word: int) -> tuple[int, int]:
        """State and length of the longest item run that ends with ``word``."""
        moves = self.moves
        while state and word not in moves[state]:
            state = self.parent[state]
            matched = self.length[state]
        there = moves[state].get(word)
        return (there, matched + 1) if there is not None else (0, 0)

    def _holding(self, state: int, size: int) -> int:
        """The ancestor, or the state itself, that stands for its last ``size`` words."""
        while self.length[self.parent[state]] >= size:
            state = self.parent[state]
        return state

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word, -1 for a word of no item."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def hits(self, words: list[int], found: set[str]) -> list[tuple[int, int]]:
        """Spans (first word, word after the last) that windows cover, merged; adds to ``found``."""
        out: list[tuple[int, int]] = []
        state = matched = 0
        seen: set[int] = set()
        for i, word in enumerate(words):
            state, matched = self.step(state, matched, word)
            at, widest = self.ends_window[state] if matched else -1, 0
            while at > 0:
                low = self.length[self.parent[at]] + 1
                # A state stands for runs of several lengths; its window is the one of window size or, below it, the item.
                size = self.window if low <= self.window <= self.length[at] else self.length[at]
                if size <= matched:
                    widest = max(widest, size)
                    if at not in seen:
                        seen.add(at)
                        found |= self.items[at]
                at = self.ends_window[self.parent[at]]
            if widest:
                begin, end = i + 1 - widest, i + 1
                while out and out[-1][1] >= begin:
                    begin = min(begin, out.pop()[0])
                out.append((begin, end))
        return out


def _runs(known: np.ndarray, before: np.ndarray, shortest: int) -> Iterator[tuple[int, int, int]]:
    """(row, begin, end) of the runs of known words, within one row and long enough for a window."""
    edge = np.zeros(len(known) + 1, bool)
    edge[before] = True
    start = known & (edge[:-1] | ~np.concatenate(([False], known[:-1])))
    stop = known & (edge[1:] | ~np.concatenate((known[1:], [False])))
    begins, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
    keep = ends - begins >= max(1, shortest)
    begins, ends = begins[keep], ends[keep]
    rows = np.searchsorted(before, begins, "right") - 1
    return zip(rows.tolist(), begins.tolist(), ends.tolist(), strict=True)


def _joined(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted([*a, *b]):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


@dataclass(frozen=True)
class Names:
    """Columns that a pass adds; chosen so that none of the input's has the name."""

    words: str
    begins: str
    ends: str
    items: str


def _pass(docs: DataFrame, text: str, names: Names, shared) -> DataFrame:
    """One pass of all documents through one automaton; adds to what an earlier pass has found."""
    again = names.words in docs.columns

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton: Automaton = shared.value
        for batch in pieces(batches, text):
            hashes, before = hashed_words(batch.column(text))
            numbers = automaton.numbers(hashes)
            n = batch.num_rows
            spans_: list[list[tuple[int, int]]] = [[] for _ in range(n)]
            items: list[set[str]] = [set() for _ in range(n)]
            if again:
                columns = [batch.column(c).to_pylist() for c in (names.begins, names.ends, names.items)]
                for row, (begins, ends, found) in enumerate(zip(*columns, strict=True)):
                    spans_[row], items[row] = list(zip(begins, ends, strict=True)), set(found)
            for row, begin, end in _runs(numbers >= 0, before, automaton.shortest):
                shift = begin - int(before[row])
                hit = automaton.hits(numbers[begin:end].tolist(), items[row])
                if hit:
                    spans_[row] = _joined(spans_[row], [(a + shift, b + shift) for a, b in hit])
            sizes = np.concatenate(([0], np.cumsum([len(x) for x in spans_])))
            flat = [y for x in spans_ for y in x]
            own = {names.words, names.begins, names.ends, names.items}
            columns = [c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name not in own]
            kept = [name for name in batch.schema.names if name not in own]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(np.diff(before), pa.int64()),
                 list_column(pa.array([x[0] for x in flat], pa.int64()), sizes),
                 list_column(pa.array([x[1] for x in flat], pa.int64()), sizes),
                 pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                [*kept, names.words, names.begins, names.ends, names.items])

    kept = docs.drop(names.words, names.begins, names.ends, names.items)
    schema = T.StructType(list(kept.schema.fields))
    longs = T.ArrayType(T.LongType())
    schema.add(names.words, "long").add(names.begins, longs).add(names.ends, longs).add(names.items, T.ArrayType(T.StringType()))
    return docs.mapInArrow(match, schema)


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str | None, np.ndarray]]]:
    """The benchmark's items as word hashes, in blocks of about ``block_words`` words."""
    upper = F.length("text") / 2 + 1  # no text has more words
    texts = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    total = texts.agg(F.sum(upper)).first()[0] or 0
    count = max(1, math.ceil(total / block_words))
    for k in range(count):
        rows = texts.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).collect()
        hashes, before = hashed_words(pa.array([r.text for r in rows], pa.string()))
        yield [(r.item_id, hashes[before[i]:before[i + 1]]) for i, r in enumerate(rows)]


def matched(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, Names]:
    """``docs`` with each row's word count, hit spans (in words) and items found.

    The documents are read once for each block of the benchmark and never
    shuffled. A block's automaton is what is broadcast: at most ``block_words``
    words, whatever the benchmark's size; only for a second block are the
    documents staged in between.
    """
    names = Names(*(fresh(docs, n) for n in ("_n_words", "_begins", "_ends", "_items")))
    out = docs
    for k, items in enumerate(_blocks(benchmark, block_words)):
        if k:
            out = stage(out, "decontaminated")
        shared = docs.sparkSession.sparkContext.broadcast(Automaton.of(items, window))
        out = _pass(out, "text", names, shared)
    return out, names


def _n_hit(names: Names):
    longs = F.zip_with(names.begins, names.ends, lambda b, e: e - b)
    return F.aggregate(longs, F.lit(0).cast("long"), lambda a, x: a + x)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_coverage: int = MIN_COVERAGE,
           block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: words, hit words, items found and the contamination verdict."""
    out, names = matched(docs.select("doc_id", "text"), benchmark, window, block_words)
    return out.select(
        "doc_id", F.col(names.words).alias("n_words"), _n_hit(names).alias("n_hit"),
        F.size(names.items).cast("long").alias("n_items"), F.col(names.items).alias("items"),
        F.arrays_zip(F.col(names.begins).alias("begin"), F.col(names.ends).alias("end")).alias("spans"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * min_coverage >= F.col("n_words")))


def cut_words(text: str, spans_: list[tuple[int, int]]) -> str:
    """``text`` without the words of the given spans, and without what stands between them."""
    raw = text.encode()
    starts, stops, _ = spans(*text_bytes(pa.array([text])), ALNUM)
    out, last = [], 0
    for begin, end in spans_:
        out.append(raw[last:starts[begin]])
        last = stops[end - 1]
    return b"".join([*out, raw[last:]]).decode()


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_coverage: int = MIN_COVERAGE,
          block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without contaminated documents; from the others, matched spans of ``window`` words or more are cut.

    Shorter spans (items below the window) stay: a word or two in common is no
    leak. The columns are those of ``docs``; ``n_chars``, where there is one,
    follows the text.
    """
    out, names = matched(docs, benchmark, window, block_words)
    hit = _n_hit(names)
    out = out.where(~((hit > 0) & (hit * min_coverage >= F.col(names.words))))
    schema, columns = docs.schema, docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begins, ends = batch.column(names.begins).to_pylist(), batch.column(names.ends).to_pylist()
            long = {i: [(b, e) for b, e in zip(x, y, strict=True) if e - b >= window] for i, (x, y) in enumerate(zip(begins, ends, strict=True)) if x}
            long = {i: x for i, x in long.items() if x}
            kept = batch.select(columns)
            if long:
                texts = kept.column("text").to_pylist()
                for i, x in long.items():
                    texts[i] = cut_words(texts[i], x)
                at = columns.index("text")
                arrays = kept.columns
                arrays[at] = pa.array(texts, kept.schema.field(at).type)
                if "n_chars" in columns:
                    counts = kept.column("n_chars").to_pylist()
                    for i in long:
                        counts[i] = len(texts[i])
                    at = columns.index("n_chars")
                    arrays[at] = pa.array(counts, kept.schema.field(at).type)
                kept = pa.RecordBatch.from_arrays(arrays, columns)
            yield kept

    return out.mapInArrow(cut, schema)
