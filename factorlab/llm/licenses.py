"""License scans: template markup compiled into token automata that run over whole texts.

A template is wording in which a region may be optional, ``<<beginOptional>> ...
<<endOptional>>``, or replaceable, ``<<var;name=...;min=...;max=...>>``: min to max
words of any kind. It becomes an automaton over words; a text has the label when
the automaton accepts words that stand together somewhere in it, so that all
mandatory wording is there, exactly and in order. Words are compared with A-Z
lower-cased; what stands between words does not matter.

Templates are of two kinds: ``TEXTS`` hold the wording of a license itself (its grant and, where it is short, its
conditions; for the Apache license its header), ``NOTICES`` a sentence that names one. A match does not begin
right after a word of ``DENIALS`` ("not licensed under ..."). ``score`` is 1 where a text is accepted, else
0.75 where a notice is, else 0.5 where one of the base phrases stands, else 0.

Defined results for odd input: a null or empty text has no words, no labels and
score 0. Very long texts are read whole, in one walk. Of overlapping matches each counts. Rows are judged one by one: repeated rows, ties and null ids change
nothing, and an empty table gives an empty one. Only doc_id and text are read;
``scanned`` keeps the other columns, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .words import fresh, hashed_words, pieces

# Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

_DISCLAIMER = (
    "<<beginOptional>>THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL "
    "<<var;name=holder;min=1;max=12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE<<endOptional>>")
_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions "
    "and the following disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution")
_PUBLISHED = "<<beginOptional>>as published by the Free Software Foundation; either<<endOptional>>"

# Wording of public license texts, by label.
TEXTS = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the <<var;name=word;min=1;max=2>>), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
            "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
            "copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be "
            f"included in all copies or substantial portions of the Software {_DISCLAIMER}"),
    ("isc", "Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or "
            "without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
                   "<<var;name=address;min=1;max=12>> Unless required by applicable law or agreed to in writing"),
    ("bsd-2-clause", f"{_CONDITIONS} THIS SOFTWARE IS PROVIDED"),
    ("bsd-3-clause", "Neither the name of <<var;name=owner;min=1;max=20>> nor the names of <<beginOptional>>its<<endOptional>> "
                     "<<beginOptional>>the<<endOptional>> contributors may be used to endorse or promote products derived from this software "
                     "without specific prior written permission"),
    ("gpl-2.0", f"under the terms of <<beginOptional>>version 2 of<<endOptional>> the GNU General Public License {_PUBLISHED} version 2 of the License, "
                "or (at your option) any later version"),
    ("gpl-3.0", f"under the terms of the GNU General Public License {_PUBLISHED} version 3 of the License, or (at your option) any later version"),
    ("lgpl-2.1", f"under the terms of the GNU Lesser General Public License {_PUBLISHED} version 2.1 of the License, or (at your option) any later version"),
    ("lgpl-3.0", f"under the terms of the GNU Lesser General Public License {_PUBLISHED} version 3 of the License, or (at your option) any later version"),
    ("agpl-3.0", f"under the terms of the GNU Affero General Public License {_PUBLISHED} version 3 of the License, or (at your option) any later version"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
                  "sell, or distribute this software"),
)
# Sentences that name a license, by label. GNU's name is whole, so that one license is not found in another's.
NOTICES = (
    ("mit", "Released under the <<beginOptional>>terms of the<<endOptional>> MIT License"),
    ("apache-2.0", "Licensed under the Apache License, <<beginOptional>>(the \"License\"),<<endOptional>> Version 2.0"),
    ("gpl-2.0", f"GNU General Public License {_PUBLISHED} version 2"),
    ("gpl-3.0", f"GNU General Public License {_PUBLISHED} version 3"),
    ("lgpl-2.1", f"GNU Lesser General Public License {_PUBLISHED} version 2.1"),
    ("lgpl-3.0", f"GNU Lesser General Public License {_PUBLISHED} version 3"),
    ("agpl-3.0", f"GNU Affero General Public License {_PUBLISHED} version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met"),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>creative commons attribution<<endOptional>> "
              "<<beginOptional>>CC BY<<endOptional>> 4.0"),
    ("cc-by-sa", "licensed under <<beginOptional>>a<<endOptional>> CC BY-SA <<var;name=version;min=2;max=2>>"),
    ("cc-by-nc", "licensed under <<beginOptional>>a<<endOptional>> CC BY-NC <<var;name=version;min=2;max=2>>"),
)
TEMPLATES = TEXTS + NOTICES
# Words after which a template's wording says the opposite.
DENIALS = ("not", "never")

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MARKUP = re.compile(r"<<(.*?)>>", re.S)
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ANY = -2


def words(text: str) -> list[str]:
    return _WORD.findall(text.translate(_FOLD))


@dataclass
class Machine:
    """All templates as one automaton without empty moves.

    State i is "the words of step i are next". ``steps[i]`` is the word's number, or
    ANY; ``after[i]`` are the states that taking it leads to; the end of a
    template is a state without a step.
    """

    vocabulary: dict[str, int] = field(default_factory=dict)
    steps: list[int] = field(default_factory=list)
    after: list[tuple[int, ...]] = field(default_factory=list)
    ends: dict[int, str] = field(default_factory=dict)
    notices: set[int] = field(default_factory=set)  # ends of templates that only name a license
    starts: dict[int, tuple[int, ...]] = field(default_factory=dict)  # by the first word's number

    @classmethod
    def of(cls, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> Machine:
        self = cls()
        openings: list[int] = []
        for label, markup in templates:
            tokens = self._tokens(markup)
            first = len(self.steps)
            skips = {i: set() for i in range(len(tokens) + 1)}
            for begin, end in self._skipped(tokens):
                skips[begin].add(end)
            reach = self._closure(skips, len(tokens))
            place: dict[int, int] = {}
            for i, token in enumerate(tokens):
                if isinstance(token, int):
                    place[i] = len(self.steps)
                    self.steps.append(token)
                    self.after.append(())
            end = len(self.steps)
            self.steps.append(-3)
            self.after.append(())
            self.ends[end] = label
            if (label, markup) in NOTICES:
                self.notices.add(end)
            place[len(tokens)] = end
            solid = lambda i: tuple(sorted(place[j] for j in reach[i] if j in place))
            for i, token in enumerate(tokens):
                if isinstance(token, int):
                    self.after[place[i]] = solid(i + 1)
            openings += solid(0)
            if any(s in self.ends or self.steps[s] == ANY for s in solid(0)):
                raise ValueError(f"a template of {label} does not begin with a word of its own: step {first}")
        begun: dict[int, list[int]] = {}
        for s in openings:
            begun.setdefault(self.steps[s], []).append(s)
        self.starts = {word: tuple(s) for word, s in begun.items()}
        return self

    def _tokens(self, markup: str) -> list:
        """Word numbers, ANY, and the marks "(", ")" of optional regions."""
        out: list = []
        at = 0
        for mark in [*_MARKUP.finditer(markup), None]:
            text = markup[at:mark.start()] if mark else markup[at:]
            out += [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]
            if mark is None:
                break
            at, kind = mark.end(), mark[1].split(";")
            if kind[0] == "beginOptional":
                out.append("(")
            elif kind[0] == "endOptional":
                out.append(")")
            elif kind[0] == "var":
                bounds = dict(x.split("=", 1) for x in kind[1:])
                least, most = int(bounds.get("min", 1)), int(bounds.get("max", 1))
                out += [ANY] * least + ["(", ANY] * (most - least) + [")"] * (most - least)
            else:
                raise ValueError(f"unknown markup {mark[0]}")
        return out

    @staticmethod
    def _skipped(tokens: list) -> list[tuple[int, int]]:
        """(place, place) pairs of empty moves: over marks, and over whole optional regions."""
        out, open_ = [], []
        for i, token in enumerate(tokens):
            if token == "(":
                open_.append(i)
                out.append((i, i + 1))
            elif token == ")":
                out += [(open_.pop(), i + 1), (i, i + 1)]
        return out

    @staticmethod
    def _closure(skips: dict[int, set[int]], size: int) -> dict[int, set[int]]:
        reach: dict[int, set[int]] = {}
        for i in range(size, -1, -1):  # empty moves lead forward only
            reach[i] = {i}.union(*(reach[j] for j in skips[i]))
        return reach

    def accepted(self, numbers: list[int], begins: list[int]) -> tuple[set[str], list[tuple[int, int, str]], bool]:
        """Labels of all templates that words of the text satisfy, where, and whether one is a text; ``begins``: places of possible first words.

        One walk over the words from the first such place: all attempts run
        side by side, so that a word costs at most the number of states.
        """
        labels: set[str] = set()
        places: list[tuple[int, int, str]] = []
        whole = False
        k, i = 0, 0
        active: dict[int, int] = {}  # state: where its attempt began, the latest if several
        while k < len(begins) or active:
            if not active:
                i = max(i, begins[k])
            word = numbers[i] if i < len(numbers) else -3
            if i >= len(numbers):
                break
            if k < len(begins) and begins[k] == i:
                for s in self.starts.get(word, ()):
                    active[s] = i
                k += 1
            following: dict[int, int] = {}
            for s, begun in active.items():
                if self.steps[s] == word or self.steps[s] == ANY:
                    for t in self.after[s]:
                        if t in self.ends:
                            labels.add(self.ends[t])
                            whole |= t not in self.notices
                            places.append((begun, i + 1, self.ends[t]))
                        elif following.get(t, -1) < begun:
                            following[t] = begun
            active = following
            i += 1
        return labels, places, whole


def _scan(docs: DataFrame, text: str, names: dict[str, str], templates=TEMPLATES) -> DataFrame:
    machine = Machine.of(templates)
    phrases = [(words(phrase), label) for phrase, label in BASE]
    for phrase, _ in phrases:
        for w in phrase:
            machine.vocabulary.setdefault(w, len(machine.vocabulary))
    denials = [machine.vocabulary.setdefault(w, len(machine.vocabulary)) for w in DENIALS]
    coded = [([machine.vocabulary[w] for w in phrase], label) for phrase, label in phrases]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = list(machine.vocabulary)
        hashes = hashed_words(pa.array(known))[0]
        order = np.argsort(hashes)
        ordered = hashes[order]
        opening = np.zeros(len(known) + 1, bool)
        opening[list(machine.starts)] = True
        for batch in pieces(batches, text):
            found, before = hashed_words(batch.column(text))
            at = np.minimum(np.searchsorted(ordered, found), len(known) - 1)
            numbers = np.where(ordered[at] == found, order[at], -1)
            n = batch.num_rows
            out: dict[str, list] = {k: [None] * n for k in names}
            out["n_words"] = np.diff(before).tolist()
            out["n_base"] = [0] * n
            base: list[list[tuple[int, str]]] = [[] for _ in range(n)]
            edge = before[1:]
            for phrase, label in coded:
                hit = np.ones(max(0, len(numbers) - len(phrase) + 1), bool)
                for j, word in enumerate(phrase):
                    hit &= numbers[j:len(hit) + j] == word
                for p in np.flatnonzero(hit).tolist():
                    row = int(np.searchsorted(before, p, "right")) - 1
                    if p + len(phrase) <= edge[row]:
                        base[row].append((p - int(before[row]), label))
            starts = np.flatnonzero(opening[numbers])
            denied = np.isin(numbers[starts - 1], denials) & ~np.isin(starts, before)
            starts = starts[~denied]
            cut = np.searchsorted(starts, before)
            for row in range(n):
                labels, whole = set(), False
                if cut[row] < cut[row + 1]:
                    own = numbers[before[row]:before[row + 1]].tolist()
                    labels, places, whole = machine.accepted(own, (starts[cut[row]:cut[row + 1]] - before[row]).tolist())
                    out["places"][row] = [{"begin": b, "end": e, "label": x} for b, e, x in sorted(places)]
                out["places"][row] = out["places"][row] or []
                own_base = {label for _, label in base[row]}
                if base[row]:
                    out["n_base"][row] = len(base[row])
                    out["first_word"][row] = min(p for p, _ in base[row])
                    out["last_word"][row] = max(p for p, _ in base[row])
                out["base_labels"][row] = ",".join(sorted(own_base))
                out["labels"][row] = ",".join(sorted(own_base | labels))
                out["score"][row] = 1.0 if whole else 0.75 if labels else 0.5 if own_base else 0.0
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))]
            added = [pa.array(out[k], kind) for k, kind in zip(names, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *names.values()])

    schema = T.StructType(list(docs.schema.fields))
    place = T.ArrayType(T.StructType().add("begin", "long").add("end", "long").add("label", "string"))
    for name, kind in zip(names.values(), ["long"] * 4 + ["string"] * 2 + ["double", place], strict=True):
        schema.add(name, kind)
    return docs.mapInArrow(scan, schema)


COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places")


def report(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """One row per document: base places, labels and score, and the places (in words) where templates were accepted."""
    out = _scan(docs.select("doc_id", "text"), "text", {n: n for n in COLUMNS}, templates)
    return out.drop("text")


def scanned(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """``docs`` with its columns and the labels; a new column's name is lengthened where ``docs`` has it."""
    names = {n: fresh(docs, n) for n in COLUMNS}
    return _scan(docs, "text", names, templates).drop(*(names[n] for n in COLUMNS if n not in ("labels", "score")))
