"""Fill-in-middle transformation by secondary sort.

A text is cut into units: a word with the blanks before it, or the blanks that end
the text. Two cuts drawn from a hash of the id part it into prefix, middle and
suffix, and its form says in which order they go out. Every part leaves as pieces of
``UNITS`` whole units at most, keyed by row and place in the output.
``repartitionAndSortWithinPartitions`` brings the pieces of a row together in order, and one pass
over them assembles the output, or only digests it, holding one piece at a time. To restore a
text, the marks are looked up in the assembled stream, which gives each byte its
place in the text, and the pieces are sorted again by that.

A plain text is its own output, so only pieces of the other forms are sorted twice.
Pieces are sent deflated. A row's pieces all go to one task, as a digest has to see them
one after the other; a task's memory does not grow with a text once it is cut.

Defined results for odd input: a null text is an empty one, and plain; a null id
counts as the empty text in the hash. A text of any length is cut at units, and within a unit of
more than ``PIECE`` bytes at bytes. Texts that hold a mark are plain, so that a mark in
an output is never one of the text's own. Repeated rows (same id and text) each give
a row, of equal values; equal cuts make an empty middle. An empty table gives an
empty one. Only doc_id and text are read, so that extra columns do not matter.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
from pyspark import RDD, TaskContext
from pyspark.sql import DataFrame, functions as F

from .words import NONBLANK, spans

UNITS, PIECE = 1024, 1 << 18
PARTITION_BYTES = 1 << 26
SEED = 42
FIM_PERCENT, SPM_PERCENT = 50, 80
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
# The parts of a form in the order of its output: (mark, place of the part in the text).
ORDERS = {"psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}

_HEAD = -1  # sorts before every piece of its row
_PART = 1 << 60  # more bytes than a text has
_END = 3 * _PART


class Head(NamedTuple):
    """What a row's result holds besides its digests."""
    doc_id: int | None
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None


def unit_ends(data: np.ndarray) -> np.ndarray:
    """Byte where each unit ends: at a word's end, and at the text's end."""
    _, ends, _ = spans(data, np.array([0, len(data)]), NONBLANK)
    return np.append(ends, len(data)) if len(data) and (not len(ends) or ends[-1] < len(data)) else ends


def drawn(doc_id: int | None, seed: int = SEED) -> list[int]:
    """The first four 32-bit numbers of the id's hash."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k:k + 4], "big") for k in (0, 4, 8, 12)]


def planned(doc_id: int | None, body: bytes) -> tuple[Head, np.ndarray, list[int]]:
    """A row's head, the ends of its units with a 0 before them, and the units after which prefix and middle end."""
    ends = np.concatenate(([0], unit_ends(np.frombuffer(body, np.uint8)))).astype(np.int64)
    n = len(ends) - 1
    h = drawn(doc_id)
    cuts = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not body or any(m in body for m in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= FIM_PERCENT:
        return Head(doc_id, n, "plain", None, None), ends, cuts
    low, high = (int(ends[k]) for k in cuts)
    form = "spm" if h[3] % 100 < SPM_PERCENT else "psm"
    return Head(doc_id, n, form, len(body[:low].decode()), len(body[low:high].decode())), ends, cuts


def _chunks(body: bytes, ends: np.ndarray, first: int, last: int) -> Iterator[bytes]:
    """Units first to last (exclusive) in pieces of whole units, a long one in pieces of bytes."""
    for k in range(first, last, UNITS):
        begin, end = int(ends[k]), int(ends[min(k + UNITS, last)])
        for at in range(begin, end, PIECE):
            yield body[at:min(at + PIECE, end)]


def pieces(doc_id: int | None, body: bytes) -> Iterator[tuple[int, object]]:
    """(place, head) and (byte in the output, piece) of a row."""
    head, ends, (low, high) = planned(doc_id, body)
    yield _HEAD, head
    parts = {0: (0, low), 1: (low, high), 2: (high, head.n)}
    order = ORDERS.get(head.form, ((b"", None),))
    at = 0
    for mark, part in order:
        lead = mark
        for chunk in _chunks(body, ends, *(parts[part] if part is not None else (0, head.n))):
            yield at, zlib.compress(lead + chunk, 1)
            at += len(lead) + len(chunk)
            lead = b""
        if lead:  # an empty part still has its mark
            yield at, zlib.compress(lead, 1)
            at += len(lead)


def _keyed(rows: Iterable) -> Iterator[tuple[tuple[bytes, int], object]]:
    """Pieces keyed by (row, place). Rows of one task with the same id and text share a key, and count as often as they come."""
    task = TaskContext.get().partitionId()
    for doc_id, text in rows:
        body = (text or "").encode()
        key = hashlib.blake2b(f"{task}/{doc_id}/".encode() + hashlib.sha256(body).digest(), digest_size=16).digest()
        for place, piece in pieces(doc_id, body):
            yield (key, place), piece


def _of_row(key: tuple[bytes, int]) -> int:
    return int.from_bytes(key[0][:6], "big")


def sorted_pieces(docs: DataFrame, partitions: int | None = None) -> RDD:
    """Pieces of all rows, those of a row in one partition and in the order of its output.

    There are as many partitions as the bytes of all texts need, so that what a task sorts
    is bounded (but for a single longer text, which it streams and spills).
    """
    if partitions is None:
        held = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), held // PARTITION_BYTES)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").rdd
    return rows.mapPartitions(_keyed).repartitionAndSortWithinPartitions(partitions, _of_row)


def _rows(stream: Iterable[tuple[tuple[bytes, int], object]]) -> Iterator[tuple[bytes, int, Head, Iterator[bytes]]]:
    """(key, times, head, pieces in order) of each row of a sorted stream. The pieces are to be read before the next row."""
    stream = iter(stream)
    item = next(stream, None)
    while item is not None:
        (key, _), head = item
        times, last = 1, _HEAD
        item = next(stream, None)
        while item is not None and item[0] == (key, _HEAD):
            times += 1
            item = next(stream, None)

        def body() -> Iterator[bytes]:
            nonlocal item, last
            while item is not None and item[0][0] == key:
                (_, place), piece = item
                if place != last:  # else another copy of the row
                    last = place
                    yield zlib.decompress(piece)
                item = next(stream, None)

        out = body()
        yield key, times, head, out
        for _ in out:
            pass


def placed(chunks: Iterable[bytes], form: str) -> Iterator[tuple[int, bytes]]:
    """Bytes of an output with their places in the text (part, byte in the part): found by the marks alone."""
    marks = list(ORDERS[form])
    held, part, at = b"", None, 0
    for chunk in chunks:
        held += chunk
        while marks and (found := held.find(marks[0][0])) >= 0:
            if found:
                yield part * _PART + at, held[:found]
            held = held[found + len(marks[0][0]):]
            part, at = marks.pop(0)[1], 0
        ready = len(held) - (2 if marks else 0)  # a mark may begin in the last two bytes
        if ready > 0:
            yield part * _PART + at, held[:ready]
            at += ready
            held = held[ready:]
    if held:
        yield part * _PART + at, held


def _digested(stream: Iterable) -> Iterator[tuple[tuple[bytes, int], object]]:
    """Of each row, its output's digest at the end, and the pieces to be sorted back before it."""
    for key, times, head, chunks in _rows(stream):
        output = hashlib.sha256()

        def seen(chunks: Iterator[bytes] = chunks, output: object = output) -> Iterator[bytes]:
            for chunk in chunks:
                output.update(chunk)
                yield chunk

        if head.form == "plain":
            for _ in seen():
                pass
        else:
            for place, piece in placed(seen(), head.form):
                yield (key, place), zlib.compress(piece, 1)
        yield (key, _END), (times, head, output.hexdigest())


def _restored(stream: Iterable) -> Iterator[tuple]:
    text = hashlib.sha256()
    for (_, place), value in stream:
        if place < _END:
            text.update(zlib.decompress(value))
        else:
            times, head, output = value
            row = (*head, output, output if head.form == "plain" else text.hexdigest())
            yield from [row] * times
            text = hashlib.sha256()


def digested(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the sha256 of every row's output and of the text restored from it."""
    first = sorted_pieces(docs)
    rows = first.mapPartitions(_digested).repartitionAndSortWithinPartitions(first.getNumPartitions(), _of_row).mapPartitions(_restored)
    schema = ("doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")
    return docs.sparkSession.createDataFrame(rows, schema, verifySchema=False)


def _assembled(stream: Iterable) -> Iterator[tuple]:
    for _, times, head, chunks in _rows(stream):
        yield from [(*head, b"".join(chunks).decode())] * times


def transformed(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the output of every row."""
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return docs.sparkSession.createDataFrame(sorted_pieces(docs).mapPartitions(_assembled), schema, verifySchema=False)


def restored(output: str, form: str) -> str:
    """The text that an output of a form was made from."""
    if form == "plain":
        return output
    return b"".join(piece for _, piece in sorted(placed([output.encode()], form))).decode()
