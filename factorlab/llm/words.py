"""Words of text batches as numpy arrays, and small helpers the operators share."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

# Text bytes worked on at once: the arrays below take some 40 bytes for each.
PIECE_BYTES = 4 << 20

# Bytes of a word in the narrow sense: digits, letters, everything outside ASCII.
ALNUM = np.array([0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
# Bytes of a word in the wide sense: everything but blanks.
NONBLANK = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column back to back, and the rows' offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut between rows so that each holds about ``size`` bytes of text, one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = text_bytes(batch.column(text))
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[begin] + size, "right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end


@lru_cache(4)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits, one to one."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def spans(data: np.ndarray, offsets: np.ndarray, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of each word, and for each row the number of words before it (one entry more than rows)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = alphabet[data]
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    # A word does not run on into the next row.
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] = inside[1:-1][first]
    ends[first[1:] - 1] = inside[1:-1][first[1:] - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of ``data``; equal for equal bytes, wherever they stand."""
    size = 1 << max(16, (len(data) - 1).bit_length())
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * _powers(_BASE, size)[:len(data)], out=sums[1:])
    h = (sums[stops] - sums[starts]) * _powers(_INVERSE, size)[starts]
    return mix(h + (stops - starts).astype(np.uint64))


def hashed_words(column: pa.Array, alphabet: np.ndarray = ALNUM) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of a string column, A-Z lower-cased, and the number of words before each row."""
    data, offsets = text_bytes(column)
    starts, stops, before = spans(data, offsets, alphabet)
    return span_hashes(LOWER[data], starts, stops), before


def list_column(values: pa.Array, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
