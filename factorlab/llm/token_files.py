"""Token ids in binary files with directly addressable codes.

An id is cut into chunks of eight bits, lowest first. Level 0 holds the first
chunk of every id; a bitmap beside it says which ids go on; level 1 holds the
second chunk of those, with a bitmap of its own, and so on. The place of an id's
next chunk is the number of set bits before it, which a directory of counts (one
for every 512 bits) gives in constant time. So any id is read without decoding
what stands before it, and ids below 256 take nine bits.

A file (``.dac``, little-endian) is: magic, number of documents, of ids and of
levels; document ids, their null marks, and where each document starts; then for
each level its length, chunks, bitmap words and directory. Documents stand in
ascending doc_id order (null first, equal ids by text), within a file and from
file to file.

Defined results for odd input: a null or empty text gives just the end id.
Rows of equal ids stand in the order of their texts, null first; null ids come before all others.
Repeated rows are written as often as they stand there. Very long texts are read whole, and are a file of their own if need be. An empty table gives no
file. Only doc_id and text are read, so that extra columns do not matter.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..staging import stage, staging_root
from .words import pieces, span_hashes, text_bytes

END_ID = 2
# Ids of a file, at which the next one is begun.
FILE_IDS = 2_000_000
# Bytes of text worked on at once, units encoded in one call, and units whose ids a worker remembers (some 40 bytes each).
PIECE_BYTES, CALL_UNITS, MEMO = 2 << 20, 10_000, 1_500_000
# Characters of a text by which rows of one id are spread.
BEGIN = 64
MAGIC = b"DACIDS01"
_BLOCK = 512  # bits of a directory entry


# --- the code -------------------------------------------------------------

def _encoded_level(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(chunks, bitmap words, directory, values that go on)."""
    goes_on = values > 255
    bits = np.zeros(-(-len(values) // _BLOCK) * _BLOCK, bool)
    bits[:len(values)] = goes_on
    packed = np.packbits(bits, bitorder="little").view(np.uint64)
    counts = bits.reshape(-1, _BLOCK).sum(axis=1, dtype=np.uint64)
    directory = np.concatenate(([0], np.cumsum(counts))).astype(np.uint64)
    return (values & 255).astype(np.uint8), packed, directory, values[goes_on] >> 8


def encoded(doc_ids: np.ndarray, null: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> bytes:
    """A whole file. ``starts`` has one entry more than there are documents."""
    levels, values = [], ids.astype(np.uint32)
    while True:
        chunks, words, directory, more = _encoded_level(values)
        levels.append((len(values), chunks, words, directory))
        if not len(more):
            break
        values = more
    parts = [MAGIC, np.array([len(doc_ids), len(ids), len(levels)], np.uint64).tobytes(),
             doc_ids.astype(np.int64).tobytes(), starts.astype(np.uint64).tobytes(), null.astype(np.uint8).tobytes()]
    for size, chunks, words, directory in levels:
        parts += [np.uint64(size).tobytes(), words.tobytes(), directory.tobytes(), chunks.tobytes()]
    return b"".join(parts)


@dataclass
class Level:
    chunks: np.ndarray
    words: np.ndarray
    directory: np.ndarray

    def rank(self, i: int) -> int:
        """Set bits before place ``i``."""
        block = i // _BLOCK
        first, last = block * (_BLOCK // 64), i // 64
        count = int(self.directory[block]) + int(np.bitwise_count(self.words[first:last]).sum())
        rest = i % 64
        return count + (int(self.words[last]) & ((1 << rest) - 1)).bit_count() if rest else count

    def bits(self, begin: int, end: int) -> np.ndarray:
        low, high = begin // 64, -(-end // 64)
        return np.unpackbits(self.words[low:high].view(np.uint8), bitorder="little")[begin - low * 64:end - low * 64].astype(bool)


class TokenFile:
    """A file's content, read where it lies."""

    def __init__(self, content) -> None:
        data = np.frombuffer(content, np.uint8)
        if data[:8].tobytes() != MAGIC:
            raise ValueError("not a token file")
        at = 8

        def take(count: int, kind) -> np.ndarray:
            nonlocal at
            size = count * np.dtype(kind).itemsize
            out = np.frombuffer(data[at:at + size].data, kind)
            at += size
            return out

        self.n_docs, self.n_ids, levels = map(int, take(3, np.uint64))
        self.doc_ids, self.starts, self.null = take(self.n_docs, np.int64), take(self.n_docs + 1, np.uint64), take(self.n_docs, np.uint8)
        self.levels: list[Level] = []
        for _ in range(levels):
            size = int(take(1, np.uint64)[0])
            blocks = -(-size // _BLOCK)
            words, directory = take(blocks * (_BLOCK // 64), np.uint64), take(blocks + 1, np.uint64)
            self.levels.append(Level(take(size, np.uint8), words, directory))

    def token(self, i: int) -> int:
        """One id, wherever it stands."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = shift = 0
        for level in self.levels:
            value |= int(level.chunks[i]) << shift
            if not int(level.words[i // 64]) >> (i % 64) & 1:
                break
            i, shift = level.rank(i), shift + 8
        return value

    def tokens(self, begin: int, end: int) -> np.ndarray:
        """The ids from ``begin`` to before ``end``. What they have on a level stands together there."""
        out = np.zeros(max(0, end - begin), np.uint32)
        places, shift = np.arange(len(out)), 0
        for level in self.levels:
            if not len(places):
                break
            out[places] |= level.chunks[begin:begin + len(places)].astype(np.uint32) << np.uint32(shift)
            more = level.bits(begin, begin + len(places))
            begin, places, shift = level.rank(begin) if more.any() else 0, places[more], shift + 8
        return out

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.starts[k]), int(self.starts[k + 1]))


# --- encoding texts -------------------------------------------------------

_BLANK = np.array([b == 0x20 or 0x09 <= b <= 0x0D or 0x1C <= b <= 0x1F for b in range(256)])
# Bytes that surely begin a character that is not blank: printable ASCII, and two-byte letters from U+00C0 on.
_SOLID = np.array([0x21 <= b <= 0x7E or 0xC3 <= b <= 0xDF for b in range(256)])


def _units(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where units begin: at each row that is not empty, and at each single blank between two characters.

    A byte-level tokenizer never joins what stands on both sides of such a place:
    its words take the blank before them along. So the ids of a text are those of
    its units, one after the other.
    """
    begins = np.zeros(len(data) + 1, bool)
    if len(data) > 2:
        begins[1:-2] = (data[1:-1] == 0x20) & ~_BLANK[data[:-2]] & _SOLID[data[2:]]
    begins[offsets[:-1]] = True
    begins[len(data)] = False
    return np.flatnonzero(begins)


class Encoder:
    """Ids of whole texts; a unit that comes again is not encoded again."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Units known so far: sorted hashes, and where in ``flat`` the ids of each stand.
        self.keys = np.zeros(0, np.uint64)
        self.at, self.sizes, self.flat = (np.zeros(0, kind) for kind in (np.int64, np.int32, np.uint32))

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        flat, sizes = [self.flat], []
        for begin in range(0, len(texts), CALL_UNITS):
            found = [x.ids for x in self.tokenizer.encode_batch(texts[begin:begin + CALL_UNITS], add_special_tokens=False)]
            sizes += map(len, found)
            flat.append(np.fromiter(chain.from_iterable(found), np.uint32))
        sizes = np.array(sizes, np.int32)
        keys = np.concatenate((self.keys, keys))
        order = np.argsort(keys, kind="stable")
        self.at = np.concatenate((self.at, len(self.flat) + np.cumsum(sizes) - sizes))[order]
        self.sizes = np.concatenate((self.sizes, sizes))[order]
        self.keys, self.flat = keys[order], np.concatenate(flat)

    def ids(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, each row's closed by ``end_id``; where each row starts, and one entry more)."""
        data, offsets = text_bytes(column)
        starts = _units(data, offsets)
        stops = np.concatenate((starts[1:], [len(data)]))[:len(starts)]
        different, first, which = np.unique(span_hashes(data, starts, stops), return_index=True, return_inverse=True)
        if len(self.keys) + len(different) > MEMO:
            self.keys, self.at, self.sizes, self.flat = self.keys[:0], self.at[:0], self.sizes[:0], self.flat[:0]
        place = np.searchsorted(self.keys, different)
        known = np.zeros(len(different), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == different[inside]
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            self._learn(different[new], [raw[x:y].decode() for x, y in zip(starts[first[new]].tolist(), stops[first[new]].tolist())])
            place = np.searchsorted(self.keys, different)
        sizes, at, flat = self.sizes[place].astype(np.int64), self.at[place], self.flat
        counts = sizes[which]
        # Ids of each row, with room for the end id.
        in_row = np.searchsorted(starts, offsets)
        before = np.concatenate(([0], np.cumsum(counts)))
        row_starts = before[in_row] + np.arange(len(offsets))
        out = np.full(row_starts[-1], end_id, np.uint32)
        row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(in_row))
        target = np.repeat(before[:-1] + row_of, counts) + (np.arange(before[-1]) - np.repeat(before[:-1], counts))
        source = np.repeat(at[which], counts) + (np.arange(before[-1]) - np.repeat(before[:-1], counts))
        out[target] = flat[source]
        return out, row_starts


@lru_cache(1)
def _encoder(path: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path)


# --- files ----------------------------------------------------------------

def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder that the cluster shares."""
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[5:]
    return pafs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id and text in ranges of ascending id, and of text among equal ids, each range sorted.

    The beginning of the text stands behind the id, so that rows of a null or a
    repeated id spread over ranges like others; only rows that begin alike, too, stay together.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_begin", F.substring("text", 1, BEGIN))
    return rows.repartitionByRange("doc_id", "_begin").sortWithinPartitions("doc_id", "text").select("doc_id", "text")


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Write all documents; returns one row per file: part, number, file, n_docs, n_ids, and its first id's number.

    Documents are range-partitioned by id; a task encodes its range and closes a
    file every ``file_ids`` ids. A file's name is its attempt's own: a task that
    is run again writes others, and only those of the returned table count.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = opened(folder)
        system.create_dir(path, recursive=True)
        encoder = _encoder(tokenizer)
        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def closed() -> pa.RecordBatch:
            ids = np.concatenate([x[3] for x in held])
            sizes = np.concatenate([np.diff(x[2]) for x in held])
            name = f"{part:06d}-{number:04d}-{uuid.uuid4().hex}.dac"
            content = encoded(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]),
                              np.concatenate(([0], np.cumsum(sizes))), ids)
            with system.open_output_stream(f"{path}/{name}") as out:
                out.write(content)
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()), "file": [name],
                "n_docs": [len(sizes)], "n_ids": [len(ids)]})

        size = 0
        for batch in pieces(batches, size=PIECE_BYTES):
            ids, starts = encoder.ids(batch.column("text"), end_id)
            doc_ids = batch.column("doc_id")
            null = np.asarray(doc_ids.is_null().to_numpy(zero_copy_only=False), np.uint8)
            held.append((doc_ids.fill_null(0).to_numpy(zero_copy_only=False), null, starts, ids))
            size += len(ids)
            if size >= file_ids:
                yield closed()
                held, size, number = [], 0, number + 1
        if held:
            yield closed()

    written = in_order(docs).mapInArrow(rows, "part int, number int, file string, n_docs long, n_ids long")
    manifest = stage(written, "token-files")  # once: each run writes files
    earlier = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return manifest.withColumn("first", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)))


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens and checksum of its ids."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, first in zip(batch.column("content"), batch.column("first").to_pylist(), strict=True):
                file = TokenFile(content.as_buffer())
                sums = [zlib.crc32(file.document(k).astype("<u4").tobytes()) for k in range(file.n_docs)]
                starts = file.starts.astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(file.doc_ids, pa.int64(), mask=file.null.astype(bool)), pa.array(starts[:-1] + first),
                    pa.array(np.diff(starts)), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.dac").load(folder)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    wanted = named.join(manifest.select("file", "first"), "file")
    return wanted.select("content", "first").mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Write ``docs`` to ``folder`` (one of its own in the shared folder, if none is named) and read them back."""
    spark = docs.sparkSession
    folder = folder or f"{staging_root(spark)}/tokens-{uuid.uuid4().hex}"
    manifest = stage(write(docs, folder, tokenizer), "token-manifest")
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read(spark, folder, manifest)
