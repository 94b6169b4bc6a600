"""Quality classifier: a convolutional network over bytes, in numpy.

A text's bytes are embedded, and ``FILTERS`` learnt filters of eight bytes run over
all of it in steps of two. Their responses are max-pooled over chunks of 512 bytes
that overlap by 128 and cover the whole text; a small hidden layer makes a logit of
each chunk, and the text's score is the logistic function of the chunks' mean logit.

Learning takes at most ``ROWS_PER_CLASS`` labelled rows of each class, those with the
least hash of the id: a fixed bound, whatever the input's size. All chunks of these rows are
learnt from, each row counting as much as another. The score reads every byte of every
text, and nothing else: windows that reach from a row's padding into the next row are left out, so
that a score depends on the text alone, wherever it stands.

Defined results for odd input: a null or empty text is one chunk of padding and
has a score like any other. A row without a label is scored, not learnt from.
Of several labels of one id the lowest counts. Without labels of both classes
every score is 0.5. Repeated rows, and equal texts, get the same score up to the rounding of single
precision. A very long text has as many chunks as it needs. An empty table gives an
empty one. Only doc_id and text are read, so that extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import crc_remainder, pieces, text_bytes

ROWS_PER_CLASS = 1_500
EMBEDDING, FILTERS, HIDDEN, WIDTH, STEP = 8, 32, 16, 8, 2
SEGMENT = 128  # bytes; a chunk is four of them, and begins three after the one before
CHUNK, HOP = 4, 3
EPOCHS, BATCH, RATE = 8, 128, 3e-3
THRESHOLD = 0.3
# Bytes whose responses are held at once.
SLICE = 1 << 17


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows laid out in whole segments, with zeros behind each, and the number of segments before each row."""
    sizes = np.diff(offsets)
    segments = (sizes + WIDTH) // SEGMENT + 1  # a filter that begins in a row's last byte ends in its padding
    before = np.concatenate(([0], np.cumsum(segments)))
    out = np.zeros(before[-1] * SEGMENT + WIDTH, np.uint8)
    shift = np.repeat(before[:-1] * SEGMENT - offsets[:-1], sizes)
    out[np.arange(len(data)) + shift] = data
    return out, before


def chunk_starts(before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first segment, last segment) of each chunk, and the number of chunks before each row."""
    segments = np.diff(before)
    counts = np.maximum(1, -(-(segments - (CHUNK - HOP)) // HOP))
    chunks = np.concatenate(([0], np.cumsum(counts)))
    place = np.arange(chunks[-1]) - np.repeat(chunks[:-1], counts)
    first = np.repeat(before[:-1], counts) + HOP * place
    return first, np.minimum(first + CHUNK, np.repeat(before[1:], counts)) - 1, chunks


@dataclass
class Network:
    embedding: np.ndarray  # 256, EMBEDDING
    filters: np.ndarray  # WIDTH * EMBEDDING, FILTERS
    bias: np.ndarray
    hidden: np.ndarray  # FILTERS, HIDDEN
    hidden_bias: np.ndarray
    out: np.ndarray  # HIDDEN
    out_bias: np.ndarray

    @classmethod
    def untrained(cls, rng: np.random.Generator) -> Network:
        normal = lambda scale, *shape: (scale * rng.standard_normal(shape)).astype(np.float32)
        zeros = lambda n: np.zeros(n, np.float32)
        return cls(normal(0.5, 256, EMBEDDING), normal(0.15, WIDTH * EMBEDDING, FILTERS), zeros(FILTERS),
                   normal(0.25, FILTERS, HIDDEN), zeros(HIDDEN), normal(0.25, HIDDEN), zeros(1))

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.bias, self.hidden, self.hidden_bias, self.out, self.out_bias]

    def responses(self, data: np.ndarray) -> np.ndarray:
        """Filter responses at every second byte but the last WIDTH of ``data``.

        Two bytes at a time meet all places of a filter that they can stand in;
        a response is the sum over the four places.
        """
        pairs = self.embedding[data].reshape(-1, STEP * EMBEDDING)
        places = WIDTH // STEP
        weights = self.filters.reshape(places, STEP * EMBEDDING, FILTERS).transpose(1, 0, 2).reshape(STEP * EMBEDDING, -1)
        parts = pairs @ weights
        n = len(pairs) - places
        out = parts[:n, :FILTERS].copy()
        for k in range(1, places):
            out += parts[k:n + k, k * FILTERS:(k + 1) * FILTERS]
        return out

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        """Of chunks, from their largest responses."""
        h = np.maximum(pooled + self.bias, 0) @ self.hidden + self.hidden_bias
        return np.maximum(h, 0) @ self.out + self.out_bias[0]

    def scores(self, texts: pa.Array) -> np.ndarray:
        data, before = padded(*text_bytes(texts))
        tops = np.empty((before[-1], FILTERS), np.float32)
        # The last places of a row's last segment would see the next row's bytes.
        outside = (WIDTH - STEP) // STEP
        step, ends = SLICE // SEGMENT, before[1:] - 1
        for begin in range(0, before[-1], step):
            end = min(begin + step, before[-1])
            found = self.responses(data[begin * SEGMENT:end * SEGMENT + WIDTH]).reshape(end - begin, SEGMENT // STEP, FILTERS)
            found[ends[(ends >= begin) & (ends < end)] - begin, -outside:] = -np.inf
            tops[begin:end] = found.max(axis=1)
        first, last, chunks = chunk_starts(before)
        pooled = tops[first]
        for k in range(1, CHUNK):
            np.maximum(pooled, tops[np.minimum(first + k, last)], out=pooled)
        mean = np.add.reduceat(self.logits(pooled).astype(np.float64), chunks[:-1]) / np.diff(chunks)
        return 1 / (1 + np.exp(-mean))


def trained(chunks: np.ndarray, labels: np.ndarray, share_of_row: np.ndarray, seed: int = 3) -> Network:
    """A network fitted to chunks (rows of CHUNK * SEGMENT + WIDTH bytes) and their texts' labels, by Adam.

    ``share_of_row`` is the part of its row that a chunk stands for. Rows of both classes weigh the
    same in sum; within an epoch, a row's chunks weigh as one row.
    """
    rng = np.random.default_rng(seed)
    net = Network.untrained(rng)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in net.parameters()]
    # Both classes count the same.
    share = (labels * share_of_row).sum() / share_of_row.sum()
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) * share_of_row / share_of_row.mean()
    places, steps = (CHUNK * SEGMENT) // STEP, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(chunks))
        for begin in range(0, len(order), BATCH):
            at = order[begin:begin + BATCH]
            x, n = chunks[at], len(at)
            responses = np.stack([net.responses(row) for row in x])
            top = responses.argmax(axis=1)
            pooled = np.take_along_axis(responses, top[:, None, :], axis=1)[:, 0] + net.bias
            h0 = np.maximum(pooled, 0)
            h1 = h0 @ net.hidden + net.hidden_bias
            h2 = np.maximum(h1, 0)
            logit = h2 @ net.out + net.out_bias[0]
            d = (weight[at] * (1 / (1 + np.exp(-logit)) - labels[at]) / n).astype(np.float32)
            d_h1 = d[:, None] * net.out * (h1 > 0)
            d_pooled = (d_h1 @ net.hidden.T) * (pooled > 0)
            # Only the place of the largest response moves a filter.
            seen = x[np.arange(n)[:, None, None], STEP * top[:, :, None] + np.arange(WIDTH)]
            window = net.embedding[seen].reshape(n, FILTERS, -1)
            d_filters = np.einsum("bf,bfk->kf", d_pooled, window)
            d_window = (d_pooled[:, :, None] * net.filters.T).reshape(-1, EMBEDDING)
            d_embedding = np.stack([np.bincount(seen.reshape(-1), d_window[:, e], 256) for e in range(EMBEDDING)], axis=1)
            gradients = [d_embedding, d_filters, d_pooled.sum(0), h0.T @ d_h1, d_h1.sum(0), h2.T @ d, np.array([d.sum()])]
            steps += 1
            for p, g, (m, v) in zip(net.parameters(), gradients, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (RATE * (m / (1 - 0.9 ** steps)) / (np.sqrt(v / (1 - 0.999 ** steps)) + 1e-8)).astype(np.float32)
    assert places == responses.shape[1]
    return net


def sample(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All chunks of the rows to learn from (those whose crc32 remainder is not 0), their labels and parts of their rows."""
    known = labels.where(crc_remainder(F.col("doc_id"), 5) != 0).groupBy("doc_id").agg(F.min("quality").alias("label"))
    picked = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_per_class) for k in (0, 1)]
    wanted = picked[0].unionByName(picked[1])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            data, before = padded(*text_bytes(batch.column("text")))
            data = np.concatenate((data, np.zeros(CHUNK * SEGMENT, np.uint8)))
            first, last, chunks = chunk_starts(before)
            out, whose = [], []
            for row in range(batch.num_rows):
                for k in range(chunks[row], chunks[row + 1]):
                    chunk = data[first[k] * SEGMENT:first[k] * SEGMENT + CHUNK * SEGMENT + WIDTH].copy()
                    chunk[(last[k] + 1 - first[k]) * SEGMENT:] = 0
                    out.append(chunk.tobytes())
                    whose.append(row)
            rows = pa.array(whose, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c).take(rows) for c in ("doc_id", "label")] + [pa.array(out, pa.binary())], ["doc_id", "label", "chunk"])

    # At most rows_per_class ids of each class: a broadcast of known size.
    texts = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("label").cast("int").alias("label"))
    found = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "label").mapInArrow(cut, "doc_id long, label int, chunk binary").toArrow()
    order = np.lexsort((np.array(found.column("chunk").to_pylist(), object).astype("S") if found.num_rows else np.zeros(0), found.column("doc_id").to_numpy()))
    size = CHUNK * SEGMENT + WIDTH
    chunks = np.frombuffer(b"".join(found.column("chunk").to_pylist()), np.uint8).reshape(-1, size)
    _, of, times = np.unique(found.column("doc_id").to_numpy()[order], return_inverse=True, return_counts=True)
    return chunks[order], found.column("label").to_numpy()[order].astype(np.float32), 1 / times[of]


def fitted(docs: DataFrame, labels: DataFrame) -> Network | None:
    chunks, known, share = sample(docs, labels)
    return trained(chunks, known, share) if 0 < known.sum() < len(known) else None


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels))  # a few thousand weights

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network | None = shared.value
        for batch in pieces(batches):
            scores = net.scores(batch.column("text")) if net is not None else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (crc_remainder(F.col("doc_id"), 5) == 0).alias("held_out"))
    return given.mapInArrow(rows, "doc_id long, held_out boolean, score double, predicted int")
