"""Language-model scores: a hierarchical Pitman-Yor model of characters, and a count model of words beside it.

A text is the sequence of its words' bytes (A-Z lower-cased), a blank after each word,
and an end symbol. Every context of up to ``CONTEXT`` bytes is a restaurant whose
parent is the context without its earliest byte; customers are the symbols seen
there, and each table is a customer in the parent. The restaurant without a
context has the uniform distribution over 256 symbols for a parent. Contexts reach over
word ends, so that a word is predicted from the end of the one before.

Texts stand in chunks. A chunk asks for its own different grams (a symbol below its context) once, with
their training counts; these requests are dealt to groups by the last two bytes of the context, and a
group's requests to slots of a bounded number of chunks. Sums of a group's slots are its part of the
model; answers (a log probability for each gram asked) go back to the chunks. So no part of the model but
the two smallest kinds of restaurant passes the driver, and texts are gone through twice, however large the model is.

The seating is sampled by Gibbs sweeps over numbers of tables: for a dish of up to ``EXACT`` customers the
number is drawn from its distribution given the other tables of its restaurant and the probability that
the parent gives it; the customers of a more frequent dish are seated anew, in blocks that grow with
those seated. Two approximations: the blocks, and that the parent's probability is that of the state before the sweep, in
which the dish's own tables still count. Restaurants of two bytes of context and more are swept in their group; those
above (at most 256 * 257 dishes) by the driver, from sums of table numbers. After a
burn-in, the tables of ``SAMPLES`` states are kept, and a symbol's probability is the average of its
probabilities in these states.

The word model has c + 1 over N + V + 1, for c occurrences of the word among N
training tokens, V of them different. Its counts come back to the texts by
chunk: a chunk asks for its own different words, so that no vocabulary is broadcast.

Defined results for odd input: a null text is an empty one, which is the end token
alone. A null id counts as the empty text for the split. Repeated rows train as
often as they stand there. Equal texts have equal scores up to the rounding of sums. A very long text is a chunk of its own and
worked on in turns. Without training texts every count is 0 and symbols are uniform. An empty table gives an empty one. Only doc_id and text are read, so
that extra columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..staging import release, stage
from .words import LOWER, NONBLANK, crc_remainder, mix, pieces, span_hashes, spans, text_bytes

CONTEXT = 6
BURN_IN, SAMPLES = 3, 3
# By length of the context.
DISCOUNT = (0.3, 0.5, 0.6, 0.7, 0.75, 0.8, 0.8)
STRENGTH = (1.0,) * (CONTEXT + 1)
EXACT = 30
# Text bytes of a chunk and for each group of the model, and the chunks whose requests meet in a slot.
CHUNK_BYTES, GROUP_BYTES, SLOT_CHUNKS = 16 << 20, 4 << 20, 64
# There are no more groups than last two bytes.
MOST_GROUPS = 1 << 14
# Text bytes that a bucket of the vocabulary is sized for.
BUCKET_BYTES = 8 << 20
BLANK, END = 0x20, 0x0A
_END_KEY = np.uint64(0x0E17D0F7EC7ED001)
PART_BYTES = 1 << 20
_CODEC = pa.Codec("zstd", compression_level=1)


# --- texts ----------------------------------------------------------------

def _bundled(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=_CODEC)) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _opened(cell: pa.BinaryScalar) -> pa.RecordBatch:
    """doc_id, held_out and text of a chunk."""
    with pa.ipc.open_stream(cell.as_py()) as bundle:
        return bundle.read_next_batch()


def _trains(docs: pa.RecordBatch) -> np.ndarray:
    return ~np.asarray(docs.column("held_out").to_numpy(zero_copy_only=False), bool)


def chunked(docs: DataFrame, held_out) -> DataFrame:
    """Documents in rows of a few MB of text: chunk, and its documents as one deflated cell, as Spark's rows of whole texts take several times their room."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 24
        for k, batch in enumerate(pieces(batches, size=CHUNK_BYTES)):
            yield pa.RecordBatch.from_arrays([pa.array([first + k], pa.int64()), pa.array([_bundled(batch)], pa.binary())], ["chunk", "docs"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return given.mapInArrow(rows, "chunk long, docs binary")


def _parts(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in turns of about PART_BYTES, as characters take more room than words."""
    for batch in pieces(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), size=PART_BYTES):
        yield batch.column(0)


def ranked(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted different numbers, which of them each is): by a hash table, so that only different ones are sorted."""
    coded = pa.array(numbers).dictionary_encode()
    different = coded.dictionary.to_numpy()
    order = np.argsort(different)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return different[order], rank[coded.indices.to_numpy()]


def word_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sorted different keys of words and end, which of them each word is, words before each row, place of the end)."""
    hashes, counts = [], [np.zeros(1, np.int64)]
    for part in _parts(texts):
        data, offsets = text_bytes(part)
        starts, stops, before = spans(data, offsets, NONBLANK)
        hashes.append(span_hashes(LOWER[data], starts, stops))
        counts.append(np.diff(before))
    different, which = ranked(np.concatenate([*hashes, [_END_KEY]]))
    return different, which[:-1], np.cumsum(np.concatenate(counts)), which[-1]


_FOLDED = np.where(NONBLANK, LOWER, BLANK).astype(np.uint8)
_LEAD, _TAIL = pa.scalar(b" " * CONTEXT, pa.large_binary()), pa.scalar(b" x", pa.large_binary())


def symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols of all rows, each led by CONTEXT blanks; which of them are to be predicted; their offsets by row)."""
    rows = len(texts)
    raw, offsets = text_bytes(texts)
    if not rows:
        return np.zeros(0, np.uint8), np.zeros(0, bool), np.zeros(1, np.int64)
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)])
    joined = pa.compute.binary_join_element_wise(_LEAD, whole, _TAIL, pa.scalar(b"", pa.large_binary()))
    starts = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset:joined.offset + rows + 1]
    data = _FOLDED[np.frombuffer(joined.buffers()[2], np.uint8)[starts[0]:starts[-1]]]
    starts = starts - starts[0]
    # A blank stays where a word ends before it.
    keep = data != BLANK
    keep[1:] |= keep[:-1].copy()
    leads = (starts[:-1, None] + np.arange(CONTEXT)).reshape(-1)
    data[starts[1:] - 1] = END
    predicted = keep
    predicted[leads] = False
    sizes = np.add.reduceat(predicted, starts[:-1], dtype=np.int64)
    kept = predicted.copy()
    kept[leads] = True
    return data[kept], predicted[kept], np.concatenate(([0], np.cumsum(sizes)))


def grams(text: np.ndarray, predicted: np.ndarray) -> np.ndarray:
    """Each symbol to predict below its CONTEXT predecessors, one number each."""
    out = text.astype(np.int64)
    for i in range(1, CONTEXT + 1):
        out[i:] |= text[:-i].astype(np.int64) << (8 * i)
    return out[predicted]


# --- word counts ----------------------------------------------------------

def word_counts(chunks: DataFrame, buckets_log2: int) -> tuple[DataFrame, int, int]:
    """(chunk, bucket, counts: training occurrences of each of the chunk's different words in key order; N; V)."""
    shift = np.uint64(64 - buckets_log2)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                docs = _opened(batch.column("docs")[k])
                keys, which, before, end = word_keys(docs.column("text"))
                train = _trains(docs)
                counts = np.bincount(which, np.repeat(train, np.diff(before)), len(keys)).astype(np.uint32)
                counts[end] += train.sum()
                bucket = (keys >> shift).astype(np.int32) if buckets_log2 else np.zeros(len(keys), np.int32)
                numbers, first = np.unique(bucket, return_index=True)
                edges = [*first.tolist(), len(keys)]
                cut = lambda a: pa.array([a[x:y].tobytes() for x, y in zip(edges, edges[1:])], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers, pa.int32()), pa.array(np.full(len(numbers), batch.column("chunk")[k].as_py()), pa.int64()), cut(keys), cut(counts)],
                    ["bucket", "chunk", "keys", "counts"])

    def answered(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("keys")]
        counts = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("counts")])
        different, which = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(which, counts, len(different)).astype(np.int64)
        wide = totals[which].astype(np.uint32 if totals.max(initial=0) < 1 << 32 else np.uint64)
        edges = np.cumsum([0, *map(len, keys)]).tolist()
        n = table.num_rows
        return pa.table({
            "chunk": pa.array([*table.column("chunk").to_pylist(), None], pa.int64()),
            "bucket": pa.array([*table.column("bucket").to_pylist(), None], pa.int32()),
            "size": pa.array([*map(len, keys), None], pa.int32()),
            "counts": pa.array([*(wide[x:y].tobytes() for x, y in zip(edges, edges[1:])), None], pa.binary()),
            "n": pa.array([None] * n + [int(totals.sum())], pa.int64()),
            "v": pa.array([None] * n + [int((totals > 0).sum())], pa.int64())})

    requests = chunks.mapInArrow(asked, "bucket int, chunk long, keys binary, counts binary")
    answers = stage(requests.groupBy("bucket").applyInArrow(
        answered, "chunk long, bucket int, size int, counts binary, n long, v long"), "answers")
    n, v = answers.agg(F.sum("n"), F.sum("v")).first()
    return answers.where("chunk is not null").drop("n", "v"), n or 0, v or 0


# --- seating --------------------------------------------------------------

def _stirling(discount: float) -> np.ndarray:
    """Logarithms of generalised Stirling numbers of c customers at t tables."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(EXACT):
        t = np.arange(c + 2)
        with np.errstate(divide="ignore"):
            stay = out[c, :c + 2] + np.log(np.maximum(c - t * discount, 0))
        out[c + 1, 0] = -np.inf
        out[c + 1, 1:c + 2] = np.logaddexp(out[c, :c + 1], stay[1:])
    return out


def seated(customers: np.ndarray, others: np.ndarray, base: np.ndarray, discount: float, strength: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish, drawn given its customers, the restaurant's other tables and the dish's base probability."""
    tables = np.ones(len(customers), np.int64)
    table = _stirling(discount)
    small = np.flatnonzero((customers > 1) & (customers <= EXACT))
    small = small[np.argsort(customers[small].astype(np.uint8), kind="stable")]
    edges = np.searchsorted(customers[small], np.arange(2, EXACT + 2))
    for c, begin, end in zip(range(2, EXACT + 1), edges, edges[1:]):
        at = small[begin:end]
        if not len(at):
            continue
        # Logarithms of the weights of 1 to c tables, then one uniform number against their sums.
        opened = np.cumsum(np.log(strength + discount * (others[at, None] + np.arange(c))), axis=1)
        weight = table[c, 1:c + 1] + opened + np.arange(1, c + 1) * np.log(base[at])[:, None]
        weight -= weight.max(axis=1, keepdims=True)
        sums = np.cumsum(np.exp(weight), axis=1)
        tables[at] = 1 + (rng.random(len(at))[:, None] * sums[:, -1:] > sums).sum(axis=1)
    at = np.flatnonzero(customers > EXACT)
    seats, count = np.ones(len(at), np.int64), np.ones(len(at), np.int64)
    while len(at):
        new = (strength + discount * (others[at] + count)) * base[at]
        chance = new / (new + seats - discount * count)
        block = np.minimum(np.maximum(1, seats // 8), customers[at] - seats)
        count = count + rng.binomial(block, chance)
        seats = seats + block
        tables[at] = count
        go = seats < customers[at]
        at, seats, count = at[go], seats[go], count[go]
    return tables


@dataclass
class Room:
    """Restaurants of one context length: dishes (context and symbol as one number, sorted) and their counts."""

    dishes: np.ndarray
    length: int
    customers: np.ndarray | None = None
    tables: np.ndarray | None = None

    def __post_init__(self) -> None:
        context = self.dishes >> 8
        first = np.concatenate(([True], context[1:] != context[:-1])) if len(context) else np.zeros(0, bool)
        self.contexts, self.of = context[first], np.cumsum(first) - 1

    def totals(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, values, len(self.contexts))

    def predictive(self, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability of each dish, weight that each context leaves to its parent)."""
        d, s = DISCOUNT[self.length], STRENGTH[self.length]
        over = s + self.totals(self.customers)
        left = (s + d * self.totals(self.tables)) / over
        return (self.customers - d * self.tables) / over[self.of] + left[self.of] * base, left

    def sweep(self, base: np.ndarray, rng: np.random.Generator) -> None:
        others = self.totals(self.tables)[self.of] - self.tables
        self.tables = seated(self.customers, others, base, DISCOUNT[self.length], STRENGTH[self.length], rng)


def _rooms(grams_: np.ndarray, counts: np.ndarray, lengths: range) -> tuple[list[Room], list[np.ndarray]]:
    """Rooms from the longest context down, and for each but the last which dish of the next one each dish is."""
    rooms, parents = [Room(grams_, lengths[0], counts)], []
    for length in lengths[1:]:
        dishes, parent = np.unique(rooms[-1].dishes & ((1 << 8 * (length + 1)) - 1), return_inverse=True)
        rooms.append(Room(dishes, length))
        parents.append(parent)
    return rooms, parents


def _pass_down(rooms: list[Room], parents: list[np.ndarray]) -> None:
    """Customers of each room from the tables of the one before; tables stay within them."""
    for room, above, parent in zip(rooms, rooms[1:], parents):
        above.customers = np.bincount(parent, room.tables, len(above.dishes)).astype(np.int64)
        if above.tables is None:
            above.tables = np.ones(len(above.dishes), np.int64)
        above.tables = np.minimum(above.tables, above.customers)


def _predicted(rooms: list[Room], parents: list[np.ndarray], base: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """By room: probabilities, weights left to the parent, and base probabilities of its dishes."""
    p, left, bases = [None] * len(rooms), [None] * len(rooms), [None] * len(rooms)
    for k in range(len(rooms) - 1, -1, -1):
        bases[k] = base if k == len(rooms) - 1 else p[k + 1][parents[k]]
        p[k], left[k] = rooms[k].predictive(bases[k])
    return p, left, bases


def _swept(rooms: list[Room], parents: list[np.ndarray], bases: list[np.ndarray], rng: np.random.Generator) -> None:
    for k, room in enumerate(rooms):
        room.sweep(bases[k], rng)
        _pass_down(rooms[k:k + 2], parents[k:k + 1])


LOWER_ROOMS = range(CONTEXT, 1, -1)  # contexts of CONTEXT to 2 bytes


@dataclass
class Upper:
    """The restaurants of one byte of context and of none, all dishes of which fit anywhere."""

    rooms: list[Room] | None = None
    parents: list[np.ndarray] | None = None

    def given(self, dishes: np.ndarray, customers: np.ndarray) -> None:
        if self.rooms is None:
            self.rooms, self.parents = _rooms(dishes, customers, range(1, -1, -1))
            self.rooms[0].tables = np.ones(len(dishes), np.int64)
        self.rooms[0].customers = customers
        self.rooms[0].tables = np.minimum(self.rooms[0].tables, customers)
        _pass_down(self.rooms, self.parents)

    def sweep(self, seed: int) -> None:
        uniform = np.full(len(self.rooms[1].dishes), 1 / 256)
        _, _, bases = _predicted(self.rooms, self.parents, uniform)
        _swept(self.rooms, self.parents, bases, np.random.default_rng([seed, 1 << 20]))

    def dense(self) -> np.ndarray:
        """Probability of every symbol after every byte, at context * 256 + symbol."""
        if self.rooms is None:
            return np.full(1 << 16, 1 / 256)
        p, left, _ = _predicted(self.rooms, self.parents, np.full(len(self.rooms[1].dishes), 1 / 256))
        none = np.full(256, (left[1][0] if len(left[1]) else 1.0) / 256)
        none[self.rooms[1].dishes] = p[1]
        out = np.tile(none, (256, 1))
        out[self.rooms[0].contexts] *= left[0][:, None]
        out = out.reshape(-1)
        out[self.rooms[0].dishes] = p[0]
        return out


# --- requests and the model -----------------------------------------------

def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers, their bytes by place and deflated, behind how many they are."""
    planes = np.ascontiguousarray(numbers.astype(np.int64).view(np.uint8).reshape(-1, 8).T)
    return len(numbers).to_bytes(8, "little") + (_CODEC.compress(planes.reshape(-1), asbytes=True) if len(numbers) else b"")


def _unpacked(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(_CODEC.decompress(raw[8:], 8 * n, asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view(np.int64)[:, 0]


def _rising(numbers: np.ndarray) -> bytes:
    return _packed(np.diff(numbers, prepend=0))


def _risen(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(raw))


def groups_of(grams_: np.ndarray, groups: int) -> np.ndarray:
    """Which group of the model a gram belongs to: by the last two bytes of its context."""
    return (mix(((grams_ >> 8) & 0xFFFF).astype(np.uint64)) % np.uint64(groups)).astype(np.int32)


def _all_grams(texts: pa.Array) -> np.ndarray:
    """Grams of all rows, written in turns to where they stay."""
    out, n = np.empty(len(text_bytes(texts)[0]) + 2 * len(texts), np.int64), 0  # a blank and the end are more than the bytes
    for part in _parts(texts):
        own = grams(*symbols(part)[:2])
        out[n:n + len(own)] = own
        n += len(own)
    return out[:n]


def counted(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different numbers, sorted; how often each stands there). The numbers are sorted in place: a copy would take their room again."""
    numbers.sort()
    new = np.ones(len(numbers), bool)
    np.not_equal(numbers[1:], numbers[:-1], out=new[1:])
    first = np.flatnonzero(new)
    return numbers[first], np.diff(first, append=len(numbers))


def chunk_grams(texts: pa.Array, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different grams of all rows, sorted; how often each stands in the rows to train from)."""
    # Sorting numbers alone is quicker than adding up counts of parts.
    keys, n = counted(_all_grams(texts.filter(pa.array(train))))
    others, _ = counted(_all_grams(texts.filter(pa.array(~train))))
    others = others[~np.isin(others, keys, assume_unique=True)]
    at = np.searchsorted(keys, others)
    return np.insert(keys, at, others), np.insert(n, at, 0)


def requested(chunks: DataFrame, groups: int, slots: int) -> DataFrame:
    """(chunk, group, slot, grams, counts): what each chunk asks for, a row for each group it touches."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                chunk = batch.column("chunk")[k].as_py()
                docs = _opened(batch.column("docs")[k])
                keys, counts = chunk_grams(docs.column("text"), _trains(docs))
                group = groups_of(keys, groups)
                order = np.argsort(group, kind="stable")
                numbers, first = np.unique(group[order], return_index=True)
                parts = np.split(order, first[1:])
                m = len(numbers)
                slot = int(mix(np.array([chunk], np.uint64))[0] % np.uint64(slots))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, chunk)), pa.array(numbers, pa.int32()), pa.array(np.full(m, slot, np.int32)),
                     pa.array([_rising(keys[at]) for at in parts], pa.binary()), pa.array([_packed(counts[at]) for at in parts], pa.binary())],
                    ["chunk", "group", "slot", "grams", "counts"])

    return chunks.mapInArrow(rows, "chunk long, group int, slot int, grams binary, counts binary")


def _met(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(different grams of some rows, their counts, and which of them each row names)."""
    named = [_risen(x) for x in table.column("grams").to_pylist()]
    counts = np.concatenate([_unpacked(x) for x in table.column("counts").to_pylist()])
    keys, which = np.unique(np.concatenate(named), return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, which, counts)
    return keys, total, np.split(which, np.cumsum([len(x) for x in named])[:-1])


def asked(requests: DataFrame) -> DataFrame:
    """A row for each group and slot: its different grams, their counts, and which of them each chunk asked for."""
    def rows(table: pa.Table) -> pa.Table:
        keys, counts, which = _met(table)
        return pa.table({
            "group": table.column("group").slice(0, 1), "slot": table.column("slot").slice(0, 1),
            "grams": pa.array([_rising(keys)], pa.binary()), "counts": pa.array([_packed(counts)], pa.binary()),
            "chunks": pa.array([table.column("chunk").to_pylist()], pa.list_(pa.int64())),
            "which": pa.array([[_rising(w) for w in which]], pa.list_(pa.binary()))})

    return requests.groupBy("group", "slot").applyInArrow(
        rows, "group int, slot int, grams binary, counts binary, chunks array<long>, which array<binary>")


_STATE = "group int, grams binary, counts binary, tables binary, upper array<struct<dish: int, t: long>>, kept array<binary>"
_STATE_ARROW = pa.schema([
    ("group", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary()), ("tables", pa.binary()),
    ("upper", pa.list_(pa.struct([("dish", pa.int32()), ("t", pa.int64())]))), ("kept", pa.list_(pa.binary()))])


def _rooms_of(row: dict, tables: bytes | None = None) -> tuple[list[Room], list[np.ndarray]]:
    rooms, parents = _rooms(_risen(row["grams"]), _unpacked(row["counts"]), LOWER_ROOMS)
    if tables is None:
        rooms[0].tables = np.ones(len(rooms[0].dishes), np.int64)
    else:
        for room, own in zip(rooms, np.split(_unpacked(tables), np.cumsum([len(r.dishes) for r in rooms])[:-1]), strict=True):
            room.tables = own
    _pass_down(rooms, parents)
    return rooms, parents


def _row(row: dict, rooms: list[Room], kept: list[bytes]) -> dict:
    dish, which = np.unique(rooms[-1].dishes & 0xFFFF, return_inverse=True)
    sums = np.bincount(which, rooms[-1].tables, len(dish)).astype(np.int64)
    return {"group": row["group"], "grams": row["grams"], "counts": row["counts"], "tables": _packed(np.concatenate([r.tables for r in rooms])),
            "upper": [{"dish": d, "t": t} for d, t in zip(dish.tolist(), sums.tolist())], "kept": kept}


def trained(counts: DataFrame, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """The model from rows of (group, grams, counts), of which a group may have several.

    Returns its lower rooms, a row for each group that has training grams, and the
    predictive probabilities of the upper ones in every kept state.
    """
    def opened(table: pa.Table) -> pa.Table:
        keys, n, _ = _met(table)
        row = {"group": table.column("group")[0].as_py(), "grams": _rising(keys[n > 0]), "counts": _packed(n[n > 0])}
        if not (n > 0).any():
            return pa.Table.from_pylist([], _STATE_ARROW)
        return pa.Table.from_pylist([_row(row, _rooms_of(row)[0], [])], _STATE_ARROW)

    state = stage(counts.select("group", "grams", "counts").groupBy("group").applyInArrow(opened, _STATE), "seating")
    upper, kept = Upper(), []
    for turn in range(BURN_IN + SAMPLES + 1):
        # Tables of two-byte contexts are the customers of one-byte contexts: at most 256 * 256 sums.
        sums = state.select(F.inline("upper")).groupBy("dish").agg(F.sum("t").alias("t"))
        got = sorted((r.dish, r.t) for r in sums.where("t > 0").collect())
        if not got:
            break
        upper.given(np.array([d for d, _ in got]), np.array([t for _, t in got]))
        upper.sweep(seed * 1000 + turn)
        if turn == BURN_IN + SAMPLES:
            break
        base, keep = upper.dense(), turn >= BURN_IN
        if keep:
            kept.append(base)
        shared = counts.sparkSession.sparkContext.broadcast(base)  # 65536 numbers

        def swept(batches: Iterator[pa.RecordBatch], shared=shared, keep=keep, turn=turn) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    row = batch.slice(k, 1).to_pylist()[0]
                    rooms, parents = _rooms_of(row, row["tables"])
                    _, _, bases = _predicted(rooms, parents, shared.value[rooms[-1].dishes & 0xFFFF])
                    more = [row["tables"]] if keep else []
                    _swept(rooms, parents, bases, np.random.default_rng([seed, turn, row["group"]]))
                    yield pa.RecordBatch.from_pylist([_row(row, rooms, [*row["kept"], *more])], _STATE_ARROW)

        last, state = state, stage(state.mapInArrow(swept, _STATE), "seating")
        release(last)
    return state, np.stack(kept, axis=1) if kept else np.full((1 << 16, 1), 1 / 256)


# --- scores ---------------------------------------------------------------

class Model:
    """Lower rooms of one group (None: without training grams) in all kept states, and the upper rooms: average probability of grams."""

    def __init__(self, row: dict | None, upper: np.ndarray) -> None:
        self.upper, self.rooms = upper, {}
        if row is None:
            return
        states = []
        for k, tables in enumerate(row["kept"]):
            rooms, parents = _rooms_of(row, tables)
            p, left, _ = _predicted(rooms, parents, upper[rooms[-1].dishes & 0xFFFF, k])
            states.append((p, left))
        for i, room in enumerate(rooms):
            self.rooms[room.length] = (room.dishes, np.stack([p[i] for p, _ in states], axis=1), room.contexts, np.stack([left[i] for _, left in states], axis=1))

    @staticmethod
    def _found(sorted_: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
        return at, sorted_[at] == wanted

    def log10(self, grams_: np.ndarray) -> np.ndarray:
        samples = self.upper.shape[1]
        out = np.empty((len(grams_), samples))
        rest, weight = np.arange(len(grams_)), np.ones((len(grams_), samples))
        for length in LOWER_ROOMS:
            if length not in self.rooms or not len(rest):
                continue
            dishes, p, contexts, left = self.rooms[length]
            wanted = grams_[rest] & ((1 << 8 * (length + 1)) - 1)
            at, hit = self._found(dishes, wanted)
            out[rest[hit]] = weight[hit] * p[at[hit]]
            rest, weight, wanted = rest[~hit], weight[~hit], wanted[~hit]
            at, hit = self._found(contexts, wanted >> 8)
            weight[hit] *= left[at[hit]]
        out[rest] = weight * self.upper[grams_[rest] & 0xFFFF]
        return np.log10(out.mean(axis=1))


def answers_of(asked_: DataFrame, state: DataFrame, upper: np.ndarray) -> DataFrame:
    """(chunk, group, logs): log10 probabilities of the grams that each chunk asked a group for, in their order."""
    shared = asked_.sparkSession.sparkContext.broadcast(upper)  # 65536 numbers for each kept state

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, of = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if model is None or of != row["group"]:
                    own = {"group": row["group"], "grams": row["model"], "counts": row["customers"], "kept": row["kept"]}
                    model, of = Model(own if row["model"] is not None else None, shared.value), row["group"]
                logs = model.log10(_risen(row["grams"])).astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["chunks"], pa.int64()), pa.array([row["group"]] * len(row["chunks"]), pa.int32()),
                     pa.array([logs[_risen(w)].tobytes() for w in row["which"]], pa.binary())], ["chunk", "group", "logs"])

    learnt = state.select("group", F.col("grams").alias("model"), F.col("counts").alias("customers"), "kept")
    return asked_.drop("counts").join(learnt, "group", "left").mapInArrow(rows, "chunk long, group int, logs binary")


def gram_scores(texts: pa.Array, answers: np.ndarray, groups: int) -> np.ndarray:
    """Sum of each row's logs, from the answers to a chunk's different grams: by group, sorted in each."""
    keys, _ = counted(_all_grams(texts))
    logs = np.empty(len(keys), np.float32)
    logs[np.argsort(groups_of(keys, groups), kind="stable")] = answers
    sums = []
    for part in _parts(texts):  # made again, as the places of all grams of a chunk would take their room again
        text, predicted, offsets = symbols(part)
        found = grams(text, predicted)
        order = np.argsort(found)
        different, n = counted(found)
        own = np.empty(len(order), np.float64)
        own[order] = np.repeat(logs[np.searchsorted(keys, different)], n)  # sorted ones are looked up in passing
        sums.append(np.add.reduceat(own, offsets[:-1]))  # every row has its end symbol
    return np.concatenate(sums)


def chunk_scores(chunks: DataFrame, words: DataFrame, answers: DataFrame, n: int, v: int, groups: int) -> DataFrame:
    """Both models' figures of every text: a chunk meets the answers of the word model and of the groups."""
    below = math.log10(n + v + 1)

    def word_figures(texts: pa.Array, right: pa.Table) -> dict[str, pa.Array]:
        right = right.sort_by("bucket")
        counts = np.concatenate([
            np.frombuffer(x.as_buffer(), np.uint32 if len(x.as_buffer()) == 4 * size else np.uint64).astype(np.float64)
            for x, size in zip(right.column("counts"), right.column("size").to_pylist(), strict=True)])
        _, which, before, end = word_keys(texts)
        add = lambda a: np.diff(np.concatenate(([0], np.cumsum(a)))[before])
        logs, known = np.log10(counts + 1), counts > 0
        tokens = np.diff(before) + 1
        return {"n_tokens": pa.array(tokens, pa.int64()), "n_known": pa.array(add(known[which]) + int(known[end]), pa.int64()),
                "base_score": pa.array(add(logs[which]) + logs[end] - tokens * below)}

    def scored_(left: pa.Table, right: pa.Table) -> pa.Table:
        of_words, docs = pa.compute.is_valid(right.column("bucket")), _opened(left.column("docs")[0])
        texts = docs.column("text")
        logs = right.filter(pa.compute.invert(of_words)).sort_by("group").column("logs")
        logs = np.concatenate([np.frombuffer(x.as_buffer(), np.float32) for x in logs])
        return pa.table({
            "doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), **word_figures(texts, right.filter(of_words)),
            "score": pa.array(gram_scores(texts, logs, groups))})

    right = words.unionByName(answers, allowMissingColumns=True).withColumnRenamed("chunk", "to")
    return chunks.groupBy("chunk").cogroup(right.groupBy("to")).applyInArrow(
        scored_, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def scored(docs: DataFrame, held_out=None, seed: int = 1) -> DataFrame:
    """Both models' log10 probability of every text, learnt from the rows that ``held_out`` leaves.

    perplexity is that of the Pitman-Yor model, for each token.
    """
    held_out = crc_remainder(F.col("doc_id"), 7) == 2 if held_out is None else held_out
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = stage(chunked(docs, held_out), "chunks")
    buckets = max(0, math.ceil(math.log2(max(1, size / BUCKET_BYTES))))
    words, n, v = word_counts(chunks, buckets)
    groups, slots = max(8, math.ceil(size / GROUP_BYTES)), max(1, math.ceil(chunks.count() / SLOT_CHUNKS))
    wanted = stage(asked(requested(chunks, min(groups, MOST_GROUPS), slots)), "asked")
    state, upper = trained(wanted, seed)
    out = chunk_scores(chunks, words, answers_of(wanted, state, upper), n, v, min(groups, MOST_GROUPS))
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
