"""Near duplicates by Order MinHash, verified by banded alignment.

A text becomes the sequence of its k-mers (``K`` consecutive words, A-Z
lower-cased; a text of fewer words is one k-mer). k-mers are labelled with their
occurrence number, so that a repeated one counts as often as it stands there.
For each of ``SKETCHES`` random orders the ``SAMPLED`` smallest labelled k-mers are
taken and kept in text order: two texts share such a sketch if they share these
k-mers in the same order, which follows edit similarity rather than set overlap.

Texts with a common sketch form a bucket. A bucket's most typical text, the one
whose sketches are the most common, is compared with all others there; links
found so join texts to components. Then every two texts of a bucket that are of
different components meet, however large the bucket is: what they have in common in
any order is counted for a block of texts at once, and those that could reach
``SIMILARITY`` by it are aligned. A bucket above ``BLOCK`` texts is cut into blocks
by length and hash, and each two blocks whose lengths allow a link meet in a task
of their own. So no pair of a bucket is left out. The price is that the counting,
some 40 ns a pair, grows with the square of a bucket that holds several components.

Two texts are linked when an alignment of their k-mer sequences matches m of na
and nb k-mers with m / (na + nb - m) >= ``SIMILARITY``. That is Jaccard similarity
with order. The band is (na + nb) / 9 wide: an alignment outside cannot reach 0.8.
Classes are the connected components of the links.

Recall: at similarity 0.8 a sketch agrees with probability of about 0.5, and at
least one of 16 does with 0.99998. Within a bucket nothing is lost.

Defined results for odd input: texts with the same words are copies; texts
without words are copies when their bytes are equal; a null text is an empty
one. ``class_id`` is the smallest id of the class, null ids left out, and null
if there is no other. Repeated rows are copies. An empty table gives an empty
one. Extra columns pass through ``deduplicated`` unread.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..staging import release, stage
from .words import fresh, hashed_words, mix, pieces, span_hashes, text_bytes

K = 5
SIMILARITY = 0.8
SKETCHES, SAMPLED = 16, 3
# Texts of a block, and its k-mers about: what a task holds twice.
BLOCK, BLOCK_KMERS = 1024, 1 << 20
# Lengths of a class differ by less than this factor; a link spans two classes more at most.
LENGTHS, SPAN = 1.12, 2
# Texts with a k-mer up to which their pairs are listed; above, they are a column of a matrix product.
LISTED, COLUMNS = 16, 1024
# Pairs listed at once, rows compared at once, and text bytes turned to k-mers at once.
LISTED_PAIRS, STRIP, TEXT_BYTES = 1 << 19, 256, 2 << 20
# Comparisons with one centre in one task.
PER_TASK = 200

_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)
_SEEDS = mix(np.arange(1, 64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def kmer_sequences(column: pa.Array, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-mers of all rows, one row at least per row, and the rows' offsets."""
    hashes, before = hashed_words(column)
    data, offsets = text_bytes(column)
    counts = np.diff(before)
    out_counts = np.maximum(counts - k + 1, 1)
    out_offsets = np.concatenate(([0], np.cumsum(out_counts)))
    out = np.empty(out_offsets[-1], np.uint64)
    if len(hashes) >= k:
        rolled = np.zeros(len(hashes) - k + 1, np.uint64)
        for i in range(k):
            rolled = mix(rolled ^ hashes[i:len(hashes) - k + 1 + i]) + np.uint64(i + 1)
        long = counts >= k
        take = np.repeat(before[:-1][long] - out_offsets[:-1][long], out_counts[long])
        at = np.repeat(long, out_counts)
        out[at] = rolled[np.flatnonzero(at) + take]
    short = np.flatnonzero(counts < k)
    if len(short):
        raw = span_hashes(data, offsets[:-1][short], offsets[1:][short])
        for j, row in enumerate(short.tolist()):
            value = raw[j:j + 1]
            if counts[row]:
                value = np.full(1, counts[row], np.uint64)
                for i in range(before[row], before[row + 1]):
                    value = mix(value ^ hashes[i:i + 1]) + np.uint64(77)
            out[out_offsets[row]] = value[0]
    return out, out_offsets


def labelled(kmers: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """k-mers with their occurrence number in the row: all different within a row."""
    if not len(kmers):
        return kmers
    rows = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(offsets))
    key = mix(kmers ^ mix(rows + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    place = np.arange(len(key))
    occurrence = np.empty(len(key), np.uint64)
    occurrence[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    return mix(kmers + occurrence * np.uint64(0xD1B54A32D192ED03))


def sketches(kmers: np.ndarray, offsets: np.ndarray, count: int = SKETCHES, sampled: int = SAMPLED) -> np.ndarray:
    """Order MinHash: for each row ``count`` hashes of ``sampled`` minimal labelled k-mers in text order."""
    rows = len(offsets) - 1
    names = labelled(kmers, offsets)
    sizes = np.diff(offsets)
    row_of = np.repeat(np.arange(rows), sizes)
    out = np.empty((rows, count), np.uint64)
    for s in range(count):
        values = mix(names ^ _SEEDS[s])
        places = np.full((rows, sampled), np.iinfo(np.int64).max)
        for j in range(sampled):
            least = np.minimum.reduceat(values, offsets[:-1])
            at = np.flatnonzero(values == least[row_of])
            at = at[values[at] != _MAX]
            where, first = np.unique(row_of[at], return_index=True)
            places[where, j] = at[first]
            values[at[first]] = _MAX
        places.sort(axis=1)
        h = np.full(rows, _SEEDS[s], np.uint64)
        for j in range(sampled):
            there = places[:, j] < len(kmers)
            h = np.where(there, mix(h ^ kmers[np.where(there, places[:, j], 0)]) + np.uint64(j), h)
        out[:, s] = mix(h)
    return out


def digests(kmers: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """128 bits that are equal for equal k-mer sequences."""
    place = np.arange(len(kmers), dtype=np.uint64) - np.repeat(offsets[:-1], np.diff(offsets)).astype(np.uint64)
    size = np.diff(offsets).astype(np.uint64)
    halves = [mix(np.add.reduceat(mix(kmers ^ mix(place + _SEEDS[40 + i])), offsets[:-1]) + size * _SEEDS[50 + i]) for i in (0, 1)]
    return np.stack(halves, axis=1)


def aligned(a: np.ndarray, b: np.ndarray) -> float:
    """m / (na + nb - m), where m is the most k-mers that an alignment within the band matches.

    Where not even the k-mers in common, in any order, reach ``SIMILARITY``, their
    own ratio is returned: it is below, and no less than that of an alignment.
    """
    na, nb = len(a), len(b)
    band = (na + nb) // 9
    both = min(na, nb)
    # Common ends are part of a best alignment.
    differs = np.flatnonzero(a[:both] != b[:both])
    head = int(differs[0]) if len(differs) else both
    left = both - head
    differs = np.flatnonzero(a[na - left:][::-1] != b[nb - left:][::-1])
    tail = int(differs[0]) if len(differs) else left
    x, y = a[head:na - tail], b[head:nb - tail]
    m = head + tail
    if len(x) and len(y):
        # No alignment matches more than the two have in common.
        ux, cx = np.unique(x, return_counts=True)
        uy, cy = np.unique(y, return_counts=True)
        _, ix, iy = np.intersect1d(ux, uy, assume_unique=True, return_indices=True)
        most = m + int(np.minimum(cx[ix], cy[iy]).sum())
        if most < SIMILARITY * (na + nb - most):
            return most / (na + nb - most)
        m += _banded(x.tolist(), y.tolist(), band)
    return m / (na + nb - m)


def _banded(x: list[int], y: list[int], band: int) -> int:
    """Length of the longest common subsequence of pairs of places at most ``band`` apart.

    A row of the alignment table is one integer: bit i is 0 where taking x[i]
    in adds a match.
    """
    places: dict[int, int] = {}
    for i, value in enumerate(x):
        places[value] = places.get(value, 0) | 1 << i
    full = (1 << len(x)) - 1
    row, window = full, (1 << (2 * band + 1)) - 1
    for j, value in enumerate(y):
        match = places.get(value, 0)
        if match:
            match &= window << (j - band) if j >= band else window >> (band - j)
            taken = row & match
            row = ((row + taken) | (row - taken)) & full
    return len(x) - row.bit_count()


def _text_key(text: str = "text") -> Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")))


def _id_key(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.col(doc_id).cast("string"), F.lit(""))


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, text key, digest of the k-mers, their number and the sketches of every row."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, size=TEXT_BYTES):
            kmers, offsets = kmer_sequences(batch.column("text"))
            marks = sketches(kmers, offsets)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("text_key"),
                pa.array([x.tobytes() for x in digests(kmers, offsets)], pa.binary()),
                pa.array(np.diff(offsets), pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(marks) + 1) * SKETCHES, pa.int32()), pa.array(marks.reshape(-1).view(np.int64))),
            ], ["doc_id", "text_key", "digest", "n", "sketches"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _text_key().alias("text_key"))
    return given.mapInArrow(rows, "doc_id long, text_key string, digest binary, n long, sketches array<long>")


def _sequences(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """k-mer sequences (32 bits each) of the ``wanted`` digests, whose text key and id are given."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, size=TEXT_BYTES):
            kmers, offsets = kmer_sequences(batch.column("text"))
            raw = pa.py_buffer(kmers.astype(np.uint32).tobytes())
            ends = pa.py_buffer((offsets * 4).astype(np.int64))
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, ends, raw])
            yield pa.RecordBatch.from_arrays([batch.column("digest"), packed.cast(pa.binary())], ["digest", "kmers"])

    texts = docs.select(_text_key().alias("text_key"), _id_key().alias("id_key"), F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(wanted, ["text_key", "id_key"]).dropDuplicates(["text_key", "id_key"])
    return found.select("digest", "text").mapInArrow(rows, "digest binary, kmers binary")


def in_common(sequences: list[np.ndarray]) -> np.ndarray:
    """How many k-mers, in any order, each two different texts have in common: no alignment matches more.

    Holds one number for each two texts, and a few MB beside.
    """
    n, sizes = len(sequences), np.array([len(x) for x in sequences])
    names = labelled(np.concatenate(sequences).astype(np.uint64), np.concatenate(([0], np.cumsum(sizes))))
    order = np.argsort(names, kind="stable")
    rows = np.repeat(np.arange(n), sizes)[order]
    first = np.flatnonzero(np.concatenate(([True], np.diff(names[order]) != 0)))
    held = np.diff(np.append(first, len(names)))
    del names, order
    out = np.zeros((n, n), np.float32)
    flat = out.reshape(-1)
    for t in range(2, min(LISTED, n) + 1):
        begin = first[held == t]
        i, j = np.triu_indices(t, 1)
        step = max(1, LISTED_PAIRS // len(i))
        for k in range(0, len(begin), step):
            who = np.sort(rows[begin[k:k + step, None] + np.arange(t)], axis=1)
            pair, times = np.unique(who[:, i] * n + who[:, j], return_counts=True)
            flat[pair] += times
    often = np.flatnonzero(held > LISTED)
    for k in range(0, len(often), COLUMNS):
        some = often[k:k + COLUMNS]
        has = np.zeros((n, len(some)), np.float32)
        for j, x in enumerate(some.tolist()):
            has[rows[first[x]:first[x] + held[x]], j] = 1
        for begin in range(0, n, STRIP):
            out[begin:begin + STRIP, begin:] += has[begin:begin + STRIP] @ has[begin:].T
    for begin in range(0, n, STRIP):  # the other half
        end = min(begin + STRIP, n)
        above = np.triu(out[begin:end, begin:end], 1)
        out[begin:end, begin:end] = above + above.T
        out[begin:end, :begin] = out[:begin, begin:end].T
    return out


def joined(sequences: list[np.ndarray], component: list, block: np.ndarray) -> list[tuple[int, int, float]]:
    """Links that join all components of these texts which a link joins; of two blocks, only links between them."""
    common, sizes = in_common(sequences), np.array([len(x) for x in sequences], np.float32)
    _, root = np.unique(component, return_inverse=True)
    two = block.any() and not block.all()
    able = []
    for begin in range(0, len(sizes), STRIP):
        held = common[begin:begin + STRIP]
        fits = held >= SIMILARITY * (sizes[begin:begin + STRIP, None] + sizes[None, :] - held) - 1e-3
        fits &= (root[begin:begin + STRIP, None] != root[None, :]) & (np.arange(begin, begin + len(held))[:, None] < np.arange(len(sizes))[None, :])
        if two:
            fits &= block[begin:begin + STRIP, None] != block[None, :]
        i, j = np.nonzero(fits)
        able.append((i + begin, j))
    x, y = (np.concatenate(c) for c in zip(*able, strict=True))
    # The most alike first, as they join the most.
    best = np.argsort(-(common[x, y] / (sizes[x] + sizes[y] - common[x, y])), kind="stable")
    out = []
    for i, j in zip(x[best].tolist(), y[best].tolist(), strict=True):
        if root[i] != root[j] and (value := aligned(sequences[i], sequences[j])) >= SIMILARITY:
            out.append((i, j, value))
            root[root == root[j]] = root[i]
    return out


def _compared(pairs: DataFrame, sequences: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with their similarity. A text of many pairs is sent to several tasks, in parts."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [aligned(np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32))
                      for x, y in zip(batch.column("kmers_a"), batch.column("kmers_b"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(values, pa.float64())], ["a", "b", "similarity"])

    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PER_TASK).cast("int").alias("parts"))
    left = sequences.withColumnsRenamed({"digest": "a", "kmers": "kmers_a"}).join(parts, "a")
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    right = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).drop("parts")
    right = right.join(sequences.withColumnsRenamed({"digest": "b", "kmers": "kmers_b"}), "b")
    return right.join(left, ["a", "part"]).select("a", "b", "kmers_a", "kmers_b").mapInArrow(rows, "a binary, b binary, similarity double")


def _ordered(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b, similarity) of digests; those at ``SIMILARITY`` or above are links, and join all that links join."""
    members = nodes.select("digest", "n", F.explode("sketches").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = stage(members.join(sizes, "bucket"), "members")
    typical = stage(members.groupBy("digest").agg(F.sum("size").alias("typical")), "typical")
    rest = stage(members.drop("size").join(typical, "digest"), "rest")
    sequences = stage(_sequences(docs, typical.join(nodes, "digest").select("digest", "text_key", "id_key")), "kmers")

    centres = rest.groupBy("bucket").agg(F.max(F.struct("typical", "digest", "n")).alias("c"))
    centres = stage(centres.select("bucket", F.col("c.digest").alias("centre"), F.col("c.n").alias("centre_n")), "centres")
    # The centre has met all others of its bucket, and leaves it.
    rays = rest.join(centres, "bucket").where(F.col("digest") != F.col("centre"))
    rays = stage(rays.select("bucket", "digest", "n", "centre", "centre_n"), "rays")
    near = F.least("n", "centre_n") >= SIMILARITY * F.greatest("n", "centre_n") - 1e-6
    pairs = stage(rays.where(near).select(*_ordered(F.col("centre"), F.col("digest"))).distinct(), "pairs")
    tested = stage(_compared(pairs, sequences), "compared")
    label = stage(components(tested.where(F.col("similarity") >= SIMILARITY).select("a", "b")), "labels")
    root = label.select(F.col("node").alias("digest"), "root")
    left = rays.select("bucket", "digest", "n").join(root, "digest", "left").withColumn("component", F.coalesce("root", "digest")).drop("root")
    found = stage(_blocks(stage(left, "left"), sequences), "met")
    release(members, typical, rest, centres, rays, pairs, label, sequences)
    return tested.unionByName(found)


def _blocks(left: DataFrame, sequences: DataFrame) -> DataFrame:
    """Links between the components of each bucket of ``left``: every two texts of different ones meet."""
    of = [F.count(F.lit(1)).alias("size"), F.sum("n").alias("kmers_in"), F.min("component").alias("low"), F.max("component").alias("high")]
    # Sketches that name the same texts make one bucket.
    same = [F.bit_xor(F.xxhash64("digest", F.lit(k))).alias(f"x{k}") for k in (0, 1)]
    buckets = left.groupBy("bucket").agg(*of, *same).where("low != high").groupBy("size", "x0", "x1").agg(F.min(F.struct("bucket", "kmers_in")).alias("one"))
    buckets = buckets.select("one.bucket", "size", "one.kmers_in")
    large = (F.col("size") > BLOCK) | (F.col("kmers_in") > BLOCK_KMERS)
    length = F.when(large, F.floor(F.log("n") / math.log(LENGTHS)).cast("int")).otherwise(0)
    dealt = left.join(buckets, "bucket").withColumn("length", length).drop("size", "kmers_in")
    cuts = dealt.groupBy("bucket", "length").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_KMERS)).cast("int").alias("cuts"))
    dealt = dealt.join(cuts, ["bucket", "length"]).withColumn("cut", F.pmod(F.xxhash64("digest", F.lit("cut")), F.col("cuts")).cast("int"))
    dealt = stage(dealt.select("bucket", "length", "cut", "digest", "component"), "dealt")
    blocks = stage(dealt.groupBy("bucket", "length", "cut").agg(of[2], of[3]), "blocks")
    x, y = (blocks.select("bucket", *(F.col(c).alias(f"{c}_{s}") for c in ("length", "cut", "low", "high"))) for s in "xy")
    two = x.join(y, "bucket").where(
        (F.struct("length_x", "cut_x") <= F.struct("length_y", "cut_y")) & (F.col("length_y") - F.col("length_x") <= SPAN)
        & (F.least("low_x", "low_y") != F.greatest("high_x", "high_y")))
    two = two.withColumn("meeting", F.xxhash64("bucket", "length_x", "cut_x", "length_y", "cut_y"))
    # A block goes to each of its meetings; one with itself is there once.
    sides = two.select("meeting", "bucket", F.explode(F.array_distinct(F.array(
        F.struct(F.col("length_x").alias("length"), F.col("cut_x").alias("cut")), F.struct(F.col("length_y").alias("length"), F.col("cut_y").alias("cut"))))).alias("at"))
    sides = sides.select("meeting", "bucket", "at.length", "at.cut")
    sent = dealt.join(sides, ["bucket", "length", "cut"]).join(sequences, "digest")

    def rows(table: pa.Table) -> pa.Table:
        digest = table.column("digest").to_pylist()
        block = np.array([table.column(c).to_numpy() for c in ("length", "cut")])
        links_ = joined([np.frombuffer(x, np.uint32) for x in table.column("kmers").to_pylist()],
                        [x.hex() for x in table.column("component").to_pylist()], (block != block[:, :1]).any(axis=0))
        pairs = [(*sorted((digest[i], digest[j])), value) for i, j, value in links_]
        a, b, values = zip(*pairs, strict=True) if pairs else ((), (), ())
        return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(values, pa.float64())], ["a", "b", "similarity"])

    return sent.select("meeting", "length", "cut", "digest", "component", "kmers").groupBy("meeting").applyInArrow(rows, "a binary, b binary, similarity double")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's connected component, for all nodes of ``edges`` (a, b).

    Large-star and small-star steps in turn: each replaces a node's links by
    links to its smallest neighbour, until every node is linked to its root only.
    """
    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not large:
            both = both.where("b < a")
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        joined = both.join(least, "a")
        out = joined.where("b > a") if large else joined.where("b != m")
        out = out.select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.unionByName(least.select("a", F.col("m").alias("b")))
        return out.where("a != b").distinct()

    def mark(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    edges = stage(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = mark(edges)
    while last[0]:
        edges = stage(star(star(edges, True), False), "edges")
        now = mark(edges)
        if now == last:
            break
        last = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _classified(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(every row's doc_id, text key and digest; for each class of more than one row: digest, class, one row to keep)."""
    rows = stage(sketched(docs), "sketched")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("one")
    nodes = rows.groupBy("digest").agg(one, F.first("n").alias("n"), F.first("sketches").alias("sketches"), F.count(F.lit(1)).alias("copies"))
    nodes = stage(nodes.select("*", F.col("one.text_key").alias("text_key"), F.coalesce(F.col("one.doc_id").cast("string"), F.lit("")).alias("id_key")), "nodes")
    found = links(docs, nodes).where(F.col("similarity") >= SIMILARITY)
    roots = components(found.select("a", "b")).withColumnRenamed("node", "digest")
    grouped = nodes.select("digest", "one", "copies").join(roots, "digest", "left")
    grouped = grouped.where((F.col("copies") > 1) | F.col("root").isNotNull()).withColumn("root", F.coalesce("root", "digest"))
    grouped = stage(grouped, "grouped")
    kept = grouped.groupBy("root").agg(F.min("one").alias("kept"))
    return rows.select("doc_id", "text_key", "digest"), stage(grouped.select("digest", "root").join(kept, "root"), "classes")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id and class_id of every document."""
    rows, groups = _classified(docs)
    out = rows.join(groups.select("digest", "kept"), "digest", "left")
    return out.select("doc_id", F.when(F.col("kept").isNull(), F.col("doc_id")).otherwise(F.col("kept.doc_id")).alias("class_id"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: the one of the smallest id."""
    rows, groups = _classified(docs)
    text_key, id_key, gone = (fresh(docs, n) for n in ("_text_key", "_id_key", "_gone"))
    member = rows.join(groups.select("digest", "kept"), "digest")
    drop = member.where(~(F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("text_key") == F.col("kept.text_key"))))
    drop = drop.select(F.col("text_key").alias(text_key), _id_key().alias(id_key), F.lit(1).alias(gone)).distinct()
    # Rows that are equal in id and text are one document.
    again = rows.groupBy(F.col("text_key").alias(text_key), _id_key().alias(id_key)).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    named = docs.withColumns({text_key: _text_key(), id_key: _id_key()})
    kept = named.join(drop.select(text_key, id_key), [text_key, id_key], "left_anti")
    if not again.isEmpty():
        kept = kept.dropDuplicates([text_key, id_key])
    return kept.drop(text_key, id_key).select(docs.columns)
