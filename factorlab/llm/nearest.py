"""Approximate nearest neighbours by NN-descent and greedy graph search.

Different vectors are the nodes of a graph; rows of equal vectors share one. Each node keeps
its ``NEIGHBOURS`` best others by inner product. They come first from ``FORESTS`` ways to part the nodes into
groups of about ``GROUP`` (one random, the others by the sides of random pairs of nodes), within which all are compared.
Then descent: a node's neighbours and those it is a neighbour of are likely neighbours of each
other, so each two of them, one of which is new in its list, are compared, and pairs that
improve a list enter it. Rounds end when fewer than ``SETTLED`` of all entries change.

Every round is a few joins: lists and reversed lists are dealt to parts of ``PART`` nodes, each part fetches every
vector it names once, and sends on at most ``NEIGHBOURS`` candidates a node. A node with many
reverse neighbours (a hub) is compared with as many of them as a list is long, chosen anew each
round: a sample inside the descent, not of the result; what a search finds is not limited to lists.

A search keeps the ``BEAM`` best nodes seen and asks for the neighbours of all of them
it has not asked yet, until there are none. Many queries advance together, a round being again two joins (lists, then vectors).
The best found are scored anew in double precision on the original vectors.

Size: recall falls slowly as the number of rows grows; ``BEAM`` sets it (see README for measured values).

Defined results for odd input: vectors that are null, empty, zero, or hold null or
non-finite components take no part, nor do rows of a null id or of a length other than most
vectors' (the shorter of equally frequent ones). Copies of a vector are different
candidates of equal score. Of rows with the same id each is a candidate, and a query leaves out one row of its own
id and vector; repeated query rows give equal results, once for each. Ties go to the
smaller id. Vectors of any length are read whole. Fewer than k candidates are all returned. An empty
table gives an empty one. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..staging import release, stage

NEIGHBOURS, FORESTS, GROUP = 32, 5, 1024
PART, LEAST_PARTS, QUERIES_PER_PART = 4096, 12, 256
SETTLED, MOST_ROUNDS = 0.04, 12
BEAM, RESCORED = 192, 64

GRAPH = "part int, node long, ids array<long>, scores array<float>, fresh array<boolean>"
_LISTS = (pa.list_(pa.int64()), pa.list_(pa.float32()), pa.list_(pa.bool_()))


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and v (doubles as bytes) of the rows that take part."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = column.flatten().to_numpy(zero_copy_only=False) + 0.0  # null becomes nan; -0 becomes 0
            row = np.repeat(np.arange(len(lengths)), lengths)
            fine = np.bincount(row, np.isfinite(values), len(lengths)) == lengths
            fine &= np.bincount(row, values != 0, len(lengths)) > 0
            ends = pa.py_buffer(np.concatenate(([0], 8 * np.cumsum(lengths[fine]))).astype(np.int64))
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), int(fine.sum()), [None, ends, pa.py_buffer(values[fine[row]].tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(np.flatnonzero(fine))), packed.cast(pa.binary())], ["vec_id", "v"])

    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    found = stage(given.where("vec_id IS NOT NULL").mapInArrow(rows, "vec_id long, v binary"), "usable")
    best = found.groupBy(F.length("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return found.where(F.length("v") == (best["size"] if best else 0))


def nodes(rows: DataFrame, members: int) -> DataFrame:
    """node, v and the ``members`` smallest ids (more for repeated ones: rows, not ids, count) of each different vector."""
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    first = rows.withColumn("place", place).where(F.col("place") <= members)
    out = first.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))  # at most ``members`` of them
    return stage(out.select(F.monotonically_increasing_id().alias("node"), "v", "members"), "nodes")


def _part(node: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(parts)).cast("int")


def _floats(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors (floats as bytes) as a matrix."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), -1) if raw else np.zeros((0, 0), np.float32)


def _lists(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    column = table.column(name).combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(lengths)))


def best_of(target: np.ndarray, other: np.ndarray, score: np.ndarray, k: int, held: np.ndarray) -> np.ndarray:
    """Places of the ``k`` best different others of each target, by target and score. Of repeats one stays, a ``held`` one first."""
    order = np.lexsort((~held, other, target))
    first = np.ones(len(order), bool)
    first[1:] = (target[order][1:] != target[order][:-1]) | (other[order][1:] != other[order][:-1])
    order = order[first]
    order = order[np.lexsort((other[order], -score[order], target[order]))]
    t = target[order]
    begin = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1]))) if len(t) else np.zeros(0, int)
    rank = np.arange(len(t)) - np.repeat(begin, np.diff(np.append(begin, len(t))))
    return order[rank < k]


def _candidates(target: np.ndarray, other: np.ndarray, score: np.ndarray, k: int) -> pa.Table:
    """The ``k`` best candidates of each target, a row each."""
    keep = best_of(target, other, score, k, np.zeros(len(target), bool))
    target, other, score = target[keep], other[keep], score[keep].astype(np.float32)
    begin = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1]))) if len(target) else np.zeros(0, int)
    ends = pa.array(np.append(begin, len(target)).astype(np.int32))
    return pa.table([pa.array(target[begin], pa.int64()), pa.ListArray.from_arrays(ends, pa.array(other, pa.int64())),
                     pa.ListArray.from_arrays(ends, pa.array(score, pa.float32()))], ["node", "ids", "scores"])


def _sides(vectors: DataFrame, count: int, k: int) -> DataFrame:
    """Groups (forest, cell) in which the nodes of about ``GROUP`` rows meet, with their vectors."""
    bits = max(0, math.ceil(math.log2(max(1, count / GROUP))))
    pivots = vectors.orderBy(F.xxhash64("node", F.lit("pivot"))).limit(2 * bits * (FORESTS - 1)).collect() if bits else []  # some hundred at most
    ends = np.stack([np.frombuffer(r.x, np.float32) for r in pivots]).astype(np.float64) if pivots else np.zeros((0, 1))
    one, two = ends[0::2][:len(ends) // 2], ends[1::2]
    planes, middle = (one - two).T.astype(np.float32), ((one + two) * (one - two) / 2).sum(axis=1).astype(np.float32)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            above = _floats(batch.column("x")) @ planes > middle if len(middle) else np.zeros((m, 0), bool)
            cells = [(above[:, t * bits:(t + 1) * bits] * (1 << np.arange(above[:, t * bits:(t + 1) * bits].shape[1]))).sum(axis=1) for t in range(FORESTS - 1)] if bits else []
            cells = np.stack([np.full(m, -1), *cells], axis=1).astype(np.int64)
            ends_ = pa.array(np.arange(m + 1, dtype=np.int32) * cells.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(ends_, pa.array(cells.ravel()))], ["node", "cells"])

    cells = vectors.mapInArrow(rows, "node long, cells array<long>").select("node", F.posexplode("cells").alias("forest", "cell"))
    sizes = cells.groupBy("forest", "cell").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("cuts"))
    cut = cells.join(sizes, ["forest", "cell"]).withColumn("cut", F.pmod(F.xxhash64("node", "forest"), F.col("cuts")).cast("int"))
    return cut.select("forest", "cell", "cut", "node").join(vectors, "node")


def _first(vectors: DataFrame, count: int, k: int) -> DataFrame:
    """Candidates of each node within its groups."""
    def rows(table: pa.Table) -> pa.Table:
        node, x = table.column("node").to_numpy(), _floats(table.column("x"))
        held = min(k, len(node) - 1)
        if held < 1:
            return _candidates(node[:0], node[:0], np.zeros(0, np.float32), k)
        best, score = np.empty((len(node), held), np.int64), np.empty((len(node), held), np.float32)
        for at in range(0, len(node), 512):
            s = x[at:at + 512] @ x.T
            s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
            top = np.argpartition(-s, held - 1, axis=1)[:, :held]
            best[at:at + 512], score[at:at + 512] = top, np.take_along_axis(s, top, axis=1)
        return _candidates(np.repeat(node, held), node[best.ravel()], score.ravel(), k)

    return _sides(vectors, count, k).groupBy("forest", "cell", "cut").applyInArrow(rows, "node long, ids array<long>, scores array<float>")


def _merged(graph: DataFrame, found: DataFrame, parts: int, k: int) -> DataFrame:
    """Lists of ``graph`` with the candidates that improve them; these are fresh, all others no longer."""
    def rows(table: pa.Table) -> pa.Table:
        node = table.column("node").to_numpy()
        ids, ends = _lists(table, "ids")
        scores, _ = _lists(table, "scores")
        of_graph = table.column("own").to_numpy(zero_copy_only=False).astype(bool)
        sizes = np.diff(ends)
        target, held = np.repeat(node, sizes), np.repeat(of_graph, sizes)
        keep = best_of(target, ids, scores, k, held)
        target, ids, scores, held = target[keep], ids[keep], scores[keep], held[keep]
        own = np.sort(node[of_graph])
        bounds = pa.array(np.append(np.searchsorted(target, own), len(target)).astype(np.int32))
        values = (pa.array(ids.astype(np.int64)), pa.array(scores.astype(np.float32)), pa.array(~held))
        return pa.table([pa.array(np.full(len(own), table.column("part")[0].as_py(), np.int32)), pa.array(own),
                         *(pa.ListArray.from_arrays(bounds, v) for v in values)], ["part", "node", "ids", "scores", "fresh"])

    both = graph.select("part", "node", "ids", "scores", F.lit(True).alias("own"))
    both = both.unionByName(found.select(_part("node", parts).alias("part"), "node", "ids", "scores", F.lit(False).alias("own")))
    return both.groupBy("part").applyInArrow(rows, GRAPH)


def _descended(graph: DataFrame, vectors: DataFrame, parts: int, k: int, turn: int) -> DataFrame:
    """Candidates from comparing the neighbours of every node, forward and reverse, with each other."""
    edges = graph.select("node", F.explode(F.arrays_zip("ids", "fresh")).alias("e")).select("node", "e.ids", "e.fresh")
    chosen = Window.partitionBy("ids").orderBy(F.xxhash64("node", "ids", F.lit(turn)), "node")
    back = edges.withColumn("place", F.row_number().over(chosen)).where(F.col("place") <= k)
    back = back.groupBy(F.col("ids").alias("node")).agg(F.collect_list(F.struct(F.col("node").alias("ids"), "fresh")).alias("e"))
    lists = graph.select("part", "node", "ids", "fresh").unionByName(
        back.select(_part("node", parts).alias("part"), "node", F.col("e.ids").alias("ids"), F.col("e.fresh").alias("fresh")))
    worst = graph.select("node", F.when(F.size("scores") == k, F.col("scores")[k - 1]).otherwise(F.lit(float("-inf")).cast("float")).alias("worst"))
    named = lists.select("part", F.explode("ids").alias("node")).distinct().join(vectors, "node").join(worst, "node").select(F.col("part").alias("to"), "node", "x", "worst")

    def rows(left: pa.Table, right: pa.Table) -> pa.Table:
        ref = right.column("node").to_numpy()
        order = np.argsort(ref)
        ref, x, worst_ = ref[order], _floats(right.column("x"))[order], right.column("worst").to_numpy()[order]
        ids, ends = _lists(left, "ids")
        fresh = _lists(left, "fresh")[0].astype(bool)
        at = np.searchsorted(ref, ids)
        whose = left.column("node").to_numpy()
        by_node = np.argsort(whose, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], np.diff(whose[by_node]) != 0)))
        out, held = [], []
        for begin, end in zip(starts, np.append(starts[1:], len(whose)), strict=True):
            own = by_node[begin:end]
            b = np.concatenate([at[ends[i]:ends[i + 1]] for i in own])
            new = b[np.concatenate([fresh[ends[i]:ends[i + 1]] for i in own])]
            if not len(new):
                continue
            s = x[new] @ x[b].T
            apart = new[:, None] != b[None, :]
            for side, (i, j) in enumerate((np.nonzero(apart & (s > worst_[new][:, None])), np.nonzero(apart & (s > worst_[b][None, :])))):
                held.append((b[j], new[i], s[i, j]) if side else (new[i], b[j], s[i, j]))
            if len(held) >= 512:
                out.append(_best(held, k))
                held = []
        out += [_best(held, k)] if held else []
        t, o, s = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (ref[:0].astype(int), ref[:0].astype(int), np.zeros(0, np.float32))
        return _candidates(ref[t], ref[o], s, k)

    def _best(held: list, k_: int) -> tuple:
        t, o, s = (np.concatenate(c) for c in zip(*held, strict=True))
        keep = best_of(t, o, s, k_, np.zeros(len(t), bool))
        return t[keep], o[keep], s[keep]

    return lists.groupBy("part").cogroup(named.groupBy("to")).applyInArrow(rows, "node long, ids array<long>, scores array<float>")


def built(vectors: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """The graph of ``vectors`` (node, x: floats as bytes): for each node its best neighbours, best first."""
    count = vectors.count()
    parts = max(LEAST_PARTS, math.ceil(count / PART))
    none = vectors.select(_part("node", parts).alias("part"), "node", F.array().cast("array<long>").alias("ids"), F.array().cast("array<float>").alias("scores"))
    graph = stage(_merged(none, _first(vectors, count, neighbours), parts, neighbours), "graph")
    for turn in range(MOST_ROUNDS):
        if count <= GROUP:  # the random group held all nodes: the lists are exact
            break
        after = stage(_merged(graph, _descended(graph, vectors, parts, neighbours, turn), parts, neighbours), "graph")
        release(graph)
        graph = after
        changed, entries = graph.agg(F.sum(F.size(F.filter("fresh", lambda f: f))), F.sum(F.size("ids"))).first()
        if (changed or 0) <= SETTLED * (entries or 0):
            break
    return graph


BEAMS = "part int, query long, x binary, ids array<long>, scores array<float>, asked array<boolean>"


def searched(graph: DataFrame, vectors: DataFrame, starts: DataFrame, beam: int = BEAM) -> DataFrame:
    """(part, query, x, ids, scores) of the best nodes for each of ``starts`` (query, x, ids: nodes to begin from)."""
    def rows(left: pa.Table, right: pa.Table) -> pa.Table:
        is_list = right.column("x").is_null().to_numpy(zero_copy_only=False)
        lists, vecs = right.filter(pa.array(is_list)), right.filter(pa.array(~is_list))
        ref = vecs.column("node").to_numpy()
        order = np.argsort(ref)
        ref, x = ref[order], _floats(vecs.column("x"))[order]
        asked_node = lists.column("node").to_numpy()
        near, near_ends = _lists(lists, "ids")
        by_node = np.argsort(asked_node)
        asked_node = asked_node[by_node]
        ids, ends = _lists(left, "ids")
        scores, _ = _lists(left, "scores")
        asked = _lists(left, "asked")[0].astype(bool)
        q = _floats(left.column("x"))
        out_ids, out_scores, out_asked, sizes = [], [], [], [0]
        for r in range(left.num_rows):
            own, s, done = ids[ends[r]:ends[r + 1]], scores[ends[r]:ends[r + 1]], asked[ends[r]:ends[r + 1]]
            rows_ = by_node[np.searchsorted(asked_node, own[~done])]
            seen = np.unique(np.concatenate([near[near_ends[i]:near_ends[i + 1]] for i in rows_])) if len(rows_) else own[:0]
            seen = seen[~np.isin(seen, own)]
            own, s = np.concatenate((own, seen)), np.concatenate((s, x[np.searchsorted(ref, seen)] @ q[r] if len(seen) else s[:0]))
            done = np.concatenate((np.ones(len(done), bool), np.zeros(len(seen), bool)))
            best = np.lexsort((own, -s))[:beam]
            out_ids.append(own[best])
            out_scores.append(s[best])
            out_asked.append(done[best])
            sizes.append(len(best))
        bounds = pa.array(np.cumsum(sizes).astype(np.int32))
        values = [np.concatenate(c) if c else np.zeros(0) for c in (out_ids, out_scores, out_asked)]
        arrays = [pa.ListArray.from_arrays(bounds, pa.array(v, kind.value_type)) for v, kind in zip(values, _LISTS, strict=True)]
        return pa.table([*(left.column(c) for c in ("part", "query", "x")), *arrays], ["part", "query", "x", "ids", "scores", "asked"])

    parts = max(LEAST_PARTS, math.ceil(starts.count() / QUERIES_PER_PART))
    state = starts.select(_part("query", parts).alias("part"), "query", "x", "ids",
                          F.transform("ids", lambda i: F.lit(float("-inf")).cast("float")).alias("scores"), F.transform("ids", lambda i: F.lit(False)).alias("asked"))
    state = stage(state, "beams")
    near = graph.select("node", "ids")
    while True:
        open_ = state.select("part", F.explode(F.arrays_zip("ids", "asked")).alias("e")).where("NOT e.asked").select("part", F.col("e.ids").alias("node")).distinct()
        lists = stage(open_.join(near, "node").select("part", "node", "ids"), "lists")
        if lists.isEmpty():
            release(lists)
            return state
        named = lists.select("part", F.explode("ids").alias("node")).distinct().join(vectors, "node")
        right = lists.select(F.col("part").alias("to"), "node", "ids", F.lit(None).cast("binary").alias("x")).unionByName(
            named.select(F.col("part").alias("to"), "node", F.lit(None).cast("array<long>").alias("ids"), "x"))
        after = stage(state.groupBy("part").cogroup(right.groupBy("to")).applyInArrow(rows, BEAMS), "beams")
        release(state, lists)
        state = after


def _scored(beams: DataFrame, index: DataFrame, rescored: int, k: int) -> DataFrame:
    """(query, found): for each query node the k + 1 nearest rows (score, vec_id), by score and id, in double precision."""
    wanted = beams.select("part", "query", F.slice("ids", 1, rescored).alias("ids"))
    asked = wanted.select("part", F.explode(F.concat("ids", F.array("query"))).alias("node")).distinct().join(index, "node").select(F.col("part").alias("to"), "node", "v", "members")

    def rows(left: pa.Table, right: pa.Table) -> pa.Table:
        ref = right.column("node").to_numpy()
        order = np.argsort(ref)
        ref = ref[order]
        raw = right.column("v").to_pylist()
        v = np.stack([np.frombuffer(raw[i]) for i in order])
        members, bounds = _lists(right, "members")
        ids, ends = _lists(left, "ids")
        query = left.column("query").to_numpy()
        out, scores, sizes = [], [], [0]
        for r in range(left.num_rows):
            at = np.searchsorted(ref, np.unique(np.append(ids[ends[r]:ends[r + 1]], query[r])))
            s = np.array([math.fsum(p) for p in v[at] * v[np.searchsorted(ref, query[r])]])
            rows_ = [members[bounds[order[i]]:bounds[order[i] + 1]] for i in at]
            who, s = np.concatenate(rows_), np.repeat(s, [len(m) for m in rows_])
            best = np.lexsort((who, -s))[:k + 1]
            out.append(who[best])
            scores.append(s[best])
            sizes.append(len(best))
        ends_ = pa.array(np.cumsum(sizes).astype(np.int32))
        return pa.table([left.column("query"), pa.ListArray.from_arrays(ends_, pa.array(np.concatenate(out), pa.int64())),
                         pa.ListArray.from_arrays(ends_, pa.array(np.concatenate(scores), pa.float64()))], ["query", "ids", "scores"])

    return wanted.groupBy("part").cogroup(asked.groupBy("to")).applyInArrow(rows, "query long, ids array<long>, scores array<double>")


def neighbours(vectors: DataFrame, k: int = 20, every: int = 20, vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: the ``k`` nearest rows of each row whose id is divisible by ``every``."""
    rows = usable(vectors, vector)
    index = nodes(rows, k + 1)

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [np.frombuffer(v).astype(np.float32).tobytes() for v in batch.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(x, pa.binary())], ["node", "x"])

    points = stage(index.select("node", "v").mapInArrow(single, "node long, x binary"), "points")
    graph = built(points)
    asked = stage(rows.where(F.col("vec_id") % every == 0).join(index.select("node", "v"), "v").select("vec_id", "node"), "asked")
    starts = asked.select(F.col("node").alias("query")).distinct()
    starts = starts.join(points.withColumnRenamed("node", "query"), "query").select("query", "x", F.array("query").alias("ids"))
    found = _scored(searched(graph, points, starts), index, RESCORED, k)
    each = asked.join(found.withColumnRenamed("query", "node"), "node")
    # The query's own row is left out where it is among the nearest; else one too many was found.
    own = F.coalesce(F.array_position("ids", F.col("vec_id")), F.lit(0))
    pairs = F.arrays_zip(F.col("ids").alias("vec_id"), F.col("scores").alias("score"))
    kept = F.slice(F.when(own > 0, F.concat(F.slice(pairs, 1, own.cast("int") - 1), F.slice(pairs, own.cast("int") + 1, k + 1))).otherwise(pairs), 1, k)
    out = each.select(F.col("vec_id").alias("query_id"), F.posexplode(kept).alias("place", "hit"))
    return out.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
