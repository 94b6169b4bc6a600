"""Embedding whitening by Chebyshev-filtered subspace iteration.

Vectors are scaled to whole numbers, so that counts and sums are exact. The leading
eigenvectors of their covariance V are found without forming it: every step is one
pass over the vectors, in which each task centres its rows, multiplies them with the current block Q and
sends one sum of Xᵀ(XQ). A Chebyshev polynomial of V, built by its three-term recurrence
from such passes, damps the spectrum between its beginning (by a few Lanczos steps) and the smallest Ritz value of the
block; QR and Rayleigh-Ritz follow. This goes on until each wanted pair has a residual ||Vq - eq|| below
``TOLERANCE`` of the largest eigenvalue (the certificate), or until rounding stops it short of that.

The block has ``EXTRA`` columns more than components are wanted; a block of all dimensions is
exact at once. What a task sends is the size of the block; beyond ``DIRECT`` tasks
these sums are added up in groups before they reach the driver.

Defined results for odd input: a vector that is null, empty, or holds null or
non-finite entries is dropped; so is one with an entry beyond ``LARGEST`` in size, and one of another
length than most (the shorter of equally frequent ones). Null and repeated ids stay, each row for itself.
Components are unit vectors of rising number and falling eigenvalue; those whose eigenvalue
is zero to rounding (``FLAT`` of the trace) cannot be whitened and have no rows, so that equal vectors, or a
single one, give an empty result. Vectors of fewer dimensions than components have as many components as dimensions.
``deviation`` is exact, and null where it exceeds a long. Equal eigenvalues share a subspace, of
which some orthonormal basis is returned. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..staging import stage

COMPONENTS, EXTRA = 8, 16
SCALE, SHIFT, LARGEST = 1024, 100_000, 2.0 ** 40
DEGREE, ROUNDS, LANCZOS = 10, 60, 8
TOLERANCE, ENOUGH, FLAT = 1e-14, 1e-10, 1e-13
# Sums of so many tasks are added up by the driver.
DIRECT = 64
# Rows multiplied at once.
ROWS = 4096


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a list column: the usable rows, their entries as doubles back to back, and their lengths."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    entries = column.flatten()
    values = entries.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null becomes nan
    bad = ~(np.abs(values) <= LARGEST)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    usable = (lengths > 0) & (np.bincount(rows[bad], minlength=len(lengths)) == 0)
    return np.flatnonzero(usable), values[usable[rows]], lengths[usable]


def scaled(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, length and x (whole numbers, as bytes of longs) of the usable rows."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            used, values, lengths = _vectors(batch.column("vector"))
            x = np.floor(SCALE * values).astype(np.int64) + SHIFT
            ends = pa.py_buffer(np.concatenate(([0], 8 * np.cumsum(lengths))).astype(np.int64))
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(used), [None, ends, pa.py_buffer(x.tobytes())])
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(used)), pa.array(lengths.astype(np.int32)), packed.cast(pa.binary())], ["vec_id", "length", "x"])

    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    return given.mapInArrow(rows, "vec_id long, length int, x binary")


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("x").to_pylist()), np.int64).reshape(-1, d)


@dataclass(frozen=True)
class Centre:
    n: int
    sums: np.ndarray  # int64

    def apart(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: the whole part of the mean is taken off exactly."""
        whole, rest = np.divmod(self.sums, self.n)
        return (x - whole) - rest / self.n

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Exact sums of (n x - S)²; objects where they do not fit a long."""
        whole, rest = np.divmod(self.sums, self.n)
        largest = float(self.n) * (np.abs(x - whole).max(initial=0) + 1.0)
        if largest * largest * x.shape[1] < 2.0 ** 63:
            return ((self.n * (x - whole) - rest) ** 2).sum(axis=1)
        exact = ((self.n * (x - whole).astype(object) - rest.astype(object)) ** 2).sum(axis=1)
        return np.array([v if v < 1 << 63 else None for v in exact], object)


def centred(x: DataFrame) -> tuple[DataFrame, Centre | None]:
    """The rows of the commonest length, and their number and exact sums."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            for d in np.unique(lengths).tolist():
                rows = _matrix(batch.filter(pa.array(lengths == d)), d)
                held = found.setdefault(d, [0, np.zeros(d, np.int64)])
                held[0] += len(rows)
                held[1] += rows.sum(axis=0)
            if len(found) > 256:
                yield _table(found)
                found = {}
        yield _table(found)

    def _table(found: dict[int, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array(list(found), pa.int32()), pa.array([n for n, _ in found.values()], pa.int64()),
            pa.array([s.tolist() for _, s in found.values()], pa.list_(pa.int64()))], ["length", "n", "sums"])

    parts = stage(x.select("length", "x").mapInArrow(sums, "length int, n long, sums array<long>"), "sums")
    best = parts.groupBy("length").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "length").first()
    if best is None:
        return x, None
    kept = parts.where(F.col("length") == best.length).select(F.posexplode("sums").alias("p", "s")).groupBy("p").agg(F.sum("s").alias("s"))
    by_place = {r.p: r.s for r in kept.collect()}  # one number a dimension
    return x.where(F.col("length") == best.length), Centre(best.n, np.array([by_place[p] for p in range(best.length)], np.int64))


def summed(x: DataFrame, d: int, of: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...], tasks: int) -> np.ndarray:
    """Sum over all rows of what ``of`` returns for a few thousand of them, in one pass of ``tasks`` tasks."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            rows = _matrix(batch, d)
            for k in range(0, len(rows), ROWS):
                total += of(rows[k:k + ROWS])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sum"])

    def add(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("task").to_numpy(), kind="stable")
        values = table.column("sum").to_pylist()
        total = sum(np.frombuffer(values[k]) for k in order)
        return pa.table([table.column("task").slice(0, 1), pa.array([total.tobytes()], pa.binary())], ["task", "sum"])

    parts = x.select("x").mapInArrow(part, "sum binary").withColumn("task", F.spark_partition_id())
    if tasks > DIRECT:
        groups = int(tasks ** 0.5)
        parts = parts.groupBy(F.pmod("task", F.lit(groups)).alias("g")).applyInArrow(add, "task int, sum binary")
    found = sorted((r.task, bytes(r.sum)) for r in parts.select("task", "sum").collect())
    return sum((np.frombuffer(s) for _, s in found), np.zeros(int(np.prod(shape)))).reshape(shape)


@dataclass(frozen=True)
class Spectrum:
    values: np.ndarray  # falling
    vectors: np.ndarray  # columns
    residuals: np.ndarray
    trace: float
    passes: int


def floor_of(multiply: Callable[[np.ndarray], np.ndarray], start: np.ndarray, steps: int) -> float:
    """Where the spectrum begins, from a few Lanczos steps: the smallest Ritz value less the last remainder.

    Only the speed of the filter depends on it, not the certificate.
    """
    basis, alpha, beta = [start / np.linalg.norm(start)], [], []
    for _ in range(min(steps, len(start))):
        w = multiply(basis[-1][:, None])[:, 0]
        alpha.append(float(w @ basis[-1]))
        held = np.stack(basis, axis=1)
        for _ in range(2):
            w = w - held @ (held.T @ w)
        beta.append(float(np.linalg.norm(w)))
        if beta[-1] <= 1e-13 * abs(alpha[0]):
            break
        basis.append(w / beta[-1])
    ritz = np.linalg.eigvalsh(np.diag(alpha) + np.diag(beta[:len(alpha) - 1], 1) + np.diag(beta[:len(alpha) - 1], -1))
    return max(0.0, float(ritz[0]) - beta[len(alpha) - 1])


def filtered(multiply: Callable[[np.ndarray], np.ndarray], q: np.ndarray, vq: np.ndarray, low: float, high: float, top: float, degree: int) -> np.ndarray:
    """A Chebyshev polynomial of V times Q that is small on [low, high] and 1 at ``top``."""
    middle, half = (high + low) / 2, (high - low) / 2
    sigma = first = half / (top - middle)
    last, now = q, (vq - middle * q) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        last, now = now, (multiply(now) - middle * now) * (2 * after / half) - sigma * after * last
        sigma = after
    return now


def leading(multiply: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, trace: float, seed: int = 12) -> Spectrum:
    """The ``wanted`` largest eigenpairs of the matrix that ``multiply`` applies, certified by their residuals."""
    block = min(d, wanted + EXTRA)
    passes = 0

    def counted(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return multiply(q)

    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, block)))[0]
    floor = floor_of(counted, q.sum(axis=1), LANCZOS) if block < d else 0.0
    best, stuck = np.inf, 0
    for _ in range(ROUNDS):
        vq = counted(q)
        h = q.T @ vq
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        residuals = np.linalg.norm(vq - q * values, axis=0)[:wanted]
        worst = residuals.max() / values[0] if values[0] > 0 else 0.0
        stuck = stuck + 1 if worst > best / 2 else 0
        best = min(best, worst)
        if worst <= TOLERANCE or block == d or (stuck >= 2 and best <= ENOUGH):
            return Spectrum(values[:wanted], q[:, :wanted], residuals, trace, passes)
        # The damped part of the spectrum ends at the block's smallest value.
        high = min(max(values[-1], 1e-12 * values[0]), (1 - 1e-9) * values[0])
        q = np.linalg.qr(filtered(counted, q, vq, min(floor, high - 1e-9 * values[0]), high, values[0], DEGREE))[0]
    raise ArithmeticError(f"largest residual {best:.3g} after {passes} passes")


def spectrum(x: DataFrame, centre: Centre, wanted: int) -> Spectrum:
    d, n, tasks = len(centre.sums), centre.n, x.rdd.getNumPartitions()
    trace = float(summed(x, d, lambda rows: (centre.apart(rows) ** 2).sum(axis=0), (d,), tasks).sum()) / n

    def multiply(q: np.ndarray) -> np.ndarray:
        def of(rows: np.ndarray) -> np.ndarray:
            apart = centre.apart(rows)
            return apart.T @ (apart @ q)
        return summed(x, d, of, q.shape, tasks) / n

    return leading(multiply, d, min(wanted, d), trace) if trace > 0 else Spectrum(np.zeros(0), np.zeros((d, 0)), np.zeros(0), 0.0, 0)


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of each usable row and component."""
    x, centre = centred(stage(scaled(vectors, vector), "scaled"))
    found = spectrum(x, centre, components) if centre else None
    kept = int((found.values > FLAT * found.trace).sum()) if found else 0
    if not kept:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    d, n = len(centre.sums), centre.n
    turn = found.vectors[:, :kept] / np.sqrt(found.values[:kept])
    explained = found.values[:kept] / found.trace

    def moments(rows: np.ndarray) -> np.ndarray:
        z = centre.apart(rows) @ turn
        return np.vstack((z.T @ z, z.sum(axis=0)))

    both = summed(x, d, moments, (kept + 1, kept), x.rdd.getNumPartitions()) / n
    error = float(np.abs(both[:-1] - np.outer(both[-1], both[-1]) - np.eye(kept)).max())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = _matrix(batch, d)
            z = centre.apart(each) @ turn
            m = len(each)
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), kept))),
                pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), m)), pa.array(np.full(m * kept, n)),
                pa.array(np.repeat(centre.deviations(each), kept), pa.int64()), pa.array(z.ravel()),
                pa.array(np.tile(explained, m)), pa.array(np.full(m * kept, error)),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.select("vec_id", "x").mapInArrow(rows, SCHEMA)
