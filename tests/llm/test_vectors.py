"""Whitening against a dense eigensolver, and nearest neighbours against all pairs."""

import math

import numpy as np
import pytest

from factorlab.llm import nearest, whitening
from tests.llm.rows import MEDIUM

NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, embedding array<float>, label int, node string, n string, part string, query string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0, "x", "x", "x", "x") for i, v in rows], VECTORS)


def mixed(dims, count, seed):
    rng = np.random.default_rng(seed)
    return [(i, v.astype(np.float32).tolist()) for i, v in enumerate(rng.standard_normal((count, dims)) * np.linspace(2, 0.1, dims) + 3)]


BAD = [(900, None), (901, []), (902, [NAN] * 12), (903, [None] * 12), (904, [INF] + [1.0] * 11), (905, [1.0] * 5), (906, [1e30] * 12)]


def dense(vectors):
    x = np.floor(1024 * np.array(vectors, np.float32).astype(np.float64)) + 100_000
    apart = x - x.mean(axis=0)
    values, turn = np.linalg.eigh(apart.T @ apart / len(x))
    return x, apart, values[::-1], turn[:, ::-1]


def test_whitening_equals_dense_eigenvectors(spark):
    rows = mixed(12, 400, 1)
    rows += [(5, rows[5][1]), (None, rows[6][1])]
    got = whitening.whitened(table(spark, rows + BAD)).toPandas()
    x, apart, values, turn = dense([v for _, v in rows])
    n, sums = len(x), x.sum(axis=0)
    assert len(got) == 8 * n and (got.n == n).all() and got.identity_error.iloc[0] < 1e-9
    got["copy"] = got.groupby(["vec_id", "component"], dropna=False).cumcount()
    got = got.sort_values(["vec_id", "copy", "component"], na_position="last")
    of = sorted(range(n), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    want = (apart @ turn[:, :8] / np.sqrt(values[:8]))[of]
    mine = got.whitened.to_numpy().reshape(n, 8)
    assert np.allclose(mine * np.sign((mine * want).sum(axis=0)), want, atol=1e-9)
    assert np.allclose(got.explained.to_numpy()[:8], values[:8] / values.sum(), rtol=1e-12)
    assert got.deviation.tolist()[::8] == [int(d) for d in ((n * x - sums) ** 2).sum(axis=1)[of]]


def test_whitening_of_few_dimensions_and_flat_tables(spark):
    rows = mixed(3, 50, 2)
    assert whitening.whitened(table(spark, rows)).count() == 150
    assert whitening.whitened(table(spark, [(k, [1.0, 2.0]) for k in range(9)])).count() == 0
    assert whitening.whitened(table(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.whitened(table(spark, BAD[:5])).count() == 0
    flat = [(i, [v[0], 7.0, v[1]]) for i, v in rows]
    assert {r.component for r in whitening.whitened(table(spark, flat)).collect()} == {1, 2}


def test_deviation_beyond_a_long():
    centre = whitening.Centre(1 << 31, np.array([7, 9]))
    assert centre.deviations(np.array([[1 << 20, 0]])).tolist() == [None]
    small = whitening.Centre(3, np.array([7, 9]))
    assert small.deviations(np.array([[5, 2]])).tolist() == [(15 - 7) ** 2 + (6 - 9) ** 2]


@pytest.mark.parametrize("spread", ["decay", "tight", "equal"])
def test_certified_spectrum(spread):
    rng = np.random.default_rng(7)
    values = {"decay": np.linspace(3, 0, 80) ** 2, "tight": 1 + 1e-3 * np.linspace(1, 0, 80), "equal": np.ones(80)}[spread]
    turn = np.linalg.qr(rng.standard_normal((80, 80)))[0]
    v = turn * values @ turn.T
    found = whitening.leading(lambda q: v @ q, 80, 8, values.sum())
    assert np.allclose(found.values, values[:8], rtol=1e-12)
    assert (found.residuals <= 1e-10 * values[0]).all()
    if spread == "decay":
        assert np.abs((found.vectors * turn[:, :8]).sum(axis=0)).min() > 1 - 1e-12


def brute(rows, k, every):
    use = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows]
    out = []
    for a, (i, x) in enumerate(use):
        if i % every == 0:
            score = sorted(((-math.fsum(x * y), j) for b, (j, y) in enumerate(use) if b != a))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(score)]
    return sorted(out)


ODD_VECTORS = [(900, None), (920, []), (940, [NAN] * 8), (960, [None] * 8), (980, [INF] + [1.0] * 7), (1000, [1.0] * 5), (1020, [0.0] * 8), (None, [9.0] * 8)]


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((500, 8)).astype(np.float32))]
    # Copies in numbers beyond k, ties, and an id that comes twice.
    rows += [(500 + i, rows[40][1]) for i in range(60)] + [(700 + i, rows[i][1]) for i in range(30)] + [(20, rows[20][1]), (60, rows[61][1])]
    got = nearest.neighbours(table(spark, rows + ODD_VECTORS)).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute(rows, 20, 20)


def test_nearest_of_few_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])]
    assert [(r.query_id, r["rank"], r.vec_id) for r in nearest.neighbours(table(spark, rows)).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert nearest.neighbours(table(spark, rows[:1])).count() == 0
    assert nearest.neighbours(table(spark, ODD_VECTORS)).count() == 0


def test_recall_of_the_descent(spark, monkeypatch):
    """Small groups, so that the lists come from descent and the results from the search."""
    monkeypatch.setattr(nearest, "GROUP", 64)
    vectors = spark.read.parquet(f"{MEDIUM.replace('0.01', '0.1')}/embeddings.parquet")
    rows = sorted((r.vec_id, list(r.embedding)) for r in vectors.collect())
    got = {}
    for r in nearest.neighbours(vectors).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    x = np.array([v for _, v in rows], np.float64)
    hits = 0
    for i, (vec_id, _) in enumerate(rows):
        if vec_id % 20 == 0:
            s = x @ x[i]
            s[i] = -np.inf
            best = set(np.array([v for v, _ in rows])[np.lexsort((np.arange(len(s)), -s))[:20]].tolist())
            hits += len(best & set(got[vec_id]))
            assert len(got[vec_id]) == 20 and all(abs(x[j] @ x[i] - v) < 1e-12 for j, v in got[vec_id].items())
    assert hits >= 0.95 * 20 * len(got) and len(got) == 100
