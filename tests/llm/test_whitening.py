"""Whitening against dense linear algebra, and exact integer sums."""

import math

import numpy as np
import pytest

from jobsift.llm import whitening as W
from jobsift.llm.blocks import importable

SCHEMA = "vec_id long, embedding array<double>, n string, whitened int, x string, label int"


def table(spark, vectors):
    importable(spark)
    return spark.createDataFrame([(i, v, "a", 1, "b", 0) for i, v in vectors], SCHEMA)


@pytest.mark.parametrize("d, rank", [(1, 1), (2, 2), (7, 7), (7, 3), (33, 33), (40, 5)])
def test_factor_and_rotations(d, rank):
    rng = np.random.default_rng(d)
    m = rng.normal(size=(d, rank)) * 10.0 ** rng.integers(-3, 3, size=rank)
    v = m @ m.T
    factor = W.pivoted_cholesky(v)
    assert factor.shape == (d, rank) and np.allclose(factor @ factor.T, v, rtol=1e-10, atol=1e-12 * v.max())
    values, vectors = W.principal(v)
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:rank], rtol=1e-8, atol=1e-13 * v.max())
    assert np.allclose(vectors @ vectors.T, np.eye(rank), atol=1e-12)
    assert np.allclose(vectors.T * values @ vectors, v, atol=1e-11 * v.max())


def test_no_variance_has_no_component():
    values, vectors = W.principal(np.zeros((3, 3)))
    assert len(values) == 0 and vectors.shape == (0, 3)


def test_rounds_meet_every_pair_once():
    for n in range(1, 10):
        met = [frozenset(p) for i, j in W._rounds(n) for p in zip(i.tolist(), j.tolist())]
        assert len(met) == len(set(met)) == n * (n - 1) // 2
        assert all(len({*i.tolist(), *j.tolist()}) == 2 * len(i) for i, j in W._rounds(n))


def brute(vectors):
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in vectors
            if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[n * a - s for a, s in zip(x, sums)] for x in fit], object)
    v = np.array([[int(p) for p in row] for row in y.T @ y], object)  # exact: n ** 3 times V
    values, vectors_ = np.linalg.eigh((v / n ** 3).astype(float))
    return kept, n, sums, values[::-1], vectors_[:, ::-1].T


def check(rows, vectors):
    kept, n, sums, values, directions = brute(vectors)
    assert len(rows) == len(kept)
    by_id = {}
    for r in rows:
        by_id.setdefault(r.vec_id, []).append(r)
    for i, x in kept:
        r = by_id[i].pop()
        assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums))
        assert np.allclose(r.explained, values[:len(r.explained)] / values.sum(), rtol=1e-9)
        want = [float(np.dot([(n * a - s) / n for a, s in zip(x, sums)], q)) / math.sqrt(e)
                for q, e in zip(directions, values[:len(r.whitened)])]
        assert np.allclose(np.abs(r.whitened), np.abs(want), atol=1e-7)
        assert r.identity_error < 1e-9


@pytest.mark.parametrize("offset", [0.0, 3.7, 1e6])
def test_whitened_equals_brute_force(spark, offset):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 6)) * [5, 3, 2, 1, 0.7, 0.2] + offset
    vectors = [(i, v.tolist()) for i, v in enumerate(base)]
    vectors += [(300 + i, base[7].tolist()) for i in range(150)]  # copies are fitted once
    vectors += [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [math.nan] * 6), (903, [math.inf] + [0.0] * 5)]
    rows = W.whiten(table(spark, vectors)).collect()
    check(rows, vectors)
    w = np.array([r.whitened for r in rows if r.vec_id < 300])
    assert w.shape == (300, 4) and np.allclose(np.cov(w.T, bias=True), np.eye(4), atol=1e-9)


def test_few_directions_and_other_lengths(spark):
    flat = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, 2.0]), (None, [4.0, 2.0]), (3, [1.0]), (4, []), (5, [1e300, 1.0])]
    rows = W.whiten(table(spark, flat)).collect()
    assert sorted((r.vec_id for r in rows), key=str) == [1, 1, 2, None] and all(len(r.whitened) == 1 for r in rows)
    assert all(r.n == 3 and abs(r.explained[0] - 1) < 1e-12 for r in rows)
    same = W.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.n, r.deviation, r.whitened) for r in same] == [(1, 0, []), (1, 0, [])]
    for none in ([], [(1, None)]):
        assert W.whiten(table(spark, none)).collect() == []


def test_deviations_beyond_a_long():
    m = W.Whitening(3, (0, 3), 0.0, np.zeros(0), np.zeros((0, 2)))
    assert m.deviations(np.array([[1 << 40, 1], [1, 1]])) == [(3 << 40) ** 2, 9]


def test_all_vectors_of_the_table(spark):
    from jobsift.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    vectors = [(r.vec_id, [float(c) for c in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(W.whiten(spark.read.parquet(f"{sf}/embeddings.parquet")).collect(), vectors)
    rows = QUERIES["op12_whitened_embeddings"](spark, sf)
    assert rows.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert rows.count() == 4 * len(vectors)
