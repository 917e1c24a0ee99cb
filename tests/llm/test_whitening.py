"""Incremental whitening against plain eigenvectors of the covariance."""

import math

import numpy as np
import pytest

from cadenza.llm import whitening

VECS = "vec_id long, embedding array<float>, label string, text string, n int"


def spectrum_of(rows, pieces):
    parts = []
    for piece in np.array_split(rows, pieces):
        s = whitening.Spectrum.empty(rows.shape[1])
        for row in piece:
            s.add(row)
        parts.append(s)
    for other in parts[1:]:
        parts[0].merge(other)
    return parts[0]


@pytest.mark.parametrize("d, n, pieces", [(1, 9, 2), (2, 40, 3), (5, 3, 1), (16, 200, 4), (16, 12, 5)])
def test_rank_one_updates_give_the_scatter_matrix(d, n, pieces):
    rng = np.random.default_rng(d * n)
    rows = np.round(rng.normal(size=(n, d)) * 100)
    rows[:, -1] = rows[:, 0]  # equal and zero eigenvalues
    rows = np.concatenate([rows, rows[: n // 2], np.zeros((3, d))])
    s = spectrum_of(rows, pieces)
    scatter = np.cov(rows.T, bias=True).reshape(d, d) * len(rows)
    assert s.n == len(rows) and np.allclose(s.mean, rows.mean(axis=0), atol=1e-9)
    assert np.allclose(s.vectors @ np.diag(s.values) @ s.vectors.T, scatter, atol=1e-10 * abs(scatter).max() + 1e-12)
    assert np.allclose(s.vectors.T @ s.vectors, np.eye(d), atol=1e-12)


def test_secular_roots_at_close_poles():
    d = np.array([0.0, 1.0, 1.0 + 1e-9, 2.0, 50.0])
    z = np.array([0.3, 1e-6, 0.5, 0.2, 0.7])
    z /= np.linalg.norm(z)
    base, shift = whitening.secular_roots(d, z, 3.0)
    assert np.allclose(d[base] + shift, np.linalg.eigvalsh(np.diag(d) + 3.0 * np.outer(z, z)), rtol=1e-13)


def brute(rows):
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in rows], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    deviation = [int(sum((n * a - s) ** 2 for a, s in zip(r, sums))) for r in x]
    y = np.array([[float(n * a - s) / n for a, s in zip(r, sums)] for r in x])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    return n, deviation, y, values[::-1], vectors[:, ::-1]


def test_query_rows_against_plain_eigenvectors(spark):
    rng = np.random.default_rng(3)
    good = (rng.normal(size=(300, 12)) * np.linspace(0.05, 1, 12)).astype(np.float32)
    rows = [(i, v.tolist(), "x", "t", 1) for i, v in enumerate(good)]
    bad = [(900, None, "x", "t", 1), (901, [None] + [0.0] * 11, "x", "t", 1), (902, [float("nan")] * 12, None, None, 1), (903, [float("inf")] + [0.0] * 11, "", "", 1), (904, [1.0] * 3, "", "", 1), (905, [], "", "", 1), (906, [3e30] * 12, "", "", 1)]
    rows += [(None, good[5].tolist(), "", "", 1), (7, good[7].tolist(), "", "", 1)]  # a null id, a repeated row
    good = np.concatenate([good, good[5:6], good[7:8]])
    df = spark.createDataFrame(rows + bad, VECS).repartition(5)
    got = whitening.whiten(df, whitening.fit(df, width=2)).collect()
    n, deviation, y, values, vectors = brute(good.tolist())
    assert len(got) == 8 * n and {r.component for r in got} == set(range(1, 9)) and {r.n for r in got} == {n}
    assert {r.vec_id for r in got} == {*range(300), None}
    assert sorted(int(r.deviation) for r in got if r.component == 1) == sorted(deviation)
    assert all(r.identity_error <= 1e-10 for r in got)
    for k in range(8):
        mine = {r.vec_id: r for r in got if r.component == k + 1 and r.vec_id is not None}
        want = y[:300] @ vectors[:, k] / math.sqrt(values[k])
        have = np.array([mine[i].whitened for i in range(300)])
        assert min(abs(have - want).max(), abs(have + want).max()) < 1e-9
        assert abs(mine[0].explained / (values[k] / values.sum()) - 1) < 1e-10


def test_defined_results_without_variance_or_rows(spark):
    empty = spark.createDataFrame([], VECS)
    assert whitening.fit(empty) is None and whitening.whiten(empty, None).collect() == []
    null = spark.createDataFrame([(1, None, "", "", 1), (2, [], "", "", 1)], VECS)
    assert whitening.whiten(null, whitening.fit(null)).collect() == []
    same = spark.createDataFrame([(i, [0.5, 0.25], "", "", 1) for i in range(5)], VECS)
    assert whitening.whiten(same, whitening.fit(same)).collect() == []
    line = spark.createDataFrame([(i, [0.5 * i, 0.5 * i, 1.0], "", "", 1) for i in range(5)], VECS)
    got = whitening.whiten(line, whitening.fit(line)).collect()
    assert {r.component for r in got} == {1} and abs(got[0].explained - 1) < 1e-12


def test_deviation_is_exact_beyond_64_bits():
    w = whitening.Whitening(10**9, [10**14 + 7], np.ones(1), np.eye(1), 1.0)
    x = np.array([[100_000 + 5 * 10**6]])
    assert w.deviations(x) == [(10**9 * int(x[0, 0]) - 10**14 - 7) ** 2]
