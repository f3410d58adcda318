"""Whitening against numpy on all vectors at once."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sweeplog.llm import whitening as op


def scatter(x):
    c = x - x.mean(axis=0)
    return c.T @ c


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.integers(1, 40), st.integers(0, 2**32 - 1), st.sampled_from([1, 3, 1000, 10**6]))
def test_rank_one_updates_give_the_scatter(size, n, seed, spread):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, spread + 1, size=(n, size)).astype(float) * rng.choice([0, 1, 1, 7], size=size)
    whole, left, right = op.Spectrum.empty(size), op.Spectrum.empty(size), op.Spectrum.empty(size)
    for i, v in enumerate(x):
        whole.add(v)
        (left if i % 3 else right).add(v, 2)
        (left if i % 3 else right).add(v)
    left.merge(right)
    for found, times in ((whole, 1), (left, 3)):
        want = scatter(x) * times
        scale = max(np.abs(want).max(), 1e-300)
        assert found.n == n * times and np.allclose(found.mean, x.mean(axis=0), atol=1e-9 * spread)
        assert np.abs(found.vectors * found.values @ found.vectors.T - want).max() <= 1e-11 * max(scale, spread * 1e-3)
        assert np.abs(found.vectors.T @ found.vectors - np.eye(size)).max() < 1e-11
        assert np.abs(np.sort(found.values) - np.linalg.eigvalsh(want)).max() <= 1e-11 * max(scale, spread * 1e-3)


def test_secular_roots_interlace():
    poles, weights = np.array([0.0, 1e-9, 1.0, 1.0 + 1e-12, 5.0, 1e6]), np.array([1e-20, 3.0, 1e-14, 2.0, 1e5, 1e-3])
    roots, apart = op.secular_roots(poles, weights)
    assert (roots >= poles).all() and (roots[:-1] <= poles[1:]).all()
    whole = np.linalg.eigvalsh(np.diag(poles) + np.outer(np.sqrt(weights), np.sqrt(weights)))
    assert np.allclose(roots, whole, rtol=1e-12, atol=1e-9)


def plain(vectors):
    """x, V, and exact deviations by whole-number arithmetic."""
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(col) for col in zip(*x, strict=True)]
    deviation = [sum((n * e - s) ** 2 for e, s in zip(row, sums, strict=True)) for row in x]
    c = np.array([[(n * e - s) / n for e, s in zip(row, sums, strict=True)] for row in x])
    return c, c.T @ c / n, deviation


def check(got, ids, vectors, count=8):
    c, cov, deviation = plain(vectors)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(count, len(values))
    assert sorted((r.vec_id, r.component) for r in got) == sorted((i, j + 1) for i in ids for j in range(k))
    place = {i: p for p, i in enumerate(ids)}
    for r in got:
        p, j = place[r.vec_id], r.component - 1
        assert (r.n, r.deviation) == (len(ids), deviation[p])
        assert r.explained == pytest.approx(values[j] / np.trace(cov), rel=1e-9, abs=1e-12) and r.identity_error < 1e-9
        if values[j] > 1e-9 * values[0]:
            assert abs(r.whitened) == pytest.approx(abs(c[p] @ axes[:, j]) / math.sqrt(values[j]), rel=1e-6, abs=1e-8)
        else:
            assert r.whitened is None


def test_equal_to_numpy(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(300, 20)) * np.linspace(0.05, 1, 20) + 0.3
    vectors[200:] = vectors[7]  # a third of all rows
    rows = [(i, [float(np.float32(e)) for e in v]) for i, v in enumerate(vectors)]
    got = op.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(40)).collect()
    check(got, [i for i, _ in rows], [v for _, v in rows])
    w = np.zeros((300, 8))
    for r in got:
        w[r.vec_id, r.component - 1] = r.whitened
    assert np.abs(np.cov(w.T, bias=True) - np.eye(8)).max() < 1e-9


def test_rows_that_are_no_vectors_and_other_columns(spark):
    rng = np.random.default_rng(4)
    good = [(i, [float(e) for e in v]) for i, v in enumerate(rng.normal(size=(30, 5)))]
    bad = [(90, None), (91, [1.0, None, 1.0, 1.0, 1.0]), (92, [1.0, math.nan, 1, 1, 1]), (93, [math.inf, 1.0, 1, 1, 1]), (94, []), (95, [1.0, 2.0]), (96, [1e300, 1.0, 1, 1, 1])]
    rows = [(i, v, 5, "x", None) for i, v in good + [(k, v and [e if e is None else float(e) for e in v]) for k, v in bad]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, vector string, deviation string")
    check(op.whiten(frame).collect(), [i for i, _ in good], [v for _, v in good])


def test_repeated_and_null_ids_constant_columns_and_a_single_vector(spark):
    rows = [(None, [1.0, 0.0, 2.0]), (None, [1.0, 3.0, 2.0]), (4, [1.0, 1.0, 2.0]), (4, [1.0, 1.0, 2.0])]
    got = op.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 12 and all((r.whitened is None) == (r.component > 1) for r in got) and got[0].identity_error < 1e-12
    assert sorted(round(r.explained, 9) for r in got) == [0.0] * 8 + [1.0] * 4
    alone = op.whiten(spark.createDataFrame(rows[:1], "vec_id long, embedding array<double>")).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained) for r in alone] == [(1, 0, None, None)] * 3


def test_empty_table(spark):
    assert op.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert op.whiten(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).count() == 0


def test_deviations_beyond_64_bits_are_exact():
    x = np.array([[2**40, 5, 2**41], [7, 2**39, 1]])
    for n in (3, 10**5, 10**9, 10**16):
        sums = [n * 17 + 1, n * 3, n // 2]
        got = op.Centre(n, sums).deviation(x).to_pylist()
        want = [sum((n * int(e) - s) ** 2 for e, s in zip(row, sums, strict=True)) for row in x]
        assert [None if g is None else int(g) for g in got] == [w if w < 10**38 else None for w in want]
