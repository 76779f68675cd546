"""Whitening against a dense eigendecomposition, with ties, odd rows and the passes' own recurrence."""

import math

import numpy as np
import pytest

from tallyspark.llm import whitening

SF = "/root/testdata/sf0.001"


def brute(rows, components=4):
    """{vec_id: [(component, n, deviation, whitened, explained)]} with either sign, from the whole covariance matrix."""
    x = {i: [math.floor(256 * c) for c in v] for i, v in rows}
    fit = sorted({tuple(v) for v in x.values()})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    m = np.array(fit, float) - np.array([s / n for s in sums])
    values, vectors = np.linalg.eigh(m.T @ m / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = {}
    for i, v in x.items():
        white = (np.array(v, float) - np.array([s / n for s in sums])) @ vectors / np.sqrt(values)
        out[i] = (n, sum((n * a - s) ** 2 for a, s in zip(v, sums)), white, values / np.trace(m.T @ m / n))
    return out


def check(df, rows, components=4):
    want = brute(rows, components)
    got = {}
    for r in whitening.whitened(df, components).collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    assert set(got) == set(want)
    sign = None
    for i, (n, deviation, white, explained) in sorted(want.items()):
        mine = [got[i][c] for c in range(1, len(white) + 1)]
        assert len(got[i]) == len(white) and all((r.n, r.deviation) == (n, deviation) for r in mine)
        w = np.array([r.whitened for r in mine])
        sign = np.sign(w * white) if sign is None else sign
        assert np.allclose(w, white * sign, rtol=0, atol=1e-8)
        assert np.allclose([r.explained for r in mine], explained, rtol=1e-10) and all(r.identity_error < 1e-10 for r in mine)


def test_given_vectors(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    check(df, [(r.vec_id, r.embedding) for r in df.collect()])


def test_flat_spectrum_and_hot_copies(spark):
    """A third of the rows are one vector, which counts once; the eigenvalues are close to each other."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(48).tolist() if i % 3 else [0.5] * 48) for i in range(1800)]
    check(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), rows)


def test_few_dimensions_use_the_whole_space(spark):
    rows = [(i, [math.sin(i), i / 7, (i * i) % 11 + 0.5]) for i in range(60)]
    check(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), rows, 3)
    assert whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).count() == 180


def test_filter_is_the_chebyshev_polynomial():
    values = np.linspace(0, 10, 30)
    v = np.diag(values)
    out = whitening.filtered(lambda q: (v @ q, values.sum()), np.eye(30), 9, 6.0, 10.0)
    want = np.polynomial.chebyshev.Chebyshev.basis(9)((values - 3) / 3) / np.polynomial.chebyshev.Chebyshev.basis(9)(7 / 3)
    assert np.allclose(np.diag(out), want, atol=1e-12)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 5), i / 3, 1.0 / (i + 1), -float(i)]) for i in range(20)]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0]), (103, [nan, 0.0, 0.0, 0.0]), (104, [inf, 0.0, 0.0, 0.0]), (105, [1.0, 2.0]), (106, [1e300, 0.0, 0.0, 0.0])]
    rows = [(*r, "clash", 1) for r in [*good, good[3], (None, good[4][1]), *odd]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string, component int")
    out = whitening.whitened(df).collect()
    assert len(out) == 22 * 4 and {r.vec_id for r in out} == {*range(20), None} and {r.n for r in out} == {20}
    same = lambda k: sorted((r.component, r.deviation, round(r.whitened, 9)) for r in out if r.vec_id == k)
    assert same(3) == sorted(2 * same(3)[::2]) and same(None) == same(4)


def test_no_variance_no_rows_and_large_entries(spark):
    kind = "vec_id long, embedding array<double>"
    assert whitening.whitened(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, None)], kind)).count() == 0
    alone = whitening.whitened(spark.createDataFrame([(1, [0.5, 2.0]), (2, [0.5, 2.0])], kind)).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in alone) == [(i, c, 1, 0, None, 0.0, 0.0) for i in (1, 2) for c in (1, 2)]
    line = whitening.whitened(spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(4)], kind)).collect()
    assert {r.whitened is None for r in line if r.component == 1} == {False} and {r.whitened for r in line if r.component == 2} == {None}
    far = [(i, [float(i) * 1e12, 3.0]) for i in range(5)]
    assert {r.deviation for r in whitening.whitened(spark.createDataFrame(far, kind)).collect() if r.vec_id != 2} == {None}


def test_residuals_are_certified():
    rng = np.random.default_rng(2)
    basis = np.linalg.qr(rng.standard_normal((100, 100)))[0]
    v = basis * np.concatenate([[5, 4, 4, 3.99], np.linspace(3.9, 0, 96)]) @ basis.T  # a tie, and a gap of a few thousandths
    values, vectors, trace = whitening.leading_pairs(lambda q: (v @ q, np.trace(v)), 100, 4)
    assert np.allclose(values, [5, 4, 4, 3.99], rtol=1e-13) and np.linalg.norm(v @ vectors - vectors * values, axis=0).max() < 1e-12
    assert trace == pytest.approx(np.trace(v))
