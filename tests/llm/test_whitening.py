"""Whitening against exact fractions and numpy's eigenvectors."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tracelake.llm import whitening as wh

ROWS = "vec_id long, embedding array<float>, label int"


def vectors(seed=3, n=120, d=6):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(d, d))
    rows = [(k, [float(np.float32(v)) for v in rng.normal(size=d) @ mix * 3 + 5], k % 3) for k in range(n)]
    return rows


def whole(rows, d):
    keep = [r for r in rows if r[1] is not None and len(r[1]) == d and all(v is not None and math.isfinite(v) for v in r[1])]
    return keep, [[math.floor(Fraction(v) * 64) + 1_000_000 for v in r[1]] for r in keep]


@pytest.mark.parametrize("parts", [1, 5])
def test_whitening_equals_plain_computation(spark, parts):
    d, rows = 6, vectors()
    rows += [(900, None, 1), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (902, [float("nan")] * d, 1), (903, [float("inf")] + [0.0] * 5, 1), (904, [1.0] * 3, 1), (905, [], 1), (None, rows[0][1], None), rows[1], rows[1]]
    got = wh.whiten(spark.createDataFrame([(*r, "x", 1) for r in rows], ROWS + ", n string, component int").repartition(parts)).collect()
    keep, x = whole(rows, d)
    n = len(x)
    sums = [sum(c) for c in zip(*x, strict=True)]
    centred = [[v * n - s for v, s in zip(r, sums, strict=True)] for r in x]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in centred), n**3)) for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1].T
    assert len(got) == n * d and {r.n for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    signs = {}
    for row, c in zip(keep, centred, strict=True):
        for k in range(d):
            r = by[row[0], k + 1][0]
            assert r.deviation == sum(t * t for t in c)
            plain = np.dot(np.array([float(Fraction(t, n)) for t in c]), u[k]) / math.sqrt(e[k])
            signs.setdefault(k, math.copysign(1, plain * r.whitened) if abs(plain) > 1e-6 else None)
            assert r.whitened == pytest.approx(plain * (signs[k] or 1), rel=1e-8, abs=1e-8)
            assert r.explained == pytest.approx(e[k] / np.trace(v), rel=1e-10)
    assert 0 <= got[0].identity_error < 1e-9


def test_hard_spectrum_and_rank(spark):
    rng = np.random.default_rng(0)
    q, _ = np.linalg.qr(rng.normal(size=(40, 40)))
    e = 10.0 ** -np.arange(0, 12, 0.3)
    v = (q * e) @ q.T
    v = (v + v.T) / 2
    values, parts = wh.jacobi(wh.pivoted_cholesky(v))
    assert np.allclose(values[:20], e[:20], rtol=1e-6) and np.abs(parts @ parts.T - np.eye(len(parts))).max() < 1e-12
    assert np.abs(parts[:10] @ v - values[:10, None] * parts[:10]).max() < 1e-13
    # a constant and a doubled dimension add no component
    rows = [(k, [float(a), float(a), 7.0, float(b)], 0) for k, (a, b) in enumerate(rng.normal(size=(50, 2)))]
    got = wh.whiten(spark.createDataFrame(rows, ROWS)).collect()
    assert {r.component for r in got} == {1, 2} and got[0].identity_error < 1e-9


def test_no_vectors_and_single_vector(spark):
    for rows in ([], [(1, None, 0), (2, [], 0)], [(1, [1.0, 2.0], 0)]):
        df = wh.whiten(spark.createDataFrame(rows, ROWS))
        assert df.collect() == [] and df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_entries_stay_exact(spark):
    rows = [(k, [float(v) for v in (3e12 + 1e9 * k * k, -(2.0**40) * k, k % 3)], 0) for k in range(9)]
    got = wh.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    keep, x = whole(rows, 3)
    sums = [sum(c) for c in zip(*x, strict=True)]
    want = {r[0]: sum((9 * v - s) ** 2 for v, s in zip(y, sums, strict=True)) for r, y in zip(keep, x, strict=True)}
    assert all(r.deviation == want[r.vec_id] for r in got) and got
