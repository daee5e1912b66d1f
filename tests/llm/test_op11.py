"""Whitening against a dense eigendecomposition in whole numbers and fractions."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tillroll.llm import op11_whitening as op

SCHEMA = "vec_id long, embedding array<float>, n int, whitened string"


def brute(vectors):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(axis=0)
    far = n * x - s
    cov = np.array([[float(Fraction(int(a), n ** 3)) for a in row] for row in far.T @ far])
    return n, (far * far).sum(axis=1), (far / n).astype(float), cov


def rows(rng, n, d, scale):
    return (rng.standard_normal((n, d)) * scale + rng.standard_normal(d)).astype(np.float32)


def check(got, vectors, k, fine=1e-8):
    n, dev, centred, cov = brute(vectors)
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    assert len(got) == n * k
    w = np.zeros((n, k))
    for r in got:
        assert r.n == n and r.deviation == (dev[r.vec_id] if dev[r.vec_id] < 1 << 63 else None) and abs(r.explained / (e[r.component - 1] / np.trace(cov)) - 1) < fine and r.identity_error < fine
        w[r.vec_id, r.component - 1] = r.whitened
    want = centred @ u / np.sqrt(e)
    sign = np.sign((w * want).sum(axis=0))
    assert np.abs(w * sign - want).max() < 10 * fine
    assert np.abs(np.cov(w.T, bias=True) - np.eye(k)).max() < fine


def test_equals_dense_solution(spark):
    rng = np.random.default_rng(5)
    vectors = rows(rng, 400, 40, np.geomspace(3, 0.05, 40))
    vectors[7] *= 20_000  # entries whose products pass 53 bits when summed
    good = [(i, [float(c) for c in v], 0, "z") for i, v in enumerate(vectors)]
    bad = [(900, None, 0, "z"), (901, [1.0] * 39 + [float("nan")], 0, "z"), (902, [float("inf")] * 40, 0, "z"), (903, [1.0] * 39 + [None], 0, "z"), (904, [1.0] * 3, 0, "z"), (905, [], 0, "z")]
    out = op.whitening_report(spark.createDataFrame(bad[:3] + good + bad[3:], SCHEMA).repartition(5))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(out.collect(), vectors, 32, 1e-6)  # eigenvalues from 1e11 to 1e2


@pytest.mark.parametrize("d,k", [(5, 5), (64, 32)])
def test_few_dimensions_and_plain(spark, d, k):
    vectors = rows(np.random.default_rng(d), 300, d, np.ones(d))
    check(op.whitening_report(spark.createDataFrame([(i, [float(c) for c in v], 0, "") for i, v in enumerate(vectors)], SCHEMA)).collect(), vectors, k)


def test_odd_tables(spark):
    frame = lambda data: spark.createDataFrame(data, SCHEMA)
    assert op.whitening_report(frame([])).collect() == []
    assert op.whitening_report(frame([(1, None, 0, "")])).collect() == []
    assert op.whitening_report(frame([(1, [0.5, 0.25], 0, ""), (None, [0.5, 0.25], 0, "")])).collect() == []  # no spread
    got = op.whitening_report(frame([(1, [1.0, 2.0, 4.0], 0, ""), (1, [2.0, 2.0, 5.0], 0, ""), (None, [1.0, 2.0, 4.0], 0, "")])).collect()
    assert len(got) == 3 and {r.component for r in got} == {1} and got[0].explained == pytest.approx(1.0)  # two dimensions move as one, one not at all


def test_equal_eigenvalues_are_counted_and_orthogonal():
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.standard_normal((12, 12)))
    e = np.array([9.0, 4, 4, 4, 4 + 1e-13, 2, 1, 1, 1e-3, 1e-3, 0, 0])
    v = q @ np.diag(e) @ q.T
    v = (v + v.T) / 2
    assert [op.above(v, t) for t in (10, 5, 3.9, 1.5, 0.5, 1e-4)] == [0, 1, 5, 6, 8, 10]
    values, unit = op.leading(v, 12)
    assert np.allclose(values, e[:10], rtol=1e-9) and np.abs(unit.T @ unit - np.eye(10)).max() < 1e-10
    assert np.abs(v @ unit - unit * values).max() < 1e-8


@pytest.mark.parametrize("seed", range(6))
def test_counts_of_random_matrices(seed):
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    if seed % 2:
        a[np.diag_indices(30)] = 0.0  # needs pivots of two rows
    e = np.linalg.eigvalsh(a)
    for t in [*(e[:-1] + e[1:]) / 2, e[0] - 1, e[-1] + 1]:
        assert op.above(a, t) == (e > t).sum()
