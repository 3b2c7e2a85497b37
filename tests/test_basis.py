"""Drift, ordered and independent bases, canonical correlations and sketched components against plain NumPy."""

import numpy as np
import pytest

from lockstep.operators import basis
from tests import plain


@pytest.fixture(scope="module")
def words(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(400, 6)) @ rng.normal(size=(6, 6))
    b = 0.7 * a[:, :4] + rng.normal(size=(400, 4))
    c = np.hstack([0.5 * a[:, :2] + 0.5 * b[:, :2], rng.normal(size=(400, 1))]) + 0.5 * rng.normal(size=(400, 3))
    onset = np.sort(rng.uniform(0, 100, 400))
    slow = np.sin(onset / 15)[:, None]
    section = np.arange(400) // 200
    x = {"a": a + 3 * slow, "b": b - 2 * slow, "c": c + slow}
    rows = [(int(section[i]), i, float(onset[i]), *(x[f][i].tolist() for f in "abc"), "kept") for i in range(400)]
    rows += [(None, 900, 1.0, [1.0] * 6, [1.0] * 4, [1.0] * 3, "x"), (0, 901, 2.0, None, [1.0] * 4, [1.0] * 3, "x")]
    frame = spark.createDataFrame(rows, "section int, word int, onset double, fa array<double>, fb array<double>, fc array<double>, p string").repartition(3)
    return x, onset, section, frame


FAMILIES = {"a": "fa", "b": "fb", "c": "fc"}


def plain_residual(x, onset, section, bumps):
    out = x.copy()
    for s in (0, 1):
        here = section == s
        t = onset[here]
        k = np.linspace(t.min(), t.max(), bumps)
        design = np.hstack([np.ones((here.sum(), 1)), np.exp(-0.5 * ((t[:, None] - k) / (k[1] - k[0])) ** 2)])
        out[here] = plain.residual(x[here], design)
    return out


def test_drift_leaves_what_is_fast(words):
    x, onset, section, frame = words
    every = np.hstack([x[f] for f in "abc"])
    want = plain_residual(every, onset, section, 12)
    rows = basis.drift_residuals(frame, "section", "onset", FAMILIES, 12).collect()
    assert len(rows) == 400 and {r.p for r in rows} == {"kept"}
    assert np.allclose([r.residual for r in sorted(rows, key=lambda r: r.word)], want, atol=1e-8)
    assert basis.drift_residuals(frame.limit(0), "section", "onset", FAMILIES, 12).count() == 0


@pytest.mark.parametrize("ordered", [True, False])
def test_basis_on_a_sweep(spark, words, ordered, tmp_path):
    x, onset, section, frame = words
    fit = basis.fit_basis(frame, "section", "onset", FAMILIES, 3, ordered, 12)
    path = str(tmp_path / "basis")
    fit.write.parquet(path)
    rest = basis.drift_residuals(frame, "section", "onset", FAMILIES, 12)
    rows = basis.put_through(rest, "residual", basis.read_basis(spark, path, ["a", "b", "c"], 3)).collect()
    z = np.array([r.z for r in sorted(rows, key=lambda r: r.word)])
    assert z.shape == (400, 9) and np.allclose(z.std(axis=0, ddof=1), 1, atol=1e-6)
    before, want = np.zeros((400, 0)), []
    for f in "abc":
        left = plain_residual(x[f], onset, section, 12)
        if ordered and before.shape[1]:
            left = plain.residual(left, before)
        scores, _ = plain.standardised_components(left, 3)
        want.append(scores)
        before = np.hstack([before, scores])
    assert np.allclose(np.abs(np.sum(z * np.hstack(want), axis=0)) / 399, 1, atol=1e-6)
    across = [basis.canonical_correlations(spark.createDataFrame([(z[i, s].tolist(), z[i, t].tolist()) for i in range(400)], "a array<double>, b array<double>"), "a", "b") for s, t in ((slice(0, 3), slice(3, 6)), (slice(3, 6), slice(6, 9)))]
    assert all(c[0] < 1e-5 for c in across) if ordered else all(c[0] > 0.2 for c in across)
    with pytest.raises(ValueError):
        basis.read_basis(spark, path, ["b", "a", "c"], 3)
    with pytest.raises(ValueError):
        basis.read_basis(spark, path, ["a", "b", "c"], 4)
    assert basis.fit_basis(frame.limit(0), "section", "onset", FAMILIES, 3).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [1.0])], "i int, residual array<double>")
    assert [r.z for r in basis.put_through(odd, "residual", fit).collect()] == [None, None]


def test_canonical_correlations_by_qr(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(300, 4))
    b = np.hstack([a[:, :1] + 0.5 * rng.normal(size=(300, 1)), rng.normal(size=(300, 2))])
    frame = spark.createDataFrame([(a[i].tolist(), b[i].tolist()) for i in range(300)] + [(None, [1.0] * 3)], "a array<double>, b array<double>")
    q = [np.linalg.qr(m - m.mean(axis=0))[0] for m in (a, b)]
    assert np.allclose(basis.canonical_correlations(frame, "a", "b"), np.linalg.svd(q[0].T @ q[1], compute_uv=False))
    double = spark.createDataFrame([([*a[i].tolist(), float(a[i, 0])], b[i].tolist()) for i in range(300)], "a array<double>, b array<double>")
    assert np.allclose(basis.canonical_correlations(double, "a", "b"), basis.canonical_correlations(frame, "a", "b"), atol=1e-6)
    assert len(basis.canonical_correlations(frame.limit(0), "a", "b")) == 0


def test_sketched_components(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 40)) @ (np.linalg.qr(rng.normal(size=(40, 40)))[0] * 2.0 ** -np.arange(40)).T + 5
    frame = spark.createDataFrame([(r.tolist(),) for r in x] + [(None,)], "v array<double>")
    mean, load, power = basis.sketched_components(frame, "v", 4)
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(power, values[::-1][:4], rtol=1e-6)
    assert np.allclose(np.abs((load * vectors[:, ::-1][:, :4]).sum(axis=0)), 1, atol=1e-6)
    again = basis.sketched_components(frame, "v", 4)
    assert np.allclose(again[1], load, atol=1e-12) and len(basis.sketched_components(frame.limit(0), "v", 4)[0]) == 0
