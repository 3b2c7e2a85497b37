"""Models, nulls and phone sequences against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lockstep.functions import scalars as sc
from lockstep.operators import dense, models, nulls, speech
from lockstep.plans import QUERIES
from tests import plain


def phones(spark, rows):
    return spark.createDataFrame([(k, i, t, c) for k, word in rows for i, (t, c) in enumerate(word)], "k string, i int, toned boolean, coda boolean")


def test_syllables(spark):
    on, coda, other = (True, False), (False, True), (False, False)
    words = [("a", [other, on, coda, other, on, other]), ("b", [other, coda]), ("c", [on, on]), ("d", [on, other, coda, on]), ("e", [(None, None), on, (None, None)])]
    got = speech.syllables(phones(spark, words), ["k"], ["i"], F.col("toned"), F.col("coda")).orderBy("k", "i").collect()
    held = {}
    for r in got:
        held.setdefault(r.k, []).append(r.syllable)
    assert held == {"a": [0, 0, 0, 1, 1, 1], "b": [0, 0], "c": [0, 1], "d": [0, 1, 1, 1], "e": [0, 0, 0]}
    assert speech.syllables(phones(spark, words).limit(0), ["k"], ["i"], F.col("toned"), F.col("coda")).count() == 0


def test_surface_tones(spark):
    said = [("a", "x", 3), ("a", "y", 3), ("a", "z", 3), ("b", "不", 4), ("b", "x", 4), ("c", "一", 1), ("c", "x", 4), ("d", "一", 1), ("d", "x", 3), ("e", "不", 4), ("e", "x", None), ("f", "一", 1)]
    frame = spark.createDataFrame([(k, i, w, t) for i, (k, w, t) in enumerate(said)], "k string, i int, w string, t int")
    got = [(r.surface, r.change) for r in speech.surface_tones(frame, ["k"], ["i"], "w", "t").orderBy("i").collect()]
    assert got == [(2, "third"), (2, "third"), (3, "none"), (2, "not"), (4, "none"), (2, "one"), (4, "none"), (4, "one"), (3, "none"), (4, "none"), (None, "none"), (1, "none")]


def test_grouped_ridge(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3)) * [1, 10, 0.1] + [0, 5, 2]
    y = x @ [1.0, 0.2, -3.0] + rng.normal(size=300)
    group = rng.integers(0, 25, 300)
    rows = [(int(g), *map(float, v), float(t)) for g, v, t in zip(group, x, y, strict=True)] + [(1, 1.0, 1.0, 1.0, None), (2, None, 1.0, 1.0, 9.0)]
    frame = spark.createDataFrame(rows, "g int, a double, b double, c double, y double")
    got = models.grouped_ridge(frame, "g", ["a", "b", "c"], "y", 2.0, 4).collect()
    assert len(got) == 302 and len({(r.g, r.fold) for r in got}) == len({r.g for r in got})
    fold = np.array([next(r.fold for r in got if r.g == g) for g in group])
    for f in range(4):
        train = fold != f
        m, s, b = x[train].mean(axis=0), x[train].std(axis=0), y[train].mean()
        w = plain.ridge((x[train] - m) / s, y[train] - b, 2.0)
        want = {round(float(t), 9): b + ((v - m) / s) @ w for v, t in zip(x[~train], y[~train], strict=True)}
        for r in got:
            if r.fold == f and r.y is not None and r.a is not None:
                assert r.predicted == pytest.approx(want[round(r.y, 9)])
    assert [r.predicted is None for r in got if r.a is None] == [True] and [r.predicted is None for r in got if r.y is None] == [False]
    assert models.grouped_ridge(frame.limit(0), "g", ["a"], "y").count() == 0
    assert [r.predicted for r in models.grouped_ridge(frame.where("g = 1"), "g", ["a"], "y").collect()].count(None) > 0


def plain_lagged(x, y, lags, alphas, folds):
    """Alpha and residual from whole design matrices."""
    n, z = len(y), (x - x.mean(axis=0)) / x.std(axis=0)
    t = (y - y.mean()) / y.std()
    part = np.arange(n) * folds // n

    def design(v):
        return np.column_stack([np.r_[np.zeros(min(lag, len(v))), v[: len(v) - lag, i]] for i in range(v.shape[1]) for lag in range(lags + 1)])

    inside = np.vstack([design(z[part == f]) for f in range(folds)])
    d = np.zeros((lags, lags + 1))
    d[np.arange(lags), np.arange(lags)], d[np.arange(lags), np.arange(lags) + 1] = -1, 1
    penalty = np.kron(np.eye(x.shape[1]), d.T @ d)

    def fit(a, v, alpha):
        a = a - a.mean(axis=0)
        return np.linalg.lstsq(a.T @ a + alpha * penalty, a.T @ (v - v.mean()), rcond=None)[0]

    score = [np.mean([np.corrcoef(inside[part == f] @ fit(inside[part != f], t[part != f], a), t[part == f])[0, 1] for f in range(folds)]) for a in alphas]
    alpha = alphas[int(np.argmax(score))]
    guess = design(z) @ fit(inside, t, alpha)
    guess[:lags] = 0
    return alpha, y - y.mean() - y.std() * guess


def test_lagged_residual(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for key in ("p", "q"):
        x = rng.normal(size=(150, 2))
        y = 3 + np.r_[0, 0, x[:-2, 0]] + 0.5 * np.r_[0, x[:-1, 1]] + 0.3 * rng.normal(size=150)
        want[key] = plain_lagged(x, y, 3, [0.1, 1.0, 10.0, 1000.0], 3)
        rows += [(key, i, float(x[i, 0]), float(x[i, 1]), float(y[i])) for i in range(150)]
    frame = spark.createDataFrame(rows, "k string, i int, a double, b double, y double")
    got = models.lagged_residual(frame, ["k"], ["i"], ["a", "b"], "y", 3, [0.1, 1.0, 10.0, 1000.0]).orderBy("k", "i").collect()
    for key, (alpha, residual) in want.items():
        mine = [r for r in got if r.k == key]
        assert {r.alpha for r in mine} == {alpha} and np.allclose([r.residual for r in mine], residual)
        assert np.var(residual) < 0.3 * np.var([r.y for r in mine])
    odd = spark.createDataFrame([(None, 0, 1.0, None, 2.0), (None, 1, 1.0, None, None), ("c", 0, None, None, 5.0)], frame.schema)
    left = models.lagged_residual(odd, ["k"], ["i"], ["a", "b"], "y", 3, [1.0]).orderBy("k", "i").collect()
    assert [r.residual for r in left] == [0.0, None, 0.0]
    assert models.lagged_residual(frame.limit(0), ["k"], ["i"], ["a"], "y", 3, [1.0]).count() == 0


def test_nulls_reuse_the_decoder(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(160, 2))
    y = x @ rng.normal(size=(2, 6)) + 0.5 * rng.normal(size=(160, 6))
    frame = spark.createDataFrame([(1, 0, i, i // 20, x[i].tolist(), y[i].tolist()) for i in range(160)], "participant long, time int, trial int, block int, x array<double>, y array<double>")
    observed = dense.b2b_scores(frame, {"all": 2}, sc.log_grid(-2, 2, 1), splits=2)
    got = nulls.b2b_nulls(frame, observed, {"all": 2}, 5, 20).collect()
    assert len(got) == 2 * 2 * 5
    alpha = {(r.split, r.direction): r.alpha for r in observed.collect()}
    for r in got:
        shift = nulls.null_shift(1, r.rep, 160, 20)
        assert 20 <= shift <= 140
        moved, half = np.roll(x, shift, axis=0), dense.first_half(np.arange(160) // 20, r.split)
        first = half if r.direction == 1 else ~half
        diagonal, valid = plain.back_to_back(y[first], moved[first], y[~first], moved[~first], alpha[r.split, r.direction])
        assert valid and r.score == pytest.approx(diagonal.mean())
    assert np.mean([r.score for r in got]) < 0.3 * observed.agg(F.avg("score")).first()[0]
    assert nulls.b2b_nulls(frame.limit(30), observed, {"all": 2}, 5, 20).count() == 0


@pytest.mark.parametrize("name", ["back_to_back_nulls", "back_to_back_scores", "lagged_residual"])
def test_queries_without_sql_give_rows_again(spark, sf, name):
    once = sorted(map(str, QUERIES[name](spark, sf).collect()))
    assert once and once == sorted(map(str, QUERIES[name](spark, sf).collect()))


def test_back_to_back_against_a_loop(spark):
    """Several times, one penalty for all of them, valid only if both directions are."""
    rng, alphas = np.random.default_rng(8), sc.log_grid(-3, 3, 1)
    x = rng.normal(size=(96, 3))
    y = np.stack([x @ rng.normal(size=(3, 5)) * t + rng.normal(size=(96, 5)) for t in range(3)])
    blocks = np.arange(96) // 12
    rows = [(7, t, i, int(blocks[i]), x[i].tolist(), y[t, i].tolist()) for t in range(3) for i in range(96)]
    frame = spark.createDataFrame(rows, "participant long, time int, trial int, block int, x array<double>, y array<double>").repartition(4)
    got = {(r.split, r.direction, r.time, r.family): r for r in dense.b2b_scores(frame, {"a": 2, "b": 1}, alphas, splits=6).collect()}
    assert len(got) == 6 * 2 * 3 * 2
    for split in range(6):
        half = dense.first_half(blocks, split)
        assert half.sum() == 48
        for direction, first in ((1, half), (2, ~half)):
            fold = np.searchsorted(np.unique(blocks[first]), blocks[first]) % 4
            errors = np.mean([plain.alpha_errors(y[t][first], x[first], fold, alphas) for t in range(3)], axis=0)
            alpha = alphas[dense.least_on_plateau(errors)]
            for t in range(3):
                diagonal, _ = plain.back_to_back(y[t][first], x[first], y[t][~first], x[~first], alpha)
                a, b = got[split, direction, t, "a"], got[split, direction, t, "b"]
                assert a.alpha == alpha and a.valid and a.trace == pytest.approx(diagonal[:2].sum()) and b.score == pytest.approx(diagonal[2])
    strict = dense.b2b_scores(frame, {"a": 3}, alphas, splits=2, most_condition=1.0)
    assert strict.where("valid").count() == 0 and strict.count() == 2 * 2 * 3


def test_nulls_shift_within_sections(spark):
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(96, 2)), rng.normal(size=(96, 4))
    rows = [(1, 0, i, i // 12, i // 48, x[i].tolist(), y[i].tolist()) for i in range(96)]
    frame = spark.createDataFrame(rows, "participant long, time int, trial int, block int, section int, x array<double>, y array<double>")
    observed = dense.b2b_alphas(frame, [1.0], splits=1)
    for r in nulls.b2b_nulls(frame, observed, {"a": 2}, 3, 10).collect():
        shift, half = nulls.null_shift(1, r.rep, 48, 10), dense.first_half(np.arange(96) // 12, 0)
        moved = np.concatenate([np.roll(x[:48], shift, axis=0), np.roll(x[48:], shift, axis=0)])
        first = half if r.direction == 1 else ~half
        assert r.score == pytest.approx(plain.back_to_back(y[first], moved[first], y[~first], moved[~first], 1.0)[0].mean())
