"""Decoders over time, spatial filters, nested and tuned nulls and crossed intercepts against plain loops."""

import math

import numpy as np
import pytest

from lockstep.functions import scalars as sc
from lockstep.operators import dense, mixed, nulls
from tests import plain

TRIALS = "participant long, time int, trial int, block int, section int, x array<double>, y array<double>"


def made(spark, seed=3, n=96, p=3, c=5, times=3, noise=1.0):
    """x, y (times x n x c), blocks and the trials of one participant in two sections of four blocks."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    x[:, -1] += 0.8 * x[:, 0]
    y = np.stack([x @ rng.normal(size=(p, c)) * (t + 1) + noise * rng.normal(size=(n, c)) for t in range(times)])
    blocks = np.arange(n) // (n // 8)
    rows = [(4, t, i, int(blocks[i]), int(blocks[i] // 4), x[i].tolist(), y[t, i].tolist()) for t in range(times) for i in range(n)]
    return x, y, blocks, spark.createDataFrame(rows, TRIALS).repartition(4)


def moved_rows(x, rep, least):
    """Rows shifted within both sections, as the null does."""
    half = len(x) // 2
    shift = nulls.null_shift(4, rep, half, least)
    return np.concatenate([np.roll(x[:half], shift, axis=0), np.roll(x[half:], shift, axis=0)])


def nested_rows(x, rep, least, red):
    fit = x[:, :red] @ np.linalg.lstsq(x[:, :red], x[:, red:], rcond=None)[0]
    return np.hstack([x[:, :red], fit + moved_rows(x[:, red:] - fit, rep, least)])


@pytest.mark.parametrize("nested", [False, True])
def test_nulls_against_a_loop_and_in_slices(spark, nested):
    x, y, blocks, frame = made(spark)
    families, observed = {"a": 2, "b": 1}, dense.b2b_alphas(frame, sc.log_grid(-2, 2, 1), splits=3)
    alpha = {(r.split, r.direction): r.alpha for r in observed.collect()}
    rows = nulls.b2b_nulls(frame, observed, families, 6, 10, nested=nested, first_rep=2).collect()
    got = {(r.split, r.direction, r.time, r.rep, r.family): r.score for r in rows}
    assert len(got) == len(rows) == 3 * 2 * 3 * 6 * 2 and {r.rep for r in rows} == set(range(2, 8))
    for (split, direction, time, rep, family), score in got.items():
        z = nested_rows(x, rep, 10, 2) if nested else moved_rows(x, rep, 10)
        half = dense.first_half(blocks, split)
        first = half if direction == 1 else ~half
        diagonal, _ = plain.back_to_back(y[time][first], z[first], y[time][~first], z[~first], alpha[split, direction])
        assert score == pytest.approx(diagonal[:2].mean() if family == "a" else diagonal[2], abs=1e-9)
    sliced = nulls.b2b_nulls(frame, observed, families, 6, 10, nested=nested, first_rep=2, most_trials=20).collect()
    assert len(sliced) == len(rows)
    assert all(got[r.split, r.direction, r.time, r.rep, r.family] == pytest.approx(r.score, abs=1e-9) for r in sliced)


def test_nested_null_leaves_the_nuisance(spark):
    x, *_ = made(spark)
    moved = nested_rows(x, 0, 10, 2)
    assert np.allclose(moved[:, :2], x[:, :2]) and not np.allclose(moved[:, 2], x[:, 2])
    assert np.corrcoef(moved[:, 0], moved[:, 2])[0, 1] == pytest.approx(np.corrcoef(x[:, 0], x[:, 2])[0, 1], abs=0.15)
    with pytest.raises(ValueError):
        nulls.b2b_nulls(spark.createDataFrame([], TRIALS), spark.createDataFrame([], "participant long, split int, direction int, alpha double"), {"a": 3}, 2, nested=True)


def test_penalties_tuned_in_each_repetition(spark):
    x, y, blocks, frame = made(spark, noise=4.0)
    alphas = sc.log_grid(-2, 2, 1)
    found = nulls.null_alphas(frame, {"a": 3}, alphas, 4, splits=2, least=10)
    got = {(r.split, r.direction, r.rep): r.alpha for r in found.collect()}
    assert len(got) == 2 * 2 * 4
    for (split, direction, rep), alpha in got.items():
        half = dense.first_half(blocks, split)
        first = half if direction == 1 else ~half
        fold = np.searchsorted(np.unique(blocks[first]), blocks[first]) % 4
        z = moved_rows(x, rep, 10)
        errors = np.mean([plain.alpha_errors(y[t][first], z[first], fold, alphas) for t in range(3)], axis=0)
        assert alpha == alphas[dense.least_on_plateau(errors)]
    sliced = nulls.null_alphas(frame, {"a": 3}, alphas, 4, splits=2, least=10, most_trials=20)
    assert {(r.split, r.direction, r.rep): r.alpha for r in sliced.collect()} == got
    rows = nulls.b2b_nulls(frame, found, {"a": 3}, 4, 10).collect()
    assert len(rows) == 2 * 2 * 4 * 3
    for r in rows:
        half, z = dense.first_half(blocks, r.split), moved_rows(x, r.rep, 10)
        first = half if r.direction == 1 else ~half
        diagonal, _ = plain.back_to_back(y[r.time][first], z[first], y[r.time][~first], z[~first], got[r.split, r.direction, r.rep])
        assert r.score == pytest.approx(diagonal.mean(), abs=1e-9)
    stat = nulls.window_maximum(nulls.b2b_nulls(frame, found, {"a": 2, "b": 1}, 4, 10), 1, 2).collect()
    assert len(stat) == 4 and all(r.stat > 0 for r in stat)


def test_chunks_that_lack_or_repeat(spark):
    done = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (1, 1, 1), (2, 0, 0), (2, 0, 0)], "participant long, chunk int, rep int")
    assert sorted(map(tuple, nulls.chunk_gaps(done, done, 3).collect())) == [(1, 1, 2), (1, 2, 0), (2, 1, 0), (2, 2, 0)]


def test_decoders_at_other_times(spark):
    x, y, blocks, frame = made(spark)
    alphas, families = sc.log_grid(-2, 2, 1), {"a": 2, "b": 1}
    got = {(r.split, r.direction, r.t_train, r.t_test, r.family): r for r in dense.b2b_generalised(frame, families, alphas, splits=3).collect()}
    assert len(got) == 3 * 2 * 9 * 2
    for r in dense.b2b_scores(frame, families, alphas, splits=3).collect():
        same = got[r.split, r.direction, r.time, r.time, r.family]
        assert (same.score, same.alpha, same.valid) == (pytest.approx(r.score, abs=1e-12), r.alpha, r.valid)
    for (split, direction, t, u, family), r in got.items():
        half = dense.first_half(blocks, split)
        first = half if direction == 1 else ~half
        center = y[t][first].mean(axis=0)
        a = y[t][first] - center
        decoder = plain.ridge(a, x[first] - x[first].mean(axis=0), r.alpha * (a**2).sum() / a.shape[1])
        guess = (y[u][~first] - center) @ decoder
        h = np.linalg.lstsq(x[~first] - x[~first].mean(axis=0), guess - guess.mean(axis=0), rcond=None)[0]
        assert r.trace == pytest.approx(np.diag(h)[:2].sum() if family == "a" else h[2, 2], abs=1e-9)
    assert {r.t_train for r in dense.b2b_generalised(frame, families, alphas, splits=1, every=2).collect()} == {0, 2}


def test_evoked_filters_find_a_bump_in_the_training_half(spark):
    rng = np.random.default_rng(7)
    trials, times, channels = 64, 20, 6
    bump = np.exp(-0.5 * ((np.arange(times) - 10) / 2) ** 2)
    epochs = rng.normal(size=(trials, channels, times)) + 0.9 * np.array([1, -1, 0.5, 0, 0, 2])[None, :, None] * bump
    blocks = np.arange(trials) // 8
    half = dense.first_half(blocks, 0)
    epochs[~half, 3] += 5 * np.sin(np.arange(times))  # what only the test half repeats
    rows = [(1, t, i, int(blocks[i]), 0, [float(rng.normal())], epochs[i, :, t].tolist()) for t in range(times) for i in range(trials)]
    frame = spark.createDataFrame(rows, TRIALS)
    sums = dense.block_sums(frame, ["participant", "time", "block"])
    fit = {r.split: r for r in dense.evoked_filters(sums, 2, 2).collect()}
    weights = np.reshape(fit[0].weights, (channels, 2))
    want = plain.evoked_components(epochs[half], 2)
    assert np.allclose(np.abs(weights.T @ want).diagonal(), 1)
    assert abs(np.corrcoef(weights[:, 0] @ epochs[half].mean(axis=0), bump)[0, 1]) > 0.9 and abs(weights[3, 0]) < 0.2
    every = np.reshape(dense.evoked_filters(sums, 1, 2, scope="all").first().weights, (channels, 2))
    assert abs(every[3, 0]) > 0.5 and 0 < fit[0].explained <= 1
    filters = dense.evoked_filters(sums, 1, 2)
    got = {(r.direction, r.time): r.score for r in dense.b2b_scores(frame, {"a": 1}, [0.1], splits=1, filters=filters).collect()}
    seen = np.einsum("nct,ck->nkt", epochs, weights)
    for direction, first in ((1, half), (2, ~half)):
        xs = np.array([rows[4 * trials + i][5] for i in range(trials)])
        diagonal, _ = plain.back_to_back(seen[first][:, :, 4], xs[first], seen[~first][:, :, 4], xs[~first], 0.1)
        assert got[direction, 4] == pytest.approx(diagonal[0], abs=1e-9)


def test_penalty_for_a_target_condition(spark):
    penalty, kappa = dense.least_penalty(1.0, 400.0, 5.0)
    assert kappa == pytest.approx(5, abs=1e-9) and math.sqrt((400 + penalty) / (1 + penalty)) == pytest.approx(5, abs=1e-9)
    assert dense.least_penalty(1.0, 4.0, 5.0) == (0.0, 2.0) and dense.least_penalty(1.0, 400.0, None) == (0.0, 20.0)
    assert dense.least_penalty(0.0, 400.0, 5.0)[1] == pytest.approx(5) and dense.least_penalty(0.0, 0.0, None)[1] == math.inf
    _, _, _, frame = made(spark)
    rows = dense.b2b_scores(frame, {"a": 3}, [1.0], splits=2, target=1.2).collect()
    assert all(r.valid and r.condition == pytest.approx(1.2, abs=1e-9) and r.penalty > 0 for r in rows)


def dense_deviance(y, x, a, b, logs, reml):
    va, vb, ve = np.exp(logs)
    v = ve * np.eye(len(y)) + va * (a[:, None] == a) + vb * (b[:, None] == b)
    inverse = np.linalg.inv(v)
    xvx = x.T @ inverse @ x
    r = y - x @ np.linalg.solve(xvx, x.T @ inverse @ y)
    n = len(y) - (x.shape[1] if reml else 0)
    return n * math.log(2 * math.pi) + np.linalg.slogdet(v)[1] + r @ inverse @ r + (np.linalg.slogdet(xvx)[1] if reml else 0)


@pytest.mark.parametrize("reml", [False, True])
def test_crossed_intercepts_on_unbalanced_rows(spark, reml):
    rng = np.random.default_rng(11)
    n = 260
    a, b = rng.integers(0, 7, n), rng.integers(0, 30, n)
    x = rng.normal(size=(n, 2))
    y = 2 + x @ [0.7, 0.0] + rng.normal(size=7)[a] + 0.6 * rng.normal(size=30)[b] + 0.8 * rng.normal(size=n)
    rows = [(f"s{a[i]}", int(b[i]), float(x[i, 0]), float(x[i, 1]), float(y[i])) for i in range(n)]
    frame = spark.createDataFrame([*rows, (None, 1, 1.0, 1.0, 1.0), ("s1", 1, None, 1.0, 1.0)], "a string, b int, u double, w double, y double")
    fits = mixed.crossed_intercepts(frame, "a", "b", "y", ["u", "w"], [[], ["u"], ["u", "w"]], reml=reml)
    for fit, k in zip(fits, (1, 2, 3), strict=True):
        design = np.hstack([np.ones((n, 1)), x])[:, :k]
        at = np.log([fit.solved, fit.absorbed, fit.residual])
        least = dense_deviance(y, design, a, b, at, reml)
        assert fit.deviance == pytest.approx(least, abs=1e-7) and fit.n == n and not fit.singular
        for step in np.vstack([np.eye(3), -np.eye(3)]) * 0.01:  # nowhere near is lower
            assert dense_deviance(y, design, a, b, at + step, reml) > least
    if not reml:
        tests = mixed.nested_ratio_tests(spark, fits).collect()
        assert tests[0].p < 1e-6 and tests[1].p > 0.01 and tests[0].chi_squared == pytest.approx(fits[0].deviance - fits[1].deviance)
        with pytest.raises(ValueError):
            mixed.nested_ratio_tests(spark, fits[::-1])


def test_crossed_intercepts_at_the_boundary(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(size=240)
    y -= np.repeat(y.reshape(12, 20).mean(axis=1), 20)  # no level of a differs
    frame = spark.createDataFrame([(i // 20, i % 20, float(v + i % 20)) for i, v in enumerate(y)], "a int, b int, y double")
    fit = mixed.crossed_intercepts(frame, "a", "b", "y", [])[0]
    assert fit.singular == ["a"] and fit.solved == 0 and fit.absorbed > 10
    with pytest.raises(ValueError):
        mixed.crossed_intercepts(frame, "b", "a", "y", [], most=5)
    with pytest.raises(ValueError):
        mixed.crossed_intercepts(frame.limit(0), "a", "b", "y", [])


def test_chi_squared():
    for x, df, p in ((3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (7.814727903251179, 3, 0.05), (9.487729036781154, 4, 0.05), (18.307038053275146, 10, 0.05)):
        assert mixed.chi_squared_p(x, df) == pytest.approx(p)
    assert mixed.chi_squared_p(0, 3) == 1
