"""Logit out of fold, class scores, distances, filters, components, trees and word vectors against plain Python."""

import re

import numpy as np
from pyspark.sql import functions as F

from lockstep.operators import alignment, decoding, models, signals
from tests import plain


def softmax(z):
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def test_logit_out_of_fold_against_newton_steps(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(240, 3)) * [1, 5, 0.2]
    y = (x @ rng.normal(size=(3, 3)) / [1, 5, 0.2] + rng.gumbel(size=(240, 3))).argmax(axis=1)
    levels = ["a", "b", "c"]
    rows = [(k, f"g{k % 30}", v.tolist(), levels[c]) for k, (v, c) in enumerate(zip(x, y, strict=True))]
    odd = [(900, None, [0.0, 0.0, 0.0], "a"), (901, "g1", None, "a"), (902, "g1", [0.0, float("nan"), 1.0], "b"), (903, "g2", [0.1, 0.2, 0.3], "z"), (904, "g2", [0.1, None, 0.3], None)]
    schema = "id long, g string, x array<double>, t string"
    frame = spark.createDataFrame(rows + odd, schema)
    got = {r.id: r for r in decoding.grouped_logit(frame, "g", "x", "t", levels, 3).collect()}
    assert len(got) == 245 and all(got[k].probability is None for k in (900, 901, 902, 904)) and len(got[903].probability) == 3
    fold = np.array([got[k].fold for k in range(240)])
    assert all(len({got[k].fold for k in range(240) if k % 30 == g}) == 1 for g in range(30))
    for held in set(fold):
        train = fold != held
        z = (x - x[train].mean(axis=0)) / x[train].std(axis=0, ddof=1)
        design, one = np.hstack([z, np.ones((240, 1))]), np.eye(3)[y]
        w = np.zeros((4, 3))
        for _ in range(6000):
            p = softmax(design[train] @ w)
            w -= 0.5 * (design[train].T @ (p - one[train]) + np.diag([1, 1, 1, 0]) @ w) / train.sum()
        want = softmax(design[~train] @ w)
        assert np.allclose([got[k].probability for k in np.flatnonzero(~train)], want, atol=2e-3)
    assert decoding.grouped_logit(frame.limit(0), "g", "x", "t", levels, 3).count() == 0


def test_scores_and_shuffles_on_small_cases(spark):
    rows = [(1, "a", [0.5, 0.5]), (2, "b", [0.0, 1.0]), (3, "b", [1.0, 0.0]), (4, "z", [1.0, 0.0]), (5, "a", None), (6, None, [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "id long, t string, p array<double>")
    r = decoding.class_scores(frame, [], "t", ["a", "b"], "p", 1e-6).first()
    assert r.n == 3 and np.isclose(r.log_loss, -(np.log(0.5) + 0 + np.log(1e-6)) / 3) and np.isclose(r.brier, (0.25 + 0 + 1) / 3) and np.isclose(r.accuracy, 2 / 3)
    assert np.isclose(r.log_loss_prior, -(np.log(1 / 3) + 2 * np.log(2 / 3)) / 3)
    assert decoding.class_scores(frame.limit(0), [], "t", ["a", "b"], "p").count() == 0
    big = spark.range(400).select("id", F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("t"), F.when(F.col("id") % 4 == 0, F.array(F.lit(0.9), F.lit(0.1))).otherwise(F.array(F.lit(0.1), F.lit(0.9))).alias("p"))
    losses = {r.rep: r.log_loss for r in decoding.shuffled_losses(big, "id", "t", ["a", "b"], "p", 30).collect()}
    assert len(losses) == 31 and np.isclose(losses[0], -np.log(0.9)) and min(losses[k] for k in range(1, 31)) > 0.5
    # Dealt labels keep their counts: with 100 a and 300 b, a loss is fixed by how many a meet their own chances.
    own = [(400 - (v + np.log(0.9)) / (np.log(0.9) - np.log(0.1)) * 400) / 2 for v in losses.values()]
    assert np.allclose(own, np.round(own), atol=1e-6)
    assert np.isclose(decoding.shuffled_p(decoding.shuffled_losses(big, "id", "t", ["a", "b"], "p", 30)).first().p, 1 / 31)
    assert decoding.shuffled_p(decoding.shuffled_losses(big.limit(0), "id", "t", ["a", "b"], "p", 3)).count() == 0


def test_distances_and_conditions_against_numpy(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 3)) @ rng.normal(size=(3, 3))
    frame = spark.createDataFrame([(k, *v.tolist(), v.tolist()) for k, v in enumerate(x)], "id long, a double, b double, c double, x array<double>").repartition(4)
    more = frame.unionByName(spark.createDataFrame([(1000, None, 1.0, 1.0, None)], frame.schema))
    cov = np.cov(x.T)
    cov = 0.1 * np.trace(cov) / 3 * np.eye(3) + 0.9 * cov
    want = np.einsum("ij,jk,ik->i", x, np.linalg.inv(cov), x)
    got = {r.id: r for r in decoding.shrunk_distance(more, ["a", "b", "c"]).collect()}
    assert np.allclose([got[k].distance for k in range(500)], want) and got[1000].distance is None
    assert np.allclose([got[k].surprise for k in range(500)], 0.5 * (want + np.linalg.slogdet(cov)[1] + 3 * np.log(2 * np.pi)))
    assert decoding.shrunk_distance(frame.limit(1), ["a"]).first().distance is None and decoding.shrunk_distance(frame.limit(0), ["a"]).count() == 0

    buckets = {r.id: r.b for r in frame.select("id", F.floor(decoding.hash_unit(F.lit("bucket"), F.col("id")) * 16).alias("b")).collect()}
    z, at = (x - x.mean(axis=0)) / x.std(axis=0), np.array([buckets[k] for k in range(500)])
    for r in decoding.half_conditions(more, "id", "x", 5, 16).collect():
        mine = z[np.isin(at, decoding.half_order(r.split, 16)[8 * r.half : 8 * r.half + 8])]
        assert r.n == len(mine) and np.isclose(r.condition, np.linalg.cond(mine))
    twice = frame.withColumn("x", F.array("a", "a"))
    assert decoding.half_conditions(twice, "id", "x", 2).where("condition is not null").count() == 0
    assert decoding.half_conditions(frame.limit(0), "id", "x").count() == 0


def test_bandpass_in_slices_equals_the_whole_signal(spark):
    rng = np.random.default_rng(8)
    signal = np.cumsum(rng.normal(size=900))
    rows = [("a", k, float(v)) for k, v in enumerate(signal)] + [("short", k, 1.0) for k in range(3)] + [(None, 1, 1.0), ("a", None, 1.0), ("gap", 0, None), ("gap", 1, float("nan"))]
    frame = spark.createDataFrame(rows, "k string, at int, v double").repartition(5)
    taps = signals.bandpass_taps(50.0, 1.0, 6.0, 250)
    assert np.allclose(taps, taps[::-1])
    got = signals.bandpass(frame, ["k"], "at", "v", taps, slice_rows=97).collect()
    assert len(got) == 905
    line = [r.filtered for r in sorted((r for r in got if r.k == "a"), key=lambda r: r["at"])]
    mirrored = np.concatenate([signal[::-1], signal, signal[::-1]])
    assert np.allclose(line, np.convolve(mirrored, taps, "same")[900:1800])
    assert np.abs(np.array(line) - plain.bandpass(signal, 50.0, 1.0, 6.0)).max() < 0.02 * np.abs(line).max()
    assert {r.filtered for r in got if r.k == "gap"} == {0.0}
    assert signals.bandpass(frame.limit(0), ["k"], "at", "v", taps).count() == 0


def test_components_against_numpy(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 5)) @ rng.normal(size=(5, 5)) * [1, 10, 1, 0.1, 1] + 4
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(999, None)], "id long, x array<double>").repartition(3)
    got = {r.id: r.components for r in signals.standardised_components(frame, "x", 3).collect()}
    want, _ = plain.standardised_components(x, 3)
    assert np.allclose([got[k] for k in range(200)], want, atol=1e-8) and got[999] is None
    assert signals.standardised_components(frame.limit(0), "x", 3).count() == 0

    wide = spark.createDataFrame([(1, rng.normal(size=24).tolist()), (2, None), (3, [1.0] * 24), (4, [1.0, 2.0, 3.0, 4.0]), (5, [])], "id long, x array<double>")
    found = {r.id: (r.x, r.component) for r in signals.window_components(wide, "x", 3).collect()}
    assert all(found[k][1] is None for k in (2, 3, 4, 5))
    parts = np.reshape(found[1][0], (3, 8)).T
    power, turn = np.linalg.eigh(np.cov(parts.T))
    score = (parts - parts.mean(axis=0)) @ turn[:, -1] / np.sqrt(power[-1])
    assert np.allclose(found[1][1], score * np.sign(turn[np.abs(turn[:, -1]).argmax(), -1]))


def terminals(text):
    """One pass with a depth, as a reader would do it."""
    tokens, depth, opened, out, k = re.findall(r"[()]|[^ \t\r\n()]+", text or ""), 0, 0, [], 0
    while k < len(tokens):
        if tokens[k] == "(":
            depth, opened, k = depth + 1, opened + 1, k + 1 + (k + 1 < len(tokens) and tokens[k + 1] not in "()")
        elif tokens[k] == ")":
            depth, k = max(0, depth - 1), k + 1
        else:
            closing = 0
            while k + 1 + closing < len(tokens) and tokens[k + 1 + closing] == ")":
                closing += 1
            depth = max(0, depth - closing)
            out.append((tokens[k], opened, closing, depth + closing, depth))
            opened, k = 0, k + 1 + closing
    return out


def test_trees_against_one_pass(spark):
    rng = np.random.default_rng(3)
    texts = ["(S (NP the (N cat)) (VP sat))", "", None, "word", ") ) a ) b (", "(( x", "(NP )(VP y))) z"]
    texts += [" ".join(rng.choice(["(", ")", "(X", "w", "v)"], 60)) for _ in range(30)]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = alignment.bracket_terminals(frame, ["id"], "t").orderBy("id", "place").collect()
    for k, text in enumerate(texts):
        mine, want = [r for r in got if r.id == k], terminals(text)
        assert [(r.word, r.n_opening, r.n_closing, r.depth, r.n_open_nodes) for r in mine] == want
        assert [r.place for r in mine] == list(range(len(want))) and [r.is_end for r in mine] == [j == len(want) - 1 for j in range(len(want))]
        assert np.allclose([r.linear_order for r in mine], [j / max(len(want) - 1, 1) for j in range(len(want))])


def test_word_vectors_of_a_vocabulary(spark):
    lines = ["3 2", "cat 1 2", "cat 3 4", "dog 1", "dog 5 6 7", "emu x 1", "fox inf 1", "gnu nan 1", "ox 1 2", "", None, "hen 1e400 1"]
    frame = spark.createDataFrame(list(enumerate(lines)), "n int, line string")
    words = spark.createDataFrame([(w,) for w in ("cat", "cat", "dog", "emu", "fox", "gnu", "hen", None)], "word string")
    got = {r.word: r.vector for r in alignment.word_vectors(frame, "line", "n", words, "word", 2).collect()}
    assert got == {"cat": [1.0, 2.0], "dog": [5.0, 6.0]}
    assert alignment.word_vectors(frame.limit(0), "line", "n", words, "word", 2).count() == 0


def test_folds_are_those_of_the_ridge(spark):
    frame = spark.createDataFrame([(f"g{k}", [float(k)], "a") for k in range(20)], "g string, x array<double>, t string")
    got = decoding.grouped_logit(frame, "g", "x", "t", ["a"], 4)
    assert got.where(F.col("fold") != models.group_fold(F.col("g"), 4)).count() == 0
