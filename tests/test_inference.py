"""Permutation tests, distributions, signals and alignment against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lockstep.functions import distributions as dist
from lockstep.operators import alignment, joins, permutation, sequences, signals, summaries
from lockstep.sources import sinks
from lockstep.sources.tables import ContractError


def test_quantiles_and_ranks_with_ties_nulls_and_one_hot_key(spark):
    rng = random.Random(3)
    rows = [("a", float(rng.randrange(40))) for _ in range(3000)] + [("b", rng.random()) for _ in range(17)] + [(None, 2.0), ("c", None), ("a", None)]
    frame = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: r for r in summaries.quantiles(frame, ["k"], "v", {"q": 0.5, "p": 0.95, "z": 0.0}).collect()}
    for k in ("a", "b", None):
        values = [v for kk, v in rows if kk == k and v is not None]
        assert np.allclose([got[k].q, got[k].p, got[k].z], np.quantile(values, [0.5, 0.95, 0.0]))
    assert "c" not in got
    ranked = summaries.average_ranks(frame, ["k"], "v", "r").collect()
    assert len(ranked) == len(rows)
    for r in ranked:
        mine = [v for kk, v in rows if kk == r.k and v is not None]
        assert r.r is None if r.v is None else r.r == sum(v < r.v for v in mine) + (sum(v == r.v for v in mine) + 1) / 2
    assert summaries.quantiles(frame.limit(0), ["k"], "v", {"q": 0.5}).count() == 0


def test_one_key_of_many_rows_in_order(spark):
    n = 40_000
    frame = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("at"), (F.col("id") % 97 == 0).alias("on"))
    right = frame.where("on").select("k", "at", F.col("at").alias("v"))
    got = joins.nearest_in_time(frame.select("k", "at"), right, ["k"], "at", "v", 1e9).collect()
    last = (n - 1) // 97 * 97
    assert all(r.nearest_v == min(last, (r["at"] + 48) // 97 * 97) for r in got)
    bounds = sequences.pause_bounds(frame.withColumn("t", F.col("at") + F.floor(F.col("at") / 97) * 10), ["k"], ["at"], "t", 5).collect()
    assert len(bounds) == n and all(r.phrase_end - r.phrase_start <= 96 for r in bounds)


def test_balanced_halves_and_keys(spark):
    for section in ("a", "b", ""):
        halves = permutation.balanced_halves(section=section)
        keys = {min(h, tuple(b for b in range(1, 9) if b not in h)) for _, h in halves}
        uses = [sum(b in h for _, h in halves) for b in range(1, 9)]
        assert len(keys) == len(halves) == 20 and min(uses) >= 8 and max(uses) <= 12 and all(len(h) == 4 for _, h in halves)
    rows = permutation.assignment_rows(spark, ["a"])
    assert rows.count() == 160 and rows.groupBy("split").agg(F.sum("half").alias("s")).where("s <> 12").count() == 0
    with pytest.raises(ValueError):
        permutation.balanced_halves(splits=35, low=18, high=17)


def test_cluster_p_against_a_loop(spark):
    rng = np.random.default_rng(0)
    t = rng.normal(0, 1.2, (21, 2, 15))
    t[0, 0, 4:9] += 3
    rows = [(r, f"f{f}", k, float(t[r, f, k])) for r in range(21) for f in range(2) for k in range(15)]

    def masses(x):
        out, run = [], []
        for k, v in enumerate([*x, 0.0]):
            if abs(v) > 1.5:
                run.append((k, abs(v)))
            elif run:
                out.append((run[0][0], run[-1][0], sum(m for _, m in run)))
                run = []
        return out

    null = [max((m for f in range(2) for *_, m in masses(t[r, f])), default=0) for r in range(1, 21)]
    want = sorted((f"f{f}", a, b, round(m, 6), round((1 + sum(n >= m for n in null)) / 21, 6)) for f in range(2) for a, b, m in masses(t[0, f]))
    found = permutation.cluster_p(spark.createDataFrame(rows, "rep int, f string, time int, t double"), ["f"], "time", "t", 1.5, 20)
    assert sorted((r.f, r.first, r.last, round(r.mass, 6), round(r.p, 6)) for r in found.collect()) == want


def test_distributions(spark):
    known = [(2.2281389, 10.0, 0.05), (1.9599640, 1e6, 0.05), (12.7062047, 1.0, 0.05), (0.0, 4.0, 1.0)]
    frame = spark.createDataFrame([*((t, d, p) for t, d, p in known), (None, 3.0, None)], "t double, df double, p double")
    assert all((r.got is None) if r.p is None else abs(r.got - r.p) < 1e-5 for r in frame.withColumn("got", dist.t_p("t", "df")).collect())
    f = spark.createDataFrame([(4.1028210, 2.0, 10.0)], "f double, a double, b double").select(dist.f_p("f", "a", "b")).first()[0]
    assert abs(f - 0.05) < 1e-6
    rows = [("x", k < 6, float(v)) for k, v in enumerate([1, 2, 2, 3, 9, 4, 5, 6, 7, 8, 8, 10, 3])]
    got = dist.rank_sum_test(spark.createDataFrame(rows, "k string, g boolean, v double"), ["k"], F.col("g"), "v").first()
    a, b = [v for _, g, v in rows if g], [v for _, g, v in rows if not g]
    assert got.u == sum((x > y) + (x == y) / 2 for x in a for y in b) and 0 < got.p_ranks < 1
    w = dist.welch_test(spark.createDataFrame(rows, "k string, g boolean, v double"), ["k"], F.col("g"), "v").first()
    va, vb = np.var(a, ddof=1) / len(a), np.var(b, ddof=1) / len(b)
    assert math.isclose(w.t, (np.mean(a) - np.mean(b)) / math.sqrt(va + vb)) and math.isclose(w.df, (va + vb) ** 2 / (va**2 / (len(a) - 1) + vb**2 / (len(b) - 1)))


def test_spatial_components_equal_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6)) + 3
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, x array<double>").repartition(5)
    mean, weights, power = signals.spatial_components(frame, "x", 3)
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(power, np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1][:3])
    y = np.array([r[0] for r in frame.orderBy("id").select(signals.apply_filter(F.col("x"), mean, weights)).collect()])
    assert np.allclose(y, (x - mean) @ weights) and np.allclose(np.var(y, axis=0), power)
    assert signals.gram(frame.limit(0), "x")[0] == 0


def test_channels_drift_and_lines_on_odd_values(spark):
    frame = spark.createDataFrame([(1, 0, 1.0), (1, 0, 3.0), (1, 0, float("nan")), (1, 1, 5.0), (1, 1, None)], "s int, channel int, x double")
    z = sorted((r.channel, round(r.z, 6)) for r in signals.zscore_channels(frame, ["s", "channel"], "x").collect())
    assert z == [(0, -0.707107), (0, 0.0), (0, 0.707107), (1, 0.0), (1, 0.0)]
    flat = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 4.0), ("b", 1, 7.0)], "k string, at int, v double")
    assert sorted((r.k, r["at"], round(r.residual, 9)) for r in signals.drift_residual(flat, ["k"], "at", "v").collect()) == [("a", 1, 0.0), ("a", 2, 0.0), ("b", 1, 0.0)]
    points = spark.createDataFrame([("a", 0.0, 1.0), ("a", 4.0, 9.0), ("a", 40.0, 0.0)], "k string, t double, v double")
    grid = spark.createDataFrame([("a", t) for t in (-1.0, 0.0, 1.0, 4.0, 20.0, 41.0)], "k string, t double")
    assert {r.t: r.v for r in signals.interpolated(grid, points, ["k"], "t", "v", 10.0).collect()} == {-1.0: None, 0.0: 1.0, 1.0: 3.0, 4.0: 9.0, 20.0: None, 41.0: None}
    with pytest.raises(ValueError):
        signals.picked(F.array(F.lit(1)), ["a"], ["b"])


def test_greedy_alignment_against_a_loop(spark):
    rng = random.Random(2)
    a = [(1, 0, k, rng.choice("abcdef")) for k in range(60)]
    b = [(1, 1, k, rng.choice("abcdef")) for k in range(60)] + [(2, 0, 0, "z")]
    want, at, last = {}, 0, None
    other = [t for _, s, _, t in b if s == 1]
    for _, _, k, t in a:
        near = other[at : at + 9]
        if t in near:
            last = at + near.index(t)
            at = last + 1
        want[k] = (last, t in near)
    got = alignment.greedy_align(spark.createDataFrame(a + b, "k long, side int, pos long, t string"), ["k"], "side", "pos", "t").collect()
    assert {r.place: (r.match, r.exact) for r in got if r.k == 1} == want and [(r.match, r.exact) for r in got if r.k == 2] == [(None, False)]


def test_annotation_files(spark):
    long_form = 'File type = "ooTextFile"\nitem [1]:\nclass = "IntervalTier"\nname = "words"\nxmin = 0\nxmax = 2.5\nintervals: size = 2\nintervals [1]:\nxmin = 0\nxmax = 1.5\ntext = "he said ""no"""\nintervals [2]:\nxmin = 1.5\nxmax = 2.5\ntext = ""\nitem [2]:\nclass = "IntervalTier"\nname = "phones"\nxmin = 0\nxmax = 2\nintervals: size = 1\nintervals [1]:\nxmin = 0\nxmax = 2\ntext = "p"\n'
    short = '"IntervalTier"\n"words"\n0\n3\n1\n0\n3\n"x"\n"IntervalTier"\n"phones"\n0\n3\n1\n0\n3\n"q"\n'
    files = spark.createDataFrame([("l", long_form), ("s", short), ("e", ""), ("n", None)], "f string, c string")
    got = sorted((r.f, r.n, r.on, r.off, r.label) for r in alignment.textgrid_intervals(files, "c", "words").collect())
    assert got == [("l", 1, 0.0, 1.5, 'he said "no"'), ("l", 2, 1.5, 2.5, ""), ("s", 1, 0.0, 3.0, "x")]
    assert [r.label for r in alignment.textgrid_intervals(files, "c", "phones").orderBy("f").collect()] == ["p", "q"]
    assert spark.range(1).select(alignment.han(F.lit("a不b一"))).first()[0] == ["不", "一"]


def test_sinks(spark, tmp_path):
    frame = spark.createDataFrame([(1, None, "x"), (2, None, "y")], "k int, empty string, v string")
    assert sinks.without_empty(frame).columns == ["k", "v"] and sinks.without_empty(frame.limit(0)).columns == frame.columns
    out = f"file://{tmp_path}/long"
    sinks.write_long(frame, out, "k")
    sinks.write_long(frame.where("k = 2").withColumn("v", F.lit("new")), out, "k")
    assert sorted(r.v for r in spark.read.parquet(out).collect()) == ["new", "x"]
    at = f"file://{tmp_path}/record"
    mark = sinks.locked(spark, at, {"a": 1, "b": [2]}, False)
    assert sinks.locked(spark, at, {"b": [2], "a": 1}, True) == mark and sinks.read_record(spark, at, late=5)["late"] == 5
    with pytest.raises(ContractError):
        sinks.locked(spark, at, {"a": 2}, True)
    arrays = spark.createDataFrame([(2, [3.0]), (1, [4.0])], "k int, v array<double>")
    assert sinks.export_array(arrays, "k", "v").tolist() == [[4.0], [3.0]]
    with pytest.raises(ContractError):
        sinks.export_array(arrays, "k", "v", 1)


def test_legendre_contours_and_helmert_codes(spark):
    """Against a least-squares fit and the codes' definition; short keys, flat spans, nulls and an empty table."""
    rng = np.random.default_rng(12)
    rows = [("a", float(i), float(v)) for i, v in enumerate(rng.normal(size=11))] + [("b", float(i), None if i == 2 else float(i * i)) for i in range(6)]
    rows += [("c", 0.0, 1.0), ("c", 1.0, 2.0), ("c", 2.0, 5.0)] + [("d", 3.0, 1.0)] * 5 + [(None, float(i), 2.0) for i in range(4)]
    frame = spark.createDataFrame(rows, "k string, t double, v double")
    got = {r.k: r for r in signals.legendre_contours(frame, ["k"], "t", "v").collect()}
    assert len(got) == 5
    for k in ("a", "b", None):
        t, v = (np.array([r[j] for r in rows if r[0] == k and r[2] is not None], float) for j in (1, 2))
        every = [r[1] for r in rows if r[0] == k]
        want = np.polynomial.legendre.legfit(2 * (t - min(every)) / (max(every) - min(every)) - 1, v, 2)
        assert np.allclose([got[k].level, got[k].slope, got[k].bend], want) and got[k].n == len(v)
    assert [got[k].level for k in ("c", "d")] == [None, None] and (got["c"].n, got["d"].n) == (3, 0)
    assert signals.legendre_contours(frame.limit(0), ["k"], "t", "v").count() == 0

    coded = signals.helmert_codes(spark.createDataFrame([("x",), ("y",), ("z",), ("?",), (None,)], "s string"), "s", ["x", "y", "z"]).collect()
    h = np.array([[r.code_1, r.code_2] for r in coded[:3]])
    assert np.allclose(h.T @ h, np.eye(2)) and np.allclose(h.sum(axis=0), 0) and h[2, 0] == 0
    assert all(r.code_1 is None and r.code_2 is None for r in coded[3:])
