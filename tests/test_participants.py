"""Resampling by weights, rates and envelopes, tones and templates, participants' tables."""

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lockstep.functions import scalars as sc
from lockstep.functions.distributions import t_quantile
from lockstep.operators import assembly, sequences, signals, weights
from lockstep.sources import tables


def plain_test(values, first, second, threshold):
    """Largest cluster mass over the rows of values (key x unit x time) for two lists of units."""
    best = 0.0
    for table in values:
        a, b = table[first], table[second]
        t = (a.mean(axis=0) - b.mean(axis=0)) / np.sqrt(a.var(axis=0, ddof=1) / len(a) + b.var(axis=0, ddof=1) / len(b))
        run = 0.0
        for v in np.abs(t):
            run = run + v if v > threshold else 0.0
            best = max(best, run)
    return best


@pytest.fixture(scope="module")
def cohort(spark):
    rng = np.random.default_rng(3)
    values = rng.normal(size=(2, 11, 8))
    values[0, :6, 2:6] += 1.2
    rows = [(f"k{k}", u, t, float(values[k, u, t])) for k in range(2) for u in range(11) for t in range(8)]
    frame = spark.createDataFrame(rows, "key string, unit int, time int, v double").repartition(5)
    units = spark.createDataFrame([(u, u < 6) for u in range(11)] + [(99, None)], "unit int, label boolean")
    return values, frame, units


def test_bootstrap_of_the_whole_cluster_test(spark, cohort):
    values, frame, units = cohort
    got = {r.draw: r for r in weights.nested_cluster_p(frame, "unit", ["key"], "time", "v", weights.bootstrap_counts(units, "unit", "label", 5, 20), 5, 20, 1.5).collect()}
    assert sorted(got) == list(range(6))
    for draw, r in got.items():
        rng = np.random.default_rng([0, draw])
        drawn = np.concatenate([g if draw == 0 else rng.choice(g, len(g)) for g in (np.arange(6), np.arange(6, 11))])
        orders = [drawn] + [rng.permutation(drawn) for _ in range(20)]
        with np.errstate(divide="ignore", invalid="ignore"):
            mass = [plain_test(values, o[:6], o[6:], 1.5) for o in orders]
        assert r.mass == pytest.approx(mass[0])
        assert r.p == (1.0 if mass[0] == 0 else pytest.approx((1 + sum(m >= mass[0] - 1e-9 for m in mass[1:])) / 21))


def test_leave_one_out_of_the_cluster_test(spark, cohort):
    values, frame, units = cohort
    counts, out = weights.left_out_counts(units, "unit", "label", 10)
    got = {r.draw: r for r in weights.nested_cluster_p(frame, "unit", ["key"], "time", "v", counts, 11, 10, 1.5).collect()}
    assert dict(out.collect()) == {u + 1: u for u in range(11)}
    for draw in range(12):
        here = np.array([u for u in range(11) if u != draw - 1])
        assert got[draw].mass == pytest.approx(plain_test(values, here[here < 6], here[here >= 6], 1.5)) and 0 < got[draw].p <= 1


def test_sums_of_many_chunks_and_units(spark, cohort, monkeypatch):
    values, frame, units = cohort
    dealt = units.withColumn("rep", F.explode(F.array(*[F.lit(k) for k in range(3)]))).withColumn("label", F.when(F.col("rep") == 1, ~F.col("label")).otherwise(F.col("label")))
    monkeypatch.setattr(weights, "HELD", 6 * 3 * 5)  # five cells a chunk
    found = weights.resampled(frame, "unit", ["key", "time"], "v", weights.labels_of(dealt, "unit", "label"), weights.by_label, 3).collect()
    assert len(found) == 3 * 16
    for r in found:
        k = int(r.key[1])
        first = values[k, :6, r.time] if r.rep != 1 else values[k, 6:, r.time]
        assert (r.n1, r.s1, r.q1) == (len(first), pytest.approx(first.sum()), pytest.approx((first**2).sum())) and r.n1 + r.n0 == 11
    assert weights.resampled(frame.limit(0), "unit", ["key", "time"], "v", weights.labels_of(dealt, "unit", "label"), weights.by_label, 3).count() == 0


def test_envelope_of_a_modulated_tone(spark):
    t = np.arange(3000) / 50
    size = 1 + 0.5 * np.sin(2 * np.pi * 0.1 * t)
    rows = [("a", i, float(s)) for i, s in enumerate(size * np.sin(2 * np.pi * 4 * t))]
    frame = spark.createDataFrame(rows, "k string, i int, v double")
    taps = signals.bandpass_taps(50.0, 2.0, 8.0, 200), signals.quadrature_taps(50.0, 2.0, 8.0, 200)
    got = np.array([r.envelope for r in sorted(signals.envelope(frame, ["k"], "i", "v", *taps, slice_rows=700).collect(), key=lambda r: r.i)])
    assert np.abs(got - size)[200:-200].max() < 0.02 * size.max()


def test_resampling_from_100_to_64(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=1111)
    taps = signals.resample_taps(16, 25)
    frame = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "k int, i int, v double").repartition(3)
    got = sorted(signals.resampled(frame, ["k"], "i", "v", 16, 25, taps, slice_rows=100).collect(), key=lambda r: r.place)
    stuffed = np.zeros(1111 * 16)
    stuffed[::16] = x
    want = np.convolve(stuffed, taps)[len(taps) // 2 :][: 1111 * 16 : 25]
    assert [r.place for r in got] == list(range(math.ceil(1111 * 16 / 25))) and np.allclose([r.resampled for r in got], want)
    t = np.arange(1111) / 100
    tone = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(np.sin(2 * np.pi * 5 * t))], "k int, i int, v double")
    back = np.array([r.resampled for r in sorted(signals.resampled(tone, ["k"], "i", "v", 16, 25, taps).collect(), key=lambda r: r.place)])
    assert np.abs(back - np.sin(2 * np.pi * 5 * np.arange(len(back)) / 64))[20:-20].max() < 0.01
    assert signals.resampled(tone.limit(0), ["k"], "i", "v", 16, 25, taps).count() == 0


def test_tones_by_longest_contour(spark):
    cases = [("a˥", "a", 1), ("a˧˥", "a", 2), ("a˨˩˦", "a", 3), ("a˥˩", "a", 4), ("ə˧", "ə", 5), ("o˩", "o", 3), ("aj˨˩˦", "aj", 3), ("tʰ", "tʰ", None), ("a1", "a", 1), ("sil", "sil", None), ("SPN ", "sil", None), (None, "sil", None), ("", "sil", None)]
    frame = spark.createDataFrame([(c[0],) for c in cases], "label string")
    phone, tone = sc.phone_and_tone(F.col("label"))
    assert [(r.p, r.t) for r in frame.select(phone.alias("p"), tone.alias("t")).collect()] == [c[1:] for c in cases]


def test_nearest_template(spark):
    shapes = {"1": np.full(10, 0.4), "2": np.linspace(-0.5, 0, 10), "3": np.linspace(0, -1, 10), "4": np.linspace(0.5, 0.1, 10)}
    templates = spark.createDataFrame([(n, s.tolist()) for n, s in shapes.items()], "name string, t array<double>")
    gap = [*[float("nan")] * 7, 0.1, 0.2, 0.3]
    rows = spark.createDataFrame([(0, shapes["1"].tolist()), (1, shapes["4"].tolist()), (2, np.linspace(0.48, 0.12, 10).tolist()), (3, gap), (4, None)], "i int, v array<double>")
    got = [r.nearest for r in sorted(signals.nearest_template(rows, "v", templates, "name", "t").collect(), key=lambda r: r.i)]
    assert got == ["1", "4", "4", None, None]
    assert signals.nearest_template(rows, "v", templates.limit(0), "name", "t").where("nearest is not null").count() == 0
    with pytest.raises(ValueError):
        signals.nearest_template(rows, "v", templates, "name", "t", most=3)


def test_rime_windows(spark):
    kind = "i int, p array<struct<on: double, off: double, phone: string>>, a double, b double"
    rows = [(0, [(0.0, 0.04, "j"), (0.04, 0.18, "ow"), (0.18, 0.22, "n")], 0.0, 0.22), (1, [(0.0, 0.05, "t"), (0.05, 0.1, "s")], 0.0, 0.1), (2, [(0.0, 0.08, "j")], 0.0, 0.08), (3, [(0.1, 0.2, "a")], 0.0, 0.1)]
    nuclei = ["a", "ow", "e"]
    window = signals.rime_window(F.col("p"), F.col("a"), F.col("b"), nuclei)
    got = [r.w for r in spark.createDataFrame(rows, kind).orderBy("i").select(window.alias("w")).collect()]
    assert tuple(got[0]) == (0.04, 0.22, "ow") and got[1:] == [None] * 3
    with pytest.raises(PySparkException):
        spark.createDataFrame([(0, [(0.0, 0.1, "a")], 0.05, 0.2)], kind).select(window.alias("w")).collect()


def test_cosine_to_earlier_rows_that_count(spark):
    rows = [("k", 0, [1.0, 0.0], True), ("k", 1, None, True), ("k", 2, [0.0, 1.0], False), ("k", 3, [1.0, 1.0], True), ("k", 4, [0.0, 2.0], True), ("k", 5, [1.0, 0.0], True), ("k", 6, [1.0, 0.0], None)]
    frame = spark.createDataFrame(rows, "k string, i int, v array<double>, c boolean")
    got = [r.cosine for r in sequences.earlier_cosine(frame, ["k"], ["i"], "v", F.col("c")).orderBy("i").collect()]
    h = math.sqrt(0.5)
    assert got[:2] == [None, None]
    assert got[2:] == [pytest.approx(x) for x in (0.0, h, (0 + h) / 2, (1 + h + 0) / 3, (h + 0 + 1) / 3)]


def test_t_quantiles():
    for p, df, t in ((0.975, 10, 2.2281388519649385), (0.975, 1, 12.706204736432095), (0.95, 30, 1.6972608943617378), (0.025, 10, -2.2281388519649385), (0.5, 4, 0.0)):
        assert t_quantile(p, df) == pytest.approx(t)
    with pytest.raises(ValueError):
        t_quantile(1.0, 3)


def test_participant_table_and_widths(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, g string")
    part = spark.createDataFrame([(1, 5.0)], "id int, x double")
    assert sorted(map(tuple, assembly.participant_table(base, "id", [part]).collect())) == [(1, "a", 5.0), (2, "b", None)]
    with pytest.raises(ValueError):
        assembly.participant_table(base, "id", [part.union(part)])
    with pytest.raises(ValueError):
        assembly.participant_table(base, "id", [part.withColumnRenamed("x", "g")])
    rows = spark.createDataFrame([([1.0, 2.0],), ([0.0, 0.0],), ([1.0],), (None,), ([float("nan"), 1.0],), ([None, 1.0],)], "v array<double>")
    assert tuple(tables.width_report(rows, {"v": 2}).first()) == ("v", 6, 2, 1, 2)
    assert tables.check_widths(rows.limit(1), {"v": 2}).count() == 1
    with pytest.raises(tables.ContractError):
        tables.check_widths(rows, {"v": 2})
