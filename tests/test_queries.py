"""Every query with SQL against DuckDB, and the operators on small cases made by hand."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lockstep.functions import scalars as sc
from lockstep.operators import dense, joins, resampling, sequences
from lockstep.operators import summaries as agg
from lockstep.plans import QUERIES, SQL
from lockstep.sources import tables
from tests import plain


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


def normal(rows, names, order):
    at = [names.index(c) for c in order]
    return sorted((tuple(round(float(r[i]), 5) if isinstance(r[i], float) else r[i] for i in at) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf, duck, name):
    frame = QUERIES[name](spark, sf)
    found = duck.execute(SQL[name])
    names, order = [d[0] for d in found.description], sorted(frame.columns)
    assert sorted(names) == order
    assert normal(map(tuple, frame.collect()), frame.columns, order) == normal(found.fetchall(), names, order)


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) <= set(e.queries())


def series(spark, values, key="a"):
    return spark.createDataFrame([(key, i, float(v)) for i, v in enumerate(values)], "k string, t int, v double")


def test_clusters_merge_signs(spark):
    frame = series(spark, [0, 0, 3, -3, 0]).union(series(spark, [0, 4, 4, 4, 0], "b"))
    assert sorted(r.mass for r in sequences.clusters(frame, ["k"], "t", "v", 2).collect()) == [6.0, 12.0]
    assert sequences.clusters(frame.limit(0), ["k"], "t", "v", 2).count() == 0


def test_largest_overlap_clips(spark):
    spans = spark.createDataFrame([("s", 1, 1.0, 2.0), ("s", 2, 2.0, 3.0)], "k string, span_id int, start double, end double")
    pieces = spark.createDataFrame([("s", 1, 1.9, 2.3), ("s", 2, 1.7, 2.05), ("s", 3, 5.0, 6.0), ("s", 4, 1.5, 2.5)], "k string, piece_id int, on double, off double")
    got = {r.piece_id: (r.span_id, r.clip_on, r.clip_off) for r in joins.largest_overlap(pieces, spans, ["k"], 0.01, 0.5).collect()}
    assert got == {1: (2, 2.0, 2.3), 2: (1, 1.7, 2.0), 4: (1, 1.5, 2.0)}


def test_nearest_prefers_earlier_and_respects_bound(spark):
    left = spark.createDataFrame([("k", 5), ("k", 20), ("k", 100), ("x", 1)], "k string, t int")
    right = spark.createDataFrame([("k", 3, 1), ("k", 7, 2), ("k", 22, 3), ("k", 22, 2)], "k string, t int, v int")
    got = {(r.k, r.t): r.nearest_v for r in joins.nearest_in_time(left, right, ["k"], "t", "v", 10).collect()}
    assert got == {("k", 5): 1, ("k", 20): 2, ("k", 100): None, ("x", 1): None}


def test_slice_puts_an_impulse_at_zero(spark):
    samples = series(spark, [1.0 if i == 100 else 0.0 for i in range(200)]).withColumnRenamed("t", "s")
    cut = joins.slice_around(spark.createDataFrame([("a", 100, "on"), ("a", 110, "off")], "k string, at int, lock string"), samples, ["k"], "at", "s", 20, 20)
    assert sorted((r.lock, r.t) for r in cut.where("v = 1").collect()) == [("off", -10), ("on", 0)]


def test_blocks_parity_latency(spark):
    at = spark.createDataFrame([(float(t),) for t in (5, 20, 40, 70, 80, 100, 130, 150, 170)], "t double")
    halves = [r[0] for r in at.select(sequences.odd_even(F.col("t"), F.lit(5.0), 60.0)).collect()]
    assert halves == ["odd"] * 3 + ["even"] * 3 + ["odd"] * 3
    r = sequences.latencies(series(spark, [0, 0, 0, 1, 0]), ["k"], "t", "v").first()
    assert (r.peak_at, r.half_area_at, r.half_max_at) == (3, 3, 3)
    r = sequences.latencies(series(spark, [-1, -1]), ["k"], "t", "v").first()
    assert r.half_area_at is None and r.half_max_at is None
    blocks = [r[0] for r in spark.range(1, 21).select(sequences.block_id(F.col("id"), F.lit(20), 8)).collect()]
    assert blocks == sorted(blocks) and set(blocks) == set(range(1, 9))


def test_circular_shift_wraps(spark):
    got = {r.t: r.v for r in sequences.circular_shift(series(spark, [0, 1, 2, 3]), ["k"], ["t"], ["v"], 1).collect()}
    assert got == {0: 3.0, 1: 0.0, 2: 1.0, 3: 2.0}


def test_scalars(spark):
    rows = spark.createDataFrame([("8;6", "a1"), ("８；6", "sil"), ("9,5", "b5"), (None, None), ("x", "3")], "age string, phone string")
    assert [r[0] for r in rows.select(sc.age_years(F.col("age"))).collect()][::2] == [8.5, 9.5, None]
    assert [tuple(r) for r in rows.select(*sc.trailing_tone(F.col("phone"))).collect()] == [("a", 1), ("sil", None), ("b", 5), (None, None), ("", 3)]
    one = spark.range(1)
    pick = lambda c: one.select(c).first()[0]
    assert pick(sc.list_items(F.lit("RN105 RN105,RN106;; "))) == ["RN105", "RN106"]
    assert pick(sc.one_hot(F.lit(2), 3)) == [0, 1, 0, 0] and pick(sc.one_hot(F.lit(None).cast("int"), 2)) == [0, 0, 1]
    arr = lambda *x: F.array(*[F.lit(v).cast("double") for v in x])
    assert pick(sc.rmse(arr(1, 1, 1, 1), arr(0, 0, 0, 0))) == 1.0 and pick(sc.rmse(arr(1, 1, 1, None), arr(0, 0, 0, 0))) is None
    assert pick(sc.cosine(arr(0, 0), arr(1, 2))) is None and pick(sc.cosine(arr(1, 2), arr(2, 4))) == pytest.approx(1)
    assert pick(sc.modal_index(arr(1, 5, 5))) == 2
    assert [pick(sc.gate(F.lit(x))) for x in (0.5, 0.3, 0.1, float("nan"))] == ["good", "fair", "poor", "unknown"]
    assert [pick(sc.stars(F.lit(x))) for x in (0.0001, 0.005, 0.04, 0.5)] == ["***", "**", "*", ""]
    assert len(sc.log_grid(-8, 8, 0.5)) == 33


def test_contracts(spark, tmp_path):
    frame = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("b", None)], "g string, v double")
    for bad in (lambda: tables.check_unique(frame, "g"), lambda: tables.check_finite(frame, "v"), lambda: tables.check_counts(frame, "g", {"a": 1, "b": 1})):
        with pytest.raises(tables.ContractError):
            bad()
    assert tables.check_counts(frame, "g", {"a": 2, "b": 1}) is frame and tables.complete_cases(frame, "v").count() == 1
    (tmp_path / "x.csv").write_text("id,ok\n1,True\n2,\n3,0\n")
    csv = tables.read_csv(spark, str(tmp_path / "x.csv"), "id int, ok string", ("id",))
    assert [r.id for r in csv.where(tables.truthy(F.col("ok"))).collect()] == [1]
    with pytest.raises(tables.ContractError):
        tables.read_csv(spark, str(tmp_path / "x.csv"), "id int, ok string", ("other",))


def test_permutation_keeps_group_sizes(spark):
    units = spark.createDataFrame([(i, i < 7) for i in range(20)], "u int, label boolean")
    dealt = resampling.shuffled_labels(units, "u", "label", 30)
    assert {r.c for r in dealt.groupBy("rep").agg(F.count_if("label").alias("c")).collect()} == {7}
    assert dealt.where("rep = 0 and label <> (u < 7)").count() == 0 and dealt.where("rep > 0 and label <> (u < 7)").count() > 0


def test_holm_and_icc(spark):
    tests = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "n string, p double")
    assert {r.n: round(r.p_holm, 6) for r in agg.holm(tests, "p", ["n"]).collect()} == {"a": 0.03, "c": 0.06, "b": 0.06}
    same = spark.createDataFrame([("k", float(i), float(i)) for i in range(5)], "k string, a double, b double")
    assert agg.icc21(same, ["k"], "a", "b").first().icc == pytest.approx(1)


def test_back_to_back_finds_planted_features(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = x[:, :2] @ rng.normal(size=(2, 12)) + rng.normal(size=(400, 12))
    rows = [(1, 0, i, i // 50, x[i].tolist(), y[i].tolist()) for i in range(400)]
    frame = spark.createDataFrame(rows, "participant long, time int, trial int, block int, x array<double>, y array<double>")
    got = dense.b2b_scores(frame, {"seen": 2, "absent": 1}, sc.log_grid(-4, 4, 1), splits=4).groupBy("family").agg(F.avg("score").alias("s"), F.count("*").alias("n"))
    score = {r.family: r.s for r in got.collect()}
    assert score["seen"] > 0.3 and abs(score["absent"]) < score["seen"] / 4
    assert dense.b2b_scores(frame.limit(0), {"seen": 2}, [1.0]).count() == 0


def test_dense_kernels():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(50, 4)), rng.normal(size=(50, 3))
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(plain.ridge(x, y, 2.0), (vt.T * (s / (s**2 + 2))) @ u.T @ y)
    t = np.arange(3000) / 100
    two, six = np.sin(2 * np.pi * 2 * t), np.sin(2 * np.pi * 6 * t)
    delta, theta = plain.bandpass(two + six, 100, 1, 4), plain.bandpass(two + six, 100, 4.5, 9)
    power = lambda a, b: abs(float(a @ b))
    assert power(delta, two) > 5 * power(delta, six) and power(theta, six) > 5 * power(theta, two)
    epochs = rng.normal(size=(60, 6, 40))
    bump = np.exp(-0.5 * ((np.arange(40) - 20) / 4) ** 2)
    epochs += 0.7 * np.array([1, -1, 0.5, 0, 0, 2])[None, :, None] * bump
    w = plain.evoked_components(epochs, 2)
    assert abs(np.corrcoef(w[:, 0] @ epochs.mean(axis=0), bump)[0, 1]) > 0.9
    h = plain.helmert(4)
    assert np.allclose(h.T @ h, np.eye(3)) and np.allclose(h.sum(axis=0), 0)
    assert np.allclose(plain.legendre_fit(np.full(10, 2.0))[0], 2) and np.isnan(plain.legendre_fit(np.full(10, np.nan))).all()
    nuisance = rng.normal(size=(50, 2))
    shifted = plain.freedman_lane(x, nuisance, 7)
    assert np.allclose(plain.residual(x, nuisance), np.roll(shifted - (x - plain.residual(x, nuisance)), -7, axis=0))
    assert np.allclose(plain.residual(plain.drift_basis(100, 5)[:, :1] * 3, plain.drift_basis(100, 5)), 0)
    scores, load = plain.standardised_components(x, 2)
    assert scores.shape == (50, 2) and load.shape == (4, 2) and np.allclose(scores.std(axis=0, ddof=1), 1)
    assert np.isnan(plain.tuned_alpha(y[:3], x[:3], np.arange(3), [1.0])[0])


def test_streams_equal_batches(spark, sf, tmp_path):
    from lockstep.streaming import windows

    batch = spark.read.parquet(f"{sf}/events.parquet")
    os.makedirs(tmp_path / "in")
    batch.repartition(3).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    for name, f in (("tumbles", lambda e: windows.tumbling(e, "6 hours")), ("gaps", lambda e: windows.sessions(e, "12 hours"))):
        q = f(stream).writeStream.outputMode("complete" if name == "tumbles" else "append").format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination()
        want = f(batch)
        if name == "tumbles":
            assert sorted(map(str, spark.table(name).select("event_type", "n").collect())) == sorted(map(str, want.select("event_type", "n").collect()))
        else:
            held = lambda d: d.select("user_id", "n", F.col("session_window.start").cast("string").alias("start"), F.col("session_window.end").cast("string").alias("end")).collect()
            last = batch.selectExpr("string(max(ts) - interval 10 minutes) as t").first().t
            # all sessions that the watermark has passed come out; compared outside Spark, since a filter on a session's end is pushed below its making
            assert sorted(map(str, held(spark.table(name)))) == sorted(str(r) for r in held(want) if r.end <= last) and spark.table(name).count() > 0
    q = windows.without_repeats(stream.union(stream)).writeStream.outputMode("append").format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == batch.count()
