"""Columns of designs, exclusions and fills on small cases."""

import pytest
from pyspark.sql import functions as F

from lockstep.operators import alignment
from lockstep.operators import features as fe
from lockstep.operators import summaries as agg
from lockstep.sources import feature_store, tables


def test_columns_have_families(spark):
    rows = spark.createDataFrame([(k,) for k in (0, 1, 2, 3, 4, 9, -1, None)], "c int")
    family, place = fe.family_of(F.col("c"), {"a": 2, "b": 2})
    got = [tuple(r) for r in rows.select(family, place).collect()]
    assert got == [("a", 0), ("a", 1), ("b", 0), ("b", 1), ("nuisance", 0), ("nuisance", 5), (None, None), (None, None)]
    assert [tuple(r) for r in rows.select(*fe.family_of(F.col("c"), {}, "rest")).limit(1).collect()] == [("rest", 0)]


def test_columns_that_are_kept(spark):
    rows = [("flat", 1.0)] * 5 + [("rare", float(i == 0)) for i in range(30)] + [("flag", float(i % 2)) for i in range(30)] + [("wide", float(i)) for i in range(5)] + [("out", float(i)) for i in range(5)] + [("none", None), ("nan", float("nan"))]
    got = {r.c: (r.binary, r.kept) for r in fe.kept_columns(spark.createDataFrame(rows, "c string, x double"), "c", "x", ["out"]).collect()}
    assert got == {"flat": (True, False), "rare": (True, False), "flag": (True, True), "wide": (False, True), "out": (False, False), "none": (False, False), "nan": (False, False)}


def test_reference_and_largest_group(spark):
    rows = spark.createDataFrame([("a",)] * 4 + [("b",)] * 4 + [("c",)] * 3 + [("d",), (None,)], "l string")
    assert dict(fe.reference_levels(rows, "l", 2).groupBy("coded").count().collect()) == {None: 4, "b": 4, "c": 3, "other": 2}
    assert dict(fe.without_largest(rows, "l").groupBy("l").count().collect()) == {"b": 4, "c": 3, "d": 1, None: 1}
    assert fe.without_largest(rows.limit(0), "l").count() == 0


def test_evidence_on_contrasts(spark):
    rows = spark.createDataFrame([(0, "x", [0.5, 0.25, 0.25]), (1, "z", [0.2, 0.2, 0.6]), (2, "?", [1.0, 0.0, 0.0]), (3, "x", None)], "i int, y string, p array<double>")
    got = {r.i: (r.evidence, r.residual) for r in fe.evidence(rows, "y", ["x", "y", "z"], "p").collect()}
    h = [[2**-0.5, 6**-0.5], [-(2**-0.5), 6**-0.5], [0, -2 * 6**-0.5]]
    for i, y in ((0, 0), (1, 2)):
        p = rows.where(F.col("i") == i).first().p
        assert got[i][0] == pytest.approx([sum(p[k] * h[k][j] for k in range(3)) for j in (0, 1)])
        assert got[i][1] == pytest.approx([sum(((k == y) - p[k]) * h[k][j] for k in range(3)) for j in (0, 1)])
    assert got[2] == got[3] == (None, None)


def test_exclusions_and_fills(spark):
    rows = spark.createDataFrame([("a", 1), ("b", None), (None, 3)], "k string, v int")
    assert sorted(map(str, tables.excluding(rows, "k", "a; a").collect())) == ["Row(k='b', v=None)", "Row(k=None, v=3)"]
    assert tables.excluding(rows, "k", " ").count() == 3
    with pytest.raises(tables.ContractError):
        tables.excluding(rows, "k", "a,zz")
    found = spark.createDataFrame([("a", 9), ("b", 8), ("c", 7), (None, 6)], "k string, v int")
    assert dict(tables.backfilled(rows, found, ["k"]).collect()) == {"a": 1, "b": 8, "c": 7, None: 3}


def test_units_waves_and_extremes(spark):
    rows = spark.createDataFrame([(5.0, 2.0, 1000), (500.0, 250.0, 1000), (None, 1.0, 1000)], "a double, b double, n int")
    assert [tuple(r) for r in rows.select(*fe.in_seconds(F.col("a"), F.col("b"), 100.0, F.col("n"))).limit(2).collect()] == [(2.0, 5.0), (2.5, 5.0)]
    x = spark.createDataFrame([(1, -5.0), (2, 5.0), (3, 1.0), (4, None)], "i int, v double")
    assert [(r.i, r["rank"]) for r in fe.most_extreme(x, "v", 2, "i").orderBy("rank").collect()] == [(1, 1), (2, 2)]
    w = spark.createDataFrame([("s", "k", 1.0), ("s", "k", 3.0), ("t", "k", 4.0)], "s string, k string, v double")
    assert tuple(agg.subject_waves(w, "s", ["k"], "v").first()) == ("k", 3.0, pytest.approx(1.0), 2)


def test_syllables(spark):
    cases = {"zhang1": ("zh", "ang", 1), "zh2": ("z", "h", 2), "nü3": ("n", "v", 3), "er2": ("", "er", 2), "A": ("", "a", None), None: (None, None, None)}
    rows = spark.createDataFrame([(c,) for c in cases], "s string")
    got = [tuple(r) for r in rows.select("s", *fe.syllable_parts(F.col("s"))).collect()]
    assert all(g[1:] == cases[g[0]] or g[0] is None for g in got)


def test_features_on_disk(spark, tmp_path):
    path, names = str(tmp_path / "store"), {"pitch": ["low", "high"], "env": ["size"]}
    rows = [("pitch", s, p, [float(p), float(s)]) for s in (1, 2) for p in range(5)] + [("env", s, p, [0.5]) for s in (1, 2) for p in range(3)]
    frame = spark.createDataFrame(rows, "feature string, section int, place long, values array<double>")
    feature_store.write_features(frame, path, names)
    got = feature_store.read_features(spark, path, ["pitch"], [2])
    assert sorted(map(tuple, got.collect())) == sorted(r for r in rows if r[:2] == ("pitch", 2))
    assert feature_store.read_features(spark, path, ["pitch", "env"]).count() == 16 and feature_store.feature_names(spark, path, "pitch") == ["low", "high"]
    feature_store.write_features(frame.where("feature = 'env' and section = 2 and place < 2"), path, {"env": ["size"]})
    assert feature_store.read_features(spark, path, ["env"]).count() == 5 and feature_store.feature_names(spark, path, "pitch") == ["low", "high"]
    for bad in (("pitch", 1, 0, [1.0]), ("pitch", 1, 0, [1.0, float("nan")]), ("pitch", None, 0, [1.0, 1.0]), ("pitch", 1, None, [1.0, 1.0]), ("pitch", 1, 0, None), ("other", 1, 0, [1.0])):
        with pytest.raises(tables.ContractError):
            feature_store.write_features(spark.createDataFrame([bad], frame.schema), path, names)
    with pytest.raises(tables.ContractError):
        feature_store.write_features(frame.union(frame), path, names)
    with pytest.raises(tables.ContractError):
        feature_store.read_features(spark, path, ["pitch"], [1, 3])
    frame.where("feature = 'env' and section = 1").withColumn("place", F.col("place") + 1).drop("feature", "section").write.mode("overwrite").parquet(f"{path}/blocks/feature=env/section=1")
    with pytest.raises(tables.ContractError):
        feature_store.read_features(spark, path, ["env"])
    assert feature_store.read_features(spark, path, ["pitch"]).count() == 10


def test_longest_entry_that_begins_a_text(spark):
    rows = spark.createDataFrame([("zhang",), ("z",), ("",), (None,), ("éa",), ("q",), ("zhang",)], "t string")
    entries = spark.createDataFrame([("z",), ("zh",), ("",), ("é",), (None,), ("zhangx",)], "e string")
    assert sorted(map(tuple, alignment.canonical(rows, "t", entries, "e").collect()), key=str) == sorted([("zhang", "zh"), ("zhang", "zh"), ("z", "z"), ("", None), (None, None), ("éa", "é"), ("q", None)], key=str)
    assert alignment.canonical(rows, "t", entries.limit(0), "e").where("canonical is not null").count() == 0
    axis = spark.createDataFrame([(0.5 * i, i) for i in range(5)], "t double, i int")
    with pytest.raises(ValueError):
        alignment.nearest_sample(axis, axis, "t", "i", most=4)


def test_quantiles_of_small_and_large_keys_agree(spark):
    rows = [("a", float(i * 37 % 101)) for i in range(101)] + [("b", 1.0)] * 5 + [("b", 2.0), (None, 3.0), ("c", None)]
    frame = spark.createDataFrame(rows, "k string, v double").repartition(3)
    shares = {"low": 0.1, "mid": 0.5, "high": 0.975}
    small, large = (sorted((r.k or "", round(r.low, 9), round(r.mid, 9), round(r.high, 9)) for r in agg.quantiles(frame, ["k"], "v", shares, most=m).collect()) for m in (1 << 17, 0))
    assert small == large == [("", 3.0, 3.0, 3.0), ("a", 10.0, 50.0, 97.5), ("b", 1.0, 1.0, 1.875)]
