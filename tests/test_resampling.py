"""Resampled tests over tables whose repetitions are far larger than they are: nothing of that size goes through the driver."""

from contextlib import contextmanager
from hashlib import md5

import numpy as np
import pytest

from __spark_entry__ import queries
from lockstep.operators import resampling

SUPPLIERS = 1000


def hashed(*parts):
    return int(md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2**32


@contextmanager
def small_broadcasts(spark):
    """An error where more than 2 MB are broadcast; units alone are far less, their 200 repetitions more."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", "2m")
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")


def broadcast_rows(frame):
    """The most rows that a broadcast of ``frame``'s plan held when it was collected. (Other keys than one number take a page of 32 MB at least, so that sizes don't tell.)"""

    def walk(plan):
        name, kids = plan.nodeName(), plan.children()
        yield plan.metrics().apply("numOutputRows").value() if name == "BroadcastExchange" else 0
        inner = [plan.plan()] if name.endswith("QueryStage") else [plan.executedPlan()] if name == "AdaptiveSparkPlan" else []
        for p in [*inner, *(kids.apply(i) for i in range(kids.size()))]:
            yield from walk(p)

    return max(walk(frame._jdf.queryExecution().executedPlan()))


def dealt(rows, label):
    """The labels of ``rows``, which are in order of their units, in repetitions 0 to 200: repetitions x units."""
    units, labels = [r[0] for r in rows], np.array([label(r) for r in rows])
    out = np.repeat(labels[None], 201, axis=0)
    for rep in range(1, 201):
        order = sorted(range(len(units)), key=lambda i: (hashed("label", rep, units[i]), units[i]))
        out[rep, order] = labels
    return out


@pytest.fixture(scope="module")
def suppliers(spark, tmp_path_factory):
    """A folder with suppliers alone: key, nation and balance."""
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(25)), float(np.round(rng.normal(), 4))) for i in rng.permutation(SUPPLIERS).tolist()]
    folder = str(tmp_path_factory.mktemp("suppliers"))
    spark.createDataFrame(rows, "s_suppkey long, s_nationkey int, s_acctbal double").coalesce(1).write.parquet(f"{folder}/supplier.parquet")
    return folder, sorted(rows)


def test_bootstrap_interval_without_large_broadcasts(spark, suppliers):
    folder, rows = suppliers
    with small_broadcasts(spark):
        got = queries()["bootstrap_interval"](spark, folder).collect()
    groups = [[(s, x) for s, nation, x in rows if (nation < 12) == g] for g in (True, False)]
    mean = lambda own, rep: np.mean([own[int(hashed("boot", rep, s) * len(own))][1] for s, _ in own])
    diffs = [mean(groups[0], rep) - mean(groups[1], rep) for rep in range(1, 201)]
    assert [(r.low, r.high) for r in got] == [pytest.approx(tuple(np.quantile(diffs, [0.025, 0.975])), abs=2e-6)]


def test_bootstrap_rows_place_a_null_unit_last(spark):
    frame = spark.createDataFrame([("k", 2, 20.0), ("k", None, 90.0), ("k", 1, 10.0), ("j", 7, 70.0)], "key string, unit int, x double")
    got = sorted((r.key, r.rep, r.x) for r in resampling.bootstrap_rows(frame, ["key"], "unit", 30).collect())
    want = [("k", rep, [10.0, 20.0, 90.0][int(hashed("boot", rep, *u) * 3)]) for rep in range(1, 31) for u in ((1,), (2,), ())]
    assert got == sorted([*want, *(("j", rep, 70.0) for rep in range(1, 31))])


def test_shuffled_labels_place_a_null_unit_last(spark):
    rows = [(3, "c"), (None, "n"), (1, "a"), (2, None)]
    got = {(r.rep, r.unit): r.label for r in resampling.shuffled_labels(spark.createDataFrame(rows, "unit int, label string"), "unit", "label", 40).collect()}
    want = {}
    for rep in range(41):
        order = sorted((1, 2, 3, None), key=lambda u: (hashed("label", rep, *[u] * (u is not None)) if rep else 0, u is None, u or 0))
        want |= {(rep, u): label for u, label in zip(order, ("a", None, "c", "n"), strict=True)}
    assert got == want


@pytest.fixture(scope="module")
def items(spark, suppliers):
    """Line items of the suppliers: supplier, family, month and quantity; suppliers of the first nations have more in spring."""
    folder, rows = suppliers
    rng = np.random.default_rng(5)
    picked = [(int(s), "ANR"[f], int(m)) for s, f, m in zip(rng.integers(SUPPLIERS, size=6000), rng.integers(3, size=6000), rng.integers(1, 13, size=6000), strict=True)]
    out = [(s, f, m, float(np.round(25 + rng.normal() + 0.4 * (rows[s][1] < 12 and f == "A" and 3 <= m <= 6), 3))) for s, f, m in picked]
    frame = spark.createDataFrame(out, "l_suppkey long, l_returnflag string, m int, l_quantity double")
    frame.selectExpr("l_suppkey", "l_returnflag", "l_quantity", "make_timestamp(1995, m, 2, 0, 0, 0) l_shipdate", "'F' l_linestatus").coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    return out


def cells(values):
    """Mean of each supplier's values in each cell, NaN without: cells in order, suppliers x cells."""
    held = {}
    for s, cell, x in values:
        held.setdefault((s, cell), []).append(x)
    names = sorted({cell for _, cell in held})
    table = np.full((SUPPLIERS, len(names)), np.nan)
    for (s, cell), xs in held.items():
        table[s, names.index(cell)] = np.mean(xs)
    return names, table


def test_label_cluster_test_without_large_broadcasts(spark, suppliers, items):
    folder, rows = suppliers
    asked = queries()["label_cluster_test"](spark, folder)
    got = asked.collect()
    assert broadcast_rows(asked) < 50 * SUPPLIERS
    names, table = cells((s, (f, m), x) for s, f, m, x in items)
    assert names == [(f, m) for f in "ANR" for m in range(1, 13)]
    found, largest = [], []
    for rep, labels in enumerate(dealt(rows, lambda r: r[1] < 12)):
        a, b = table[labels], table[~labels]
        error = sum(np.nanvar(v, axis=0, ddof=1) / np.sum(~np.isnan(v), axis=0) for v in (a, b))
        t = np.abs((np.nanmean(a, axis=0) - np.nanmean(b, axis=0)) / np.sqrt(error)).reshape(3, 12)
        masses = []
        for f in range(3):
            for first in (m for m in range(12) if t[f, m] > 1 and (m == 0 or t[f, m - 1] <= 1)):
                size = next((k for k in range(12 - first) if t[f, first + k] <= 1), 12 - first)
                masses.append(("ANR"[f], first + 1, first + size, size, t[f, first : first + size].sum()))
        if rep == 0:
            found = masses
        else:
            largest.append(max((m[-1] for m in masses), default=0))
    want = [(*m, (1 + sum(x >= m[-1] - 1e-9 for x in largest)) / 201) for m in found]
    assert len(want) > 3 and min(w[-1] for w in want) < 0.05
    assert sorted((r.family, r.first, r["last"], r.size) for r in got) == sorted(w[:4] for w in want)
    assert np.allclose([r[4:] for r in sorted(map(tuple, got))], [w[4:] for w in sorted(want)], atol=2e-6)


def test_label_permutation_test_without_large_broadcasts(spark, suppliers):
    folder, rows = suppliers
    asked = queries()["label_permutation_test"](spark, folder)
    got = asked.collect()
    assert broadcast_rows(asked) < 50 * SUPPLIERS
    x = np.array([r[2] for r in rows])
    d = np.array([x[labels].mean() - x[~labels].mean() for labels in dealt(rows, lambda r: r[1] < 12)])
    assert [tuple(r) for r in got] == [pytest.approx((d[0], (1 + np.sum(np.abs(d[1:]) >= abs(d[0]) - 1e-9)) / 201), abs=2e-6)]


def test_metric_contrasts_without_large_broadcasts(spark, suppliers, items):
    folder, rows = suppliers
    asked = queries()["metric_contrasts"](spark, folder)
    got = {(r.family, r.metric): tuple(r[c] for c in ("n_a", "n_b", "mean_a", "mean_b", "g", "p")) for r in asked.collect()}
    assert broadcast_rows(asked) < 50 * SUPPLIERS
    held = {}
    for s, f, _, x in items:
        held.setdefault((s, f), []).append(x)
    names, table = cells((s, (f, metric), take(xs)) for (s, f), xs in held.items() for metric, take in (("mean", np.mean), ("top", max)))
    deals, want = dealt(rows, lambda r: r[1] < 12), {}
    for name, v in zip(names, table.T, strict=True):
        d = np.array([np.nanmean(v[labels]) - np.nanmean(v[~labels]) for labels in deals])
        a, b = (v[at & ~np.isnan(v)] for at in (deals[0], ~deals[0]))
        df = len(a) + len(b) - 2
        g = (1 - 3 / (4 * df - 1)) * d[0] / np.sqrt(((len(a) - 1) * a.var(ddof=1) + (len(b) - 1) * b.var(ddof=1)) / df)
        want[name] = (len(a), len(b), a.mean(), b.mean(), g, (1 + np.sum(np.abs(d[1:]) >= abs(d[0]) - 1e-9)) / 201)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)


def test_omnibus_f_test_without_large_broadcasts(spark, suppliers):
    folder, rows = suppliers
    asked = queries()["omnibus_f_test"](spark, folder)
    got = asked.collect()
    assert broadcast_rows(asked) < 50 * SUPPLIERS
    x, f = np.array([r[2] for r in rows]), []
    for labels in dealt(rows, lambda r: r[1] % 4):
        groups = [x[labels == k] for k in range(4)]
        between = sum(len(g) * (g.mean() - x.mean()) ** 2 for g in groups) / 3
        f.append(between / (sum(((g - g.mean()) ** 2).sum() for g in groups) / (len(x) - 4)))
    assert [tuple(r) for r in got] == [pytest.approx((f[0], (1 + np.sum(np.array(f[1:]) >= f[0] - 1e-9)) / 201), abs=2e-6)]
