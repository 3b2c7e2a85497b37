"""Cluster permutation tests, omnibus and one-sided tests, half-assignments: repetitions are rows, so that one aggregation covers all."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import hash_unit
from .resampling import empirical_p, shuffled_labels
from .sequences import clusters
from .weights import by_label, labels_of, resampled, welch


def cluster_p(stats: DataFrame, key: list[str], by: str, stat: str, threshold: float, reps: int) -> DataFrame:
    """Observed clusters (rep 0) of each key: first, last, size, mass and p.

    Each repetition gives one number, the largest mass over all keys (0 without a cluster), which corrects for time and
    keys at once: p = (1 + repetitions with at least the mass) / (``reps`` + 1). The repetitions' numbers, ``reps`` at most,
    meet every cluster as one array.
    """
    found = clusters(stats, ["rep", *key], by, stat, threshold)
    largest = found.where("rep > 0").groupBy("rep").agg(F.max("mass").alias("m")).agg(F.collect_list("m").alias("_null"))
    over = F.size(F.filter("_null", lambda m: m >= F.col("mass") - 1e-9))
    observed = found.where("rep = 0").join(F.broadcast(largest))
    return observed.select(*key, "first", "last", "size", "mass", ((over + 1) / F.lit(reps + 1.0)).alias("p"))


def label_clusters(frame: DataFrame, units: DataFrame, unit: str, label: str, key: list[str], by: str, value: str, threshold: float, reps: int) -> DataFrame:
    """Two groups of units compared at every time of every key; the labels of units are dealt anew, the same for all keys."""
    dealt = labels_of(shuffled_labels(units, unit, label, reps), unit, label)
    stats = welch(resampled(frame, unit, [*key, by], value, dealt, by_label, reps + 1), ["rep", *key, by])
    return cluster_p(stats, key, by, "t", threshold, reps)


def shifted_places(frame: DataFrame, unit: str, by: str, places: int, reps: int) -> DataFrame:
    """``frame`` for repetitions 0 to ``reps``, the places ``by`` (1 to ``places``) of each unit moved around by a hashed shift of 1 or more; as they are in 0."""
    shift = F.when(F.col("rep") > 0, 1 + F.floor(hash_unit(F.lit("shift"), F.col("rep"), F.col(unit)) * (places - 1))).otherwise(0)
    every = frame.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps))))
    return every.withColumn(by, (F.pmod(F.col(by) - 1 + shift, F.lit(places)) + 1).cast("int"))


def place_shifts(units: DataFrame, unit: str, places: int, reps: int) -> DataFrame:
    """unit, _w: how far each repetition moves the unit's places around: 0 in repetition 0, then a hashed number from 1 on."""
    drawn = lambda rep: 1 + F.floor(hash_unit(F.lit("shift"), rep, F.col(unit)) * (places - 1))
    return units.select(unit).distinct().withColumn("_w", F.transform(F.sequence(F.lit(0), F.lit(reps)), lambda r: F.when(r > 0, drawn(r)).otherwise(0).cast("int")))


def existence_clusters(frame: DataFrame, unit: str, key: list[str], by: str, value: str, places: int, threshold: float, reps: int) -> DataFrame:
    """Clusters in time where the units' ``value`` differs from 0, against repetitions in which each unit's times (1 to ``places``) are moved around by themselves.

    A unit's sums for all places of a key are one row, rolled for each repetition where it is added up.
    """
    at = (F.col(by) - 1).cast("int")
    x = F.col(value).cast("double")
    sums = frame.groupBy(unit, *key, at.alias("_at")).agg(F.count(x).cast("double").alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    packed = sums.groupBy(unit, *key).agg(F.collect_list(F.struct("_at", "n", "s", "q")).alias("_v")).join(place_shifts(frame, unit, places, reps), unit).drop(unit)
    fields = ", ".join(f"`{k}` {frame.schema[k].dataType.simpleString()}" for k in key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        types: list[pa.DataType] = []

        def flushed() -> pa.RecordBatch:
            lists = [pa.array([k[i] for k in held for _ in range((reps + 1) * places)], t) for i, t in enumerate(types)]
            rep, place = np.tile(np.repeat(np.arange(reps + 1, dtype=np.int32), places), len(held)), np.tile(np.arange(1, places + 1, dtype=np.int32), len(held) * (reps + 1))
            sums = np.concatenate([v.reshape(-1, 3) for v in held.values()])
            return pa.RecordBatch.from_arrays([*lists, pa.array(rep), pa.array(place), *(pa.array(sums[:, k]) for k in range(3))], names=[*key, "rep", by, "n", "s", "q"])

        for batch in batches:
            types[:] = [batch.schema.field(k).type for k in key]
            for i, name in enumerate(zip(*(batch.column(k).to_pylist() for k in key), strict=True) if key else [()] * batch.num_rows):
                inner = batch.column("_v").slice(i, 1).flatten()
                table = np.zeros((places, 3))
                table[inner.field("_at").to_numpy()] = np.column_stack([inner.field(c).to_numpy(zero_copy_only=False) for c in "nsq"])
                rolled = table[(np.arange(places) - batch.column("_w")[i].values.to_numpy()[:, None]) % places]
                held[name] = held[name] + rolled if name in held else rolled
                if sum(v.size for v in held.values()) > 6 << 20:
                    yield flushed()
                    held.clear()
        if held:
            yield flushed()

    added = packed.mapInArrow(run, f"{fields}{', ' * bool(key)}rep int, `{by}` int, n double, s double, q double").groupBy(*key, "rep", by).agg(*[F.sum(c).alias(c) for c in "nsq"])
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1))
    stats = added.where("n > 0").select(*key, "rep", by, F.when(F.col("n") > 1, F.when(spread > 1e-9, (F.col("s") / F.col("n")) / (spread / F.sqrt("n")))).alias("t"))
    return cluster_p(stats, key, by, "t", threshold, reps)


def omnibus_f(frame: DataFrame, unit: str, label: str, value: str, reps: int) -> DataFrame:
    """One-way F over the groups of ``label`` and its p by relabelling: observed, p."""
    dealt = shuffled_labels(frame, unit, label, reps).join(frame.select(unit, value), unit)
    g = dealt.groupBy("rep", label).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    r = g.groupBy("rep").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    between = (F.col("b") - F.col("s") * F.col("s") / F.col("n")) / (F.col("k") - 1)
    within = (F.col("q") - F.col("b")) / (F.col("n") - F.col("k"))
    return empirical_p(r.select("rep", (between / within).alias("f")), [], "f")


def one_sided_p(stats: DataFrame, key: list[str], stat: str) -> DataFrame:
    """observed and p = (1 + repetitions at least as large) / (n + 1) by key, from rows of rep 0 (observed) and others."""
    w = Window.partitionBy(*key)
    seen = stats.withColumn("_o", F.max(F.when(F.col("rep") == 0, F.col(stat))).over(w))
    hits = F.count_if((F.col("rep") > 0) & (F.col(stat) >= F.col("_o") - 1e-9))
    return seen.groupBy(*key).agg(F.max("_o").alias("observed"), ((hits + 1) / (F.count_if(F.col("rep") > 0) + 1)).alias("p"))


def decision(effect: Column, p: Column, reliable: Column, alpha: float = 0.05) -> Column:
    """keep, weak or drop: a test that holds counts fully only if the measure is reliable and the effect positive."""
    return F.when((p < alpha) & reliable & (effect > 0), "keep").when((p < alpha) | reliable, "weak").otherwise("drop")


def rank_correlation(frame: DataFrame, unit: str, rank_of: str, metric: str) -> DataFrame:
    """By unit: the correlation of the rank of ``rank_of`` with ``metric`` over its rows."""
    ranked = frame.withColumn("_k", F.rank().over(Window.partitionBy(unit).orderBy(rank_of)))
    return ranked.groupBy(unit).agg(F.corr("_k", metric).alias("r"), F.count("*").alias("n"))


def leave_one_out(frame: DataFrame, unit: str, label: str, value: str) -> DataFrame:
    """Difference of the group means without each unit, from the totals: no unit is copied for another. ``frame`` has one row a unit."""
    own = frame.groupBy(label).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    both = own.agg(*[F.max(F.when(F.col(label) == flag, F.col(c))).alias(f"{c}{k}") for k, flag in (("a", True), ("b", False)) for c in ("_s", "_n")])
    out = lambda k, flag: (F.col(f"_s{k}") - F.when(F.col(label) == flag, F.col(value)).otherwise(0)) / (F.col(f"_n{k}") - (F.col(label) == flag).cast("int"))
    return frame.join(F.broadcast(both)).select(unit, (out("a", True) - out("b", False)).alias("diff"))


def balanced_halves(blocks: int = 8, splits: int = 20, low: int = 8, high: int = 12, section: str = "") -> list[tuple[int, tuple[int, ...]]]:
    """(split, blocks of the first half) of half-assignments that differ, also from each other's complements.

    Halves that hold the first block, in order of a hash, are taken; every second one is turned round. The first seed for
    which each block is in ``low`` to ``high`` first halves is used.
    """
    halves = [c for c in combinations(range(1, blocks + 1), blocks // 2) if 1 in c]
    for seed in range(10_000):
        order = sorted(halves, key=lambda c: (md5(f"half|{section}|{seed}|{','.join(map(str, c))}".encode()).hexdigest(), c))[:splits]
        turned = [c if k % 2 == 0 else tuple(b for b in range(1, blocks + 1) if b not in c) for k, c in enumerate(order)]
        if all(low <= sum(b in c for c in turned) <= high for b in range(1, blocks + 1)):
            return list(enumerate(turned, 1))
    raise ValueError("no balanced assignment found")


def assignment_rows(spark: SparkSession, sections: list[str], blocks: int = 8, splits: int = 20) -> DataFrame:
    """section, split, block, half: one row for each block and split; a table of a few hundred rows, whatever the data."""
    rows = [(s, k, b, 1 if b in first else 2) for s in sections for k, first in balanced_halves(blocks, splits, section=s) for b in range(1, blocks + 1)]
    return spark.createDataFrame(rows, "section string, split int, block int, half int")


def split_key(blocks: Column, every: Column) -> Column:
    """The same name for a half and its complement: the smaller of both, in order."""
    mine, other = F.array_sort(blocks), F.array_sort(F.array_except(every, blocks))
    text = lambda a: F.array_join(F.transform(a, lambda b: b.cast("string")), ",")
    return F.least(text(mine), text(other))


def allowed_shifts(n: Column, least: int) -> Column:
    """Shifts of a circle of n whose distance from 0, either way, is ``least`` or more."""
    return F.when(n >= 2 * least, F.sequence(F.lit(least), (n - least).cast("int"))).otherwise(F.array().cast("array<int>"))
