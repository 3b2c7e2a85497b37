"""Resampled sums of cells: units' weights times units' sums, so that no row is copied for a repetition."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers that a task adds up at a time: repetitions x cells x 6.
HELD = 6 << 20


def cell_sums(frame: DataFrame, unit: str, cell: list[str], value: str) -> DataFrame:
    """unit, _cell (a number for each cell), n, s, q: number, sum and sum of squares of the values of each unit in each cell. Null values don't count."""
    x = F.col(value).cast("double")
    return frame.groupBy(unit, *cell).agg(F.count(x).alias("n"), F.coalesce(F.sum(x), F.lit(0.0)).alias("s"), F.coalesce(F.sum(x * x), F.lit(0.0)).alias("q"))


def numbered(sums: DataFrame, cell: list[str]) -> DataFrame:
    """The cells of ``sums`` with _cell, from 0 in their order; cells are keys and times, as many as a result has rows."""
    return sums.select(*cell).distinct().withColumn("_cell", F.row_number().over(Window.orderBy(*cell)) - 1)


def resampled(frame: DataFrame, unit: str, cell: list[str], value: str, drawn: DataFrame, rows: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], reps: int) -> DataFrame:
    """rep, the columns of ``cell``, n1, s1, q1, n0, s0, q0: sums of both groups of each repetition (0 to ``reps`` - 1).

    ``drawn`` (unit, _w: an array of numbers) says what repetitions do with a unit, and ``rows`` makes of those of many units the weights
    (repetitions x units) in the one and in the other group. A unit's cells are one row, which meets its weights once; each task multiplies blocks of units and adds them up,
    and Spark adds the tasks' sums: repetitions x cells numbers, whatever the units.
    """
    sums = cell_sums(frame, unit, cell, value)
    cells = numbered(sums, cell)
    count = cells.count()
    step = max(1, HELD // (6 * max(1, reps)))
    named = cells.withColumnsRenamed({c: f"_k{i}" for i, c in enumerate(cell)})
    at = sums.join(named, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(cell)])
    packed = at.withColumn("_chunk", F.floor(F.col("_cell") / step).cast("int")).groupBy(unit, "_chunk").agg(F.collect_list(F.struct("_cell", "n", "s", "q")).alias("_v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def flushed(chunk: int) -> pa.RecordBatch:
            out = held.pop(chunk)
            rep, here = np.nonzero(out[:, :, [0, 3]].any(axis=2))
            sums = [pa.array(out[rep, here, k]) for k in range(6)]
            return pa.RecordBatch.from_arrays([pa.array(rep.astype(np.int32)), pa.array((here + chunk * step).astype(np.int32)), *sums], names=["rep", "_cell", "n1", "s1", "q1", "n0", "s0", "q0"])

        for batch in batches:
            if not batch.num_rows:
                continue
            chunks = batch.column("_chunk").to_numpy()
            for chunk in np.unique(chunks):
                part = batch.filter(pa.array(chunks == chunk))
                width = min(step, count - int(chunk) * step)
                for begin in range(0, part.num_rows, 256):
                    few = part.slice(begin, 256)
                    v, w = few.column("_v"), few.column("_w")
                    who = np.repeat(np.arange(few.num_rows), v.value_lengths().to_numpy())
                    flat = v.flatten()
                    table = np.zeros((few.num_rows, width, 3))
                    table[who, flat.field("_cell").to_numpy() - chunk * step] = np.column_stack([flat.field(k).to_numpy() for k in "nsq"])
                    groups = rows(w.flatten().to_numpy(zero_copy_only=False).reshape(few.num_rows, -1), table)
                    out = np.concatenate(groups, axis=2)
                    held[chunk] = held[chunk] + out if chunk in held else out
                for old in [c for c in held if c != chunk and sum(x.size for x in held.values()) > HELD]:
                    yield flushed(old)
        for chunk in list(held):
            yield flushed(chunk)

    schema = "rep int, _cell int, n1 double, s1 double, q1 double, n0 double, s0 double, q0 double"
    added = packed.join(drawn, unit).select("_chunk", "_v", "_w").mapInArrow(run, schema).groupBy("rep", "_cell").agg(*[F.sum(c).alias(c) for c in ("n1", "s1", "q1", "n0", "s0", "q0")])
    return added.join(cells, "_cell").drop("_cell")


def by_label(w: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of 1 for a label: ``w`` is 1, 0 or, without a label, -1, for each unit and repetition."""
    return tuple(np.einsum("ur,ucj->rcj", (w == k).astype(float), table, optimize=True) for k in (1, 0))


def by_count(w: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of copies in both groups: ``w`` has those of the one for all repetitions, then those of the other."""
    half = w.shape[1] // 2
    return tuple(np.einsum("ur,ucj->rcj", w[:, k].astype(float), table, optimize=True) for k in (slice(0, half), slice(half, None)))


def welch(sums: DataFrame, key: list[str]) -> DataFrame:
    """``key`` and t of the first group's mean against the second's, from sums; null with fewer than two values in one, or without spread."""
    parts = {}
    for k in "10":
        n, s, q = (F.col(f"{c}{k}") for c in "nsq")
        parts[k] = s / n, F.when(n > 1, F.greatest(F.lit(0.0), q - s * s / n) / (n - 1)) / n
    error = parts["1"][1] + parts["0"][1]
    some = F.when((F.col("n1") > 1) & (F.col("n0") > 1), error)
    return sums.select(*key, F.when(some > 1e-18, (parts["1"][0] - parts["0"][0]) / F.sqrt(some)).alias("t"))


def labels_of(dealt: DataFrame, unit: str, label: str) -> DataFrame:
    """unit, _w: for each repetition in order 1 or 0 as its label is true or false, -1 without one; from rows of unit, rep and label."""
    code = F.when(F.col(label), 1).when(~F.col(label), 0).otherwise(-1)
    return dealt.groupBy(unit).agg(F.array_sort(F.collect_list(F.struct("rep", code.alias("w")))).alias("_s")).select(unit, F.col("_s.w").alias("_w"))


def bootstrap_counts(units: DataFrame, unit: str, label: str, draws: int, inner: int, seed: int = 0) -> DataFrame:
    """unit, _w: for ``draws`` outer draws (0 is the data as observed) of units with replacement within both groups, and in each ``inner`` relabellings (after the draw as it is),
    how many copies of the unit are in the first group, then in the second: (draws + 1) x (inner + 1) numbers each.

    A group keeps its size in every draw, and a relabelling deals the copies of the draw anew to groups of these sizes. All follow from the seed, the order of the units and the number
    of the draw. Units are few: their labels are gathered, and each task makes the weights of its draws.
    """
    known = units.where(F.col(label).isNotNull()).select(F.col(unit).alias("u"), F.col(label).alias("l")).orderBy("u").collect()
    spark = units.sparkSession
    if not known:
        return spark.createDataFrame([], units.select(unit).schema).withColumn("_w", F.array().cast("array<int>"))
    label_of = np.array([bool(r.l) for r in known])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for draw in batch.column("id").to_pylist():
                rng = np.random.default_rng([seed, draw])
                own = [np.flatnonzero(label_of == k) for k in (True, False)]
                drawn = np.concatenate([g if draw == 0 or not len(g) else rng.choice(g, len(g)) for g in own])
                first = len(own[0])
                counts = np.zeros((2, len(label_of), inner + 1), np.int32)
                for r in range(inner + 1):
                    order = drawn if r == 0 else rng.permutation(drawn)
                    counts[0, :, r] = np.bincount(order[:first], minlength=len(label_of))
                    counts[1, :, r] = np.bincount(order[first:], minlength=len(label_of))
                some = np.arange(len(label_of), dtype=np.int32)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(c.ravel()), inner + 1).cast(pa.list_(pa.int32())) for c in counts]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), draw, np.int32)), pa.array(some), *lists], names=["draw", "at", "a", "b"])

    made = spark.range(draws + 1, numPartitions=min(draws + 1, 64)).mapInArrow(run, "draw int, at int, a array<int>, b array<int>")
    joined = made.groupBy("at").agg(F.array_sort(F.collect_list(F.struct("draw", "a", "b"))).alias("_s"))
    names = spark.createDataFrame([(k, r.u) for k, r in enumerate(known)], f"at int, `{unit}` {units.schema[unit].dataType.simpleString()}")
    return joined.join(names, "at").select(unit, F.concat(F.flatten("_s.a"), F.flatten("_s.b")).alias("_w"))


def left_out_counts(units: DataFrame, unit: str, label: str, inner: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """As ``bootstrap_counts``, each draw being all units but one (draw 0: all): unit, _w; and draw, unit (the one left out)."""
    known = units.where(F.col(label).isNotNull()).select(F.col(unit).alias("u"), F.col(label).alias("l")).orderBy("u").collect()
    label_of, spark = np.array([bool(r.l) for r in known]), units.sparkSession
    n = len(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for draw in batch.column("id").to_pylist():
                rng = np.random.default_rng([seed, draw])
                here = np.delete(np.arange(n), draw - 1) if draw else np.arange(n)
                here = np.concatenate([here[label_of[here]], here[~label_of[here]]])
                first = int(label_of[here].sum())
                counts = np.zeros((2, n, inner + 1), np.int32)
                for r in range(inner + 1):
                    order = here if r == 0 else rng.permutation(here)
                    counts[0, order[:first], r], counts[1, order[first:], r] = 1, 1
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(c.ravel()), inner + 1).cast(pa.list_(pa.int32())) for c in counts]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, draw, np.int32)), pa.array(np.arange(n, dtype=np.int32)), *lists], names=["draw", "at", "a", "b"])

    made = spark.range(n + 1, numPartitions=min(n + 1, 64)).mapInArrow(run, "draw int, at int, a array<int>, b array<int>")
    joined = made.groupBy("at").agg(F.array_sort(F.collect_list(F.struct("draw", "a", "b"))).alias("_s"))
    kind = units.schema[unit].dataType.simpleString()
    names = spark.createDataFrame([(k, r.u) for k, r in enumerate(known)], f"at int, `{unit}` {kind}")
    counts = joined.join(names, "at").select(unit, F.concat(F.flatten("_s.a"), F.flatten("_s.b")).alias("_w"))
    return counts, names.select((F.col("at") + 1).alias("draw"), unit)


def nested_cluster_p(frame: DataFrame, unit: str, key: list[str], by: str, value: str, counts: DataFrame, draws: int, inner: int, threshold: Column | float) -> DataFrame:
    """draw, mass, p of the whole cluster test in each outer draw: the largest cluster over all keys, and the share of the draw's relabellings with one as large.

    ``counts`` are those of ``bootstrap_counts`` or ``left_out_counts``. A draw without a cluster has mass 0 and p 1.
    """
    from .sequences import clusters

    cells = resampled(frame, unit, [*key, by], value, counts, by_count, (draws + 1) * (inner + 1))
    stats = welch(cells.withColumns({"draw": F.floor(F.col("rep") / (inner + 1)).cast("int"), "rep": F.pmod("rep", F.lit(inner + 1))}), ["draw", "rep", *key, by])
    largest = clusters(stats, ["draw", "rep", *key], by, "t", threshold).groupBy("draw", "rep").agg(F.max("mass").alias("mass"))
    observed = largest.where("rep = 0").select("draw", F.col("mass").alias("_m"))
    every = frame.sparkSession.range(draws + 1).select(F.col("id").cast("int").alias("draw"))
    hits = largest.where("rep > 0").join(observed, "draw").groupBy("draw").agg(F.count_if(F.col("mass") >= F.col("_m") - 1e-9).alias("_h"))
    out = every.join(observed, "draw", "left").join(hits, "draw", "left")
    return out.select("draw", F.coalesce("_m", F.lit(0.0)).alias("mass"), F.when(F.col("_m").isNull(), 1.0).otherwise((F.coalesce("_h", F.lit(0)) + 1) / (inner + 1.0)).alias("p"))
