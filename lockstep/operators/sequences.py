"""Ordered sequences within a key: neighbours, runs, clusters, blocks, shifts, latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cosine


def ordered(key: list[str], by: list[str]):
    return Window.partitionBy(*key).orderBy(*by)


def neighbours(frame: DataFrame, key: list[str], by: list[str], columns: list[str]) -> DataFrame:
    """Each column's value one row before and after: ``<c>_m1`` and ``<c>_p1``."""
    w = ordered(key, by)
    return frame.withColumns({f"{c}_m1": F.lag(c).over(w) for c in columns} | {f"{c}_p1": F.lead(c).over(w) for c in columns})


def gap_before(frame: DataFrame, key: list[str], by: list[str], at: str, out: str = "gap") -> DataFrame:
    """Time since the row before, never negative; 0 at the first."""
    step = F.col(at) - F.lag(at).over(ordered(key, by))
    return frame.withColumn(out, F.coalesce(F.greatest(step, F.lit(0)), F.lit(0)))


def runs_by_gap(frame: DataFrame, key: list[str], by: list[str], at: str, most: float, out: str = "run") -> DataFrame:
    """Number of the run of each row, from 0: a gap over ``most`` starts another."""
    w = ordered(key, by)
    new = (F.col(at) - F.lag(at).over(w) > most).cast("int")
    return frame.withColumn(out, F.sum(F.coalesce(new, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def islands(frame: DataFrame, key: list[str], by: list[str], flag: Column) -> DataFrame:
    """Rows where ``flag`` holds, with ``island``: equal for rows that follow each other without a gap."""
    w = ordered(key, by)
    marked = frame.withColumn("_on", F.coalesce(flag, F.lit(False))).withColumn("_row", F.row_number().over(w))
    on = ordered([*key, "_on"], by)
    return marked.withColumn("island", F.col("_row") - F.row_number().over(on)).where("_on").drop("_on", "_row")


def longest_run(frame: DataFrame, key: list[str], by: list[str], flag: Column) -> DataFrame:
    """Per key with any row where ``flag`` holds: rows of the longest run, and of all."""
    return islands(frame, key, by, flag).groupBy(*key, "island").count().groupBy(*key).agg(F.max("count").alias("longest"), F.sum("count").alias("total"))


def clusters(frame: DataFrame, key: list[str], by: str, stat: str, threshold: float) -> DataFrame:
    """Runs where \\|stat\\| is over a threshold, signs not told apart: first, last, size, mass (sum of \\|stat\\|)."""
    on = islands(frame, key, [by], F.abs(F.col(stat)) > threshold)
    return on.groupBy(*key, "island").agg(F.min(by).alias("first"), F.max(by).alias("last"), F.count("*").alias("size"), F.sum(F.abs(F.col(stat))).alias("mass")).drop("island")


def block_id(position: Column, n: Column, blocks: int) -> Column:
    """Block (from 1) of position 1..n between edges round(b n / blocks)."""
    edges = F.sequence(F.lit(0), F.lit(blocks - 1))
    return F.aggregate(edges, F.lit(0), lambda s, b: s + (F.rint(b * n / blocks) < position).cast("int"))


def near_edge(position: Column, n: Column, blocks: int, guard: int) -> Column:
    """Whether a position is within ``guard`` of the last or first position at an inner edge."""
    inner = F.sequence(F.lit(1), F.lit(blocks - 1))
    edge = lambda b: F.rint(b * n / blocks)
    return F.exists(inner, lambda b: (F.abs(position - edge(b)) <= guard) | (F.abs(position - edge(b) - 1) <= guard))


def placed(frame: DataFrame, key: list[str], by: str, tie: Column, parts: int = 64) -> DataFrame:
    """``_at`` (place from 0 in order of ``by``, then of ``tie``) and ``_n`` (rows) of each row in its key, none of which may be null.

    A key is cut at approximate quantiles into ``parts`` slices; only a slice is put in order, and places start at the sizes of those before.
    """
    edges = frame.groupBy(*key).agg(F.approx_percentile(by, F.array(*[F.lit(k / parts) for k in range(1, parts)]), F.lit(1000)).alias("_edges"))
    cut = frame.join(edges, key).withColumn("_part", F.aggregate("_edges", F.lit(0), lambda n, e: n + (e < F.col(by)).cast("int"))).drop("_edges")
    w = Window.partitionBy(*key)
    sizes = cut.groupBy(*key, "_part").agg(F.count("*").alias("_m"))
    sizes = sizes.withColumn("_below", F.sum("_m").over(w.orderBy("_part")) - F.col("_m")).withColumn("_n", F.sum("_m").over(w)).drop("_m")
    inside = Window.partitionBy(*key, "_part").orderBy(F.col(by), tie)
    return cut.join(sizes, [*key, "_part"]).withColumn("_at", F.col("_below") + F.row_number().over(inside) - 1).drop("_part", "_below")


def circular_shift(frame: DataFrame, key: list[str], by: list[str], columns: list[str], shift: int | Column) -> DataFrame:
    """``columns`` of each row from the row ``shift`` places before it in its key, wrapping around.

    An equi-join on the position does it, so that a shift may differ between keys.
    """
    w = ordered(key, by)
    n = F.count("*").over(Window.partitionBy(*key))
    placed = frame.withColumn("_at", F.row_number().over(w) - 1).withColumn("_n", n)
    source = placed.select(*key, F.col("_at").alias("_from"), *columns)
    shift = F.lit(shift) if isinstance(shift, int) else shift
    moved = placed.drop(*columns).withColumn("_from", F.pmod(F.col("_at") - shift, F.col("_n")).cast("int"))
    return moved.join(source, [*key, "_from"]).drop("_from", "_at", "_n")


def rolling_median(frame: DataFrame, key: list[str], by: list[str], column: str, half: int, least: int, out: str = "median") -> DataFrame:
    """Median over the rows within ``half`` places, null where fewer than ``least`` have a value."""
    w = ordered(key, by).rowsBetween(-half, half)
    return frame.withColumn(out, F.when(F.count(column).over(w) >= least, F.percentile(column, F.lit(0.5)).over(w)))


def latencies(frame: DataFrame, key: list[str], at: str, value: str) -> DataFrame:
    """Per key: time of the first maximum, first time with half of the positive area, first time with half of the maximum."""
    w = Window.partitionBy(*key)
    run = w.orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    up = F.greatest(F.col(value), F.lit(0))
    marked = frame.withColumns({"_area": F.sum(up).over(run), "_all": F.sum(up).over(w), "_max": F.max(value).over(w)})
    return marked.groupBy(*key).agg(
        F.max_by(F.col(at), F.struct(F.col(value), -F.col(at))).alias("peak_at"),
        F.min(F.when((F.col("_all") > 0) & (2 * F.col("_area") >= F.col("_all")), F.col(at))).alias("half_area_at"),
        F.min(F.when((F.col("_max") > 0) & (2 * F.col(value) >= F.col("_max")), F.col(at))).alias("half_max_at"),
    )


def pause_bounds(frame: DataFrame, key: list[str], by: list[str], at: str, least: float) -> DataFrame:
    """Start of the phrase of each row and its end: the rows between pauses of ``least`` or more, with ``phrase_start`` and ``phrase_end``."""
    w = ordered(key, by)
    before = F.col(at) - F.lag(at).over(w)
    after = F.lead(at).over(w) - F.col(at)
    marked = frame.withColumn("_start", F.when(before.isNull() | (before >= least), F.col(at))).withColumn("_end", F.when(after.isNull() | (after >= least), F.col(at)))
    start = F.last("_start", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    back = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in by])
    end = F.last("_end", True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("phrase_start", start).withColumn("phrase_end", end).drop("_start", "_end")


def odd_even(at: Column, start: Column, width: float) -> Column:
    """odd or even: parity of the number of the window of ``width`` since ``start``, counted from 1."""
    return F.when(F.pmod(F.floor((at - start) / width), F.lit(2)) == 0, "odd").otherwise("even")


def earlier_cosine(frame: DataFrame, key: list[str], by: list[str], vector: str, counts: Column, n: int = 3, out: str = "cosine") -> DataFrame:
    """``frame`` with ``out``: the mean cosine of a row's vector to those of the up to ``n`` rows before it in the key for which ``counts`` holds and that have a vector.

    Null without a vector or without such a row; rows that don't count are passed over, and have a value of their own.
    """
    useful = F.coalesce(counts, F.lit(False)) & F.col(vector).isNotNull()
    before = Window.partitionBy(*key).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    # the number of useful rows before a row tells which ones it looks at: an equi-join on these numbers, so that no window gathers vectors
    marked = frame.withColumn("_useful", useful).withColumn("_k", F.coalesce(F.sum(F.col("_useful").cast("long")).over(before), F.lit(0)))
    marked = marked.withColumn("_row", F.row_number().over(Window.partitionBy(*key).orderBy(*by)))
    held = marked.where("_useful").select(*[F.col(k).alias(f"_{k}") for k in key], (F.col("_k") + 1).alias("_j"), F.col(vector).alias("_other"))
    asked = marked.where(F.col(vector).isNotNull() & (F.col("_k") > 0)).select(*key, "_row", F.col(vector).alias("_own"), F.explode(F.sequence(F.greatest(F.lit(1), F.col("_k") - n + 1), F.col("_k"))).alias("_j"))
    on = [F.col(k) == F.col(f"_{k}") for k in key]
    met = asked.join(held.withColumnRenamed("_j", "_i"), [*on, F.col("_j") == F.col("_i")])
    mean = met.groupBy(*key, "_row").agg(F.avg(cosine(F.col("_own"), F.col("_other"))).alias(out))
    return marked.join(mean, [*key, "_row"], "left").drop("_useful", "_k", "_row")
