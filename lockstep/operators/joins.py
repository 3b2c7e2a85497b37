"""Joins in time: nearest, largest overlap, overlap flags, slices around events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest_in_time(left: DataFrame, right: DataFrame, key: list[str], at: str, value: str, most: float) -> DataFrame:
    """Each row of ``left`` with the ``value`` of ``right`` nearest in time, the earlier one on ties, null if farther than ``most``.

    Both sides are laid along one window per key, once in each direction; no pair is formed. Of several ``right`` rows at one time the smallest counts.
    """
    right = right.groupBy(*key, at).agg(F.min(value).alias(value))
    marks = right.select(*key, F.col(at).alias("_at"), F.struct(F.col(at).alias("t"), F.col(value).alias("v")).alias("_hit"), F.lit(0).alias("_left"), F.lit(None).cast(left.schema).alias("_row"))
    rows = left.select(*key, F.col(at).alias("_at"), F.lit(None).cast(marks.schema["_hit"].dataType).alias("_hit"), F.lit(1).alias("_left"), F.struct(*left.columns).alias("_row"))
    w, back = Window.partitionBy(*key).orderBy("_at", "_left"), Window.partitionBy(*key).orderBy(F.desc("_at"), F.desc("_left"))
    run = (Window.unboundedPreceding, Window.currentRow)
    both = marks.unionByName(rows)
    both = both.withColumn("_b", F.last("_hit", True).over(w.rowsBetween(*run))).withColumn("_a", F.last("_hit", True).over(back.rowsBetween(*run)))
    before, after = F.col("_at") - F.col("_b.t"), F.col("_a.t") - F.col("_at")
    use_before = before.isNotNull() & (after.isNull() | (before <= after))
    chosen = both.where("_left = 1").withColumn("_c", F.when(use_before, F.col("_b")).otherwise(F.col("_a"))).withColumn("_d", F.when(use_before, before).otherwise(after))
    return chosen.select("_row.*", F.when(F.col("_d") <= most, F.col("_c.v")).alias(f"nearest_{value}"))


def largest_overlap(pieces: DataFrame, spans: DataFrame, key: list[str], least: float, width: float) -> DataFrame:
    """Each piece (on, off) with the one span (span_id, start, end) that it overlaps most, by ``least`` or more: span_id, overlap, clipped on and off.

    Both are dealt into time bins of ``width``, so that the range join is an equi-join; the smaller span_id wins ties.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    p, s = pieces.withColumn("_bin", bins("on", "off")), spans.withColumn("_bin", bins("start", "end"))
    met = p.join(s, [*key, "_bin"]).where((F.col("on") < F.col("end")) & (F.col("off") > F.col("start")))
    met = met.withColumns({"clip_on": F.greatest("on", "start"), "clip_off": F.least("off", "end")}).withColumn("overlap", F.col("clip_off") - F.col("clip_on"))
    best = F.max_by(F.struct("span_id", "overlap", "clip_on", "clip_off"), F.struct("overlap", -F.col("span_id")))
    return met.where(F.col("overlap") >= least).groupBy(*key, "piece_id").agg(best.alias("_b")).select(*key, "piece_id", "_b.*")


def overlaps_any(rows: DataFrame, bad: DataFrame, key: list[str], row_id: str, width: float) -> DataFrame:
    """``rows`` (start, end) with ``bad``: whether an interval (bad_start, bad_end, in either order) of their key overlaps them."""
    bad = bad.select(*key, F.least("bad_start", "bad_end").alias("_s"), F.greatest("bad_start", "bad_end").alias("_e"))
    binned = bad.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_s") / width), F.floor(F.col("_e") / width))))
    mine = rows.select(*key, row_id, "start", "end", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))).alias("_bin"))
    hit = mine.join(binned, [*key, "_bin"]).where((F.col("start") < F.col("_e")) & (F.col("end") > F.col("_s"))).select(*key, row_id).distinct()
    return rows.join(hit.withColumn("bad", F.lit(True)), [*key, row_id], "left").withColumn("bad", F.coalesce("bad", F.lit(False)))


def slice_around(events: DataFrame, samples: DataFrame, key: list[str], at: str, sample: str, before: int, after: int) -> DataFrame:
    """Each event with the samples from ``before`` places before it to ``after`` places after, by an equi-join on sample number: column ``t`` is the place."""
    wanted = events.withColumn("t", F.explode(F.sequence(F.lit(-before), F.lit(after)))).withColumn(sample, F.col(at) + F.col("t"))
    return wanted.join(samples, [*key, sample])
