"""Aggregations and statistics over long score tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean_over_valid(scores: DataFrame, key: list[str], value: str, valid: Column) -> DataFrame:
    """mean, sample deviation (0 for one) and number over valid rows."""
    return scores.where(valid).groupBy(*key).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), F.count(value).alias("n"))


def quantiles(frame: DataFrame, key: list[str], value: str, shares: dict[str, float], parts: int = 64, most: int = 1 << 17) -> DataFrame:
    """Exact quantiles, interpolated between neighbours, by key: a column for each name in ``shares``. Null values are left out.

    Where no key has more than ``most`` values, Spark's own aggregate takes them. Else no task holds the values of a key: they are counted by value first, ranged over ``parts`` slices of each key at approximate
    quantiles, and only the slices' totals and each slice are put in order. Keys match null-safe.
    """
    known = frame.where(F.col(value).isNotNull())
    if (known.groupBy(*key).agg(F.count("*").alias("_c")).agg(F.max("_c")).first()[0] or 0) <= most:
        found = known.groupBy(*key).agg(F.percentile(value, F.array(*[F.lit(float(s)) for s in shares.values()])).alias("_q"))
        return found.select(*key, *[F.col("_q")[k].alias(name) for k, name in enumerate(shares)])
    counts = known.groupBy(*key, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    edges = counts.groupBy(*key).agg(F.approx_percentile("_v", F.array(*[F.lit(k / parts) for k in range(1, parts)]), F.lit(1000)).alias("_edges"))
    cut = _beside(counts, edges, key).withColumn("_part", F.aggregate("_edges", F.lit(0), lambda n, e: n + (e < F.col("_v")).cast("int"))).drop("_edges")
    slices = cut.groupBy(*key, "_part").agg(F.sum("_c").alias("_m"))
    w = Window.partitionBy(*key)
    slices = slices.withColumn("_below", F.sum("_m").over(w.orderBy("_part")) - F.col("_m")).withColumn("_n", F.sum("_m").over(w)).drop("_m")
    inside = Window.partitionBy(*key, "_part").orderBy("_v")
    upto = _beside(cut, slices, [*key, "_part"]).withColumn("_upto", F.col("_below") + F.sum("_c").over(inside))
    n = F.col("_n") - 1
    found = upto.groupBy(*key).agg(
        *[F.min(F.when(F.col("_upto") > f(F.lit(share) * n), F.col("_v"))).alias(f"_{side}_{name}") for name, share in shares.items() for side, f in (("low", F.floor), ("high", F.ceil))], F.max("_n").alias("_n")
    )
    step = lambda name, share: F.col(f"_low_{name}") + (F.lit(share) * n - F.floor(F.lit(share) * n)) * (F.col(f"_high_{name}") - F.col(f"_low_{name}"))
    return found.select(*key, *[step(name, share).alias(name) for name, share in shares.items()])


def _beside(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """``left`` with the columns of ``right`` of the same key, null matching null."""
    if not key:
        return left.join(right)
    named = right.withColumnsRenamed({k: f"_r_{k}" for k in key})
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in key]
    return left.join(named, on).drop(*[f"_r_{k}" for k in key])


def null_floor(nulls: DataFrame, key: list[str], value: str) -> DataFrame:
    """median, mean, sample deviation and 95th percentile of null scores."""
    spread = nulls.groupBy(*key).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    found = _beside(spread, quantiles(nulls, key, value, {"median": 0.5, "p95": 0.95}), key)
    return found.select(*key, "median", "mean", "sd", "p95")


def mad_threshold(frame: DataFrame, key: list[str], value: str, times: float = 5.0) -> DataFrame:
    """median, MAD and median + ``times`` MAD per key; the threshold is null (no bound) where the MAD is 0."""
    mid = quantiles(frame, key, value, {"median": 0.5})
    gaps = _beside(frame.select(*key, value), mid, key).withColumn("_gap", F.abs(F.col(value) - F.col("median")))
    mad = quantiles(gaps, [*key, "median"], "_gap", {"mad": 0.5})
    return mad.withColumn("threshold", F.when(F.col("mad") > 0, F.col("median") + times * F.col("mad")))


def transitions(frame: DataFrame, key: list[str], by: list[str], state: str) -> DataFrame:
    """before, after, n and share of each step between states that follow each other."""
    steps = frame.select(F.lag(state).over(Window.partitionBy(*key).orderBy(*by)).alias("before"), F.col(state).alias("after")).where("before is not null")
    counts = steps.groupBy("before", "after").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("before")))


def confusion(frame: DataFrame, true: str, guess: str) -> DataFrame:
    """Per true class: n, share of right guesses, most frequent guess (the smaller on ties)."""
    counts = frame.groupBy(true, guess).agg(F.count("*").alias("_n"))
    return counts.groupBy(true).agg(F.sum("_n").alias("n"), (F.sum(F.when(F.col(true) == F.col(guess), F.col("_n")).otherwise(0)) / F.sum("_n")).alias("hit_rate"), F.min_by(guess, F.struct(-F.col("_n"), F.col(guess))).alias("modal"))


def hedges_g(frame: DataFrame, key: list[str], group: Column, value: str) -> DataFrame:
    """Two groups compared (group true against false): means, sizes, Welch's t, Hedges' g with its small-sample factor."""
    a, b = F.when(group, F.col(value)), F.when(~group, F.col(value))
    s = frame.groupBy(*key).agg(*[f(x).alias(f"{n}_{k}") for k, x in (("a", a), ("b", b)) for n, f in (("mean", F.avg), ("var", F.var_samp), ("n", F.count))])
    df = F.col("n_a") + F.col("n_b") - 2
    pooled = F.sqrt(((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b")) / df)
    d = F.col("mean_a") - F.col("mean_b")
    out = {"welch_t": F.when(F.col("var_a") + F.col("var_b") > 0, d / F.sqrt(F.col("var_a") / F.col("n_a") + F.col("var_b") / F.col("n_b"))), "g": F.when(pooled > 0, (1 - F.lit(3.0) / (4 * (F.col("n_a") + F.col("n_b")) - 9)) * d / pooled)}
    return s.withColumns(out).drop("var_a", "var_b")


def icc21(frame: DataFrame, key: list[str], one: str, two: str) -> DataFrame:
    """Agreement of two ratings, ICC(2,1), and its Spearman-Brown value 2r/(1+r), of keys with three rows or more."""
    w = Window.partitionBy(*key)
    mean = (F.avg(one).over(w) + F.avg(two).over(w)) / 2
    rows = frame.withColumns({"_g": mean, "_r": (F.col(one) + F.col(two)) / 2})
    s = rows.groupBy(*key).agg(
        F.count("*").alias("n"), F.sum(2 * F.pow(F.col("_r") - F.col("_g"), 2)).alias("ssr"),
        (F.count("*") * (F.pow(F.avg(one) - F.max("_g"), 2) + F.pow(F.avg(two) - F.max("_g"), 2))).alias("ssc"),
        F.sum(F.pow(F.col(one) - F.col("_g"), 2) + F.pow(F.col(two) - F.col("_g"), 2)).alias("sst"),
    )
    msr, msc, mse = F.col("ssr") / (F.col("n") - 1), F.col("ssc"), (F.col("sst") - F.col("ssr") - F.col("ssc")) / (F.col("n") - 1)
    icc = (msr - mse) / (msr + mse + 2 * (msc - mse) / F.col("n"))
    return s.where("n > 2").select(*key, "n", icc.alias("icc")).withColumn("spearman_brown", 2 * F.col("icc") / (1 + F.col("icc")))


def holm(tests: DataFrame, p: str, order: list[str]) -> DataFrame:
    """``tests`` with step-down adjusted p values; the tests of one table are few."""
    w = Window.partitionBy(F.lit(0)).orderBy(p, *order)
    m = F.count("*").over(Window.partitionBy(F.lit(0)))
    return tests.withColumn("_raw", (m - F.row_number().over(w) + 1) * F.col(p)).withColumn("p_holm", F.least(F.lit(1.0), F.max("_raw").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("_raw")


def average_ranks(frame: DataFrame, key: list[str], column: str, out: str, parts: int = 64) -> DataFrame:
    """Ranks within a key, ties sharing their mean; a null value has a null rank.

    Ranks are found on distinct values, sliced as in ``quantiles``, and joined back: a key with a third of all rows is no one's task.
    """
    counts = frame.where(F.col(column).isNotNull()).groupBy(*key, F.col(column).alias("_v")).agg(F.count("*").alias("_c"))
    edges = counts.groupBy(*key).agg(F.approx_percentile("_v", F.array(*[F.lit(k / parts) for k in range(1, parts)]), F.lit(1000)).alias("_edges"))
    cut = _beside(counts, edges, key).withColumn("_part", F.aggregate("_edges", F.lit(0), lambda n, e: n + (e < F.col("_v")).cast("int"))).drop("_edges")
    slices = cut.groupBy(*key, "_part").agg(F.sum("_c").alias("_m"))
    slices = slices.withColumn("_below", F.sum("_m").over(Window.partitionBy(*key).orderBy("_part")) - F.col("_m")).drop("_m")
    inside = Window.partitionBy(*key, "_part").orderBy("_v")
    ranks = _beside(cut, slices, [*key, "_part"]).withColumn(out, F.col("_below") + F.sum("_c").over(inside) - (F.col("_c") - 1) / 2).select(*key, "_v", out)
    named = ranks.withColumnsRenamed({k: f"_r_{k}" for k in key})
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in key] + [F.col(column) == F.col("_v")]
    return frame.join(named, on, "left").drop("_v", *[f"_r_{k}" for k in key])


def merge_rare(frame: DataFrame, level: str, least: int, other: str = "other") -> DataFrame:
    """Levels with fewer than ``least`` rows become ``other``; a join with the aggregated levels decides."""
    often = frame.groupBy(level).count().where(F.col("count") >= least).select(F.col(level).alias("_l"))
    return frame.join(often, F.col(level) == F.col("_l"), "left").withColumn(level, F.when(F.col("_l").isNull(), F.lit(other)).otherwise(F.col(level))).drop("_l")


def tertile_edges(items: DataFrame, value: str) -> DataFrame:
    """The 1/3 and 2/3 quantiles of a value: one row."""
    return quantiles(items, [], value, {"q1": 1 / 3, "q2": 2 / 3})


def epoch_quality(long: DataFrame, epoch: list[str], channel: str, value: str) -> DataFrame:
    """By epoch: the largest peak to peak over channels, the largest \\|z\\| (z by channel over all epochs; 0 without spread), and the channels' mean variance."""
    stats = long.groupBy(channel).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    z = F.when(F.col("_s") > 0, F.abs(F.col(value) - F.col("_m")) / F.col("_s")).otherwise(0.0)
    by = long.join(stats, channel).groupBy(*epoch, channel).agg((F.max(value) - F.min(value)).alias("_p"), F.max(z).alias("_z"), F.var_samp(value).alias("_v"))
    return by.groupBy(*epoch).agg(F.max("_p").alias("peak_to_peak"), F.max("_z").alias("largest_z"), F.avg("_v").alias("mean_variance"))


def subject_waves(frame: DataFrame, subject: str, key: list[str], value: str) -> DataFrame:
    """``key``, mean, sem, n: the mean over subjects of their own means, and its standard error."""
    own = frame.groupBy(subject, *key).agg(F.avg(value).alias("_v"))
    return own.groupBy(*key).agg(F.avg("_v").alias("mean"), (F.stddev_samp("_v") / F.sqrt(F.count("_v"))).alias("sem"), F.count("_v").alias("n"))
