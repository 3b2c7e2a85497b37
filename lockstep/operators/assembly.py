"""Tables of participants: wide rows from many parts, contrasts of measures, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .resampling import empirical_p, shuffled_labels
from .sequences import longest_run
from .summaries import hedges_g
from .weights import by_label, labels_of, resampled


def spread(long: DataFrame, key: str, name: str, value: str, names: list[str], prefix: str = "") -> DataFrame:
    """One row for each ``key``: the mean ``value`` of each of ``names`` in a column of its own, null where there is none. Other names are left out."""
    return long.groupBy(key).agg(*[F.avg(F.when(F.col(name) == n, F.col(value))).alias(f"{prefix}{n}") for n in names])


def participant_table(base: DataFrame, key: str, parts: list[DataFrame]) -> DataFrame:
    """``base`` with the columns of each part, which has a row for each ``key`` at most; participants that a part lacks have nulls there.

    A part with a repeated key, which would multiply participants, or with a column that is there already, is an error.
    """
    out = base
    for part in parts:
        if clash := set(part.columns) & set(out.columns) - {key}:
            raise ValueError(f"columns twice: {sorted(clash)}")
        if not part.groupBy(key).count().where("count > 1").isEmpty():
            raise ValueError(f"a part has several rows of one {key}")
        out = out.join(part, key, "left")
    return out


def metric_contrasts(frame: DataFrame, units: DataFrame, unit: str, label: str, key: list[str], value: str, reps: int) -> DataFrame:
    """``key``, n_a, n_b, mean_a, mean_b, g, p: two groups of units compared on each measure, p by relabelling units, the same for all measures.

    ``frame`` has one row for each unit and ``key``. The relabelled sums come from weights of units (``resampled``): no row is copied.
    """
    observed = hedges_g(frame.join(units, unit), key, F.col(label), value).drop("welch_t")
    sums = resampled(frame, unit, key, value, labels_of(shuffled_labels(units, unit, label, reps), unit, label), by_label, reps + 1)
    stats = sums.select("rep", *key, (F.col("s1") / F.col("n1") - F.col("s0") / F.col("n0")).alias("d"))
    return observed.join(empirical_p(stats, key, "d").drop("observed"), key)


def gated(frame: DataFrame, key: list[str], by: list[str], above: Column, least_run: int, gates: dict[str, Column]) -> DataFrame:
    """``key``, longest, each gate, verdict: PASS where all ``gates`` (aggregates over the key's rows) hold and ``above`` holds in ``least_run`` rows in a row; else STOP."""
    checks = frame.groupBy(*key).agg(*[F.coalesce(g, F.lit(False)).alias(n) for n, g in gates.items()])
    runs = longest_run(frame, key, by, above).select(*key, "longest")
    out = checks.join(runs, key, "left").withColumn("longest", F.coalesce("longest", F.lit(0)))
    ok = F.col("longest") >= least_run
    for name in gates:
        ok = ok & F.col(name)
    return out.select(*key, "longest", *gates, F.when(ok, "PASS").otherwise("STOP").alias("verdict"))
