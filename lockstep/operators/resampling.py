"""Resampling tests whose randomness is a hash of repetition and row, equal on any engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hash_unit

#: Tasks that units are dealt to before they are repeated: a table of units is small, their repetitions are not.
PARTS = 64


def repetitions(frame: DataFrame, n: int) -> DataFrame:
    """``frame`` once for each repetition 0..n; 0 is the data as observed."""
    return frame.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n))))


def sign_flips(frame: DataFrame, unit: str, n: int) -> DataFrame:
    """``sign`` of each unit in each repetition: 1 or -1, and 1 in repetition 0."""
    flip = hash_unit(F.lit("sign"), F.col("rep"), F.col(unit)) < 0.5
    return repetitions(frame, n).withColumn("sign", F.when((F.col("rep") > 0) & flip, -1).otherwise(1))


def shuffled_labels(units: DataFrame, unit: str, label: str, n: int) -> DataFrame:
    """unit, rep, label: labels dealt anew among all units in each repetition, group sizes kept; as they are in repetition 0. A null unit has the last place, as in SQL.

    The windows sort the units (one row each) within a repetition. Labels, once each, meet the places of all repetitions by a merge:
    Spark's estimates don't see that these are ``n`` times the units, and would send them through the driver.
    """
    reps = repetitions(units.select(unit).repartition(PARTS, unit), n)
    order = F.when(F.col("rep") > 0, hash_unit(F.lit("label"), F.col("rep"), F.col(unit))).otherwise(F.lit(0.0))
    place = F.row_number().over(Window.partitionBy("rep").orderBy(order, F.asc_nulls_last(unit)))
    labels = units.select(F.row_number().over(Window.orderBy(F.asc_nulls_last(unit))).alias("_k"), label)
    return reps.select("rep", unit, place.alias("_k")).join(labels.hint("merge"), "_k").drop("_k")


def empirical_p(stats: DataFrame, key: list[str], stat: str) -> DataFrame:
    """observed and p = (1 + repetitions at least as large) / (n + 1), two-sided on \\|stat\\|."""
    w = Window.partitionBy(*key) if key else Window.partitionBy(F.lit(0))
    seen = stats.withColumn("_o", F.max(F.when(F.col("rep") == 0, F.col(stat))).over(w))
    return seen.groupBy(*key).agg(F.max("_o").alias("observed"), (F.count_if((F.col("rep") > 0) & (F.abs(F.col(stat)) >= F.abs(F.col("_o")) - 1e-9)) + 1).cast("double").alias("_hits"), F.count_if(F.col("rep") > 0).alias("n")).select(*key, "observed", (F.col("_hits") / (F.col("n") + 1)).alias("p"))


def bootstrap_rows(frame: DataFrame, key: list[str], unit: str, n: int) -> DataFrame:
    """Rows drawn with replacement within each key: one for each row and repetition 1..n, by hashed place. A null unit has the last place, as in SQL.

    Draws meet rows by a merge: Spark's estimates don't see that the draws are ``n`` times the rows, and would send them through the driver.
    """
    w = Window.partitionBy(*key)
    placed = frame.withColumn("_k", F.row_number().over(w.orderBy(F.asc_nulls_last(unit))) - 1).withColumn("_n", F.count("*").over(w))
    draws = repetitions(placed.select(*key, F.col(unit).alias("_u"), "_n").repartition(PARTS, "_u"), n).where("rep > 0")
    draws = draws.withColumn("_k", F.floor(hash_unit(F.lit("boot"), F.col("rep"), F.col("_u")) * F.col("_n")).cast("int")).drop("_n", "_u")
    return draws.join(placed.drop("_n").hint("merge"), [*key, "_k"]).drop("_k")
