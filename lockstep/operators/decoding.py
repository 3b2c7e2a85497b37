"""Classes and residuals out of fold: multinomial logit, its scores, shrunk distances, preflight of halves."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hash_unit
from .dense import block_sums
from .models import group_fold
from .resampling import repetitions
from .sequences import placed


def level_index(column: str, levels: list) -> Column:
    """Place (from 0) of a value among ``levels``; null for any other."""
    return F.nullif(F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(column)), F.lit(0)) - 1


def grouped_logit(frame: DataFrame, group: str, values: str, target: str, levels: list, folds: int = 5, penalty: float = 1.0) -> DataFrame:
    """``frame`` with ``fold`` and ``probability`` (an array by level): a multinomial logit on standardised values, fit on the folds that hold none of the row's group.

    ``values`` is an array of one width; the penalty is on half the squared weights, against the sum of losses. A null or
    NaN in the values or a null group leaves the probability null; rows of other targets are predicted but not learnt from.
    A level that the other folds lack has probability 0; without others the probability is null. Spark fits, one fold at a
    time: what meets on the driver is a gradient of levels x values.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    dealt = frame.withColumn("fold", group_fold(F.col(group), folds))
    known = F.coalesce(F.col(group).isNotNull() & F.col(values).isNotNull() & ~F.exists(values, lambda v: v.isNull() | F.isnan(v)), F.lit(False))
    rows = dealt.where(known).withColumns({"_x": array_to_vector(F.col(values).cast("array<double>")), "_y": level_index(target, levels).cast("double")})
    labelled = rows.where("_y is not null")
    sizes = {r.fold: r.n for r in labelled.groupBy("fold").agg(F.count("*").alias("n")).collect()}
    none = F.lit(None).cast("array<double>")
    out = dealt.where(~known).withColumn("probability", none)
    for fold in range(folds):
        here, others = rows.where(F.col("fold") == fold), sum(n for k, n in sizes.items() if k != fold)
        if others:
            logit = LogisticRegression(
                featuresCol="_x", labelCol="_y", predictionCol="_guess", probabilityCol="_p", rawPredictionCol="_raw",
                family="multinomial", regParam=penalty / others, maxIter=500, tol=1e-7,
            )
            found = logit.fit(labelled.where(F.col("fold") != fold).select("_x", "_y")).transform(here)
            given = vector_to_array("_p")
            found = found.withColumn("probability", F.array(*[F.coalesce(F.get(given, F.lit(k)), F.lit(0.0)) for k in range(len(levels))]))
        else:
            found = here.withColumn("probability", none)
        out = out.unionByName(found.select(*dealt.columns, "probability"))
    return out


def _loss(p: Column, least: float) -> Column:
    return -F.log(F.greatest(F.least(p, F.lit(1.0)), F.lit(least)))


def class_scores(frame: DataFrame, key: list[str], target: str, levels: list, probability: str, least: float = 1e-15) -> DataFrame:
    """By key: n, log_loss, log_loss_prior (of the levels' own shares), brier (mean over rows and levels), accuracy (ties: the first level).

    Rows of another target or without probabilities take no part; one pass of sums.
    """
    rows = frame.withColumn("_y", level_index(target, levels)).where(F.col("_y").isNotNull() & F.col(probability).isNotNull())
    p = [F.get(probability, F.lit(k)) for k in range(len(levels))]
    gap = sum(((F.col("_y") == k).cast("double") - v) * ((F.col("_y") == k).cast("double") - v) for k, v in enumerate(p)) / len(levels)
    best = F.array_position(probability, F.array_max(probability)) - 1
    counts = [F.count_if(F.col("_y") == k).alias(f"_c{k}") for k in range(len(levels))]
    sums = rows.groupBy(*key).agg(
        F.count("*").alias("n"), F.avg(_loss(F.get(probability, F.col("_y").cast("int")), least)).alias("log_loss"), F.avg(gap).alias("brier"),
        F.avg((best == F.col("_y")).cast("double")).alias("accuracy"), *counts,
    )
    share = [F.col(f"_c{k}") / F.col("n") for k in range(len(levels))]
    prior = sum(F.when(s > 0, -s * F.log(s)).otherwise(0.0) for s in share)
    return sums.where("n > 0").withColumn("log_loss_prior", prior).select(*key, "n", "log_loss", "log_loss_prior", "brier", "accuracy")


def shuffled_losses(frame: DataFrame, unit: str, target: str, levels: list, probability: str, reps: int, least: float = 1e-15) -> DataFrame:
    """rep, log_loss: that of the targets as they are in repetition 0, and dealt anew among all rows in the others, with ``probability`` kept.

    Rows are ordered by a hash of repetition and ``unit``, a unique and non-null key, in slices (``placed``), and the levels' counts are laid
    along that order: a task holds a slice of a repetition, never all rows.
    """
    rows = frame.withColumn("_y", level_index(target, levels).cast("int")).where(F.col("_y").isNotNull() & F.col(probability).isNotNull()).select(unit, "_y", F.col(probability).alias("_p"))
    seen = {r["_y"]: r.n for r in rows.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    ends = np.cumsum([seen.get(k, 0) for k in range(len(levels))])
    dealt = repetitions(rows, reps).withColumn("_h", hash_unit(F.lit("deal"), F.col("rep"), F.col(unit)))
    dealt = placed(dealt, ["rep"], "_h", F.col(unit))
    drawn = sum((F.col("_at") >= int(e)).cast("int") for e in ends[:-1]) if len(levels) > 1 else F.lit(0)
    label = F.when(F.col("rep") == 0, F.col("_y")).otherwise(drawn)
    return dealt.groupBy("rep").agg(F.avg(_loss(F.get("_p", label), least)).alias("log_loss"))


def shuffled_p(losses: DataFrame) -> DataFrame:
    """log_loss of repetition 0, the shuffled ones' mean, and p = (1 + shuffled losses as small) / (n + 1)."""
    found = losses.groupBy().agg(F.max(F.when(F.col("rep") == 0, F.col("log_loss"))).alias("log_loss"), F.collect_list(F.when(F.col("rep") > 0, F.col("log_loss"))).alias("_all"))
    small = F.size(F.filter("_all", lambda v: v <= F.col("log_loss") + 1e-9))
    mean = F.aggregate("_all", F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size("_all"), F.lit(0))
    return found.where("log_loss is not null").select("log_loss", mean.alias("shuffled"), ((1 + small) / (1 + F.size("_all"))).alias("p"))


def shrunk_distance(frame: DataFrame, residuals: list[str], shrink: float = 0.1) -> DataFrame:
    """``distance`` (squared Mahalanobis) and ``surprise`` (negative log density of a Gaussian around 0) of each row's residuals.

    Their covariance over all complete rows is drawn towards the mean variance on its diagonal by ``shrink``. One row of sums
    reaches the driver. Rows with a null residual get null; with fewer than two complete rows all are null.
    """
    k = len(residuals)
    full = F.lit(True)
    for c in residuals:
        full = full & F.col(c).isNotNull()
    row = frame.where(full).agg(F.count("*").alias("n"), *[F.covar_samp(a, b).alias(f"c{i}_{j}") for i, a in enumerate(residuals) for j, b in enumerate(residuals) if i <= j]).first()
    if row is None or row.n < 2:
        return frame.withColumns({"distance": F.lit(None).cast("double"), "surprise": F.lit(None).cast("double")})
    cov = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
    cov = shrink * max(np.trace(cov) / k, 1e-6) * np.eye(k) + (1 - shrink) * cov
    inverse = np.linalg.pinv(cov, hermitian=True)
    size = float(np.linalg.slogdet(cov)[1]) + k * float(np.log(2 * np.pi))
    distance = sum(float(inverse[i, j]) * F.col(a) * F.col(b) for i, a in enumerate(residuals) for j, b in enumerate(residuals))
    return frame.withColumn("distance", distance).withColumn("surprise", 0.5 * (F.col("distance") + size))


def half_conditions(frame: DataFrame, unit: str, values: str, splits: int = 40, buckets: int = 64) -> DataFrame:
    """split, half, n, condition: the condition numbers of an array column, standardised over all rows, in random halves.

    Units fall into ``buckets`` by hash, and a split takes half of the buckets, by hash. Spark sums products by bucket once; all
    splits are solved from these few rows. The condition is null where it is infinite (as many rows as columns or
    more, and full rank, are needed); a column without spread counts as deviation 1. Rows without values or unit take no part.
    """
    bucket = F.floor(hash_unit(F.lit("bucket"), F.col(unit)) * buckets).cast("int")
    rows = frame.where(F.col(unit).isNotNull()).select(bucket.alias("bucket"), F.col(values).alias("x"), F.array().cast("array<double>").alias("y"))

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        width = int(rows["p"].iloc[0])
        flat = np.zeros((buckets, 1 + width + width * width))
        flat[rows["bucket"].to_numpy()] = np.stack(rows["sums"].to_list())
        whole = flat.sum(axis=0)
        mean = whole[1 : 1 + width] / whole[0]
        spread = np.diag(whole[1 + width :].reshape(width, width)) / whole[0] - mean**2
        sd = np.sqrt(np.where(spread > 1e-16, spread, 1.0))
        out = []
        for split in range(splits):
            order = half_order(split, buckets)
            for half, members in enumerate((order[: buckets // 2], order[buckets // 2 :])):
                part = flat[members].sum(axis=0)
                n, s, products = part[0], part[1 : 1 + width], part[1 + width :].reshape(width, width)
                z = (products - np.outer(s, mean) - np.outer(mean, s) + n * np.outer(mean, mean)) / np.outer(sd, sd)
                power = np.linalg.eigvalsh(z)
                finite = n >= width and power[0] > 1e-12 * max(power[-1], 1e-300)
                out.append((split, half, int(n), float(np.sqrt(power[-1] / power[0])) if finite else None))
        return pd.DataFrame(out, columns=["split", "half", "n", "condition"])

    return block_sums(rows, ["bucket"]).groupBy("p").applyInPandas(solve, "split int, half int, n long, condition double")


def half_order(split: int, buckets: int) -> list[int]:
    """Buckets in the order of a hash: the first half of them is a split's first half."""
    import hashlib

    return sorted(range(buckets), key=lambda b: (hashlib.md5(f"half|{split}|{b}".encode()).hexdigest(), b))
