"""Linear models from sums of products: Spark sums per key and fold, small matrices are solved, rows never leave the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hash_unit


def group_fold(group: Column, folds: int) -> Column:
    """Fold (from 0) of a group by hash: all its rows share it."""
    return F.floor(hash_unit(F.lit("fold"), group) * folds).cast("int")


def moments(frame: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Per key: n, and the sums of ``columns`` and of their products (upper triangle by rows)."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    sums, products = [F.sum(F.col(c)) for c in columns], [F.sum(F.col(a) * F.col(b)) for a, b in pairs]
    return frame.groupBy(*by).agg(F.count("*").alias("n"), F.array(*sums).alias("sums"), F.array(*products).alias("products"))


def unfold(n: Iterable, sums: Iterable, products: Iterable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n, sums and product matrices of the rows of ``moments``."""
    n, sums, flat = np.array(n, float), np.stack(list(sums)), np.stack(list(products))
    p = sums.shape[1]
    full = np.zeros((len(n), p, p))
    full[:, *np.triu_indices(p)] = flat
    return n, sums, full + np.triu(full, 1).transpose(0, 2, 1)


def centred(n: float, sums: np.ndarray, products: np.ndarray) -> np.ndarray:
    return products - np.outer(sums, sums) / n


def grouped_ridge(frame: DataFrame, group: str, features: list[str], target: str, penalty: float = 1.0, folds: int = 5) -> DataFrame:
    """``frame`` with ``fold`` and ``predicted``: a ridge on standardised features, fit on the folds that hold none of the row's group.

    One pass sums per fold; the sums of the other folds are the totals less these. Rows with a null in a feature or the target
    take no part in a fit, and are predicted from their features if these are there. A fold without others has no prediction.
    """
    p = len(features)

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        n, sums, products = unfold(rows["n"], rows["sums"], rows["products"])
        out = []
        for k, fold in enumerate(rows["fold"]):
            m = n.sum() - n[k]
            if m < 1:
                continue
            rest = sums.sum(axis=0) - sums[k]
            s, mean = centred(m, rest, products.sum(axis=0) - products[k]), rest / m
            sd = np.sqrt(np.maximum(np.diag(s)[:p], 0) / m)
            sd[sd < 1e-12] = 1.0
            w = np.linalg.solve(s[:p, :p] / np.outer(sd, sd) + penalty * np.eye(p), s[:p, p] / sd) / sd
            out.append((int(fold), w.tolist(), float(mean[p] - w @ mean[:p])))
        return pd.DataFrame(out, columns=["fold", "_w", "_b"])

    dealt = frame.withColumn("fold", group_fold(F.col(group), folds))
    whole = dealt.dropna(subset=[*features, target, "fold"]).select("fold", *[F.col(c).cast("double").alias(c) for c in [*features, target]])
    found = moments(whole, ["fold"], [*features, target]).groupBy().applyInPandas(solve, "fold int, _w array<double>, _b double")
    # One row for each fold: the number of folds bounds it.
    guess = F.col("_b") + sum(F.col("_w")[k] * F.col(c) for k, c in enumerate(features))
    return dealt.join(F.broadcast(found), "fold", "left").withColumn("predicted", guess).drop("_w", "_b")


def compared_ridges(frame: DataFrame, group: str, features: list[str], part: list[str], target: str, penalty: float = 1.0, folds: int = 5) -> DataFrame:
    """``frame`` with ``fold``, ``predicted`` and ``predicted_part``: ``grouped_ridge`` on all features and on a part of them, over the same folds.

    Only rows with all features and the target are fit and compared.
    """
    whole = frame.dropna(subset=[group, target, *features])
    both = grouped_ridge(whole, group, features, target, penalty, folds).withColumnsRenamed({"predicted": "_whole", "fold": "_fold"})
    return grouped_ridge(both, group, part, target, penalty, folds).withColumnRenamed("predicted", "predicted_part").withColumnRenamed("_whole", "predicted").drop("_fold")


def smoothness(features: int, lags: int) -> np.ndarray:
    """Penalty on the differences of each feature's neighbouring lags."""
    d = np.diff(np.eye(lags), axis=0)
    return np.kron(np.eye(features), d.T @ d)


def lagged_coefficients(n: np.ndarray, sums: np.ndarray, products: np.ndarray, penalty: np.ndarray, alphas: list[float]) -> tuple[float, np.ndarray]:
    """The alpha whose fits on the other folds correlate best with a fold's target, on average, and its fit on all folds; the target is the last column."""
    p = sums.shape[1] - 1

    def fits(s: np.ndarray, chosen: list[float]) -> np.ndarray:
        return np.linalg.pinv(s[:p, :p] + np.array(chosen)[:, None, None] * penalty, rcond=1e-12, hermitian=True) @ s[:p, p]

    score = np.full((len(alphas), len(n)), np.nan)
    for k in range(len(n)):
        if n.sum() - n[k] < 2 or n[k] < 2:
            continue
        test = centred(n[k], sums[k], products[k])
        w = fits(centred(n.sum() - n[k], sums.sum(axis=0) - sums[k], products.sum(axis=0) - products[k]), alphas)
        size = np.einsum("ai,ij,aj->a", w, test[:p, :p], w) * test[p, p]
        some = size > 1e-18
        score[some, k] = (w @ test[:p, p])[some] / np.sqrt(size[some])
    held = ~np.isnan(score)
    mean = np.where(held.any(axis=1), np.where(held, score, 0).sum(axis=1) / np.maximum(held.sum(axis=1), 1), -np.inf)
    best = int(mean.argmax()) if np.isfinite(mean).any() else len(alphas) // 2
    return alphas[best], fits(centred(n.sum(), sums.sum(axis=0), products.sum(axis=0)), [alphas[best]])[0]


def lagged_residual(frame: DataFrame, key: list[str], by: list[str], features: list[str], target: str, lags: int, alphas: list[float], folds: int = 3) -> DataFrame:
    """``frame`` with ``alpha`` and ``residual``: ``target`` less what the features of the row and the ``lags`` rows before it explain, by key.

    Columns are standardised by key, null counts as the mean, and coefficients of neighbouring lags are held together. Alpha comes from
    ``folds`` consecutive parts of a key, over whose edges no lag reaches. The first ``lags`` rows of a key lose only the mean.
    A key's rows meet in one task, since they are in order; only its sums, a row for each fold, go to Python.
    """
    w = Window.partitionBy(*key)
    names = [*features, target]
    values = frame.withColumns({f"_v{i}": F.col(c).cast("double") for i, c in enumerate(names)} | {"_at": F.row_number().over(w.orderBy(*by)) - 1, "_n": F.count("*").over(w)})
    values = values.withColumns({f"_m{i}": F.avg(f"_v{i}").over(w) for i in range(len(names))} | {f"_s{i}": F.stddev_pop(f"_v{i}").over(w) for i in range(len(names))})
    z = values.withColumns({f"_z{i}": F.coalesce(F.when(F.col(f"_s{i}") > 0, (F.col(f"_v{i}") - F.col(f"_m{i}")) / F.col(f"_s{i}")), F.lit(0.0)) for i in range(len(names))})
    z = z.withColumn("_fold", F.floor(F.col("_at") * folds / F.col("_n")).cast("int"))
    places = [(i, lag) for i in range(len(features)) for lag in range(lags + 1)]

    def lagged(within: list[str]) -> dict[str, Column]:
        at = Window.partitionBy(*within).orderBy("_at")
        return {f"_x{i}_{lag}": F.coalesce(F.lag(f"_z{i}", lag).over(at), F.lit(0.0)) for i, lag in places}

    xs, y = [f"_x{i}_{lag}" for i, lag in places], f"_z{len(features)}"
    penalty = smoothness(len(features), lags + 1)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [lagged_coefficients(*unfold(*parts), penalty, alphas) for parts in zip(rows["_n"], rows["_sums"], rows["_products"], strict=True)]
            yield rows[key].assign(alpha=[a for a, _ in found], _w=[w.tolist() for _, w in found])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.select(*key).schema) + ", alpha double, _w array<double>"
    sums = moments(z.withColumns(lagged([*key, "_fold"])), [*key, "_fold"], [*xs, y])
    # A key's parts are as many as the folds.
    parts = sums.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_fold", "n", "sums", "products"))).alias("_p"))
    fits = parts.select(*key, *[F.col(f"_p.{c}").alias(f"_{c}") for c in ("n", "sums", "products")]).mapInPandas(solve, schema)
    fits = fits.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], "alpha", "_w")
    guess = F.when(F.col("_at") >= lags, sum(F.col("_w")[j] * F.col(x) for j, x in enumerate(xs))).otherwise(0.0)
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)]
    t = len(features)
    explained = F.col(f"_m{t}") + F.col(f"_s{t}") * guess
    return z.withColumns(lagged(key)).join(fits, same).select(*frame.columns, "alpha", (F.col(f"_v{t}") - explained).alias("residual"))
