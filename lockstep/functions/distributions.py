"""p values of t, F, rank and correlation statistics: the statistics are Spark's, the distributions small vector functions."""

from __future__ import annotations

from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..operators.summaries import average_ranks


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction on the side where that converges fast."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    turned = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - x, x)
    tiny = 1e-300
    c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for top in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    gamma = np.vectorize(lgamma, otypes=[float])
    with np.errstate(divide="ignore"):
        front = np.exp(gamma(p + q) - gamma(p) - gamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    found = np.where(z <= 0, 0.0, front * h)
    return np.where(turned, 1 - found, found)


@F.pandas_udf(DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of t; null for null or without degrees of freedom."""
    ok = t.notna() & df.notna() & (df > 0)
    out = pd.Series(np.nan, t.index)
    out[ok] = incomplete_beta(df[ok] / 2, 0.5, df[ok] / (df[ok] + t[ok] ** 2))
    return out.astype(object).where(ok, None)


def t_quantile(p: float, df: float) -> float:
    """The value that t stays below with probability ``p``: by halving an interval."""
    if not 0 < p < 1 or df <= 0:
        raise ValueError("a probability between 0 and 1 and degrees of freedom are wanted")
    if p == 0.5:
        return 0.0
    tail, low, high = min(p, 1 - p), 0.0, 1.0
    upper = lambda t: float(incomplete_beta(np.array(df / 2), np.array(0.5), np.array(df / (df + t * t)))) / 2
    while upper(high) > tail:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if upper(mid) > tail else (low, mid)
    return mid if p > 0.5 else -mid


@F.pandas_udf(DoubleType())
def f_p(f: pd.Series, between: pd.Series, within: pd.Series) -> pd.Series:
    """Upper p of F."""
    ok = f.notna() & between.notna() & within.notna() & (between > 0) & (within > 0)
    out = pd.Series(np.nan, f.index)
    out[ok] = incomplete_beta(within[ok] / 2, between[ok] / 2, within[ok] / (within[ok] + between[ok] * f[ok].clip(lower=0)))
    return out.astype(object).where(ok, None)


def normal_p(z: Column) -> Column:
    """Two-sided p of a standard normal value: that of t at a million degrees of freedom."""
    return t_p(z, F.lit(1e6))


def spearman_p(rho: Column, n: Column) -> Column:
    """Two-sided p of a rank correlation over n pairs, by t."""
    df = (n - 2).cast("double")
    return F.when(F.abs(rho) >= 1, F.lit(0.0)).otherwise(t_p(rho * F.sqrt(df / (1 - rho * rho)), df))


def welch_test(frame: DataFrame, key: list[str], group: Column, value: str) -> DataFrame:
    """t, df and p of the difference of two means by key; null where a group has fewer than 2 values or neither has spread."""
    a, b = F.when(group, F.col(value)), F.when(~group, F.col(value))
    s = frame.groupBy(*key).agg(*[f(x).alias(f"_{n}{k}") for k, x in (("a", a), ("b", b)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    ea, eb = F.col("_va") / F.col("_na"), F.col("_vb") / F.col("_nb")
    df = (ea + eb) * (ea + eb) / (ea * ea / (F.col("_na") - 1) + eb * eb / (F.col("_nb") - 1))
    ok = (F.col("_na") > 1) & (F.col("_nb") > 1) & (ea + eb > 0)
    return s.select(*key, F.when(ok, (F.col("_ma") - F.col("_mb")) / F.sqrt(ea + eb)).alias("t"), F.when(ok, df).alias("df")).withColumn("p", t_p(F.col("t"), F.col("df")))


def rank_sum_test(frame: DataFrame, key: list[str], group: Column, value: str) -> DataFrame:
    """u and p_ranks (normal, with ties and without continuity correction) of two groups by key."""
    ranked = average_ranks(frame.where(F.col(value).isNotNull()).withColumn("_g", group), key, value, "_r")
    ties = ranked.groupBy(*key, value).agg(F.count("*").cast("double").alias("_t")).groupBy(*key).agg(F.sum(F.pow("_t", F.lit(3.0)) - F.col("_t")).alias("_ties"))
    s = ranked.groupBy(*key).agg(F.sum(F.when(F.col("_g"), F.col("_r"))).alias("_s"), F.count_if("_g").cast("double").alias("_a"), F.count_if(~F.col("_g")).cast("double").alias("_b")).join(ties, key)
    u, n = F.col("_s") - F.col("_a") * (F.col("_a") + 1) / 2, F.col("_a") + F.col("_b")
    spread = F.col("_a") * F.col("_b") / 12 * (n + 1 - F.col("_ties") / (n * (n - 1)))
    found = s.select(*key, u.alias("u"), F.when(spread > 0, (u - F.col("_a") * F.col("_b") / 2) / F.sqrt(spread)).alias("_z"))
    return found.withColumn("p_ranks", normal_p(F.col("_z"))).drop("_z")
