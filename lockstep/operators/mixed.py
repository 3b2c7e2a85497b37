"""Mixed models with two crossed random intercepts: variance components by profiled likelihood over sums of cells."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Logarithms of the ratio of the error's to the intercepts' variance that are searched; at the upper end the intercepts have none.
LOW, HIGH = -12.0, 16.0


@dataclass
class Fit:
    """One model: fixed effects with standard errors, variances (0 at the boundary) and -2 log likelihood."""

    columns: list[str]
    beta: np.ndarray
    error: np.ndarray
    residual: float
    solved: float
    absorbed: float
    deviance: float
    n: int
    reml: bool
    singular: list[str] = field(default_factory=list)


def _cells(frame: DataFrame, solved: str, absorbed: str, y: str, columns: list[str]) -> tuple[DataFrame, int]:
    """_a, _b, and sums and products of w = [1, columns, y] for each pair of levels that has rows; and the width of w."""
    known = frame.where(" and ".join(f"`{c}` is not null" for c in [solved, absorbed, y, *columns]))
    rows = known.select(F.col(solved).alias("_a"), F.col(absorbed).alias("_b"), F.array(F.lit(1.0), *[F.col(c).cast("double") for c in [*columns, y]]).alias("w"))
    width = len(columns) + 2
    sums = [F.sum(F.col("w")[i]).alias(f"s{i}") for i in range(width)]
    products = [F.sum(F.col("w")[i] * F.col("w")[j]).alias(f"p{i}_{j}") for i in range(width) for j in range(i, width)]
    return rows.groupBy("_a", "_b").agg(*sums, *products), width


def _levels(cells: DataFrame, width: int, most: int) -> tuple[list, np.ndarray]:
    """Levels of the solved factor in order, and the products of [1, columns, y, levels]; ``most`` levels at most."""
    sums = [F.sum(f"s{i}").alias(f"s{i}") for i in range(width)]
    products = [F.sum(f"p{i}_{j}").alias(f"p{i}_{j}") for i in range(width) for j in range(i, width)]
    by = cells.groupBy("_a").agg(*sums, *products).orderBy("_a").limit(most + 1).collect()
    if len(by) > most:
        raise ValueError(f"the solved factor has more than {most} levels: name the smaller factor as solved")
    q = len(by)
    out = np.zeros((width + q, width + q))
    for k, r in enumerate(by):
        for i in range(width):
            out[i, width + k] = out[width + k, i] = r[f"s{i}"]
            for j in range(i, width):
                out[i, j] += r[f"p{i}_{j}"]
        out[width + k, width + k] = r["s0"]
    out[:width, :width] = np.triu(out[:width, :width]) + np.triu(out[:width, :width], 1).T
    return [r["_a"] for r in by], out


def _absorbed(rows: DataFrame, size: int, ratios: list[float]) -> list[tuple[float, np.ndarray]]:
    """For each ratio: sum of log(n + ratio) over the absorbed levels, and sum of v v' / (n + ratio), v a level's sums of [1, columns, y, levels].

    Each task adds up its own levels. What Spark adds and the driver gets is the square of the solved factor's levels, whatever the rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, products = np.zeros(len(ratios)), np.zeros((len(ratios), size * size))
        any_rows = False
        for batch in batches:
            if not batch.num_rows:
                continue
            any_rows = True
            at, v = batch.column("at"), batch.column("v")
            lengths = at.value_lengths().to_numpy()
            at, v, n = at.flatten().to_numpy(), v.flatten().to_numpy(), batch.column("n").to_numpy()
            scale = [1 / (n + r) for r in ratios]
            for k, r in enumerate(ratios):
                logs[k] += np.log(n + r).sum()
            ends = np.cumsum(lengths)
            pairs, start, begun = lengths**2, 0, 0
            while begun < len(lengths):  # pairs of numbers of some levels at a time
                end = max(begun + 1, int(np.searchsorted(np.cumsum(pairs[begun:]), 1 << 20, side="right")) + begun)
                m = lengths[begun:end]
                first = np.repeat(ends[begun:end] - m, m * m)
                inside = np.arange(len(first)) - np.repeat(np.cumsum(m * m) - m * m, m * m)
                i, j = first + inside // np.repeat(m, m * m), first + inside % np.repeat(m, m * m)
                where, value = at[i] * size + at[j], v[i] * v[j]
                for k in range(len(ratios)):
                    products[k] += np.bincount(where, value * np.repeat(scale[k][begun:end], m * m), minlength=size * size)
                begun = end
        if any_rows:
            for k in range(len(ratios)):
                flat = np.r_[logs[k], products[k]]
                here = np.flatnonzero(flat)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(here), k, np.int32)), pa.array(here), pa.array(flat[here])], names=["k", "i", "v"])

    found = rows.select("n", "at", "v").mapInArrow(run, "k int, i long, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((len(ratios), 1 + size * size))
    out[found["k"].to_numpy(), found["i"].to_numpy()] = found["v"].to_numpy()
    return [(float(o[0]), o[1:].reshape(size, size)) for o in out]


def _deviance(whole: np.ndarray, log_b: float, less: np.ndarray, used: list[int], ratio: float, ratio_a: float | None, levels_b: int, reml: bool) -> tuple[float, dict]:
    """-2 log likelihood with the error's variance profiled out; ``ratio`` None: without the absorbed intercepts, ``ratio_a`` None: without the solved ones."""
    s = whole if ratio is None else whole - less
    fixed, y = used[:-1], used[-1]
    levels = np.arange(y + 1, len(whole))  # behind y stand the levels
    q = len(levels)
    log_v = 0.0 if ratio is None else log_b - levels_b * math.log(ratio)
    order = [*fixed, y]
    inner = s[np.ix_(order, order)].copy()
    if ratio_a is not None:
        a = s[np.ix_(levels, levels)] + ratio_a * np.eye(q)
        across = s[np.ix_(levels, order)]
        factor = np.linalg.cholesky(a)
        half = np.linalg.solve(factor, across)
        inner -= half.T @ half
        log_v += 2 * np.log(np.diag(factor)).sum() - q * math.log(ratio_a)
    xx, xy, yy = inner[:-1, :-1], inner[:-1, -1], inner[-1, -1]
    beta = np.linalg.solve(xx, xy)
    n = whole[0, 0] - (len(fixed) if reml else 0)
    residual = max(float(yy - xy @ beta), 1e-300) / n
    value = n * (math.log(2 * math.pi * residual) + 1) + log_v + (np.linalg.slogdet(xx)[1] if reml else 0.0)
    return value, {"beta": beta, "error": np.sqrt(np.maximum(np.diag(np.linalg.inv(xx)), 0) * residual), "residual": residual}


def _vertex(at: np.ndarray, values: list[float], k: int) -> float:
    """The lowest place of the parabola through the points around number ``k``; its own place at the ends."""
    if not 0 < k < len(at) - 1:
        return float(at[k])
    left, mid, right = values[k - 1 : k + 2]
    bend = left - 2 * mid + right
    return float(at[k] + (at[1] - at[0]) * (np.clip((left - right) / (2 * bend), -1, 1) if bend > 0 else 0.0))


def _best_solved(whole: np.ndarray, log_b: float, less: np.ndarray, used: list[int], ratio: float | None, levels_b: int, reml: bool) -> tuple[float, float | None, dict]:
    """The least deviance over the solved factor's ratio (None: no variance): a grid, then the interval around its best again and again, then a parabola."""
    low, high = LOW, HIGH
    none = _deviance(whole, log_b, less, used, ratio, None, levels_b, reml)
    of = lambda g: _deviance(whole, log_b, less, used, ratio, math.exp(g), levels_b, reml)
    while True:
        grid = np.linspace(low, high, 9)
        tried = [of(g) for g in grid]
        k = int(np.argmin([v for v, _ in tried]))
        low, high = grid[max(0, k - 1)], grid[min(8, k + 1)]
        if high - low < 4e-3:
            break
    at = _vertex(grid, [v for v, _ in tried], k)
    best = min((*of(at), math.exp(at)), (*tried[k], math.exp(grid[k])), key=lambda b: b[0])
    return (none[0], None, none[1]) if none[0] <= best[0] + 1e-9 else (best[0], best[2], best[1])


def crossed_intercepts(frame: DataFrame, solved: str, absorbed: str, y: str, columns: list[str], models: list[list[str]] | None = None, reml: bool = False, most: int = 4096) -> list[Fit]:
    """Fits of ``y`` on ``columns`` (and each of ``models``, subsets of them) with random intercepts for the levels of two crossed factors.

    Henderson's equations: the larger factor, ``absorbed``, has a diagonal block and is absorbed level by level in Spark; the other, ``solved``, of ``most`` levels at most,
    is left as one small system for the driver. For a ratio of the error's to the absorbed intercepts' variance, one pass over the cells gives the absorbed system
    of all models; the other ratio and the error's variance are profiled out of it. The first ratio is found by
    passes over several values at a time, each in a third of the interval before, and then by a parabola. A variance at the boundary is 0 and is named in ``singular``.

    ``reml`` fits by restricted likelihood. Rows with a null are left out; repeated rows count as often as they come. An empty table is an error.
    """
    models = [columns] if models is None else models
    cells, width = _cells(frame, solved, absorbed, y, columns)
    cells = cells.persist()
    levels, whole = _levels(cells, width, most)
    if not levels:
        raise ValueError("no row without a null")
    size = width + len(levels)
    place = cells.sparkSession.createDataFrame([(a, width + k) for k, a in enumerate(levels)], StructType([cells.schema["_a"], StructField("_at", IntegerType())]))
    numbered = cells.join(F.broadcast(place), "_a")  # as many rows as the solved factor has levels
    sparse = numbered.groupBy("_b").agg(F.sum("s0").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)], F.array_sort(F.collect_list(F.struct("_at", F.col("s0").alias("_k")))).alias("_c"))
    rows = sparse.select("n", F.concat(F.sequence(F.lit(0), F.lit(width - 1)), F.col("_c._at")).cast("array<long>").alias("at"), F.concat(F.array(*[f"s{i}" for i in range(width)]), F.col("_c._k")).alias("v"))
    rows = rows.persist()
    levels_b = rows.count()
    names = ["1", *columns]
    used = {k: [0, *(names.index(c) for c in m), width - 1] for k, m in enumerate(models)}
    none = {k: _best_solved(whole, 0.0, np.zeros_like(whole), used[k], None, levels_b, reml) for k in used}
    grids, best = {k: np.linspace(LOW, HIGH, 7) for k in used}, {}
    while grids:
        wanted = sorted({float(g) for grid in grids.values() for g in grid})
        found = dict(zip(wanted, _absorbed(rows, size, [math.exp(g) for g in wanted]), strict=True))
        onward = {}
        for k, grid in grids.items():
            tried = [(*_best_solved(whole, *found[float(g)], used[k], math.exp(g), levels_b, reml), math.exp(g)) for g in grid]
            j = int(np.argmin([t[0] for t in tried]))
            if k not in best or tried[j][0] <= best[k][0]:
                best[k] = tried[j]
            low, high = grid[max(0, j - 1)], grid[min(len(grid) - 1, j + 1)]
            if len(grid) > 1:  # a last pass at the vertex
                onward[k] = np.linspace(low, high, 7) if high - low >= 4e-3 else np.array([_vertex(grid, [t[0] for t in tried], j)])
        grids = onward
    rows.unpersist()
    cells.unpersist()
    out = []
    for k, m in enumerate(models):
        value, ratio_a, at, ratio = best[k] if best[k][0] < none[k][0] - 1e-9 else (*none[k], None)
        residual = at["residual"]
        variances = {solved: residual / ratio_a if ratio_a else 0.0, absorbed: residual / ratio if ratio else 0.0}
        out.append(Fit(["1", *m], at["beta"], at["error"], float(residual), float(variances[solved]), float(variances[absorbed]), float(value), int(whole[0, 0]), reml, [f for f, v in variances.items() if not v]))
    return out


def chi_squared_p(x: float, df: int) -> float:
    """The upper tail of the chi-squared distribution with a whole number of degrees of freedom."""
    if x <= 0:
        return 1.0
    odd = df % 2
    total, term = (math.erfc(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2)) if odd else (0.0, math.exp(-x / 2))
    for k in range(2 + odd, df + 1, 2):
        total, term = total + term, term * x / k
    return total


def nested_ratio_tests(spark: SparkSession, fits: list[Fit]) -> DataFrame:
    """model, added, chi_squared, df, p of each fit against the one before, which its columns hold; by maximum likelihood."""
    rows = []
    for small, large in zip(fits, fits[1:], strict=False):
        if small.reml or large.reml or not set(small.columns) < set(large.columns):
            raise ValueError("nested models by maximum likelihood are wanted")
        df = len(large.columns) - len(small.columns)
        statistic = max(0.0, small.deviance - large.deviance)
        rows.append((" + ".join(large.columns), " + ".join(c for c in large.columns if c not in small.columns), statistic, df, chi_squared_p(statistic, df)))
    return spark.createDataFrame(rows, "model string, added string, chi_squared double, df int, p double")


def effects_table(spark: SparkSession, fits: list[Fit]) -> DataFrame:
    """model, column, beta, error, and of the model residual, solved, absorbed (variances), deviance, n, singular."""
    rows = [
        (" + ".join(f.columns), c, float(b), float(e), f.residual, f.solved, f.absorbed, f.deviance, f.n, bool(f.singular)) for f in fits for c, b, e in zip(f.columns, f.beta, f.error, strict=True)
    ]
    return spark.createDataFrame(rows, "model string, column string, beta double, error double, residual double, solved double, absorbed double, deviance double, n long, singular boolean")
