"""Dense solvers on sums of products: back-to-back regression, its spatial filters, its generalisation over time and its nulls."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .permutation import balanced_halves


def least_on_plateau(errors: np.ndarray) -> int:
    """The first place whose error is within 1e-8, or a millionth, of the least."""
    return int(np.flatnonzero(errors <= errors.min() + max(1e-8, 1e-6 * abs(float(errors.min()))))[0])


_eight = cache(balanced_halves)


def first_half(blocks: np.ndarray, split: int) -> np.ndarray:
    """Rows of the half that a split trains on first.

    8 blocks are halved by the balanced assignments, of which there are 20; other numbers in an order drawn for each pair of
    splits, of which the odd one swaps the halves.
    """
    every = np.unique(blocks)
    if len(every) == 8:
        halves = _eight()
        return np.isin(blocks, every[np.array(halves[split % len(halves)][1]) - 1])
    order = np.random.default_rng(split // 2 + 1).permutation(every)
    half = np.isin(blocks, order[: len(order) // 2])
    return half if split % 2 == 0 else ~half


def least_penalty(low: float, high: float, target: float | None) -> tuple[float, float]:
    """The least penalty that brings the condition of a matrix with squared singular values from ``low`` to ``high`` to ``target``, and the condition after it."""
    kappa = float(np.sqrt(high / low)) if low > 1e-14 * high else float("inf")
    if not target or kappa <= target:
        return 0.0, kappa
    penalty = max(0.0, float(high - target**2 * max(low, 0.0)) / (target**2 - 1))
    return penalty, float(np.sqrt((high + penalty) / (max(low, 0.0) + penalty))) if penalty else kappa


def two_eigenvalues(aa: Column, bb: Column, ab: Column) -> tuple[Column, Column]:
    """The smaller and the larger eigenvalue of the matrix of aa, ab, ab and bb."""
    mid, gap = (aa + bb) / 2, F.sqrt((aa - bb) * (aa - bb) + 4 * ab * ab) / 2
    return mid - gap, mid + gap


def condition_gate(designs: DataFrame, low: str, high: str, n: str, width: int, target: float) -> DataFrame:
    """``designs`` with condition, penalty (as ``least_penalty``), condition_after, warn (a penalty is needed) and invalid (fewer rows than ``width``, or a condition that no penalty mends)."""
    kappa = F.when(F.col(low) > 1e-14 * F.col(high), F.sqrt(F.col(high) / F.col(low))).otherwise(float("inf"))
    floor = F.greatest(F.col(low), F.lit(0.0))
    gated = designs.withColumn("condition", kappa).withColumn("penalty", F.when(F.col("condition") > target, F.greatest(F.lit(0.0), (F.col(high) - target**2 * floor) / (target**2 - 1))).otherwise(0.0))
    after = F.when(F.col("penalty") > 0, F.sqrt((F.col(high) + F.col("penalty")) / (floor + F.col("penalty")))).otherwise(F.col("condition"))
    gated = gated.withColumns({"condition_after": after, "warn": F.col("condition") > target})
    return gated.withColumn("invalid", (F.col(n) < width) | (F.col("condition_after") == float("inf")))


class Sums:
    """Numbers, sums and products of rows [x, y], for a set of blocks; ``p`` of the columns are features."""

    def __init__(self, n: float, sums: np.ndarray, products: np.ndarray, p: int):
        self.n, self.sums, self.products, self.p = n, sums, products, p
        self.mean = sums / n if n else sums

    @property
    def centred(self) -> np.ndarray:
        return self.about(self.mean)

    def about(self, center: np.ndarray) -> np.ndarray:
        """Products of the rows less ``center``."""
        across = np.outer(self.sums, center)
        return self.products - across - across.T + self.n * np.outer(center, center)

    def decoders(self, alphas: list[float]) -> list[np.ndarray]:
        """Ridge weights of x on y for each alpha; the penalty is alpha times the mean sum of squares of the channels."""
        c, p = self.centred, self.p
        values, turn = np.linalg.eigh(c[p:, p:])
        seen, scale = turn.T @ c[p:, :p], float(np.trace(c[p:, p:])) / (len(c) - p)
        return [turn @ (seen / np.maximum(values + a * scale, np.finfo(float).tiny)[:, None]) for a in alphas]

    def turned(self, left: np.ndarray) -> Sums:
        """The sums of ``left`` times each row; the features stay in front."""
        return Sums(self.n, left @ self.sums, left @ self.products @ left.T, self.p)

    def filtered(self, weights: np.ndarray) -> Sums:
        """The sums with the channels seen through a spatial filter, a column for each of its components."""
        left = np.zeros((self.p + weights.shape[1], len(self.sums)))
        left[: self.p, : self.p], left[self.p :, self.p :] = np.eye(self.p), weights.T
        return self.turned(left)

    def regressed(self, most_condition: float, target: float | None = None) -> tuple[np.ndarray, float, float, bool]:
        """Features on channels: weights (features x channels), the condition of the features, their penalty, and whether rows are enough and well conditioned.

        With ``target`` the penalty is the least one that brings the condition down to it, and the condition is that after it.
        """
        c, p = self.centred, self.p
        values = np.linalg.eigvalsh(c[:p, :p])
        penalty, kappa = least_penalty(values[0], values[-1], target)
        weights = np.linalg.pinv(c[:p, :p] + penalty * np.eye(p), rcond=1e-12, hermitian=True) @ c[:p, p:]
        return weights, kappa, penalty, bool(self.n >= p and (np.isfinite(kappa) if target else kappa <= most_condition))

    def explained(self, decoder: np.ndarray, most_condition: float, target: float | None = None) -> tuple[np.ndarray, float, float, bool]:
        """The diagonal of the regression of decoded features on the features; condition, penalty and validity as ``regressed``."""
        weights, kappa, penalty, valid = self.regressed(most_condition, target)
        return (weights * decoder.T).sum(axis=1), kappa, penalty, valid


def sums_errors(parts: list[Sums], folds: np.ndarray, alphas: list[float]) -> np.ndarray | None:
    """``alpha_errors`` from the sums of blocks, of which ``folds`` tells the fold."""
    errors, used = np.zeros(len(alphas)), 0
    for f in np.unique(folds):
        train, test = (_total([s for s, k in zip(parts, folds, strict=True) if (k == f) == held]) for held in (False, True))
        p = test.p
        if train is None or train.n < len(train.sums) - p:
            continue
        c = test.about(train.mean)
        for k, w in enumerate(train.decoders(alphas)):
            errors[k] += float(np.trace(c[:p, :p]) - 2 * (w * c[p:, :p]).sum() + (w * (c[p:, p:] @ w)).sum()) / (test.n * p)
        used += 1
    return errors / used if used else None


def _total(parts: list[Sums]) -> Sums | None:
    return Sums(sum(s.n for s in parts), sum(s.sums for s in parts), sum(s.products for s in parts), parts[0].p) if parts else None


#: Numbers that a task holds before it hands its sums on.
HELD = 8 << 20


def block_sums(trials: DataFrame, key: list[str]) -> DataFrame:
    """``key``, p (features) and sums: n, the sums and the products of [x, y], one after the other, of the trials of each key.

    Each task sums its own rows, and Spark adds these sums element by element, so that a key with most of the trials
    is never in one task. Trials without x or y take no part; the widths of x and y are alike within a key.
    """
    rows = trials.where("x is not null and y is not null").select(*key, F.col("x").cast("array<double>").alias("x"), F.col("y").cast("array<double>").alias("y"))
    fields = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in key)
    types: list[pa.DataType] = []

    def flushed(held: dict[tuple, np.ndarray]) -> pa.RecordBatch:
        sizes = [len(v) for v in held.values()]
        of = pa.array(np.repeat(np.arange(len(sizes)), sizes))
        columns = [pa.array(c, t).take(of) for c, t in zip(zip(*held, strict=True), [*types, pa.int32()], strict=True)]
        at = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
        return pa.RecordBatch.from_arrays([*columns, pa.array(at), pa.array(np.concatenate(list(held.values())))], names=[*key, "p", "i", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            types[:] = [batch.schema.field(k).type for k in key]
            members: dict[tuple, list[int]] = {}
            for i, k in enumerate(zip(*(batch.column(c).to_pylist() for c in key), strict=True)):
                members.setdefault(k, []).append(i)
            x, y = batch.column("x"), batch.column("y")
            for k, at in members.items():
                both = np.hstack([np.array(c.take(pa.array(at)).to_pylist(), float) for c in (x, y)])
                flat = np.concatenate([[len(at)], both.sum(axis=0), (both.T @ both).ravel()])
                named = (*k, len(x[at[0]]))
                held[named] = held[named] + flat if named in held else flat
            if sum(map(len, held.values())) > HELD:
                yield flushed(held)
                held.clear()
        if held:
            yield flushed(held)

    parts = rows.mapInArrow(run, f"{fields}, p int, i int, v double")
    return _flat(parts, [*key, "p"])


def _flat(parts: DataFrame, key: list[str]) -> DataFrame:
    """Elements (i, v) added up and put in order, as one array ``sums`` for each key: as long as one row's products."""
    summed = parts.groupBy(*key, "i").agg(F.sum("v").alias("v"))
    return summed.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("_s")).select(*key, F.col("_s.v").alias("sums"))


def _parts(rows: pd.DataFrame) -> tuple[np.ndarray, list[Sums]]:
    """Blocks in order, and their sums; rows of one block stay in their order."""
    rows = rows.sort_values("block", kind="stable")
    out = []
    for p, flat in zip(rows["p"], rows["sums"], strict=True):
        flat = np.asarray(flat, float)
        width = round((-1 + (1 + 4 * (len(flat) - 1)) ** 0.5) / 2)
        out.append(Sums(flat[0], flat[1 : 1 + width], flat[1 + width :].reshape(width, width), int(p)))
    return rows["block"].to_numpy(), out


def _halves(blocks: np.ndarray, parts: list[Sums], split: int) -> tuple[np.ndarray, list[list[Sums]]] | None:
    """The blocks of the first half, and the sums of both; None if a half has under 4 trials."""
    half = first_half(blocks, split)
    both = [[s for s, h in zip(parts, half, strict=True) if h == side] for side in (True, False)]
    return (half, both) if all(sum(s.n for s in side) >= 4 for side in both) else None


def _with_filters(sums: DataFrame, filters: DataFrame | None) -> DataFrame:
    """``sums`` with the filters of the participant's splits in one column."""
    if filters is None:
        return sums
    return sums.join(filters.groupBy("participant").agg(F.collect_list(F.struct("split", "weights", "width")).alias("filters")), "participant")


def _filtered(parts: list[Sums], rows: pd.DataFrame, split: int) -> list[Sums]:
    if "filters" not in rows:
        return parts
    weights = next(np.asarray(f["weights"], float).reshape(-1, f["width"]) for f in rows["filters"].iloc[0] if f["split"] == split)
    return [s.filtered(weights) for s in parts]


def b2b_alphas(trials: DataFrame, alphas: list[float], splits: int = 20, folds: int = 4, sums: DataFrame | None = None, filters: DataFrame | None = None) -> DataFrame:
    """participant, split, direction, alpha: one penalty for all times, from the mean of the times' errors.

    ``filters`` (as ``evoked_filters``) stand before the channels.

    Everything comes from ``block_sums``: a group is the blocks of a participant and time, however many their trials.
    """
    def tune(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        blocks, parts = _parts(rows)
        out = []
        for split in range(splits):
            if (halved := _halves(blocks, parts, split)) is None:
                continue
            for direction, first in ((1, halved[1][0]), (2, halved[1][1])):
                first = _filtered(first, rows, split)
                errors = sums_errors(first, np.arange(len(first)) % folds, alphas)
                if errors is not None:
                    out += [(key[0], split, direction, k, float(e)) for k, e in enumerate(errors)]
        return pd.DataFrame(out, columns=["participant", "split", "direction", "k", "error"])

    sums = block_sums(trials, ["participant", "time", "block"]) if sums is None else sums
    found = _with_filters(sums, filters).groupBy("participant", "time").applyInPandas(tune, "participant long, split int, direction int, k int, error double")
    mean = found.groupBy("participant", "split", "direction", "k").agg(F.avg("error").alias("e"))
    ranked = mean.groupBy("participant", "split", "direction").agg(F.min("e").alias("least"), F.collect_list(F.struct("k", "e")).alias("all"))
    plateau = F.filter("all", lambda p: p["e"] <= F.col("least") + F.greatest(F.lit(1e-8), 1e-6 * F.abs("least")))
    chosen = F.element_at(F.array(*[F.lit(float(a)) for a in alphas]), F.array_min(F.transform(plateau, lambda p: p["k"])) + 1)
    return ranked.select("participant", "split", "direction", chosen.alias("alpha"))


def _solved(sums: DataFrame, tuned: DataFrame, most_condition: float, target: float | None, filters: DataFrame | None) -> DataFrame:
    """participant, split, direction, time, alpha, decoder, weights, width, condition, penalty, valid: both regressions, a row of weights for each feature."""

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        blocks, parts = _parts(rows)
        alphas, out = {(t["split"], t["direction"]): t["alpha"] for t in rows["tuned"].iloc[0]}, []
        for split in sorted({s for s, _ in alphas}):
            if (halved := _halves(blocks, parts, split)) is None:
                continue
            totals, found = [_total(_filtered(side, rows, split)) for side in halved[1]], []
            for direction, (first, second) in ((1, totals), (2, totals[::-1])):
                if (alpha := alphas.get((split, direction))) is not None:
                    found.append((direction, alpha, first.decoders([alpha])[0], *second.regressed(most_condition, target)))
            valid = len(found) == 2 and all(ok for *_, ok in found)
            out += [(key[0], split, d, key[1], alpha, g.T.ravel(), w.ravel(), g.shape[0], kappa, penalty, valid) for d, alpha, g, w, kappa, penalty, _ in found]
        return pd.DataFrame(out, columns=["participant", "split", "direction", "time", "alpha", "decoder", "weights", "width", "condition", "penalty", "valid"])

    schema = "participant long, split int, direction int, time int, alpha double, decoder array<double>, weights array<double>, width int, condition double, penalty double, valid boolean"
    return _with_filters(sums, filters).join(_tuned(tuned), "participant").groupBy("participant", "time").applyInPandas(solve, schema)


def _by_family(solved: DataFrame, families: dict[str, int], decoder: str, weights: str) -> DataFrame:
    """A row for each family: the trace of its part of weights times decoder, and its mean."""
    at, parts = 0, []
    for name, n in families.items():
        cut = [F.slice(c, at * F.col("width") + 1, n * F.col("width")) for c in (weights, decoder)]
        trace = F.aggregate(F.zip_with(*cut, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        parts.append(F.struct(F.lit(name).alias("family"), trace.alias("trace"), (trace / n).alias("score")))
        at += n
    return solved.withColumn("_f", F.explode(F.array(*parts))).withColumns({c: F.col(f"_f.{c}") for c in ("family", "trace", "score")}).drop("_f", decoder, weights, "width")


def b2b_scores(
    trials: DataFrame, families: dict[str, int], alphas: list[float], splits: int = 20, folds: int = 4, most_condition: float = 85.0, target: float | None = None, filters: DataFrame | None = None
) -> DataFrame:
    """Back-to-back scores: participant, split, direction, time, family, trace, score, alpha, condition, penalty, valid.

    ``trials`` has participant, time, trial, block, x (features) and y (channels), one row for each trial and time.
    Spark sums the products by participant, time and block (``block_sums``); a first pass gives each participant, split and
    direction one penalty for all times (``b2b_alphas``), the second one solves. What a task solves is the blocks' sums, which
    don't grow with the trials. A split is valid if both directions are. ``families`` gives the number of consecutive features of each.
    The features' own regression has no penalty and is valid up to ``most_condition``, or the least one that brings its condition to ``target``.
    ``filters`` (as ``evoked_filters``) stand before the channels, each split's own.
    """
    sums = block_sums(trials, ["participant", "time", "block"])
    solved = _solved(sums, b2b_alphas(trials, alphas, splits, folds, sums, filters), most_condition, target, filters)
    return _by_family(solved, families, "decoder", "weights").select("participant", "split", "direction", "time", "family", "trace", "score", "alpha", "condition", "penalty", "valid")


def b2b_generalised(
    trials: DataFrame, families: dict[str, int], alphas: list[float], splits: int = 20, folds: int = 4, most_condition: float = 85.0, target: float | None = None, filters: DataFrame | None = None, every: int = 1
) -> DataFrame:
    """Decoders trained at one time and tested at another: participant, split, direction, t_train, t_test, family, trace, score, alpha, valid.

    Neither trials nor products of channels at two times are needed: a decoder comes from the training half at its time,
    and what it is tested with are the features' weights on the channels at the other time, from the test half. Both are made once for each time,
    as features x channels numbers, and meet by participant, split and direction. At equal times the scores are those of ``b2b_scores``.
    ``every`` takes each so many times.
    """
    sums = block_sums(trials, ["participant", "time", "block"])
    solved = _solved(sums, b2b_alphas(trials, alphas, splits, folds, sums, filters), most_condition, target, filters).where(F.col("time") % every == 0)
    key = ["participant", "split", "direction"]
    trained = solved.select(*key, F.col("time").alias("t_train"), "alpha", "decoder", "width", F.col("valid").alias("_ok"))
    tested = solved.select(*key, F.col("time").alias("t_test"), "weights", "valid")
    met = trained.join(tested, key).withColumn("valid", F.col("valid") & F.col("_ok")).drop("_ok")
    return _by_family(met, families, "decoder", "weights").select(*key, "t_train", "t_test", "family", "trace", "score", "alpha", "valid")


def evoked_filters(sums: DataFrame, splits: int, n: int, scope: str = "half", floor: float = 1e-6) -> DataFrame:
    """participant, split, weights, width, powers, explained: spatial filters that favour what repeats over trials.

    From ``block_sums`` by participant, time and block: the channels are whitened over all times and trials, eigenvalues below ``floor`` of
    the largest raised to it, and the ``n`` leading components of the whitened mean over trials are kept, as columns of length 1.
    ``scope`` half fits each split on the trials of its first half alone, all on every trial. The time course of a component may
    have either sign; the largest weight is positive.
    """
    if scope not in ("half", "all"):
        raise ValueError("scope is half or all")

    def collapse(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """One block: products over all times, means by time."""
        _, parts = _parts(rows)
        channels = slice(parts[0].p, None)
        return pd.DataFrame({
            "participant": [key[0]], "block": [key[1]], "products": [sum(s.products[channels, channels] for s in parts).ravel()],
            "times": [rows.sort_values("block", kind="stable")["time"].to_numpy()], "n": [[s.n for s in parts]], "sums": [np.concatenate([s.sums[channels] for s in parts])],
        })

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        blocks, out = rows["block"].to_numpy(), []
        for split in range(splits):
            used = rows[first_half(blocks, split)] if scope == "half" else rows
            if not len(used):
                continue
            width = len(used["sums"].iloc[0]) // len(used["times"].iloc[0])
            by_time: dict = {}
            for r in used.itertuples():
                for t, n_, v in zip(r.times, r.n, np.reshape(r.sums, (-1, width)), strict=True):
                    m, total = by_time.get(t, (0, 0.0))
                    by_time[t] = (m + n_, total + v)
            count = sum(m for m, _ in by_time.values())
            mean = sum(v for _, v in by_time.values()) / count
            values, turn = np.linalg.eigh(sum(np.reshape(v, (width, width)) for v in used["products"]) / count - np.outer(mean, mean))
            white = turn / np.sqrt(np.maximum(values, floor * max(values[-1], np.finfo(float).tiny)))
            evoked = white.T @ np.array([v / m - mean for m, v in by_time.values()]).T
            power, lead = np.linalg.eigh(evoked @ evoked.T / evoked.shape[1])
            power, found = power[::-1], white @ lead[:, ::-1][:, :n]
            found = found / np.linalg.norm(found, axis=0)
            found = found * np.sign(found[np.abs(found).argmax(axis=0), np.arange(found.shape[1])])
            out.append((key[0], split, found.ravel(), found.shape[1], np.maximum(power[:n], 0), float(power[:n].sum() / max(np.maximum(power, 0).sum(), np.finfo(float).tiny))))
        return pd.DataFrame(out, columns=["participant", "split", "weights", "width", "powers", "explained"])

    block = sums.schema["block"].dataType.simpleString()
    parts = sums.groupBy("participant", "block").applyInPandas(collapse, f"participant long, block {block}, products array<double>, times array<int>, n array<double>, sums array<double>")
    return parts.groupBy("participant").applyInPandas(fit, "participant long, split int, weights array<double>, width int, powers array<double>, explained double")


def _tuned(alphas: DataFrame) -> DataFrame:
    """participant, tuned: an entry for each split and direction."""
    return alphas.groupBy("participant").agg(F.array_sort(F.collect_list(F.struct("split", "direction", "alpha"))).alias("tuned"))
