"""Nulls of back-to-back regression: features moved around against the channels, whole or beyond what nested features explain."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dense import _flat, _tuned, block_sums, first_half, least_penalty
from .sequences import placed


def null_shift(participant: object, rep: int, n: int, least: int) -> int:
    """A circular shift of n rows by ``least`` to n - ``least`` places, by hash: the same for all times and splits of a participant."""
    digest = hashlib.md5(f"shift|{participant}|{rep}".encode()).digest()
    return least + int.from_bytes(digest[:8], "big") % (n - 2 * least + 1)


def _shift_column(rep: Column, least: int) -> Column:
    """``null_shift`` of the participant and its ``_n`` rows, as a column."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("shift"), F.col("participant").cast("string"), rep.cast("string"))), 1, 16), 16, 10).cast("decimal(20,0)")
    return least + F.pmod(drawn, (F.col("_n") - 2 * least + 1).cast("decimal(20,0)")).cast("long")


def shifted_sums(trials: DataFrame, reps: int, least: int, slice_rows: int = 256, first_rep: int = 0) -> DataFrame:
    """participant, time, rep, block, sums: of each block, the sums of the features shifted around within each section, and
    their products with themselves and with the channels, one after the other. For participants of any number of trials.

    Features go to the places they are shifted to, in slices of ``slice_rows`` places, where they meet the channels: a
    task holds one slice of the channels and of all its shifts.
    """
    key = ["participant", "time", "section"]
    whole = trials.select(*key, "trial", "block", "x", "y")
    at = placed(whole, key, "trial", F.xxhash64("x", "y"))
    moved = at.select(*key, "_n", "_at", "x", F.explode(F.sequence(F.lit(first_rep), F.lit(first_rep + reps - 1))).alias("rep")).withColumn("to", F.pmod(F.col("_at") + _shift_column(F.col("rep"), least), F.col("_n")))
    moved = moved.select(*key, F.floor(F.col("to") / slice_rows).alias("slice"), "to", "rep", "x").withColumnsRenamed({k: f"_{k}" for k in [*key, "slice"]})
    fixed = at.select(*key, F.floor(F.col("_at") / slice_rows).alias("slice"), F.col("_at").alias("to"), "block", "y")

    def run(key: tuple, fixed: pd.DataFrame, moved: pd.DataFrame) -> pd.DataFrame:
        fixed, moved = fixed.sort_values("to"), moved.sort_values(["rep", "to"])
        y, x = np.array(fixed["y"].tolist(), float), np.array(moved["x"].tolist(), float).reshape(reps, len(fixed), -1)
        blocks, out = fixed["block"].to_numpy(), []
        for block in np.unique(blocks):
            here = blocks == block
            z, other = x[:, here], y[here]
            flat = np.concatenate([z.sum(axis=1), (z.transpose(0, 2, 1) @ z).reshape(reps, -1), (z.transpose(0, 2, 1) @ other).reshape(reps, -1)], axis=1)
            n = flat.shape[1]
            out.append(pd.DataFrame({"participant": key[0], "time": key[1], "rep": np.repeat(first_rep + np.arange(reps), n), "block": block, "i": np.tile(np.arange(n), reps), "v": flat.ravel()}))
        return pd.concat(out)

    by = [*key, "slice"]
    block = trials.schema["block"].dataType.simpleString()
    parts = fixed.groupBy(*by).cogroup(moved.groupBy(*[f"_{k}" for k in by])).applyInPandas(run, f"participant long, time int, rep int, block {block}, i int, v double")
    return _flat(parts, ["participant", "time", "rep", "block"])

#: Trials of one participant and time that are shifted in one task; more are cut into slices.
MOST_TRIALS = 1 << 15


class Moved:
    """Of the blocks of one participant and time: sums of the channels (and still features), and of the features for many shifts.

    ``still`` are n, sums and products of the columns f that stay, by block; ``moved`` the sums of the shifted features x', their products with
    themselves and with f, by repetition and block.
    """

    def __init__(self, blocks: np.ndarray, still: tuple[np.ndarray, ...], moved: tuple[np.ndarray, ...]):
        self.blocks, self.still, self.moved = blocks, still, moved
        self.p, self.f = moved[0].shape[2], still[1].shape[1]

    @classmethod
    def of_trials(cls, x: np.ndarray, f: np.ndarray, blocks: np.ndarray, sources: np.ndarray) -> Moved:
        """From trials in their order; ``sources`` (repetitions x trials) tells which trial's features come to each place."""
        every = np.unique(blocks)
        here = [np.flatnonzero(blocks == b) for b in every]
        still = (np.array([float(len(h)) for h in here]), np.array([f[h].sum(axis=0) for h in here]), np.array([f[h].T @ f[h] for h in here]))
        step, parts = max(1, (1 << 22) // max(1, x.size)), []
        for at in range(0, len(sources), step):
            z = [x[sources[at : at + step, h]] for h in here]
            parts.append([np.stack(v, axis=1) for v in ([m.sum(axis=1) for m in z], [m.transpose(0, 2, 1) @ m for m in z], [m.transpose(0, 2, 1) @ f[h] for m, h in zip(z, here, strict=True)])])
        return cls(every, still, tuple(np.concatenate(v) for v in zip(*parts, strict=True)))

    @classmethod
    def of_sums(cls, blocks: np.ndarray, still: list[np.ndarray], moved: list[np.ndarray], p: int) -> Moved:
        """One repetition, from flat sums of its blocks."""
        flat, m = np.array(still, float), np.array(moved, float)
        f = round((-1 + (1 + 4 * (flat.shape[1] - 1)) ** 0.5) / 2)
        parts = m[:, :p], m[:, p : p + p * p].reshape(-1, p, p), m[:, p + p * p :].reshape(-1, p, f)
        return cls(blocks, (flat[:, 0], flat[:, 1 : 1 + f], flat[:, 1 + f :].reshape(-1, f, f)), tuple(v[None] for v in parts))

    def half(self, chosen: np.ndarray, turn: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """n, sums and products of [features, channels] of the chosen blocks for each repetition; ``turn`` makes them of [x', f]."""
        n, fs, ff = (v[chosen].sum(axis=0) for v in self.still)
        ms, mm, mf = (v[:, chosen].sum(axis=1) for v in self.moved)
        reps = len(ms)
        sums = np.concatenate([ms, np.broadcast_to(fs, (reps, self.f))], axis=1)
        products = np.concatenate([np.concatenate([mm, mf], axis=2), np.concatenate([mf.transpose(0, 2, 1), np.broadcast_to(ff, (reps, self.f, self.f))], axis=2)], axis=1)
        return float(n), sums @ turn.T, turn @ products @ turn.T

    def turn(self, added: int | None) -> np.ndarray:
        """What makes [features, channels] of [x', f]. Whole: f are the channels. Nested: f are channels and still features, and of the last ``added``
        features only what the others don't explain is moved: x_add - R x + R x' with R x = x_add - B x_red."""
        p = self.p
        if added is None:
            return np.eye(p + self.f)
        c, red = self.f - p, p - added
        gram = self.still[2].sum(axis=0)[c:, c:]
        rest = np.concatenate([-np.linalg.lstsq(gram[:red, :red], gram[:red, red:], rcond=None)[0].T, np.eye(added)], axis=1)
        out = np.zeros((p + c, p + self.f))
        out[:p, p + c :] = np.eye(p)
        out[red:p, p + c :] -= rest
        out[red:p, :p] = rest
        out[p:, p : p + c] = np.eye(c)
        return out


def _centred(half: tuple[float, np.ndarray, np.ndarray]) -> np.ndarray:
    n, sums, products = half
    return products - sums[:, :, None] * sums[:, None, :] / max(n, 1)


class Decoder:
    """Ridge decoders of one half for all repetitions: the channels' factor is made once, since no shift changes it."""

    def __init__(self, half: tuple[float, np.ndarray, np.ndarray], p: int):
        self.n, self.p = half[0], p
        self.mean = half[1] / max(half[0], 1)
        c = _centred(half)
        self.width = c.shape[1] - p
        self.values, self.factor = np.linalg.eigh(c[0, p:, p:])
        self.seen, self.scale = self.factor.T @ c[:, p:, :p], float(np.trace(c[0, p:, p:])) / self.width

    def weights(self, alpha: float | np.ndarray) -> np.ndarray:
        """Channels x features for each repetition; ``alpha`` may differ between them."""
        scale = np.maximum(self.values + np.reshape(alpha, (-1, 1)) * self.scale, np.finfo(float).tiny)
        return self.factor @ (self.seen / scale[:, :, None])


def _scores(moved: Moved, added: int | None, sides: tuple[np.ndarray, np.ndarray], alpha: float | np.ndarray, most_condition: float, target: float | None) -> tuple[np.ndarray, np.ndarray]:
    """The diagonal (repetitions x features) of one direction, and which repetitions are valid."""
    turn, p = moved.turn(added), moved.p
    decoder, second = Decoder(moved.half(sides[0], turn), p), moved.half(sides[1], turn)
    c = _centred(second)
    values = np.linalg.eigvalsh(c[:, :p, :p])
    found = [least_penalty(v[0], v[-1], target) for v in values]
    inverse = np.linalg.pinv(c[:, :p, :p] + np.array([x for x, _ in found])[:, None, None] * np.eye(p), rcond=1e-12, hermitian=True)
    kappa = np.array([k for _, k in found])
    return np.einsum("rkc,rck->rk", inverse @ c[:, :p, p:], decoder.weights(alpha)), (second[0] >= p) & (np.isfinite(kappa) if target else kappa <= most_condition)


def _errors(moved: Moved, added: int | None, side: np.ndarray, alphas: list[float], folds: int) -> np.ndarray | None:
    """repetitions x alphas: the mean squared error over folds of a half's blocks."""
    turn, p, blocks = moved.turn(added), moved.p, np.flatnonzero(side)
    total, used = 0.0, 0
    fold = np.arange(len(blocks)) % folds
    for f in np.unique(fold):
        train, test = (moved.half(blocks[(fold == f) == held], turn) for held in (False, True))
        if train[0] < train[1].shape[1] - p:
            continue
        decoder, (n, sums, products) = Decoder(train, p), test
        across = sums[:, :, None] * decoder.mean[:, None, :]
        c = products - across - across.transpose(0, 2, 1) + n * decoder.mean[:, :, None] * decoder.mean[:, None, :]
        own = np.trace(c[:, :p, :p], axis1=1, axis2=2)
        one = []
        for a in alphas:
            w = decoder.weights(a)
            one.append((own - 2 * (w * c[:, p:, :p]).sum(axis=(1, 2)) + (w * (c[:, p:, p:] @ w)).sum(axis=(1, 2))) / (n * p))
        total, used = total + np.array(one).T, used + 1
    return total / used if used else None


def _halved(moved: Moved, split: int) -> tuple[np.ndarray, np.ndarray] | None:
    half = first_half(moved.blocks, split)
    return (half, ~half) if min(moved.still[0][half].sum(), moved.still[0][~half].sum()) >= 4 else None


def _over_shifts(trials: DataFrame, extra: DataFrame, reps: int, least: int, nested: bool, first_rep: int, most_trials: int, work, columns: list[str], schema: str) -> DataFrame:
    """``work(participant, time, first repetition, Moved, extra)`` gives rows, for all repetitions of a participant and time at once where its trials are ``most_trials``
    or fewer, and for one repetition after the other, from sums over slices, where they are more.

    Only participants whose sections all have twice ``least`` trials take part. ``extra`` has a row for each participant.
    """
    if "section" not in trials.columns:
        trials = trials.withColumn("section", F.lit(0))
    at = ["participant", "time"]
    still = F.concat("_y", "_x") if nested else F.col("_y")
    whole = trials.where("x is not null and y is not null").withColumns({"_x": F.col("x").cast("array<double>"), "_y": F.col("y").cast("array<double>")})
    whole = whole.select(*at, "section", "trial", "block", F.col("_x").alias("x"), still.alias("y"), F.xxhash64("_x", "_y").alias("_tie"))
    sizes = whole.groupBy(*at, "section").agg(F.count("*").alias("_m")).groupBy(*at).agg(F.min("_m").alias("_m"), F.sum("_m").alias("_all")).where(F.col("_m") >= 2 * least)
    whole = whole.join(sizes.select(*at, "_all"), at)

    def together(key: tuple, rows: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(other):
            return pd.DataFrame([], columns=columns)
        rows = rows.sort_values(["section", "trial", "_tie"])
        x, f = (np.array(rows[c].tolist(), float).reshape(len(rows), -1) for c in ("x", "y"))
        sources, start = [], 0
        for n in rows.groupby("section", sort=True).size():
            shifts = np.array([null_shift(key[0], r, n, least) for r in range(first_rep, first_rep + reps)])
            sources.append(start + (np.arange(n) - shifts[:, None]) % n)
            start += n
        moved = Moved.of_trials(x, f, rows["block"].to_numpy(), np.concatenate(sources, axis=1))
        return pd.DataFrame(list(work(key[0], rows["time"].iloc[0], first_rep, moved, other.iloc[0])), columns=columns)

    small = whole.where(F.col("_all") <= most_trials)
    out = _cogrouped(small, extra, together, schema)
    large = whole.where(F.col("_all") > most_trials)
    if large.isEmpty():
        return out

    def alone(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        moved = Moved.of_sums(rows["block"].to_numpy(), rows["sums"].tolist(), rows["shifted"].tolist(), int(rows["p"].iloc[0]))
        return pd.DataFrame(list(work(key[0], key[1], key[2], moved, rows.iloc[0])), columns=columns)

    fixed = block_sums(large.withColumn("_w", F.size("x")).withColumn("x", F.array().cast("array<double>")), [*at, "block", "_w"]).drop("p").withColumnRenamed("_w", "p")
    shifted = shifted_sums(large, reps, least, first_rep=first_rep).withColumnRenamed("sums", "shifted")
    rows = shifted.join(fixed, [*at, "block"]).join(extra, "participant")
    return out.unionByName(rows.groupBy(*at, "rep").applyInPandas(alone, schema))


def _cogrouped(small: DataFrame, extra: DataFrame, together, schema: str) -> DataFrame:
    """One group for each participant and time, beside the participant's row of ``extra``."""
    times = small.select(F.col("participant").alias("_p"), F.col("time").alias("_t")).distinct()
    beside = times.join(extra.withColumnRenamed("participant", "_q"), F.col("_p") == F.col("_q")).drop("_q")
    return small.groupBy("participant", "time").cogroup(beside.groupBy("_p", "_t")).applyInPandas(together, schema)


def b2b_nulls(
    trials: DataFrame, observed: DataFrame, families: dict[str, int], reps: int, least: int = 20, most_condition: float = 85.0,
    target: float | None = None, nested: bool = False, first_rep: int = 0, most_trials: int = MOST_TRIALS,
) -> DataFrame:
    """Back-to-back scores with the features shifted around against the channels: participant, split, direction, time, rep, family, score.

    ``observed`` (participant, split, direction, alpha, and rep where each repetition has its own) gives the penalties. With a column
    ``section``, features are shifted within each section. Whole designs are shifted, or, ``nested``, only what the last family holds beyond the others
    (Freedman and Lane, 1983): the fit of the last family on the others stays, as the others do, and its residuals are shifted together.

    A participant's trials of one time meet once, whatever the number of repetitions: the factor of the channels is made once, the sums of
    products of shifted features come from the trials in memory, and all repetitions are solved together. Above ``most_trials`` trials, features meet the
    channels in slices and a group is one repetition. Sections with fewer than twice ``least`` trials, and ill-conditioned designs, give no rows.
    """
    names, sizes = list(families), list(families.values())
    added = sizes[-1] if nested else None
    if nested and len(sizes) < 2:
        raise ValueError("a nested null needs a family to nest in")

    def work(participant: int, time: int, first: int, moved: Moved, extra: pd.Series) -> Iterator[tuple]:
        count = len(moved.moved[0])
        by: dict[tuple, dict] = {}
        for t in extra["tuned"]:
            by.setdefault((t["split"], t["direction"]), {})[t["rep"]] = t["alpha"]
        for (split, direction), alphas in sorted(by.items()):
            if (sides := _halved(moved, split)) is None:
                continue
            alpha = alphas[None] if None in alphas else np.array([alphas.get(r, np.nan) for r in range(first, first + count)])
            diagonal, valid = _scores(moved, added, sides if direction == 1 else sides[::-1], alpha, most_condition, target)
            at = 0
            for name, size in zip(names, sizes, strict=True):
                score = diagonal[:, at : at + size].mean(axis=1)
                yield from ((participant, split, direction, time, first + r, name, float(score[r])) for r in np.flatnonzero(valid & np.isfinite(score)))
                at += size

    rep = F.col("rep") if "rep" in observed.columns else F.lit(None).cast("int")
    alphas = observed.withColumn("rep", rep).groupBy("participant", "split", "direction", "rep").agg(F.max("alpha").alias("alpha"))
    tuned = alphas.groupBy("participant").agg(F.array_sort(F.collect_list(F.struct("split", "direction", "rep", "alpha"))).alias("tuned"))
    columns = ["participant", "split", "direction", "time", "rep", "family", "score"]
    schema = "participant long, split int, direction int, time int, rep int, family string, score double"
    return _over_shifts(trials, tuned, reps, least, nested, first_rep, most_trials, work, columns, schema)


def null_alphas(
    trials: DataFrame, families: dict[str, int], alphas: list[float], reps: int, splits: int = 20, folds: int = 4, least: int = 20, nested: bool = False, first_rep: int = 0, most_trials: int = MOST_TRIALS
) -> DataFrame:
    """participant, split, direction, rep, alpha: the penalty tuned anew for each repetition, over all times, as ``b2b_alphas`` tunes the observed one."""
    added = list(families.values())[-1] if nested else None

    def work(participant: int, time: int, first: int, moved: Moved, extra: pd.Series) -> Iterator[tuple]:
        for split in range(splits):
            if (sides := _halved(moved, split)) is None:
                continue
            for direction, side in ((1, sides[0]), (2, sides[1])):
                if (errors := _errors(moved, added, side, alphas, folds)) is not None:
                    yield from ((participant, split, direction, first + r, errors[r].tolist()) for r in range(len(errors)))

    people = trials.select("participant").distinct().withColumn("_one", F.lit(1))
    schema = "participant long, split int, direction int, rep int, errors array<double>"
    found = _over_shifts(trials, people, reps, least, nested, first_rep, most_trials, work, ["participant", "split", "direction", "rep", "errors"], schema)
    key = ["participant", "split", "direction", "rep"]
    mean = found.groupBy(*key).agg(F.array(*[F.avg(F.col("errors")[k]) for k in range(len(alphas))]).alias("e"))
    near = F.array_min("e") + F.greatest(F.lit(1e-8), 1e-6 * F.abs(F.array_min("e")))
    return mean.select(*key, F.array_min(F.filter(F.transform("e", lambda e, k: F.when(e <= near, k)), lambda k: k.isNotNull())).alias("_k")).select(
        *key, F.element_at(F.array(*[F.lit(float(a)) for a in alphas]), F.col("_k") + 1).alias("alpha")
    )


def window_maximum(scores: DataFrame, first: int, last: int) -> DataFrame:
    """participant, rep, stat: the largest size of a family's mean score (over splits and directions) at a time from ``first`` to ``last``, over families and times."""
    mean = scores.where(F.col("time").between(first, last)).groupBy("participant", "rep", "family", "time").agg(F.avg("score").alias("m"))
    return mean.groupBy("participant", "rep").agg(F.max(F.abs("m")).alias("stat"))


def chunk_gaps(done: DataFrame, wanted: DataFrame, reps: int) -> DataFrame:
    """participant, rep, n of the repetitions (0 to ``reps`` - 1) that chunks of ``done`` (participant, chunk, rep) lack (n is 0) or hold in more than one chunk."""
    every = wanted.select("participant").distinct().withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    found = done.select("participant", "chunk", "rep").distinct().groupBy("participant", "rep").agg(F.count("*").alias("n"))
    return every.join(found, ["participant", "rep"], "left").select("participant", "rep", F.coalesce("n", F.lit(0)).alias("n")).where("n <> 1")
