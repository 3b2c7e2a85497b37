"""Signals as tables: channels, drift, residuals, segments, voiced runs. Sums are Spark's; only small systems are solved outside it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import rmse
from ..sources.tables import finite
from .sequences import circular_shift, ordered, placed


def by_channel(frame: DataFrame, keep: list[str], values: str) -> DataFrame:
    """One row for each element of an array column: ``keep``, channel (from 0), x (double)."""
    return frame.select(*keep, F.posexplode(values).alias("channel", "x")).withColumn("x", F.col("x").cast("double"))


def zscore_channels(long: DataFrame, key: list[str], value: str, out: str = "z") -> DataFrame:
    """z by ``key`` (such as section and channel) from finite values; a deviation of 0 counts as 1, and what isn't finite becomes 0."""
    known = F.when(finite(F.col(value)), F.col(value))
    stats = long.groupBy(*key).agg(F.avg(known).alias("_m"), F.stddev_samp(known).alias("_s"))
    scale = F.when(F.coalesce(F.col("_s"), F.lit(0.0)) > 0, F.col("_s")).otherwise(1.0)
    return long.join(stats, key).withColumn(out, F.coalesce((known - F.col("_m")) / scale, F.lit(0.0))).drop("_m", "_s")


def channel_qc(long: DataFrame, epoch: list[str], channel: str, value: str, baseline: Column) -> DataFrame:
    """By channel: variance of all values, and root mean square of baseline values less their epoch's baseline mean."""
    before = F.when(baseline, F.col(value))
    parts = long.groupBy(channel, *epoch).agg(F.count(before).alias("k"), F.sum(before).alias("s"), F.sum(before * before).alias("q"))
    noise = parts.groupBy(channel).agg(F.sqrt(F.sum(F.when(F.col("k") > 0, F.greatest(F.lit(0.0), F.col("q") - F.col("s") * F.col("s") / F.col("k")))) / F.sum("k")).alias("baseline_rms"))
    return long.groupBy(channel).agg(F.var_samp(value).alias("variance"), F.count(value).alias("n")).join(noise, channel)


def picked(values: Column, names: list[str], wanted: list[str]) -> Column:
    """Elements of ``values`` for the channels ``wanted``, in that order; an unknown name is an error."""
    if missing := [w for w in wanted if w not in names]:
        raise ValueError(f"no channel {missing}")
    return F.array(*[F.get(values, F.lit(names.index(w))) for w in wanted])


def drift_residual(frame: DataFrame, key: list[str], at: str, value: str, out: str = "residual") -> DataFrame:
    """``value`` less its line over ``at`` by key, from sums: ``fit`` and ``residual``. Without spread in ``at`` the fit is the mean."""
    line = frame.groupBy(*key).agg(F.regr_slope(value, at).alias("_b"), F.avg(F.when(F.col(value).isNotNull(), F.col(at))).alias("_x"), F.avg(F.when(F.col(at).isNotNull(), F.col(value))).alias("_y"))
    fit = F.col("_y") + F.coalesce(F.col("_b"), F.lit(0.0)) * (F.col(at) - F.col("_x"))
    return frame.join(line, key).withColumn("fit", fit).withColumn(out, F.col(value) - F.col("fit")).drop("_b", "_x", "_y")


def freedman_lane(frame: DataFrame, key: list[str], by: list[str], at: str, value: str, shift: int | Column) -> DataFrame:
    """``surrogate``: the fit of the nuisance at each row plus the residual ``shift`` places before, around the circle of the key."""
    parts = drift_residual(frame, key, at, value, "_r")
    return circular_shift(parts, key, by, ["_r"], shift).withColumn("surrogate", F.col("fit") + F.col("_r")).drop("_r", "fit")


def gram(frame: DataFrame, values: str) -> tuple[int, np.ndarray, np.ndarray]:
    """n, mean and covariance of an array column. Each task sums products of its rows; what reaches the driver is bounded by the square of the width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = 0, 0.0, 0.0
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float)
            if len(x):
                n, total, products = n + len(x), total + x.sum(axis=0), products + x.T @ x
        if n:
            flat = np.concatenate([[n], total, products.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], names=["i", "v"])

    sums = frame.where(F.col(values).isNotNull()).select(values).mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    flat = np.array([r.v for r in sums.orderBy("i").collect()])
    if not len(flat):
        return 0, np.zeros(0), np.zeros((0, 0))
    width = next(w for w in range(1, len(flat)) if 1 + w + w * w >= len(flat))
    n, mean = int(flat[0]), flat[1 : 1 + width] / flat[0]
    return n, mean, flat[1 + width :].reshape(width, width) / n - np.outer(mean, mean)


def spatial_components(frame: DataFrame, values: str, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, filter (a column for each of the ``n`` leading components) and their variances, largest first; the largest weight of each is positive."""
    _, mean, cov = gram(frame, values)
    power, vectors = np.linalg.eigh(cov)
    vectors, power = vectors[:, ::-1][:, :n], power[::-1][:n]
    return mean, vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]), power


def apply_filter(values: Column, mean: np.ndarray, weights: np.ndarray) -> Column:
    """Weights transposed times (values - mean), as an array column."""
    centred = F.zip_with(values, F.array(*[F.lit(float(m)) for m in mean]), lambda x, m: x.cast("double") - m)
    dot = lambda w: F.aggregate(F.zip_with(centred, F.array(*[F.lit(float(v)) for v in w]), lambda x, v: x * v), F.lit(0.0), lambda s, v: s + v)
    return F.array(*[dot(w) for w in weights.T])


def rectified_steps(frame: DataFrame, key: list[str], by: list[str], value: str, rate: float) -> DataFrame:
    """onset and offset: the rise and the fall since the row before, each 0 or more, times ``rate``; 0 at the first."""
    step = (F.col(value) - F.lag(value).over(ordered(key, by))) * rate
    return frame.withColumns({"onset": F.coalesce(F.greatest(step, F.lit(0.0)), F.lit(0.0)), "offset": F.coalesce(F.greatest(-step, F.lit(0.0)), F.lit(0.0))})


def nearest_template(rows: DataFrame, values: str, templates: DataFrame, name: str, template: str, least: int = 4, most: int = 256) -> DataFrame:
    """``rows`` with nearest and distance: the template with the smallest root mean square difference over places that both have, ties by name.

    Null where no template has ``least`` such places in common. ``templates`` has ``most`` rows at most, else it is an error; they travel with the rows.
    """
    held = templates.select(F.col(name).alias("n"), F.col(template).cast("array<double>").alias("t")).limit(most + 1).collect()
    if len(held) > most:
        raise ValueError(f"more than {most} templates")
    kind = templates.schema[name].dataType.simpleString()
    every = F.array(*[F.struct(rmse(F.col(values).cast("array<double>"), F.array(*[F.lit(v) for v in r.t]), least).alias("d"), F.lit(r.n).cast(kind).alias("n")) for r in held]) if held else F.array().cast(f"array<struct<d:double,n:{kind}>>")
    best = F.array_min(F.filter(every, lambda e: e["d"].isNotNull()))
    return rows.withColumn("_best", best).withColumns({"nearest": F.col("_best.n"), "distance": F.col("_best.d")}).drop("_best")


def rime_window(phones: Column, onset: Column, offset: Column, nuclei: list[str], slack: float = 1e-6) -> Column:
    """A struct of start, end and nucleus: from the first phone that may be one to the syllable's end. ``phones`` are structs of on, off, phone in order.

    Null without a nucleus, or if nothing of the syllable is left after it. A nucleus that starts before the syllable is an error.
    """
    first = F.get(F.filter(phones, lambda p: p["phone"].isin(nuclei)), F.lit(0))
    start = F.greatest(first["on"], onset)
    early = F.raise_error(F.concat(F.lit("a nucleus starts before its syllable: "), first["on"].cast("string")))
    window = F.struct(start.alias("start"), offset.cast("double").alias("end"), first["phone"].alias("nucleus"))
    return F.when(first.isNull(), None).when(first["on"] < onset - slack, early.cast("struct<start:double,end:double,nucleus:string>")).when(offset > start + slack, window)


def sampled(events: DataFrame, signal: DataFrame, key: list[str], at: str, sample: str, n: int, last: str) -> DataFrame:
    """``n`` samples from the event on, the place held at the last one there is (``last``): an equi-join on the number of the sample."""
    wanted = events.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(sample, F.greatest(F.lit(1), F.least(F.col(at) + F.col("k"), F.col(last))))
    return wanted.join(signal, [*key, sample])


def segment_stats(frame: DataFrame, key: list[str], at: str, value: str) -> DataFrame:
    """mean, deviation (of the whole), range, max, slope and last less first of the finite values of a segment."""
    x = F.when(finite(F.col(value)), F.col(value))
    t = F.when(x.isNotNull(), F.col(at))
    return frame.groupBy(*key).agg(
        F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), (F.max(x) - F.min(x)).alias("range"), F.max(x).alias("max"),
        F.regr_slope(x, t).alias("slope"), (F.max_by(x, t) - F.min_by(x, t)).alias("change"), F.count(x).alias("n"),
    )


def voiced(value: Column, fill: Column, least: float = 1e-4) -> Column:
    """Whether a value is more than ``least`` from the fill value."""
    return F.coalesce(F.abs(value - fill) > least, F.lit(False))


def fill_value(frame: DataFrame, key: list[str], value: str) -> DataFrame:
    """The most frequent value of a key to 6 places, the smaller on ties: counted before it is chosen."""
    counts = frame.groupBy(*key, F.round(value, 6).alias("fill")).agg(F.count("*").alias("_n"))
    return counts.groupBy(*key).agg(F.max_by("fill", F.struct(F.col("_n"), -F.col("fill"))).alias("fill"))


def interpolated(grid: DataFrame, points: DataFrame, key: list[str], at: str, value: str, most: float) -> DataFrame:
    """``value`` at the places of ``grid`` on the line between the points next to it; null outside the points and where these are more than ``most`` apart."""
    marks = points.groupBy(*key, at).agg(F.avg(value).alias(value)).select(*key, F.col(at).alias("_at"), F.struct(F.col(at).cast("double").alias("t"), F.col(value).alias("v")).alias("_p"), F.lit(False).alias("_asked"))
    asked = grid.select(*key, F.col(at).alias("_at"), F.lit(None).cast(marks.schema["_p"].dataType).alias("_p"), F.lit(True).alias("_asked"))
    up, down = Window.partitionBy(*key).orderBy("_at", "_asked"), Window.partitionBy(*key).orderBy(F.desc("_at"), "_asked")
    run = (Window.unboundedPreceding, Window.currentRow)
    both = marks.unionByName(asked).withColumn("_a", F.last("_p", True).over(up.rowsBetween(*run))).withColumn("_b", F.last("_p", True).over(down.rowsBetween(*run))).where("_asked")
    gap = F.col("_b.t") - F.col("_a.t")
    line = F.when(gap == 0, F.col("_a.v")).when(gap <= most, F.col("_a.v") + (F.col("_at") - F.col("_a.t")) / gap * (F.col("_b.v") - F.col("_a.v")))
    return both.select(*key, F.col("_at").alias(at), line.alias(value))


def rasterised(events: DataFrame, key: list[str], at: Column, n: int) -> DataFrame:
    """key, sample (0 to n - 1), x: 1 where an event falls on a sample, else 0."""
    on = events.select(*key, F.rint(at).cast("int").alias("sample"), F.lit(1).alias("_on")).distinct()
    grid = events.select(*key).distinct().withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return grid.join(on, [*key, "sample"], "left").select(*key, "sample", F.coalesce("_on", F.lit(0)).alias("x"))


def constant_columns(frame: DataFrame, columns: list[str], half: Column) -> DataFrame:
    """column, sd, constant (no spread), fragile (0 throughout one of the halves), kept: statistics of all columns in one pass, then a row for each."""
    x = {c: F.col(c).cast("double") for c in columns}
    stats = frame.agg(*[F.struct(F.stddev_pop(v).alias("sd"), F.max(F.when(half, F.abs(v))).alias("a"), F.max(F.when(~half, F.abs(v))).alias("b")).alias(c) for c, v in x.items()])
    rows = stats.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in columns])).alias("r")).select("r.column", "r.s.*")
    constant, fragile = F.col("sd") < 1e-12, (F.coalesce("a", F.lit(0.0)) == 0) | (F.coalesce("b", F.lit(0.0)) == 0)
    return rows.select("column", "sd", constant.alias("constant"), fragile.alias("fragile"), (~constant & ~fragile).alias("kept"))


def standardised(frame: DataFrame, columns: list[str], least: dict[str, Column] | None = None) -> DataFrame:
    """Columns as z scores over the table; what isn't finite first becomes the least finite value."""
    known = {c: F.when(finite(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    floors = frame.agg(*[F.min(v).alias(f"_f_{c}") for c, v in known.items()])
    filled = frame.join(F.broadcast(floors)).withColumns({c: F.coalesce(v, F.col(f"_f_{c}")) for c, v in known.items()}).drop(*[f"_f_{c}" for c in columns])
    scale = filled.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = {c: F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0) for c in columns}
    return filled.join(F.broadcast(scale)).withColumns(z).drop(*[f"_{n}_{c}" for c in columns for n in "ms"])


def time_correlations(frame: DataFrame, unit: str, key: list[str], at: str, value: str) -> DataFrame:
    """Training time against test time: the correlation over units of the values at both, for each key. A unit has one row for each time, so that its pairs are few."""
    other = frame.select(unit, *key, F.col(at).alias("t_test"), F.col(value).alias("_y"))
    both = frame.withColumnRenamed(at, "t_train").join(other, [unit, *key])
    return both.groupBy(*key, "t_train", "t_test").agg(F.corr(value, "_y").alias("score"), F.count("*").alias("n"))


def diagonal_means(matrix: DataFrame, key: list[str]) -> DataFrame:
    """Mean along each diagonal: lag, score."""
    return matrix.groupBy(*key, (F.col("t_test") - F.col("t_train")).alias("lag")).agg(F.avg("score").alias("score"))


def sustained(matrix: DataFrame, key: list[str], threshold: float) -> DataFrame:
    """Mean number of test times above a threshold, over training times whose own is above; over all if none is."""
    rows = matrix.groupBy(*key, "t_train").agg(F.count_if(F.col("score") > threshold).alias("width"), F.max(F.when(F.col("t_train") == F.col("t_test"), F.col("score"))).alias("own"))
    return rows.groupBy(*key).agg(F.coalesce(F.avg(F.when(F.col("own") > threshold, F.col("width"))), F.avg("width")).alias("width"), F.count_if(F.col("own") > threshold).alias("rows_above"))


def legendre_contours(frame: DataFrame, key: list[str], at: str, value: str, least: int = 4) -> DataFrame:
    """level, slope and bend of each key's finite values: least-squares Legendre coefficients of degree 0 to 2 over the key's span as [-1, 1].

    ``least`` values at three places or more are needed; else the coefficients are null. Two passes
    of sums: the span, then the moments of the place, from which the three equations are solved in closed form.
    """
    span = frame.groupBy(*key).agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    named = span.withColumnsRenamed({k: f"_k_{k}" for k in key})
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key]
    y = F.when(finite(F.col(value)), F.col(value))
    u = F.when(y.isNotNull() & (F.col("_hi") > F.col("_lo")), 2.0 * (F.col(at) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) - 1.0)
    sums = frame.join(named, on).withColumns({"_u": u, "_y": F.when(u.isNotNull(), y)}).groupBy(*key).agg(
        F.count("_u").alias("n"), F.count_distinct("_u").alias("_places"), *[F.avg(F.pow("_u", F.lit(float(k)))).alias(f"_m{k}") for k in (1, 2, 3, 4)],
        F.avg("_y").alias("_y0"), F.avg(F.col("_u") * F.col("_y")).alias("_y1"), F.avg(F.col("_u") * F.col("_u") * F.col("_y")).alias("_y2"),
    )
    m1, m2, m3, m4, y0, y1, y2 = (F.col(c) for c in ("_m1", "_m2", "_m3", "_m4", "_y0", "_y1", "_y2"))
    c11, c12, c22, d1, d2 = m2 - m1 * m1, m3 - m1 * m2, m4 - m2 * m2, y1 - m1 * y0, y2 - m2 * y0
    known = (F.col("n") >= least) & (F.col("_places") >= 3)
    b2 = (c11 * d2 - c12 * d1) / (c11 * c22 - c12 * c12)
    b1 = (d1 - c12 * b2) / c11
    level = y0 - b1 * m1 - b2 * m2 + b2 / 3
    return sums.select(*key, "n", *[F.when(known, c).alias(n) for n, c in (("level", level), ("slope", b1), ("bend", 2 * b2 / 3))])


def helmert_codes(frame: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """code_1 to code_k-1: orthonormal contrasts of a column's ``k`` levels, each against those before it; null for any other value."""
    codes = {}
    for j in range(1, len(levels)):
        size = (j * (j + 1)) ** 0.5
        codes[f"code_{j}"] = F.when(F.col(column).isin(*levels[:j]), 1 / size).when(F.col(column) == levels[j], -j / size).when(F.col(column).isin(*levels), 0.0)
    return frame.withColumns(codes)


def standardised_components(frame: DataFrame, values: str, n: int, out: str = "components") -> DataFrame:
    """``out``: scores of the first ``n`` principal components of an array column, its places standardised, each score with deviation 1.

    From the sums of products (``gram``). The largest loading of a component is positive; a place without spread counts as
    deviation 1, and a component without variance as 0. Null values give null; without rows nothing is fit.
    """
    size, mean, cov = gram(frame, values)
    if size < 2:
        return frame.withColumn(out, F.lit(None).cast("array<double>"))
    cov = cov * size / (size - 1)
    sd = np.sqrt(np.where(np.diag(cov) > 1e-24, np.diag(cov), 1.0))
    power, load = np.linalg.eigh(cov / np.outer(sd, sd))
    power, load = power[::-1][:n], load[:, ::-1][:, :n]
    load = load * np.sign(load[np.abs(load).argmax(axis=0), np.arange(load.shape[1])])
    scale = np.where(power > 1e-12, 1 / np.sqrt(np.maximum(power, 1e-12)), 0.0)
    return frame.withColumn(out, F.when(F.col(values).isNotNull(), apply_filter(F.col(values), mean, load / sd[:, None] * scale)))


def bandpass_taps(rate: float, low: float, high: float, half: int, order: int = 4) -> np.ndarray:
    """Taps -half..half of the zero-phase filter with the squared gain of a Butterworth band-pass."""
    n = 64 * (half + 1)
    f = np.fft.rfftfreq(n, 1 / rate)[1:]
    gain = np.concatenate([[0.0], 1 / (1 + ((f**2 - low * high) / (f * (high - low))) ** (2 * order))])
    return np.roll(np.fft.irfft(gain, n), half)[: 2 * half + 1]


def quadrature_taps(rate: float, low: float, high: float, half: int, order: int = 4) -> np.ndarray:
    """``bandpass_taps`` with every frequency a quarter turn later."""
    n = 64 * (half + 1)
    f = np.fft.rfftfreq(n, 1 / rate)[1:]
    gain = np.concatenate([[0.0], 1 / (1 + ((f**2 - low * high) / (f * (high - low))) ** (2 * order))])
    return np.roll(np.fft.irfft(-1j * gain, n), half)[: 2 * half + 1]


def _overlapping(frame: DataFrame, key: list[str], by: str, value: str, half: int, slice_rows: int) -> DataFrame:
    """``key``, ``by``, _v, _n, _at, _to, _slice: each key's values in order, dealt to slices of ``slice_rows`` places and the ``half`` places at their edges.

    A key is mirrored at both ends, its first and last value repeated; beyond the mirror image, which is as long as the key, there
    is 0. Values that are null or not finite count as 0; rows with a null in key or ``by`` take no part.
    """
    whole = frame.where(" and ".join(f"`{k}` is not null" for k in [*key, by])).select(*key, by, F.when(finite(F.col(value)), F.col(value)).otherwise(0.0).cast("double").alias("_v"))
    at = placed(whole, key, by, F.col("_v"))
    places = F.array(F.col("_at"), -1 - F.col("_at"), 2 * F.col("_n") - 1 - F.col("_at"))
    copies = at.withColumn("_to", F.explode(F.filter(places, lambda p: (p >= -half) & (p < F.col("_n") + half))))
    first = F.greatest(F.lit(0), F.floor((F.col("_to") - half) / slice_rows)).cast("long")
    last = F.least(F.floor((F.col("_n") - 1) / slice_rows), F.floor((F.col("_to") + half) / slice_rows)).cast("long")
    sliced = copies.withColumn("_slice", F.explode(F.sequence(first, last)))
    return sliced.where((F.col("_to") >= F.col("_slice") * slice_rows - half) & (F.col("_to") < (F.col("_slice") + 1) * slice_rows + half))


def convolved(frame: DataFrame, key: list[str], by: str, value: str, taps: dict[str, np.ndarray], slice_rows: int = 4096) -> DataFrame:
    """``key``, ``by`` and a column for each of ``taps``, odd numbers of which all have as many: each key's values in order of ``by``, an even raster, under each filter.

    Ends and odd values are those of ``_overlapping``; a task never holds a whole key.
    """
    half = len(next(iter(taps.values()))) // 2
    kinds = {f.name: f.dataType.simpleString() for f in frame.schema}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        start = int(rows["_slice"].iloc[0]) * slice_rows
        end = min(start + slice_rows, int(rows["_n"].iloc[0]))
        line = np.zeros(end - start + 2 * half)
        line[rows["_to"].to_numpy() - start + half] = rows["_v"]
        own = rows[(rows["_to"] == rows["_at"]) & (rows["_at"] >= start) & (rows["_at"] < end)]
        return own[[*key, by]].assign(**{name: np.convolve(line, t, "valid")[own["_at"].to_numpy() - start] for name, t in taps.items()})

    schema = ", ".join([f"`{k}` {kinds[k]}" for k in [*key, by]] + [f"`{name}` double" for name in taps])
    return _overlapping(frame, key, by, value, half, slice_rows).groupBy(*key, "_slice").applyInPandas(run, schema)


def bandpass(frame: DataFrame, key: list[str], by: str, value: str, taps: np.ndarray, slice_rows: int = 4096, out: str = "filtered") -> DataFrame:
    """``key``, ``by`` and ``out``: each key's values under a symmetric filter, as ``convolved``."""
    return convolved(frame, key, by, value, {out: taps}, slice_rows)


def envelope(frame: DataFrame, key: list[str], by: str, value: str, taps: np.ndarray, quadrature: np.ndarray, slice_rows: int = 4096, compress: bool = False) -> DataFrame:
    """``key``, ``by``, ``envelope``: the size of a band of each key's values, from a pair of filters a quarter turn apart, both in one pass.

    ``compress`` takes log(1 + x) of it.
    """
    pair = convolved(frame, key, by, value, {"_a": taps, "_b": quadrature}, slice_rows)
    size = F.sqrt(F.col("_a") * F.col("_a") + F.col("_b") * F.col("_b"))
    return pair.select(*key, by, (F.log1p(size) if compress else size).alias("envelope"))


def resample_taps(up: int, down: int, zeros: int = 10) -> np.ndarray:
    """A low pass at the lower of both rates, on the raster of ``up`` times the first: a windowed sinc of ``zeros`` zeros a side, with sum ``up``."""
    wide = max(up, down)
    at = np.arange(-zeros * wide, zeros * wide + 1)
    return up * np.sinc(at / wide) / wide * np.hamming(len(at))


def resampled(frame: DataFrame, key: list[str], by: str, value: str, up: int, down: int, taps: np.ndarray, slice_rows: int = 4096) -> DataFrame:
    """``key``, place (from 0), resampled: each key's values, an even raster in order of ``by``, at ``up`` / ``down`` times their rate.

    Output k stands at input k down / up and is the sum of inputs j times the tap at k down - j up: the phases of one filter, without the zeros between inputs
    or outputs that nobody asks for. Beyond the ends there is 0, and values that are null or not finite count as 0. There are ceil(n up / down) outputs. Inputs
    are dealt to slices of outputs with what these need beside them, so that a task never holds a whole key.
    """
    half = len(taps) // 2
    kinds = {f.name: f.dataType.simpleString() for f in frame.schema}
    whole = frame.where(" and ".join(f"`{k}` is not null" for k in [*key, by])).select(*key, by, F.when(finite(F.col(value)), F.col(value)).otherwise(0.0).cast("double").alias("_v"))
    at = placed(whole, key, by, F.col("_v")).withColumn("_m", F.ceil(F.col("_n") * up / down))
    first = F.greatest(F.lit(0), F.floor(F.ceil((F.col("_at") * up - half) / down) / slice_rows))
    last = F.least(F.floor((F.col("_m") - 1) / slice_rows), F.floor(F.floor((F.col("_at") * up + half) / down) / slice_rows))
    sliced = at.withColumn("_slice", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<long>"))))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        start = int(rows["_slice"].iloc[0]) * slice_rows
        k = np.arange(start, min(start + slice_rows, int(rows["_m"].iloc[0])))
        low = -((half - k * down) // up)  # the first input that a tap of k reaches
        inputs = low[:, None] + np.arange(2 * half // up + 2)
        tap = k[:, None] * down - inputs * up + half
        base = int(inputs.min())
        line = np.zeros(int(inputs.max()) - base + 1)
        here = rows["_at"].to_numpy() - base
        some = (here >= 0) & (here < len(line))
        line[here[some]] = rows["_v"].to_numpy()[some]
        values = np.where((tap >= 0) & (tap < len(taps)), line[inputs - base] * taps[np.clip(tap, 0, len(taps) - 1)], 0.0).sum(axis=1)
        return pd.DataFrame({**{name: rows[name].iloc[0] for name in key}, "place": k, "resampled": values})

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in key) + ", place long, resampled double"
    return sliced.groupBy(*key, "_slice").applyInPandas(run, schema)


def window_components(frame: DataFrame, values: str, windows: int, out: str = "component") -> DataFrame:
    """``out``: an array of ``windows`` equal stretches, one after the other, as the scores of its places on the first component over the stretches.

    Scores have deviation 1 over the places; the largest loading is positive. A row is solved by itself, in Arrow batches. Null
    values, another length than a multiple of ``windows``, and stretches without spread give null.
    """

    def component(rows: pd.Series) -> pd.Series:
        found = []
        for v in rows:
            x = np.asarray(v if v is not None else [], float)
            if not len(x) or len(x) % windows or not np.isfinite(x).all():
                found.append(None)
                continue
            x = x.reshape(windows, -1).T
            x = x - x.mean(axis=0)
            _, power, turn = np.linalg.svd(x, full_matrices=False)
            score = x @ (turn[0] * np.sign(turn[0][np.abs(turn[0]).argmax()]))
            found.append((score * np.sqrt(len(x) - 1) / power[0]).tolist() if len(x) > 1 and power[0] > 1e-12 else None)
        return pd.Series(found)

    return frame.withColumn(out, F.pandas_udf(component, "array<double>")(F.col(values).cast("array<double>")))
