"""A basis of feature families: drift out by section, components of each family, one after the other or each by itself, as a table that other rows are put through."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dense import _flat, block_sums
from .signals import gram

#: Rows of a section that go through its drift together.
SLICE = 256


def _with_drift(frame: DataFrame, section: str, onset: str, families: dict[str, str], bumps: int) -> DataFrame:
    """participant 0, section, x (the drift basis of the row) and y (all families): a constant and ``bumps`` Gaussian bumps over the section's span of onsets."""
    span = frame.groupBy(section).agg(F.min(onset).alias("_lo"), F.max(onset).alias("_hi"))
    width = F.when(F.col("_hi") > F.col("_lo"), (F.col("_hi") - F.col("_lo")) / (bumps - 1)).otherwise(1.0)
    bump = lambda k: F.exp(-0.5 * F.pow((F.col(onset) - (F.col("_lo") + k * width)) / width, F.lit(2)))
    basis = F.concat(F.array(F.lit(1.0)), F.transform(F.sequence(F.lit(0), F.lit(bumps - 1)), bump)) if bumps > 1 else F.array(F.lit(1.0))
    values = F.concat(*[F.col(c).cast("array<double>") for c in families.values()])
    known = frame.where(" and ".join(f"`{c}` is not null" for c in (section, onset, *families.values())))
    return known.join(span, section).withColumns({"_x": basis, "_y": values}).drop("_lo", "_hi")


def _solved(products: np.ndarray, p: int) -> np.ndarray:
    """Weights of the drift (p x width), least squares of smallest norm."""
    return np.linalg.pinv(products[:p, :p], rcond=1e-10, hermitian=True) @ products[:p, p:]


def _drift_weights(sums: DataFrame, section: str, kind: str) -> DataFrame:
    """section, _w: drift weights one row after the other, and _r: n and the products of what the drift leaves."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in rows.itertuples(index=False):
            p, flat = int(r.p), np.asarray(r.sums, float)
            width = round((-1 + (1 + 4 * (len(flat) - 1)) ** 0.5) / 2)
            products = flat[1 + width :].reshape(width, width)
            w = _solved(products, p)
            rest = products[p:, p:] - w.T @ products[:p, p:]
            out.append((getattr(r, section), w.ravel(), np.r_[flat[0], rest.ravel()]))
        return pd.DataFrame(out, columns=[section, "_w", "_r"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield solve(part)

    return sums.select(section, "p", "sums").mapInPandas(run, f"`{section}` {kind}, _w array<double>, _r array<double>")


def drift_residuals(frame: DataFrame, section: str, onset: str, families: dict[str, str], bumps: int = 40) -> DataFrame:
    """``frame`` with ``residual``: all families, one after the other, less what slow drift explains of each column within the section.

    The weights of a section come from its sums of products; slices of a section's rows meet them, so that a long section is many tasks. A
    section without a span, or with fewer rows than bumps, is fit by least squares of smallest norm. Rows with a null onset, section or family are left out.
    """
    rows = _with_drift(frame, section, onset, families, bumps)
    kind = frame.schema[section].dataType.simpleString()
    weights = _drift_weights(block_sums(rows.select(section, F.col("_x").alias("x"), F.col("_y").alias("y")), [section]), section, kind).drop("_r")
    parts = rows.join(rows.groupBy(section).agg(F.ceil(F.count("*") / SLICE).alias("_n")), section)
    packed = parts.withColumn("_slice", F.pmod(F.xxhash64(onset, "_y"), F.col("_n"))).groupBy(section, "_slice").agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in frame.columns], "_x", "_y")).alias("_rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                inner = batch.column("_rows").slice(k, 1).flatten()
                x, y = (inner.field(c).flatten().to_numpy(zero_copy_only=False).reshape(len(inner), -1) for c in ("_x", "_y"))
                rest = y - x @ batch.column("_w")[k].values.to_numpy().reshape(x.shape[1], -1)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(inner) + 1, dtype=np.int32) * rest.shape[1]), pa.array(rest.ravel()))
                yield pa.RecordBatch.from_arrays([*(inner.field(c) for c in names), flat], names=[*names, "residual"])

    names = frame.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)
    return packed.join(weights, section).select("_rows", "_w").mapInArrow(run, f"{schema}, residual array<double>")


def fit_basis(frame: DataFrame, section: str, onset: str, families: dict[str, str], k: int, ordered: bool = True, bumps: int = 40) -> DataFrame:
    """family, component, eigenvalue, n, widths, weights: what turns drift-free rows into at most ``k`` whitened components of each family.

    Drift is swept out section by section, and what it leaves of all families is one matrix of products, added up by Spark; its size is the square of
    the families' widths. ``ordered``: each family is freed of the components of those before it, and the remainder is standardised, turned into its
    components and whitened, so that components of different families don't correlate. Otherwise each family is by itself. A column without
    variance has scale 1; components without variance are left out. The table is the model: ``put_through`` needs nothing else.
    """
    rows = _with_drift(frame, section, onset, families, bumps)
    kind = frame.schema[section].dataType.simpleString()
    sums = block_sums(rows.select(section, F.col("_x").alias("x"), F.col("_y").alias("y")), [section])
    left = _drift_weights(sums, section, kind).select(F.posexplode("_r").alias("i", "v"))
    flat = np.array([r.v for r in left.groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()])
    sizes = frame.where(" and ".join(f"`{c}` is not null" for c in families.values())).select(*[F.size(c) for c in families.values()]).first()
    if not len(flat) or sizes is None:
        return frame.sparkSession.createDataFrame([], BASIS)
    n, products = flat[0], flat[1:].reshape(sum(sizes), sum(sizes))
    ends = np.cumsum(sizes)
    before, out = np.zeros((len(products), 0)), []
    for f, (name, width, end) in enumerate(zip(families, sizes, ends, strict=True)):
        turn = np.eye(len(products))[:, end - width : end]
        if ordered and before.shape[1]:
            turn = turn - before @ np.linalg.lstsq(before.T @ products @ before, before.T @ products @ turn, rcond=None)[0]
        scale = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", turn, products, turn), 0) / max(n - 1, 1))
        turn = turn / np.where(scale > 1e-10, scale, 1.0)
        values, vectors = np.linalg.eigh(turn.T @ products @ turn / max(n - 1, 1))
        values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
        some = values > 1e-10 * max(values.max(initial=0), 1e-30)
        weights = (turn @ vectors / np.sqrt(np.where(some, values, 1)))[:, some]
        before = np.hstack([before, weights])
        out += [(name, f, c, float(v), int(n), [int(s) for s in sizes], [float(x) for x in w]) for c, (v, w) in enumerate(zip(values[some], weights.T, strict=True))]
    return frame.sparkSession.createDataFrame(out, BASIS)


BASIS = "family string, family_no int, component int, eigenvalue double, n long, widths array<int>, weights array<double>"


def read_basis(spark: SparkSession, path: str, families: list[str], k: int) -> DataFrame:
    """A stored basis cut to ``k`` components; other families than those it was fit on, or fewer components, are an error."""
    found = spark.read.schema(BASIS).parquet(path)
    held = {r.family: (r.family_no, r.n) for r in found.groupBy("family", "family_no").agg(F.count("*").alias("n")).collect()}
    if [f for f, _ in sorted(held.items(), key=lambda x: x[1][0])] != families:
        raise ValueError(f"the basis is of {sorted(held)}, not of {families}")
    if short := [f for f, (_, n) in held.items() if n < k]:
        raise ValueError(f"fewer than {k} components of {short}")
    return found.where(F.col("component") < k)


def put_through(rows: DataFrame, values: str, basis: DataFrame, out: str = "z") -> DataFrame:
    """``rows`` with ``out``: the components of their array ``values``, families in their order. The basis is as many rows as it has components.

    Null arrays, and arrays of another width, stay null.
    """
    weights = np.array([r.weights for r in basis.orderBy("family_no", "component").select("weights").collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(values)
            ok = np.asarray(x.value_lengths().fill_null(-1)) == weights.shape[1]
            z = x.filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).reshape(-1, weights.shape[1]) @ weights.T
            lists = iter(z.tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([next(lists) if o else None for o in ok], pa.list_(pa.float64()))], names=[*batch.schema.names, out])

    if not len(weights):
        return rows.withColumn(out, F.lit(None).cast("array<double>"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, `{out}` array<double>")


def canonical_correlations(frame: DataFrame, a: str, b: str) -> np.ndarray:
    """Canonical correlations of two array columns, largest first: singular values of their products whitened by Cholesky factors.

    One pass for the products of both; directions without variance are left out. Rows where either is null are left out.
    """
    known = frame.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    first = known.select(F.size(a)).first()
    if first is None:
        return np.zeros(0)
    p = first[0]
    _, _, cov = gram(known.select(F.concat(F.col(a).cast("array<double>"), F.col(b).cast("array<double>")).alias("_v")), "_v")
    white = [_whitened(cov[s, s]) for s in (slice(0, p), slice(p, None))]
    return np.minimum(np.linalg.svd(white[0].T @ cov[:p, p:] @ white[1], compute_uv=False), 1.0)


def _whitened(cov: np.ndarray) -> np.ndarray:
    """Columns that make ``cov`` the identity; by a Cholesky factor where it has one, else by what eigenvalues it has."""
    try:
        return np.linalg.inv(np.linalg.cholesky(cov)).T
    except np.linalg.LinAlgError:
        values, vectors = np.linalg.eigh(cov)
        some = values > 1e-12 * max(values.max(initial=0), 1e-300)
        return vectors[:, some] / np.sqrt(values[some])


def sketched_components(frame: DataFrame, values: str, n: int, extra: int = 10, passes: int = 4, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, loadings (a column for each of the ``n`` leading components) and variances, for widths whose square no machine holds.

    A random sketch of ``n`` + ``extra`` columns, the same in every run, goes ``passes`` times through the rows: each task adds up its rows' products with what the
    rows make of the sketch, width x columns numbers, and between passes the sketch is made orthonormal. The last pass gives a small
    system of as many columns, whose eigenvectors turn the sketch into components. The largest weight of each is positive.
    """
    known = frame.where(F.col(values).isNotNull()).select(values)
    first = known.select(F.size(values)).first()
    if first is None:
        return np.zeros(0), np.zeros((0, 0)), np.zeros(0)
    width = first[0]
    columns = min(n + extra, width)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, columns)))[0]

    def products(q: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        shared = known.sparkSession.sparkContext.broadcast(q)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count, total, out = 0.0, np.zeros(width), np.zeros((width, columns))
            for batch in batches:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
                count, total = count + len(x), total + x.sum(axis=0)
                out += x.T @ (x @ shared.value)
            if count:
                flat = np.r_[count, total, out.ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["i", "v"])

        flat = np.asarray(_flat(known.mapInArrow(run, "i int, v double").withColumn("_one", F.lit(1)), ["_one"]).first()["sums"], float)
        shared.destroy()
        return flat[0], flat[1 : 1 + width], flat[1 + width :].reshape(width, columns)

    for _ in range(passes):
        count, total, out = products(q)
        mean = total / count
        out = out / count - np.outer(mean, mean @ q)
        small, last = q.T @ out, q
        q = np.linalg.qr(out)[0]
    power, turn = np.linalg.eigh((small + small.T) / 2)
    load = (last @ turn)[:, ::-1][:, :n]
    return mean, load * np.sign(load[np.abs(load).argmax(axis=0), np.arange(load.shape[1])]), power[::-1][:n]
