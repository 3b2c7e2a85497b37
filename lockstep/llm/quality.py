"""Quality classifier: a sparse rule ensemble over text statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_slices, utf8

STATISTICS = (
    "n_bytes", "n_words", "word_bytes", "longest_word", "upper", "digits", "stops", "symbols", "spaces", "newlines", "beyond_ascii",
    "distinct_words", "common_word", "distinct_lines", "line_words", "ended_lines", "cased_words", "symbol_words",
)
_CLASS = np.zeros(256, np.int64)
for _chars, _k in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b".,;:?'\"-()", 3), (b"!#$%&*+/<=>@[\\]^_`{|}~", 4), (b" \t", 5), (b"\n", 6)):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 7
_SYMBOLS = frozenset(b"!#$%&*+/<=>@[\\]^_`{|}~")


def text_statistics(text: bytes) -> tuple[float, ...]:
    """``STATISTICS`` of a UTF-8 text; shares are of its bytes, words or lines, and all are 0 for an empty one."""
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    n, w, m = max(1, len(text)), max(1, len(words)), max(1, len(lines))
    by_class = np.zeros(8)
    for at in range(0, len(text), 1 << 20):
        counts = np.bincount(np.frombuffer(text, np.uint8, min(1 << 20, len(text) - at), at), minlength=256)
        by_class += np.bincount(_CLASS, counts, 8)
    counted = Counter(words)
    return (
        float(len(text)), float(len(words)), sum(map(len, words)) / w, float(max(map(len, words), default=0)),
        *(by_class[1:] / n).tolist(),
        len(counted) / w, max(counted.values(), default=0) / w, len(set(lines)) / m if lines else 0.0, len(words) / m,
        sum(x.rstrip()[-1:] in b".!?" for x in lines) / m,
        sum(k for x, k in counted.items() if x.isupper() and len(x) > 1) / w, sum(k for x, k in counted.items() if x[-1] in _SYMBOLS) / w,
    )


def with_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and a double column for each of ``STATISTICS``, from whole texts."""
    schema = ", ".join([f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"{s} double" for s in STATISTICS])

    def run(batch: pa.RecordBatch) -> Iterator[list]:
        for part in text_slices(batch, "text"):
            values = np.array([text_statistics(t) for t in utf8(part.column("text"))]).reshape(-1, len(STATISTICS))
            yield [*(part.column(c) for c in keep), *(pa.array(np.ascontiguousarray(v)) for v in values.T)]

    return map_batches(docs.select(*dict.fromkeys([*keep, "text"])), schema, run)


Condition = tuple[int, bool, float]  # statistic, whether above (else at most), threshold


@dataclass(frozen=True)
class RuleEnsemble:
    """Rules with weights: the score is the logistic function of the bias and the weights of the rules that hold."""

    bias: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]

    def score(self) -> Column:
        """The score as a Spark expression over the columns of ``STATISTICS``."""
        total = F.lit(self.bias)
        for conditions, weight in self.rules:
            holds = F.lit(True)
            for k, above, at in conditions:
                holds = holds & ((F.col(STATISTICS[k]) > F.lit(at)) if above else (F.col(STATISTICS[k]) <= F.lit(at)))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def tree_rules(x: np.ndarray, y: np.ndarray, depth: int, columns: np.ndarray, least: int = 8) -> list[tuple[Condition, ...]]:
    """The path to each node below the root of one tree, grown by Gini impurity on thresholds at quantiles."""
    rules: list[tuple[Condition, ...]] = []

    def grow(rows: np.ndarray, path: tuple[Condition, ...]) -> None:
        if len(path) >= depth or len(rows) < 2 * least or y[rows].min() == y[rows].max():
            return
        n, best = len(rows), None
        whole = y[rows].mean()
        for k in columns:
            v = x[rows, k]
            cuts = np.unique(np.quantile(v, np.linspace(0.02, 0.98, 25), method="lower"))
            order = np.argsort(v, kind="stable")
            left = np.searchsorted(v[order], cuts, side="right")
            ones = np.r_[0, np.cumsum(y[rows][order])]
            ok = (left >= least) & (n - left >= least)
            if ok.any():
                left, cuts = left[ok], cuts[ok]
                p, q = ones[left] / left, (ones[-1] - ones[left]) / (n - left)
                gain = whole * (1 - whole) - (left * p * (1 - p) + (n - left) * q * (1 - q)) / n
                if best is None or gain.max() > best[0] + 1e-12:
                    best = (gain.max(), int(k), float(cuts[gain.argmax()]))
        if best is None or best[0] < 1e-6:
            return
        _, k, at = best
        for above in (False, True):
            rules.append((*path, (k, above, at)))
            grow(rows[(x[rows, k] > at) == above], rules[-1])

    grow(np.arange(len(x)), ())
    return rules


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Bias and weights of an L1-penalised logistic regression, by accelerated proximal gradient."""
    n, m = z.shape
    center = z.mean(axis=0)
    scale = np.maximum(z.std(axis=0), 1e-3)
    z = (z - center) / scale
    step = 4.0 / (np.linalg.norm(z, 2) ** 2 / n + 1)
    w, b = np.zeros(m), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    v, c, t = w, b, 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-np.clip(z @ v + c, -30, 30))) - y
        w2 = v - step * (z.T @ error) / n
        w2 = np.sign(w2) * np.maximum(0, np.abs(w2) - step * penalty)
        b2 = c - step * error.mean()
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return float(b - (w / scale * center).sum()), w / scale


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 0.002, seed: int = 7) -> RuleEnsemble:
    """Rules from trees on random halves of rows and statistics, weighted by a lasso logistic regression.

    Without rows the score is 0.5; with one class only it is that class's share, smoothed.
    """
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return RuleEnsemble(float(np.log(share / (1 - share))), ())
    rng, rules = np.random.default_rng(seed), {}
    for _ in range(trees):
        rows = rng.choice(len(y), min(len(y), max(64, min(4000, len(y) // 2))), replace=False)
        columns = np.sort(rng.choice(x.shape[1], x.shape[1] // 2, replace=False))
        rules |= dict.fromkeys(tree_rules(x[rows], y[rows], depth, columns))
    held = {rule: np.all([(x[:, k] > at) == above for k, above, at in rule], axis=0) for rule in rules}
    distinct = {h.tobytes(): rule for rule, h in reversed(held.items()) if 0 < h.mean() < 1}
    chosen = list(distinct.values())[::-1]
    if not chosen:
        return fit_rules(x, y[:0])
    bias, weights = lasso_logistic(np.column_stack([held[r] for r in chosen]).astype(float), y.astype(float), penalty)
    return RuleEnsemble(bias, tuple((r, float(w)) for r, w in zip(chosen, weights, strict=True) if abs(w) > 1e-6))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the doc_id as text, modulo ``folds``; null for a null doc_id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, folds: int = 5, held_out: int = 0) -> RuleEnsemble:
    """Fit on labelled rows whose fold is not ``held_out``: at most ``max_rows`` of them, those with the smallest hash of doc_id.

    The number of labels gives a level of the hash that twice as many pass, so that only those are sorted. The bound makes the label rows safe to broadcast and their statistics safe to gather. Rows with a null
    doc_id or quality are left out; of several labels of a document each counts, and of several texts of a doc_id the smallest.
    """
    usable = labels.where("doc_id is not null and quality is not null").where(fold(F.col("doc_id"), folds) != held_out)
    digest, n = F.md5(F.col("doc_id").cast("string").cast("binary")), usable.count()
    few = usable.where(F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 2.0**32 * n <= 2 * max_rows)
    some = few.select("doc_id", F.col("quality").cast("double").alias("_label")).orderBy(digest, "doc_id", "_label").limit(max_rows)
    once = docs.select("doc_id", "text").join(F.broadcast(some.select("doc_id").distinct()), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    joined = once.join(F.broadcast(some), "doc_id")
    rows = sorted(tuple(r) for r in with_statistics(joined, "doc_id", "_label").collect())
    data = np.array(rows, float).reshape(-1, 2 + len(STATISTICS))
    return fit_rules(data[:, 2:], (data[:, 1] > 0).astype(int))


def score_quality(docs: DataFrame, model: RuleEnsemble, *keep: str) -> DataFrame:
    """``keep`` columns and ``score`` (0 to 1) of each whole text.

    Null and empty texts get the score of their statistics, all 0; repeated rows come out as often; other
    columns are ignored; an empty table gives no rows. A kept column may have the name of a statistic, but not ``score``.
    """
    if "score" in keep:
        raise ValueError("a column named score can't be kept beside the new one")
    held = docs.select(F.col("text").alias("text"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_kept"))
    scored = with_statistics(held, "_kept").withColumn("_score", model.score())
    return scored.select(*[F.col("_kept").getField(c).alias(c) for c in keep], F.col("_score").alias("score"))
