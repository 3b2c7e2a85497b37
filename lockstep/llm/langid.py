"""Language identification by nearest centroids of TF-IDF n-gram vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, stored, text_slices
from .quality import fold

DIMS = 4096
_LETTERS = bytes(i if i >= 128 or chr(i).isalpha() else 32 for i in range(256))


def gram_counts(text: str) -> np.ndarray:
    """Hashed counts of the 2- and 3-byte grams of a lower-case text, anything but letters taken as space."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace").translate(_LETTERS), np.uint8)
    out = np.zeros(DIMS, np.int64)
    for at in range(0, max(1, len(raw)), 1 << 20):
        x = raw[max(0, at - 2) : at + (1 << 20)].astype(np.uint32)
        two = x[:-1] << 8 | x[1:]
        three = two[:-1] << 8 | x[2:]
        for gram in (two[1 if at else 0 :], three):
            if len(gram):
                out += np.bincount((gram * np.uint32(2654435761)) >> np.uint32(20), minlength=DIMS)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def spherical_means(x: np.ndarray, k: int, rounds: int = 20, seed: int = 3) -> np.ndarray:
    """At most k unit centroids of the unit rows of x."""
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        nearest = (x @ centers.T).argmax(axis=1)
        centers = _unit(np.stack([x[nearest == j].mean(axis=0) if (nearest == j).any() else centers[j] for j in range(len(centers))]))
    return centers


@dataclass(frozen=True)
class CentroidModel:
    """idf, unit centroids, the language of each, and the least cosine at which each accepts a text."""

    idf: np.ndarray
    centers: np.ndarray
    langs: tuple[str, ...]
    least: np.ndarray

    def predict(self, counts: np.ndarray) -> tuple[list[str | None], np.ndarray, np.ndarray]:
        """Nearest language, cosine and whether it is accepted, for rows of counts."""
        if not self.langs:
            return [None] * len(counts), np.zeros(len(counts)), np.zeros(len(counts), bool)
        near = _unit(np.sqrt(counts.astype(np.float32)) * self.idf) @ self.centers.T
        at = near.argmax(axis=1)
        best = near[np.arange(len(near)), at].astype(float)
        return [self.langs[i] for i in at], np.clip(best, 0, 1), best >= self.least[at]


def fit_centroids(counts: np.ndarray, langs: list[str], per_lang: int = 4, quantile: float = 0.005) -> CentroidModel:
    """``per_lang`` centroids for each language; each rejects what is farther than all but ``quantile`` of its own rows."""
    if not len(langs):
        return CentroidModel(np.zeros(DIMS, np.float32), np.zeros((0, DIMS), np.float32), (), np.zeros(0))
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    x = _unit(np.sqrt(counts.astype(np.float32)) * idf).astype(np.float32)
    centers, owners, least = [], [], []
    for lang in sorted(set(langs)):
        mine = x[np.array(langs) == lang]
        c = spherical_means(mine, per_lang)
        near = mine @ c.T
        for j in range(len(c)):
            own = near[near.argmax(axis=1) == j, j]
            least.append(float(np.quantile(own, quantile)) - 0.02 if len(own) else 1.0)
        centers.append(c)
        owners += [lang] * len(c)
    return CentroidModel(idf, np.concatenate(centers).astype(np.float32), tuple(owners), np.array(least))


def fit_languages(docs: DataFrame, rows_per_lang: int = 256, folds: int = 4, held_out: int = 2, per_lang: int = 4, most_langs: int = 512) -> CentroidModel:
    """Fit on at most ``rows_per_lang`` documents of each language outside the held-out fold, those with the smallest hash of doc_id.

    The ids are chosen first, without their texts, and each counts once, however often it is repeated: counts per language give a level of the hash
    that about four times as many pass, so that only those are ranked, however large a language is. Of the rows of an id in a language the text with
    the smallest hash is taken. The bounds make the ids safe to broadcast and their vectors (16 KB each) safe to gather; more than
    ``most_langs`` languages are an error. Rows with a null doc_id, text or lang are left out.
    """
    usable = docs.where("doc_id is not null and lang is not null and text is not null").where(fold(F.col("doc_id"), folds) != held_out)
    ids = usable.select("doc_id", "lang").distinct()
    counts = stored(ids.groupBy("lang").agg(F.count("*").alias("_of")))
    if counts.count() > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    digest = F.md5(F.col("doc_id").cast("string").cast("binary"))
    few = ids.join(counts, "lang").where(F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 2.0**32 * F.col("_of") <= 4 * rows_per_lang)
    order = Window.partitionBy("lang").orderBy(digest, "doc_id")
    some = few.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= rows_per_lang).drop("_n", "_of")
    joined = usable.select("doc_id", "lang", "text").join(F.broadcast(some), ["doc_id", "lang"])
    one = joined.groupBy("doc_id", "lang").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("_t")).select("doc_id", "lang", "_t.text")

    def run(batch: pa.RecordBatch) -> Iterator[list]:
        for part in text_slices(batch, "text", 4 << 20):
            packed = [gram_counts(t).astype("<u4").tobytes() for t in part.column("text").to_pylist()]
            yield [part.column("doc_id").cast(pa.int64()), part.column("lang"), pa.array(packed, pa.binary())]

    rows = sorted((r.lang, r.doc_id, bytes(r.counts)) for r in map_batches(one, "doc_id long, lang string, counts binary", run).collect())
    counts = np.array([np.frombuffer(c, "<u4") for *_, c in rows]).reshape(-1, DIMS)
    return fit_centroids(counts, [lang for lang, *_ in rows], per_lang)


def identify(docs: DataFrame, model: CentroidModel) -> DataFrame:
    """doc_id, lang_near (nearest learned language), score (its cosine, 0 to 1), accepted, lang (``und`` if not accepted) for each whole text.

    A text that is null or has no letter is ``und`` with score 0. Repeated rows come out as often; other columns
    are ignored; an empty table gives no rows.
    """

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> Iterator[list]:
        for part in text_slices(batch, "text", 4 << 20):
            for at in range(0, part.num_rows, 512):
                few = part.slice(at, 512)
                texts = few.column("text").to_pylist()
                letters = few.column("letters").to_pylist()
                langs, scores, accepted = shared.value.predict(np.stack([gram_counts(t or "") for t in texts]))
                near = [lang if has and lang else "und" for lang, has in zip(langs, letters, strict=True)]
                ok = [bool(a and x != "und") for a, x in zip(accepted, near, strict=True)]
                yield [few.column("doc_id"), pa.array(near), pa.array([s if x != "und" else 0.0 for s, x in zip(scores.tolist(), near, strict=True)]), pa.array(ok)]

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    found = map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", letters), "doc_id long, lang_near string, score double, accepted boolean", run)
    return found.withColumn("lang", F.when(F.col("accepted"), F.col("lang_near")).otherwise("und"))
