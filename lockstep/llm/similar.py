"""Near-duplicates by the Jaccard similarity of word shingles: banded MinHash for candidates, exact sets to decide."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bits import key_bits, marked, maybe_in
from .common import map_batches, scratch, stored, text_slices, utf8
from .components import connected_components
from .simhash import fingerprint, fingerprint_links

#: A pair at similarity s shares a band with probability 1 - (1 - s ** ROWS) ** BANDS: 0.9999 at 0.8.
BANDS, ROWS = 24, 5
_RANDOM = np.random.default_rng(20240607).integers(0, 1 << 63, (3, BANDS * ROWS), dtype=np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(words: list[bytes], shingle: int = 5, seed: int = 42) -> np.ndarray:
    """Hashes of the different shingles, sorted; all words are one shingle if they are fewer."""
    grams = map(b" ".join, zip(*[words[k:] for k in range(shingle)], strict=False)) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in grams), np.uint64))


def bands_of(shingles: np.ndarray) -> np.ndarray:
    """One key for each band of ``ROWS`` least hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 4096):
        least = np.minimum(least, (shingles[at : at + 4096] * _RANDOM[0][:, None] + _RANDOM[1][:, None]).min(axis=1))
    keys = ((least ^ (least >> np.uint64(32))) * _RANDOM[2]).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64)
    return (keys ^ (keys >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


def _node(words: list[bytes]) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(words), 7)).view(np.int64))


def sketches(docs: DataFrame, shingle: int, seed: int) -> DataFrame:
    """doc_id, fp (SimHash), node (hash of the words in lower case), bands of every row; without a word, node and bands are null."""

    def run(batch: pa.RecordBatch) -> Iterator[list]:
        for part in text_slices(batch, "text", 4 << 20):
            fps, nodes, bands = [], [], []
            for text in utf8(part.column("text")):
                words = text.lower().split()
                fps.append(fingerprint(text, shingle, seed))
                nodes.append(_node(words) if words else None)
                bands.append(bands_of(shingle_set(words, shingle, seed)).view(np.int64) if words else None)
            yield [part.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(nodes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id long, fp long, node long, bands array<long>", run)


def spanning_pairs(sets: list[np.ndarray], least: float = 0.8) -> list[tuple[int, int]]:
    """(member, root) numbers that join what is connected at a similarity of ``least``.

    A search spreads through the members not reached yet: a dense group costs about one pass, never all pairs.
    """
    share = Fraction(least).limit_denominator(1000)
    sizes = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    own = np.split(ids, np.cumsum(sizes)[:-1])
    marked, alive, out = np.zeros(ids.max() + 1, bool), np.ones(len(sets), bool), []
    members, flat, starts = np.arange(len(sets)), ids, np.cumsum(sizes) - sizes
    for root in range(len(sets)):
        if not alive[root]:
            continue
        alive[root], queue = False, [root]
        while queue and alive.any():
            if 2 * alive.sum() < len(members):
                members = np.flatnonzero(alive)
                flat, starts = np.concatenate([own[m] for m in members]), np.cumsum(sizes[members]) - sizes[members]
            at = queue.pop()
            marked[own[at]] = True
            both = np.add.reduceat(marked[flat].astype(np.int64), starts)
            marked[own[at]] = False
            near = members[alive[members] & (both * share.denominator >= share.numerator * (sizes[members] + sizes[at] - both))]
            alive[near] = False
            queue += near.tolist()
            out += [(m, root) for m in near.tolist()]
    return out


def similar_links(docs: DataFrame, sketched: DataFrame, shingle: int = 5, least: float = 0.8, seed: int = 42, keep: Callable[..., DataFrame] = stored) -> DataFrame:
    """Links (src, dst) between fingerprints of texts with a Jaccard similarity of ``least`` or more that share a band.

    Texts with the same words are one node. Only texts in a band with other fingerprints are read again, for their
    sets. One band is read by one task, as different texts; it is searched without forming all pairs.
    Rows without a doc_id are left out. ``keep`` writes the tables on the way.
    """
    nodes = keep(sketched.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("fp").alias("fp"), F.first("bands").alias("bands")))
    spread = nodes.select("node", "fp", F.posexplode("bands").alias("k", "band"))
    shared = spread.groupBy("k", "band").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high").select("k", "band")
    shared = keep(shared)
    asked = keep(maybe_in(spread, key_bits(shared, "k", "band", a_key=64), "k", "band").join(shared.hint("merge"), ["k", "band"]))
    places = keep(nodes.join(asked.select("node").distinct(), "node", "left_semi").select(F.col("doc_id").alias("_id"), "node"))

    def read(batch: pa.RecordBatch) -> Iterator[list]:
        for part in text_slices(batch, "text", 2 << 20):
            rows = []
            for node, text in zip(part.column("node").to_pylist(), utf8(part.column("text")), strict=True):
                words = text.lower().split()
                if words and _node(words) == node:
                    rows.append((node, shingle_set(words, shingle, seed).tobytes()))
            yield [pa.array([n for n, _ in rows], pa.int64()), pa.array([s for _, s in rows], pa.binary())]

    texts = maybe_in(docs.select(F.col("doc_id").cast("long").alias("_id"), "text"), key_bits(places, "_id"), "_id").join(places.hint("merge"), "_id")
    sets = keep(map_batches(texts.select("node", "text"), "node long, shingles binary", read).groupBy("node").agg(F.first("shingles").alias("shingles")))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fps, group, out = None, [], [], []

        def close() -> None:
            if len(group) > 1:
                out.extend((fps[a], fps[b]) for a, b in spanning_pairs(group, least) if fps[a] != fps[b])

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["src", "dst"])

        for batch in batches:
            for k, band, fp, raw in zip(*(batch.column(c).to_pylist() for c in ("k", "band", "fp", "shingles")), strict=True):
                if (k, band) != key:
                    close()
                    key, fps, group = (k, band), [], []
                fps.append(fp)
                group.append(np.frombuffer(raw, np.uint64))
            yield flush()
            out.clear()
        close()
        yield flush()

    dealt = asked.join(sets, "node").select("k", "band", "fp", "shingles").repartition("k", "band").sortWithinPartitions("k", "band", "fp")
    return dealt.mapInArrow(link, "src long, dst long").distinct()


def keep_first(docs: DataFrame, shingle: int = 5, most: int = 3, least: float = 0.8, seed: int = 42) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that with the smallest doc_id, and one of its repeated rows.

    Linked are texts with fingerprints within ``most`` bits and those with a Jaccard similarity of ``least`` or more;
    groups are what links connect. Texts without a word, null or empty, are one group. Rows without a doc_id all stay, since
    they can't be told apart. Other columns stay as they are; an empty table gives no rows. Only rows whose doc_id goes or repeats
    are shuffled at the end; the others pass by a filter of bits.
    """
    with scratch(docs.sparkSession) as keep:
        sketched = keep(sketches(docs, shingle, seed))
        nodes = keep(sketched.groupBy("fp").agg(F.min("doc_id").alias("doc_id")))
        links = fingerprint_links(nodes, most).unionByName(similar_links(docs, sketched, shingle, least, seed, keep))
        roots = connected_components(links, keep=keep).withColumnRenamed("node", "fp")
        first = nodes.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("doc_id").alias("_first")).select("_first").distinct()
        ids = sketched.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_n")).join(first, F.col("doc_id") == F.col("_first"), "left")
        told = stored(ids.select(F.col("doc_id").alias("_id"), F.col("_first").isNotNull().alias("_stays"), "_n").where("not _stays or _n > 1"))
    keyed = marked(docs.withColumn("_key", F.col("doc_id").cast("long")), key_bits(told, "_id"), "_maybe", "_key")
    some = keyed.where("_maybe and doc_id is not null").join(told.hint("merge"), F.col("_key") == F.col("_id"), "left").where("_id is null or _stays").dropDuplicates(["doc_id"])
    return keyed.where("not _maybe or doc_id is null").select(*docs.columns).unionByName(some.select(*docs.columns))
