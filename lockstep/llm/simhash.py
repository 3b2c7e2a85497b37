"""SimHash near-duplicates by a segment-popcount embedding and a grid range-join."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, scratch, stored, text_slices, utf8
from .components import connected_components

SEGMENT_BITS, SEGMENTS = 2, 32
#: Segments of each block; a pair within Manhattan distance 3 differs in 3 blocks at most.
BLOCKS = [tuple(range(i, SEGMENTS, 6)) for i in range(6)]


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a UTF-8 text; 0 if it has no word.

    A-Z count as lower case, words end at ASCII white space, every shingle counts as often as it comes.
    """
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    h64 = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        end = min(n, at + (1 << 16))
        part = words[at : end + shingle - 1]
        grams = map(b" ".join, zip(*[part[k:] for k in range(shingle)], strict=False)) if len(words) >= shingle else [b" ".join(words)]
        hashes = np.fromiter((h64(g, seed) for g in grams), np.uint64, end - at)
        counts += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row."""

    def run(batch: pa.RecordBatch) -> Iterator[list]:
        for part in text_slices(batch, "text"):
            found = np.array([fingerprint(t, shingle, seed) for t in utf8(part.column("text"))], np.uint64)
            yield [part.column("doc_id"), pa.array(found.view(np.int64))]

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id long, fp long", run)


def embed(fps: np.ndarray) -> np.ndarray:
    """Bit counts per 2-bit segment, a row of 32 for each fingerprint: half the bit distance at worst, never over it."""
    bits = np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return bits.reshape(-1, SEGMENTS, SEGMENT_BITS).sum(axis=2, dtype=np.uint8)


def cells(fps: np.ndarray) -> np.ndarray:
    """Grid cells of each fingerprint: its embedding on each choice of 3 of the 6 blocks, as one number.

    Bits that differ change the embedding by their number at most. So a pair within 3 bits is within
    Manhattan distance 3, differs in 3 blocks at most, and shares the cell of 3 others.
    """
    counts = embed(fps).astype(np.int64)
    out = np.empty((len(fps), 20), np.int64)
    for k, chosen in enumerate(combinations(range(len(BLOCKS)), 3)):
        value = np.zeros(len(fps), np.int64)
        for segment in (s for b in chosen for s in BLOCKS[b]):
            value = value * 3 + counts[:, segment]
        out[:, k] = k * 3**17 + value
    return out


def spanning_links(fps: np.ndarray, most: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Links (smaller, root) that join what is connected at ``most`` bits within one cell.

    A search spreads through the members not reached yet, so that a dense group costs about one
    pass, and gives one link for each member but its root: never all pairs. Manhattan distance of the
    embeddings, a lower bound, screens each comparison; exact bit distance decides.
    """
    left, counts = fps, embed(fps)
    members, roots = [], []
    while len(left) > 1:
        queue_fp, queue_count = [left[0]], [counts[0]]
        root, left, counts = left[0], left[1:], counts[1:]
        while queue_fp and len(left):
            fp, count = queue_fp.pop(), queue_count.pop()
            near = np.flatnonzero(np.abs(counts.astype(np.int8) - count.astype(np.int8)).sum(axis=1) <= most)
            near = near[np.bitwise_count(left[near] ^ fp) <= most]
            if len(near):
                queue_fp += list(left[near])
                queue_count += list(counts[near])
                members.append(left[near])
                roots.append(np.full(len(near), root))
                keep = np.ones(len(left), bool)
                keep[near] = False
                left, counts = left[keep], counts[keep]
    if not members:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(members), np.concatenate(roots)


def fingerprint_links(nodes: DataFrame, most: int = 3) -> DataFrame:
    """Links (src, dst) between distinct fingerprints (``fp``) that span all components at ``most`` bits."""
    if most > 3:
        raise ValueError("the grid covers 3 bits at most")

    def spread(batch: pa.RecordBatch) -> Iterator[list]:
        fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        yield [pa.array(cells(fps).ravel()), pa.array(np.repeat(fps, 20).view(np.int64))]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_cell, held = np.empty(0, np.int64), np.empty(0, np.uint64)

        def close(cell: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            """Links of whole cells."""
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.empty(0, int)
            sizes = np.diff(np.r_[starts, len(cell)])
            two = starts[sizes == 2]
            a, b = fps[two], fps[two + 1] if len(two) else fps[two]
            near = np.abs(embed(a).astype(np.int8) - embed(b).astype(np.int8)).sum(axis=1) <= most
            near &= np.bitwise_count(a ^ b) <= most
            src, dst = [b[near]], [a[near]]
            for at, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
                s, d = spanning_links(fps[at : at + n], most)
                src.append(s)
                dst.append(d)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (src, dst)], names=["src", "dst"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cell = np.concatenate([held_cell, batch.column("cell").to_numpy(zero_copy_only=False)])
            fps = np.concatenate([held, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            last = np.searchsorted(cell, cell[-1])
            held_cell, held = cell[last:], fps[last:]
            if last:
                yield close(cell[:last], fps[:last])
        yield close(held_cell, held)

    spread_out = map_batches(nodes.select("fp"), "cell long, fp long", spread)
    return spread_out.repartition("cell").sortWithinPartitions("cell", "fp").mapInArrow(link, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, most: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id reachable) for every row.

    Equal fingerprints meet before anything is compared, so that copies cost nothing more. Distinct
    ones meet in the cells of a grid and are linked by spanning links; components are found with joins.

    Texts without a word, null or empty, have fingerprint 0 and are linked like any others. A null
    doc_id counts as larger than any other: its component is null only if all its members' ids are.
    Repeated rows come out as often; other columns are ignored; an empty table gives no rows.
    """
    fps = stored(fingerprints(docs, shingle, seed))
    with scratch(docs.sparkSession) as keep:
        nodes = keep(fps.groupBy("fp").agg(F.min("doc_id").alias("doc_id")))
        roots = connected_components(fingerprint_links(nodes, most), keep=keep)
        label = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        smallest = label.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        labels = stored(label.join(smallest, "root").select("fp", "component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fps.join(labels, "fp", "left").select("doc_id", hexed.alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, shingle: int = 5, most: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that with the smallest doc_id, and one of its repeated rows.

    Rows without a doc_id all stay, since they can't be told apart.
    """
    first = near_duplicates(docs, shingle, most, seed).where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(stored(first), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.where("doc_id is null"))
