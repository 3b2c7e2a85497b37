"""Exact top-k search over binary codes by incremental multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, stored


def sign_code(embedding: Column) -> Column:
    """The signs of an embedding as text of 0 and 1: 1 where a value is above 0. Null for null or empty."""
    return F.when(F.size(embedding) > 0, F.concat_ws("", F.transform(embedding, lambda x: F.when(x > 0, "1").otherwise("0"))))


@cache
def _flips(width: int, radius: int) -> np.ndarray:
    """All masks of ``radius`` bits of ``width``."""
    return np.array([sum(1 << f for f in flips) for flips in combinations(range(width), radius)], np.int64)


class MultiIndex:
    """One hash index for each segment of a set of codes.

    Segments are as wide as it takes to give each value about one code, so that a probe meets few. A query grows the search radius one segment at a
    time: once m segments are searched to radius r and the other s - m to r - 1, every code within ``s * r + m - 1`` bits has been
    seen, for a code farther away in each segment than was searched is that far in sum. The search ends when the kth distance found is covered.
    """

    def __init__(self, bits: np.ndarray, segment_bits: int | None = None):
        """bits: a row of 0 and 1 for each code."""
        self.bits = bits
        width = bits.shape[1]
        count = max(1, round(width / (segment_bits or min(16, max(4, len(bits).bit_length())))))
        edges = [width * k // count for k in range(count + 1)]
        self.cuts = [slice(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]
        self.packed = np.packbits(bits, axis=1)
        self.verified = 0
        self.order, self.start = [], []
        for cut in self.cuts:
            values = self._value(bits[:, cut])
            self.order.append(np.argsort(values, kind="stable"))
            self.start.append(np.searchsorted(values[self.order[-1]], np.arange((1 << (cut.stop - cut.start)) + 1)))

    @staticmethod
    def _value(bits: np.ndarray) -> np.ndarray:
        return bits.astype(np.int64) @ (1 << np.arange(bits.shape[1] - 1, -1, -1, dtype=np.int64))

    def search(self, query: np.ndarray, k: int, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Indexes and distances of all codes within the kth smallest distance (all codes if fewer than k), and within ``most`` if given."""
        most = query.size if most is None else most
        packed = np.packbits(query)
        seen = np.zeros(len(self.bits), bool)
        at, far = np.empty(0, np.int64), np.empty(0, np.int64)
        kth = query.size
        for radius, (m, (cut, order, start)) in product(range(max(c.stop - c.start for c in self.cuts) + 1), enumerate(zip(self.cuts, self.order, self.start, strict=True), 1)):
            width = cut.stop - cut.start
            if radius <= width:
                probe = int(self._value(query[None, cut])[0]) ^ _flips(width, radius)
                sizes = start[probe + 1] - start[probe]
                new = order[np.repeat(start[probe] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
                new = new[~seen[new]]  # a code is in one bucket of a segment
                seen[new] = True
                self.verified += len(new)
                at = np.concatenate([at, new])
                far = np.concatenate([far, np.bitwise_count(self.packed[new] ^ packed).sum(axis=1, dtype=np.int64)])
                if len(new) and len(far) >= k:
                    kth = np.partition(far, k - 1)[k - 1]
            if min(kth, most) <= len(self.cuts) * radius + m - 1:
                break
        at, far = at[far <= most], far[far <= most]
        if len(far) > k:
            keep = far <= np.partition(far, k - 1)[k - 1]
            at, far = at[keep], far[keep]
        return at, far


def _bits(texts: list[str]) -> np.ndarray:
    return (np.frombuffer("".join(texts).encode(), np.uint8).reshape(len(texts), -1) == 49).astype(np.uint8)


def _searched(items: DataFrame, queries: DataFrame, k: int, query_block: int) -> DataFrame:
    """The k best of each query (b, code, most) among the items (b, code, ids) of its block: code, ids, distances.

    A block's items come first and make its index, once; its queries stream past, however many they are, and their results
    are handed on ``query_block`` at a time.
    """
    none = F.lit(None)
    left = items.select("b", F.lit(0).alias("kind"), "code", "ids", none.cast("int").alias("most"))
    both = left.unionByName(queries.select("b", F.lit(1).alias("kind"), "code", none.cast("array<long>").alias("ids"), "most"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, index, out = None, {}, {}, []
        kinds = (pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 3
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["code", "ids", "distances"])

        for batch in batches:
            for b, kind, code, ids, most in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != block:
                    block, held, index = b, {}, {}
                width = len(code)
                if not kind:
                    held.setdefault(width, []).append((code, ids))
                    continue
                if width not in held:
                    continue
                if width not in index:
                    index[width] = MultiIndex(_bits([c for c, _ in held[width]]))
                at, far = index[width].search(_bits([code])[0], k, most)
                best = sorted((d, i) for a, d in zip(at.tolist(), far.tolist(), strict=True) for i in held[width][a][1])[:k]
                out.append((code, [i for _, i in best], [d for d, _ in best]))
                if len(out) >= query_block:
                    yield flush()
        yield flush()

    return both.repartition("b").sortWithinPartitions("b", "kind").mapInArrow(run, "code string, ids array<long>, distances array<int>")


def hamming_top_k(items: DataFrame, queries: DataFrame, k: int = 10, block: int = 32768, query_block: int = 4096) -> DataFrame:
    """The k nearest items of each query by Hamming distance of codes: query_id, rank, id, distance.

    ``items`` and ``queries`` have id (long) and code (text of 0 and 1). A query is no neighbour of itself;
    ties go to the smaller id. Equal codes meet first: a code keeps only its k + 1 smallest ids, ranked in salted groups, since no more
    can be among the results, so that a vector that repeats often costs one entry. Distinct codes are dealt into
    blocks of about ``block`` by hash. Each distinct query code first searches the block of its own hash; the distance
    of its kth there bounds the radius of the search in all other blocks, which most end soon. Items are moved once,
    queries once for each block, and a block's index is made once for all of them.

    A null code is neither found nor searched; codes of another length than the query's are not
    compared; repeated rows count once; other columns are ignored; empty tables give no rows.
    """
    with scratch(items.sparkSession) as keep:
        base = items.where("code is not null and id is not null").select(F.col("id").cast("long").alias("id"), "code").distinct()
        salted = Window.partitionBy("code", "salt").orderBy("id")
        few = base.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("_k", F.row_number().over(salted)).where(F.col("_k") <= k + 1)
        codes = keep(few.groupBy("code").agg(F.slice(F.sort_array(F.collect_list("id")), 1, k + 1).alias("ids")))
        asked = stored(queries.where("code is not null and id is not null").select(F.col("id").cast("long").alias("query_id"), "code").distinct())
        wanted = keep(asked.select("code").distinct())
        n = -(-max(1, codes.count()) // block)
        dealt = codes.withColumn("b", F.pmod(F.xxhash64("code"), F.lit(n)).cast("int"))
        own = wanted.withColumn("b", F.pmod(F.xxhash64("code"), F.lit(n)).cast("int"))
        best = keep(_searched(dealt, own.withColumn("most", F.lit(None).cast("int")), k + 1, query_block))
        if n > 1:
            bound = best.where(F.size("distances") > k).select("code", F.element_at("distances", -1).alias("most"))
            others = own.join(bound, "code", "left").select("code", "most", F.explode(F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: b != F.col("b"))).alias("b"))
            best = best.unionByName(_searched(dealt, others, k + 1, query_block))
        pairs = F.arrays_zip(F.col("distances").alias("distance"), F.col("ids").alias("id"))
        best = stored(best.groupBy("code").agg(F.slice(F.sort_array(F.flatten(F.collect_list(pairs))), 1, k + 1).alias("best")))
    mine = asked.join(best, "code").withColumn("best", F.slice(F.filter("best", lambda x: x["id"] != F.col("query_id")), 1, k))
    return mine.select("query_id", F.posexplode("best").alias("rank", "hit")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.id").alias("id"), F.col("hit.distance").cast("int").alias("distance"))
