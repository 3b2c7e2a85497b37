"""Phrases whose words stand together more often than apart, counted by FM-indexes over shards of word ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bits import ROW, key_bits
from .common import scratch, stored, utf8
from .fmindex import Intervals, ShardIndex

#: A-Z as lower case, the ends of pieces as one of them, a tab as a space: what is left to split are spaces.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"." * 10)
#: Bytes of text of one shard; a single longer text is a shard of its own.
SHARD_BYTES = 12 << 20


class Shard:
    """The words of many texts of one language as ids in the order of their bytes (from 1; 0 ends a piece)."""

    def __init__(self, texts: list[bytes]):
        joined = b".".join([*(t.translate(_FOLD) for t in texts), b""]).replace(b".", b" . ")
        tokens = pc.ascii_split_whitespace(pa.array([joined.strip()], pa.large_string()).cast(pa.large_binary()).view(pa.large_string())).values
        coded = tokens.dictionary_encode()
        found = coded.dictionary.cast(pa.large_binary())
        order = pc.array_sort_indices(found)
        names = found.take(order)
        rank = np.empty(len(names), np.int64)
        rank[order.to_numpy()] = np.arange(1, len(names) + 1)
        end = pc.index(names, b".").as_py()  # no word holds this byte
        rank = np.where(rank == end + 1, 0, rank - (rank > end + 1)).astype(np.int32)
        self.words = pa.concat_arrays([names.slice(0, end), names.slice(end + 1)])
        self.text = rank[coded.indices.to_numpy()]

    def phrases(self, found: Intervals) -> pa.BinaryArray:
        parts = [self.words.take(pa.array(found.words[:, k] - 1)) for k in range(found.words.shape[1])]
        return pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())).cast(pa.binary())

    def hashes(self) -> np.ndarray:
        """Of each id, the hash of its word as Spark has it; 0 for the end of a piece."""
        digests = b"".join([xxhash.xxh64_digest(w, 42) for w in self.words.to_numpy(zero_copy_only=False)])
        return np.r_[np.zeros(1, np.uint64), np.frombuffer(digests, ">u8").astype(np.uint64)]


def _pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return first ^ ((second << np.uint64(1)) | (second >> np.uint64(63)))


def _pair_column(phrase: Column) -> Column:
    """As ``_pair_key``, from the text of two words."""
    first, second = (F.xxhash64(F.split_part(phrase, F.lit(" "), F.lit(k))) for k in (1, 2))
    return first.bitwiseXOR(F.shiftleft(second, 1).bitwiseOR(F.shiftrightunsigned(second, 63)))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Shard]]:
    """The texts of a task by language, cut into shards."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), utf8(batch.column("text")), strict=True):
            if held and size + len(text) > SHARD_BYTES:
                yield from ((k, Shard(held.pop(k))) for k in list(held))
                pa.default_memory_pool().release_unused()
                size = 0
            held.setdefault(lang, []).append(text)
            size += len(text)
    yield from ((k, Shard(held.pop(k))) for k in list(held))


def _rows(lang: str, shard: Shard, found: Intervals, step: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """key, f: the language, an end of line, which no phrase holds, and the phrase. One column is less to hash and to compare."""
    for at in range(0, len(found.counts), step):
        part = found.where(slice(at, at + step))
        key = pc.binary_join_element_wise(pa.scalar(lang.encode() + b"\n", pa.binary()), shard.phrases(part), pa.scalar(b"", pa.binary()))
        yield pa.RecordBatch.from_arrays([key.cast(pa.string()), pa.array(part.counts.astype(np.int64))], names=["key", "f"])


def _summed(counts: DataFrame) -> DataFrame:
    """lang, phrase, f: counts added up over shards."""
    found = counts.groupBy("key").agg(F.sum("f").alias("f"))
    phrase = F.substring_index("key", "\n", -1)
    return found.select(F.substr("key", F.lit(1), F.length("key") - F.length(phrase) - 1).alias("lang"), phrase.alias("phrase"), "f")


def count_short(texts: DataFrame) -> DataFrame:
    """lang, phrase, f of all single words and pairs of ``texts`` (lang, text): counted by shard, summed over shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, shard in _shards(batches):
            index = ShardIndex(shard.text)
            yield from _rows(lang, shard, index.one)
            yield from _rows(lang, shard, index.left(index.one))

    return _summed(texts.mapInArrow(run, "key string, f long"))


def count_longer(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """lang, phrase, f of all triples whose two pairs are among ``pairs`` (lang, phrase), and of a few others.

    A triple is at most as frequent as its pairs. A filter of bits over the pairs, 64 MB at most, tells each shard which intervals to extend: it
    lets through all of ``pairs``, and is the same everywhere, so that every count is whole.
    """
    spark = texts.sparkSession
    bits = key_bits(pairs, hashed=_pair_column(F.col("phrase")))
    rows, size = spark.sparkContext.broadcast({r["_row"]: bytes(r["_bits"]) for r in bits.table.collect()}), bits.rows * ROW
    flat: list[np.ndarray] = []

    def may_be(key: np.ndarray) -> np.ndarray:
        if not flat:
            table = bytearray(size // 8)
            for k, v in rows.value.items():
                table[k * ROW // 8 : (k + 1) * ROW // 8] = v
            flat.append(np.frombuffer(table, np.uint8))
        at = key & np.uint64(size - 1)
        return (flat[0][at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, shard in _shards(batches):
            index, hashes = ShardIndex(shard.text, left=1, right=2), shard.hashes()
            two = index.left(index.one)
            two = two.where(may_be(_pair_key(hashes[two.words[:, 0]], hashes[two.words[:, 1]])))
            three = index.right(two)
            yield from _rows(lang, shard, three.where(may_be(_pair_key(hashes[three.words[:, 1]], hashes[three.words[:, 2]]))))

    return _summed(texts.mapInArrow(run, "key string, f long"))


def collocations(docs: DataFrame, least: int = 10, share: int = 50, most: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``most`` phrases of two or three words of each language.

    a, l and r count the phrase and the two sides of its lowest-scoring cut, n all words of the language, overlaps included;
    score is floor(1000000 a a / (l r)), in exact integers. Phrases with a < ``least``, and those inside a triple that comes in
    ``share`` percent of their places or more, take no part. Ranks go by score, then a, both falling, then by the phrase's bytes.

    Each task cuts its texts into shards and builds an FM-index of each, depth-limited and bidirectional (``fmindex``):
    single words and pairs first; then the triples of frequent pairs, whose intervals alone are extended. Only
    counts leave a shard, so that a hot word or phrase is one row of each.

    A null lang is ``und``, a null text is empty; a text without words gives nothing; repeated rows count as often as they come; other columns
    are ignored; an empty table gives no rows.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    with scratch(docs.sparkSession) as keep:
        single = ~F.contains("phrase", F.lit(" "))
        short = keep(count_short(texts).where(single | (F.col("f") >= least)), "zstd")
        pairs = short.where(~single)
        triples = keep(count_longer(texts, pairs).where(F.col("f") >= least).select("lang", "phrase", "f"), "zstd")
        sizes = short.where(single).groupBy("lang").agg(F.sum("f").alias("n"))
        words = short.where(single & (F.col("f") >= least)).select("lang", F.col("phrase").alias("side"), "f")
        exact = lambda c: F.col(c).cast("decimal(19,0)")

        def sided(found: DataFrame, sides: DataFrame, at: Column, name: str) -> DataFrame:
            return found.withColumn("side", at).join(sides.withColumnRenamed("f", name), ["lang", "side"]).drop("side")

        def scored(found: DataFrame, left: DataFrame, right: DataFrame, k: int) -> DataFrame:
            """One row for each phrase, cut after its first ``k`` words."""
            head = F.substring_index("phrase", " ", k)
            cut = sided(sided(found, left, head, "l"), right, F.substr("phrase", F.length(head) + 2), "r")
            return cut.withColumns({"k": F.lit(k), "score": F.call_function("div", F.lit(1000000).cast("decimal(7,0)") * exact("a") * exact("a"), exact("l") * exact("r"))})

        two = pairs.withColumnRenamed("f", "a")
        three = triples.withColumnRenamed("f", "a")
        inside = [three.select("lang", at.alias("phrase"), F.col("a").alias("longer")) for at in (F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2))]
        longest = inside[0].union(inside[1]).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        free = two.join(longest, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * exact("longer") < share * exact("a"))).drop("longer")
        both = pairs.withColumnRenamed("phrase", "side")
        cuts = scored(three, words, both, 1).unionByName(scored(three, both, words, 2))
        columns = ["lang", "phrase", "a", "l", "r", "score"]
        best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("_b")).select("lang", "phrase", "a", "_b.l", "_b.r", "_b.score")
        every = scored(free, words, words, 1).select(*columns).unionByName(best.select(*columns))
        order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
        dealt = F.pmod(F.xxhash64("phrase"), F.lit(64))
        first = every.withColumn("_slice", dealt).withColumn("_k", F.row_number().over(Window.partitionBy("lang", "_slice").orderBy(*order))).where(F.col("_k") <= most)
        ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
        return stored(ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
