"""Line dedup by content-defined chunks of lines."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bits import key_bits, marked, maybe_in
from .common import freed, map_batches, scratch, stored, text_slices, utf8

#: A byte that no UTF-8 text holds.
CUT = b"\xff"


def lines_of(text: bytes) -> list[bytes]:
    """A text as its lines, long lines cut after the ends of sentences; white space at a cut stays with the line before."""
    if CUT in text:
        return [text]
    marked = text.replace(b". ", b". \xff").replace(b"! ", b"! \xff").replace(b"? ", b"? \xff").replace(b"\xff ", b" \xff")
    lines = marked.replace(b"\n", b"\n\xff").replace(b"\xff\n", b"\n").split(CUT)
    if not lines[-1]:
        lines.pop()
    return lines


def chunks_of(lines: list[bytes], window: int = 2, divisor: int = 3, least: int = 2, most: int = 32, least_bytes: int = 40) -> list[tuple[int, int]]:
    """Runs [start, end) of lines that content defines.

    A rolling hash over the hashes of the last ``window`` lines ends a chunk after a line where it is divisible by
    ``divisor``, once the chunk has ``least`` lines and ``least_bytes`` bytes, and after ``most`` lines in any case: a line that repeats
    on and on gives no other boundary. Line ends and outer white space don't count. An insertion moves
    boundaries only until the next one. A short rest joins the chunk before it.
    """
    n, h64 = len(lines), xxhash.xxh64_intdigest
    hashes = np.fromiter((h64(x.strip(), 11) for x in lines), np.uint64, n)
    rolling = hashes.copy()
    for k in range(1, min(window, n)):
        rolling[k:] += hashes[:-k] * np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64))
    mixed = ((rolling ^ (rolling >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(33)
    ends = [0, *accumulate(map(len, lines))]
    out, start = [], 0
    for at in [*np.flatnonzero(mixed % np.uint64(divisor) == 0).tolist(), n]:
        while (forced := start + most - 1) < at:
            while forced < at and ends[forced + 1] - ends[start] < least_bytes:
                forced += 1
            if forced == at:
                break
            out.append((start, forced + 1))
            start = forced + 1
        if at < n and at + 1 - start >= max(least, window) and ends[at + 1] - ends[start] >= least_bytes:
            out.append((start, at + 1))
            start = at + 1
    if start < n:
        if out and n - start < least:
            out[-1] = (out[-1][0], n)
        else:
            out.append((start, n))
    return out


def text_chunks(text: bytes, least_bytes: int) -> list[tuple[int, bytes]]:
    """(number, bytes without outer white space) of the chunks that have several lines and ``least_bytes``."""
    lines = lines_of(text)
    found = ((n, b"".join(lines[a:b]).strip()) for n, (a, b) in enumerate(chunks_of(lines, least_bytes=least_bytes)) if b - a > 1)
    return [(n, raw) for n, raw in found if len(raw) >= least_bytes]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def chunk_keys(docs: DataFrame, least_bytes: int, with_text: bool) -> DataFrame:
    """doc_id, version (hash of the text), n (number of the chunk), key (hash of the chunk), and its bytes if asked for."""

    def run(batch: pa.RecordBatch) -> Iterator[list]:
        for part in text_slices(batch, "text", 4 << 20):
            rows = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), utf8(part.column("text")), strict=True):
                version = _signed(xxhash.xxh64_intdigest(text, 42))
                rows += [(doc_id, version, n, _signed(xxhash.xxh64_intdigest(raw)), raw)[: 4 + with_text] for n, raw in text_chunks(text, least_bytes)]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())[: 4 + with_text]
            yield [pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * len(kinds), kinds, strict=True)]

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id long, version long, n int, key long" + ", chunk binary" * with_text, run)


def repeated_chunks(docs: DataFrame, least_bytes: int = 40, keep: Callable[..., DataFrame] = stored) -> DataFrame:
    """Chunks that stand elsewhere before: doc_id, version, n, bytes. ``keep`` writes the tables on the way.

    First only hashes are counted, with partial sums before the shuffle. A filter of bits over those that repeat lets
    only such chunks go on, as bytes, to be grouped by hash and bytes, which compares them whole; a chunk that stands
    in a third of all documents is a hot key, and is pre-aggregated there. Then places meet the first
    place of their chunk by its hash, and by its bytes only where different chunks share a hash; adaptive execution splits
    a hot key of this join. The first place in order of doc_id (null first), version and number is kept.
    """
    place = F.struct("doc_id", "version", "n")
    repeated = chunk_keys(docs, least_bytes, False).groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    candidates = keep(maybe_in(chunk_keys(docs, least_bytes, True), key_bits(keep(repeated), "key"), "key"), "zstd")
    whole = keep(candidates.groupBy("key", "chunk").agg(F.min(place).alias("first"), F.count("*").alias("c")), "zstd")
    shared = keep(whole.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select("key", F.lit(True).alias("_shared")))

    def told(df: DataFrame) -> DataFrame:
        """``chunk`` only where its hash does not tell it."""
        return df.join(shared, "key", "left").withColumn("chunk", F.when(F.col("_shared"), F.col("chunk"))).drop("_shared")

    first = told(whole.where("c > 1").select("key", "chunk", "first", F.octet_length("chunk").alias("bytes")))
    places = told(maybe_in(candidates, key_bits(whole.where("c > 1"), "key"), "key"))
    first = keep(first.withColumnsRenamed({"key": "_key", "chunk": "_chunk"}), "zstd")
    joined = keep(places, "zstd").join(first.hint("merge"), (F.col("key") == F.col("_key")) & F.col("chunk").eqNullSafe(F.col("_chunk")))
    return joined.where(~place.eqNullSafe(F.col("first"))).select("doc_id", "version", "n", "bytes")


def edited(docs: DataFrame, gone: DataFrame, names: list[str], edit: Callable[..., bytes]) -> DataFrame:
    """``docs`` with ``names``, and ``text`` as ``edit`` makes it from its bytes and their values, where ``gone`` (doc_id, version, ``names``) has a row.

    Texts that surely have none, by a filter of bits, pass without a shuffle.
    """
    versioned = docs.withColumn("_at", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))  # XXH64 with seed 42, as where version is made
    told = marked(versioned, key_bits(gone, "version"), "_maybe", "_at")
    inner = gone.select(F.col("doc_id").alias("_doc_id"), F.col("version").alias("_version"), *names)
    some = told.where("_maybe").join(inner.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col("_doc_id")) & (F.col("_at") == F.col("_version")), "left")
    some = some.select(*docs.columns, *names)
    columns, at = some.columns, some.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", 8 << 20):
                texts = part.column("text").to_pylist()
                for i, values in enumerate(zip(*(part.column(c).to_pylist() for c in names), strict=True)):
                    if any(values):
                        texts[i] = edit(texts[i].encode(), *values).decode()
                out = [part.column(c) for c in columns]
                out[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(out, names=columns)

    rest = told.where("not _maybe").select(*docs.columns, *[F.lit(None).cast(gone.schema[c].dataType).alias(c) for c in names])
    return rest.unionByName(some.mapInArrow(run, some.schema))


def dedup_lines(docs: DataFrame, least_bytes: int = 40) -> DataFrame:
    """``docs`` with ``text`` less its repeated chunks, and ``removed`` (the numbers of the chunks that went, sorted).

    A chunk counts if it has several lines and ``least_bytes`` bytes. No row goes: a text of which nothing is left is
    empty. A null text stays null; an empty one has no chunk. Rows that agree in doc_id and text are
    one document, and stay alike. All other columns stay as they are; a column named ``removed`` is replaced; an
    empty table gives no rows.
    """
    docs = docs.drop("removed")
    with scratch(docs.sparkSession) as keep:
        gone = stored(repeated_chunks(docs, least_bytes, keep).groupBy("doc_id", "version").agg(F.sort_array(F.collect_set("n")).alias("removed")))

    def edit(text: bytes, removed: list[int]) -> bytes:
        lines, out = lines_of(text), set(removed)
        return b"".join(x for n, (a, b) in enumerate(chunks_of(lines, least_bytes=least_bytes)) if n not in out for x in lines[a:b])

    return edited(docs, gone, ["removed"], edit)


#: Words of the shortest passage that goes, of the grams that are counted first, and grams in a window of which the least is taken.
PASSAGE, GRAM = 51, 16
WINDOW = PASSAGE - GRAM + 1
#: Stands for all of a text among the starts of passages.
WHOLE = -1
#: Characters of scripts without spaces (Kana, Han, Thai, Lao, Burmese, Khmer): each is a word of its own.
_SOLO = rb"[\xe3-\xe9][\x80-\xbf]{2}|\xe0[\xb8-\xbb][\x80-\xbf]|\xe1[\x80-\x82\x9e\x9f][\x80-\xbf]"
_HAS_SOLO, _WORD = re.compile(_SOLO), re.compile(rb"\S+")
_WORD_OR_SOLO = re.compile(_SOLO + rb"|(?:(?!" + _SOLO + rb")\S)+")


def words_of(text: bytes) -> list[bytes]:
    """Runs without ASCII white space; a character of a script without spaces is a word of its own."""
    return _WORD_OR_SOLO.findall(text) if _HAS_SOLO.search(text) else text.split()


def run_hashes(words: np.ndarray, width: int, base: int) -> np.ndarray:
    """A 64-bit hash of each ``width`` words in a row, from running sums of the words' hashes times powers of an odd ``base``."""
    n = len(words)
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[:1] = down[:1] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * np.cumprod(up))])
    out = (sums[width:] - sums[:-width]) * np.cumprod(down)[: n - width + 1]
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def _sliding(values: np.ndarray, width: int, take: np.ufunc) -> np.ndarray:
    """Least or greatest of each ``width`` values in a row, by doubling."""
    span = 1
    while 2 * span <= width:
        values, span = take(values[:-span], values[span:]), 2 * span
    return take(values[: len(values) - (width - span)], values[width - span :]) if width > span else values


def seed_places(hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, place) of the grams that are least in some window of grams. ``ends``: where the text of each word ends.

    A run of ``PASSAGE`` words holds one whole window, and so one of these at the same place in any text that has the run.
    """
    if len(hashes) < PASSAGE:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    grams = run_hashes(hashes, GRAM, 0x9E3779B97F4A7C15)
    whole = np.arange(len(grams)) + GRAM <= ends[: len(grams)]
    grams[~whole] = np.iinfo(np.uint64).max
    least = _sliding(grams, WINDOW, np.minimum)
    edge = np.zeros(WINDOW - 1, np.uint64)
    at = np.flatnonzero(whole & (grams == _sliding(np.concatenate([edge, least, edge]), WINDOW, np.maximum)))
    return grams[at], at


#: Stands for a word before or after a text.
_OUTSIDE = np.uint64(0xB5297A4D3F84D5B5)


def passage_seeds(docs: DataFrame) -> DataFrame:
    """key, around, doc_id, version, at (number of its first word) of the grams taken from each text of ``PASSAGE`` words or more.

    ``around`` is a hash of the gram with ``WINDOW - 1`` words on both sides: all that any passage around it has.
    """
    side = WINDOW - 1

    def run(batch: pa.RecordBatch) -> Iterator[list]:
        h64 = xxhash.xxh64_intdigest
        for part in text_slices(batch, "text", 2 << 20):
            ids, versions, sizes, hashes = [], [], [], []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), utf8(part.column("text")), strict=True):
                words = words_of(text)
                if len(words) >= PASSAGE:
                    ids.append(doc_id)
                    versions.append(_signed(h64(text, 42)))
                    sizes.append(len(words))
                    hashes.append(np.fromiter(map(h64, words), np.uint64, len(words)))
            if not sizes:
                continue
            ends, edge = np.cumsum(sizes), np.full(side, _OUTSIDE)
            keys, places = seed_places(np.concatenate(hashes), np.repeat(ends, sizes))
            of = np.searchsorted(ends, places, "right")
            at = places - (ends - sizes)[of]
            around = run_hashes(np.concatenate([x for h in hashes for x in (edge, h)] + [edge]), GRAM + 2 * side, 0xD6E8FEB86659FD93)[places + side * of]
            yield [pa.array(keys.view(np.int64)), pa.array(around.view(np.int64)), pa.array(ids, pa.int64()).take(pa.array(of)), pa.array(np.array(versions, np.int64)[of]), pa.array(at.astype(np.int32))]

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "key long, around long, doc_id long, version long, at int", run)


def passage_windows(texts: DataFrame) -> DataFrame:
    """a, b (128 bits of hash), doc_id, version, at of every run of ``PASSAGE`` words around the grams ``seeds`` of each text."""

    def run(batch: pa.RecordBatch) -> Iterator[list]:
        for part in text_slices(batch, "text", 1 << 20):
            found, sizes = [], []
            for seeds, text in zip(part.column("seeds").to_pylist(), utf8(part.column("text")), strict=True):
                words = words_of(text)
                hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
                at = np.unique((np.array(seeds)[:, None] - np.arange(WINDOW)).ravel())
                at = at[(at >= 0) & (at <= len(words) - PASSAGE)]
                other = (hashes ^ (hashes >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
                found.append((run_hashes(hashes, PASSAGE, 0x9E3779B97F4A7C15)[at].view(np.int64), run_hashes(other, PASSAGE, 0xD6E8FEB86659FD93)[at].view(np.int64), at.astype(np.int32)))
                sizes.append(len(at))
            a, b, at = (np.concatenate(x) for x in zip(*found, strict=True))
            of = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            yield [pa.array(a), pa.array(b), part.column("doc_id").take(of), part.column("version").take(of), pa.array(at)]

    return map_batches(texts.select("doc_id", "version", "seeds", "text"), "a long, b long, doc_id long, version long, at int", run)


def without_passages(text: bytes, starts: list[int], seeds: list[int]) -> bytes:
    """``text`` less the ``PASSAGE`` words from each of ``starts`` on, and all runs around the grams at ``seeds``; white space after a word goes with it."""
    if starts[:1] == [WHOLE]:
        return b""
    spans = [m.start() for m in (_WORD_OR_SOLO if _HAS_SOLO.search(text) else _WORD).finditer(text)] + [len(text)]
    last = len(spans) - 1 - PASSAGE
    out, done = [], 0
    for low, high in sorted([*((at, at) for at in starts), *((max(0, at - WINDOW + 1), min(at, last)) for at in seeds)]):
        if spans[low] > done:
            out.append(text[done : spans[low]])
        done = max(done, spans[high + PASSAGE])
    return b"".join([*out, text[done:]])


def dedup_passages(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` less each run of ``PASSAGE`` words or more that stands at an earlier place, whatever surrounds it.

    Words are compared, not the white space between them. Places are ordered by doc_id (null first), hash of
    the text and word; the first one stays, and so do runs that overlap it. No row goes; a text of which nothing
    is left is empty, a null text stays null; rows that agree in doc_id and text stay alike.

    Grams of ``GRAM`` words that are least in a window find the runs: two places of a run share one of them. Grams that
    repeat with all words around them settle at once that every run there is later than another; only for the
    first of such places, and around other grams that repeat, every run of ``PASSAGE`` words is counted, by 128 bits of hash.
    Nothing compares texts in pairs, and copies of a text cost no more than one; a passage in a third of all texts is a
    key of joins that adaptive execution splits.
    """
    spark = docs.sparkSession
    place, here = F.struct("doc_id", "version", "at"), F.struct("doc_id", "version")
    with scratch(spark) as keep:
        seeds = keep(passage_seeds(docs))
        spread = F.xxhash64("version", "at")
        repeated = seeds.groupBy("key").agg(F.min(spread).alias("low"), F.max(spread).alias("high")).where("low <> high").select("key")
        named = seeds.select("doc_id", "version").distinct()
        owner = keep(named.groupBy("version").agg(F.min(F.struct("doc_id")).alias("first"), F.max(F.struct("doc_id")).alias("last")))
        several = owner.where(~F.col("first").eqNullSafe(F.col("last"))).select("version", F.col("first.doc_id").alias("first_id"))
        copies = keep(named.join(several, "version").where(~F.col("doc_id").eqNullSafe(F.col("first_id"))).select("doc_id", "version"))

        found = keep(maybe_in(seeds, key_bits(keep(repeated), "key"), "key"))
        earliest = keep(found.groupBy("key", "around").agg(F.min(place).alias("first"), F.count("*").alias("c")).where("c > 1").drop("c"))
        told = marked(found, key_bits(earliest, "key", "around"), "_maybe", "key", "around")
        sure = (F.col("first").isNotNull() & ~here.eqNullSafe(F.struct("first.doc_id", "first.version"))).alias("sure")
        met = told.where("_maybe").join(earliest.hint("merge"), ["key", "around"], "left").select("doc_id", "version", "at", sure)
        told = keep(met.unionByName(told.where("not _maybe").select("doc_id", "version", "at", F.lit(False).alias("sure"))))

        asked = keep(told.where("not sure").groupBy("doc_id", "version").agg(F.collect_set("at").alias("seeds")))
        versioned = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("version", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
        named = asked.withColumnsRenamed({"doc_id": "_id", "version": "_at"}).hint("merge")
        texts = maybe_in(versioned, key_bits(asked, "version"), "version").join(named, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_at")))
        windows = keep(passage_windows(texts), "zstd")
        freed(spark)
        runs = keep(windows.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("c")).where(~F.col("first").eqNullSafe(F.col("last"))))
        many = runs.where("c > 2")
        met = maybe_in(windows, key_bits(many, "a"), "a").join(many.select("a", "b", "first").hint("merge"), ["a", "b"])
        both = met.select(place.alias("it"), "first").unionByName(runs.where("c = 2").select(F.col("last").alias("it"), "first"))
        same = F.col("it.doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("it.version") == F.col("first.version"))
        later = both.where(~same | (F.col("it.at") - F.col("first.at") >= PASSAGE)).select("it.doc_id", "it.version", F.col("it.at").alias("start"))
        rows = later.unionByName(copies.withColumn("start", F.lit(WHOLE))).withColumn("seed", F.lit(None).cast("int"))
        rows = rows.unionByName(told.where("sure").select("doc_id", "version", F.lit(None).cast("int").alias("start"), F.col("at").alias("seed")))
        gone = stored(rows.groupBy("doc_id", "version").agg(*[F.sort_array(F.collect_set(c)).alias(n) for c, n in (("start", "_starts"), ("seed", "_seeds"))]))
    return edited(docs, gone, ["_starts", "_seeds"], without_passages).drop("_starts", "_seeds")
