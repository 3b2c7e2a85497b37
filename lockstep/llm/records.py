"""Length-delimited binary records of token ids, with a separate offset index.

A shard is one file of records in ascending doc_id order; shards ascend too. A record is

    length of the payload   8 bytes, little-endian unsigned
    masked CRC-32 of those  4 bytes
    payload                 1 byte: width of an id in bytes, plus 128 if doc_id is null;
                            8 bytes: doc_id; then the ids, little-endian unsigned
    masked CRC-32 of it     4 bytes
    end mark                1 byte, 0x0A

A mask rotates a checksum by 15 bits and adds 0xA282EAD8, so that a checksum over data that hold
checksums stays sound. Spark's own text and binaryFile sources write and read the shards: they reach
any store that Spark reaches, and a lost executor leaves no half-written file.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, text_slices, utf8
from .tokens import tokenizer

INDEX_SCHEMA = "shard long, record long, doc_id long, at long, n_bytes long, n_tokens long, tokens_before long, ids_crc32 long"
HEAD, ID_NULL = struct.Struct("<QI"), 128


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """One record around ``payload``."""
    length = struct.pack("<Q", len(payload))
    return b"%b%b%b%b\n" % (length, struct.pack("<I", masked(zlib.crc32(length))), payload, struct.pack("<I", masked(zlib.crc32(payload))))


def payload_at(content: bytes | memoryview, at: int) -> bytes | memoryview:
    """The payload of the record at byte ``at``, its checksums verified."""
    length, check = HEAD.unpack_from(content, at)
    if masked(zlib.crc32(content[at : at + 8])) != check:
        raise ValueError(f"length at byte {at} is damaged")
    payload = content[at + 12 : at + 12 + length]
    if len(payload) != length or struct.unpack_from("<I", content, at + 12 + length)[0] != masked(zlib.crc32(payload)) or content[at + 16 + length : at + 17 + length] != b"\n":
        raise ValueError(f"record at byte {at} is damaged")
    return payload


def parsed(payload: bytes) -> tuple[int | None, np.ndarray]:
    """doc_id and ids (unsigned 32-bit) of a payload."""
    width, doc_id = struct.unpack_from("<Bq", payload)
    return None if width & ID_NULL else doc_id, np.frombuffer(payload, f"<u{width & 7}", offset=9).astype("<u4")


def _tie() -> Column:
    """Orders the rows of one doc_id."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def shard_starts(docs: DataFrame, shard_bytes: int) -> list[tuple]:
    """(has id, doc_id, tie) of the first row of each shard, in order: a new one once ``shard_bytes`` bytes of text are passed.

    Ids, hashes and sizes alone are put in order; a shard starts anew with each task that orders them. What the
    driver gets is one row for each shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shard_bytes
        for batch in batches:
            starts = []
            for i, size in enumerate(batch.column("size").to_pylist()):
                if held + size > shard_bytes and held:
                    starts.append(i)
                    held = 0
                held += size
            yield batch.take(pa.array(starts, pa.int64()))

    sizes = docs.select("doc_id", _tie().alias("tie"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 32).cast("long").alias("size"))
    order = ("doc_id", "tie")
    with scratch(docs.sparkSession) as keep:  # the texts are read once for this
        ordered = keep(sizes).repartitionByRange(*order).sortWithinPartitions(*order)
        starts = ordered.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tie long, size long").collect()
    return sorted((r.doc_id is not None, r.doc_id or 0, r.tie) for r in starts)


def write_records(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, shard_bytes: int = 24 << 20) -> None:
    """Tokenise ``docs``, append ``end_id`` to each and write the shards below ``path``.

    Shards are cut by running bytes of text, ``shard_bytes`` at most (or one longer text), in the order of doc_id and, within one doc_id, of a
    hash of the text, so that a doc_id of many rows is split too and any run gives the same order. One shuffle brings each text to
    its shard. A null text is empty, a null doc_id comes first, repeated rows are repeated
    records, other columns are ignored, an empty table gives no record.
    """
    docs = docs.select("doc_id", "text")
    starts = shard_starts(docs, shard_bytes)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to = [bisect_right(starts, (d is not None, d or 0, t)) - 1 for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("tie").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to, pa.int32())], names=[*batch.schema.names, "shard"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_path)
        end = np.asarray([end_id], tok.dtype).tobytes()
        for batch in batches:
            for part in text_slices(batch, "text", 2 << 20):
                out = []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), tok.encode(utf8(part.column("text"))), strict=True):
                    head = struct.pack("<Bq", tok.dtype.itemsize | ID_NULL * (doc_id is None), doc_id or 0)
                    out.append(unframed(frame(head + ids + end)))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, tie long, shard int"
    dealt = docs.withColumn("tie", _tie()).mapInArrow(deal, schema).repartitionById(max(1, len(starts)), F.col("shard"))
    ordered = dealt.sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    ordered.mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def unframed(record: bytes) -> bytes:
    """A record without its end mark, which the text writer adds."""
    return record[:-1]


def scan_index(spark: SparkSession, path: str) -> DataFrame:
    """Walk all shards, verify each record, and return the index: where it is, what it holds.

    ``tokens_before`` counts the ids of earlier records of the same shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, content = batch.column("shard")[row].as_py(), batch.column("content")[row].as_py()
                at = before = 0
                rows = []
                while at < len(content):
                    payload = payload_at(content, at)
                    doc_id, ids = parsed(payload)
                    rows.append((shard, len(rows), doc_id, at, len(payload) + 17, len(ids), before, zlib.crc32(ids.tobytes())))
                    at += len(payload) + 17
                    before += len(ids)
                kinds = [pa.int64()] * 8
                columns = list(zip(*rows, strict=True)) or [()] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in INDEX_SCHEMA.split(", ")])

    return shards(spark, path).mapInArrow(run, INDEX_SCHEMA)


def write_index(spark: SparkSession, path: str) -> DataFrame:
    """The index of the shards at ``path``, written beside them (``<path>.index``) for reads in any order, and read back."""
    scan_index(spark, path).write.parquet(f"{path}.index")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX_SCHEMA).parquet(f"{path}.index")


def _files(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(list(paths))


def _number() -> Column:
    """The number of a shard from its file's name: the task's, and the file's where a task has written several."""
    number = lambda pattern: F.coalesce(F.regexp_extract("path", pattern, 1).try_cast("long"), F.lit(0))
    return F.shiftleft(number(r"part-(\d+)[^/]*$"), 31) + number(r"-c(\d+)[^/]*$")


def shards(spark: SparkSession, path: str) -> DataFrame:
    """The shard files: shard (its number; shards ascend by it), content."""
    return _files(spark, path).select(_number().alias("shard"), "content")


def global_starts(index: DataFrame) -> DataFrame:
    """``index`` with ``start``: the ids of all records before one, over all shards.

    The window holds one row for each shard file. Repeated rows and null doc_ids have records and starts of their own; an
    empty index gives no rows.
    """
    ordered = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("_n")).select("shard", F.coalesce(F.sum("_n").over(ordered), F.lit(0)).alias("_before"))
    return index.join(totals, "shard").withColumn("start", F.col("_before") + F.col("tokens_before")).drop("_before")


def fetch(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Records that rows of the index name (shard, at), in any order: doc_id, ids.

    Only the shards that hold a wanted record are read (their names, one for each shard, come from the driver), and the wanted offsets of
    one meet its file once. A record asked for twice comes twice, a null doc_id stays null; nothing wanted gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                content = memoryview(batch.column("content")[row].as_buffer())
                found = [parsed(bytes(payload_at(content, at))) for at in batch.column("places")[row].as_py()]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([i.tolist() for _, i in found], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    places = wanted.groupBy("shard").agg(F.collect_list("at").alias("places"))
    names = _files(spark, path).select("path", _number().alias("shard")).join(places.select("shard"), "shard", "left_semi").select("path").collect()
    if not names:
        return spark.createDataFrame([], "doc_id long, ids array<long>")
    held = _files(spark, *(r.path for r in names)).select(_number().alias("shard"), "content")
    return held.join(places, "shard").select("content", "places").mapInArrow(run, "doc_id long, ids array<long>")
