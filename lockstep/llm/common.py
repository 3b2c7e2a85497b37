"""Shared helpers: the shared work folder, tables cut from their lineage, Arrow mapping."""

from __future__ import annotations

import gc
import itertools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def work_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only a local master may leave that setting unset (as in tests): a temporary folder takes its place. Elsewhere
    executors would write to disks of their own, so that this is an error.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or getattr(sc, "_lockstep_dir", None)
    if base is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = sc._lockstep_dir = "file://" + tempfile.mkdtemp(prefix="spark-lockstep-")
    return f"{base.rstrip('/')}/lockstep-{uuid.uuid4().hex}"


def _written(df: DataFrame, path: str, compression: str) -> DataFrame:
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends here."""
    return _written(df, work_dir(df.sparkSession), compression)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """``stored`` for tables that nothing needs after the block: their folder is deleted at its end, and so are shuffle files of work done."""
    path, made = work_dir(spark), itertools.count()
    try:
        yield lambda df, compression="snappy": _written(df, f"{path}/{next(made)}", compression)
    finally:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        freed(spark)


def packed(docs: DataFrame, *used: str) -> DataFrame:
    """The columns ``used``, and all others in one struct ``_rest``, where their names clash with nothing."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in used]
    return docs.select(*used, F.struct(*others, F.lit(None).cast("boolean").alias("_")).alias("_rest"))


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of a table that comes from ``packed``."""
    inside = {f.name for f in df.schema["_rest"].dataType.fields[:-1]}
    return df.select(*[F.col("_rest").getField(c).alias(c) if c in inside else F.col(f"`{c}`") for c in columns])


def freed(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of work that is done: it does so only when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def map_batches(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], Iterator[list]]) -> DataFrame:
    """``mapInArrow`` where ``fn`` turns one batch into lists of columns, in ``schema`` order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in fn(batch):
                yield pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns], names=names)

    names = [c.name for c in StructType.fromDDL(schema)]
    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of every text of an Arrow string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def text_slices(batch: pa.RecordBatch, column: str, max_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``max_bytes`` of text, so that outputs stay small."""
    sizes = [len(x) for x in utf8(batch.column(column))]
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > max_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if len(sizes) > start:
        yield batch.slice(start)
