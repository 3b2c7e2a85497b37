"""Tables and records out: long tables, small JSON records, locked settings, what has to be made again."""

from __future__ import annotations

import json
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import ContractError


def without_empty(frame: DataFrame) -> DataFrame:
    """``frame`` without the columns that hold no value at all; one pass over all columns. An empty table keeps its columns."""
    counts = frame.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(f"c{k}") for k, c in enumerate(frame.columns)]).first()
    return frame if not counts["_rows"] else frame.select(*[F.col(f"`{c}`") for k, c in enumerate(frame.columns) if counts[f"c{k}"]])


def write_long(frame: DataFrame, path: str, *by: str, kind: str = "parquet") -> None:
    """A result table, a folder for each value of ``by``; only folders that the frame has rows for are replaced."""
    writer = frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by)
    (writer.option("header", True).csv if kind == "csv" else writer.parquet)(path)


def write_record(spark: SparkSession, record: dict, path: str) -> None:
    """A small record as one JSON line in a folder of its own; the commit protocol shows all of it or nothing."""
    spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_record(spark: SparkSession, path: str, **defaults: object) -> dict:
    """A record, with defaults for keys that older ones lack."""
    return defaults | json.loads(spark.read.text(path).first().value)


def fingerprint(settings: dict) -> str:
    """The same text for the same settings in any order."""
    return sha256(json.dumps(settings, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def locked(spark: SparkSession, path: str, settings: dict, exists: bool) -> str:
    """The fingerprint of ``settings``, kept in the record at ``path``; an error if the record there has another one."""
    if exists and (found := read_record(spark, path, fingerprint=None)["fingerprint"]) != fingerprint(settings):
        raise ContractError(f"{path} was made with other settings ({found})")
    if not exists:
        write_record(spark, {"settings": settings, "fingerprint": fingerprint(settings)}, path)
    return fingerprint(settings)


def stale(record: DataFrame, now: DataFrame, key: list[str], digest: str) -> DataFrame:
    """Keys whose checksum isn't on record, with ``reason``: new or changed."""
    old = record.select(*key, F.col(digest).alias("_old"))
    found = now.join(old, key, "left").where(~F.col("_old").eqNullSafe(F.col(digest)))
    return found.select(*key, F.when(F.col("_old").isNull(), "new").otherwise("changed").alias("reason"))


def export_array(frame: DataFrame, key: str, values: str, most: int = 100_000):
    """A NumPy array of a column of arrays in order of ``key``, for tables of ``most`` rows at most: more is an error."""
    import numpy as np

    rows = frame.select(key, values).orderBy(key).limit(most + 1).collect()
    if len(rows) > most:
        raise ContractError(f"over {most} rows")
    return np.array([r[1] for r in rows], float)
