"""Filters of bits over the keys of a table: what surely has no partner in a join needs no shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Bits of one row of a filter, as ``bitmap_construct_agg`` makes them.
ROW = 32768


@dataclass(frozen=True)
class Bits:
    """Rows (_row, _bits) of 4 KB each, ``rows`` at most."""

    table: DataFrame
    rows: int


def _places(hashed: Column, rows: int) -> tuple[Column, Column]:
    at = F.pmod(hashed, F.lit(rows * ROW))
    return F.floor(at / ROW).cast("int"), F.pmod(at, F.lit(ROW))


def key_bits(keys: DataFrame, *columns: str, a_key: int = 16, most_rows: int = 1 << 14, hashed: Column | None = None) -> Bits:
    """The filter of the values of ``columns``, or of the hash ``hashed``: ``a_key`` bits for each row, at most ``most_rows`` rows of 4 KB (64 MB), whatever the table's size.

    The bound makes it safe to broadcast. Beyond 33 million keys it lets through more and more, so that joins behind it
    move more, and give the same rows.
    """
    keys = keys.select((F.xxhash64(*columns) if hashed is None else hashed).alias("_h"))
    rows = min(most_rows, 1 << max(0, (-(-keys.count() * a_key // ROW) - 1)).bit_length())
    row, bit = _places(F.col("_h"), rows)
    placed = keys.select(row.alias("_row"), bit.alias("_bit")).repartition("_row")
    return Bits(stored(placed.groupBy("_row").agg(F.bitmap_construct_agg("_bit").alias("_bits"))), rows)


def marked(df: DataFrame, bits: Bits, name: str, *columns: str | Column) -> DataFrame:
    """``df`` with ``name``: false if the values of ``columns`` are surely not among the keys. No shuffle."""
    row, bit = _places(F.xxhash64(*columns), bits.rows)
    placed = df.withColumns({"_row": row, "_bit": bit}).join(F.broadcast(bits.table), "_row", "left")
    byte = F.ascii(F.decode(F.substring("_bits", (F.floor(F.col("_bit") / 8) + 1).cast("int"), F.lit(1)), "ISO-8859-1"))
    return placed.withColumn(name, F.coalesce(F.getbit(byte, F.pmod("_bit", F.lit(8)).cast("int")) == 1, F.lit(False))).drop("_row", "_bit", "_bits")


def maybe_in(df: DataFrame, bits: Bits, *columns: str | Column) -> DataFrame:
    """Rows of ``df`` whose values of ``columns`` may be among the keys: all that are, and a few others."""
    return marked(df, bits, "_maybe", *columns).where("_maybe").drop("_maybe")
