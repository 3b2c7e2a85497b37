"""Tables in, with contracts; tables out, by key."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class ContractError(ValueError):
    """A table breaks what was agreed on it."""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str | StructType, required: tuple[str, ...] = ()) -> DataFrame:
    """A CSV with a header and a given schema: nothing is inferred."""
    frame = spark.read.csv(path, schema=schema, header=True, enforceSchema=False)
    if missing := set(required) - set(frame.columns):
        raise ContractError(f"missing columns: {sorted(missing)}")
    return frame


def truthy(column: Column) -> Column:
    """1, true and yes in any case as true; other values and null as false."""
    return F.coalesce(F.lower(F.trim(column.cast("string"))).isin("1", "true", "yes", "1.0"), F.lit(False))


def check_unique(frame: DataFrame, *key: str) -> DataFrame:
    """``frame``, if no key repeats; one aggregation decides."""
    if frame.groupBy(*key).count().where("count > 1").limit(1).count():
        raise ContractError(f"repeated {key}")
    return frame


def check_counts(frame: DataFrame, column: str, expected: dict[str, int]) -> DataFrame:
    """``frame``, if each expected group has its number of rows and no other group is there."""
    found = dict(frame.groupBy(column).count().limit(len(expected) + 1).collect())
    if found != expected:
        raise ContractError(f"{column}: {found} instead of {expected}")
    return frame


def check_finite(frame: DataFrame, *columns: str) -> DataFrame:
    """``frame``, if no value is null, NaN or infinite; one pass over all columns."""
    bad = frame.agg(*[F.count_if(~finite(F.col(c))).alias(c) for c in columns]).first().asDict()
    if any(bad.values()):
        raise ContractError(f"not finite: {({c: n for c, n in bad.items() if n})}")
    return frame


def width_report(frame: DataFrame, widths: dict[str, int]) -> DataFrame:
    """column, n, wrong_width, only_zeros, not_finite: of array columns, how many rows break the contract; one pass."""
    per = []
    for c, width in widths.items():
        odd = F.exists(c, lambda v: ~finite(v))
        zeros = F.size(c) > 0, F.forall(c, lambda v: v == 0)
        bad = (F.col(c).isNull() | (F.size(c) != width), zeros[0] & zeros[1], odd)
        per.append(F.struct(F.lit(c).alias("column"), F.count("*").alias("n"), *[F.count_if(F.coalesce(b, F.lit(False))).alias(name) for b, name in zip(bad, ("wrong_width", "only_zeros", "not_finite"), strict=True)]))
    return frame.agg(F.array(*per).alias("_r")).select(F.explode("_r").alias("_r")).select("_r.*")


def check_widths(frame: DataFrame, widths: dict[str, int]) -> DataFrame:
    """``frame``, if each array column has its width in every row, no row of zeros alone, and finite values."""
    if bad := [r.asDict() for r in width_report(frame, widths).where("wrong_width + only_zeros + not_finite > 0").collect()]:
        raise ContractError(f"arrays: {bad}")
    return frame


def finite(column: Column) -> Column:
    return column.isNotNull() & ~F.isnan(column) & (F.abs(column) != F.lit(float("inf")))


def complete_cases(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.where(reduce(Column.__and__, [finite(F.col(c)) for c in columns]))


def upsert(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """``old`` with the rows of each key in ``new`` replaced by those of ``new``."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new, allowMissingColumns=True)


def missing_keys(work: DataFrame, done: DataFrame, *key: str) -> DataFrame:
    """Rows of a work list without a result yet."""
    return work.join(done.select(*key), list(key), "left_anti")


def excluding(frame: DataFrame, key: str, text: str) -> DataFrame:
    """``frame`` without the keys that ``text`` lists (between commas, semicolons or spaces; repeats count once); a key that ``frame`` doesn't have is an error."""
    wanted = list(dict.fromkeys(re.findall(r"[^,;:\s]+", text)))
    if not wanted:
        return frame
    listed = frame.sparkSession.createDataFrame([(w,) for w in wanted], "_key string")
    unknown = [r[0] for r in listed.join(frame.select(F.col(key).cast("string").alias("_key")), "_key", "left_anti").collect()]
    if unknown:
        raise ContractError(f"unknown {key}: {sorted(unknown)}")
    return frame.where(~F.col(key).cast("string").isin(wanted) | F.col(key).isNull())


def backfilled(entries: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """``entries`` with what ``found`` knows: keys that are missing are added, and nulls of those there are filled; other values stay as they are."""
    rest = [c for c in entries.columns if c not in key]
    other = found.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], *[F.col(c).alias(f"_f_{c}") for c in rest])
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)]
    both = entries.withColumn("_there", F.lit(True)).join(other.withColumn("_known", F.lit(True)), on, "full")
    keys = [F.when(F.col("_there"), F.col(k)).otherwise(F.col(f"_k{i}")).alias(k) for i, k in enumerate(key)]
    return both.select(*keys, *[F.coalesce(c, f"_f_{c}").alias(c) for c in rest]).select(*entries.columns)
