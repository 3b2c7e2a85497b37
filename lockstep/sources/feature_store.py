"""Features on disk: a block for each feature and section, with names, a width and a checksum that a reader holds it to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import ContractError, finite


def _digest(place: str, values: str) -> Column:
    """A checksum of a block's rows in any order: the sum of their hashes."""
    return F.sum(F.xxhash64(place, values).cast("decimal(38,0)")).cast("string")


def write_features(frame: DataFrame, path: str, names: dict[str, list[str]], feature: str = "feature", section: str = "section", place: str = "place", values: str = "values") -> None:
    """Rows of (feature, section, place, values) below ``path``, a folder for each feature and section, and beside them ``names`` and a checksum of each block.

    A feature without names, a row of another width than its names, a value that is null or not finite, a null section or place, and a place that
    comes twice are errors, before anything is written. Blocks that are there already are replaced; others stay.
    """
    spark = frame.sparkSession
    rows = frame.select(F.col(feature).alias("feature"), F.col(section).alias("section"), F.col(place).cast("long").alias("place"), F.col(values).cast("array<double>").alias("values"))
    widths = F.map_from_arrays(F.array(*[F.lit(k) for k in names]), F.array(*[F.lit(len(v)) for v in names.values()])) if names else F.lit(None).cast("map<string,int>")
    wrong = ~F.coalesce(F.size("values") == F.try_element_at(widths, F.col("feature")), F.lit(False)) | F.col("section").isNull() | F.col("place").isNull() | F.exists("values", lambda v: ~finite(v))
    blocks = rows.groupBy("feature", "section").agg(F.count("*").alias("n"), F.count_if(F.coalesce(wrong, F.lit(True))).alias("wrong"), F.count_distinct("place").alias("places"), _digest("place", "values").alias("digest"))
    if bad := [(r.feature, r.section) for r in blocks.where("wrong > 0 or places < n").select("feature", "section").limit(20).collect()]:
        raise ContractError(f"blocks that break the contract: {bad}")
    write = lambda d, where: d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("feature", "section").parquet(where)
    write(rows, f"{path}/blocks")
    write(blocks.select("feature", "section", "n", "digest"), f"{path}/digests")
    listed = [(k, i, n) for k, v in names.items() for i, n in enumerate(v)]
    spark.createDataFrame(listed, "feature string, position int, name string").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("feature").parquet(f"{path}/names")


def read_features(spark: SparkSession, path: str, features: list[str], sections: list | None = None) -> DataFrame:
    """The blocks of ``features`` (and ``sections``), from their folders alone: feature, section, place, values.

    A feature without a block in one of the sections, and a block that isn't what its checksum was made from, are errors.
    """
    chosen = F.col("feature").isin(features) if sections is None else F.col("feature").isin(features) & F.col("section").isin(sections)
    rows, digests = spark.read.parquet(f"{path}/blocks").where(chosen), spark.read.parquet(f"{path}/digests").where(chosen)
    now = rows.groupBy("feature", "section").agg(F.count("*").alias("m"), _digest("place", "values").alias("now"))
    held = digests.join(now, ["feature", "section"], "full").where("not (n <=> m and digest <=> now)").select("feature", "section").limit(20).collect()
    if held:
        raise ContractError(f"blocks that aren't what was written: {[tuple(r) for r in held]}")
    wanted = digests.select("section").distinct() if sections is None else spark.createDataFrame([(s,) for s in sections], digests.select("section").schema)
    every = wanted.join(spark.createDataFrame([(f,) for f in features], "feature string"))
    if missing := every.join(digests, ["feature", "section"], "left_anti").limit(20).collect():
        raise ContractError(f"no block of {[(r.feature, r.section) for r in missing]}")
    return rows.select("feature", "section", "place", "values")


def feature_names(spark: SparkSession, path: str, feature: str) -> list[str]:
    """The names of a feature's columns, in order."""
    return [r.name for r in spark.read.parquet(f"{path}/names").where(F.col("feature") == feature).orderBy("position").collect()]
