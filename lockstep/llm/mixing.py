"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text, split at ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets per source from its size: source, source_size, weight, target, rate.

    Sources in order of code points, null last, take ``weights`` in turn. Together they get ``share``
    of all sizes by weight; none gets over ``most`` times its size, and what is over goes to the others
    by weight. In order of size/weight those that reach their cap come first: if the first k do, what they
    leave, over the weights of the rest, is the level of the rest. It rises with k up to the right k and falls
    after it, so that its maximum is the level. The windows hold one row for each source, aggregated before. A source of size 0 has target 0 and rate 0.
    """
    by_name, by_level = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("level_at", F.col("source").asc_nulls_last())
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("level_at", F.lit(most) * F.col("source_size") / F.col("weight"))
    run = ranked.select(
        "*",
        (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.lit(most) * F.sum("source_size").over(before), F.lit(0.0))).alias("left"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("weight_left"),
    )
    level = F.max(F.col("left") / F.col("weight_left")).over(every)
    found = run.withColumn("target", F.least(F.lit(most) * F.col("source_size"), level * F.col("weight")))
    return found.select("source", "source_size", "weight", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"))


def copies(rate: Column, doc_id: Column, seed: str) -> Column:
    """floor(rate), and one more with probability of the fraction, by a hash of seed and doc_id."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    uniform = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return (F.floor(rate) + (uniform < rate - F.floor(rate)).cast("long")).cast("int")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """``docs`` with size, source_size, target, rate and the number of copies to emit (``copies``).

    The targets, a row for each source, are written first; Spark then knows their size and broadcasts
    them below its threshold, else it joins by sort-merge and splits a hot source. Columns of ``docs``
    with the names of the new ones are replaced. A null source is a source of its own; a null text has size 0;
    repeated rows are decided alike, as their doc_id is; an empty table gives no rows.
    """
    new = ("size", "source_size", "target", "rate", "copies")
    sized = docs.drop(*new).withColumn("size", word_count(F.col("text")))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(sizes, weights, share, most).drop("weight").withColumnRenamed("source", "_source"))
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    return joined.withColumn("copies", copies(F.col("rate"), F.col("doc_id"), seed))


def emit(mixed: DataFrame) -> DataFrame:
    """Each row as often as its ``copies`` says."""
    return mixed.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("_copy", "size", "source_size", "target", "rate", "copies")
