"""Phones and tones along a sequence: syllables of a word, tones that their neighbours change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequences import Window, ordered

#: The two words whose tone follows the next one.
NOT, ONE = "不", "一"


def syllables(frame: DataFrame, key: list[str], by: list[str], nucleus: Column, coda: Column, out: str = "syllable") -> DataFrame:
    """The syllable of each phone within its key, from 0. Each nucleus has one.

    A phone between two nuclei belongs to the next one, but a coda right after a nucleus stays with it. What stands
    before the first or after the last nucleus belongs to that; without a nucleus, all is one syllable. Null counts as false.
    """
    w = ordered(key, by)
    marked = frame.withColumn("_on", F.coalesce(nucleus, F.lit(False)))
    so_far = F.count_if("_on").over(w.rowsBetween(Window.unboundedPreceding, 0))
    left = F.count_if("_on").over(Window.partitionBy(*key)) - so_far
    stays = F.col("_on") | (left == 0) | (F.coalesce(F.lag("_on").over(w), F.lit(False)) & F.coalesce(coda, F.lit(False)))
    return marked.withColumn(out, F.greatest(F.when(stays, so_far - 1).otherwise(so_far), F.lit(0)).cast("int")).drop("_on")


def surface_tones(frame: DataFrame, key: list[str], by: list[str], word: str, tone: str) -> DataFrame:
    """``frame`` with ``surface``, the tone (1 to 4, null if neutral) as spoken, and ``change``, the rule that made it.

    Two passes, each on the tones that the one before left: the two fixed words follow the next tone, then a third tone before a third becomes a second.
    """
    w = ordered(key, by)
    after = F.lead(tone).over(w)
    first = frame.withColumn("_next", after).withColumn(
        "_first",
        F.when((F.col(word) == NOT) & (F.col("_next") == 4), 2).when((F.col(word) == ONE) & F.col("_next").between(1, 4), F.when(F.col("_next") == 4, 2).otherwise(4)).otherwise(F.col(tone)),
    )
    third = (F.col("_first") == 3) & (F.lead("_first").over(w) == 3)
    spoken = first.withColumn("surface", F.when(third, 2).otherwise(F.col("_first")).cast("int"))
    same = F.col(tone).isNull() | F.col("surface").eqNullSafe(F.col(tone))
    change = (
        F.when(same, "none").when((F.col(word) == NOT) & (F.col("_next") == 4), "not").when((F.col(word) == ONE) & F.col("_next").between(1, 4), "one")
        .when((F.col(tone) == 3) & (F.col("surface") == 2), "third").otherwise("other")
    )
    return spoken.withColumn("change", change).drop("_next", "_first")
