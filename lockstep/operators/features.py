"""Columns of designs: families, sub-families, screens, reference levels, evidence, and what names and intervals are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .decoding import level_index
from .summaries import merge_rare

#: Initials of syllables; those of two letters come first.
INITIALS = ["zh", "ch", "sh", "b", "p", "m", "f", "d", "t", "n", "l", "g", "k", "h", "j", "q", "x", "r", "z", "c", "s", "y", "w"]


def family_of(column: Column, families: dict[str, int], tail: str = "nuisance") -> tuple[Column, Column]:
    """The family of a flat column number (from 0), and its place in that family (from 0). Columns behind the families are ``tail``; null for null and negative numbers."""
    name, place, at = F.lit(tail), column, 0
    ends = []
    for family, size in families.items():
        ends.append((at, at + size, family))
        at += size
    name, place = F.when(column >= at, tail), F.when(column >= at, column - at)
    for low, high, family in ends:
        inside = (column >= low) & (column < high)
        name, place = name.when(inside, family), place.when(inside, column - low)
    return name, place


def subset_sums(long: DataFrame, key: list[str], column: str, value: str, subsets: DataFrame) -> DataFrame:
    """``key``, subset, total, n: the sum of ``value`` over the columns of each of ``subsets`` (subset, column), which may share columns. Columns without a value don't count."""
    return long.join(subsets.select("subset", F.col("column").alias(column)).distinct(), column).groupBy(*key, "subset").agg(F.sum(value).alias("total"), F.count(value).alias("n"))


def window_means(scores: DataFrame, key: list[str], time: str, column: str, family: str, value: str, first: float, last: float) -> DataFrame:
    """``key``, family, column, mean over the times from ``first`` to ``last``: of each column, and, as column 0, of the family's trace, the sum of its columns at a time.

    Columns count from 1. A null value makes no trace.
    """
    inside = scores.where(F.col(time).between(first, last))
    one = inside.groupBy(*key, F.col(family).alias("family"), F.col(column).cast("int").alias("column")).agg(F.avg(value).alias("mean"))
    trace = inside.groupBy(*key, F.col(family).alias("family"), time).agg(F.sum(value).alias("_t")).groupBy(*key, "family").agg(F.avg("_t").alias("mean"))
    return one.unionByName(trace.withColumn("column", F.lit(0)))


def kept_columns(long: DataFrame, column: str, value: str, dropped: list[str] | None = None, least_sd: float = 1e-8, least_ones: int = 10) -> DataFrame:
    """``column``, n, sd, binary, kept: columns with spread; of those that hold 0 and 1 alone, only those with ``least_ones`` ones; and none of ``dropped``. Values that aren't finite don't count."""
    x = F.when(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) < float("inf")), F.col(value).cast("double"))
    is_bit = F.abs(x * (x - 1)) < 1e-8
    s = long.groupBy(column).agg(F.count(x).alias("n"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("sd"), F.coalesce(F.min(is_bit), F.lit(False)).alias("binary"), F.count_if(x > 0.5).alias("_ones"))
    ok = (F.col("n") > 0) & (F.col("sd") >= least_sd) & (~F.col("binary") | (F.col("_ones") >= least_ones)) & ~F.col(column).isin(dropped or [])
    return s.withColumn("kept", ok).drop("_ones")


def reference_levels(frame: DataFrame, level: str, least: int, other: str = "other") -> DataFrame:
    """``frame`` with rare levels as ``other`` and ``coded``: the level, but null for the most frequent one (ties: the smallest), which a full-rank design leaves out."""
    merged = merge_rare(frame, level, least, other)
    top = merged.groupBy(level).count().agg(F.min_by(level, F.struct(-F.col("count"), F.col(level))).alias("_top"))
    return merged.join(F.broadcast(top)).withColumn("coded", F.when(F.col(level) != F.col("_top"), F.col(level))).drop("_top")


def evidence(frame: DataFrame, target: str, levels: list, probability: str) -> DataFrame:
    """``frame`` with evidence and residual: a class's chances, and its indicator less these, on orthonormal contrasts of each level against those before it.

    Rows of another target or without chances have nulls.
    """
    k = len(levels)
    y = level_index(target, levels)
    p = [F.get(probability, F.lit(i)) for i in range(k)]
    own = [(y == i).cast("double") - p[i] for i in range(k)]

    def contrasts(values: list[Column]) -> Column:
        out = []
        for j in range(1, k):
            size = (j * (j + 1)) ** 0.5
            out.append(sum((values[i] / size for i in range(j)), F.lit(0.0)) - values[j] * (j / size))
        return F.array(*out)

    known = y.isNotNull() & F.col(probability).isNotNull()
    return frame.withColumns({"evidence": F.when(known, contrasts(p)), "residual": F.when(known, contrasts(own))})


def without_largest(frame: DataFrame, group: str) -> DataFrame:
    """``frame`` without the rows of the group that has most (ties: the smallest); rows without a group stay."""
    top = frame.where(F.col(group).isNotNull()).groupBy(group).count().agg(F.min_by(group, F.struct(-F.col("count"), F.col(group))).alias("_top"))
    return frame.join(F.broadcast(top)).where(~F.col(group).eqNullSafe(F.col("_top"))).drop("_top")


def syllable_parts(syllable: Column) -> tuple[Column, Column, Column]:
    """Initial, final and tone of a syllable with a tone digit: the longest initial that leaves a final; an umlaut counts as v. No digit is no tone."""
    text = F.regexp_replace(F.regexp_replace(F.lower(F.trim(syllable)), "u:", "v"), "ü", "v")
    body = F.regexp_replace(text, "[1-5]$", "")
    digit = F.regexp_extract(text, "([1-5])$", 1)
    initial = F.lit("")
    for part in reversed(INITIALS):
        initial = F.when(F.startswith(body, F.lit(part)) & (F.length(body) > len(part)), part).otherwise(initial)
    return initial, F.substring(body, F.length(initial) + 1, F.length(body)), F.when(digit != "", digit.cast("int"))


def in_seconds(start: Column, end: Column, rate: float, samples: Column) -> tuple[Column, Column]:
    """Both ends of an interval in seconds, in order: numbers beyond twice the duration of ``samples`` samples are numbers of samples."""
    scale = F.when(F.greatest(F.abs(start), F.abs(end)) > samples / rate * 2, rate).otherwise(1.0)
    return F.least(start, end) / scale, F.greatest(start, end) / scale


def most_extreme(frame: DataFrame, value: str, n: int, *ties: str) -> DataFrame:
    """The ``n`` rows of the largest \\|value\\|, with their rank; ties by the columns ``ties``. Nulls have no rank."""
    order = [F.desc(F.abs(F.col(value))), *ties]
    few = frame.where(F.col(value).isNotNull()).orderBy(*order).limit(n)
    return few.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
