"""Scalar functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column, least: float = 1e-12) -> Column:
    """num/den, null where the denominator is next to 0."""
    return F.when(F.abs(den) > least, num / den)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null if either has norm 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return ratio(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def rmse(a: Column, b: Column, least: int = 4) -> Column:
    """Root mean square difference over positions where both are there, if these are ``least`` or more."""
    gaps = F.filter(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), lambda v: v.isNotNull() & ~F.isnan(v))
    return F.when(F.size(gaps) >= least, F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v) / F.size(gaps)))


def gate(value: Column) -> Column:
    """good from 0.5, fair from 0.3, else poor; unknown for null or NaN."""
    return F.when(value.isNull() | F.isnan(value), "unknown").when(value >= 0.5, "good").when(value >= 0.3, "fair").otherwise("poor")


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def age_years(text: Column) -> Column:
    """Years;months, with full-width signs too, as years; a plain number as it is; else null."""
    plain = F.translate(F.trim(text), "；：:，,", ";;;..")
    years, months = F.regexp_extract(plain, r"^(\d+);(\d+)$", 1), F.regexp_extract(plain, r"^(\d+);(\d+)$", 2)
    return F.when(years != "", years.cast("double") + months.cast("double") / 12).otherwise(plain.try_cast("double"))


def trailing_tone(text: Column) -> tuple[Column, Column]:
    """A phone without its tone digit, and the digit (null if there is none)."""
    digit = F.regexp_extract(text, "([1-5])$", 1)
    return F.regexp_replace(text, "[1-5]$", ""), F.when(digit != "", digit.cast("int"))


#: Contours at the end of a phone, and the tones they stand for.
CONTOURS = {"˨˩˦": 3, "˧˥": 2, "˥˩": 4, "˥": 1, "˧": 5, "˩": 3}
#: Labels of silence, in lower case.
SILENCE = ["", "sil", "sp", "spn", "pau", "<unk>", "unk"]


def longest_suffix(text: Column, suffixes: dict[str, int]) -> tuple[Column, Column]:
    """``text`` without the longest of ``suffixes`` that ends it, and what that stands for (null if none does)."""
    length, value = F.lit(0), F.lit(None).cast("int")
    for suffix, means in sorted(suffixes.items(), key=lambda x: len(x[0])):
        ends = F.endswith(text, F.lit(suffix))
        length, value = F.when(ends, len(suffix)).otherwise(length), F.when(ends, means).otherwise(value)
    return F.substring(text, F.lit(1), F.length(text) - length), value


def phone_and_tone(label: Column) -> tuple[Column, Column]:
    """A phone without its tone, and the tone: a digit from 1 to 5, else the longest contour at its end. Silence, null too, is ``sil`` without a tone."""
    text = F.trim(F.coalesce(label, F.lit("")))
    quiet = F.lower(text).isin(SILENCE)
    by_digit, digit = trailing_tone(text)
    by_contour, contour = longest_suffix(text, CONTOURS)
    phone = F.when(quiet, "sil").when(digit.isNotNull(), by_digit).otherwise(by_contour)
    return phone, F.when(~quiet, F.coalesce(digit, contour))


def list_items(text: Column) -> Column:
    """Items between commas, semicolons, colons or spaces, trimmed, none empty, repeats out, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(text, r"[,;:\s]+"), F.trim), lambda x: x != ""))


def one_hot(value: Column, levels: int) -> Column:
    """Array of 0 and 1 for levels 1 to ``levels``; a last place for any other value."""
    known = F.transform(F.sequence(F.lit(1), F.lit(levels)), lambda k: F.coalesce((value == k).cast("int"), F.lit(0)))
    return F.concat(known, F.array(F.lit(1) - F.aggregate(known, F.lit(0), lambda s, v: s + v)))


def modal_index(values: Column) -> Column:
    """Position (from 1) of the first largest element."""
    return F.array_position(values, F.array_max(values))


def hash_unit(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts: the same on any engine and in any run."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def log_grid(low: float, high: float, step: float) -> list[float]:
    """Powers of ten from 10^low to 10^high."""
    return [10 ** (low + step * k) for k in range(round((high - low) / step) + 1)]
