"""Words, tokens and phones put side by side; tables of them put together."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import largest_overlap
from .summaries import average_ranks

#: Letters that begin the tags of content words.
CONTENT = ("n", "v", "a", "m", "q", "i")


def offsets(frame: DataFrame, key: list[str], by: str, text: str, gap: int) -> DataFrame:
    """``on`` and ``off`` of each piece in the text that its key's pieces make, ``gap`` characters apart."""
    w = Window.partitionBy(*key).orderBy(by)
    end = F.sum(F.char_length(text) + gap).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return frame.withColumn("off", end - gap).withColumn("on", F.col("off") - F.char_length(text))


def tokens_to_words(tokens: DataFrame, words: DataFrame, key: list[str], width: int = 16) -> DataFrame:
    """Each token (piece_id, on, off) with the word (span_id, start, end) that holds most of it, the first on ties."""
    return largest_overlap(tokens, words, key, 1, width)


def mapped(frame: DataFrame, column: str, names: DataFrame, code: str, name: str, other: str = "unknown") -> DataFrame:
    """``column`` by its name in a table of codes; ``other`` where there is none."""
    codes = names.select(F.col(code).alias("_code"), F.col(name).alias("_name"))
    return frame.join(codes, F.col(column) == F.col("_code"), "left").withColumn(column, F.coalesce("_name", F.lit(other))).drop("_code", "_name")


def first_given(frame: DataFrame, own: DataFrame, shared: DataFrame, own_key: list[str], key: list[str], value: str) -> DataFrame:
    """``value`` from a participant's ``own`` table, else from the ``shared`` one, and ``source``: which of them gave it."""
    mine = own.select(*own_key, F.col(value).alias("_own"))
    all_ = shared.select(*key, F.col(value).alias("_shared"))
    both = frame.join(mine, own_key, "left").join(all_, key, "left")
    source = F.when(F.col("_own").isNotNull(), "own").when(F.col("_shared").isNotNull(), "shared")
    return both.withColumn(value, F.coalesce("_own", "_shared")).withColumn("source", source).drop("_own", "_shared")


def context(frame: DataFrame, key: list[str], at: str, value: str, back: int) -> DataFrame:
    """``context``: the values of the rows up to ``back`` before each one, its own included, in order of time."""
    w = Window.partitionBy(*key).orderBy(at).rangeBetween(-back, 0)
    pairs = F.array_sort(F.collect_list(F.struct(F.col(at).alias("t"), F.col(value).alias("v"))).over(w))
    return frame.withColumn("context", F.transform(pairs, lambda p: p["v"]))


def best_span(pattern: DataFrame, text: DataFrame, key: list[str], place: str, token: str) -> DataFrame:
    """Where a list of tokens begins in a longer one: start with the most hits (the first on ties), hits, and their share of the list.

    An equi-join on key and token counts hits by offset; nothing is compared place by place.
    """
    size = pattern.groupBy(*key).agg(F.count("*").alias("_n"))
    hits = pattern.withColumnRenamed(place, "_i").join(text.withColumnRenamed(place, "_j"), [*key, token]).groupBy(*key, (F.col("_j") - F.col("_i")).alias("_at")).agg(F.count("*").alias("hits"))
    best = hits.groupBy(*key).agg(F.max_by(F.struct(F.col("_at").alias("start"), "hits"), F.struct("hits", -F.col("_at"))).alias("_b"))
    return best.join(size, key).select(*key, "_b.start", "_b.hits", (F.col("_b.hits") / F.col("_n")).alias("share"))


def greedy_align(frame: DataFrame, key: list[str], side: str, place: str, token: str, ahead: int = 8) -> DataFrame:
    """Each token of side 0 with the place of its match among those of side 1, in order: the next equal one up to ``ahead`` places on; without one the last match is carried on.

    The state is one place; a key's two lists are one group, so key by section.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(place, kind="stable")
        mine, other = group[group[side] == 0], group[group[side] == 1]
        words, places = other[token].tolist(), other[place].tolist()
        at, last, rows = 0, None, []
        for spot, word in zip(mine[place], mine[token], strict=True):
            hit = next((k for k in range(at, min(at + ahead + 1, len(words))) if words[k] == word), None)
            if hit is not None:
                last, at = places[hit], hit + 1
            rows.append((spot, last, hit is not None))
        out = pd.DataFrame(rows, columns=["place", "match", "exact"])
        for k in key:
            out[k] = group[k].iloc[0]
        return out[[*key, "place", "match", "exact"]].astype({"match": "Int64"})

    kinds = ", ".join(f"{k} {frame.schema[k].dataType.simpleString()}" for k in key)
    return frame.groupBy(*key).applyInPandas(run, f"{kinds}, place long, match long, exact boolean")


def content_word(tag: Column) -> Column:
    """Whether a part-of-speech tag is that of a content word."""
    return F.coalesce(F.lower(F.left(tag, F.lit(1))).isin(*CONTENT), F.lit(False))


def han(text: Column) -> Column:
    """The characters U+4E00 to U+9FFF of a text, in order."""
    return F.regexp_extract_all(text, F.lit("([\\u4E00-\\u9FFF])"), F.lit(1))


def canonical(frame: DataFrame, column: str, inventory: DataFrame, entry: str) -> DataFrame:
    """``canonical``: the longest entry of an inventory that the text begins with, else null.

    Each distinct text meets the inventory by its beginnings, no longer than the longest entry: an equi-join, however large the inventory.
    """
    entries = inventory.select(F.col(entry).alias("_e")).where("_e <> ''").distinct()
    longest = entries.agg(F.max(F.char_length("_e")).alias("_m"))
    texts = frame.select(F.col(column).alias("_text")).where("_text <> ''").distinct().join(F.broadcast(longest)).where("_m is not null")
    starts = texts.select("_text", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.char_length("_text"), F.col("_m"))), lambda k: F.left("_text", k))).alias("_e"))
    found = starts.join(entries, "_e").groupBy("_text").agg(F.max_by("_e", F.char_length("_e")).alias("canonical"))
    return frame.join(found, F.col(column) == F.col("_text"), "left").drop("_text")


def occupancy(pieces: DataFrame, key: list[str], level: str, levels: list[str], on: str, off: str) -> DataFrame:
    """Share of a key's whole time that each level takes; levels beyond ``levels`` are ``other``."""
    named = pieces.withColumn(level, F.when(F.col(level).isin(*levels), F.col(level)).otherwise("other"))
    wide = named.groupBy(*key).pivot(level, [*levels, "other"]).agg(F.sum(F.col(off) - F.col(on)))
    whole = sum((F.coalesce(F.col(c), F.lit(0)) for c in (*levels, "other")), F.lit(0))
    return wide.select(*key, *[F.when(whole > 0, F.coalesce(F.col(c), F.lit(0)) / whole).alias(c) for c in (*levels, "other")])


def same_axis(frame: DataFrame, key: list[str], at: str) -> DataFrame:
    """key, points, same: whether each key has the grid of times that most keys have, told by number and hash of its times."""
    axis = frame.select(*key, at).distinct().groupBy(*key).agg(F.count("*").alias("points"), F.sum(F.xxhash64(at).cast("decimal(38,0)")).alias("_grid"))
    common = axis.groupBy("points", "_grid").agg(F.count("*").alias("_n")).agg(F.max_by(F.struct("points", "_grid"), F.struct("_n", "points", "_grid")).alias("_c"))
    return axis.join(F.broadcast(common)).select(*key, "points", (F.struct("points", "_grid") == F.col("_c")).alias("same"))


def inventory(expected: DataFrame, found: DataFrame, key: list[str], size: str) -> DataFrame:
    """Expected sizes against found ones: key, expected, found, problem (missing, size, extra, or null)."""
    a, b = expected.select(*key, F.col(size).alias("expected")), found.select(*key, F.col(size).alias("found"))
    both = a.join(b, key, "full")
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "extra").when(F.col("expected") != F.col("found"), "size")
    return both.withColumn("problem", problem)


def nearest_sample(wanted: DataFrame, axis: DataFrame, at: str, index: str, most: int = 1 << 16) -> DataFrame:
    """The samples of a short time axis that are nearest to the wanted times, each once; times outside the axis drop out.

    The axis travels with the times: more than ``most`` samples are an error (``joins.nearest_in_time`` takes any number).
    """
    if axis.limit(most + 1).count() > most:
        raise ValueError(f"an axis of more than {most} samples")
    whole = axis.agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("t"), F.col(index).alias("i")))).alias("_axis"))
    inside = wanted.join(F.broadcast(whole)).where((F.col(at) >= F.array_min("_axis.t")) & (F.col(at) <= F.array_max("_axis.t")))
    best = F.array_min(F.transform("_axis", lambda p: F.struct(F.abs(p["t"] - F.col(at)).alias("d"), p["i"].alias("i"))))
    return inside.select(best["i"].alias(index)).distinct()


def long_metrics(frame: DataFrame, key: list[str], metrics: list[str], name: str, value: str) -> DataFrame:
    return frame.unpivot(key, metrics, name, value)


def rank_grid(left: DataFrame, right: DataFrame, unit: str, least: int) -> DataFrame:
    """Spearman's rho of every metric of ``left`` with every one of ``right`` (unit, metric, value), over units that have both, if these are ``least`` or more."""
    ranks = lambda frame, m, r: frame.where("value is not null").select(unit, F.col("metric").alias(m), F.col("value").alias(f"_{r}"))
    both = ranks(left, "score", "x").join(ranks(right, "behaviour", "y"), unit)
    pair = ["score", "behaviour"]
    ranked = average_ranks(average_ranks(both, pair, "_x", "_rx"), pair, "_y", "_ry")
    return ranked.groupBy(*pair).agg(F.corr("_rx", "_ry").alias("rho"), F.count("*").alias("n")).where(F.col("n") >= least)


def textgrid_intervals(files: DataFrame, content: str, tier: str) -> DataFrame:
    """Intervals of one tier of annotation files, long or short form: all other columns, n (from 1), on, off, label.

    A double quote in a label is written twice. A file without the tier gives no rows.
    """
    number, label = r"([-+]?\d+(?:\.\d*)?(?:[eE][-+]?\d+)?)", r'"((?:[^"]|"")*)"'
    text = F.regexp_replace(content, "\r", "")
    body = F.regexp_extract(text, rf'(?s)"IntervalTier"\s*(?:name\s*=\s*)?"{tier}"(.*?)(?:"(?:IntervalTier|TextTier)"|$)', 1)
    head = F.regexp_replace(body, rf"^\s*(?:xmin\s*=\s*)?{number}\s*(?:xmax\s*=\s*)?{number}\s*(?:intervals:\s*size\s*=\s*)?\d+", "")
    row = rf"(?:xmin\s*=\s*)?{number}\s+(?:xmax\s*=\s*)?{number}\s+(?:text\s*=\s*)?{label}"
    cells = F.arrays_zip(*[F.regexp_extract_all(head, F.lit(row), F.lit(k)).alias(n) for k, n in ((1, "on"), (2, "off"), (3, "label"))])
    rows = files.select(*[c for c in files.columns if c != content], F.posexplode(cells).alias("n", "c"))
    return rows.select("*", F.col("c.on").cast("double").alias("on"), F.col("c.off").cast("double").alias("off"), F.replace(F.col("c.label"), F.lit('""'), F.lit('"')).alias("label")).drop("c").withColumn("n", F.col("n") + 1)


def bracket_terminals(frame: DataFrame, key: list[str], text: str) -> DataFrame:
    """Terminals of bracketed trees, one tree a row: ``key``, place (from 0), word, n_opening, n_closing, depth, n_open_nodes, linear_order, is_end.

    Tokens are brackets and runs of other characters than white space; the one after an opening bracket is a label. n_opening
    counts the opening brackets since the terminal before, n_closing the closing ones right after; depth is before these, n_open_nodes after.
    A closing bracket at depth 0 counts as none. Trees are told apart by ``key``, which is unique; null or empty texts give no rows.
    """
    tokens = frame.select(*key, F.posexplode(F.regexp_extract_all(text, F.lit(r"([()]|[^ \t\r\n()]+)"), F.lit(1))).alias("_i", "_t"))
    w = Window.partitionBy(*key).orderBy("_i")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    opens, closes = F.col("_t") == "(", F.col("_t") == ")"
    word = ~opens & ~closes & (F.coalesce(F.lag("_t").over(w), F.lit("")) != "(")
    level = tokens.withColumn("_word", word).withColumn("_s", F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(so_far))
    # A running sum that stops at 0: less its least value so far, if that is below 0.
    level = level.withColumn("_d", F.col("_s") - F.least(F.lit(0), F.min("_s").over(so_far))).withColumn("_o", F.sum(opens.cast("int")).over(so_far))
    # Closing brackets since the last other token: a run's number is the count of other tokens up to it.
    level = level.withColumn("_run", F.sum((~closes).cast("int")).over(so_far))
    run = Window.partitionBy(*key, "_run")
    level = level.withColumn("_closing", F.count_if(closes).over(run)).withColumn("_after", F.greatest(F.lit(0), F.col("_d") - F.col("_closing")))
    kept = level.where("_word").withColumns({"place": F.row_number().over(w) - 1, "_m": F.count("*").over(Window.partitionBy(*key)), "n_opening": F.col("_o") - F.coalesce(F.lag("_o").over(w), F.lit(0))})
    return kept.select(
        *key, "place", F.col("_t").alias("word"), F.col("n_opening").cast("long"), F.col("_closing").cast("long").alias("n_closing"), (F.col("_after") + F.col("_closing")).cast("long").alias("depth"),
        F.col("_after").cast("long").alias("n_open_nodes"), (F.col("place") / F.greatest(F.col("_m") - 1, F.lit(1))).alias("linear_order"), (F.col("place") == F.col("_m") - 1).alias("is_end"),
    )


def word_vectors(lines: DataFrame, line: str, order: str, vocabulary: DataFrame, word: str, width: int) -> DataFrame:
    """``word`` and ``vector`` from lines of a word and its numbers: the words of ``vocabulary``, each by its first line in ``order`` that has ``width`` finite numbers.

    The semi-join with the vocabulary comes before the numbers are read. Numbers beyond ``width`` are left; null lines, and lines with too few or other than numbers, give no rows.
    """
    parts = lines.where(F.trim(line) != "").select(F.col(order).alias("_o"), F.split(F.trim(line), " ").alias("_p"))
    wanted = parts.withColumn(word, F.col("_p")[0]).join(vocabulary.select(word).distinct(), word, "left_semi")
    numbers = F.transform(F.slice("_p", 2, width), lambda v: v.try_cast("float"))
    whole = wanted.withColumn("vector", numbers).where((F.size("vector") == width) & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    return whole.groupBy(word).agg(F.min_by("vector", "_o").alias("vector"))
