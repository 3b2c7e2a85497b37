"""Spelling variants: words one edit apart, found by a trie over counts of letter groups."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, stored, text_slices, utf8

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_RUNS = re.compile("[a-zÀ-ÿ]+").findall
#: Groups of letters (by code point), and how many of them may be part of a key: 8 bits each, below 16 bits of length.
GROUPS, KEYED, MOST_LENGTH = 12, 6, 32767
#: Parts of one node that take each a share of the words that look into it.
PARTS = 4
#: Numbers in one table of letters.
CELLS = 1 << 22


def count_words(docs: DataFrame, least: int = 7, every: int = 31, held: int = 200_000) -> DataFrame:
    """word, n: lower-cased runs of letters of ``docs`` (doc_id, text) with ``least`` code points or more, over all documents.

    Where ``every`` divides the checksum h of ``<doc_id>:<run>``, the run loses its code point number h modulo its length, in all its places in the
    document. A null text has no runs; a null doc_id reads ``null``.
    """

    def flushed(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for part in text_slices(batch, "text"):
                for doc_id, text in zip(part.column("doc_id").to_pylist(), utf8(part.column("text")), strict=True):
                    start = zlib.crc32(f"{'null' if doc_id is None else doc_id}:".encode())
                    for word, n in Counter(_RUNS(text.translate(_LOWER).decode("utf-8", "replace"))).items():
                        if len(word) >= least:
                            h = zlib.crc32(word.encode(), start)
                            if h % every == 0:
                                at = h % len(word)
                                word = word[:at] + word[at + 1 :]
                                if len(word) < least:
                                    continue
                            counts[word] += n
                if len(counts) > held:
                    yield flushed(counts)
                    counts.clear()
        yield flushed(counts)

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def by_cells(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Places of words, the shorter ones first, in groups whose table of letters has ``CELLS`` numbers at most (or one word)."""
    order, at = np.argsort(lengths, kind="stable"), 0
    while at < len(order):
        end = min(len(order), at + max(1, CELLS // max(1, int(lengths[order[at]]))))
        while end - at > 1 and (end - at) * int(lengths[order[end - 1]]) > CELLS:
            end = at + (end - at) // 2
        yield order[at:end]
        at = end


def letters(words: np.ndarray) -> np.ndarray:
    """Code points, a row for each word, 0 behind its end and one 0 at least."""
    wide = words.astype(f"<U{max(1, words.dtype.itemsize // 4) + 1}")
    return wide.view(np.uint32).reshape(len(words), -1)


def group_counts(table: np.ndarray) -> np.ndarray:
    """The frequency vector of each word: its length, then how many of its letters are in each group."""
    group = np.where(table > 0, table % GROUPS, GROUPS)
    return np.column_stack([(table > 0).sum(axis=1), *((group == g).sum(axis=1) for g in range(GROUPS))]).astype(np.int64)


def keys_of(vectors: np.ndarray, depth: int) -> np.ndarray:
    """The trie node of a vector after its length and ``depth`` groups, as one number."""
    out = np.minimum(vectors[..., 0], MOST_LENGTH)
    for g in range(depth):
        out = (out << 8) | np.minimum(vectors[..., 1 + g], 255)
    return out


def probes(vectors: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vector looks into which node: its own, those of words as long and further on, and those of words one shorter.

    A word one edit away has at most one letter more in some group and one less in another. Nodes of equally long words are
    visited from one side only.
    """
    units = np.eye(1 + depth, dtype=np.int64)[1:]
    shorter = np.r_[1, np.zeros(depth, np.int64)]
    same = [np.zeros(1 + depth, np.int64), *units, *(-u for u in units), *(u - v for u in units for v in units if (u != v).any())]
    steps = np.array([*(s for s in same if tuple(s) >= (0,) * len(s)), -shorter, *(-shorter - u for u in units)])
    moved = vectors[:, None, : 1 + depth] + steps
    key = np.where((moved >= 0).all(axis=2), keys_of(moved, depth), -1)
    key.sort(axis=1)
    key[:, 1:][key[:, 1:] == key[:, :-1]] = -1
    of, at = np.nonzero(key >= 0)
    return of, key[of, at]


class Trie:
    """Words by successive counts, below the nodes that they were dealt to."""

    def __init__(self, words: np.ndarray, nodes: np.ndarray):
        self.table = letters(words)
        self.vectors = group_counts(self.table)
        levels = np.column_stack([nodes, self.vectors])
        self.order = np.lexsort(levels.T[::-1])
        levels = levels[self.order]
        self.span = int(levels[:, 1:].max(initial=0)) + 2
        self.roots, parent = np.unique(levels[:, 0], return_inverse=True)
        self.children: list[np.ndarray] = []
        for count in levels.T[1:]:
            found, parent = np.unique(parent * self.span + count, return_inverse=True)
            self.children.append(found)
        self.first = np.searchsorted(parent, np.arange(len(self.children[-1]) + 1))

    def search(self, vectors: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries and leaves: all paths that spend at most one surplus and one deficit, the length's difference among them."""
        at = np.searchsorted(self.roots, nodes)
        known = np.flatnonzero((at < len(self.roots)) & (self.roots[np.minimum(at, len(self.roots) - 1)] == nodes))
        # more, less: letters that the words of a node may still have beyond the query's, and lack
        q, node, more, less = known, at[known], np.ones(len(known), np.int8), np.ones(len(known), np.int8)
        for level, children in enumerate(self.children):
            parts = []
            for step in (-1, 0) if level == 0 else (-1, 0, 1):
                may = np.flatnonzero((step == 0) | ((less if step < 0 else more) > 0)) if level else np.arange(len(q))
                key = node[may] * self.span + vectors[q[may], level] + step
                key[(vectors[q[may], level] + step < 0) | (vectors[q[may], level] + step >= self.span)] = -1
                child = np.minimum(np.searchsorted(children, key), len(children) - 1)
                hit = children[child] == key
                may, child = may[hit], child[hit]
                if level == 0:  # words one shorter lack a letter and have none in its place
                    parts.append((q[may], child, more[may] + step, less[may]))
                else:
                    parts.append((q[may], child, more[may] - (step > 0), less[may] - (step < 0)))
            q, node, more, less = (np.concatenate(x) for x in zip(*parts, strict=True))
        return q, node

    def near(self, table: np.ndarray, q: np.ndarray, leaf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Queries and words exactly one edit apart, among the words of the leaves."""
        sizes = self.first[leaf + 1] - self.first[leaf]
        width = max(table.shape[1], self.table.shape[1])
        queries, own = (np.pad(t, ((0, 0), (0, width - t.shape[1]))) for t in (table, self.table))
        ends, at, step = np.cumsum(sizes), 0, max(1, CELLS // width)
        while at < len(q):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + step, side="right")))
            n, base = sizes[at:end], self.first[leaf[at:end]]
            who = np.repeat(q[at:end], n)
            word = self.order[np.repeat(base - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            at = end
            for k in range(0, len(who), step):  # one leaf may hold more
                a, b = queries[who[k : k + step]], own[word[k : k + step]]
                equal = a == b
                shorter = (b > 0).sum(axis=1) < (a > 0).sum(axis=1)
                first = np.argmin(equal, axis=1)
                moved = np.pad(a[:, 1:], ((0, 0), (0, 1))) == b
                after = np.arange(width) >= first[:, None]
                ok = np.where(shorter, (moved | ~after).all(axis=1), (~equal).sum(axis=1) == 1)
                yield who[k : k + step][ok], word[k : k + step][ok]


def _best(words: np.ndarray, n: np.ndarray, rank: np.ndarray, target: np.ndarray, other: np.ndarray) -> list[pa.Array]:
    """word, k, n, form: for each target how many others there are, and the most frequent (ties: the smallest)."""
    order = np.lexsort([rank[other], -n[other], target])
    target, other = target[order], other[order]
    first = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
    return [pa.array(words[target[first]].tolist(), pa.string()), pa.array(np.diff(np.r_[first, len(target)])), pa.array(n[other[first]]), pa.array(words[other[first]].tolist(), pa.string())]


def _variants(dealt: DataFrame, depth: int) -> DataFrame:
    """word, k, form_n, form: what each word meets in each node, from rows (node, part, query, word, n) sorted by these."""

    def solve(own: list[tuple], asked: list[tuple]) -> Iterator[pa.RecordBatch]:
        """``own``: words of units (a part of a node each), ``asked``: words that look into them; of each (unit, word, n)."""
        if not own or not asked:
            return
        units, words, n = (np.array(x) for x in zip(*own, strict=True))
        trie, weights = Trie(words, units), 3 ** np.arange(depth, -1, -1)
        name = np.array([a[1] for a in asked], object)
        unit, size = (np.array([a[k] for a in asked]) for k in (0, 2))
        for group in by_cells(np.array([len(w) for w in name])):
            here = name[group].astype(str)
            table = letters(here)
            vectors = group_counts(table)
            every, sizes = np.concatenate([here, words]), np.concatenate([size[group], n])
            rank = np.argsort(np.argsort(every, kind="stable"), kind="stable")
            for who, word in trie.near(table, *trie.search(vectors, unit[group])):
                # equally long words meet from the side whose first counts are smaller; those that agree in them ask each other, others are told
                sign = (trie.vectors[word, : 1 + depth] - vectors[who, : 1 + depth]) @ weights
                shorter = trie.vectors[word, 0] < vectors[who, 0]
                who, word, told = (x[shorter | (sign >= 0)] for x in (who, word, shorter | (sign != 0)))
                if len(who):
                    yield pa.RecordBatch.from_arrays(_best(every, sizes, rank, np.r_[who, word[told] + len(here)], np.r_[word + len(here), who[told]]), names=["word", "k", "form_n", "form"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple] = []
        asked: list[tuple] = []
        unit, last, longest = 0, None, 1
        for batch in batches:
            for node, part, query, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (node, part) != last:
                    unit, last = unit + 1, (node, part)
                    if (len(own) + len(asked)) * max(longest, len(word)) > 2 * CELLS or len(own) > 1 << 15:
                        yield from solve(own, asked)
                        own, asked, longest = [], [], 1
                longest = max(longest, len(word))
                if not query:
                    own.append((unit, word, n))
                elif own and own[-1][0] == unit:  # a part without words has nobody to meet
                    asked.append((unit, word, n))
                    if len(asked) * longest > 4 * CELLS:
                        yield from solve(own, asked)
                        own, asked = [o for o in own if o[0] == unit], []
        yield from solve(own, asked)

    return dealt.mapInArrow(run, "word string, k long, form_n long, form string")


def _dealt(words: DataFrame, depth: int) -> DataFrame:
    """node, query, word, n: each word in its own node, and as a query in every node that may hold one near it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every, n = np.array(batch.column("word").to_pylist(), object), batch.column("n").to_numpy()
            for group in by_cells(np.array([len(w) for w in every], np.int64)):
                vectors = group_counts(letters(every[group].astype(str)))
                of, node = probes(vectors, depth)
                here = pa.array(np.r_[group, group[of]])
                columns = [pa.array(np.r_[keys_of(vectors, depth), node]), pa.array(np.r_[np.zeros(len(group), bool), np.ones(len(of), bool)]), batch.column("word").take(here), pa.array(n).take(here)]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "query", "word", "n"])

    return words.mapInArrow(run, "node long, query boolean, word string, n long")


def _own_keys(words: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = np.array(batch.column("word").to_pylist(), object)
            for group in by_cells(np.array([len(w) for w in every], np.int64)):
                vectors = group_counts(letters(every[group].astype(str)))
                yield pa.RecordBatch.from_arrays([pa.array(keys_of(vectors, KEYED)), pa.array(1 + vectors[:, 0] // 16)], names=["node", "weight"])

    return words.mapInArrow(run, "node long, weight long").groupBy("node").agg(F.sum("weight").alias("weight"))


def near_words(words: DataFrame, keep=stored, most: int = 1 << 14) -> DataFrame:
    """word, n_near, form_n, form: how many of ``words`` (word, n; distinct) are exactly one edit away, and the most frequent of them.

    Words are dealt to the nodes of a trie: their length, then the counts of as many letter groups as leave ``most`` words (of 16 letters)
    in a node; a node that no key splits is cut into chunks. A word looks into the nodes that one surplus and one deficit can reach, and there goes down the counts of all groups
    with the same budget. What the leaves hold is verified. Numbers of neighbours leave a node, never pairs.
    """
    sizes = keep(_own_keys(words))
    for depth in range(1, KEYED + 1):
        nodes = sizes.groupBy(F.shiftright("node", 8 * (KEYED - depth)).alias("node")).agg(F.sum("weight").alias("weight"))
        if (largest := nodes.agg(F.max("weight")).first()[0] or 0) <= most:
            break
    rows = _dealt(words, depth).withColumn("chunks", F.lit(1))
    if largest > most:
        large = nodes.where(F.col("weight") > most).select("node", F.ceil(F.col("weight") / most).cast("int").alias("chunks"))
        rows = rows.drop("chunks").join(keep(large), "node", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    hashed = F.xxhash64("word")
    chunk: Column = F.explode(F.when(F.col("query"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(F.pmod(hashed, F.col("chunks")).cast("int"))))
    rows = rows.withColumn("chunk", chunk)
    share = F.explode(F.when(F.col("query"), F.array(F.pmod(F.shiftright(hashed, 20), F.lit(PARTS)).cast("int"))).otherwise(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    rows = rows.withColumn("share", share).select("node", (F.col("chunk") * PARTS + F.col("share")).alias("part"), "query", "word", "n")
    dealt = rows.repartition("node", "part").sortWithinPartitions("node", "part", "query")
    found = _variants(dealt, depth).groupBy("word").agg(F.sum("k").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("n"), "form")).alias("_b"))
    return found.select("word", "n_near", (-F.col("_b.n")).alias("form_n"), "_b.form")


def spelling_variants(docs: DataFrame, least: int = 7, least_n: int = 2, times: int = 10, every: int = 31) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of ``docs`` that ``count_words`` finds ``least_n`` times or more.

    n_near counts the words exactly one inserted, deleted or replaced code point away; form is the most frequent of them (ties: the smallest in
    code-point order) if it comes ``times`` as often as the word, else null; root is where the forms lead to, the word itself without one.

    Null and empty texts have no words; repeated rows count as often as they come; other columns are ignored; an empty table gives no rows.
    """
    with scratch(docs.sparkSession) as keep:
        words = keep(count_words(docs, least, every).where(F.col("n") >= least_n))
        found = words.join(near_words(words, keep), "word", "left")
        is_form = F.col("form_n") >= times * F.col("n")
        every_word = keep(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n")))
        steps = every_word.where("form is not null").select("word", F.col("form").alias("root"))
        while True:  # a form is several times as frequent as its word: the chains are short, and each round doubles the steps
            steps = keep(steps)
            onward = steps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
            jumped = keep(steps.join(onward, "root", "left"))
            if jumped.where("_next is not null").isEmpty():
                break
            steps = jumped.select("word", F.coalesce("_next", "root").alias("root"))
        out = every_word.join(steps, "word", "left").withColumn("root", F.coalesce("root", "word"))
        return stored(out.select("word", "form", "root", "n", "n_near", "form_n"))
