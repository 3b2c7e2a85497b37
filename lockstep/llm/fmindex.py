"""A bidirectional FM-index over the word ids of one shard, and the n-grams it enumerates."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np


@dataclass
class Intervals:
    """Distinct n-grams as intervals: words (a row of ids each), counts, and the first places in the forward and in the backward index."""

    words: np.ndarray
    counts: np.ndarray
    forward: np.ndarray
    backward: np.ndarray

    def where(self, keep: np.ndarray) -> Intervals:
        return Intervals(self.words[keep], self.counts[keep], self.forward[keep], self.backward[keep])


def sorted_places(text: np.ndarray, symbols: int, depth: int) -> np.ndarray:
    """Places of ``text`` (as a ring) in the order of their first ``depth`` symbols, ties by place."""
    n = len(text)
    rank, most, seen = text.astype(np.int64), symbols, 1
    while seen < depth:
        if most * symbols << n.bit_length() < 1 << 63:  # one more symbol, still in one number with the place
            rank, most, seen = rank * symbols + np.roll(text, -seen), most * symbols, seen + 1
        else:  # prefix doubling: ranks of what is seen so far, and of as much behind it
            rank = np.unique(rank, return_inverse=True)[1]
            rank, most, seen = rank * n + np.roll(rank, -seen), n * n, seen * 2
            rank, most = np.unique(rank, return_inverse=True)[1], n
    bits = n.bit_length()
    if most << bits >= 1 << 63:
        return np.argsort(rank, kind="stable")
    held = (rank << bits) | np.arange(n)
    held.sort()
    return held & ((1 << bits) - 1)


class Direction:
    """The Burrows-Wheeler transform of a text whose suffixes are sorted by their first ``depth`` symbols, at least.

    That is enough for patterns of up to ``depth`` symbols: their suffixes stand together, and in the right order among others.
    """

    def __init__(self, text: np.ndarray, symbols: int, depth: int):
        self.n, self.symbols = len(text), symbols
        self.bwt = text[sorted_places(text, symbols, depth) - 1].astype(np.int64)

    @cached_property
    def places(self) -> np.ndarray:
        """Of each symbol in order, the places where the transform holds it: symbol * n + place."""
        return np.sort(self.bwt * self.n + np.arange(self.n))

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The first place of an interval that is extended by ``symbol``: symbols that are smaller, and occurrences before ``at``."""
        return np.searchsorted(self.places, symbol * self.n + at)

    def extensions(self, first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each interval and word before it: interval, word, count, and how many in the interval have a smaller symbol."""
        before = np.cumsum(counts) - counts
        key = np.repeat(np.arange(len(counts)) * self.symbols, counts) + self.bwt[np.repeat(first - before, counts) + np.arange(counts.sum())]
        key.sort()
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        of, symbol = np.divmod(key[starts], self.symbols)
        word = symbol > 0
        return of[word], symbol[word], np.diff(np.r_[starts, len(key)])[word], (starts - before[of])[word]


class ShardIndex:
    """Counts of n-grams in ``text`` (ids from 1; 0 ends a piece and stands at the end), enumerated breadth first.

    Patterns grow to the left in the forward index and to the right in the backward one, that of the reversed text. A step to one side gives the
    interval on the other side at once; its own is found by rank when a later step needs it. ``left`` and ``right`` tell how
    long the patterns are that are extended to that side.
    """

    def __init__(self, text: np.ndarray, left: int = 1, right: int = 1):
        self.text, self.symbols, self.depths = text, int(text.max(initial=0)) + 1, (left, right)
        sizes = np.bincount(text, minlength=self.symbols)
        first = np.cumsum(sizes) - sizes
        words = np.flatnonzero(sizes[1:]) + 1
        self.one = Intervals(words[:, None], sizes[words], first[words], first[words])

    @cached_property
    def forward(self) -> Direction:
        return Direction(self.text, self.symbols, self.depths[0])

    @cached_property
    def backward(self) -> Direction:
        return Direction(self.text[::-1], self.symbols, self.depths[1])

    def left(self, found: Intervals, then_left: bool = False) -> Intervals:
        """All n-grams with one more word at their left; ``then_left``: these are to grow to the left again."""
        of, word, counts, smaller = self.forward.extensions(found.forward, found.counts)
        forward = self.forward.step(word, found.forward[of]) if then_left else np.full(len(of), -1)
        return Intervals(np.column_stack([word, found.words[of]]), counts, forward, found.backward[of] + smaller)

    def right(self, found: Intervals, then_right: bool = False) -> Intervals:
        """All n-grams with one more word at their right; ``then_right``: these are to grow to the right again."""
        of, word, counts, smaller = self.backward.extensions(found.backward, found.counts)
        backward = self.backward.step(word, found.backward[of]) if then_right else np.full(len(of), -1)
        return Intervals(np.column_stack([found.words[of], word]), counts, found.forward[of] + smaller, backward)
