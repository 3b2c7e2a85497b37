"""Greedy alignment of two growing lists as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "spot long, at long, last long, ended long, mine_place array<long>, mine_token array<string>, other_place array<long>, other_token array<string>"


def greedy_matches(rows: DataFrame, key: str, side: str = "side", place: str = "place", token: str = "token", ahead: int = 8) -> DataFrame:
    """``key``, place, match, exact: as ``alignment.greedy_align``, from a stream in which both sides' tokens arrive in any order.

    Places of each side count from 0 without gaps, so that it is known what is still to come; a row with a null token tells that side 1 has no more
    from its place on. A token of side 0 is decided, and leaves the state, once the ``ahead`` + 1 tokens of side 1 that it may match are
    there, or side 1 has ended. What is held for a key are tokens that came too early and those that may still be matched: as many as the sides are apart. A token that comes again is left out.
    """

    def step(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spot, at, last, ended, *lists = state.get if state.exists else (0, 0, None, None, [], [], [], [])
        mine, other = dict(zip(lists[0], lists[1], strict=True)), dict(zip(lists[2], lists[3], strict=True))
        for part in parts:
            for s, p, t in zip(part[side], part[place], part[token], strict=True):
                if s == 0 and t is not None and p >= spot:
                    mine.setdefault(int(p), t)
                elif s == 1 and t is None:
                    ended = int(p) if ended is None else min(ended, int(p))
                elif s == 1 and p >= at:
                    other.setdefault(int(p), t)
        out = []
        while spot in mine:
            window = range(at, at + ahead + 1 if ended is None else min(at + ahead + 1, max(at, ended)))
            hit, known = None, True
            for k in window:
                if k not in other:
                    known = False  # an earlier one may still be the match
                    break
                if other[k] == mine[spot]:
                    hit = k
                    break
            if hit is None and not known:
                break
            if hit is not None:
                last, at = hit, hit + 1
                other = {k: v for k, v in other.items() if k >= at}
            out.append((spot, last, hit is not None))
            del mine[spot]
            spot += 1
        state.update((spot, at, last, ended, list(mine), list(mine.values()), list(other), list(other.values())))
        found = pd.DataFrame(out, columns=["place", "match", "exact"]).astype({"place": "Int64", "match": "Int64", "exact": "bool"})
        found.insert(0, key, name[0])
        yield found

    kind = rows.schema[key].dataType.simpleString()
    known = rows.where(F.col(key).isNotNull() & F.col(place).isNotNull()).select(key, side, F.col(place).cast("long").alias(place), token)
    return known.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, place long, match long, exact boolean", STATE, "append", GroupStateTimeout.NoTimeout)
