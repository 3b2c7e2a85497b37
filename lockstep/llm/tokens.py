"""Token ids by a public tokenizer file, memoised per unit where the file allows it."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Characters that are their own NFC form, and whose lower case and class are beyond doubt.
LATIN = re.compile("[\t-\r -~\u00a1-\u012f\u0131-\u024f]*").fullmatch

#: With this pattern of units, a word of letters alone is a unit.
LETTERS_ARE_UNITS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: The character that stands for each byte in vocabularies: itself where it is a visible Latin-1 character, else one from 256 on; a blank stays.
_SHOWN = {32, *range(33, 127), *range(161, 173), *range(174, 256)}
_HIDDEN = sorted({*range(256)} - _SHOWN | {32})
BYTE_CHARS = np.asarray([b if b in _SHOWN else 256 + _HIDDEN.index(b) for b in range(256)], "<u2")

_LOADED: dict[str, MemoTokenizer] = {}


def byte_chars(text: str) -> str:
    """``text`` with each byte of its UTF-8 form, but blanks, as its character."""
    return BYTE_CHARS[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-16-le")


def strings(column: pa.LargeStringArray) -> list[str]:
    """Strings without blanks, at less cost than by ``to_pylist``."""
    joined = pc.binary_join(pa.ListArray.from_arrays([0, len(column)], column), pa.scalar(" ", column.type))[0].as_py()
    return joined.split(" ") if len(column) else []


class HeldIds:
    """The ids of strings: each string has a number, and the ids of all numbers stand in one array."""

    def __init__(self, dtype: np.dtype):
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.starts, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.dtype)

    def of(self, keys: list[str], learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        """The numbers of different ``keys``; ``learn`` gives ids, starts in them and sizes of those that have no number yet."""
        found = np.fromiter(map(self.numbers.get, keys, repeat(-1)), np.int64, len(keys))
        places = np.flatnonzero(found < 0)
        if len(places):
            new = [keys[i] for i in places.tolist()]
            found[places] = np.arange(len(new)) + len(self.numbers)
            ids, starts, sizes = learn(new)
            self.numbers.update(zip(new, found[places].tolist(), strict=True))
            self.starts = np.concatenate([self.starts, starts + len(self.ids)])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.ids = np.concatenate([self.ids, ids])
        return found

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``numbers`` one after another, and where those of each end."""
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        places = np.repeat(self.starts[numbers] - ends + sizes, sizes)
        places += np.arange(len(places))
        return self.ids[places], ends


class MemoTokenizer:
    """Encodes whole UTF-8 texts with the ``tokenizers`` library.

    Some files drop white space, cut texts into units by a pattern, and mark the end of each unit. There the
    ids of a text are those of its units one after another, so that a unit is encoded once, many together, and
    then looked up; so are words, runs without white space, of which most come again: Arrow finds the different
    words of a call's texts, and each is looked up once. Units are in normal form, lower-case and cut already, so that
    the file's steps for these are left out. Texts with other characters than printable Latin ones and ASCII white
    space, or with a special token, and all texts of other files are encoded as they are.
    """

    def __init__(self, path: str, max_held: int = 300_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.units, self.words = HeldIds(self.dtype), HeldIds(self.dtype)
        self.max_held = max_held
        pattern = self._unit_pattern(path)
        self.by_unit = pattern is not None
        if self.by_unit:
            self.letters_are_units = pattern == LETTERS_ARE_UNITS
            self.find_units = regex.compile(rf"{pattern}|\n").findall
            self.special = re.compile("|".join(re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()) or "(?!)").search
            self.ends_unit = np.zeros(self.tok.get_vocab_size(), bool)
            self.ends_unit[[i for token, i in self.tok.get_vocab().items() if token.endswith(self.suffix)]] = True
            self.unit_tok = Tokenizer(self.tok.model)
            self.unit_tok.pre_tokenizer = pre_tokenizers.WhitespaceSplit()

    def _unit_pattern(self, path: str) -> str | None:
        """The pattern of units, if the file works as the memo needs it."""
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        normal, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        steps = [n["type"] for n in normal.get("normalizers", [])]
        split, *rest = pre.get("pretokenizers") or [{}]
        by_bytes = [(r["type"], r.get("add_prefix_space"), r.get("use_regex")) for r in rest] == [("ByteLevel", False, False)]
        self.suffix = spec["model"].get("end_of_word_suffix")
        if self.suffix and by_bytes and steps == ["NFC", "Replace", "Lowercase"] and split.get("type") == "Split" and split.get("invert") and split.get("behavior") == "Removed":
            return split["pattern"].get("Regex")
        return None

    def _plain(self, text: str) -> np.ndarray:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, self.dtype)

    def _learn_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        held, sizes = [], []
        for at in range(0, len(units), 2048):
            part = units[at : at + 2048]
            ids = np.asarray(self.unit_tok.encode_batch_fast([byte_chars(" ".join(part))], add_special_tokens=False)[0].ids, self.dtype)
            counts = np.diff(np.flatnonzero(self.ends_unit[ids]), prepend=-1)
            if len(counts) != len(part):
                each = [self._plain(u) for u in part]
                ids, counts = np.concatenate(each), np.asarray([len(e) for e in each])
            held.append(ids)
            sizes.append(counts)
        sizes = np.concatenate(sizes)
        return np.concatenate(held), np.cumsum(sizes) - sizes, sizes

    def _learn_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of many words at once: those that are a unit, then all units of the others in a row, with a mark after each word."""
        if len(self.units.numbers) > self.max_held:
            self.units.clear()
        if not self.units.numbers:
            self.units.of(["\n"], lambda _: (np.zeros(0, self.dtype), np.zeros(1, np.int64), np.zeros(1, np.int64)))
        whole = np.fromiter(map(str.isalpha, words), bool, len(words)) & self.letters_are_units
        order = np.argsort(~whole, kind="stable")
        first, n = [words[i] for i in order.tolist()], np.count_nonzero(whole)
        units = pa.array(first[:n] + self.find_units("\n".join(first[n:])), pa.large_string()).dictionary_encode()
        numbers = self.units.of(strings(units.dictionary), self._learn_units)[units.indices.to_numpy()]
        ids, ends = self.units.take(numbers)
        marks = n + np.flatnonzero(numbers[n:] == self.units.numbers["\n"])
        ends = np.r_[ends[:n], ends[marks], len(ids)][: len(words)]
        starts, sizes = np.empty_like(ends), np.empty_like(ends)
        sizes[order] = np.diff(ends, prepend=0)
        starts[order] = ends - sizes[order]
        return ids, starts, sizes

    def _by_words(self, texts: list[str]) -> list[bytes]:
        """The ids of lower-case texts that the memo can take."""
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        words = split.flatten().dictionary_encode()
        if len(self.words.numbers) > self.max_held:
            self.words.clear()
        ids, ends = self.words.take(self.words.of(strings(words.dictionary), self._learn_words)[words.indices.to_numpy()])
        raw, stops = ids.tobytes(), np.r_[0, ends * self.dtype.itemsize][np.cumsum(pc.list_value_length(split).to_numpy())].tolist()
        return [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian ids of each text, ``dtype`` wide."""
        whole = [t.decode("utf-8", "replace") for t in texts]
        if not self.by_unit:
            return [np.asarray(e.ids, self.dtype).tobytes() for e in self.tok.encode_batch_fast(whole, add_special_tokens=False)]
        known = [bool(LATIN(t)) and not self.special(t) for t in whole]
        held = iter(self._by_words([t.lower() for t, k in zip(whole, known, strict=True) if k]))
        return [next(held) if k else self._plain(t).tobytes() for t, k in zip(whole, known, strict=True)]


def tokenizer(path: str) -> MemoTokenizer:
    """The tokenizer of a file, loaded once in each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = MemoTokenizer(path)
    return _LOADED[path]
