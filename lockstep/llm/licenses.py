"""License scans by template markup compiled into token automata."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_slices, utf8

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Phrases and labels of the base scan.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Templates of notices and of whole license texts. [[...]] is optional; {{n}} stands for up to n words of any wording.
TEMPLATES = {
    "notice:mit": "[[this work is]] released under the mit license",
    "notice:apache": "licensed under the apache license [[version 2 0]]",
    "notice:gpl": "[[this work is]] licensed under the [[gnu]] [[lesser]] general public license [[version {{2}}]]",
    "notice:cc": "licensed under [[a]] [[creative commons]] cc by [[nc]] [[nd]] [[sa]] [[4 0]]",
    "notice:bsd": "[[this work is]] [[released]] [[licensed]] under the bsd [[{{2}} clause]] license",
    "notice:reserved": "[[copyright {{6}}]] all rights reserved",
    "grant:mit": "permission is hereby granted free of charge to any person obtaining a copy of {{4}} software and associated documentation files",
    "license:mit": """[[The MIT License [[(MIT)]]]] [[Copyright {{12}}]] Permission is hereby granted, free of charge, to any person obtaining a copy
        of {{4}} software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
        furnished to do so, subject to the following conditions: The above copyright notice and this permission notice [[(including the next paragraph)]] shall be
        included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
        IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
        {{8}} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
        CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "license:isc": """[[ISC License]] [[Copyright {{12}}]] Permission to use, copy, modify, and[[/or]] distribute this software for any purpose with or without
        fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND
        {{6}} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL
        {{6}} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "license:bsd": """[[Copyright {{12}}]] [[All rights reserved.]] Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: [[1.]] Redistributions of source code must retain the above copyright notice, this list of conditions
        and the following disclaimer. [[2.]] Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution. [[[[3.]] Neither the name of {{10}} nor the names of its
        contributors may be used to endorse or promote products derived from this software without specific prior written permission.]]
        THIS SOFTWARE IS PROVIDED BY {{8}} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {{8}} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
        EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
        BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
        OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "header:apache": """[[Copyright {{12}}]] Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the License.""",
    "notice:mit-terms": "licensed under [[the terms of]] [[the]] mit license",
    "notice:gpl-2.0": "gnu general public license [[{{2}}]] version 2",
    "notice:gpl-3.0": "gnu general public license [[{{2}}]] version 3",
    "notice:lgpl-2.1": "gnu lesser general public license [[{{2}}]] version 2 1",
    "notice:lgpl-3.0": "gnu lesser general public license [[{{2}}]] version 3",
    "notice:agpl-3.0": "gnu affero general public license [[{{2}}]] version 3",
    "notice:mpl-2.0": "mozilla public license [[version]] [[v]] 2 0",
    "notice:epl-2.0": "eclipse public license [[version]] [[v]] 2 0",
    "notice:bsl-1.0": "distributed under the boost software license version 1 0",
    "notice:cc0-1.0": "cc0 1 0 [[universal]]",
    "notice:spdx": "spdx license identifier {{3}}",
    "header:gpl": """This program is free software[[:]] you can redistribute it and/or modify it under the terms of the GNU [[Lesser]] [[Affero]] General Public License
        as published by the Free Software Foundation[[,]] either version {{2}} of the License, or (at your option) any later version.""",
    "header:mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
        file, You can obtain one at {{1}} mozilla.org/MPL/2.0""",
    "license:zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will {{6}} be held liable for any damages arising
        from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter
        it and redistribute it freely, subject to the following restrictions: [[1.]] The origin of this software must not be misrepresented; you must not claim
        that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is
        not required. [[2.]] Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. [[3.]] This
        notice may not be removed or altered from any source distribution.""",
    "license:unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
        distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "license:0bsd": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS
        PROVIDED "AS IS" AND {{6}} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    "notice:cc-work": """This work is licensed under [[a]] [[the]] Creative Commons Attribution [[NonCommercial]] [[NoDerivatives]] [[NoDerivs]] [[ShareAlike]]
        {{2}} [[International]] [[Unported]] License""",
}


def words_of(text: bytes) -> list[bytes]:
    """The words of a text, or of a template's wording: A-Z in lower case."""
    return WORD.findall(text.lower())


@dataclass
class Automaton:
    """States over words: ``moves`` by word, ``wild`` by any word, ``free`` without one; ``end`` accepts."""

    label: str
    moves: list[dict[bytes, int]] = field(default_factory=list)
    wild: list[int | None] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    needed: set[bytes] = field(default_factory=set)
    end: int = 0

    def state(self) -> int:
        self.moves.append({})
        self.wild.append(None)
        self.free.append([])
        return len(self.moves) - 1

    def closure(self, states: set[int]) -> frozenset[int]:
        todo = list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return frozenset(states)

    def step(self, states: frozenset[int], word: bytes) -> frozenset[int]:
        after = {self.moves[s][word] for s in states if word in self.moves[s]}
        after |= {t for s in states if (t := self.wild[s]) is not None}
        return self.closure(after)

    @property
    def first_words(self) -> set[bytes]:
        return {w for s in self.closure({0}) for w in self.moves[s]}


def compile_template(label: str, template: str) -> Automaton:
    """The automaton of a template. It has to begin with a fixed word, optional or not, and to need one.

    Its wording is cut into words as texts are; optional regions may lie in one another.
    """
    out = Automaton(label)
    at, opened = out.state(), []
    for token in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|(?:(?!\[\[|\]\]|\{\{\d+\}\})\S)+", template):
        if token == "[[":
            opened.append(at)
            fresh = out.state()
            out.free[at].append(fresh)
            at = fresh
        elif token == "]]":
            after = out.state()
            out.free[at].append(after)
            out.free[opened.pop()].append(after)
            at = after
        elif token.startswith("{{"):
            end = out.state()
            for _ in range(int(token[2:-2])):
                out.free[at].append(end)
                fresh = out.state()
                out.wild[at] = fresh
                at = fresh
            out.free[at].append(end)
            at = end
        else:
            for word in words_of(token.encode()):
                fresh = out.state()
                out.moves[at][word] = fresh
                if not opened:
                    out.needed.add(word)
                at = fresh
    out.end = at
    if opened or not out.needed or any(out.wild[s] is not None for s in out.closure({0})):
        raise ValueError(f"{label}: unclosed, without mandatory words, or begins with any words")
    return out


class Scanner:
    """All places of the phrases and templates in a list of words."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        self.phrases = [(tuple(p.encode().split()), label) for p, label in phrases.items()]
        self.automata = [compile_template(label, t) for label, t in templates.items()]
        self.by_first: dict[bytes, list[Automaton]] = {}
        for a in self.automata:
            for w in a.first_words:
                self.by_first.setdefault(w, []).append(a)

    def base(self, words: list[bytes]) -> list[tuple[int, str]]:
        found = []
        for phrase, label in self.phrases:
            at = -1
            while True:
                try:
                    at = words.index(phrase[0], at + 1)
                except ValueError:
                    break
                if tuple(words[at : at + len(phrase)]) == phrase:
                    found.append((at, label))
        return found

    def matches(self, words: list[bytes]) -> list[tuple[int, int, str]]:
        """(start, end, label) of each template's matches: the leftmost, as long as it can be, then the next one behind it."""
        held, found = set(words), []
        wanted = {id(a): 0 for a in self.automata if a.needed <= held}
        if not wanted:
            return found
        for at, word in enumerate(words):
            for a in self.by_first.get(word, ()):
                if wanted.get(id(a), len(words)) > at:
                    continue
                states, last, i = a.closure({0}), 0, at
                while states and i < len(words):
                    states = a.step(states, words[i])
                    i += 1
                    if a.end in states:
                        last = i
                if last:
                    found.append((at, last, a.label))
                    wanted[id(a)] = last
        return found


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """Scan whole texts: doc_id, n_words, base (array of places), matches (array of spans), n_base, first_word, last_word, base_labels, labels, score.

    A-Z count as lower case; a word is a run of ASCII letters, digits and characters beyond ASCII. ``base`` holds
    every place where the words of a phrase stand consecutively; ``matches`` the spans of templates whose mandatory
    wording stands exactly, with optional regions or not, and replaceable ones by other words; the spans of one template don't overlap. The score is 0 without
    any place, else 1 - 2^-(places of the base + 2 x templates found), at most 1.

    A null text counts as empty; it and a text without words have no place, null first_word and last_word, empty
    labels and score 0. Repeated rows come out as often; other columns are ignored; an empty table gives no rows.
    """
    phrases, templates = BASE_PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    place = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))

    def run(batch: pa.RecordBatch) -> Iterator[list]:
        scanner = _scanner(tuple(phrases.items()), tuple(templates.items()))
        for part in text_slices(batch, "text"):
            rows = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), utf8(part.column("text")), strict=True):
                words = words_of(text)
                rows.append((doc_id, len(words), [{"word": w, "label": x} for w, x in sorted(scanner.base(words))], [{"start": s, "end": e, "label": x} for s, e, x in scanner.matches(words)]))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), place, span), strict=True)]

    schema = "doc_id long, n_words long, base array<struct<word:bigint,label:string>>, matches array<struct<start:bigint,end:bigint,label:string>>"
    found = map_batches(docs.select("doc_id", "text"), schema, run)
    labels = lambda *arrays: F.array_join(F.sort_array(F.array_distinct(F.concat(*arrays))), ",")
    n_base = F.size("base")
    return found.select(
        "doc_id", "n_words", "base", "matches", n_base.cast("long").alias("n_base"),
        F.array_min("base.word").alias("first_word"), F.array_max("base.word").alias("last_word"),
        labels("base.label").alias("base_labels"), labels("base.label", "matches.label").alias("labels"),
        (F.lit(1.0) - F.pow(F.lit(2.0), -(n_base + 2 * F.size("matches")).cast("double"))).alias("score"),
    )


_SCANNERS: dict[tuple, Scanner] = {}


def _scanner(phrases: tuple, templates: tuple) -> Scanner:
    if (phrases, templates) not in _SCANNERS:
        _SCANNERS[phrases, templates] = Scanner(dict(phrases), dict(templates))
    return _SCANNERS[phrases, templates]
