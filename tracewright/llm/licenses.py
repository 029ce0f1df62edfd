"""Licence scans: a generalised suffix automaton of licence words.

The automaton of all templates is built once on the driver (its size is that of
the templates, a few thousand states) and broadcast. Each text is streamed
through it word by word, which gives at every word the longest suffix that
occurs in some template (matching statistics). Where a match stops growing and
is long enough it becomes a seed for each template that holds it; seeds that
advance in text and template alike are chained, and the template words they
cover give the template's share. Phrases that must be found exactly are
templates too: the states where one ends are marked, so every place is found
while streaming.

A row is handled alone: no shuffle, memory of the order of one text.

Defined results: null text counts as empty and has no words; a text without a
finding has empty labels, null word positions and the score of its best partial
cover; repeated rows give equal results; an empty table gives an empty result;
very long texts are streamed whole; other columns are kept, and columns of the
added names are replaced. Of found templates that overlap in the text the one with
most words covered stays, then the one with the largest share.
"""

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

# Phrases that are found word for word, and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Wording of well-known licences, from the licences themselves.
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution. """
_BSD_NAMES = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission. """
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
TEMPLATES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included
in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE
AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-2": _BSD + _BSD_END,
    "bsd-3": _BSD + _BSD_NAMES + _BSD_END,
    "apache-2": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
License.""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU
General Public License along with this program. If not, see http://www.gnu.org/licenses/.""",
    "lgpl": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This
library is distributed in the hope that it will be useful""",
    "mpl-2": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means.""",
    "cc-by": """This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license,
visit http://creativecommons.org/licenses/by/4.0/""",
    "cc-by-nc": """This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of
this license, visit http://creativecommons.org/licenses/by-nc/4.0/""",
}

#: A match of fewer words is no seed; seeds further apart than GAP words (in the text) start a new chain.
SEED_WORDS, GAP = 6, 40
#: A template counts as found once this share of its words is covered by one chain.
COVER = 0.6


def words_of(text: str | None) -> list[str]:
    """Words of the text with A-Z lower-cased; any other letter stays as it is."""
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


class Automaton:
    """A suffix automaton over several word sequences."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        self.vocabulary: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        texts = [words_of(t) for t in templates.values()]
        exact = [words_of(p) for p in phrases]
        coded = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in t] for t in texts + exact]
        for code in coded:
            last = 0
            for c in code:
                last = self._extend(last, c)
        self.labels, self.sizes = list(templates), [len(t) for t in texts]
        self.phrase_labels, self.phrase_sizes = list(phrases.values()), [len(p) for p in exact]
        #: For each state the templates that hold its strings, with one place where they end.
        self.ends: list[dict[int, int]] = [{} for _ in self.next]
        self.phrase: list[int] = [-1] * len(self.next)
        for k, code in enumerate(coded):
            state = 0
            for at, c in enumerate(code):
                state = self.next[state][c]
                up = state
                while k < len(texts) and up and k not in self.ends[up]:
                    self.ends[up][k] = at
                    up = self.link[up]
            if k >= len(texts):
                self.phrase[state] = k - len(texts)
        #: The nearest state up the links where a phrase ends, itself included.
        self.up: list[int] = [-1] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.up[state] = state if self.phrase[state] >= 0 else self.up[self.link[state]]

    def _extend(self, last: int, c: int) -> int:
        """Append ``c`` after ``last``; a known continuation is shared rather than added again."""
        known = self.next[last].get(c)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, c, known)
        new = self._state({}, self.length[last] + 1, 0)
        at = last
        while at >= 0 and c not in self.next[at]:
            self.next[at][c] = new
            at = self.link[at]
        if at >= 0:
            to = self.next[at][c]
            self.link[new] = to if self.length[to] == self.length[at] + 1 else self._split(at, c, to)
        return new

    def _split(self, at: int, c: int, to: int) -> int:
        twin = self._state(dict(self.next[to]), self.length[at] + 1, self.link[to])
        self.link[to] = twin
        while at >= 0 and self.next[at].get(c) == to:
            self.next[at][c] = twin
            at = self.link[at]
        return twin

    def _state(self, following: dict[int, int], length: int, link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def stream(self, words: list[str]):
        """(phrase places as (first word, phrase), seeds as (text end, length, state))."""
        code, step, link, length, up = self.vocabulary.get, self.next, self.link, self.length, self.up
        places, seeds, state, size = [], [], 0, 0
        for at, w in enumerate(words):
            c = code(w)
            if c is None:
                if size >= SEED_WORDS:
                    seeds.append((at - 1, size, state))
                state = size = 0
                continue
            if c not in step[state]:
                if size >= SEED_WORDS:
                    seeds.append((at - 1, size, state))
                while state and c not in step[state]:
                    state = link[state]
                    size = length[state]
            to = step[state].get(c)
            if to is None:
                state = size = 0
                continue
            state, size = to, size + 1
            end = up[state]
            while end > 0:
                k = self.phrase[end]
                if self.phrase_sizes[k] <= size:
                    places.append((at - self.phrase_sizes[k] + 1, k))
                end = up[link[end]]
        if size >= SEED_WORDS:
            seeds.append((len(words) - 1, size, state))
        return places, seeds

    def chains(self, seeds) -> list[tuple[float, str, int, int]]:
        """For each template its best chain: (share covered, label, first word, last word in the text)."""
        per: dict[int, list[tuple[int, int, int]]] = {}
        for end, size, state in seeds:
            for k, at in self.ends[state].items():
                per.setdefault(k, []).append((end - size + 1, at - size + 1, size))
        out = []
        for k, blocks in per.items():
            share, first, last = self._best(blocks)
            out.append((min(1.0, share / self.sizes[k]), self.labels[k], first, last))
        return sorted(out, reverse=True)

    @staticmethod
    def _best(blocks: list[tuple[int, int, int]]) -> tuple[int, int, int]:
        """The most template words that blocks rising in text and template cover; blocks GAP apart don't chain.

        Blocks come in text order. Within a stretch the best chain ending below a
        template place is kept as a staircase, so a stretch costs n log n.
        """
        best, stretch_end = (0, 0, 0), None
        places: list[int] = []
        tops: list[tuple[int, int]] = []
        for start, at, size in blocks:
            if stretch_end is None or start - stretch_end > GAP:
                places, tops = [], []
            stretch_end = start + size - 1
            # what an earlier chain has covered of this block's template words isn't counted again
            k = bisect_left(places, at + size) - 1
            value, first = size, start
            if k >= 0:
                over = max(0, places[k] - at + 1)
                if tops[k][0] + size - over > value:
                    value, first = tops[k][0] + size - over, tops[k][1]
            end = at + size - 1
            k = bisect_left(places, end)
            if k == 0 or tops[k - 1][0] < value:
                j = k
                while j < len(places) and tops[j][0] <= value:
                    j += 1
                places[k:j], tops[k:j] = [end], [(value, first)]
            if value > best[0]:
                best = (value, first, stretch_end)
        return best

    def apart(self, chains: list[tuple]) -> list[tuple]:
        """The chains (share, label, first, last) that stay where they overlap in the text."""
        kept: list[tuple] = []
        for c in sorted(chains, key=lambda c: (-round(c[0] * self.sizes[self.labels.index(c[1])]), -c[0], c[1])):
            if all(c[3] < a or b < c[2] for _, _, a, b in kept):
                kept.append(c)
        return kept


def scan(df: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """``df`` with n_words, n_base, first_word, last_word, base_labels, labels, score and spans (label:first-last of found templates)."""
    from pyspark.sql.types import StructType

    shared = df.sparkSession.sparkContext.broadcast(Automaton(PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates))
    extra = StructType.fromDDL("n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans string")
    df = df.drop(*extra.names)

    def row(automaton: Automaton, text: str | None):
        words = words_of(text)
        places, seeds = automaton.stream(words)
        chains = automaton.chains(seeds) if seeds else []
        base = {automaton.phrase_labels[k] for _, k in places}
        full = automaton.apart([c for c in chains if c[0] >= COVER])
        starts = [p for p, _ in places]
        score = 1.0 if places else round(chains[0][0], 6) if chains else 0.0
        spans = ",".join(f"{label}:{a}-{b}" for _, label, a, b in sorted(full, key=lambda c: (c[2], c[1])))
        return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {c[1] for c in full})), score, spans

    def work(batches):
        automaton = shared.value
        for batch in batches:
            rows = [row(automaton, t) for t in batch.column("text").to_pylist()]
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
            new = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *extra.names])

    return df.mapInArrow(work, StructType([*df.schema.fields, *extra.fields]))


def op6_license_scan(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
