"""License scans: a generalised suffix automaton of licence texts, matching statistics and chained template spans.

The words of all templates (base phrases and licence texts) build one suffix automaton. The words of a text stream through it: at
each word the automaton holds the longest run of words ending there that some template contains (the matching statistics).
Whole base phrases are read off the automaton's states. Maximal runs of at least ``MIN_RUN`` words are chained template by
template, in order in both text and template with at most ``MAX_GAP`` words between; every chain that covers at least
``MIN_COVER`` of its template's words labels the text, and its extent is a span (each copy of a licence has its own; of chains of one
template that overlap the one that covers more stands), unless templates of another label cover more words
of the same place (sibling licences share most of their words). Of labels that cover equally many, in terms
that licences share, those stand that cover most of the whole text.

Defined cases: null and empty texts have no words, no labels and score 0; texts of any length stream through in one pass with
memory for their words; repeated rows and null ids give a row each; an empty table gives an empty table; other columns are not
carried. A label that both ways find appears once.
"""

from __future__ import annotations

from bisect import bisect, bisect_left
from collections.abc import Iterable, Sequence
from functools import lru_cache
from importlib.resources import files

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.llm._frames import map_slices, raw_texts, read

MIN_RUN = 5
MAX_GAP = 8
MIN_COVER = 0.5

#: Base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Opening or notice texts of public licences.
TEMPLATES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
        is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be
        included in all copies or substantial portions of the Software.""",
    "apache-2": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
        agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS
        OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
        License.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies.""",
    "gpl-3": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
        as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program
        is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY
        or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "mpl-2": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
        with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means.""",
    "cc-by-nc": """This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.""",
    "cc-by-sa": """This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.""",
}

_GNU = """This {what} is free software{stop} you can redistribute it and/or modify it under the terms of the GNU {name} Public License as
    published by the Free Software Foundation{comma} either version {version} of the License, or (at your option) any later version. This {what} is
    distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
    FOR A PARTICULAR PURPOSE. See the GNU {name} Public License for more details."""
_CC = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
_BSD_3 = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
    this software without specific prior written permission."""

#: Further texts of licences: sibling licences' notices, and what follows the openings above.
MORE = [
    ("gpl-2", _GNU.format(what="program", stop=";", comma=";", name="General", version=2)),
    ("lgpl-2.1", _GNU.format(what="library", stop=";", comma=";", name="Lesser General", version="2.1")),
    ("lgpl-3", _GNU.format(what="library", stop=":", comma=",", name="Lesser General", version=3)),
    ("agpl-3", _GNU.format(what="program", stop=":", comma=",", name="Affero General", version=3)),
    *((f"cc-by{label}", _CC.format(name)) for label, name in (("", ""), ("-nd", "-NoDerivatives"), ("-nc-sa", "-NonCommercial-ShareAlike"), ("-nc-nd", "-NonCommercial-NoDerivatives"))),
    ("mit", """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR
        ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH
        THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("cc0", """To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the
        public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain
        Dedication along with this software. If not, see http://creativecommons.org/publicdomain/zero/1.0/."""),
    ("bsd", _BSD_3),
    ("bsd", """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
        NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
        COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
        (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
        HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
        ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("isc", """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
        DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
        TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("unlicense", """In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in
        the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and
        successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this
        software under copyright law."""),
]

#: Licences whose whole terms stand in ``licenses``; they are cut into templates of ``PART`` words, so that any part of them is found.
BODIES = ("apache-2", "gpl-2", "gpl-3", "lgpl-2.1", "lgpl-3", "mpl-2")
PART = 100

_WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words(raw: bytes) -> list[bytes]:
    """Runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` of a UTF-8 text with A-Z in lower case."""
    return raw.lower().translate(_WORD_BYTES).split()


class Automaton:
    """Generalised suffix automaton of the word sequences of templates."""

    def __init__(self, templates: Iterable[tuple[str, bool, list[bytes]]]):
        self.templates = list(templates)
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, own = [-1], [0], [[]]
        for t, (_, _, tokens) in enumerate(self.templates):
            last = 0
            for place, word in enumerate(tokens):
                last = self._extend(last, self.vocabulary.setdefault(word, len(self.vocabulary)), own)
                own[last].append((t, place))
        self.ends: list[list[tuple[int, int]]] = own
        by_length = sorted(range(1, len(self.link)), key=lambda v: -self.length[v])
        for v in by_length:
            if self.link[v] > 0:
                self.ends[self.link[v]] = sorted(set(self.ends[self.link[v]]) | set(self.ends[v]))
        #: Base phrases that end in each state: (template, words), to be matched at full length.
        self.phrases: list[list[tuple[int, int]]] = [[] for _ in self.link]
        whole = {}
        for t, (_, base, tokens) in enumerate(self.templates):
            if base and tokens:
                v = 0
                for word in tokens:
                    v = self.next[v][self.vocabulary[word]]
                whole.setdefault(v, []).append((t, len(tokens)))
        for v in reversed(by_length):
            self.phrases[v] = self.phrases[self.link[v]] + whole.get(v, [])

    def _state(self, length: int, own: list, copy: int | None = None) -> int:
        self.next.append(dict(self.next[copy]) if copy is not None else {})
        self.link.append(self.link[copy] if copy is not None else 0)
        self.length.append(length)
        own.append([])
        return len(self.link) - 1

    def _extend(self, last: int, token: int, own: list) -> int:
        if token in self.next[last]:
            q = self.next[last][token]
            if self.length[q] == self.length[last] + 1:
                return q
            return self._split(last, q, token, own)
        new, p = self._state(self.length[last] + 1, own), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, token, own)
        return new

    def _split(self, p: int, q: int, token: int, own: list) -> int:
        twin = self._state(self.length[p] + 1, own, q)
        self.link[q] = twin
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = twin
            p = self.link[p]
        return twin

    def scan(self, tokens: list[int | None]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Base phrases as (template, first word) and maximal runs as (last word, words, state)."""
        bases: list[tuple[int, int]] = []
        runs: list[tuple[int, int, int]] = []
        nexts, link, length, phrases = self.next, self.link, self.length, self.phrases
        state = size = 0
        before = -1
        for i in [i for i, t in enumerate(tokens) if t is not None]:
            if i != before + 1:
                if size >= MIN_RUN:
                    runs.append((before, size, state))
                state = size = 0
            before, token = i, tokens[i]
            to = nexts[state].get(token)
            if to is None:
                if size >= MIN_RUN:
                    runs.append((i - 1, size, state))
                while to is None and state > 0:
                    state = link[state]
                    size = length[state]
                    to = nexts[state].get(token)
            if to is None:
                state = size = 0
                continue
            state, size = to, size + 1
            for t, n in phrases[state]:
                if n <= size:
                    bases.append((t, i - n + 1))
        if size >= MIN_RUN:
            runs.append((before, size, state))
        return bases, runs

    def pieces(self, runs: list[tuple[int, int, int]]) -> dict[int, list[tuple[int, int, int]]]:
        """By template: (last word, last template word, words) of every place of every run, in order."""
        out: dict[int, list[tuple[int, int, int]]] = {}
        for end, size, state in runs:
            for t, place in self.ends[state]:
                out.setdefault(t, []).append((end, place, min(size, place + 1)))
        return {t: sorted(parts) for t, parts in out.items()}

    def chains(self, runs: list[tuple[int, int, int]]) -> list[tuple[int, float, int, int]]:
        """(template, covered share, first word, last word) of the chains of each template that do not overlap, the best ones first taken."""
        found = []
        for t, parts in self.pieces(runs).items():
            best: list[tuple[int, int]] = []  # covered words and first word of the best chain that ends with each part
            for i, (end, place, size) in enumerate(parts):
                score, first = size, end - size + 1
                j = i - 1
                while j >= 0 and end - size - parts[j][0] <= MAX_GAP + size:
                    gap_text, gap_own = end - size - parts[j][0], place - size - parts[j][1]
                    overlap = max(0, -gap_text, -gap_own)
                    if place > parts[j][1] and max(gap_text, gap_own) <= MAX_GAP and overlap < size and best[j][0] + size - overlap > score:
                        score, first = best[j][0] + size - overlap, best[j][1]
                    j -= 1
                best.append((score, first))
            taken: list[tuple[int, int]] = []  # extents, in order
            for k in sorted(range(len(parts)), key=lambda i: (-best[i][0], i)):
                first, last = best[k][1], parts[k][0]
                at = bisect(taken, (first, last))
                if (at == 0 or taken[at - 1][1] < first) and (at == len(taken) or last < taken[at][0]):
                    taken.insert(at, (first, last))
                    found.append((t, min(1.0, best[k][0] / len(self.templates[t][2])), first, last))
        return sorted(found)


def bodies() -> list[tuple[str, bool, list[bytes]]]:
    out = []
    for label in BODIES:
        tokens = words((files("curatrix.llm") / "licenses" / f"{label}.txt").read_bytes())
        cuts = [*range(0, max(1, len(tokens) - PART // 2), PART), len(tokens)]
        out += [(label, False, tokens[a:b]) for a, b in zip(cuts, cuts[1:])]
    return out


Templates = tuple[tuple[str, str], ...]  # label, text


@lru_cache(maxsize=4)
def automaton(templates: Templates | None = None) -> Automaton:
    """Of the base phrases and the given templates, or the public licences above."""
    base = [(label, True, words(text.encode())) for text, label in PHRASES.items()]
    if templates is not None:
        return Automaton(base + [(label, False, words(text.encode())) for label, text in templates])
    return Automaton(base + [(label, False, words(text.encode())) for label, text in [*TEMPLATES.items(), *MORE]] + bodies())


Found = tuple[str, int, int, float, int]  # label, first word, end, covered share, covered words


def best_labels(spans: list[Found]) -> list[Found]:
    """The spans that cover ``MIN_COVER`` of their template, without those where another label covers more words of the place, or as many and more of the text."""
    sure = [s for s in spans if s[3] >= MIN_COVER]
    total = {label: sum(x[4] for x in sure if x[0] == label) for label in {x[0] for x in sure}}
    order = sorted((x for x in spans if x[0] in total), key=lambda x: x[1])
    starts = [x[1] for x in order]
    longest = max((x[2] - x[1] for x in order), default=0)
    out = []
    for s in sure:
        here = {s[0]: 0.0}  # covered words within the span's extent
        for label, start, end, _, covered in order[bisect(starts, s[1] - longest) : bisect_left(starts, s[2])]:
            if s[1] < end:
                here[label] = here.get(label, 0.0) + covered * (min(end, s[2]) - max(start, s[1])) / (end - start)
        if all((round(n, 6), total[x]) <= (round(here[s[0]], 6), total[s[0]]) for x, n in here.items()):
            out.append(s)
    return out


def scan_text(raw: bytes, templates: Templates | None = None) -> dict:
    a = automaton(templates)
    tokens = list(map(a.vocabulary.get, words(raw)))
    bases, runs = a.scan(tokens)
    spans = [(a.templates[t][0], first, first + len(a.templates[t][2]), 1.0) for t, first in bases]
    chained = []
    for t, share, first, last in a.chains(runs):
        if not a.templates[t][1]:
            chained.append((a.templates[t][0], first, last + 1, share, round(share * len(a.templates[t][2]))))
    kept = sorted({*spans, *(s[:4] for s in best_labels(chained))})
    spans += [s[:4] for s in chained]
    starts = [first for _, first in bases]
    return {
        "n_words": len(tokens),
        "n_base": len(bases),
        "first_word": min(starts, default=None),
        "last_word": max(starts, default=None),
        "base_labels": sorted({a.templates[t][0] for t, _ in bases}),
        "labels": sorted({s[0] for s in kept}),
        "spans": [dict(zip(("label", "start", "end", "share"), s)) for s in kept],
        "score": max((s[3] for s in spans), default=0.0),
    }


_SPAN = T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("share", T.DoubleType())])
_RESULT = [
    ("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()), ("base_labels", T.ArrayType(T.StringType())),
    ("labels", T.ArrayType(T.StringType())), ("spans", T.ArrayType(_SPAN)), ("score", T.DoubleType()),
]
_ARROW = [
    pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()),
    pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())])), pa.float64(),
]


def license_scan(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), templates: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """``keep`` columns, then counts, label lists, covered spans (in words, end exclusive) and the best covered share.

    ``templates`` are (label, text) pairs in place of the public licences; every worker builds its automaton from them once.
    """
    given = None if templates is None else tuple(map(tuple, templates))
    narrow = df.select(*keep, F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([*narrow.drop("_text").schema, *(T.StructField(n, t) for n, t in _RESULT)])

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = [scan_text(raw, given) for raw in raw_texts(part, "_text")]
        columns = [pa.array([r[n] for r in rows], t) for (n, _), t in zip(_RESULT, _ARROW)]
        return pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *columns], schema.names)

    return map_slices(narrow, "_text", work, schema)


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    found = license_scan(read(spark, sf_dir, "documents"))
    return found.withColumns({"base_labels": F.array_join("base_labels", ","), "labels": F.array_join("labels", ",")}).drop("spans")
