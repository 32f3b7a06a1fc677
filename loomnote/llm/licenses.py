"""License scans by patience alignment.

A text's words are aligned with a license template: words that occur once in both are anchors; the longest run of
anchors that is increasing in both (longest increasing subsequence) is kept, and the gaps between them are aligned
in the same way, with words that are unique inside the gap, until nothing is left; equal words at a gap's ends match
before that. Coverage is the share of the template's words that are matched. Words are lower-cased runs of letters and
digits; a version number (``2.1``) is one word, and ``2.0`` is ``2``.

Where to align. A window begins at a word that the template has and is ``SPREAD`` times as long as the template. The
windows that can reach ``COVERAGE`` are those in which enough of the template's words occur at all, each as often as the
template has it at most; that count is kept for all windows of a text at once, by what each occurrence adds to the
windows it lies in. Exactly those are aligned, in texts of any length by the same rule, so that the hits are those of an
alignment at every window (the tests hold them against that). Before this, a regular expression over the lower-cased
text finds, in the JVM, the texts that have a trigger of any template. A template that is covered has at most
(1 - COVERAGE) of its words unmatched, so any hit has one of its trigger words, which are chosen to be more than that
share: the rarest first, "the" and "of" last. Only texts with triggers go to Python.

A hit must be covered to ``COVERAGE`` and its matched words must lie within ``SPREAD`` times the template's length.
Words that tell licenses apart (``MARKS``, and all numbers of the template) must be matched if the template has them,
and must not stand unmatched inside the hit. A negation up to three words before a word of granting (``GRANTS``), be that
matched or up to three words before the hit, voids it. Of hits that overlap, the one with more matched words stays, then the better covered, then the shorter, then
the first by name, then by place.

Rows: null and empty texts have no hit. Very long texts are scanned whole. Repeated rows and null ids have their hits
each. An empty table gives no rows. Only the id and the text are read: extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COVERAGE = 0.8
SPREAD = 1.5
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_MIT0 = _MIT.replace(", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "")
_BSD3 = _BSD + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_ZERO = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE"""


def _gnu(kind: str, version: str, what: str = "program", old: bool = False) -> str:
    """The notice of a GNU license; ``old`` is the wording before version 3."""
    name = f"GNU {kind} General Public License".replace("  ", " ")
    begin = f"This {what} is free software; you can" if old else f"This {what} is free software: you can"
    return (
        f"{begin} redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version. "
        f"This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."
    )


_CC_LONG = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
#: (license, text); several texts may stand for one license.
TEMPLATES = [
    ("0BSD", _ZERO),
    ("AGPL-3.0", _gnu("Affero", "3")),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("Apache-1.1", "Licensed under the Apache License, Version 1.1"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", _APACHE),
    ("BSD-2-Clause", _BSD),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License"),
    ("BSD-3-Clause", _BSD3),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal"),
    *((f"CC-{kind}-{v}", f"Licensed under CC {kind} {v}") for v in ("2.0", "2.5", "3.0", "4.0") for kind in _CC_LONG),
    *((f"CC-{kind}-{v}", f"This work is licensed under a Creative Commons {long} {v} {'International' if v == '4.0' else 'Unported'} License") for v in ("3.0", "4.0") for kind, long in _CC_LONG.items()),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", _gnu("", "2", old=True)),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", _gnu("", "3")),
    ("ISC", _ISC),
    ("ISC", "Released under the ISC License"),
    ("LGPL-2.1", _gnu("Lesser", "2.1", "library", old=True)),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", _gnu("Lesser", "3")),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", _MIT),
    ("MIT-0", _MIT0),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Words that tell licenses apart, beside numbers: where a template has one, it must be matched, and a hit has no other.
MARKS = frozenset("affero apache attribution bsd cc0 cc clause eclipse isc lesser mit mozilla nc nd noderivatives noderivs noncommercial sa sharealike".split())
GRANTS = frozenset("licensed released permission redistribution redistribute distributed subject available granted free".split())
NEGATIONS = frozenset("not never neither nor isn aren wasn no cannot without".split())
_COMMON = set("the of and a to in is this any under or for with by be as at that are it on an no not all if you may from 1 2 3 4 0 v".split())
_WORD = re.compile(r"\d+(?:\.\d+)+|[^\W_]+")
_NUMBER = re.compile(r"\d+(?:\.\d+)*")


def words_of(text: str) -> list[str]:
    return [re.sub(r"(?:\.0)+$", "", w) if "." in w else w for w in _WORD.findall(text.lower())]


def _lis(places: list[int]) -> list[int]:
    """Indexes of a longest increasing subsequence, by patience sorting with back pointers."""
    tops: list[int] = []
    ends: list[int] = []
    back = [-1] * len(places)
    for k, p in enumerate(places):
        pile = bisect_left(tops, p)
        if pile == len(tops):
            tops.append(p)
            ends.append(k)
        else:
            tops[pile] = p
            ends[pile] = k
        back[k] = ends[pile - 1] if pile else -1
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Matched places (i, j) of a and b, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, k, j, m = todo.pop()
        while i < k and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < k and j < m and a[k - 1] == b[m - 1]:
            k, m = k - 1, m - 1
            out.append((k, m))
        if i == k or j == m:
            continue
        ca, cb = Counter(a[i:k]), Counter(b[j:m])
        once = {w for w, n in ca.items() if n == 1 and cb.get(w) == 1}
        if not once:
            continue
        where = {w: y for y, w in enumerate(b[j:m], j) if w in once}
        at = [(x, where[w]) for x, w in enumerate(a[i:k], i) if w in once]
        chain = [at[n] for n in _lis([y for _, y in at])]
        out += chain
        for (x0, y0), (x1, y1) in zip([(i - 1, j - 1), *chain], [*chain, (k, m)]):
            if x1 > x0 + 1 and y1 > y0 + 1:
                todo.append((x0 + 1, x1, y0 + 1, y1))
    return sorted(out)


class Template:
    def __init__(self, name: str, text: str, coverage: float = COVERAGE, spread: float = SPREAD):
        self.name, self.words = name, words_of(text)
        n, count = len(self.words), Counter(self.words)
        self.least, self.reach, self.count = int(np.ceil(n * coverage - 1e-9)), int(n * spread), count
        self.marks = {w for w in count if w in MARKS or _NUMBER.fullmatch(w)}
        need = int(n * (1 - coverage) + 1e-9) + 1
        self.triggers: set[str] = set()
        for w in sorted(count, key=lambda w: (w in _COMMON, -len(w), w)):
            if sum(count[t] for t in self.triggers) >= need:
                break
            self.triggers.add(w)

    def hit(self, words: list[str], start: int) -> tuple[str, int, int, int, int] | None:
        """The hit of the window that begins at ``start``, if it is one."""
        window = words[start : start + self.reach]
        pairs = align(self.words, window)
        if len(pairs) < self.least or pairs[-1][1] - pairs[0][1] >= self.reach:
            return None
        matched = {j for _, j in pairs}
        if self.marks - {window[j] for j in matched}:
            return None
        first, last = pairs[0][1], pairs[-1][1] + 1
        if any(window[j] in MARKS for j in range(first, last) if j not in matched):
            return None
        for j in (*range(max(-start, first - 3), first), *matched):
            if words[start + j] in GRANTS and any(words[k] in NEGATIONS and k - start not in matched for k in range(max(0, start + j - 3), start + j)):
                return None
        return self.name, start + first, start + last, len(pairs), len(self.words)


class Library:
    """Templates, and how often each has each word of all their words."""

    def __init__(self, templates: list[tuple[str, str]], coverage: float = COVERAGE, spread: float = SPREAD):
        self.templates = [Template(name, text, coverage, spread) for name, text in templates]
        self.word = {w: k for k, w in enumerate(sorted(set().union(*(t.count for t in self.templates))))}
        self.need = np.zeros((len(self.templates), len(self.word)), dtype=np.int64)
        for i, t in enumerate(self.templates):
            for w, n in t.count.items():
                self.need[i, self.word[w]] = n
        self.least = np.array([t.least for t in self.templates])

    def starts(self, place: np.ndarray, word: np.ndarray, i: int) -> np.ndarray:
        """The places of template i's words at which a window begins that has enough of them."""
        need = self.need[i][word]
        at, word, need = place[need > 0], word[need > 0], need[need > 0]
        # an occurrence counts for windows that begin after the same word's need-th occurrence before it
        order = np.argsort(word, kind="stable")
        w, before = word[order], np.full(len(at), -1, dtype=np.int64)
        k = np.arange(len(at)) - need[order]
        ok = (k >= 0) & (w[np.maximum(k, 0)] == w)
        before[order[ok]] = at[order[k[ok]]]
        low = np.searchsorted(at, np.maximum(before, at - self.templates[i].reach), side="right")
        size = np.bincount(low, minlength=len(at) + 1) - np.bincount(np.arange(len(at)) + 1, minlength=len(at) + 1)
        return at[np.cumsum(size)[:-1] >= self.templates[i].least]

    def scan(self, words: list[str]) -> list[tuple[str, int, int, int, int]]:
        """(license, first word, word after the last, matched, words of the template) of each hit in a text's words."""
        get = self.word.get
        code = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
        place = np.flatnonzero(code >= 0)
        word, found = code[place], set()
        enough = np.minimum(self.need, np.bincount(word, minlength=len(self.word))).sum(axis=1) >= self.least
        for i in np.flatnonzero(enough).tolist():
            t, past = self.templates[i], -1
            for a in self.starts(place, word, i).tolist():
                if a < past:
                    continue
                if h := t.hit(words, a):
                    found.add(h)
                    if h[3] == h[4] == h[2] - h[1]:  # all of it, nothing between: no window inside is better
                        past = h[2]
        return best(found)


def best(found: set[tuple[str, int, int, int, int]]) -> list[tuple[str, int, int, int, int]]:
    """Of hits that overlap, the first by matched words, coverage, length, name and place; in the order of the text."""
    starts, kept = [], []  # kept hits don't overlap, so both are sorted by place
    for h in sorted(found, key=lambda h: (-h[3], -h[3] / h[4], h[2] - h[1], h[0], h[1])):
        k = bisect_left(starts, h[1])
        if (k == 0 or kept[k - 1][2] <= h[1]) and (k == len(kept) or h[2] <= starts[k]):
            starts.insert(k, h[1])
            kept.insert(k, h)
    return kept


def _any_of(words: set[str]) -> str:
    """A pattern of the words, common beginnings first, so that few branches are tried at a place."""
    tails: dict[str, set[str]] = {}
    for w in words:
        tails.setdefault(w[0], set()).add(w[1:])
    parts = []
    for c, rest in sorted(tails.items()):
        more = rest - {""}
        parts.append(re.escape(c) + (f"(?:{_any_of(more)})" + ("?" if "" in rest else "") if more else ""))
    return "|".join(parts)


def trigger_pattern(templates: list[Template]) -> str:
    """A pattern that every text with a hit matches: a trigger word of any template, as a word."""
    return r"(?<![\p{L}\p{N}])(?:" + _any_of(set().union(*(t.triggers for t in templates))) + r")(?![\p{L}\p{N}])"


def find_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, first_word, end_word, matched, template_words, coverage) of each hit."""
    library = Library(templates, coverage)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.lower("text").rlike(trigger_pattern(library.templates)))
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), T.StructField("license", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("first_word", "end_word", "matched", "template_words")), T.StructField("coverage", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, hits = [], []
            for k, text in enumerate(batch.column(1)):
                for h in library.scan(words_of(text.as_py())):
                    place.append(k)
                    hits.append((*h, round(h[3] / h[4], 6)))
            cols = list(zip(*hits)) if hits else [[] for _ in range(6)]
            arrays = [pa.array(list(c), t) for c, t in zip(cols, (pa.string(), *[pa.int64()] * 4, pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place, pa.int32())), *arrays], names=schema.names)

    return rows.mapInArrow(run, schema)
