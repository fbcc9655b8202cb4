"""Licence scanning: matching statistics against a generalised suffix automaton of licence tokens, chained into spans.

The automaton holds every token run of every template. A text is streamed through it once; where a match cannot grow it
is a maximal match. Maximal matches that lie in order in one template and in the text are chained; a chain that covers
enough of its template is a span and gives the template's label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.common import lean, plain_words, raw, schema_of

#: Phrases that name a licence, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices and openings of public licences, by the label that the chained match gives.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "mit-text": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ],
    "agpl-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
}


@dataclass
class State:
    length: int = 0
    link: int = -1
    next: dict[int, int] = field(default_factory=dict)
    ends: set[tuple[int, int]] = field(default_factory=set)


class Automaton:
    """A suffix automaton of several token sequences; each state knows where in which sequence its runs end."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.states = [State()]
        for k, tokens in enumerate(sequences):
            last = 0
            for i, c in enumerate(tokens):
                last = self._extend(last, c)
                self.states[last].ends.add((k, i))
        for s in sorted(range(1, len(self.states)), key=lambda s: -self.states[s].length):
            if self.states[s].link > 0:
                self.states[self.states[s].link].ends |= self.states[s].ends

    def _clone(self, p: int, q: int, c: int) -> int:
        self.states.append(State(self.states[p].length + 1, self.states[q].link, dict(self.states[q].next)))
        new = self.states[q].link = len(self.states) - 1
        while p >= 0 and self.states[p].next.get(c) == q:
            self.states[p].next[c] = new
            p = self.states[p].link
        return new

    def _extend(self, last: int, c: int) -> int:
        if c in self.states[last].next:
            q = self.states[last].next[c]
            return q if self.states[q].length == self.states[last].length + 1 else self._clone(last, q, c)
        self.states.append(State(self.states[last].length + 1))
        new, p = len(self.states) - 1, last
        while p >= 0 and c not in self.states[p].next:
            self.states[p].next[c] = new
            p = self.states[p].link
        if p < 0:
            self.states[new].link = 0
        else:
            q = self.states[p].next[c]
            self.states[new].link = q if self.states[q].length == self.states[p].length + 1 else self._clone(p, q, c)
        return new

    def matches(self, tokens: list[int]) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) of each maximal match: the matching statistic at end, where it can't grow further."""
        s, n = 0, 0
        for i, c in enumerate(tokens):
            t = self.states[s].next.get(c)
            if t is None:
                if n:
                    yield i - 1, n, s
                while s > 0 and c not in self.states[s].next:
                    s = self.states[s].link
                    n = self.states[s].length
                t = self.states[s].next.get(c)
            s, n = (t, n + 1) if t is not None else (0, 0)
        if n:
            yield len(tokens) - 1, n, s


class Scanner:
    """Spans of licence templates in texts. min_match: tokens of the shortest match that counts. max_gap: tokens between
    chained matches, in the text or the template. min_cover: part of a template that a span covers at least."""

    def __init__(self, templates: dict[str, list[str]], min_match: int = 4, max_gap: int = 12, min_cover: float = 0.6) -> None:
        self.min_match, self.max_gap, self.min_cover = min_match, max_gap, min_cover
        named = [(label, plain_words(x.encode())) for label, xs in templates.items() for x in xs]
        self.labels, self.lengths = [x for x, _ in named], [len(w) for _, w in named]
        self.vocabulary: dict[bytes, int] = {}
        self.automaton = Automaton([[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words] for _, words in named])

    def spans(self, words: list[bytes]) -> list[tuple[str, int, int, float]]:
        """(label, first word, last word, covered part of the template), in order of place; one span for each place."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
        known = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).astype(np.int8), [0]))))
        chains: list[list[int]] = []  # template, first, last in text, last in template, covered
        opened: list[list[list[int]]] = [[] for _ in self.labels]  # of each template, those that a match can still join
        for a, b in zip(known[::2].tolist(), known[1::2].tolist()):
            if b - a < self.min_match:
                continue
            for end, n, s in self.automaton.matches(ids[a:b].tolist()):
                if n >= self.min_match:
                    for k, at in sorted(self.automaton.states[s].ends):
                        self._chain(chains, opened[k], k, a + end, at, n)
        found = [(self.labels[k], first, last, covered / self.lengths[k], covered) for k, first, last, _, covered in chains if covered >= self.min_cover * self.lengths[k]]
        found.sort(key=lambda x: (-x[4], -x[3], x[1], x[0]))
        taken: list[tuple] = []
        for x in found:
            if all(x[2] < y[1] or x[1] > y[2] for y in taken):
                taken.append(x)
        return sorted((x[:4] for x in taken), key=lambda x: (x[1], x[0]))

    def _chain(self, chains: list[list[int]], opened: list[list[int]], k: int, end: int, at: int, n: int) -> None:
        # matches start in ascending order, so a chain that ended too far before one is closed for good
        opened[:] = [c for c in opened if end - n - c[2] <= self.max_gap]
        for c in reversed(opened):
            if at > c[3] and end > c[2]:
                new = min(n, at - c[3], end - c[2])
                if at - new - c[3] <= self.max_gap and new > 0:
                    c[2:] = [end, at, c[4] + new]
                    return
        opened.append([k, end - n + 1, end, at, n])
        chains.append(opened[-1])


def phrase_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(start word, label) of every place where the words of a phrase stand consecutively."""
    out = []
    phrases = [(p.encode().split(), label) for p, label in PHRASES.items()]
    at = -1
    while True:
        try:
            at = words.index(b"license", at + 1)
        except ValueError:
            return sorted(out)
        for p, label in phrases:
            if at >= len(p) - 1 and words[at - len(p) + 1 : at + 1] == p:
                out.append((at - len(p) + 1, label))


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,last_word:long,cover:double>>"


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, min_match: int = 4, max_gap: int = 12, min_cover: float = 0.6) -> DataFrame:
    """A row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    score: the largest covered part of a template among the spans, 1 where a phrase stands, else 0. Null texts count as
    empty: no words, no labels, score 0. Equal rows each get their result; an empty table gives no rows. Where spans of
    several templates meet, the one that covers most words is taken, then the larger part of a template, the earlier start
    and the first label. Nothing is shuffled; other columns of docs are not read.
    """
    schema = schema_of(lean(docs), SCHEMA)
    templates = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        scanner, to = Scanner(templates, min_match, max_gap, min_cover), to_arrow_schema(schema)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), raw(batch.column("text"))):
                words = plain_words(text or b"")
                base, spans = phrase_places(words), scanner.spans(words)
                names = {label for _, label in base}
                score = max([0.0, *(min(1.0, x[3]) for x in spans), *(1.0 for _ in base[:1])])
                rows.append((doc_id, len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(names)), ",".join(sorted(names | {x[0] for x in spans})), score, [dict(zip(("label", "first_word", "last_word", "cover"), x)) for x in spans]))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * len(to), to)], schema=to)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
