"""License scans by patience alignment.

A template and a window of the text are aligned on the words that are unique to
both: the longest increasing subsequence of their places is anchored, equal
words around the ends are matched, and each gap between anchors is aligned in
the same way. The share of the template's words that are matched is its
coverage. Windows come from every place where a distinctive word of a template
occurs, so a notice is found anywhere in a text and as often as it stands there.
Each place is tried with windows of three widths and the best alignment counts,
so that copies that stand side by side do not hide each other's unique words.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hexsupport.llm.store import bound_batches

#: Customary public license notices, whole or their usual short forms.
TEMPLATES = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0-short": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-short": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "GPL-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "MIT-short": "Released under the MIT License.",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}

_WORD = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")


def words_of(text: str) -> list[str]:
    return [m.group().lower() for m in _WORD.finditer(text)]


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence of pairs (in order of the first) whose second numbers increase."""
    tops: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        before.append(last[at - 1] if at else -1)
        tops[at : at + 1], last[at : at + 1] = [j], [k]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def align(left: list[str], right: list[str]) -> list[tuple[int, int]]:
    """The matched places (left, right), increasing in both."""
    matched: list[tuple[int, int]] = []
    todo = [(0, len(left), 0, len(right))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and left[a] == right[c]:
            matched.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and left[b - 1] == right[d - 1]:
            b, d = b - 1, d - 1
            matched.append((b, d))
        if a >= b or c >= d:
            continue
        once: dict[str, int] = {}
        for i in range(a, b):
            once[left[i]] = -1 if left[i] in once else i
        there: dict[str, int] = {}
        for j in range(c, d):
            there[right[j]] = -1 if right[j] in there else j
        anchors = _increasing([(i, there[w]) for w, i in once.items() if i >= 0 and there.get(w, -1) >= 0])
        if anchors:
            for (i, j), (x, y) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)], strict=True):
                todo.append((i + 1, x, j + 1, y))
            matched += anchors
    return sorted(matched)


class Scanner:
    """Templates, and the words by which each is looked for."""

    def __init__(self, templates: dict[str, str], least: float):
        self.least = least
        self.words = {name: words_of(text) for name, text in templates.items()}
        self.counts = {name: Counter(own) for name, own in self.words.items()}
        #: A text that lacks all of these lacks so many of the template's words that it cannot reach ``least``.
        self.marks: dict[str, dict[str, int]] = {}
        spread: dict[str, int] = {}
        for own in self.words.values():
            for w in set(own):
                spread[w] = spread.get(w, 0) + 1
        for name, own in self.words.items():
            spare = int(len(own) * (1 - least) + 1e-9) + 1
            marks: dict[str, int] = {}
            for w in sorted(set(own), key=lambda w: (own.count(w), -len(w), spread[w], w)):
                if spare <= 0:
                    break
                marks[w] = own.index(w)
                spare -= own.count(w)
            self.marks[name] = marks
        self.by_mark: dict[str, list[str]] = {}
        for name, marks in self.marks.items():
            for w in marks:
                self.by_mark.setdefault(w, []).append(name)
        self.marked = set(self.by_mark)

    def _common(self, name: str, window: list[str]) -> int:
        """The words that a template and a window have in common, each as often as in both: no alignment matches more."""
        spare, n = dict(self.counts[name]), 0
        for w in window:
            if spare.get(w):
                spare[w] -= 1
                n += 1
        return n

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(license, coverage, start, end) of the notices in a text, by start; of overlapping ones the best alone."""
        low = text.lower()
        if not any(w in low for w in self.marked):
            return []
        spots = [(m.group().lower(), m.start(), m.end()) for m in _WORD.finditer(text)]
        words = [w for w, _, _ in spots]
        starts: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            for name in self.by_mark.get(w, ()):
                starts.setdefault(name, []).append(i - self.marks[name][w])
        hits = []
        for name, at in starts.items():
            own = self.words[name]
            whole, begun = len(own) // 2 + 2, None
            for s in sorted(set(at)):
                if begun is not None and s <= begun + len(own) // 4:
                    continue  # the whole notice was found from here
                best: list[tuple[int, int]] = []
                # the widest window holds all that the others hold; in narrower ones a notice is told from copies beside it
                for slack in (whole, whole // 2, 0):
                    lo, hi = max(0, s - slack), min(len(words), max(0, s + len(own) + slack))
                    if self._common(name, words[lo:hi]) < self.least * len(own):
                        break
                    pairs = [(i, lo + j) for i, j in align(own, words[lo:hi])]
                    if pairs and (not best or (len(pairs), best[-1][1] - best[0][1]) > (len(best), pairs[-1][1] - pairs[0][1])):
                        best = pairs
                if best and len(best) >= self.least * len(own):
                    first, last = best[0][1], best[-1][1]
                    hits.append((len(best) / len(own), len(best), name, spots[first][1], spots[last][2]))
                    begun = s if len(best) == len(own) else None
        kept: list[tuple[str, float, int, int]] = []
        for coverage, size, name, a, b in sorted(hits, key=lambda h: (-h[1] * h[0], -h[0], h[2], h[4] - h[3], h[3])):
            if all(b <= c or d <= a for _, _, c, d in kept):
                kept.append((name, round(coverage, 6), a, b))
        return sorted(kept, key=lambda h: h[2])


def scanned(df: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, text_col: str = "text", out_col: str = "licenses") -> DataFrame:
    """``df`` with ``out_col``: an array of (license, coverage, start, end), places in code points, end exclusive.

    A notice counts from a coverage of ``least``. Defined results: null and empty
    texts have none; a notice that occurs repeatedly is listed each time; of
    overlapping notices the one with more matched words stays; rows are scanned
    each by its own text, of any length and whole; a column of the name
    ``out_col`` (in any case) is replaced, others pass through whatever their
    names. An empty table gives an empty one.
    """
    bound_batches(df.sparkSession)
    templates = TEMPLATES if templates is None else templates
    rest = [c for c in df.columns if c.lower() != out_col.lower()]
    base = df.select(*(F.col(f"`{c}`") for c in rest))
    at = rest.index(text_col)
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least)
        for batch in batches:
            found = [[dict(zip(("license", "coverage", "start", "end"), hit, strict=True)) for hit in scanner.scan(text)] if text else [] for text in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, out_col])

    item = T.StructType().add("license", "string").add("coverage", "double").add("start", "integer").add("end", "integer")
    return base.mapInArrow(run, T.StructType(list(base.schema.fields)).add(out_col, T.ArrayType(item)))
