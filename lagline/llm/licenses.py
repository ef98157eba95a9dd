"""License notices in documents, by patience alignment against templates.

Every whole text is read as words (lower case, without marks around them). A stretch about as long
as a template is looked at where it holds so many of the template's words, ordinary ones aside,
that the coverage wanted is possible; it is aligned to the template by patience: words that occur once in both are anchors, their longest
increasing subsequence is kept, and the gaps between kept anchors are aligned in the same way,
at last by the longest common subsequence where no word is unique. Coverage is the share of
the template's words that are aligned. A notice counts where coverage reaches ``COVERAGE`` and the
words that tell the version (3 from 2, Lesser, Affero) are among those aligned. Of notices that
overlap, the one with the most aligned words is reported, then the one with the highest coverage,
then the first template; a text may carry any number of notices.

A null or empty text has no notice, a null ``doc_id`` is reported as null, repeated rows are
reported each, an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame

from lagline.llm.common import narrow

COVERAGE = 0.8
VOCABULARY = 1 << 19
FOUND = "doc_id long, license string, first_word long, last_word long, coverage double"
SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("license", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("coverage", pa.float64()),
])
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())

# Words of ordinary prose, which point at no license.
PROSE = frozenset(
    b"a all an and any are as at be but by can do file for form from had has have if in is it its may must no not of on or other "
    b"shall that the these this to under use used was were which with without you your work terms following".split()
)

# Public license notices, with the words that tell each from its next of kin.
TEMPLATES: dict[str, tuple[str, str]] = {
    "MIT (line)": ("Released under the MIT License", "mit"),
    "Apache-2.0 (line)": ("Licensed under the Apache License, Version 2.0", "apache 2.0"),
    "GPL-3.0 (line)": (
        "This work is licensed under the GNU General Public License, version 3",
        "gnu 3",
    ),
    "GPL-2.0 (line)": ("This work is licensed under the GNU General Public License, version 2", "gnu 2"),
    "LGPL-3.0 (line)": (
        "This work is licensed under the GNU Lesser General Public License, version 3",
        "lesser 3",
    ),
    "AGPL-3.0 (line)": (
        "This work is licensed under the GNU Affero General Public License, version 3",
        "affero 3",
    ),
    "BSD-3-Clause (line)": ("Released under the BSD 3-Clause License", "bsd 3-clause"),
    "BSD-2-Clause (line)": ("Released under the BSD 2-Clause License", "bsd 2-clause"),
    "CC-BY-NC-4.0 (line)": ("Licensed under CC BY-NC 4.0", "cc by-nc 4.0"),
    "CC-BY-4.0 (line)": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "attribution 4.0",
    ),
    "CC-BY-SA-4.0 (line)": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "attribution-sharealike 4.0",
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files, to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
        "of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software.",
        "",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
        "apache",
    ),
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version.",
        "3 later",
    ),
    "GPL-2.0-or-later": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation; either version 2 of the License, "
        "or (at your option) any later version.",
        "2 later",
    ),
    "GPL-2.0-only": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License version 2 as published by the Free Software Foundation.",
        "2",
    ),
    "LGPL-2.1-or-later": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, "
        "or (at your option) any later version.",
        "lesser 2.1 later",
    ),
    "LGPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version.",
        "lesser 3 later",
    ),
    "AGPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "Affero General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version.",
        "affero 3 later",
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
        "",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. Neither the name of the copyright "
        "holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission.",
        "endorse",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
        "mozilla",
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public "
        "License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "eclipse 2.0",
    ),
    "CC0-1.0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights "
        "to this work.",
        "waived",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means.",
        "",
    ),
}


def words_of(text: bytes) -> list[bytes]:
    return [w.strip(MARKS) for w in text.lower().split()]


def _increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence, by patience piles."""
    tops: list[int] = []
    pile_top: list[int] = []
    below = [-1] * len(values)
    for i, value in enumerate(values):
        pile = bisect_left(tops, value)
        if pile == len(tops):
            tops.append(value)
            pile_top.append(i)
        else:
            tops[pile], pile_top[pile] = value, i
        below[i] = pile_top[pile - 1] if pile else -1
    out, i = [], pile_top[-1] if pile_top else -1
    while i >= 0:
        out.append(i)
        i = below[i]
    return out[::-1]


def _common_subsequence(a, b, a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    n, m = a1 - a0, b1 - b0
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            same = a[a0 + i] == b[b0 + j]
            best[i][j] = best[i + 1][j + 1] + 1 if same else max(best[i + 1][j], best[i][j + 1])
    pairs, i, j = [], 0, 0
    while i < n and j < m:
        if a[a0 + i] == b[b0 + j]:
            pairs.append((a0 + i, b0 + j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return pairs


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places (in a, in b), increasing in both."""
    pairs: list[tuple[int, int]] = []
    waiting = [(0, len(a), 0, len(b))]
    while waiting:
        a0, a1, b0, b1 = waiting.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {b[j]: j for j in range(b0, b1) if once_b[b[j]] == 1}
        anchors = [(i, where[a[i]]) for i in range(a0, a1) if once_a[a[i]] == 1 and a[i] in where]
        kept = [anchors[k] for k in _increasing([j for _, j in anchors])]
        if not kept:
            pairs += _common_subsequence(a, b, a0, a1, b0, b1)
            continue
        pairs += kept
        for (i0, j0), (i1, j1) in zip([(a0 - 1, b0 - 1), *kept], [*kept, (a1, b1)]):
            waiting.append((i0 + 1, i1, j0 + 1, j1))
    return sorted(pairs)


def _drawn_together(pairs: list[tuple[int, int]], b: list) -> list[tuple[int, int]]:
    """The same words aligned to the nearest equal ones: the earliest end, then the latest start."""
    for step in (1, -1):
        pairs, last = pairs[::step], None
        for k, (i, j) in enumerate(pairs):
            if last is not None:
                last += step
                while b[last] != b[j]:
                    last += step
                pairs[k] = (i, last)
            else:
                last = j
        pairs = pairs[::step]
    return pairs


class Scanner:
    """Templates with the words that point at them."""

    def __init__(self, templates: Mapping[str, tuple[str, str]] = TEMPLATES, coverage: float = COVERAGE):
        self.coverage = coverage
        self.names = list(templates)
        self.words = [words_of(text.encode()) for text, _ in templates.values()]
        self.telling = [set(words_of(words.encode())) for _, words in templates.values()]
        self.least = [-int(-coverage * len(words) // 1) for words in self.words]
        self.points: dict[bytes, list[int]] = {}
        self.needed: list[int] = []
        self.offset = [{w: words.index(w) for w in words} for words in self.words]
        for t, words in enumerate(self.words):
            rare = [w for w in words if w not in PROSE]
            # A notice lacks at most len(words) - least of the template's words.
            self.needed.append(max(1, len(rare) - (len(words) - self.least[t])))
            for word in set(rare):
                self.points.setdefault(word, []).append(t)
        self.known: dict[bytes, bytes] = {}

    def _normal(self, raw: list[bytes]) -> list[bytes]:
        """Words as in ``words_of``; unknown ones are remembered up to a bound."""
        if len(self.known) > VOCABULARY:
            self.known.clear()
        known, get, out = self.known, self.known.get, []
        for word in raw:
            value = get(word)
            if value is None:
                value = known[word] = word.lower().strip(MARKS)
            out.append(value)
        return out

    def scan(self, text: bytes) -> list[tuple[str, int, int, float]]:
        """(license, first word, last word, coverage) of every notice."""
        words = self._normal(text.split())
        points = self.points
        if points.keys().isdisjoint(words):
            return []
        at: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            for t in points.get(word, ()):
                at.setdefault(t, []).append(i)
        found = []
        for t, places in at.items():
            if len(places) >= self.needed[t]:
                found += self._notices(t, places, words)
        taken: list[tuple[int, int]] = []
        out = []
        for _, _, t, first, last, share in sorted(found):
            k = bisect_left(taken, (first, last))
            if (k == 0 or taken[k - 1][1] < first) and (k == len(taken) or taken[k][0] > last):
                taken.insert(k, (first, last))
                out.append((t, self.names[t], first, last, share))
        return [row[1:] for row in sorted(out)]

    def _notices(self, t: int, places: list[int], words: list[bytes]):
        """(-aligned words, -coverage, template, first word, last word, coverage) of one template's notices."""
        template, telling = self.words[t], self.telling[t]
        more, least = self.needed[t] - 1, self.least[t]
        slack = len(template) // 4 + 2
        reach = len(template) + slack
        wanted = Counter(template)
        out, done = [], -1
        for k in range(len(places) - more):
            i = places[k]
            if i <= done or places[k + more] - i >= reach:
                continue
            # Any surviving word of the notice that stands once in the template gives its place.
            start = i - self.offset[t][words[i]]
            begin, end = max(done + 1, start - slack), min(len(words), start + reach)
            region = words[begin:end]
            if (Counter(region) & wanted).total() < least:
                continue
            pairs = self._tight(_drawn_together(patience(template, region), region), template)
            if len(pairs) >= least and telling <= {template[a] for a, _ in pairs}:
                first, last = begin + pairs[0][1], begin + pairs[-1][1]
                share = len(pairs) / len(template)
                out.append((-len(pairs), -share, t, first, last, share))
                done = last
        return out

    @staticmethod
    def _tight(pairs: list[tuple[int, int]], template: list[bytes]) -> list[tuple[int, int]]:
        """Without aligned words at either end that stand far from the rest."""
        allowed = len(template) // 4 + 2
        while len(pairs) > 1 and pairs[1][1] - pairs[0][1] > pairs[1][0] - pairs[0][0] + allowed:
            pairs = pairs[1:]
        while len(pairs) > 1 and pairs[-1][1] - pairs[-2][1] > pairs[-1][0] - pairs[-2][0] + allowed:
            pairs = pairs[:-1]
        return pairs


def notices(docs: DataFrame, templates: Mapping[str, tuple[str, str]] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, license, first_word, last_word, coverage): one row per notice found."""
    templates = dict(templates)

    def run(batches):
        scanner = Scanner(templates, coverage)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                rows += [(doc_id.as_py(), *hit) for hit in scanner.scan(text.as_py())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SCHEMA)], schema=SCHEMA)

    return narrow(docs).mapInArrow(run, FOUND)
