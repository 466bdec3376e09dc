"""License scans by patience alignment.

A template's coverage is the share of its words that the text has in the template's order. Words that occur once in both are
anchors; their longest increasing subsequence is matched; between anchors the gaps are aligned in the same way; equal heads and
tails of a gap match at once, and a gap without anchors is aligned by longest common subsequence.

A place of a license is a run of aligned words with the wanted coverage, in which at least every second word of the text is the
license's; so it is at most twice as long as what it covers, and windows of two template lengths to either side of each telling
word hold every place whole. Where templates meet at a place, the one with the most words, weighed by the share that both
sides have in common, is the license; words that tell a template from its likes (a version, NC or SA) must be there. A place whose text
says another version, or a qualifier that the template lacks (ND, SA, Lesser), is no place of it, whether or not there is a template for what it says.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Share of a template's words at a place; share of the place's words that are the template's.
COVERAGE, DENSITY = 0.8, 0.5
_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")

# Notices and texts of well-known licenses, as their stewards publish them.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.',
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "BSL-1.0": "Boost Software License - Version 1.0 - August 17th, 2003. Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
} | {
    f"{name}-spdx": f"SPDX-License-Identifier: {name}"
    for name in ("MIT", "ISC", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-3.0-only", "AGPL-3.0-only", "CC-BY-4.0", "CC-BY-SA-4.0")
}

#: Words that make another license of one that lacks them, and words that a version follows.
QUALIFIERS = {"nc", "nd", "sa", "noncommercial", "noderivatives", "noderivs", "sharealike", "lesser", "affero", "library"}
VERSIONED = {"version", "v", "by", "license", "licence", "public", "apache", "gpl", "lgpl", "agpl", "mpl", "epl"} | QUALIFIERS
_VERSION = re.compile(r"v?\d{1,2}(?:\.\d+)*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matching places (i, j), both rising, of equal words of ``a`` and ``b``."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, ie, j, je = todo.pop()
        while i < ie and j < je and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < ie and j < je and a[ie - 1] == b[je - 1]:
            ie, je = ie - 1, je - 1
            out.append((ie, je))
        if i == ie or j == je:
            continue
        once_a, once_b = Counter(a[i:ie]), Counter(b[j:je])
        place = {w: n for n, w in enumerate(b[j:je], j) if once_b[w] == 1}
        anchors = [(n, place[w]) for n, w in enumerate(a[i:ie], i) if once_a[w] == 1 and w in place]
        if anchors:
            at = (i, j)
            for x, y in [*_increasing(anchors), (ie, je)]:
                todo.append((at[0], x, at[1], y))
                if x < ie:
                    out.append((x, y))
                at = (x + 1, y + 1)
        else:
            out += [(x + i, y + j) for x, y in _common(a[i:ie], b[j:je])]
    return sorted(out)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence that rises in the second place too."""
    tails: list[int] = []
    ends, back = [], []
    for k, (_, y) in enumerate(pairs):
        n = bisect_left(tails, y)
        back.append(ends[n - 1] if n else -1)
        if n == len(tails):
            tails.append(y)
            ends.append(k)
        else:
            tails[n], ends[n] = y, k
    out, k = [], ends[-1]
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def best_run(pairs: list[tuple[int, int]], least: int) -> tuple[int, int] | None:
    """Bounds of the longest run of ``least`` pairs or more that is dense enough in the text; the shortest in the text, then the
    first of these."""
    best = None
    for i in range(len(pairs) - least + 1):
        for j in range(len(pairs), i + least - 1, -1):
            n, span = j - i, pairs[j - 1][0] - pairs[i][0] + 1
            if best and n < best[0]:
                break
            if n >= DENSITY * span:
                best = max(best or (0,), (n, -span, -i, j))
    return (-best[2], best[3]) if best else None


class Scanner:
    """Templates with their telling words (the longest ones that together are so many of a template's words that a text without
    any of them can't reach the coverage) and the words that tell them from their likes."""

    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE):
        self.coverage, self.templates = coverage, []
        every = {name: words(text) for name, text in templates.items()}
        for name, own in every.items():
            tally, probes = Counter(own), set()
            for w in sorted(tally, key=lambda w: (-len(w), w)):
                probes.add(w)
                if sum(tally[p] for p in probes) > (1 - coverage) * len(own) + 1e-9:
                    break
            likes = [{*range(len(own))} - {j for _, j in pairs} for other, said in every.items() if other != name and len(pairs := patience(said, own)) >= self._least(own)]
            self.templates.append((name, own, probes, [x for x in likes if x]))

    def _least(self, own: list[str]) -> int:
        return max(1, math.ceil(self.coverage * len(own) - 1e-9))

    def _place(self, said: list[str], own: list[str], likes: list[set[int]], start: int, stop: int):
        """(matched words, first, last) of the best place in a window, or None."""
        pairs = patience(said[start:stop], own)
        if not (run := best_run(pairs, self._least(own))):
            return None
        pairs = pairs[slice(*run)]
        matched = {j for _, j in pairs}
        if self._says_another(said[start : stop + 1], own, pairs, matched):
            return None
        if any(len(x & matched) < self.coverage * len(x) for x in likes):
            return None
        return len(pairs), start + pairs[0][0], start + pairs[-1][0]

    @staticmethod
    def _says_another(said: list[str], own: list[str], pairs: list[tuple[int, int]], matched: set[int]) -> bool:
        """Whether the place has a version or a qualifier that isn't the template's: inside, or, where the template's own version isn't there, right after."""
        version = lambda text, i: i > 0 and bool(_VERSION.fullmatch(text[i])) and text[i - 1] in VERSIONED
        versions = {j for j in range(len(own)) if version(own, j)}
        first, last, aligned = pairs[0][0], pairs[-1][0], {i for i, _ in pairs}
        for i in range(first, last + 1):
            if i not in aligned and (said[i] in QUALIFIERS and said[i] not in own or versions and version(said, i)):
                return True
        # a part of the words is enough to find a license, so its end may be missing: what stands there instead counts
        lacks = versions and not versions & matched
        return bool(lacks and last + 1 < len(said) and version(said, last + 1)) or (len(own) < 20 and last + 1 < len(said) and said[last + 1] in QUALIFIERS and said[last + 1] not in own)

    def scan(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """(license, coverage, first and last word of the best place, number of places) of a whole text."""
        low = text.lower()
        found, said = [], None
        for name, own, probes, likes in self.templates:
            if not any(p in low for p in probes):
                continue
            said = words(text) if said is None else said
            n, at = len(own), 0
            for h, w in enumerate(said):
                if h < at or w not in probes:
                    continue
                j = own.index(w)
                # as long as the template first, so that copies that follow one another aren't mixed
                for slack in (n // 8 + 2, 2 * n):
                    if place := self._place(said, own, likes, max(at, h - j - slack), h - j + n + slack):
                        count, first, last = place
                        found.append((count * count / (n + last - first + 1 - count), count / n, first, last, name))
                        at = max(last, h) + 1
                        break
        taken, out = [], {}
        for _, share, first, last, name in sorted(found, key=lambda x: (-x[0], x[2], x[4])):
            if all(last < a or b < first for a, b in taken):
                taken.append((first, last))
                out.setdefault(name, []).append((share, -first, -last))
        return [(name, *(lambda b: (b[0], -b[1], -b[2]))(max(places)), len(places)) for name, places in out.items()]


_scanners: dict[tuple, Scanner] = {}


class _Scan:
    def __init__(self, templates: dict[str, str], coverage: float):
        self.key = (tuple(templates.items()), coverage)

    def __call__(self, batch) -> dict:
        if self.key not in _scanners:
            _scanners[self.key] = Scanner(dict(self.key[0]), self.key[1])
        scanner, names = _scanners[self.key], ("doc_id", "license", "coverage", "first_word", "last_word", "places")
        out = {n: [] for n in names}
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for row in scanner.scan(text) if text else []:
                for n, v in zip(names, (doc, *row), strict=True):
                    out[n].append(v)
        return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, license, coverage, first_word, last_word, places: one row for each template found in a document.

    A template counts as found where ``coverage`` of its words or more are there in its order and no other template fits the
    place better. Null and empty texts hold none; repeated rows are answered one by one; ties between places go to the earlier;
    other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_arrow(rows, _Scan(templates or TEMPLATES, coverage), "doc_id long, license string, coverage double, first_word long, last_word long, places long")
