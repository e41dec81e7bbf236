"""License scans: winnowed fingerprints pick candidates, banded alignment confirms them.

A template is a sequence of words (runs of letters and digits, A-Z in lower case). Of the hashes of
its word triples, each window of ``WINDOW`` triples contributes the least one to an inverted index;
so every passage of ``WINDOW + 2`` words that a text shares with a template hits the index. Hits of
nearly the same diagonal form a candidate, and the text around it is aligned with the whole template
within a band of diagonals: +2 for equal words, -1 for a gap or two different words. Reported are the
words of the template that match, as a share (coverage), and the span of the text from the first to
the last of them. Templates of under ``SHORT`` words have to match whole. Of overlapping spans the one with more matched words stays, then the better covered.

The index grows with the templates, which are a parameter, and not with the texts.

Inputs and edge cases: a null or empty text has no match; texts are scanned whole; a template can
match several times in a text; repeated rows give repeated matches; an empty table or no templates
give an empty result; a template needs at least three words; a null id is kept; of templates that match the
same words equally well, the first by name stays; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, mix64, table

GRAM, WINDOW = 3, 2
#: Least coverage that is reported; half the width of the band, in words, at least, and as a share.
COVERAGE, BAND, BAND_SHARE = 0.8, 4, 0.1
#: Templates of fewer words have to match whole: a word more or less is another license there.
SHORT = 9
TOKEN = re.compile(rb"[a-z0-9]+")
MATCH = "license_id string, coverage double, matched int, start int, end int"

#: Texts and notices as license stewards publish them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "LGPL-2.1-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. "
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."
    ),
    "AGPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    "MIT-text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-condition": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-2-Clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-3-Clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "Unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. "
        "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."
    ),
    "Zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    **{f"SPDX-{x}": f"SPDX-License-Identifier: {x}" for x in ("Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-or-later", "AGPL-3.0-only", "MPL-2.0", "EPL-2.0", "Unlicense", "CC0-1.0")},
}


def align(text: list[int], template: list[int], shift: int, band: int) -> tuple[int, int, int]:
    """Words matched, and the first and last matched word of ``text`` (-1 without a match).

    Cell (i, j) aligns the text's word ``i`` with the template's word ``j``; only cells with
    ``|i - j - shift| <= band`` exist. The best local path of least start wins.
    """
    width = 2 * band + 1
    # Per cell of a row: score, matched, first matched word, last matched word.
    zero = (0, 0, -1, -1)
    row: list[tuple] = [zero] * width
    best = zero
    for j, word in enumerate(template):
        new: list[tuple] = [zero] * width
        for c in range(width):
            i = j + shift - band + c
            if not 0 <= i < len(text):
                continue
            score, matched, first, last = row[c]  # cell (i - 1, j - 1)
            if text[i] == word:
                cell = (score + 2, matched + 1, i if first < 0 else first, i)
            else:
                cell = (score - 1, matched, first, last)
            for other in (row[c + 1] if c + 1 < width else zero, new[c - 1] if c else zero):
                if other[0] - 1 > cell[0]:
                    cell = (other[0] - 1, *other[1:])
            new[c] = cell if cell[0] > 0 else zero
            if new[c][0] > best[0]:
                best = new[c]
        row = new
    return best[1:]


class Scanner:
    """The inverted index of the templates' fingerprints."""

    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE) -> None:
        self.coverage = coverage
        self.names = sorted(n for n in templates if len(TOKEN.findall(templates[n].encode().lower())) >= GRAM)
        tokens = [TOKEN.findall(templates[n].encode().lower()) for n in self.names]
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for t in tokens for w in t}))}
        self.templates = [[self.vocabulary[w] for w in t] for t in tokens]
        postings: dict[int, list[tuple[int, int]]] = {}
        for t, ids in enumerate(self.templates):
            codes = self.codes(np.array(ids, np.int64))
            order = mix64(codes.view(np.uint64))
            picked = set()
            for at in range(max(1, len(codes) - WINDOW + 1)):
                window = order[at : at + WINDOW]
                picked.add(at + len(window) - 1 - int(window[::-1].argmin()))
            for at in sorted(picked):
                postings.setdefault(int(codes[at]), []).append((t, at))
        self.keys = np.array(sorted(postings), np.int64)
        self.postings = postings
        self.known: dict = {}

    @staticmethod
    def codes(ids: np.ndarray) -> np.ndarray:
        """One number for each triple of word numbers; exact up to two million words."""
        n = max(0, len(ids) - GRAM + 1)
        return (ids[:n] << 42) | (ids[1 : n + 1] << 21) | ids[2 : n + 2]

    def scan(self, text: bytes) -> list[tuple[str, float, int, int, int]]:
        """``(license_id, coverage, matched, start, end)`` in the text, places in code points."""
        low = text.lower()
        words = TOKEN.findall(low)
        if len(words) < GRAM or not len(self.keys):
            return []
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))
        codes = self.codes(ids)
        at = np.minimum(np.searchsorted(self.keys, codes), len(self.keys) - 1)
        hits = np.flatnonzero(self.keys[at] == codes)
        if not len(hits):
            return []
        found: list[tuple] = []
        diagonals: dict[int, list[int]] = {}
        for i in hits.tolist():
            for t, j in self.postings[int(codes[i])]:
                diagonals.setdefault(t, []).append(i - j)
        for t, shifts in diagonals.items():
            size = len(self.templates[t])
            band = max(BAND, int(BAND_SHARE * size))
            reach = None
            for d in sorted(shifts):
                if reach is not None and d <= reach:
                    continue
                reach = d + band
                lo, hi = max(0, d - band), min(len(words), d + size + 2 * band + 1)
                matched, first, last = self._aligned(t, tuple(ids[lo:hi].tolist()), d + band // 2 - lo, band + band // 2)
                if matched >= (size if size < SHORT else self.coverage * size):
                    found.append((matched, matched / size, t, lo + first, lo + last))
        found.sort(key=lambda x: (-x[0], -x[1], x[3], x[2]))
        kept: list[tuple] = []
        for x in found:
            if all(x[4] < y[3] or x[3] > y[4] for y in kept):
                kept.append(x)
        if not kept:
            return []
        spans = [m.span() for m in TOKEN.finditer(low)]

        def place(byte: int) -> int:
            return len(text[:byte].decode("utf-8", "replace"))

        return [(self.names[t], share, matched, place(spans[a][0]), place(spans[b][1])) for matched, share, t, a, b in sorted(kept, key=lambda x: x[3])]

    def _aligned(self, t: int, part: tuple[int, ...], shift: int, band: int) -> tuple[int, int, int]:
        key = (t, part, shift)
        if key not in self.known:
            if len(self.known) >= 20_000:
                self.known.clear()
            self.known[key] = align(list(part), self.templates[t], shift, band)
        return self.known[key]


@lru_cache(maxsize=2)
def _scanner(templates: tuple[tuple[str, str], ...], coverage: float) -> Scanner:
    return Scanner(dict(templates), coverage)


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """``doc_id`` and ``matches``, an array of ``MATCH``, of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    given = tuple(sorted(templates.items()))
    struct = pa.list_(pa.struct([("license_id", pa.string()), ("coverage", pa.float64()), ("matched", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    def make():
        scanner = _scanner(given, coverage)

        def fn(b: pa.RecordBatch) -> pa.RecordBatch:
            names = ("license_id", "coverage", "matched", "start", "end")
            matches = [[dict(zip(names, m, strict=True)) for m in scanner.scan(x or b"")] for x in b.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(matches, struct)], names=["doc_id", "matches"])

        return fn

    return map_arrow(docs.select("doc_id", F.col("text").cast("binary")), f"doc_id {kind}, matches array<struct<license_id:string,coverage:double,matched:int,start:int,end:int>>", make)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license notice found in all documents."""
    return scan(table(spark, sf_dir, "documents")).select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")
