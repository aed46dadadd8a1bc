"""License scans: winnowed template fingerprints pick candidates, banded alignment measures them.

Templates are short and fixed, so their inverted index travels with the job and no row is shuffled.
Every word trigram of a text, for short templates every bigram, is looked up in the index. The diagonal with most hits of a template is the
middle of a band, wide enough to take in the diagonals beyond an insertion; an alignment within it gives matched words and a span.
A hit counts only with the words that tell its template from its kin (``REQUIRED``).
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vigilgrid.llm.words import mixed, slices, words_of, _MIX

# Public license notices.
TEMPLATES = {
    "mit-note": "Released under the MIT License.",
    "apache-note": "Licensed under the Apache License, Version 2.0.",
    "gpl3-note": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-note": "Licensed under CC BY-NC 4.0.",
}
#: First paragraphs, which many texts give alone.
PARTS = {
    "mit-part": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
            "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
            "included in all copies or substantial portions of the Software."),
    "isc-part": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."),
    "bsd-part": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
            "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
            "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
            "the following disclaimer in the documentation and/or other materials provided with the distribution."),
    "apache-part": ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
               "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
               "law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES "
               "OR CONDITIONS OF ANY KIND, either express or implied."),
    "gpl-part": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
            "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "unlicense-part": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
                  "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
                  "commercial or non-commercial, and by any means."),
}
_NO_ENDORSEMENT = ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
                   "from this software without specific prior written permission.")
_MIT_WARRANTY = ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
                 "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS{} BE LIABLE FOR ANY CLAIM, "
                 "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
                 "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_ISC_WARRANTY = ("THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
                 "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
                 "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
                 "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
_BSD_WARRANTY = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT "
                 "NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL "
                 "THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
                 "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
                 "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
                 "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
TEMPLATES |= {
    "mit": f"{PARTS['mit-part']} {_MIT_WARRANTY.format(' OR COPYRIGHT HOLDERS')}",
    "isc": f"{PARTS['isc-part']} {_ISC_WARRANTY}",
    "bsd": f"{PARTS['bsd-part']} {_BSD_WARRANTY}",
    "bsd-3": f"{PARTS['bsd-part']} {_NO_ENDORSEMENT} {_BSD_WARRANTY}",
    "apache": f"{PARTS['apache-part']} See the License for the specific language governing permissions and limitations under the License.",
    "gpl": (f"{PARTS['gpl-part']} This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
            "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have "
            "received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
            "with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "unlicense": (f"{PARTS['unlicense-part']} In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and "
                  "all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and "
                  "to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of "
                  f"all present and future rights to this software under copyright law. {_MIT_WARRANTY.format('')} For more information, please "
                  "refer to <https://unlicense.org/>"),
} | PARTS
_GNU_WARRANTY = ("This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
                 "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1}General Public License for more details. You should have "
                 "received a copy of the GNU {1}General Public License along with this {0}.")
# Kinds of the GNU licenses as (thing, word of the kind, version).
GNU = {"gpl2": ("program", "", "2"), "lgpl21": ("library", "Lesser ", "2.1"), "lgpl3": ("library", "Lesser ", "3"), "agpl3": ("program", "Affero ", "3")}
GNU_PARTS = {f"{name}-part": (f"This {thing} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind}General Public "
                              f"License as published by the Free Software Foundation; either version {version} of the License, or (at your option) any "
                              "later version.") for name, (thing, kind, version) in GNU.items()}
GNU_NOTES = {f"{name}-note": f"This work is licensed under the GNU {kind}General Public License, version {version}." for name, (_, kind, version) in GNU.items()}
# Creative Commons kinds by their short and long names.
CREATIVE = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nd": "Attribution-NoDerivatives", "by-nc": "Attribution-NonCommercial",
            "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}
PARTS |= GNU_PARTS | {
    "boost-part": ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
                   "documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the "
                   "Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"),
}
TEMPLATES |= PARTS | GNU_NOTES | {f"cc-{k}-note": f"Licensed under CC {k.upper()} 4.0." for k in CREATIVE} | {
    f"cc-{k}": f"This work is licensed under a Creative Commons {name} 4.0 International License." for k, name in CREATIVE.items()} | {
    name: f"{GNU_PARTS[name + '-part']} {_GNU_WARRANTY.format(thing, kind)}" for name, (thing, kind, _) in GNU.items()} | {
    "bsd-note": "Released under the BSD License.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "boost-note": ("Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at "
                   "http://www.boost.org/LICENSE_1_0.txt)"),
    "zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
             "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
             "applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not "
             "be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in "
             "the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not "
             "be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."),
    "epl": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
            "https://www.eclipse.org/legal/epl-2.0/"),
}
#: Words that must match for a hit to bear the name, as they stand in the template without edge marks and in lower case.
REQUIRED = {"mit-note": ["mit"], "bsd-note": ["bsd"], "apache-note": ["apache"], "apache-part": ["apache"], "apache": ["apache"], "mpl": ["mozilla"],
            "epl": ["eclipse"], "boost-note": ["boost"], "gpl3-note": ["gnu", "3"], "gpl-part": ["gnu", "3"], "gpl": ["gnu", "3"], "cc0": ["waived"],
            **{f"cc-{k}-note": ["cc", k] for k in CREATIVE}, **{f"cc-{k}": ["creative", name.lower()] for k, name in CREATIVE.items()},
            **{f"{name}{end}": ["gnu", *kind.lower().split(), version] for name, (_, kind, version) in GNU.items() for end in ("", "-part", "-note")}}
#: Templates with words in common; where their spans overlap, the one with most matched words counts.
FAMILY = ({name: name.removesuffix("-part") for name in PARTS} | {"bsd-3": "bsd", "apache-note": "apache"}
          | dict.fromkeys([*GNU, *GNU_PARTS, *GNU_NOTES, "gpl", "gpl-part", "gpl3-note"], "gnu"))
GRAM, BAND = 3, 8
#: Words that may be inserted in a text of a template, and what a match weighs against one of them.
REACH, WEIGHT = 64, 16
#: Least share of a template's words that must be matched.
COVERAGE = 0.75


def _grams(hashes: np.ndarray, size: int) -> np.ndarray:
    n = len(hashes) - size + 1
    return mixed(sum(hashes[i:i + n] * _MIX[i] for i in range(size))) if n > 0 else np.zeros(0, np.uint64)


def shared_run(n: int) -> int:
    """Words that follow one another, at least, where so many of ``n`` match as ``COVERAGE`` asks and the others are changed or left out."""
    matched = max(1, math.ceil(COVERAGE * n))
    return -(-matched // (n - matched + 1))


def winnowed(grams: np.ndarray, width: int) -> list[int]:
    """Places of the least gram of every window, the last of equals."""
    width = min(width, len(grams))
    return sorted({i + width - 1 - int(np.argmin(grams[i:i + width][::-1])) for i in range(len(grams) - width + 1)}) if width else []


def index(templates: dict[str, str]) -> tuple[list[np.ndarray], dict[int, dict[int, list[tuple[int, int]]]]]:
    """Word hashes of each template, and by gram size gram -> (template, place).

    Grams and windows are as wide as the run every hit shares allows, so none is missed; below a run of
    ``GRAM`` words grams are shorter, and at that run each gram is kept.
    """
    bodies, places = [], defaultdict(lambda: defaultdict(list))
    for t, text in enumerate(templates.values()):
        bodies.append(words_of(pa.array([text]), bare=True).hashes)
        if not len(bodies[-1]):
            continue
        run = shared_run(len(bodies[-1]))
        size = min(GRAM, run)
        grams = _grams(bodies[-1], size)
        for i in winnowed(grams, run - size + 1):
            places[size][int(grams[i])].append((t, i))
    return bodies, {size: dict(p) for size, p in places.items()}


def reach(n: int) -> int:
    """Diagonals to either side of a candidate's that an alignment may use; less than a template of ``n`` words, so copies in a row stay apart."""
    return min(BAND, (n - 1) // 2) + min(REACH, (n - 1) // 2)


def may_match(template: np.ndarray, words: np.ndarray, shift: int, required: np.ndarray) -> bool:
    """Whether the words within reach of an alignment hold as many words of the template as a hit needs, and those it must have."""
    side = reach(len(template))
    near = words[max(0, shift - side):max(0, shift + len(template) + side)]
    least = COVERAGE * len(template)
    return np.isin(near, template).sum() >= least and np.isin(template, near).sum() >= least and bool(np.isin(required, near).all())


def aligned(template: np.ndarray, words: np.ndarray, shift: int) -> tuple[list[int], list[int]]:
    """Places in the template and in ``words`` that the best alignment matches, its diagonals (place in words minus place in template) within
    reach of ``shift``. A match weighs ``WEIGHT``, a word of the text left out between matches costs 1; one numpy step a template word."""
    m, side = len(template), reach(len(template))
    width, base = 2 * side + 1, shift - side
    at = np.arange(base, base + m + width - 1)
    inside = (at >= 0) & (at < len(words))
    near = np.where(inside, words[np.clip(at, 0, len(words) - 1)], 0)
    equal = np.lib.stride_tricks.sliding_window_view(near, width) == template[:, None]
    equal &= np.lib.stride_tricks.sliding_window_view(inside, width)
    steps = np.arange(width, dtype=np.int32)
    gains = equal * np.int32(WEIGHT) + steps
    best = np.zeros((m + 1, width), np.int32)
    for i in range(m):
        row = best[i] + gains[i]
        # Leaving out a template word moves one diagonal up, leaving out a word of the text one down.
        np.maximum(row[:-1], best[i, 1:] + steps[:-1], out=row[:-1])
        np.subtract(np.maximum.accumulate(row, out=row), steps, out=best[i + 1])
    i, d = m, int(np.argmax(best[m]))
    mine, theirs = [], []
    while i:
        here = best[i, d]
        if equal[i - 1, d] and here == best[i - 1, d] + WEIGHT:
            i -= 1
            mine.append(i)
            theirs.append(base + i + d)
        elif here == best[i - 1, d]:
            i -= 1
        elif d + 1 < width and here == best[i - 1, d + 1]:
            i, d = i - 1, d + 1
        else:
            d -= 1
    return mine[::-1], theirs[::-1]


def _spans(template: np.ndarray, words: np.ndarray, hits: list[tuple[int, int]], required: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Matched words, first and last place of each hit of a template; ``hits`` are (place in text, place in template) of shared grams."""
    left = defaultdict(list)
    for i, k in hits:
        left[i - k].append(i)
    # Diagonals with most hits first; those a found span takes in are done.
    done = np.zeros(len(words), bool)
    for shift in sorted(left, key=lambda d: (-len(left[d]), d)):
        if done[left[shift]].all() or not may_match(template, words, shift, required):
            continue
        mine, theirs = aligned(template, words, shift)
        if len(mine) >= COVERAGE * len(template) and np.isin(required, template[mine]).all():
            done[theirs[0]:theirs[-1] + 1] = True
            yield len(mine), theirs[0], theirs[-1]


def found_in(column: pa.Array, names: list[str], bodies: list[np.ndarray], places: dict, keys: dict[int, np.ndarray],
             required: list[np.ndarray]) -> Iterator[tuple]:
    """(row, license, coverage, matched, start, end) of a batch; start and end are code points."""
    w = words_of(column, bare=True)
    hits = defaultdict(lambda: defaultdict(list))
    for size, known in keys.items():
        grams = _grams(w.hashes, size)
        if not len(grams):
            continue
        whole = w.rows[:len(grams)] == w.rows[size - 1:]
        at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        for i in np.flatnonzero((known[at] == grams) & whole).tolist():
            r = int(w.rows[i])
            for t, k in places[size][int(grams[i])]:
                hits[r][t].append((i - int(w.first[r]), k))
    kin = [FAMILY.get(name, name) for name in names]
    for r, own in hits.items():
        a, b = int(w.first[r]), int(w.first[r + 1])
        spans = sorted({(first, last, matched, t) for t, places_of in own.items() for matched, first, last in _spans(bodies[t], w.hashes[a:b], places_of, required[t])})
        if not spans:
            continue
        longest = max(last - first for first, last, _, _ in spans)
        points = np.concatenate([[0], np.cumsum((w.raw[w.offsets[r]:w.ends[b - 1]] & 0xC0) != 0x80)])
        for first, last, matched, t in spans:
            # Of several alignments that overlap, the longest of a template and its family counts, of equals that of the shortest template.
            near = spans[bisect_left(spans, (first - longest,)):bisect_left(spans, (last + 1,))]
            if any(kin[o[3]] == kin[t] and o[1] >= first and (o[2], -len(bodies[o[3]]), -o[0]) > (matched, -len(bodies[t]), -first) for o in near):
                continue
            start, end = int(w.starts[a + first] - w.offsets[r]), int(w.ends[a + last] - w.offsets[r])
            yield r, names[t], matched / len(bodies[t]), matched, int(points[start]), int(points[end])


def scanned(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, license, coverage, matched, start, end``: one row per template found in a row's text.

    Null and empty texts hold none; repeated rows report each; spans are code points, end exclusive.
    Words compare in lower case (A-Z), without marks at their edges; spans take those in. Other columns are not read.
    """
    templates = TEMPLATES if templates is None else templates

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bodies, places = index(templates)
        names, keys = list(templates), {size: np.array(sorted(p), np.uint64) for size, p in places.items()}
        required = [words_of(pa.array([" ".join(REQUIRED.get(name, []))]), bare=True).hashes for name in names]
        for batch in slices(batches, "text"):
            rows = list(found_in(batch.column("text"), names, bodies, places, keys, required)) if len(keys) else []
            if rows:
                r, name, coverage, matched, start, end = zip(*rows)
                yield pa.record_batch([batch.column("id").take(pa.array(r)), pa.array(name), pa.array(coverage, pa.float64()),
                                       pa.array(matched, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                                      ["id", "license", "coverage", "matched", "start", "end"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, license string, coverage double, matched long, start long, end long")
