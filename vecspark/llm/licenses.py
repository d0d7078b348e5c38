"""License scans by patience alignment of templates.

A template is aligned around each of its seeds in a text: words that a text holding the
template must have at least one of. These are a word that names the license, where the
template has such words, and otherwise as many of its words as may be missing at the least
coverage, and one more. Alignment anchors on words that occur once in both, takes the
longest increasing subsequence of the anchors, and aligns the gaps between them in the same
way; equal words at the ends of a gap match as they stand. The share of template words
matched is the coverage.

Where findings of several templates overlap, the one that leaves the least unexplained
stands: most words matched, less those missing and those of the text in between.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm import textkit as tk
from vecspark.llm.chunks import on_batches, slim

COVERAGE = 0.8
#: Least share of matched words in the stretch of text they span, and what a word in between costs when the stretch is chosen.
DENSITY, GAP = 0.5, 0.25

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


@dataclass(frozen=True)
class Template:
    """A license's text or notice; ``naming``: words of it without which a text names another license, in order."""

    license: str
    naming: str
    text: str


# Notices, headings and texts of common licenses.
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_DISCLAIMER = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_TWO = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_DISCLAIMER = "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_GNU_NOTICE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
TEMPLATES = (
    Template("MIT", "mit", "Released under the MIT License."),
    Template("MIT", "mit", "Licensed under the MIT License."),
    Template("Apache-2.0", "apache 2 0", "Licensed under the Apache License, Version 2.0."),
    Template("GPL-2.0", "gnu general 2", "This work is licensed under the GNU General Public License, version 2."),
    Template("GPL-3.0", "gnu general 3", "This work is licensed under the GNU General Public License, version 3."),
    Template("LGPL-2.1", "gnu lesser 2 1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    Template("LGPL-3.0", "gnu lesser 3", "This work is licensed under the GNU Lesser General Public License, version 3."),
    Template("AGPL-3.0", "gnu affero 3", "This work is licensed under the GNU Affero General Public License, version 3."),
    Template("CC-BY-NC-4.0", "cc by nc 4 0", "Licensed under CC BY-NC 4.0."),
    Template("CC-BY-4.0", "cc by 4 0", "Licensed under CC BY 4.0."),
    Template("CC-BY-SA-4.0", "cc by sa 4 0", "Licensed under CC BY-SA 4.0."),
    Template("CC-BY-ND-4.0", "cc by nd 4 0", "Licensed under CC BY-ND 4.0."),
    Template("CC-BY-NC-SA-4.0", "cc by nc sa 4 0", "Licensed under CC BY-NC-SA 4.0."),
    Template("CC-BY-NC-ND-4.0", "cc by nc nd 4 0", "Licensed under CC BY-NC-ND 4.0."),
    Template("MPL-2.0", "mozilla 2 0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    Template("MPL-2.0", "mozilla 2 0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    Template("MIT", "", _MIT_GRANT),
    Template("MIT", "", _MIT_GRANT + " " + _MIT_DISCLAIMER),
    Template("ISC", "", _ISC_GRANT),
    Template("ISC", "", _ISC_GRANT + " " + _ISC_DISCLAIMER),
    Template("BSD-2-Clause", "", _BSD_TWO),
    Template("BSD-2-Clause", "", _BSD_TWO + " " + _BSD_DISCLAIMER),
    Template("BSD-3-Clause", "", _BSD_TWO + " " + _BSD_THIRD),
    Template("BSD-3-Clause", "", _BSD_TWO + " " + _BSD_THIRD + " " + _BSD_DISCLAIMER),
    Template("Unlicense", "", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    Template("Zlib", "", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."),
    Template("Apache-2.0", "", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    Template("Apache-2.0", "apache 2 0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    Template("GPL-2.0", "general 2", _GNU_NOTICE.format("General Public License", "2")),
    Template("GPL-3.0", "general 3", _GNU_NOTICE.format("General Public License", "3")),
    Template("LGPL-2.1", "lesser 2 1", _GNU_NOTICE.format("Lesser General Public License", "2.1")),
    Template("LGPL-3.0", "lesser 3", _GNU_NOTICE.format("Lesser General Public License", "3")),
    Template("AGPL-3.0", "affero 3", _GNU_NOTICE.format("Affero General Public License", "3")),
    Template("GPL-2.0", "general 2 1991", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    Template("GPL-3.0", "general 3 2007", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    Template("LGPL-2.1", "lesser 2 1 1999", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    Template("LGPL-3.0", "lesser 3 2007", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    Template("LGPL-3.0", "lesser 3", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    Template("AGPL-3.0", "affero 3 2007", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
)


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched positions of two sequences, rising in both."""
    out, open_ = [], [(0, len(a), 0, len(b))]
    while open_:
        alo, ahi, blo, bhi = open_.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo == ahi or blo == bhi:
            continue
        na, nb = Counter(a[alo:ahi]), Counter(b[blo:bhi])
        where = {a[i]: i for i in range(alo, ahi) if na[a[i]] == 1}
        anchors = [(where[b[j]], j) for j in range(blo, bhi) if nb[b[j]] == 1 and b[j] in where]
        chain = _rising(anchors)
        for (p, q), (r, s) in zip([(alo - 1, blo - 1), *chain], [*chain, (ahi, bhi)], strict=True):
            if chain and p + 1 < r and q + 1 < s:
                open_.append((p + 1, r, q + 1, s))
        out += chain
    return sorted(out)


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence rising in the first part (the second already rises)."""
    ends, at, back = [], [], []
    for k, (i, _) in enumerate(pairs):
        n = bisect_left(ends, i)
        back.append(at[n - 1] if n else -1)
        if n == len(ends):
            ends.append(i)
            at.append(k)
        else:
            ends[n], at[n] = i, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


class _Prepared:
    """A template's words, the least number that must match, and its seeds."""

    def __init__(self, template: Template, coverage: float):
        self.license, self.words = template.license, _WORD.findall(template.text.encode().lower())
        self.naming = _WORD.findall(template.naming.encode().lower())
        if not self.words or not _within(self.naming, self.words):
            raise ValueError(f"the words that name {template.license} are not in order in its template")
        self.need = Counter(self.words)
        self.least = next(n for n in range(len(self.words) + 1) if n / len(self.words) >= coverage)
        # Long words are rare, words that name the license rarer.
        order = sorted(dict.fromkeys(self.naming or self.words), key=len, reverse=True)
        self.seeds, places = [], 0
        for w in order:
            self.seeds.append(w)
            places += self.words.count(w)
            if self.naming or places > len(self.words) - self.least:
                break

    def likely(self, have: Counter) -> bool:
        """Whether a bag of words has enough of the template's, and those that name it."""
        return sum(min(n, have[w]) for w, n in self.need.items()) >= self.least and all(have[w] for w in self.naming)


def _within(some: list, words: list) -> bool:
    """Whether ``some`` occur in ``words`` in their order."""
    rest = iter(words)
    return all(w in rest for w in some)


@dataclass(frozen=True)
class Hit:
    license: str
    coverage: float
    matched: int
    start: int
    end: int
    #: Words matched, less those missing and those in between.
    gain: int


class Scanner:
    """Templates ready for use at one least coverage, with one automaton over all seeds."""

    def __init__(self, templates: tuple[Template, ...], coverage: float = COVERAGE):
        import ahocorasick

        self.coverage = coverage
        self.templates = [_Prepared(t, coverage) for t in templates]
        self.seeds = {w for t in self.templates for w in t.seeds}
        self.automaton = ahocorasick.Automaton()
        for seed in self.seeds:
            self.automaton.add_word(seed.decode("latin-1"), seed)
        self.automaton.make_automaton()

    def scan(self, raw: bytes) -> list[Hit]:
        """All findings, by place and license."""
        low = raw.lower()
        if next(self.automaton.iter(low.decode("latin-1")), None) is None:
            return []
        words = _WORD.findall(low)
        have = Counter(words)
        templates = [t for t in self.templates if t.likely(have)]
        if not templates:
            return []
        wanted = {w for t in templates for w in t.seeds}
        where: dict[bytes, list[int]] = {w: [] for w in wanted}
        for i, w in enumerate(words):
            if w in wanted:
                where[w].append(i)
        return settle([hit for t in templates for hit in self._places(words, t, where)])

    def _places(self, words: list[bytes], t: _Prepared, where: dict[bytes, list[int]]) -> list[Hit]:
        """Findings of one template around its seeds; a seed within one is not tried again."""
        found: list[Hit] = []
        for seed in t.seeds:
            spots = where[seed]
            for n, p in enumerate(spots):
                if any(h.start <= p < h.end for h in found[-8:]):
                    continue
                # A stretch of the least density is no longer than this.
                far = 2 * len(t.words)
                lo, hi = max(0, p - far), min(len(words), p + far)
                if not t.likely(Counter(words[lo:hi])):
                    continue
                # Other places of a seed that the template has once belong to other copies, or to chance.
                near = (spots[n - 1] + 1 if n else 0, spots[n + 1] if n + 1 < len(spots) else len(words))
                tries = [(lo, hi)] if t.words.count(seed) > 1 else [(max(lo, near[0]), min(hi, near[1])), (lo, hi)]
                hits = [h for a, b in dict.fromkeys(tries) if (h := self.align(words, t, a, b)) and h.start <= p < h.end]
                if hits:
                    found.append(max(hits, key=lambda h: (h.gain, -h.start)))
        return found

    def align(self, words: list[bytes], t: _Prepared, lo: int, hi: int) -> Hit | None:
        """The template's finding between two words of the text, if it is covered enough."""
        pairs = patience(words[lo:hi], t.words)
        if len(pairs) < t.least:
            return None
        # The stretch of most matches, less a part of the words in between: matches far from the rest are chance.
        best, gain, start = (0.0, 0, 0), 0.0, 0
        for k, (at, _) in enumerate(pairs):
            gain = gain + 1 - GAP * (at - pairs[k - 1][0]) if k else 1 - GAP
            if gain < 1 - GAP:
                gain, start = 1 - GAP, k
            if gain > best[0]:
                best = (gain, start, k + 1)
        run = pairs[best[1] : best[2]]
        a, b = run[0][0] + lo, run[-1][0] + lo + 1
        if len(run) < t.least or len(run) < DENSITY * (b - a) or not _within(t.naming, [t.words[j] for _, j in run]):
            return None
        return Hit(t.license, len(run) / len(t.words), len(run), a, b, len(run) - (len(t.words) - len(run)) - (b - a - len(run)))


def settle(hits: list[Hit]) -> list[Hit]:
    """Of overlapping findings those with the most gain, by place and license."""
    kept: list[Hit] = []
    starts: list[int] = []
    for hit in sorted(hits, key=lambda h: (-h.gain, h.start, h.end, h.license)):
        n = bisect_right(starts, hit.start)
        if (n and kept[n - 1].end > hit.start) or (n < len(kept) and kept[n].start < hit.end):
            continue
        kept.insert(n, hit)
        starts.insert(n, hit.start)
    return kept


_RESULT = "doc_id long, license string, coverage double, n_matched long, start_word long, end_word long"
_RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("n_matched", pa.int64()), ("start_word", pa.int64()), ("end_word", pa.int64())])
_scanners: dict[tuple, Scanner] = {}


def _scan(templates: tuple[Template, ...], coverage: float, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    scanner = _scanners.get((templates, coverage))
    if scanner is None:
        scanner = _scanners[templates, coverage] = Scanner(templates, coverage)
    for part in tk.slices(batch, "text"):
        buf, offs = tk.text_buffer(part.column(1))
        raw, ids = buf.tobytes(), part.column(0).to_pylist()
        rows = [(ids[d], h.license, h.coverage, h.matched, h.start, h.end) for d in range(part.num_rows) for h in scanner.scan(raw[offs[d] : offs[d + 1]])]
        yield pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(_RESULT_ARROW.names)}, _RESULT_ARROW)


def find_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """One row for each license notice or text found in each whole text; no shuffle.

    ``doc_id``, ``license``, ``coverage`` (of the template), ``n_matched`` and the stretch of
    words ``start_word`` to ``end_word`` (end exclusive). Words ignore case and ASCII
    punctuation. Null and empty texts give no rows; a null ``doc_id`` is returned as null;
    repeated rows give repeated rows; columns other than ``doc_id`` and ``text`` are
    ignored; an empty table gives an empty result. Findings of one result never overlap.
    """
    docs = slim(docs)
    return docs.mapInArrow(on_batches(_scan, tuple(templates), coverage), _RESULT)
