"""License scan by patience alignment.

Texts and templates are compared as lower-case words (letters and digits; everything else separates). A text is aligned with a template
by anchors: words that occur once in the stretch and once in the template; the
longest increasing subsequence of their places is kept, and each gap between kept anchors is aligned the
same way, until gaps have no anchors; equal words at the ends of a gap are matched directly. A template's coverage is the share of its words
that are matched; its precision is the share of the words between the first and the last match that are. A notice is found if

* both are at least `coverage`; for templates of up to SHORT words both have to be 1, so they are matched word for word without alignment;
* all words that tell the licence apart (its name and version) are matched, and none that tells another stands within.

Where several templates are found in one place, the one with the greater harmonic mean of both counts (then the longer template, then the name).

Which stretches are aligned follows from postings of template words: a template that is covered has a match for at least one of any
n - ceil(`coverage` * n) + 1 of its n words, so only places of that many chosen words (long ones, which are rarer) are looked at, and there
only if the window holds enough of the template's words. Nothing that would be found is missed.

Defined cases: null and empty texts give no rows. Texts of any length are read whole, in windows of bounded size. Repeated rows each give their rows. Ties go as said above.
Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .words import Words, pieces, stretch_hashes

SHORT = 12
NOT_WORD = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])

# Public license notices, with the words that have to be matched and those that may not stand within.
_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; "
    "OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_ENDORSE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_GNU = (
    "{what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
    "{what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, '
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
_LEADS = ("Released under the {}.", "Licensed under the {}.", "This work is licensed under the {}.", "This project is licensed under the terms of the {}.", "Distributed under the {}.")
_NAMED = {
    "MIT": ("MIT License",),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL version 2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL version 3"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1",),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3",),
    "AGPL-3.0": ("GNU Affero General Public License, version 3",),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License",),
    "BSD-3-Clause": ("BSD 3-Clause License",),
    "ISC": ("ISC License",),
}
_COMMONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}

Template = tuple[str, str, str, str]  # license, text, words that must match, words that may not stand within


def templates() -> list[Template]:
    """The notices of all licences."""
    gnu = lambda what, name, version: _GNU.format(what=what, name=name, version=version)
    out = [(name, lead.format(said), "", "") for name, every in _NAMED.items() for said in every for lead in _LEADS]
    out += [
        ("MIT", _MIT, "", ""), ("Apache-2.0", _APACHE, "apache 2 0", ""), ("ISC", _ISC, "", ""), ("MPL-2.0", _MPL, "mozilla 2 0", ""),
        ("BSD-2-Clause", f"{_BSD} {_WARRANTY}", "", "endorse"), ("BSD-3-Clause", f"{_BSD} {_ENDORSE} {_WARRANTY}", "endorse", ""), ("BSD-2-Clause", _BSD, "", "endorse"), ("BSD-3-Clause", f"{_BSD} {_ENDORSE}", "endorse", ""),
        ("GPL-2.0", gnu("This program", "General Public License", "2"), "general 2", "lesser library affero 3"), ("GPL-3.0", gnu("This program", "General Public License", "3"), "general 3", "lesser library affero 2"),
        ("LGPL-2.1", gnu("This library", "Lesser General Public License", "2.1"), "lesser 2 1", "affero 3"), ("LGPL-3.0", gnu("This library", "Lesser General Public License", "3"), "lesser 3", "affero 2"),
        ("AGPL-3.0", gnu("This program", "Affero General Public License", "3"), "affero 3", "lesser 2"),
    ]
    for short, long_ in _COMMONS.items():
        for version in ("3.0", "4.0"):
            name, kind = f"CC-{short}-{version}", "International" if version == "4.0" else "Unported"
            out += [(name, f"Licensed under CC {short} {version}.", "", ""), (name, f"Released under CC {short} {version}.", "", "")]
            words = long_.lower().replace("-", " ")
            others = " ".join(sorted({w for x in _COMMONS.values() for w in x.lower().split("-")} - set(words.split())))
            out.append((name, f"This work is licensed under a Creative Commons {long_} {version} {kind} License.", f"{words} {version.replace('.', ' ')}", others))
    return out


def words_of(text: bytes) -> list[bytes]:
    w = Words(pa.array([text.decode()], pa.string()), lower=True, separator=NOT_WORD)
    return [w.text(i) for i in range(len(w.starts))]


def _longest_increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of pairs in the order of their first places, the most whose second places rise too (patience sorting)."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        back[i] = piles[at - 1] if at else -1
        if at == len(tops):
            tops.append(b)
            piles.append(i)
        else:
            tops[at], piles[at] = b, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Places of matched words in a and b, rising in both."""
    out, gaps = [], [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        once: dict = {}
        for i in range(a0, a1):
            once[a[i]] = -1 if a[i] in once else i
        other: dict = {}
        for i in range(b0, b1):
            other[b[i]] = -1 if b[i] in other else i
        anchors = _longest_increasing([(i, other[w]) for w, i in once.items() if i >= 0 and other.get(w, -1) >= 0])
        if anchors:
            out += anchors
            at, bt = a0, b0
            for i, j in [*anchors, (a1, b1)]:
                if i > at and j > bt:
                    gaps.append((at, i, bt, j))
                at, bt = i + 1, j + 1
    return sorted(out)


def _dense(matched: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """The most matched words within a stretch of so many words."""
    best: tuple[int, int] = (0, 0)
    first = 0
    for last in range(len(matched)):
        while matched[last][0] - matched[first][0] >= size:
            first += 1
        best = max(best, (last - first + 1, -first))
    return matched[-best[1] : -best[1] + best[0]]


class Templates:
    """Templates as numbers of words, with the postings that say where to align."""

    def __init__(self, every: list[Template], coverage: float):
        self.coverage = coverage
        said = [(name, words_of(text.encode()), must, bar) for name, text, must, bar in every]
        vocabulary = sorted({w for _, words, must, bar in said for w in (*words, *words_of(must.encode()), *words_of(bar.encode()))})
        number = {w: i for i, w in enumerate(vocabulary)}
        raw = np.frombuffer(b"".join(vocabulary), np.uint8)
        ends = np.cumsum([len(w) for w in vocabulary])
        hashes = stretch_hashes(raw, ends - [len(w) for w in vocabulary], ends)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.all = []
        self.asked: dict[int, list[int]] = {}  # chosen words: the templates that they were chosen for
        seen = set()
        for name, words, must, bar in said:
            own = [number[w] for w in words]
            if (name, *own) in seen or not own:
                continue
            seen.add((name, *own))
            need = len(own) if len(own) <= SHORT else -int(-coverage * len(own) // 1)
            count = np.bincount(own, minlength=len(vocabulary))
            chosen, held = set(), 0
            for w in sorted(set(own), key=lambda w: (-len(vocabulary[w]), w)):
                if held > len(own) - need:
                    break
                chosen.add(w)
                held += int(count[w])
            for w in chosen:
                self.asked.setdefault(w, []).append(len(self.all))
            ids = lambda x: {number[w] for w in words_of(x.encode())}
            self.all.append((name, own, need, count, ids(must), ids(bar)))
        self.posted = np.zeros(len(vocabulary) + 1, bool)
        self.posted[list(self.asked)] = True

    def numbers(self, w: Words) -> np.ndarray:
        """Each word's number, -1 for words of no template."""
        h = w.hashes()
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.order[at], -1)

    def find(self, words: np.ndarray) -> list[tuple[float, int, str, float, int, int]]:
        """(harmonic mean, words, license, coverage, first and last word) of the notices in a text given by its words' numbers."""
        places: dict[int, list[int]] = {}
        for at in np.flatnonzero(self.posted[words]).tolist():
            for t in self.asked[int(words[at])]:
                places.setdefault(t, []).append(at)
        found = []
        for t, every in places.items():
            name, own = self.all[t][:2]
            if len(own) <= SHORT:
                for at in every:
                    for a in [at - j for j, x in enumerate(own) if x == words[at]]:
                        if a >= 0 and words[a : a + len(own)].tolist() == own:
                            found.append((1.0, len(own), name, 1.0, a, a + len(own) - 1))
                continue
            reach, first = 2 * len(own), 0
            while first < len(every):
                last = first
                while last + 1 < len(every) and every[last + 1] - every[last] <= reach and every[last] - every[first] <= 8 * reach:
                    last += 1
                self._search(t, words, max(0, every[first] - reach), min(len(words), every[last] + reach), found)
                first = last + 1
        kept: list[tuple[float, int, str, float, int, int]] = []
        for x in sorted(set(found), key=lambda x: (-x[0], -x[1], x[2], x[4])):
            if all(x[5] < y[4] or x[4] > y[5] for y in kept):
                kept.append(x)
        return sorted(kept, key=lambda x: x[4])

    def _search(self, t: int, words: np.ndarray, low: int, high: int, found: list) -> None:
        name, own, need, count, must, bar = self.all[t]
        size, todo = len(own), [(low, high)]
        while todo:
            low, high = todo.pop()
            here = words[low:high]
            have = np.bincount(here[here >= 0], minlength=len(count))
            if np.minimum(have, count).sum() < need:
                continue
            # what is further apart than a notice can be long is aligned window by window
            if high - low > 6 * size:
                cuts = range(low, high, 2 * size)
                todo += [(a, min(high, a + 4 * size)) for a in cuts]
                continue
            matched = _dense(align(here.tolist(), own), 2 * size)
            if not matched:
                continue
            a, z = matched[0][0], matched[-1][0]
            share, exact = len(matched) / size, len(matched) / (z - a + 1)
            got = {own[j] for _, j in matched}
            if share >= self.coverage and exact >= self.coverage and must <= got and not bar & set(here[a : z + 1].tolist()):
                found.append((2 * share * exact / (share + exact), size, name, share, low + a, low + z))
                todo += [(low, low + a), (low + z + 1, high)]
            elif z - a + 1 < high - low and len(matched) < need:
                continue
            elif high - low > size:  # several notices in one window spoil each other's anchors: each half by itself
                middle = (low + high) // 2
                todo += [x for x in ((low, middle), (middle, high), (low + (high - low) // 4, low + 3 * (high - low) // 4)) if x[1] - x[0] >= need]


_FOUND = "doc_id long, license string, coverage double, start long, end long"
_KINDS = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])


def _scan(every: list[Template], coverage: float):
    def scan(batches):
        known = Templates(every, coverage)
        for batch in pieces(batches):
            w = Words(batch.column("text"), lower=True, separator=NOT_WORD)
            words, rows = known.numbers(w), []
            for d in np.unique(np.searchsorted(w.first, np.flatnonzero(known.posted[words]), "right") - 1).tolist():
                first = int(w.first[d])
                for _, _, name, share, a, z in known.find(words[first : w.first[d + 1]]):
                    low = int(w.offsets[d])
                    characters = np.cumsum((w.data[low : w.ends[first + z]] & 0xC0) != 0x80)  # of a UTF-8 text up to each byte
                    rows.append((batch.column("doc_id")[d].as_py(), name, share, int(characters[w.starts[first + a] - low]) - 1, int(characters[-1])))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, _KINDS)], schema=_KINDS)

    return scan


def license_scan(docs: DataFrame, coverage: float = 0.8, every: list[Template] | None = None) -> DataFrame:
    """doc_id, license, coverage, start, end (code points) of every license notice in `docs` (doc_id, text)."""
    shared.tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL")
    return rows.mapInArrow(_scan(every or templates(), coverage), _FOUND)
