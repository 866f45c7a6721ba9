"""License scans by patience alignment.

Words of a license template and of a text are aligned: words unique to both sides are anchors, the longest increasing
run of anchors stays, and the gaps between are aligned the same way. Templates are of two kinds. Notices, of a few words, count only where
all their words stand one after the other: a near notice names another license. Whole texts and headers count where the aligned words cover
enough of them, all words that decide between licenses are among these, none that speaks of another license stands between or soon after, and the
aligned words lie no farther apart than a text of that coverage can have them. Of overlapping finds the one with most aligned words stays.

A text is looked at where it can hold a template: a template can reach its coverage only if one of a few of its words stands there (those whose
places are more than may be missing), so windows are laid with each such word of the text at its place in the template, with some words to
spare at both ends. Notices that repeat back to back have a window each. Texts without any of these words aren't split into words at all.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of a whole text's words that must be aligned, and words from which a template counts as a whole text, not a notice.
COVERAGE, LONG = 0.8, 20

#: How licenses are named in notices.
NAMED = {
    "0BSD": ("Zero-Clause BSD License", "0BSD License"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPL-3.0", "AGPLv3"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 license"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License, Version 2.0", "Eclipse Public License v2.0"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL version 2", "GPLv2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL version 3", "GPLv3"),
    "ISC": ("ISC License",),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPLv2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPLv3"),
    "MIT": ("MIT License", "MIT-License", "Expat License"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0"),
    "Unlicense": ("Unlicense",),
    "Zlib": ("zlib License", "zlib/libpng License"),
}
#: Parts of Creative Commons licenses and what they are called at length.
COMMONS = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
#: Versions of these.
VERSIONS = ("4.0", "3.0", "2.5", "2.0")
#: Words that open a notice.
OPENINGS = ("Licensed under", "Released under", "Distributed under", "Available under")


def notices() -> list[tuple[str, str]]:
    """(license, words) of every notice: each opening with each name, with and without an article."""
    names = [(name, phrase) for name, phrases in NAMED.items() for phrase in phrases]
    for part, long in COMMONS.items():
        for v in VERSIONS:
            for phrase in (f"CC {part} {v}", f"Creative Commons {long} {v}", f"Creative Commons {long} {v} International"):
                names.append((f"CC-{part}-{v}", phrase))
    names += [("CC0-1.0", "CC0 1.0"), ("CC0-1.0", "CC0 1.0 Universal"), ("CC0-1.0", "Creative Commons Zero 1.0")]
    made = [(name, f"{opening}{article} {phrase}") for name, phrase in names for opening in OPENINGS for article in ("", " the", " a")]
    return [*made, ("all-rights-reserved", "All rights reserved")]


@dataclass(frozen=True)
class Text:
    """A whole license text or header: words that decide (each must be aligned) and words of other licenses (none may stand between, or soon after)."""

    license: str
    words: str
    must: tuple[str, ...] = ()
    never: tuple[str, ...] = ()


#: What all texts of the BSD family begin with.
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
    are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
    disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
    disclaimer in the documentation and/or other materials provided with the distribution."""
#: The third clause of BSD-3-Clause.
BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
    this software without specific prior written permission."""
#: The disclaimer of the BSD family.
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
    LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
    HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED
    TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY
    OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
    SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: Grant and disclaimer of MIT.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
    "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
    distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
    following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
    Software."""
MIT_END = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
    MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
    DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE
    USE OR OTHER DEALINGS IN THE SOFTWARE."""
#: Grants and disclaimer of ISC and 0BSD.
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_NOTICE = "provided that the above copyright notice and this permission notice appear in all copies."
ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
    MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
    WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
    OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""


def gnu(kind: str, version: str) -> str:
    """The header of programs under a GNU license."""
    return f"""This program is free software: you can redistribute it and/or modify it under the terms of the {kind} as published by the Free
        Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the
        hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
        PURPOSE. See the {kind} for more details."""


#: Whole texts of short licenses and headers of long ones.
TEXTS = (
    Text("MIT", MIT, ("sublicense", "furnished")),
    Text("MIT", MIT + MIT_END, ("sublicense", "furnished")),
    Text("BSD-2-Clause", BSD, ("redistribution", "binary"), ("neither", "endorse", "advertising")),
    Text("BSD-2-Clause", BSD + BSD_END, ("redistribution", "binary"), ("neither", "endorse", "advertising")),
    Text("BSD-3-Clause", BSD + BSD_NAMES, ("redistribution", "binary", "neither", "endorse"), ("advertising",)),
    Text("BSD-3-Clause", BSD + BSD_NAMES + BSD_END, ("redistribution", "binary", "neither", "endorse"), ("advertising",)),
    Text("ISC", f"{ISC}, {ISC_NOTICE}", ("purpose", "fee", "provided", "appear")),
    Text("ISC", f"{ISC}, {ISC_NOTICE} {ISC_END}", ("purpose", "fee", "provided", "appear")),
    Text("0BSD", f"{ISC}. {ISC_END}", ("purpose", "fee", "granted"), ("appear",)),
    Text("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
        obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
        implied. See the License for the specific language governing permissions and limitations under the License.""", ("apache", "version", "2")),
    Text("GPL-2.0", gnu("GNU General Public License", "2"), ("general", "public", "2"), ("lesser", "library", "affero")),
    Text("GPL-3.0", gnu("GNU General Public License", "3"), ("general", "public", "3"), ("lesser", "library", "affero")),
    Text("LGPL-2.1", gnu("GNU Lesser General Public License", "2.1"), ("lesser", "general", "2", "1")),
    Text("LGPL-3.0", gnu("GNU Lesser General Public License", "3"), ("lesser", "general", "3")),
    Text("AGPL-3.0", gnu("GNU Affero General Public License", "3"), ("affero", "general", "3")),
    Text("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You
        can obtain one at https://mozilla.org/MPL/2.0/.""", ("mozilla", "public", "2")),
    Text("BSL-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation
        covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative
        works of the Software, and to permit third-parties to whom the Software is furnished to do so""", ("organization", "display", "execute", "transmit")),
    Text("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the
        use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
        and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim
        that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be
        appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
        original software. 3. This notice may not be removed or altered from any source distribution.""", ("misrepresented", "altered")),
    Text("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute
        this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""", ("unencumbered", "domain")),
)

WORD = re.compile(r"\w+")


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places (of a, of b), increasing on both sides."""
    out: list[tuple[int, int]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        once = {w for w, n in in_a.items() if n == 1 and in_b.get(w) == 1}
        if not once:
            continue
        at_b = {w: i for i, w in enumerate(b[b0:b1], b0) if w in once}
        pairs = [(i, at_b[w]) for i, w in enumerate(a[a0:a1], a0) if w in once]
        anchors = longest_increasing(pairs)
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        out += anchors
        stack += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def longest_increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs (in order of their first) whose second increase."""
    tails: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(pairs):
        i = bisect_left(tails, j)
        before.append(at[i - 1] if i else -1)
        if i == len(tails):
            tails.append(j)
            at.append(k)
        else:
            tails[i], at[i] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


@dataclass
class Template:
    """A template as words: how many must be aligned, how far apart they may lie, places that must be aligned, and words that may not stand between or soon after."""

    license: str
    words: list[str]
    need: int
    span: int
    must: set[int]
    never: set[str]
    counts: Counter
    keys: list[tuple[str, int]]  # words one of which stands in every find, with their places

    @property
    def slack(self) -> int:
        return self.span - len(self.words)


class Scanner:
    """Templates ready to be looked for. Of a notice all words are needed; of a whole text ``coverage``."""

    def __init__(self, texts: tuple[Text, ...], coverage: float):
        self.templates: list[Template] = []
        shared: set[str] = set()
        for t in sorted(texts, key=lambda t: len(t.words)):
            words = WORD.findall(t.words.lower())
            n, counts = len(words), Counter(words)
            share = coverage if n >= LONG else 1.0
            need = -(-n * round(share * 10_000) // 10_000)
            chosen, places = set(), 0
            # words that other templates look for already, then the longest
            for w in sorted(counts, key=lambda w: (w not in shared, -len(w), w)):
                chosen.add(w)
                places += counts[w]
                if places > n - need:
                    break
            shared |= chosen
            must = {next(i for i, w in enumerate(words) if w == m) for m in t.must if counts[m]}
            keys = [(w, i) for i, w in enumerate(words) if w in chosen]
            self.templates.append(Template(t.license, words, need, int(n / share), must, set(t.never), counts, keys))
        self.any = sorted(shared)
        #: notices by their key word, as one look-up tells all that stand at a place
        self.short: dict[str, dict[int, dict[tuple[str, ...], list[Template]]]] = {}
        for t in self.templates:
            if t.need == len(t.words):
                w, i = t.keys[0]
                self.short.setdefault(w, {}).setdefault(i, {}).setdefault(tuple(t.words), []).append(t)
        self.long = [t for t in self.templates if t.need < len(t.words)]

    def aligned(self, t: Template, words: list[str], first: int) -> tuple[int, int, int] | None:
        """(aligned words, first and last place) of a find in the window that would hold the template from ``first`` on; None without."""
        low = max(0, first - t.slack)
        window = words[low : max(0, first + t.span)]
        if sum((t.counts & Counter(window)).values()) < t.need:
            return None
        pairs = patience(t.words, window)
        # single words far out aren't of this text
        while len(pairs) >= t.need and pairs[-1][1] - pairs[0][1] >= t.span:
            left, right = pairs[1][1] - pairs[0][1], pairs[-1][1] - pairs[-2][1]
            pairs = pairs[1:] if left >= right else pairs[:-1]
        if len(pairs) < t.need or not t.must <= {i for i, _ in pairs}:
            return None
        a, b = pairs[0][1], pairs[-1][1]
        if t.never.intersection(words[low + a : low + b + 1 + t.slack]):
            return None
        return len(pairs), low + a, low + b

    def finds(self, words: list[str], every: bool = False) -> list[tuple[str, int, float, int, int]]:
        """(license, aligned words, coverage, first and last place) of all finds, overlapping ones too. every: windows at all places, for tests."""
        where: dict[str, list[int]] = {}
        wanted = set(self.any)
        for i, w in enumerate(words):
            if w in wanted:
                where.setdefault(w, []).append(i)
        found: set[tuple[str, int, float, int, int]] = set()
        for w, at_place in self.short.items():
            for i in where.get(w, ()):
                for p, known in at_place.items():
                    for n in {len(k) for k in known if p <= i <= len(words) - len(k) + p}:
                        for t in known.get(tuple(words[i - p : i - p + n]), ()):
                            found.add((t.license, n, 1.0, i - p, i - p + n - 1))
        for t in self.long:
            n = len(t.words)
            starts = range(-n, len(words)) if every else {i - p for w, p in t.keys for i in where.get(w, ())}
            for s in starts:
                hit = self.aligned(t, words, s)
                if hit:
                    found.add((t.license, hit[0], hit[0] / n, *hit[1:]))
        return sorted(found)

    def scan(self, text: str | None, every: bool = False) -> list[tuple[str, int, float, int, int]]:
        """(license, aligned words, coverage, first character, end character) of every occurrence, none overlapping another."""
        if not text:
            return []
        low = text.lower()
        if len(low) != len(text):  # so that places stay those of the text
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        if not every and not any(k in low for k in self.any):
            return []
        spans = [(m.start(), m.end()) for m in WORD.finditer(low)]
        taken: list[tuple[int, int]] = []  # in order, apart from each other
        out = []
        # most aligned words first, then the best covered, the shortest, the first
        for name, n, coverage, first, last in sorted(self.finds([low[a:b] for a, b in spans], every), key=lambda f: (-f[1], -f[2], f[4] - f[3], f[3], f[0])):
            at = bisect_left(taken, (first, last))
            if (at == len(taken) or taken[at][0] > last) and (at == 0 or taken[at - 1][1] < first):
                taken.insert(at, (first, last))
                out.append((name, n, coverage, spans[first][0], spans[last][1]))
        return sorted(out, key=lambda x: (x[3], x[0]))


@lru_cache(maxsize=4)
def scanner(texts: tuple[Text, ...], coverage: float) -> Scanner:
    return Scanner(texts, coverage)


def templates() -> tuple[Text, ...]:
    """All notices and texts."""
    return (*(Text(name, words) for name, words in notices()), *TEXTS)


def scan(docs: DataFrame, texts: tuple[Text, ...] | None = None, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, n_words, coverage, start, end): one row for each occurrence in whole texts, none overlapping another.

    Words are runs of letters, digits and underscores, lower-cased. Of overlapping finds the one with most aligned words stays, then the better covered,
    the shorter, the first and the first by name. Null and empty texts have none; repeated rows give repeated rows; a very long text is held once, as words;
    extra columns are ignored, whatever they are called; an empty table gives an empty one.
    """
    given = templates() if texts is None else texts

    def run(batches):
        of = scanner(given, coverage)
        for b in batches:
            rows = [(i, *found) for i, text in enumerate(b.column(1)) for found in of.scan(text.as_py())]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            ids = b.column(0).take(pa.array(columns[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.float64()), pa.array(columns[4], pa.int64()), pa.array(columns[5], pa.int64())], names=["id", "license", "n_words", "coverage", "start", "end"])

    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(run, f"id {plain.schema['id'].dataType.simpleString()}, license string, n_words long, coverage double, start long, end long").withColumnRenamed("id", id_col)
