"""Licence scan: templates with optional and replaceable regions, compiled into automata over words.

A template is text in which `[[...]]` marks words that may be missing and `{name:n}` a place for
0 to n words of any kind. Everything else is mandatory and must match exactly, word by word. The
automaton of a template is walked wherever its first run of mandatory words stands, from each word at which what may come before that run can begin.

Short licences stand here whole, from the grant to the end of the disclaimer; of those that projects keep in a file of their own
(Apache, GPL, LGPL, AGPL, MPL) it is the notice that their text gives for source files.

Defined cases: a null or empty text has no words and no label; repeated rows are scanned alike, each on its own; places that several
templates accept count for each; null ids are kept and further columns ignored; an empty table gives an empty result; a text of any length is scanned whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read_table, slices, small_batches
from .textvec import ALNUM

# The phrases of the base scan and their labels, in the order given.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_MIT_GRANT = """Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the
    Software to deal in the Software without restriction including without limitation the rights to use copy modify merge publish distribute
    sublicense and or sell copies of the Software and to permit persons to whom the Software is furnished to do so [[subject to the following conditions]]"""
_AS_IS = """THE SOFTWARE IS PROVIDED AS IS WITHOUT WARRANTY OF ANY KIND EXPRESS OR IMPLIED INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY
    FITNESS FOR A PARTICULAR PURPOSE AND {title:3} NONINFRINGEMENT IN NO EVENT SHALL {holders:12} BE LIABLE FOR ANY CLAIM DAMAGES OR OTHER LIABILITY WHETHER IN
    [[AN]] ACTION OF CONTRACT TORT OR OTHERWISE ARISING FROM OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"""
_BSD_GRANT = """Redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
    {n:2} Redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
    {n:2} Redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the
    documentation and or other materials provided with the distribution"""
_BSD_NAMES = """{n:2} Neither the name of {holder:16} nor the names of {holders:6} contributors may be used to endorse or promote products derived from this software without
    specific prior written permission"""
_BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY {holders:16} AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES INCLUDING BUT NOT LIMITED TO THE IMPLIED WARRANTIES OF
    MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED IN NO EVENT SHALL {holders:16} BE LIABLE FOR ANY DIRECT INDIRECT INCIDENTAL SPECIAL
    EXEMPLARY OR CONSEQUENTIAL DAMAGES INCLUDING BUT NOT LIMITED TO PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES LOSS OF USE DATA OR PROFITS OR BUSINESS
    INTERRUPTION HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY WHETHER IN CONTRACT STRICT LIABILITY OR TORT INCLUDING NEGLIGENCE OR OTHERWISE ARISING IN ANY
    WAY OUT OF THE USE OF THIS SOFTWARE EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"""
_ISC_AS_IS = """THE SOFTWARE IS PROVIDED AS IS AND {holders:8} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
    MERCHANTABILITY AND FITNESS IN NO EVENT SHALL {holders:8} BE LIABLE FOR ANY SPECIAL DIRECT INDIRECT OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
    RESULTING FROM LOSS OF USE DATA OR PROFITS WHETHER IN AN ACTION OF CONTRACT NEGLIGENCE OR OTHER TORTIOUS ACTION ARISING OUT OF OR IN CONNECTION WITH THE USE
    OR PERFORMANCE OF THIS SOFTWARE"""
_GNU = """This {kind:3} is free software you can redistribute it and or modify it under the terms of the GNU %s General Public License as published by the
    Free Software Foundation either version {version:3} of the License or at your option any later version"""
_GNU_NO_WARRANTY = """{what:3} is distributed in the hope that it will be useful but WITHOUT ANY WARRANTY without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
    PARTICULAR PURPOSE See the GNU %s General Public License for more details"""

# Standard wording of licence notices and texts, with their variable parts marked.
TEMPLATES = {
    "mit": [
        "[[is]] released under the [[terms of the]] MIT License",
        "licensed under the [[terms of the]] MIT License",
        "SPDX License Identifier MIT",
        f"{_MIT_GRANT} The above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the Software",
        f"{_MIT_GRANT} The above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the Software {_AS_IS}",
    ],
    "apache": [
        "licensed under the Apache License [[Version 2 0]]",
        "SPDX License Identifier Apache 2 0",
        """Licensed under the Apache License Version 2 0 the License you may not use this file except in compliance with the
        License You may obtain a copy of the License at {url:12} Unless required by applicable law or agreed to in writing
        software distributed under the License is distributed on an AS IS BASIS WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND
        either express or implied [[See the License for the specific language governing permissions and limitations under the License]]""",
    ],
    "gpl": [
        "licensed under the [[terms of the]] GNU General Public License [[version 3]]",
        "SPDX License Identifier GPL {version:4}",
        _GNU % "",
        f"{_GNU % ''} {_GNU_NO_WARRANTY % ''}",
    ],
    "lgpl": ["licensed under the [[terms of the]] GNU Lesser General Public License", "SPDX License Identifier LGPL {version:4}", _GNU % "Lesser", f"{_GNU % 'Lesser'} {_GNU_NO_WARRANTY % 'Lesser'}"],
    "agpl": ["licensed under the [[terms of the]] GNU Affero General Public License", "SPDX License Identifier AGPL {version:4}", _GNU % "Affero", f"{_GNU % 'Affero'} {_GNU_NO_WARRANTY % 'Affero'}"],
    "bsd": ["SPDX License Identifier BSD {kind:3}", _BSD_GRANT, f"{_BSD_GRANT} {_BSD_AS_IS}", f"{_BSD_GRANT} {_BSD_NAMES} {_BSD_AS_IS}"],
    "isc": [
        "SPDX License Identifier ISC",
        """Permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
        provided that the above copyright notice and this permission notice appear in all copies""",
        f"""Permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
        provided that the above copyright notice and this permission notice appear in all copies {_ISC_AS_IS}""",
    ],
    "0bsd": [f"Permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted {_ISC_AS_IS}"],
    "zlib": [
        """This software is provided as is without any express or implied warranty In no event will the authors be held liable for any damages arising from the
        use of this software Permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and
        redistribute it freely subject to the following restrictions {n:1} The origin of this software must not be misrepresented you must not claim that you wrote the
        original software If you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required
        {n:1} Altered source versions must be plainly marked as such and must not be misrepresented as being the original software {n:1} This notice may not be removed or
        altered from any source distribution"""
    ],
    "unlicense": [
        """This is free and unencumbered software released into the public domain Anyone is free to copy modify publish use compile sell or distribute this
        software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"""
    ],
    "boost": [
        """Permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this
        license the Software to use reproduce display distribute execute and transmit the Software and to prepare derivative works of the Software and to permit
        third parties to whom the Software is furnished to do so all subject to the following"""
    ],
    "cc": ["licensed under [[a]] [[the]] Creative Commons {kind:6} License", "SPDX License Identifier CC {kind:6}"],
    "mpl": ["SPDX License Identifier MPL {version:2}", "This Source Code Form is subject to the terms of the Mozilla Public License v 2 0 [[If a copy of the MPL was not distributed with this file You can obtain one at]] {url:8}"],
}

#: Words before the run of mandatory words by which a template is found.
REACH = 40

_MAP = bytes(b if ALNUM[b] else 0x20 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_MAP).split()


class Automaton:
    """One template. State i stands before step i; steps are (word, None), or (None, n) for up to n words of any kind."""

    def __init__(self, template: str):
        self.steps: list[tuple[bytes | None, int]] = []
        self.skips: dict[int, int] = {}
        for optional, hole, plain in re.findall(r"\[\[(.*?)\]\]|\{\w+:(\d+)\}|([^\[{]+)", template, re.S):
            if hole:
                self.steps.append((None, int(hole)))
                continue
            start = len(self.steps)
            self.steps += [(w, 0) for w in words_of(optional or plain)]
            if optional:
                self.skips[start] = len(self.steps)
        free = {i for a, b in self.skips.items() for i in range(a, b)} | {i for i, (w, _) in enumerate(self.steps) if w is None}
        must = set(range(len(self.steps))) - free
        if not must:
            raise ValueError("a template needs mandatory words")
        self.mandatory = len(must)
        #: A run of mandatory words, the longest of those with at most REACH words before them, and how many words at most a match has before it.
        runs, before = [], 0
        for i, (w, most) in enumerate(self.steps):
            if i in must and i - 1 in must:
                runs[-1][1].append(w)
            elif i in must:
                runs.append((before, [w]))
            before += most if w is None else 1
        near = [x for x in runs if x[0] <= REACH] or runs[:1]
        self.before, run = max(near, key=lambda x: len(x[1]))
        self.first = b" ".join(run)

    def places(self, words: list[bytes], joined: bytes) -> Iterator[tuple[int, int]]:
        """(start, end) of each place where the template stands; of those around one run of mandatory words the first start, and from there the first end."""
        for at in _places(joined, b" " + self.first + b" "):
            for start in range(max(0, at - self.before), at + 1):
                end = self.match(words, start)
                if end is not None and end > at:
                    yield start, end
                    break

    def match(self, words: list[bytes], at: int) -> int | None:
        """Where a match that begins at word `at` ends; None without one."""
        return self._run(words, at, 0, -1)

    def _run(self, words: list[bytes], at: int, state: int, used: int) -> int | None:
        live = {(state, 0)}
        while True:
            queue, live = list(live), set(live)
            while queue:  # moves that read nothing
                s, n = queue.pop()
                to = []
                if s in self.skips:
                    to.append((self.skips[s], 0))
                if s < len(self.steps) and self.steps[s][0] is None:
                    to.append((s + 1, 0))
                for x in to:
                    if x not in live:
                        live.add(x)
                        queue.append(x)
            if any(s == len(self.steps) for s, _ in live):
                return at
            if at >= len(words) or not live:
                return None
            word, read = words[at], set()
            for s, n in live:
                w, most = self.steps[s]
                if w is None:
                    if n < most:
                        read.add((s, n + 1))
                elif w == word:
                    read.add((s + 1, 0))
            live, at = read, at + 1


@cache
def compiled() -> list[tuple[str, Automaton]]:
    return [(label, Automaton(t)) for label, ts in TEMPLATES.items() for t in ts]


def _places(joined: bytes, phrase: bytes) -> Iterator[int]:
    """Word numbers at which the words of phrase stand; joined has a space before and after every word."""
    at, word, counted = joined.find(phrase), 0, 0
    while at >= 0:
        word += joined.count(b" ", counted, at)
        counted = at
        yield word
        at = joined.find(phrase, at + 1)


def scan(text: str) -> dict:
    """n_words, the base places, the templates that accept a part of the text, and a score."""
    words = words_of(text)
    joined = b" " + b" ".join(words) + b" "
    base, labels, spans = [], set(), []
    for phrase, label in PHRASES.items():
        found = list(_places(joined, b" " + phrase.encode() + b" "))
        base += found
        if found:
            labels.add(label)
    accepted = {}
    for label, a in compiled():
        for start, end in a.places(words, joined):
            accepted[label] = max(accepted.get(label, 0), a.mandatory)
            spans.append((label, start, end))
    # A longer mandatory wording is surer; a bare phrase counts half.
    score = max([0.5 * bool(base), *(1 - 0.25 / n for n in accepted.values())])
    return {
        "n_words": len(words),
        "n_base": len(base),
        "first_word": min(base, default=None),
        "last_word": max(base, default=None),
        "base_labels": ",".join(sorted(labels)),
        "labels": ",".join(sorted(labels | set(accepted))),
        "score": score,
        "spans": ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(set(spans), key=lambda x: (x[1], x[0], x[2]))),
    }


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string()]


def _scan_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for whole in batches:
        for batch in slices(whole):
            rows = [scan(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[n] for r in rows], t) for n, t in zip(names, _TYPES, strict=True))], ["doc_id", *names])


def licenses(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id and what `scan` finds, for every row of docs (doc_id, text)."""
    small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scan_batches, f"doc_id {kind}, {SCHEMA}")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(spark, read_table(spark, sf_dir, "documents"))
