"""License scans by patience alignment of a text with license templates.

Words that occur once in the text and once in the template are anchors; the longest increasing subsequence of their
places is kept, and the gaps between kept anchors are aligned in the same way, where more words are unique. Equal
words at a gap's ends match as well. Coverage is the share of the template's words that found a partner.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Whole wordings of short licenses, the notices that long ones ask for, and lines that name one.
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "MIT line": "Released under the MIT License.",
    "Apache-2.0 notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0 notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope "
        "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN "
        "THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        'copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD '
        "TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE "
        "OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        'and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR '
        "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO "
        "EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, "
        "BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY "
        "OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN "
        "IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
}
_FOLD = bytes(c if chr(c).isalnum() and c < 128 or c > 127 else 0x20 for c in range(256))


def words(text: str) -> list[bytes]:
    """Lower-cased runs of ASCII letters and digits; other scripts' bytes count as letters."""
    return text.encode().lower().translate(_FOLD).split()


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs (sorted by the first) whose second values increase, by piles."""
    tops, piles, before = [], [], [-1] * len(pairs)
    for k, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        before[k] = piles[at - 1] if at else -1
        if at == len(tops):
            tops.append(b)
            piles.append(k)
        else:
            tops[at], piles[at] = b, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def align(template: list[bytes], text: list[bytes]) -> list[tuple[int, int]]:
    """Matched places (template, text), both increasing."""
    matched, todo = [], [(0, len(template), 0, len(text))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and template[a] == text[c]:
            matched.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and template[b - 1] == text[d - 1]:
            b, d = b - 1, d - 1
            matched.append((b, d))
        if a >= b or c >= d:
            continue
        mine = Counter(template[a:b])
        held: dict[bytes, int] = {}
        for at in range(c, d):
            if text[at] in mine:
                held[text[at]] = -1 if text[at] in held else at
        anchors = _increasing([(i, held[template[i]]) for i in range(a, b) if mine[template[i]] == 1 and held.get(template[i], -1) >= 0])
        matched += anchors
        for (i, j), (k, m) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)], strict=True) if anchors else ():
            todo.append((i + 1, k, j + 1, m))
    return sorted(matched)


def _surroundings(template: list[bytes], positions: list[int], places: dict[bytes, list[int]], slack: int) -> list[tuple[int, int]]:
    """Stretches about each occurrence of the words at those positions: as the template lies there, with slack, and its whole length to both sides.

    The narrow ones keep out copies that follow each other closely and would hide the anchors again.
    """
    out = set()
    for i in positions:
        for at in places.get(template[i], ()):
            first = at - i
            for low, high in ((first, first + len(template)), (first - slack, first + len(template) + slack), (at - len(template), at + len(template))):
                out.add((max(0, low), high))
    return sorted(out)


def _common(template: list[bytes], text: list[bytes]) -> int:
    """Words of template that text has, each as often as there: no alignment matches more."""
    return (Counter(template) & Counter(text)).total()


def scan_text(text: list[bytes], templates: dict[str, list[bytes]], coverage: float) -> list[tuple[str, float, int, int, int]]:
    """(license, coverage, matched words, first and last matched word) of every template that is covered enough.

    The whole text is aligned first. Where its repeats hide the anchors, passages are aligned on their own, and the
    best one counts. A passage that covers enough misses at most so many of the template's positions, so one of that
    many and one more positions lies in it: the surroundings of all occurrences of their words are aligned, those of
    the rarest words.
    """
    vocabulary = {w for t in templates.values() for w in t}
    places: dict[bytes, list[int]] = {}
    for at, w in enumerate(text):
        if w in vocabulary:
            places.setdefault(w, []).append(at)
    out = []
    for name, template in templates.items():
        if sum(w in places for w in template) < coverage * len(template):
            continue  # no alignment can cover more
        best = align(template, text)
        if len(best) < len(template):
            least = next(n for n in range(len(template) + 1) if n >= coverage * len(template))
            missed = len(template) - least
            order = sorted(range(len(template)), key=lambda i: (len(places.get(template[i], ())), template[i], i))
            for low, high in _surroundings(template, order[: missed + 1], places, missed):
                part = text[low:high]
                if _common(template, part) < max(len(best), least):
                    continue  # no alignment can be as good
                near = [(i, low + j) for i, j in align(template, part)]
                best = max(best, near, key=lambda m: (len(m), -(m[-1][1] - m[0][1]) if m else 0))
        if best and len(best) >= coverage * len(template):
            out.append((name, len(best) / len(template), len(best), best[0][1], best[-1][1]))
    return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, coverage: float = 0.8) -> DataFrame:
    """One row per row of docs and license that covers enough: id_col, license, coverage, matched, first_word, last_word.

    Places count the text's words from 0. Null and empty texts have no words and match nothing; whole texts are
    aligned, whatever their length. Repeated and null ids keep rows of their own; equal coverage of several templates
    gives a row each. Other columns of docs are ignored; an empty table gives an empty result.
    """
    split = {name: words(t) for name, t in templates.items()}
    vocabulary = frozenset(w for t in split.values() for w in t)
    least = min(map(len, split.values())) * coverage

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = words(text or "")
                if len(vocabulary.intersection(own)) >= min(least, 2):
                    out += [(i, *found) for found in scan_text(own, split, coverage)]
            if out:
                kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["id", "license", "coverage", "matched", "first_word", "last_word"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "id long, license string, coverage double, matched long, first_word long, last_word long").withColumnRenamed("id", id_col)
