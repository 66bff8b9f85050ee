"""License scans: winnowed fingerprints pick candidate places, banded alignment measures them.

Templates are cut into words (ASCII letters and digits and all beyond ASCII, lower-cased). Hashes of
GRAM consecutive words are winnowed: of each WINNOW neighbouring hashes the smallest is kept. The
kept ones form an inverted index hash -> (template, place). A document's grams are looked up there (all of
them, so any GRAM + WINNOW - 1 words that a document shares with a template meet the index); hits of a
template on nearby diagonals make a candidate place, if they are hits of as many different fingerprints as SHARE
of the template's. There the whole template is aligned with the document, within BAND diagonals on either side (a quarter
of a short template's words), all candidate places of a template at once: a match scores 2, a mismatch or a gap -1, and
the document's ends are free. A place is reported if at least COVERAGE of the template's words match.

Candidates that are no place by themselves are chained where they follow one another in template and document, with at most
as many words between them as the template has (a text with something inserted): each is aligned with its part of the template, cut half-way
between their hits, and the chain is judged like a place.

Only words of some template can be in a gram that hits, so a document's other words have number 0
and grams with such a word are never hashed.

Result: one row for each place: license, coverage, n_matched, start and end (code points, end
exclusive). Of overlapping places of one template the best is reported (most matched words, then the first); a place
that lies to WITHIN of its words in one of another template with more matched words (or as many, of a shorter template) is left to that one. Defined results: null and
empty texts have none; repeated rows are scanned each; a template may occur many times; templates without words are
refused; an empty table gives an empty result; columns of the input with the result's names are replaced.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded, by_size, without

GRAM, WINNOW, BAND, COVERAGE = 3, 2, 8, 0.8
#: Of a template's fingerprints, those that a candidate must hit; and of a place's words, those that put it within another.
SHARE, WITHIN = 0.1, 0.8
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_PLACED = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
RESULT = ["license", "coverage", "n_matched", "start", "end"]

#: Notices and licence texts as published.
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission. "
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "mit-notice": "Released under the MIT License.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
        'or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."
    ),
    "mit": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation '
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        'included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY '
        "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
        "OTHER DEALINGS IN THE SOFTWARE."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR "
        "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT "
        "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS "
        "OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
        "THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "bsd-2-clause": _BSD_HEAD + _BSD_TAIL,
    "bsd-3-clause": _BSD_HEAD + _BSD_THIRD + _BSD_TAIL,
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "lgpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program "
        "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."
    ),
    "agpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program "
        "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."
    ),
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program "
        "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
}


class Index:
    def __init__(self, templates: dict[str, str], gram: int = GRAM, winnow: int = WINNOW) -> None:
        self.names, self.gram = sorted(templates), gram
        self.vocabulary: dict[bytes, int] = {}
        self.texts = [[self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in _words(templates[n])] for n in self.names]
        if not all(self.texts):
            raise ValueError("a template has no words")
        self.base = len(self.vocabulary) + 1
        if self.base**gram >= 1 << 63 or max(map(len, self.texts)) >= 1 << 15:
            raise ValueError("too many words in the templates")
        self.places: dict[int, list[tuple[int, int]]] = {}
        self.kept: list[int] = []  # fingerprints of each template
        for t, text in enumerate(self.texts):
            marks = self.hashes(np.array(text, np.int64)).tolist()
            kept = set()
            mixed = [(m * 0x9E3779B97F4A7C15) % (1 << 64) for m in marks]
            for at in range(max(1, len(marks) - winnow + 1)):
                window = range(at, min(at + winnow, len(marks)))
                if window:
                    kept.add(min(window, key=lambda k: (mixed[k], -k)))
            self.kept.append(len(kept))
            for at in sorted(kept):
                self.places.setdefault(marks[at], []).append((t, at))
        self.marks = np.array(sorted(self.places), np.int64)
        self.shortest = min(map(len, self.texts))

    def hashes(self, numbers: np.ndarray) -> np.ndarray:
        """Of each gram, a number that tells its words; 0 if one is in no template."""
        n = len(numbers) - self.gram + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        out, known = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(self.gram):
            part = numbers[k : k + n]
            out = out * self.base + part
            known &= part > 0
        return np.where(known, out, 0)


def _words(text: str) -> list[bytes]:
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower())


_MATCHED, _SCORE = 1 << 31, 1 << 46


def align(template: np.ndarray, words: np.ndarray, shifts: np.ndarray, band: int = BAND) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best alignments of the whole template with stretches of words, one near each shift: matched words, first word, word after the last.

    Cell (i, j) is allowed if j - i is within band of the shift. The stretch begins and ends anywhere. Score, matched words and first
    word of a cell are one number, so that the largest is the best by score, then matches, then the later start.
    """
    if not len(words):
        words = np.array([-1])  # no word matches
    n, width = len(words), 2 * band + 1
    across, low = np.arange(width), -(1 << 62)
    begin = shifts[:, None] + across - band
    row = np.where((begin >= 0) & (begin <= n), begin, low)
    for i, symbol in enumerate(template.tolist()):
        at = i + begin  # the word that is compared
        inside = (at >= 0) & (at < n)
        same = words[np.clip(at, 0, n - 1)] == symbol
        new = np.where(inside & (row > low // 2), row + np.where(same, 2 * _SCORE + _MATCHED, -_SCORE), low)
        missing = row[:, 1:] - _SCORE  # the template's word is missing
        new[:, :-1] = np.maximum(new[:, :-1], np.where(row[:, 1:] > low // 2, missing, low))
        extra = np.maximum.accumulate(new + across * _SCORE, axis=1) - across * _SCORE  # words are extra
        row = np.where(inside, np.maximum(new, extra), new)
    best = row.argmax(axis=1)
    found = row[np.arange(len(row)), best]
    score = (found + _SCORE // 2) // _SCORE
    rest = found - score * _SCORE
    return rest // _MATCHED, rest % _MATCHED, len(template) + shifts + best - band


def _clusters(places: np.ndarray, at: np.ndarray, reach: int) -> list[np.ndarray]:
    """Hits (place in the template, place in the document) by stretches of neighbouring diagonals, as indices."""
    order = np.argsort(at - places, kind="stable")
    diagonals, out, first = (at - places)[order].tolist(), [], 0
    for k in range(1, len(diagonals) + 1):  # the middle is within half of reach of all of them
        if k == len(diagonals) or diagonals[k] - diagonals[first] > reach:
            out.append(order[first:k])
            first = k
    return out


def _free(taken: list[tuple[int, int]], begin: int, end: int) -> bool:
    """Whether a stretch overlaps none of those taken, which are in order; if so it is taken."""
    k = bisect_left(taken, (begin, end))
    if (k and taken[k - 1][1] > begin) or (k < len(taken) and taken[k][0] < end):
        return False
    taken.insert(k, (begin, end))
    return True


def _chained(template: np.ndarray, numbers: np.ndarray, rest: list[tuple[int, int, int, int, int]], band: int) -> list[tuple[int, int, int]]:
    """(matched, begin, end) of chains of two clusters or more: (first and last place in the template, in the document, fingerprints hit).

    A chain takes the clusters with the most hits in all. Only those within reach of a cluster are looked at, so work stays in
    proportion to the document.
    """
    rest = sorted(rest, key=lambda c: (c[2], c[0]))
    best, before, low = [c[4] for c in rest], [-1] * len(rest), 0
    for k, c in enumerate(rest):
        while rest[low][2] < c[2] - 3 * len(template):
            low += 1
        for j in range(low, k):
            p = rest[j]
            if c[0] > p[0] and c[1] > p[1] and 0 < c[2] - p[3] <= len(template) and best[j] + c[4] > best[k]:
                best[k], before[k] = best[j] + c[4], j
    out, used = [], [False] * len(rest)
    for end in sorted(range(len(rest)), key=lambda k: (-best[k], k)):
        chain, k = [], end
        while k >= 0 and not used[k]:
            used[k] = True
            chain.insert(0, rest[k])
            k = before[k]
        if len(chain) < 2:
            continue
        cuts = [0, *((a[1] + b[0] + 1) // 2 for a, b in pairwise(chain)), len(template)]
        matched, begin, done = 0, None, 0
        for (lo, hi), c in zip(pairwise(cuts), chain, strict=True):  # each part behind the one before it
            m, a, b = (int(x[0]) for x in align(template[lo:hi], numbers[done:], np.array([c[2] - c[0] + lo - done]), band))
            matched, begin, done = matched + max(m, 0), done + a if begin is None else begin, done + max(b, 0)
        out.append((matched, begin, done))
    return out


def _places(t: int, index: Index, numbers: np.ndarray, places: np.ndarray, at: np.ndarray, band: int, coverage: float, share: float) -> list[tuple[int, int, int]]:
    """(matched, begin, end) of template t."""
    template = np.array(index.texts[t])
    reach, needed = min(band, max(1, len(template) // 4)), max(1, math.ceil(share * index.kept[t]))
    # A stretch of one diagonal may have hits of several places: those more than a template's length apart are told apart.
    clusters = []
    for c in _clusters(places, at, reach):
        c = c[np.argsort(at[c], kind="stable")]
        clusters += np.split(c, np.flatnonzero(np.diff(at[c]) > len(template)) + 1)
    candidates = [c for c in clusters if len(np.unique(places[c])) >= needed]
    taken: list[tuple[int, int]] = []
    found, good = [], np.zeros(len(candidates), bool)
    if candidates:
        shifts = np.array([(int((at - places)[c].min()) + int((at - places)[c].max())) // 2 for c in candidates])
        matched, begin, end = (np.concatenate(x) for x in zip(*(align(template, numbers, shifts[k : k + 1024], reach) for k in range(0, len(shifts), 1024)), strict=True))
        good = matched >= coverage * len(template)
        for k in np.lexsort((end, begin, -matched)).tolist():
            if good[k] and _free(taken, int(begin[k]), int(end[k])):
                found.append((int(matched[k]), int(begin[k]), int(end[k])))
    ends = lambda x: (int(x.min()), int(x.max()) + index.gram - 1)
    rest = []
    for c in clusters:
        if len(np.unique(places[c])) >= max(1, needed // 2):
            # Where a cluster begins and ends is told by its commonest diagonal; a phrase that repeats lies on others.
            diagonals, n = np.unique((at - places)[c], return_counts=True)
            c = c[(at - places)[c] == diagonals[n.argmax()]]
            rest.append((*ends(places[c]), *ends(at[c]), len(np.unique(places[c]))))
    rest = [c for c in rest if not any(a < c[3] and c[2] < b for a, b in taken[max(0, bisect_left(taken, (c[2], 0)) - 1) : bisect_left(taken, (c[3], 0))])]
    chains = [c for c in _chained(template, numbers, rest, reach) if c[0] >= coverage * len(template)]
    return found + [c for c in sorted(chains, key=lambda c: (-c[0], c[1:])) if _free(taken, c[1], c[2])]


def _without_inner(found: list[tuple[int, int, int, int]], within: float, sizes: list[int]) -> list[tuple[int, int, int, int]]:
    """Places (t, matched, begin, end) but those that lie in one of another template with more matched words, or as many of fewer. sizes: of templates."""
    kept: list[tuple[int, int, int, int]] = []
    spans: list[tuple[int, int]] = []  # of kept places, merged where they overlap
    for p in sorted(found, key=lambda p: (-p[1], sizes[p[0]], p[2], p[0])):
        k = bisect_left(spans, (p[3], 0))
        inner = any(min(b, p[3]) - max(a, p[2]) >= within * (p[3] - p[2]) for a, b in spans[max(0, k - 1) : k])
        if inner and any((q[1] > p[1] or q[1] == p[1] and sizes[q[0]] < sizes[p[0]]) and q[0] != p[0] and min(q[3], p[3]) - max(q[2], p[2]) >= within * (p[3] - p[2]) for q in kept):
            continue
        kept.append(p)
        lo = bisect_left(spans, (p[2], 0))
        lo -= bool(lo and spans[lo - 1][1] > p[2])
        hi = bisect_left(spans, (p[3], 0))
        joined = [*spans[lo:hi], p[2:]]
        spans[lo:hi] = [(min(a for a, _ in joined), max(b for _, b in joined))]
    return kept


def scan(text: str | None, index: Index, band: int = BAND, coverage: float = COVERAGE, share: float = SHARE) -> list[tuple[str, float, int, int, int]]:
    """(license, coverage, n_matched, start, end) of all places, in order of start, then license."""
    if not text:
        return []
    get = index.vocabulary.get
    numbers = np.array([get(w, 0) for w in _words(text)], np.int64)
    marks = index.hashes(numbers)
    hits = np.flatnonzero(np.isin(marks, index.marks) & (marks > 0)) if len(marks) else []
    if not len(hits):
        return []
    by_template: dict[int, tuple[list[int], list[int]]] = {}
    for at, mark in zip(hits.tolist(), marks[hits].tolist(), strict=True):
        for t, place in index.places[mark]:
            mine = by_template.setdefault(t, ([], []))
            mine[0].append(place)
            mine[1].append(at)
    found = [(t, *p) for t, (places, at) in by_template.items() if len(set(places)) >= max(1, math.ceil(share * index.kept[t])) for p in _places(t, index, numbers, np.array(places), np.array(at), band, coverage, share)]
    if not found:
        return []
    placed = [m.span() for m in _PLACED.finditer(text)]
    out = [(index.names[t], m / len(index.texts[t]), m, placed[a][0], placed[b - 1][1]) for t, m, a, b in _without_inner(found, WITHIN, list(map(len, index.texts)))]
    return sorted(out, key=lambda r: (r[3], r[0]))


@lru_cache(maxsize=4)
def _index(templates: tuple[tuple[str, str], ...]) -> Index:
    return Index(dict(templates))


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row (columns keep of docs, all by default, and RESULT) for each place of a template."""
    docs = without(docs, RESULT)
    keep = docs.columns if keep is None else keep
    at, kept = docs.columns.index(text), [docs.columns.index(c) for c in keep]
    known = tuple(sorted((templates or TEMPLATES).items()))
    _index(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(known)
        for b in by_size(batches, at):
            rows, which = [], []
            for k, t in enumerate(b.column(at)):
                for r in scan(t.as_py(), index):
                    rows.append(r)
                    which.append(k)
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()))]
            part = b.select(kept).take(pa.array(which, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*keep, *RESULT])

    added = [F.lit("").alias("license"), F.lit(0.0).alias("coverage"), *[F.lit(0).cast("long").alias(c) for c in RESULT[2:]]]
    return bounded(docs).mapInArrow(run, docs.select(*[F.col(f"`{c}`") for c in keep], *added).schema)
