"""Licence scans: texts compared with licence templates by the Dice coefficient of their sets of word bigrams.

Texts are normalised to words of letters and digits in small letters. A document is compared as a whole, by paragraph
(lines between empty ones) and by line. Since Dice is at most 2 min(a, b) / (a + b) for sets of a and b bigrams, a unit
is compared only with templates whose size lies within the bounds the threshold sets, and only if it holds enough bigrams
of any template.

A licence may also stand in several paragraphs, or in part of a longer line. So windows of words, from one bigram of a template
to another over whatever lies between, are compared as well, each template with its best window. A window inside a unit that
has matched the same licence says nothing new and is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gapkit.llm.words import mix, raw, slices, words_in

_WARRANTY = ("THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
             "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
             "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
             "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
# Wordings of public licences and of the notices that point to them, each under its SPDX identifier.
TEMPLATES = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
            "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
            "included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY "
            "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
            "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
            "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
            "OTHER DEALINGS IN THE SOFTWARE."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies. " + _WARRANTY),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. "
             + _WARRANTY),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
                   "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
                   "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
                   "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
                   "governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
                         "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
                         "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
                         "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
                         "License for more details. You should have received a copy of the GNU General Public License along with this "
                         "program. If not, see <https://www.gnu.org/licenses/>."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)


def _normal() -> np.ndarray:
    """Letters small, everything else in ASCII that is no letter or digit a space; line feeds are read before this."""
    out = np.arange(256, dtype=np.uint8)
    for i in range(128):
        out[i] = ord(chr(i).lower()) if chr(i).isalnum() else 32
    return out


_NORMAL = _normal()


@dataclass(frozen=True)
class LicenseParams:
    """``templates`` are pairs of an identifier and a text and number a few hundred at most; they go to every task."""

    threshold: float = 0.8
    templates: tuple[tuple[str, str], ...] = field(default=TEMPLATES)


def _bigrams(words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all pairs of words that follow each other in one line, and the first word of each."""
    h = words.hashes()
    if len(h) < 2:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    inside = np.ones(len(h), bool)
    ends = words.bounds[1:] - 1
    inside[ends[ends >= 0]] = False
    at = np.flatnonzero(inside[:-1])
    return mix(h[at] * np.uint64(0x9E3779B97F4A7C15) + h[at + 1]), at


def _template_sets(p: LicenseParams) -> list[tuple[str, int, np.ndarray]]:
    out = []
    for i, (name, text) in enumerate(p.templates):
        data = _NORMAL[np.frombuffer(text.encode(), np.uint8)]
        out.append((name, i, np.unique(_bigrams(words_in(data, np.array([0, len(data)])))[0])))
    return [t for t in out if len(t[2])]


def _units(data: np.ndarray, at: np.ndarray):
    """Kind (0 document, 1 paragraph, 2 line), document, and first and last byte of each unit; documents with one line are
    one unit, as are paragraphs of one line."""
    doc_edge = np.zeros(len(data) + 1, bool)
    doc_edge[at] = True
    feed = np.flatnonzero(data == 10)
    starts = np.union1d(at[:-1][np.diff(at) > 0], feed + 1)
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))
    doc = np.searchsorted(at, starts, "right") - 1
    blank = np.ones(len(starts), bool)
    seen = np.concatenate([[0], np.cumsum(~np.isin(data, (9, 10, 11, 12, 13, 32)))])
    blank = seen[ends] == seen[starts]
    lines = np.flatnonzero(~blank)
    if not len(lines):
        return (np.empty(0, np.int64),) * 4
    new = np.ones(len(lines), bool)
    new[1:] = (np.diff(lines) > 1) | (doc[lines][1:] != doc[lines][:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(lines)) - 1
    several = tail > head
    docs = np.unique(doc[lines])
    first = np.searchsorted(doc[lines], docs)
    last = np.searchsorted(doc[lines], docs, "right") - 1
    more = last > first
    kind = np.concatenate([np.zeros(more.sum(), np.int64), np.ones(several.sum(), np.int64), np.full(len(lines), 2)])
    return (kind, np.concatenate([docs[more], doc[lines][head[several]], doc[lines]]),
            np.concatenate([starts[lines][first[more]], starts[lines][head[several]], starts[lines]]),
            np.concatenate([ends[lines][last[more]], ends[lines][tail[several]], ends[lines]]))


UNITS = ("document", "paragraph", "line", "window")


def best_window(hashes: np.ndarray, hit: np.ndarray, size: int, threshold: float) -> tuple[float, int, int] | None:
    """Score and bounds of the window of bigrams with the highest Dice coefficient, the first and shortest of equals; ``hit`` marks
    the bigrams of the template, which has ``size``. None if no window reaches the threshold.

    A best window begins and ends with a hit. In a window from s, a bigram counts if it has not occurred since s. Windows
    grow until they hold too many bigrams for the threshold, or all hits that are left, or the bigram at s again: from there on a
    later start does as well. So all windows together are no longer than the text times the distinct bigrams of the template.
    The first start is then found by going back from the best windows over bigrams that are in them.
    """
    n = len(hashes)
    order = np.argsort(hashes, kind="stable")
    prev, nxt = np.full(n, -1), np.full(n, n)
    same = hashes[order][1:] == hashes[order][:-1]
    prev[order[1:][same]], nxt[order[:-1][same]] = order[:-1][same], order[1:][same]
    left = np.cumsum(((nxt == n) & hit)[::-1])[::-1]  # distinct hits from a place to the end
    need, most = threshold * size / (2 - threshold) - 1e-9, size * (2 - threshold) / threshold + 1e-9

    def scores(s: int, end: int) -> np.ndarray:
        reach = 2 * size
        while True:
            hi = min(s + reach, end)
            fresh = prev[s:hi] < s
            own, common = np.cumsum(fresh), np.cumsum(fresh & hit[s:hi])
            if own[-1] > most or common[-1] == left[s] or hi == end:
                return 2 * common / (own + size)
            reach *= 2

    best, ends = 0.0, []  # of the best score: starts and last ends, by start
    for s in np.flatnonzero(hit & (left >= need)).tolist():
        found = scores(s, int(nxt[s]))
        top = float(found.max())
        if top >= threshold and top >= best:
            if top > best:
                best, ends = top, []
            ends.append((s, s + len(found) - int(found[::-1].argmax())))
    if not ends:
        return None
    # from ``low`` on, all up to ``seen`` are in a best window; ``far`` is the farthest next occurrence of these and of the one before
    low = seen = ends[0][0]
    far = -1
    for s, end in ends:
        far = max(far, int(nxt[seen:s].max(initial=-1)))
        seen = s
        while low and max(far, int(nxt[low - 1])) < end:
            low -= 1
            far = max(far, int(nxt[low]))
    start = low + int(hit[low:].argmax())
    found = scores(start, n)
    return best, start, start + int(found.argmax()) + 1


def scanned(docs: DataFrame, params: LicenseParams = LicenseParams()) -> DataFrame:
    """``doc_id, license, score, unit, first_word, n_words`` for each row of ``docs`` (``doc_id, text``): its best match.

    Ties go to the larger unit, then the earlier one, then the earlier template. ``license`` is null and ``score`` 0 where
    nothing reaches the threshold, as for null texts and texts of one word. An empty table gives no rows. Bigrams go
    over line ends in documents, paragraphs and windows.
    """
    p = params

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = _template_sets(p)
        known = np.unique(np.concatenate([t[2] for t in templates])) if templates else np.empty(0, np.uint64)
        sizes = np.array([len(t[2]) for t in templates])
        owned = [np.isin(known, t[2], assume_unique=True) for t in templates]
        few = int(np.ceil(p.threshold * (1 + sizes.min(initial=1)) / 2))
        for part in slices(batches):
            data, at = raw(part.column(1))
            words = words_in(_NORMAL[data], at)
            hashes, first = _bigrams(words)
            hit = np.zeros(len(hashes), bool)
            if len(known):
                where = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = known[where] == hashes
            hits = np.concatenate([[0], np.cumsum(hit)])
            best: dict[int, tuple] = {}
            matched: dict[tuple[int, str], list[tuple[int, int]]] = {}  # words of the units that match a licence
            kind, doc, lo, hi = _units(data, at)
            word_lo, word_hi = np.searchsorted(words.starts, lo), np.searchsorted(words.starts, hi)
            a, b = np.searchsorted(first, word_lo), np.searchsorted(first, np.maximum(word_hi - 1, word_lo))
            for u in np.flatnonzero(hits[b] - hits[a] >= few).tolist():
                own = np.unique(hashes[a[u]:b[u]])
                bound = p.threshold / (2 - p.threshold)
                for t in np.flatnonzero((sizes >= bound * len(own)) & (sizes * bound <= len(own))).tolist():
                    common = np.isin(own, templates[t][2], assume_unique=True).sum()
                    score = 2 * int(common) / (len(own) + int(sizes[t]))
                    rank = (-score, int(kind[u]), int(lo[u]), templates[t][1])
                    if score >= p.threshold:
                        matched.setdefault((int(doc[u]), templates[t][0]), []).append((int(word_lo[u]), int(word_hi[u])))
                    if score >= p.threshold and (int(doc[u]) not in best or rank < best[int(doc[u])][0]):
                        place = int(word_lo[u] - words.bounds[doc[u]])
                        best[int(doc[u])] = rank, templates[t][0], score, UNITS[kind[u]], place, int(word_hi[u] - word_lo[u])
            at_hit = np.flatnonzero(hit)
            index = where[at_hit] if len(known) else at_hit
            doc_of_hit = np.searchsorted(words.bounds, first[at_hit], "right") - 1
            edges = np.searchsorted(first, words.bounds)
            for t, (name, number, _) in enumerate(templates):
                mine = owned[t][index]
                pairs = np.unique(doc_of_hit[mine] * len(known) + index[mine])  # distinct bigrams of the template in a document
                d, distinct = np.unique(pairs // max(len(known), 1), return_counts=True)
                for i in d[distinct >= p.threshold * sizes[t] / (2 - p.threshold) - 1e-9].tolist():
                    lo_, hi_ = int(edges[i]), int(edges[i + 1])
                    inside = np.zeros(hi_ - lo_, bool)
                    chosen = at_hit[mine & (doc_of_hit == i)]
                    inside[chosen - lo_] = True
                    window = best_window(hashes[lo_:hi_], inside, int(sizes[t]), p.threshold)
                    if window is None:
                        continue
                    score, s, e = window
                    a_, b_ = int(first[lo_ + s]), int(first[lo_ + e - 1]) + 2
                    if any(x <= a_ and b_ <= y for x, y in matched.get((i, name), ())):
                        continue
                    rank = (-score, 3, int(words.starts[a_]), number)
                    if i not in best or rank < best[i][0]:
                        best[i] = rank, name, score, UNITS[3], a_ - int(words.bounds[i]), b_ - a_
            found = [best.get(i, (None, None, 0.0, None, None, None)) for i in range(part.num_rows)]
            kinds = (pa.string(), pa.float64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array([f[i + 1] for f in found], k) for i, k in enumerate(kinds))],
                names=["doc_id", "license", "score", "unit", "first_word", "n_words"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, license string, score double, unit string, first_word long, n_words long")
