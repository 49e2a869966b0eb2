"""Licence scans: normalised text compared to licence templates by the Dice coefficient over word bigrams.

Text is lower-cased and reduced to words of letters and digits, whatever its lines. A document is compared as windows of
neighbouring words, wherever they stand. For bigram sets A (window) and B (template)

    dice = 2 |A and B| / (|A| + |B|)

so dice >= t needs |A| between t / (2 - t) |B| and (2 - t) / t |B|, and as many common bigrams as the lower bound. A template
whose bigrams the document shares less of is pruned, from an index of bigrams. For the others the windows that begin and end
at a shared bigram are scored, up to the upper bound of bigrams long; a stretch of that length with too few shared ones
is passed over. A template of one word has that word as its only "bigram".

Templates are a parameter: (licence, text) pairs; the default ones are the usual short notices and some full short
texts. They are small and go to the tasks with the code.

Edge cases: null and empty texts match nothing; matches do not overlap: the higher score is kept, of equal scores the template
that comes first in the list, then the earlier window; texts of any length are scanned whole, in time that grows with their
words times the length of the templates they hold; repeated rows are scanned row by row; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusjobs.llm.common import slices

THRESHOLD = 0.8

_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
    "IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a "
    "copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed "
    "under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for "
    "the specific language governing permissions and limitations under the License."
)
_GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software "
    "Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be "
    "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for "
    "more details."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    "copyright notice and this permission notice appear in all copies."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
    "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
)
_MPL = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can "
    "obtain one at http://mozilla.org/MPL/2.0/."
)
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike"}

#: Fixed values: (licence, template text).
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", _GRANT),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", _APACHE),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GPL.format(name="General Public License", version=3)),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _GPL.format(name="General Public License", version=2)),
    ("LGPL-3.0", _GPL.format(name="Lesser General Public License", version=3)),
    ("AGPL-3.0", _GPL.format(name="Affero General Public License", version=3)),
    ("BSD-2-Clause", _BSD),
    ("BSD-3-Clause", _BSD + "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", _ISC),
    ("Unlicense", _UNLICENSE),
    ("MPL-2.0", _MPL),
    *((f"CC-{k}-4.0", f"Licensed under CC {k} 4.0.") for k in _CC),
    *((f"CC-{k}-4.0", f"This work is licensed under a Creative Commons {v} 4.0 International License.") for k, v in _CC.items()),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("all-rights-reserved", "All rights reserved."),
]

_words = re.compile(r"[^\W_]+").findall
_spans = re.compile(r"[^\W_]+").finditer


def bigrams(text: str) -> set[tuple[str, ...]]:
    words = _words(text.lower())
    return set(zip(words, words[1:])) if len(words) != 1 else {(words[0],)}


class Index:
    """Templates by bigram, with their size bounds."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float):
        self.threshold = threshold
        self.templates = [(name, bigrams(text)) for name, text in templates]
        low, high = threshold / (2 - threshold), (2 - threshold) / threshold
        self.bounds = [(low * len(b), high * len(b)) for _, b in self.templates]
        self.least, self.most = min((a for a, _ in self.bounds), default=1), max((b for _, b in self.bounds), default=0)
        self.of: dict[tuple[str, ...], list[int]] = {}
        for n, (_, b) in enumerate(self.templates):
            for pair in b:
                self.of.setdefault(pair, []).append(n)
        self.known = frozenset(self.of)
        self.single = any(len(pair) == 1 for pair in self.known)

    def best(self, stretch: str) -> tuple[float, int] | None:
        """(dice, template) of the best template for a stretch, or None below the threshold."""
        # a bigram takes three characters at least, two with a one-word template
        if len(stretch) < self.least:
            return None
        pairs = bigrams(stretch)
        size = len(pairs)
        if not self.least <= size <= self.most:
            return None
        common: dict[int, int] = {}
        for pair in pairs & self.of.keys():
            for n in self.of[pair]:
                common[n] = common.get(n, 0) + 1
        found = None
        for n, both in sorted(common.items()):
            low, high = self.bounds[n]
            if low <= size <= high:
                dice = 2 * both / (size + len(self.templates[n][1]))
                if dice >= self.threshold and (found is None or dice > found[0]):
                    found = (dice, n)
        return found

    def _windows(self, n: int, pairs: list[tuple[str, ...]], hits: list[int]) -> list[tuple[float, int, int, int]]:
        """(-dice, template, first, last) of the best window from each shared bigram, as places in `pairs`."""
        template, (low, high) = self.templates[n][1], self.bounds[n]
        out, done = [], -1
        for k, first in enumerate(hits):
            stop = bisect_left(hits, first + int(high), k)
            if stop - k < low or first <= done:
                continue
            found, seen, common, at = None, set(), set(), first
            for last in hits[k:stop]:
                seen.update(pairs[at : last + 1])
                at = last + 1
                common.add(pairs[last])
                dice = 2 * len(common) / (len(seen) + len(template))
                if dice >= self.threshold and (found is None or dice > found[0]):
                    found = (dice, last)
            if found:
                out.append((-found[0], n, first, found[1]))
                if found[0] == 1:  # nothing that overlaps it can be better
                    done = found[1]
        return out

    def scan(self, text: str) -> list[tuple[int, int, float, int]]:
        """(start, end, dice, template) of the best windows that do not overlap, by start."""
        low = text.lower()
        alike = len(low) == len(text)
        words = _words(low) if alike else [w.lower() for w in _words(text)]
        found: list[tuple[float, int, int, int]] = []  # places of words
        for width, pairs in ((2, list(zip(words, words[1:]))), (1, [(w,) for w in words] if self.single else [])):
            shared = self.known.intersection(pairs)
            counts = Counter(n for pair in shared for n in self.of[pair])
            asked = {n for n, k in counts.items() if k >= self.bounds[n][0]}
            if not asked:
                continue
            hits: dict[int, list[int]] = {}
            for at, pair in enumerate(pairs):
                if pair in shared:
                    for n in asked.intersection(self.of[pair]):
                        hits.setdefault(n, []).append(at)
            found += [(d, n, first, last + width) for n, places in hits.items() for d, n, first, last in self._windows(n, pairs, places)]
        if not found:
            return []
        spans = [m.span() for m in _spans(text)]
        taken: list[tuple[int, int]] = []
        out = []
        for dice, n, first, end in sorted(found):
            k = bisect_left(taken, (first, end))
            if (k == 0 or taken[k - 1][1] <= first) and (k == len(taken) or taken[k][0] >= end):
                insort(taken, (first, end))
                out.append((spans[first][0], spans[end - 1][1], -dice, n))
        return sorted(out)


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, licence (of the best match, null without one), dice, n_matches, matches (licence, dice, start, end in characters)."""
    pairs = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(pairs, threshold)
        for batch in slices(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                hits = index.scan(text or "")
                best = min(hits, key=lambda h: (-h[2], h[3], h[0]), default=None)
                rows.append((index.templates[best[3]][0] if best else None, best[2] if best else 0.0, len(hits), [{"licence": index.templates[n][0], "dice": d, "start": a, "end": b} for a, b, d, n in hits]))
            kind = pa.list_(pa.struct([("licence", pa.string()), ("dice", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.float64(), pa.int32(), kind))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "licence", "dice", "n_matches", "matches"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, licence string, dice double, n_matches int, matches array<struct<licence:string,dice:double,start:int,end:int>>")
