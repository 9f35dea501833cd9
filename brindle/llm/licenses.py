"""License scans by an exact set-similarity join of text blocks with templates.

A template is a set of words; its blocks are all windows of the whole text that are half as long again as the template,
wherever lines and paragraphs end. The templates' words are put in one order by how many documents of the corpus have
them, the rarest first. A block that holds at least the threshold t of a template T must hold one of T's first
|T| - ceil(t |T|) + 1 words (prefix filter), have at least ceil(t |T|) words (length filter), and, from the first common
word on, still have enough of T before it (positional filter). Windows that pass are counted exactly, so every block that
reaches the threshold is found. Of the windows that end at a word the one most like its template is the place. Places are taken best first, and
one falls only if most of the words that it matched are matched by better ones that stand (:meth:`LicenseScan.standing`): a license isn't taken for a
shorter one that it contains or for another version, and of two notices side by side, damaged or not, both stay.
Templates are a fixed list of a few kilobytes; all tasks have them, and no text is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.shared import bounded_batches, table
from brindle.llm.words import LOWER, chunks, hash_words

#: Share of a template's words that a block must hold, and words of a block for each of the template.
CONTAINMENT, WINDOW = 0.8, 1.5
#: Words that a turn back in the template counts as.
TURN = 4
#: Cells of windows, or words of places, that are looked at at once.
CELLS = 1 << 21

#: Phrases whose words must stand consecutively, and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Usual notices, and their labels.
TEMPLATES = (
    ("Released under the MIT License.", "mit"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("Licensed under the Apache License, Version 2.0.", "apache-2"),
    ("You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "apache-2"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
    ("This work is licensed under the GNU General Public License, version 2.", "gpl-2"),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", "lgpl-3"),
    ("This work is licensed under the GNU Lesser General Public License, version 2.1.", "lgpl-2"),
    ("This work is licensed under the GNU Affero General Public License, version 3.", "agpl-3"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
    ("Licensed under CC BY 4.0.", "cc-by"),
    ("Licensed under CC BY-SA 4.0.", "cc-by-sa"),
    ("Licensed under CC BY-ND 4.0.", "cc-by-nd"),
    ("Licensed under CC BY-NC-SA 4.0.", "cc-by-nc-sa"),
    ("Licensed under CC BY-NC-ND 4.0.", "cc-by-nc-nd"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa"),
    ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "cc-by-nd"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "cc-by-nc-sa"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "cc-by-nc-nd"),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "epl-2"),
    ("Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3", "gfdl-1.3"),
    ("You can redistribute it and/or modify it under the terms of the Artistic License 2.0", "artistic-2"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    ("Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "bsd"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide", "cc0"),
    # whole licenses and the headers that the others ask for
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal "
        "in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
        "of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this "
        "permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL "
        "THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT "
        "OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "mit",
    ),
    (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
        "notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS "
        "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
        "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        "isc",
    ),
    (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form "
        "must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
        "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
        "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT "
        "OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, "
        "STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "bsd",
    ),
    (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of "
        "this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it "
        "freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. "
        "If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be "
        "plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
        "zlib",
    ),
    (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright "
        "laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the "
        "benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of "
        "all present and future rights to this software under copyright law.",
        "unlicense",
    ),
    (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the "
        "License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
        "apache-2",
    ),
    *(
        (
            f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} Public License as published by the Free Software "
            f"Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but "
            f"WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} Public License for more details.",
            label,
        )
        for name, version, label in (("General", "3", "gpl-3"), ("General", "2", "gpl-2"), ("Lesser General", "3", "lgpl-3"), ("Lesser General", "2.1", "lgpl-2"), ("Affero General", "3", "agpl-3"))
    ),
    (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/.",
        "mpl-2",
    ),
)

#: Words are runs of ASCII letters and digits and of all beyond ASCII.
WORD = np.zeros(256, bool)
for _a, _b in (("0", "9"), ("A", "Z"), ("a", "z")):
    WORD[ord(_a) : ord(_b) + 1] = True
WORD[128:] = True


def words_of(text: str) -> np.ndarray:
    return hash_words([text.encode()], WORD, LOWER).hashes


@dataclass
class Found:
    """What a scan finds in one document; words are numbered from 0."""

    n_words: int
    n_base: int
    first_word: int | None
    last_word: int | None
    base_labels: list[str]
    labels: list[str]
    score: float


class LicenseScan:
    """Templates and phrases in the order of the corpus. ``df``: word hash -> documents with it."""

    def __init__(self, df: dict[int, int], templates=TEMPLATES, phrases=PHRASES, containment: float = CONTAINMENT):
        self.phrases = [(words_of(p), label) for p, label in phrases]
        self.labels = [label for _, label in templates] + [label for _, label in phrases]
        texts = [words_of(t) for t, _ in templates]
        sets = [np.unique(t) for t in texts] + [np.unique(p) for p, _ in self.phrases]
        self.n_templates = len(templates)
        vocabulary = sorted({int(h) for s in sets for h in s}, key=lambda h: (df.get(h, 0), h))
        order = {h: i for i, h in enumerate(vocabulary)}
        self.known = np.sort(np.array(vocabulary, np.uint64))
        self.rank = np.array([order[int(h)] for h in self.known], np.int64)  # of the sorted hashes
        self.sets = [np.sort([order[int(h)] for h in s]) for s in sets]
        self.need = [ceil(containment * len(s) - 1e-9) if i < self.n_templates else len(s) for i, s in enumerate(self.sets)]
        self.window = [ceil(WINDOW * len(t)) for t in texts]
        #: the first and last place of each word in a template
        self.span = []
        for text in texts:
            places = np.full((len(vocabulary), 2), -1)
            for i, h in enumerate(text):
                places[order[int(h)]] = (i if places[order[int(h)], 0] < 0 else places[order[int(h)], 0], i)
            self.span.append(places)
        #: words that follow one another in a template, and how often; how often a word stands there
        self.texts = [np.array([order[int(h)] for h in t], np.int64) for t in texts]
        self.times = [np.bincount(t, minlength=len(vocabulary)) for t in self.texts]
        pairs = [np.unique(t[:-1] * len(vocabulary) + t[1:], return_counts=True) for t in self.texts]
        self.steps, self.step_times = [p for p, _ in pairs], [n for _, n in pairs]
        #: word -> (template, place in it), for the words of prefixes
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        #: templates x words: 1 for a template's word, 2 for one of its prefix
        self.member = np.zeros((len(sets), len(vocabulary)), np.int8)
        for t, s in enumerate(self.sets):
            self.member[t, s] = 1
            for place, w in enumerate(s[: len(s) - self.need[t] + 1]):
                self.prefix.setdefault(int(w), []).append((t, place))
                self.member[t, w] = 2
        self.rare = np.zeros(len(vocabulary), bool)
        self.rare[list(self.prefix)] = True

    def candidates(self, block: np.ndarray, size: int) -> list[int]:
        """Templates and phrases that a block may hold; ``block``: the sorted distinct known words, ``size``: all its words."""
        passed: dict[int, bool] = {}
        for w in block[self.rare[block]]:
            for t, place in self.prefix[int(w)]:
                if t not in passed:
                    # the first common word: from here on T has no more than these words left to share
                    left = min(len(self.sets[t]) - place, len(block) - int(np.searchsorted(block, w)))
                    passed[t] = size >= self.need[t] and left >= self.need[t]
        held = np.zeros(self.member.shape[1], bool)
        held[block] = True
        return [t for t, ok in passed.items() if ok and held[self.sets[t]].sum() >= self.need[t]]

    def places(self, t: int, at: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, last), hits and likeness of each place of template t; first and last are indexes of ``at``.

        A place is the block that ends at a word of t, holds enough of its words and is most like it, of equal ones the shortest. Likeness: twice the common
        words and, doubled, steps from word to word, each as often as in the template, to those of the template and those of the block. A turn back in the template, to
        a word that only stands before, counts as ``TURN`` words more: the end of a notice and the begin of the next aren't one.
        """
        spots = np.flatnonzero(self.member[t, rank])
        at, rank = at[spots], rank[spots]
        kind = self.member[t, rank]
        spot = np.arange(len(at))
        low = np.searchsorted(at, at - self.window[t] + 1)
        rare = np.maximum.accumulate(np.where(kind == 2, spot, -1))
        ends = np.flatnonzero((spot - low + 1 >= self.need[t]) & (rare >= low))
        again, too_often = _recurrence(rank, np.ones(self.member.shape[1], np.int64)), _recurrence(rank, self.times[t])
        pair = np.append(rank[:-1] * self.member.shape[1] + rank[1:], -1)[: len(at)]
        step = np.append(at[1:] == at[:-1] + 1, False)[: len(at)] & np.isin(pair, self.steps[t])
        # steps that aren't the template's are told apart, each its own
        kinds, kind_of = np.unique(np.where(step, pair, -1 - spot), return_inverse=True)
        found_at = np.searchsorted(self.steps[t], kinds)
        step_too_often = _recurrence(kind_of, np.where(kinds >= 0, self.step_times[t][np.minimum(found_at, len(self.steps[t]) - 1)], 1)) if len(self.steps[t]) else again
        back_to = np.concatenate(([False], self.span[t][rank[1:], 1] <= self.span[t][rank[:-1], 0]))[: len(at)]
        turns = np.cumsum(back_to)
        whole = 3 * len(self.texts[t]) - 2
        found = [(np.zeros((0, 2), np.int64), np.zeros(0, np.int64), np.zeros(0))]
        while len(ends):
            n = max(1, CELLS // int((ends - low[ends]).max() + 1))
            now, ends = ends[:n], ends[n:]
            back = now[:, None] - np.arange(int((now - low[now]).max()) + 1)
            inside = back >= low[now][:, None]
            back = np.maximum(back, 0)
            hits = np.cumsum(inside & (again[back] > now[:, None]), axis=1)
            common = np.cumsum((inside & (too_often[back] > now[:, None])) + 2 * (inside & step[back] & (back < now[:, None]) & (step_too_often[back] >= now[:, None])), axis=1)
            words = at[now][:, None] - at[back] + 1 + TURN * (turns[now][:, None] - turns[back])
            like = 2 * common / (whole + 3 * words - 2)
            like[~inside | (hits < self.need[t])] = -1.0
            best = like.argmax(axis=1)
            row = np.arange(len(now))
            enough = like[row, best] >= 0
            ends_at = np.stack((back[row, best], now), axis=1)[enough]
            found.append((spots[ends_at], hits[row, best][enough], like[row, best][enough]))
        return tuple(np.concatenate([f[i] for f in found]) for i in range(3))  # type: ignore[return-value]

    def standing(self, at: np.ndarray, rank: np.ndarray, templates: list[int]) -> list[tuple[int, float]]:
        """(template, share) of the places that stand.

        They are decided best first: by likeness, then the larger template, then the one that comes first in the list, then the one that ends
        first. A place falls if at least half of its words that are its template's are words of better places that stand, and theirs, too.
        Those that no better undecided place overlaps are decided at once, which comes to the same.
        """
        of, ends, share, like = [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)], [np.zeros(0)], [np.zeros(0)]
        for t in templates:
            p, hits, q = self.places(t, at, rank)
            of.append(np.full(len(p), t))
            ends.append(p)
            share.append(hits / len(self.sets[t]))
            like.append(q)
        t, p, share_, q = np.concatenate(of), np.concatenate(ends), np.concatenate(share), np.concatenate(like)
        if not len(t):
            return []
        size = np.array([len(s) for s in self.sets])
        place = np.empty(len(t), np.int64)
        place[np.lexsort((p[:, 1], t, -size[t], -q))] = np.arange(len(t))
        mine = {int(x): self.member[x, rank] > 0 for x in np.unique(t)}
        total = np.empty(len(t), np.int64)
        taken, stand, open_ = np.zeros(len(at), bool), [], np.arange(len(t))

        def words(marked: np.ndarray, which: np.ndarray) -> np.ndarray:
            """How many of its template's words with a mark each place has."""
            out = np.empty(len(which), np.int64)
            for x, is_word in mine.items():
                sums = np.concatenate(([0], np.cumsum(is_word & marked)))
                here = t[which] == x
                out[here] = sums[p[which[here], 1] + 1] - sums[p[which[here], 0]]
            return out

        total = words(np.ones(len(at), bool), open_)
        while len(open_):
            open_ = open_[2 * words(taken, open_) < total[open_]]
            best = _unbeaten(np.column_stack((at[p[open_]], place[open_])))
            now = open_[best]
            stand += [(int(x), float(y)) for x, y in zip(t[now], share_[now], strict=True)]
            for x, is_word in mine.items():
                here = now[t[now] == x]
                edge = np.bincount(p[here, 0], minlength=len(at) + 1)[: len(at) + 1] - np.bincount(p[here, 1] + 1, minlength=len(at) + 1)[: len(at) + 1]
                taken |= (np.cumsum(edge)[:-1] > 0) & is_word
            open_ = open_[~best]
        return stand

    def scan(self, texts: list[bytes]) -> list[Found]:
        out: list[Found] = []
        for s in chunks(texts):
            words = hash_words(texts[s], WORD, LOWER)
            spots = np.searchsorted(self.known, words.hashes)
            spots[spots == len(self.known)] = 0
            there = self.known[spots] == words.hashes
            at, rank = np.flatnonzero(there), self.rank[spots[there]]
            cuts = np.searchsorted(at, words.at)
            for a, b, lo, hi in zip(words.at[:-1], words.at[1:], cuts[:-1], cuts[1:], strict=True):
                out.append(self._document(words.hashes[a:b], at[lo:hi] - a, rank[lo:hi]))
        return out

    def _document(self, words: np.ndarray, at: np.ndarray, rank: np.ndarray) -> Found:
        if not self.rare[rank].any():
            return Found(len(words), 0, None, None, [], [], 0.0)
        may = self.candidates(np.unique(rank), len(words))
        stand = self.standing(at, rank, sorted(t for t in may if t < self.n_templates))
        labels = {self.labels[t] for t, _ in stand}
        score = max((share for _, share in stand), default=0.0)
        # phrases: the document is the block, then the places one by one
        starts: list[np.ndarray] = []
        base: set[str] = set()
        for t in may:
            if t >= self.n_templates:
                phrase, label = self.phrases[t - self.n_templates]
                n = len(words) - len(phrase) + 1
                if n > 0 and len(found := np.flatnonzero(np.logical_and.reduce([words[j : j + n] == p for j, p in enumerate(phrase)]))):
                    starts.append(found)
                    base.add(label)
                    score = 1.0
        found = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        ends = (int(found.min()), int(found.max())) if len(found) else (None, None)
        return Found(len(words), len(found), *ends, sorted(base), sorted(base | labels), score)


def _recurrence(kind: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Where each of a row of kinds has come ``times`` (by kind) times more; the end if it doesn't."""
    order = np.lexsort((np.arange(len(kind)), kind))
    sorted_ = kind[order]
    later = np.arange(len(kind)) + times[sorted_]
    there = later < len(kind)
    there[there] = sorted_[later[there]] == sorted_[there]
    out = np.full(len(kind), len(kind))
    out[order[there]] = order[later[there]]
    return out


def _unbeaten(rows: np.ndarray) -> np.ndarray:
    """Which (first, last, ...) places no better one overlaps; the columns after the first two, then last, are the order, least first."""
    keep = np.zeros(len(rows), bool)
    place = np.empty(len(rows), np.int64)
    place[np.lexsort((rows[:, 1], *rows[:, :1:-1].T))] = np.arange(len(rows))
    by = np.argsort(rows[:, 0], kind="stable")
    first, last = rows[by, 0].astype(np.int64), rows[by, 1].astype(np.int64)
    reach = np.maximum.accumulate(last) if len(by) else last
    apart = np.flatnonzero(np.concatenate(([True], first[1:] > reach[:-1]))) if len(by) else by  # stretches that don't overlap
    size = np.concatenate(([0], np.cumsum(last - first + 1)))
    a = 0
    while a < len(by):
        b = int(np.searchsorted(size, size[a] + CELLS))
        later = apart[(apart > a) & (apart <= b)]
        more = apart[apart > a]
        b = int(later[-1]) if len(later) else int(more[0]) if len(more) else len(by)
        b = len(by) if size[-1] - size[a] <= CELLS else b
        order = a + np.argsort(-place[by[a:b]], kind="stable")  # the best comes last, and its number stays
        start, n, base = first[order], last[order] - first[order] + 1, int(first[a])
        cells = np.repeat(start - base - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        best = np.full(int(reach[b - 1]) - base + 1, len(rows), np.int64)
        best[cells] = np.repeat(place[by[order]], n)
        keep[by[order]] = np.minimum.reduceat(best[cells], np.concatenate(([0], np.cumsum(n)[:-1]))) == place[by[order]]
        a = b
    return keep


def document_frequencies(docs: DataFrame, text: str = "text") -> dict[int, int]:
    """Documents with each word of the templates, over all rows; a word a row at most goes to the driver."""
    known = np.unique(np.concatenate([words_of(t) for t, _ in (*TEMPLATES, *PHRASES)]))

    def count(batches):
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(0).to_pylist()]
            for s in chunks(texts):
                words = hash_words(texts[s], WORD, LOWER)
                spots = np.searchsorted(known, words.hashes)
                spots[spots == len(known)] = 0
                hit = np.flatnonzero(known[spots] == words.hashes)
                of = np.searchsorted(words.at, hit, "right") - 1
                total += np.bincount(np.unique(of * len(known) + spots[hit]) % len(known), minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(known))), pa.array(total)], ["word", "n"])

    counts = docs.select(F.col(text)).mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {int(known[r["word"]]): r["n"] for r in counts.collect()}


KIND = "struct<n_words: bigint, n_base: bigint, first_word: bigint, last_word: bigint, base_labels: string, labels: string, score: double>"


def scanner(spark: SparkSession, scan: LicenseScan, text: str = "text") -> Column:
    """The findings of a column of whole texts, as :data:`KIND`."""
    sent = spark.sparkContext.broadcast(scan)

    @F.arrow_udf(KIND)
    def found(texts: pa.Array) -> pa.Array:
        rows = sent.value.scan([t.encode() for t in texts.to_pylist()])
        return pa.StructArray.from_arrays(
            [
                *(pa.array([getattr(r, c) for r in rows], pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")),
                *(pa.array([",".join(getattr(r, c)) for r in rows], pa.string()) for c in ("base_labels", "labels")),
                pa.array([r.score for r in rows], pa.float64()),
            ],
            ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
        )

    return found(F.coalesce(F.col(text), F.lit("")))


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_words, n_base, first_word, last_word, base_labels, labels, score (the largest share of a template that stands).

    Two narrow passes over the text: the words' frequencies, then the join. Null, empty and wordless texts: no words, no
    places, empty labels, 0. Very long texts: scanned whole, in time linear in their words. Null keys and repeated rows: each
    row on its own. Ties of places: see :meth:`LicenseScan.standing`. An empty table: no rows. Columns other than key and text
    are ignored.
    """
    docs = bounded_batches(docs)
    scan = LicenseScan(document_frequencies(docs, text))
    found = docs.select(F.col(key), scanner(docs.sparkSession, scan, text).alias("_found"))
    return found.select(key, "_found.*")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in every whole text of ``documents``."""
    return license_scan(table(spark, sf_dir, "documents"))
