"""License scan: winnowed fingerprints of templates pick candidates, chained hits report spans.

Templates are whole license texts (the long ones in `license_texts`) and short notices. Their words' `K`-grams are
hashed and winnowed (the least hash of every `WINDOW` in a row), so any `K + WINDOW - 1` words
in common share a fingerprint. The inverted index is as small as the list of templates and
travels with the code. Each text is tokenized and looked up whole, vectorised; only around
fingerprints, all word K-grams in common with a template are chained over neighbouring diagonals, which
gives matched words, coverage and the span. A notice of another version or variant is no match. Of overlapping matches the one with most matched words stays.

Edge cases: null and empty texts match nothing; repeated rows match each; a null doc_id is
returned as it is; ties go to the template first in the list; an empty table gives an
empty result; other columns are ignored. A document without matches has no row.
"""

from __future__ import annotations

from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioflow.llm.common import read_table, slices, text_buffers
from folioflow.llm.words import mix, spans, take_ranges

K = 3
WINDOW = 3
COVERAGE = 0.8
PART = 20  # words that a part of a template has at least
REACH = 200  # words that text or template may have between two hits of a chain
NOTICE = 60  # templates of up to so many words must agree in version and variant
VARIANTS = "0 1 2 3 4 5 apache mit bsd isc mpl mozilla gpl lgpl agpl gnu general lesser library affero cc by nc nd sa attribution sharealike noncommercial noderivatives noderivs".split()

TEMPLATES: dict[str, str] = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "mit-notice": "Released under the MIT License",
    "mit": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
        ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
        ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
    ),
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "lgpl-notice": "licensed under the GNU Lesser General Public License",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2",
    **{x.name.removesuffix(".txt"): x.read_text() for x in sorted(files("folioflow.llm").joinpath("license_texts").iterdir(), key=lambda x: x.name) if x.name.endswith(".txt")},
}

_GAP = np.ones(256, dtype=bool)
_GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _words(raw: np.ndarray, offsets: np.ndarray):
    return spans(raw, offsets, separator=_GAP, lower=True)


def _grams(h: np.ndarray) -> np.ndarray:
    if len(h) < K:
        return np.zeros(0, np.uint64)
    c = np.uint64(0x9FB21C651E98DF25)
    total = h[: len(h) - K + 1].copy()
    for j in range(1, K):
        total = total * c + h[j : len(h) - K + 1 + j]
    return mix(total, 41)


class Index:
    def __init__(self, templates: dict[str, str] = TEMPLATES):
        self.names = list(templates)
        self.words: list[np.ndarray] = []
        keys, owner, place, picks = [], [], [], []
        for t, text in enumerate(templates.values()):
            raw = np.frombuffer(text.encode(), dtype=np.uint8)
            h = _words(raw, np.array([0, len(raw)]))[2]
            self.words.append(h)
            grams = _grams(h)
            picked = {k + int(grams[k : k + WINDOW].argmin()) for k in range(max(1, len(grams) - WINDOW + 1))}
            keys.append(grams)
            owner.append(np.full(len(grams), t))
            place.append(np.arange(len(grams)))
            picks.append(grams[sorted(picked)])
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner, self.place = keys[order], np.concatenate(owner)[order], np.concatenate(place)[order]
        self.fingerprints = np.unique(np.concatenate(picks))
        raw = " ".join(VARIANTS).encode()
        self.variants = np.unique(_words(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]))[2])

    def scan(self, h: np.ndarray, least: float = COVERAGE):
        """(template, matched words, coverage, first word, last word) of the matches in one text's words."""
        grams = _grams(h)
        low, high = np.searchsorted(self.keys, grams), np.searchsorted(self.keys, grams, side="right")
        at = np.repeat(np.arange(len(grams)), high - low)
        entry = take_ranges(low, high - low)
        owner, place = self.owner[entry], self.place[entry]
        found = []
        for t in np.unique(owner).tolist():
            own = owner == t
            found += self._matches(t, h, at[own], place[own], least)
        found.sort(key=lambda f: (-f[1], -f[2], f[0], f[3]))
        kept: list = []
        for f in found:
            if all(f[4] < g[3] or f[3] > g[4] for g in kept):
                kept.append(f)
        return sorted(kept, key=lambda f: f[3])

    def _matches(self, t: int, h: np.ndarray, at: np.ndarray, place: np.ndarray, least: float):
        words = self.words[t]
        needed = max(least * len(words), min(PART, COVERAGE * len(words)))
        reach = min(REACH, max(2, len(words) // 3))  # a short notice may stand twice in a row
        while K * len(at) >= needed:
            matched, text_at, template_at = chain(at, place, reach)
            if matched < needed:
                return
            first, last = int(text_at[0]), int(text_at[-1])
            if len(words) > NOTICE or self._same_variant(words, h, first, last, text_at, template_at):
                yield t, matched, matched / len(words), first, last
            rest = (at + K - 1 < first) | (at > last)
            at, place = at[rest], place[rest]

    def _same_variant(self, words, h, first, last, text_at, template_at) -> bool:
        """No version or variant word of the template is missing and the span holds no other one."""
        missing = np.delete(words, template_at)
        extra = np.delete(h[first : last + 1], text_at - first)
        return not np.isin(np.concatenate([missing, extra]), self.variants).any()


def chain(at: np.ndarray, place: np.ndarray, reach: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Words, their places in the text and in the template, of the chain of K-gram hits with most words.

    Hits (by `at`, then `place`) follow one another in both; between two of them either side may hold up to
    `reach` words that the other doesn't.
    """
    order = np.lexsort((place, at))
    at, place = at[order].astype(np.int64), place[order].astype(np.int64)
    score, back = np.full(len(at), K), np.full(len(at), -1)
    start = np.searchsorted(at, at - reach - K)
    stop = np.searchsorted(at, at)
    for i in range(len(at)):
        a, b = start[i], stop[i]
        if a == b:
            continue
        x, y = at[i] - at[a:b], place[i] - place[a:b]
        gain = np.where((y > 0) & (y <= reach + K) & ((x == y) | (np.minimum(x, y) >= K)), score[a:b] + np.minimum(np.minimum(x, y), K), 0)
        # of equal chains the one on the nearest diagonal
        j = int((gain * (4 * reach + 8) - np.abs(x - y)).argmax())
        if gain[j] > K:
            score[i], back[i] = gain[j], a + j
    i = int(score.argmax())
    hits = []
    while i >= 0:
        hits.append(i)
        i = int(back[i])
    hits = np.array(hits[::-1])
    steps = np.arange(K)
    return int(score.max()), np.unique(at[hits][:, None] + steps), np.unique(place[hits][:, None] + steps)


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = COVERAGE) -> DataFrame:
    """(doc_id, license, coverage, matched_words, start, end): character spans; no shuffle.

    Matches of less than `least` of the template are left out; 0 reports every part of `PART` words and more.
    """

    def run(batches):
        index = Index(templates)
        for batch in batches:
            rows = []
            for part in slices(batch):
                raw, offsets = text_buffers(part.column("text"))
                s, e, h, off = _words(raw, offsets)
                grams = _grams(h)
                hit = np.zeros(len(h), dtype=bool)
                if len(grams):
                    hit[: len(grams)] = np.isin(grams, index.fingerprints)
                touched = np.concatenate([[0], np.cumsum(hit)])
                chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                for k in np.flatnonzero(touched[off[1:]] > touched[off[:-1]]).tolist():
                    a = off[k]
                    for t, matched, coverage, first, last in index.scan(h[a : off[k + 1]], least):
                        zero = chars[offsets[k]]
                        rows.append((part.column("doc_id")[k].as_py(), index.names[t], round(coverage, 4), matched, int(chars[s[a + first]] - zero), int(chars[e[a + last]] - zero)))
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "license", "coverage", "matched_words", "start", "end"],
            )

    from pyspark.sql import functions as F

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, license string, coverage double, matched_words long, start long, end long")


def op5_license_scan(spark, sf_dir):
    return scan_licenses(read_table(spark, sf_dir, "documents"), least=0.0)


QUERIES = {"op5_license_scan": op5_license_scan}
ORACLES: dict[str, str] = {}
