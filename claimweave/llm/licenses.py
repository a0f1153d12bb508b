"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import PLAIN_WORDS, WordTable, doc_key, key_to_id, mix64, shingle_hashes, text_blocks

SHINGLE = 5
CONTAINMENT = 0.8
#: Windows of so many shingles start every quarter of their length; a template is looked for at the least scale
#: that holds it, a longer one in pieces of the largest scale.
SCALES = (4, 16, 64)
#: A window that holds a template or piece must share a band with it at least this often.
RECALL = 0.999

#: Notices by which licenses are stated, as public texts have them (fixed values).
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-2-line": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-3-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}


def bands_for(similarity: float, recall: float = RECALL) -> int:
    """Bands of one row so that sets of this Jaccard similarity share one with probability ``recall``."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similarity)))


class TemplateIndex:
    """MinHash bands of templates, or of their pieces, by scale."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        self.sets, self.lengths = [], []
        self.bands: dict[int, dict[tuple[int, int], set[int]]] = {s: defaultdict(set) for s in SCALES}
        # a piece fills more than a quarter of its scale's window, so the window's similarity is over 1/5
        self.seeds = mix64(np.arange(1, bands_for(1 / 5) + 1, dtype=np.uint64))
        for k, name in enumerate(self.names):
            if len(templates[name].split()) < SHINGLE:
                raise ValueError(f"a template has {SHINGLE} words at least: {name}")
            h = shingle_hashes(WordTable([templates[name].lower().encode()], PLAIN_WORDS).hash)
            self.sets.append(np.unique(h))
            self.lengths.append(len(h))
            scale = next((s for s in SCALES if len(h) <= 3 * s // 4 + 1), SCALES[-1])
            step = 3 * scale // 4
            for at in range(0, len(h), step):
                for band, least in enumerate(self.minima(h[at : at + step])):
                    self.bands[scale][band, int(least)].add(k)
        self.known = np.unique(np.concatenate(self.sets)) if self.sets else np.zeros(0, dtype=np.uint64)
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(self.known >> np.uint64(48)).astype(np.int64)] = True

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        return mix64(shingles[None, :] ^ self.seeds[:, None]).min(axis=1)

    def marks(self, h: np.ndarray) -> np.ndarray:
        """Positions of shingles that some template has."""
        at = np.flatnonzero(self.maybe[(h >> np.uint64(48)).astype(np.int64)])
        return at[np.isin(h[at], self.known)]

    def scan(self, h: np.ndarray) -> list[tuple[str, int, int, float]]:
        """(template, first shingle, end, containment) of the best place of each template in a text's shingles.

        A window without any template shingle has no band in common with a template, so only windows around
        shared shingles are looked up; nothing is lost by that.
        """
        marks = self.marks(h)
        retrieved: dict[int, set[int]] = defaultdict(set)
        for scale in SCALES if len(marks) else ():
            stride = scale // 4
            starts = {s for m in (marks // stride).tolist() for s in range(max(0, m - 3), m + 1)}
            for s in sorted(starts):
                at = s * stride
                for band, least in enumerate(self.minima(h[at : at + scale])):
                    for k in self.bands[scale].get((band, int(least)), ()):
                        retrieved[k].add(at)
        out = []
        for k, places in sorted(retrieved.items()):
            best = None
            for at in sorted(places):
                # the template may begin or end outside the window
                from_, to = max(0, at - self.lengths[k]), at + SCALES[-1] + self.lengths[k]
                inside = np.isin(h[from_:to], self.sets[k])
                share = len(np.unique(h[from_:to][inside])) / len(self.sets[k])
                if share >= CONTAINMENT and (best is None or share > best[2]):
                    where = np.flatnonzero(inside)
                    best = (from_ + int(where[0]), from_ + int(where[-1]) + 1, share)
            if best:
                out.append((self.names[k], *best))
        # a match within another one's span goes if that has more of its shingles there, or as many and fits better
        size = dict(zip(self.names, map(len, self.sets)))
        weight = lambda m: (round(m[3] * size[m[0]]), m[3])
        return [m for m in out if not any(o[1] <= m[1] and m[2] <= o[2] and weight(o) > weight(m) for o in out)]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """Rows (key, license, first_word, end_word, containment): the templates that a text of ``docs`` (doc_id, text) holds.

    Words are compared without case and ASCII punctuation. A template counts if CONTAINMENT of its five-word
    shingles are in the region around a window that shares a MinHash band; one row for each document and
    template, for its best place. Of a match within the span of another the one with more shingles of its template stays. Whole texts are scanned. Null, empty and clean texts give no row; rows that
    repeat are scanned each. The templates are a short list of the configuration, of five words each at least (fewer are an error).
    """
    index = TemplateIndex(TEMPLATES if templates is None else templates)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            encoded = [(t or "").lower().encode() for t in pdf["text"]]
            keys = pdf["key"].tolist()
            for first, last in text_blocks(encoded):
                table = WordTable(encoded[first:last], PLAIN_WORDS)
                hashes = shingle_hashes(table.hash)
                hit = np.unique(table.text[index.marks(hashes)])
                for text in hit.tolist():
                    own = shingle_hashes(table.hash[table.first[text] : table.first[text + 1]])
                    for name, start, end, share in index.scan(own):
                        rows.append((keys[first + text], name, start, end - 1 + SHINGLE, share))
            yield pd.DataFrame(rows, columns=["key", "license", "first_word", "end_word", "containment"])

    return docs.select(doc_key().alias("key"), "text").mapInPandas(scan, "key long, license string, first_word long, end_word long, containment double")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(key_to_id("key").alias("doc_id"), "license", "first_word", "end_word", "containment")
