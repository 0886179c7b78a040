"""Licence notices found by MinHash bands over overlapping text windows.

Texts are cut into word pairs. A window as long as a template stands at every
word of a text; where a band of its minimum hashes equals the template's, the
exact share of the template's pairs found in the window decides. How many bands
there are follows from the least similarity that a matching window can have with
its template and the wanted probability: a window at every word is never out of
place, so that similarity is two thirds or so and few bands are enough.

The bands' tables are probed for many texts at once: a window has a template's
minimum if the value stands in it and no smaller one does, so the windows of a
value met reach as far as the next smaller hash on either side.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_column
from .words import PLAIN, distinct, mix, seeds, shingle_hashes, word_hashes

# Wordings of well-known licence notices. Of licences whose notices
# differ in a word or two, those are given that hold the words they differ in.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "all-rights-reserved": "All rights reserved. No part of this publication may be reproduced",
    "all-rights-reserved-bare": "All rights reserved.",
    "lgpl": "GNU Lesser General Public License",
    "agpl": "GNU Affero General Public License",
    "cc-by-sa-4.0": "Attribution-ShareAlike 4.0 International",
    "cc-by-sa-4.0-short": "CC BY-SA 4.0",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
    "epl-2.0": "made available under the terms of the Eclipse Public License 2.0",
    "bsd-disclaimer": "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "cc0-1.0": "CC0 1.0 Universal",
    "bsl-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-2-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsd-3-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsl-1.0-text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software",
}

WIDTH = 2


def bands_for(similarity: float, rows: int, probability: float) -> int:
    """Bands of ``rows`` hashes with which sets of this similarity share one with at least this probability."""
    return math.ceil(math.log(1 - probability) / math.log(1 - similarity**rows))


#: Places of a text whose windows are looked at together.
PIECE = 1 << 16


class Scanner:
    """Templates, their bands, and the search of many texts' words."""

    def __init__(self, templates: dict[str, str], share: float = 0.8, probability: float = 1 - 1e-6, salt: int = 7):
        self.share = share
        self.names = sorted(templates)
        texts = [templates[n].encode().translate(PLAIN) for n in self.names]
        words = [h[a:b] for _, _, h, bounds in word_hashes(texts) for a, b in zip(bounds, bounds[1:])]
        if any(len(w) < WIDTH for w in words):
            raise ValueError(f"a template has {WIDTH} words at least")
        self.pairs = [distinct(shingle_hashes(w, WIDTH)) for w in words]
        self.lengths = [len(w) - WIDTH + 1 for w in words]
        #: distinct pairs of each template that a matching window has at least
        self.need = [math.ceil(share * len(p) - 1e-9) for p in self.pairs]
        self.bands = bands_for(min(map(self.least_similarity, range(len(words)))), 1, probability)
        self.seeds = seeds(self.bands, salt)
        self.least = np.stack([[mix(p ^ s).min() for p in self.pairs] for s in self.seeds])  # bands x templates
        #: each band's table: minimum -> templates, and by its high bits whether one may be there
        self.tables: list[dict[int, list[int]]] = [{} for _ in self.seeds]
        self.near = np.zeros((self.bands, 1 << 16), bool)
        for table, near, least in zip(self.tables, self.near, self.least):
            near[least >> np.uint64(48)] = True
            for k, value in enumerate(least.tolist()):
                table.setdefault(value, []).append(k)

    def least_similarity(self, k: int) -> float:
        """Of a window that has just enough of template k."""
        return self.need[k] / (len(self.pairs[k]) + self.lengths[k] - self.need[k])

    def windows(self, pairs: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(template, first places of windows as long as it that share a band with it)."""
        longest = max(self.lengths)
        met: list[list[np.ndarray]] = [[] for _ in self.names]
        for a in range(0, len(pairs), PIECE):
            piece = pairs[a : a + PIECE + longest - 1]
            hits: list[set[int]] = [set() for _ in self.names]
            for seed, table, near in zip(self.seeds, self.tables, self.near):
                hashed = mix(piece ^ seed)
                for at in np.flatnonzero(near[hashed >> np.uint64(48)]).tolist():
                    value = hashed[at]
                    for k in table.get(int(value), ()):
                        n = self.lengths[k]
                        below = np.flatnonzero(hashed[max(0, at - n + 1) : at] < value)
                        above = np.flatnonzero(hashed[at + 1 : at + n] < value)
                        first = max(0, at - n + 1) + (int(below[-1]) + 1 if len(below) else 0)
                        last = min(at, len(piece) - n, (at + 1 + int(above[0]) if len(above) else len(piece)) - n)
                        hits[k].update(range(first, last + 1))
            for k, found in enumerate(hits):
                met[k].append(a + np.array(sorted(x for x in found if x < PIECE), np.int64))
        return [(k, np.unique(np.concatenate(found))) for k, found in enumerate(met) if any(map(len, found))]

    def shares(self, k: int, windows: np.ndarray) -> np.ndarray:
        """The share of template k's distinct pairs in each window (rows of pair hashes)."""
        own = self.pairs[k]
        at = np.minimum(np.searchsorted(own, windows), len(own) - 1)
        at = np.where(own[at] == windows, at, -1)
        out = np.zeros(len(windows))
        some = np.flatnonzero((at >= 0).sum(axis=1) >= self.need[k])
        rows = np.sort(at[some], axis=1)
        fresh = np.hstack([rows[:, :1] >= 0, (rows[:, 1:] != rows[:, :-1]) & (rows[:, 1:] >= 0)])
        out[some] = fresh.sum(axis=1) / len(own)
        return out

    def scan(self, words: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(text, template, first word of the best window, share found); text i has words[bounds[i]:bounds[i + 1]].

        A text shorter than a template is one window.
        """
        pairs = shingle_hashes(words, WIDTH)
        if not len(pairs):
            return []
        begins, ends = bounds[:-1], np.maximum(bounds[1:] - WIDTH + 1, bounds[:-1])
        best: dict[tuple[int, int], tuple[float, int]] = {}

        def take(k: int, text: int, start: int, share: float) -> None:
            if share >= self.need[k] / len(self.pairs[k]) and (-share, start) < best.get((text, k), (0.0, 0)):
                best[text, k] = (-share, start)

        for k, starts in self.windows(pairs):
            text = np.searchsorted(bounds, starts, side="right") - 1
            fine = starts + self.lengths[k] <= ends[text]
            starts, text = starts[fine], text[fine]
            for a in range(0, len(starts), 4096):
                some = starts[a : a + 4096]
                share = self.shares(k, pairs[some[:, None] + np.arange(self.lengths[k])])
                for i in np.flatnonzero(share):
                    take(k, int(text[a + i]), int(some[i] - begins[text[a + i]]), float(share[i]))
        full = np.flatnonzero(ends > begins)
        sizes = (ends - begins)[full]
        if len(full) and sizes.min() < max(self.lengths):
            # the pairs between texts belong to none
            own = np.concatenate([pairs[a:z] for a, z in zip(begins[full], ends[full])])
            edges = np.cumsum([0, *sizes])[:-1]
            least = np.stack([np.minimum.reduceat(mix(own ^ s), edges) for s in self.seeds])
            for k, n in enumerate(self.lengths):
                short = (sizes < n) & (sizes >= self.need[k]) & (least == self.least[:, k : k + 1]).any(axis=0)
                for i in np.flatnonzero(short):
                    window = pairs[begins[full[i]] : ends[full[i]]][None, :]
                    take(k, int(full[i]), 0, float(self.shares(k, window)[0]))
        return [(text, k, start, -share) for (text, k), (share, start) in sorted(best.items())]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, share: float = 0.8) -> DataFrame:
    """Licence notices in every text: doc_id, license, start, containment.

    One row for each text and template of whose distinct word pairs some window
    as long as the template (or the whole text, where that is shorter) holds
    ``share`` at least: start is the first word of the best window (the earliest
    of several), containment the share found. A null or empty text has none; a
    null doc_id stays null; repeated rows give repeated results; an empty table
    gives none; other columns are ignored; texts are read whole. The templates
    are sent with the function. No shuffle.
    """
    chosen = dict(templates or TEMPLATES)
    names = sorted(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scanner(chosen, share)
        for batch in (s for b in batches for s in slices(b)):
            ids, rows = batch.column(0).to_pylist(), []
            texts = [t.translate(PLAIN) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for first, _, hashes, bounds in word_hashes(texts):
                rows += [(ids[first + i], names[k], start, found) for i, k, start, found in own.scan(hashes, bounds)]
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.float64()))], names=["doc_id", "license", "start", "containment"])

    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_column(docs).alias("text"))
    return some.mapInArrow(run, "doc_id long, license string, start long, containment double")
