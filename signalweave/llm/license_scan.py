"""License scans with a positional index of licence words, of which each file's rarest ones are looked up."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalweave.llm.common import batch_slices, quoted
from signalweave.llm.text import filled

#: Bytes of words stay, A-Z are lowered, all other ASCII separates; bytes from 0x80 belong to words.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class Template:
    """A licence text and the phrases that a match must hold word by word."""

    label: str
    text: str
    keys: tuple[str, ...]


#: Phrases whose every place counts, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Public licence texts and notices, without names and years (fixed values), and phrases that a copy must hold.
TEMPLATES = (
    Template(
        "mit-text",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        ("permission is hereby granted free of charge",),
    ),
    Template(
        "bsd-text",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
        ("redistribution and use in source and binary forms",),
    ),
    Template(
        "isc-text",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
        ("with or without fee is hereby granted",),
    ),
    Template(
        "zlib-text",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
        ("must not be misrepresented",),
    ),
    Template(
        "unlicense-text",
        """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
        ("free and unencumbered software",),
    ),
    Template(
        "boost-1.0-text",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:""",
        ("accompanying documentation covered by this license",),
    ),
    Template(
        "apache-2.0-text",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
        ("apache license version 2 0",),
    ),
    Template(
        "gpl-text",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
        ("gnu general public license",),
    ),
    Template(
        "lgpl-text",
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
        ("gnu lesser general public license",),
    ),
    Template(
        "mpl-2.0-text",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
        ("mozilla public license",),
    ),
    Template(
        "cc-by-text",
        """This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA.""",
        ("creative commons attribution",),
    ),
)


def split_words(text: str) -> list[str]:
    return [w.decode() for w in text.encode().translate(TABLE).split(b" ") if w]


class Index:
    """Positions of all words in the templates, and phrases as word numbers."""

    def __init__(self, templates: tuple[Template, ...] = TEMPLATES, phrases: dict[str, str] = PHRASES, rare: int = 8, support: int = 4) -> None:
        self.templates, self.rare, self.support = templates, rare, support
        texts = [split_words(t.text) for t in templates]
        every = [*texts, *[p.split() for p in phrases], *[k.split() for t in templates for k in t.keys]]
        self.words = {w: i for i, w in enumerate(sorted({w for t in every for w in t}))}
        self.full = [np.array([self.words[w] for w in t]) for t in texts]
        self.postings: list[dict[int, list[int]]] = []
        for t in self.full:
            self.postings.append(defaultdict(list))
            for q, w in enumerate(t.tolist()):
                self.postings[-1][w].append(q)
        self.keys = [[np.array([self.words[w] for w in k.split()]) for k in t.keys] for t in templates]
        self.phrases = [(np.array([self.words[w] for w in p.split()]), label) for p, label in phrases.items()]
        self.names = pa.array(list(self.words), pa.string())


def tokens(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of the scan in one array, and each row's bounds in it."""
    text = filled(text).cast(pa.large_string())
    bounds = np.frombuffer(text.buffers()[1], "i8", len(text) + 1, text.offset * 8)
    data = text.buffers()[2]
    raw = (memoryview(data)[bounds[0] : bounds[-1]] if data is not None else b"").tobytes() if bounds[-1] > bounds[0] else b""
    bounds = bounds - bounds[0]
    plain = np.frombuffer(raw.translate(TABLE), "u1")
    word = np.zeros(len(plain) + 2, bool)
    word[1:-1] = plain != 32
    cut = np.zeros(len(plain) + 1, bool)
    cut[bounds] = True  # a word never crosses rows
    starts = np.flatnonzero(word[1:] & (~word[:-1] | cut))
    stops = np.flatnonzero(word[:-1] & (~word[1:] | cut))
    size = stops - starts
    offsets = np.concatenate([[0], np.cumsum(size)]).astype("i4")
    kept = plain[plain != 32].tobytes()
    flat = pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(kept))
    return flat, np.searchsorted(starts, bounds)


def places(ids: np.ndarray, at: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Starts of a phrase; ids and at are the licence words and their places, -1 elsewhere left out."""
    first = np.flatnonzero(ids == phrase[0])
    for j, w in enumerate(phrase[1:].tolist(), 1):
        first = first[first + j < len(ids)]
        first = first[(ids[first + j] == w) & (at[first + j] == at[first] + j)]
    return at[first]


def _matches(index: Index, rarity: np.ndarray, ids: np.ndarray, at: np.ndarray, t: int, keys: list[np.ndarray]) -> list[tuple[int, int, float]]:
    """(template, start, share of its words found in place) for one file and a template whose key phrases, at keys, the file has.

    The file's licence words that the template has too are looked up, those of the highest IDF first; where enough of them
    agree on a start and each key phrase stands within, there is a match.
    """
    posting, span = index.postings[t], len(index.full[t])
    mine = [w for w in np.unique(ids).tolist() if w in posting]
    chosen = set(sorted(mine, key=lambda w: (-rarity[w], w))[: index.rare])
    votes: dict[int, set[int]] = defaultdict(set)
    for i in np.flatnonzero(np.isin(ids, list(chosen))).tolist():
        for q in posting[int(ids[i])]:
            votes[int(at[i]) - q].add(int(ids[i]))
    out = []
    for start, words in votes.items():
        if len(words) >= index.support and all(((k >= start) & (k < start + span)).any() for k in keys):
            inside = (at >= start) & (at < start + span)
            out.append((t, start, float((index.full[t][at[inside] - start] == ids[inside]).sum() / span)))
    return out


def _coded(index: Index, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Licence words by number, their places in the batch, and each row's bounds in places; a gap of one word between rows, so that nothing stands across them."""
    flat, bounds = tokens(text)
    code = pc.fill_null(pc.index_in(flat, value_set=index.names), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(code >= 0)
    return code[at], at + np.searchsorted(bounds, at, side="right") - 1, bounds


def rarities(rows: DataFrame, index: Index) -> np.ndarray:
    """The inverse document frequency of each licence word over the whole corpus. What comes to the driver has a row for each word of the templates."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.zeros(len(index.words), "i8"), 0
        for batch in batches:
            for part in batch_slices(batch, "text"):
                ids, at, bounds = _coded(index, part.column("text"))
                row = np.searchsorted(bounds + np.arange(len(bounds)), at, side="right") - 1
                found += np.bincount(np.unique(row * len(found) + ids) % len(found), minlength=len(found))
                n += part.num_rows
        yield pa.record_batch([pa.array([*range(len(found)), -1], pa.int32()), pa.array([*found.tolist(), n], pa.int64())], names=["word", "n"])

    held = {r.word: r.n for r in rows.select("text").mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return np.array([math.log((1 + held.get(-1, 0)) / (1 + held.get(i, 0))) for i in range(len(index.words))])


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", templates: tuple[Template, ...] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """Rows (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) for each row of docs.

    Base: every place of a phrase. The method adds a template's label where at least four of the file's eight rarest words
    of that template, by document frequency in docs, stand at the same relative position as in the template and each key
    phrase stands within. score: the best share of a template's words found in place; 0.5 at least with a base phrase, 0
    with nothing. spans: template label, first word, one past the last, as far as the text goes. Null texts count as
    empty: no words, no labels, score 0. Repeated rows are scanned each. The frequencies take one pass, the scan another;
    rows never leave their task.
    """
    index = Index(templates, phrases)
    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text).alias("text"))
    rarity = rarities(rows, index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch_slices(batch, "text"):
                ids, at, bounds = _coded(index, part.column("text"))
                cols = [[] for _ in range(8)]
                edge = bounds + np.arange(len(bounds))
                row = np.searchsorted(at, edge)
                cuts = [(np.searchsorted(h, edge), h, label) for h, label in [(places(ids, at, p), label) for p, label in index.phrases]]
                held = [[(np.searchsorted(h, edge), h) for h in (places(ids, at, k) for k in keys)] for keys in index.keys]
                for i in range(part.num_rows):
                    s, words = int(edge[i]), int(bounds[i + 1] - bounds[i])
                    found = [(int(h[c[i]]) - s, int(h[c[i + 1] - 1]) - s, int(c[i + 1] - c[i]), label) for c, h, label in cuts if c[i + 1] > c[i]]
                    method = []
                    for t, keys in enumerate(held):
                        if all(c[i + 1] > c[i] for c, _ in keys):
                            method += _matches(index, rarity, ids[row[i] : row[i + 1]], at[row[i] : row[i + 1]] - s, t, [h[c[i] : c[i + 1]] - s for c, h in keys])
                    base = sorted({f[3] for f in found})
                    every = sorted({*base, *(index.templates[t].label for t, _, _ in method)})
                    best = max([0.5 * bool(found), *(share for *_, share in method)])
                    for col, v in zip(cols, [words, sum(f[2] for f in found), min((f[0] for f in found), default=None), max((f[1] for f in found), default=None), ",".join(base), ",".join(every), best, [{"label": index.templates[t].label, "start": max(0, a), "end": min(words, a + len(index.full[t]))} for t, a, _ in sorted(method)]]):
                        col.append(v)
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), span]
                yield pa.record_batch([part.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:bigint,end:bigint>>")
