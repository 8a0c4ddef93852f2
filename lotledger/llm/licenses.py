"""Licence scan: TF-IDF cosine of a file's passages to licence templates, then inheritance from the nearest ancestor directory.

Templates are one-line notices, standard headers, SPDX lines and whole licence texts (`licence_texts`), cut into sentences of `SHORT` words
or more. A file's passages are its lines, its sentences (which may run over several lines), each sentence with the next, and runs of
`WINDOWS` words. Each is a sparse vector of its words (letters and digits, A-Z in lower case), weighed by their inverse document frequency
over all files. A file has every licence with a template whose cosine to one of its passages is `LEAST` or more (for an SPDX line:
`EXACT`); its own licence is the one with the highest, of equal ones the one that more words of its passages speak for. A licence file
(its name is `LICENSE`) states the licence of its directory. A file without an own licence has that of the nearest directory above it
that has one.

Every word weighs 1 at least, so no passage is lost that is tested only where words outside the templates could weigh no more than 1.

Null or empty text: no own licence. Null path: no inheritance. Ties go to the template that stands first; of several licence files in
one directory the one with the highest cosine, then the smallest file id, counts. Repeated rows give repeated results. An empty table
gives an empty result. Texts are read whole. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotledger.llm.tables import ship, slices, stored, texts_of
from lotledger.llm.words import lowered, raw, span_hashes, word_spans

ship(__name__)

LEAST, EXACT, LICENCE_FILE = 0.6, 0.99, "LICENSE"
SHORT, WINDOWS = 8, (6, 9, 13, 19, 28, 42)
# Short notices by which works name their licence.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, version 2.0"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0"),
    ("Proprietary", "All rights reserved. No part of this work may be reproduced without permission"),
    ("Proprietary", "All rights reserved"),
)
_GNU = (
    "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} as published by the Free Software "
    "Foundation{3} either version {4} of the License, or (at your option) any later version. This {0} is distributed in the hope that it will be "
    "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {2} "
    "for more details. You should have received a copy of the GNU {2} along with this {0}."
)
# Headers that the licences' authors ask for in each file.
HEADERS = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
     "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in "
     "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either "
     "express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", _GNU.format("program", ":", "General Public License", ",", 3)),
    ("GPL-2.0", _GNU.format("program", ";", "General Public License", ";", 2)),
    ("LGPL-3.0", _GNU.format("library", ":", "Lesser General Public License", ",", 3)),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
     "this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)
IDENTIFIERS = tuple(
    (name, f"SPDX-License-Identifier: {name}{end}")
    for name in dict.fromkeys(n for n, _ in TEMPLATES[:-2]) for end in (("", "-only", "-or-later") if "GPL" in name else ("",))
)


def whole_texts() -> tuple[tuple[str, str], ...]:
    """Name and text of the whole licences."""
    return tuple((p.stem, p.read_text()) for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")))


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and text of every word, and whether a line and a sentence begins with it.

    A line ends with a line feed or a full stop, `!` or `?` before white space; a sentence with one of the latter, an empty line or the text.
    """
    data, offsets = raw(texts)
    data = lowered(data)
    white = ((data - np.uint8(9)) < 5) | (data == 32)
    plain = ((data - np.uint8(97)) < 26) | ((data - np.uint8(48)) < 10) | (data >= 128)
    stop, feed = np.zeros(len(data), bool), data == 10
    if len(data):
        stop[:-1] = ((data[:-1] == 46) | (data[:-1] == 33) | (data[:-1] == 63)) & white[1:]
    lone = data == 13  # a carriage return that no line feed follows ends a line too
    if len(data):
        lone[:-1] &= ~feed[1:]
    starts, ends, counts = word_spans(np.where(plain, data, np.uint8(32)), offsets)
    text = np.repeat(np.arange(len(counts)), counts)
    stops, feeds = (np.concatenate([[0], np.cumsum(x)])[starts] for x in (stop, feed | lone))
    first = np.diff(text, prepend=-1) != 0
    ended = first | (np.diff(stops, prepend=0) > 0)
    fed = np.diff(feeds, prepend=0)
    return span_hashes(data, starts, ends), text, ended | (fed > 0), ended | (fed > 1)


def _passages(text: np.ndarray, line: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of every passage, and the word after it; each once."""
    n = len(text)
    found = []
    for begins in (line, sentence):
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], n)[: len(starts)]
        found.append((starts, ends))
    same = text[starts[:-1]] == text[starts[1:]]
    found.append((starts[:-1][same], ends[1:][same]))
    for size in WINDOWS:
        at = np.arange(0, max(n - size + 1, 0), max(size // 4, 1))
        at = at[text[at] == text[at + size - 1]]
        found.append((at, at + size))
    both = np.unique(np.concatenate([a * (n + 1) + b for a, b in found]))
    return both // (n + 1), both % (n + 1)


class Templates:
    """Word hashes and counts of the templates, which are grouped by licence and limit."""

    def __init__(self, templates: tuple[tuple[str, str], ...], least: float = LEAST, whole: tuple[tuple[str, str], ...] = (), exact: tuple[tuple[str, str], ...] = ()) -> None:
        self.names = list(dict.fromkeys(n for n, _ in (*templates, *whole, *exact)))
        parts = [(self.names.index(name), least, _words(pa.array([text]))[0]) for name, text in templates]
        parts += [(self.names.index(name), max(least, EXACT), _words(pa.array([text]))[0]) for name, text in exact]
        for name, text in whole:
            hashes, _, _, begins = _words(pa.array([text]))
            cuts = [*np.flatnonzero(begins).tolist(), len(hashes)]
            a = 0
            for b in cuts[1:]:  # a short sentence goes with the next one
                if b - a >= SHORT or b == len(hashes):
                    parts.append((self.names.index(name), least, hashes[a:b]))
                    a = b
        parts = sorted((p for p in parts if len(p[2])), key=lambda p: p[:2])
        self.words = np.unique(np.concatenate([w for *_, w in parts]))
        self.counts = np.array([np.bincount(np.searchsorted(self.words, w), minlength=len(self.words)) for *_, w in parts], float)
        groups = [p[:2] for p in parts]
        self.begins = [k for k, g in enumerate(groups) if not k or g != groups[k - 1]]
        self.groups = [groups[k] for k in self.begins]

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each word among the templates' words; their number for all others."""
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, len(self.words))


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of each part each word stands."""
    for batch in batches:
        for part in slices(batch, "text", 1 << 22):
            hashes, text, *_ = _words(texts_of(part))
            word, at = np.unique(hashes, return_inverse=True)
            own = np.unique(text * max(len(word), 1) + at)
            n = np.bincount(own % max(len(word), 1), minlength=len(word)) if len(word) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "texts"])


def frequencies(files: DataFrame) -> DataFrame:
    """word, texts: the number of texts that hold it, for every word of all texts."""
    return files.select("text").mapInArrow(_seen, "word long, texts long").groupBy("word").agg(F.sum("texts").alias("texts"))


FOUND = pa.list_(pa.struct([
    ("licence", pa.int32()), ("least", pa.float64()), ("dot", pa.float64()), ("known", pa.float64()), ("words", pa.int64()),
    ("other", pa.list_(pa.struct([("word", pa.int64()), ("times", pa.int64())]))),
]))


def _likely(templates: Templates, weights: np.ndarray) -> Callable:
    """weights: of each template word. Words that are not in the templates count 1 here, the least they can weigh."""
    unit = templates.counts * weights
    unit /= np.sqrt((unit**2).sum(1, keepdims=True))
    most = np.append(unit.max(0) * weights, 0.0)
    weigh, wide, lowest = np.append(weights, 1.0), len(weights), min(least for _, least in templates.groups)
    holders = np.count_nonzero(unit, axis=0)
    begin = np.cumsum(holders) - holders
    held_by, held = np.nonzero(unit.T)[1], unit.T[np.nonzero(unit.T)]

    def likes(row: np.ndarray, word: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """Products of n passages with the templates, the largest of each group."""
        many = holders[word]
        at = np.repeat(begin[word] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        cell = np.repeat(row, many) * len(unit) + held_by[at]
        all_ = np.bincount(cell, np.repeat(value, many) * held[at], minlength=n * len(unit)).reshape(n, len(unit))
        return np.maximum.reduceat(all_, templates.begins, axis=1)

    def of_part(part: pa.RecordBatch) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in range(part.num_rows)]
        hashes, text, line, sentence = _words(texts_of(part))
        if not len(hashes):
            return out
        starts, ends = _passages(text, line, sentence)
        known = templates.known(hashes)
        top, squares = (np.concatenate([[0.0], np.cumsum(x)]) for x in (most[known], weigh[known] ** 2))
        # Repeated words only lengthen a vector, so this is no less than any cosine.
        good = top[ends] - top[starts] >= (lowest - 1e-6) * np.sqrt(np.maximum(squares[ends] - squares[starts], 1e-300))
        starts, ends = starts[good], ends[good]
        for k in range(0, len(starts), 256):
            a, b = starts[k : k + 256], ends[k : k + 256]
            size = b - a
            place = np.repeat(np.arange(len(a)), size)
            at = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            values, which = np.unique(hashes[at], return_inverse=True)
            cell, times = np.unique(place * len(values) + which, return_counts=True)
            row, value = cell // len(values), values[cell % len(values)]
            word = templates.known(value)
            length = times * weigh[word]
            inner = word < wide
            inside = np.bincount(row[inner], length[inner] ** 2, minlength=len(a))
            outside = np.bincount(row[~inner], length[~inner] ** 2, minlength=len(a))
            dots = likes(row[inner], word[inner], length[inner], len(a))
            limits = np.array([least for _, least in templates.groups]) - 1e-9
            for i, g in zip(*np.nonzero(dots >= limits * np.sqrt(inside + outside)[:, None]), strict=True):
                licence, least = templates.groups[g]
                mine = np.flatnonzero((row == i) & ~inner)
                other = [{"word": w, "times": t} for w, t in zip(value[mine].view(np.int64).tolist(), times[mine].tolist(), strict=True)]
                found = {"licence": licence, "least": least, "dot": float(dots[i, g]), "known": float(inside[i]), "words": int(size[i]), "other": other}
                out[text[a[i]]].append(found)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("file"), part.column("path"), pa.array(of_part(part), FOUND)], ["row", "file", "path", "found"]
                )

    return run


def own_licences(files: DataFrame, templates: Templates) -> DataFrame:
    """file, path, licence, cosine, licences (all of them, with their cosines, best first) for every row."""
    spark = files.sparkSession
    texts = stored(frequencies(files), "words")
    every = files.count()
    # One number for each template word reaches the driver.
    asked = spark.createDataFrame([(int(w),) for w in templates.words.view(np.int64)], "word long")
    counted = dict(texts.join(asked, "word").select("word", "texts").collect())
    weights = np.array([math.log((1 + every) / (1 + counted.get(int(w), 0))) + 1 for w in templates.words.view(np.int64)])
    shape = "row long, file long, path string, found array<struct<licence int, least double, dot double, known double, words long, other array<struct<word long, times long>>>>"
    rows = files.withColumn("row", F.monotonically_increasing_id())
    likely = stored(rows.mapInArrow(_likely(templates, weights), shape), "licences-likely")
    found = likely.select("row", F.explode("found").alias("f")).select("row", "f.*")
    # Passages with the same other words share one sum.
    others = found.where(F.size("other") > 0).select("other").distinct().select("other", F.explode("other").alias("o")).select("other", "o.word", "o.times")
    weight = F.lit(math.log(1 + every)) - F.log(1.0 + F.col("texts")) + 1
    sums = others.join(texts, "word").groupBy("other").agg(F.sum((F.col("times") * weight) ** 2).alias("more"))
    found = found.where(F.size("other") > 0).join(sums, "other").drop("other").unionByName(found.where(F.size("other") == 0).drop("other").withColumn("more", F.lit(0.0)))
    found = found.withColumn("cosine", F.least(F.lit(1.0), F.round(F.col("dot") / F.sqrt(F.col("known") + F.col("more")), 9))).where("cosine >= least")
    each = found.groupBy("row", "licence").agg(F.max("cosine").alias("cosine"), F.sum(F.col("cosine") * F.col("words")).alias("speak"))
    names = F.array(*map(F.lit, templates.names))
    best = each.groupBy("row").agg(F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("a"), (-F.round("speak", 6)).alias("b"), F.col("licence").alias("c")))).alias("best"))
    named = best.select("row", F.transform("best", lambda x: F.struct(F.element_at(names, x["c"] + 1).alias("licence"), (-x["a"]).alias("cosine"))).alias("licences"))
    told = likely.select("row", "file", "path").join(named, "row", "left")
    first = F.col("licences")[0]
    return told.select("file", "path", first["licence"].alias("licence"), first["cosine"].alias("cosine"), F.coalesce("licences", F.expr("cast(array() as array<struct<licence: string, cosine: double>>)")).alias("licences"))


def scan(files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """file, path, licence, cosine, licences, how (own, inherited or null), from_path for every row. files: (file long, path string, text)."""
    known = Templates((*templates, *HEADERS), least, (*whole_texts(), *HEADERS), IDENTIFIERS)
    files = files.select(F.col("file").cast("long").alias("file"), F.col("path").cast("string").alias("path"), "text")
    own = stored(own_licences(files, known), "licences")
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    name = F.regexp_extract("path", "([^/]*)$", 1)
    stated = (
        own.where((name == LICENCE_FILE) & F.col("licence").isNotNull()).groupBy(folder.alias("folder"))
        .agg(F.max(F.struct("cosine", (-F.col("file")).alias("order"), "licence", "path")).alias("s"))
        .select("folder", F.col("s.licence").alias("above"), F.col("s.path").alias("from_path"))
    )
    # Directories, not files, look up their ancestors.
    folders = own.where(F.col("licence").isNull() & F.col("path").isNotNull()).select(folder.alias("own_folder")).distinct()
    steps = F.split("own_folder", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    nearest = Window.partitionBy("own_folder").orderBy(F.length("folder").desc())
    given = (
        folders.select("own_folder", F.explode(F.array_distinct(above)).alias("folder")).join(stated, "folder")
        .withColumn("place", F.row_number().over(nearest)).where("place = 1").select("own_folder", "above", "from_path")
    )
    has = F.col("licence").isNotNull()
    return own.withColumn("own_folder", F.when(F.col("licence").isNull(), folder)).join(given, "own_folder", "left").select(
        "file", "path", F.coalesce("licence", "above").alias("licence"), "cosine", "licences",
        F.when(has, "own").when(F.col("above").isNotNull(), "inherited").alias("how"),
        F.when(has, F.col("path")).otherwise(F.col("from_path")).alias("from_path"),
    )
