"""Licence scan: runs of sentences against licence templates by the Dice coefficient of their word bigrams.

Texts and templates become lower-case words. A text is cut at sentence ends and line breaks; every run of consecutive
pieces whose number of bigrams lies within the size bounds of a template is compared with it. A run and a template of
a and b bigrams share at most the smaller number, so a coefficient of ``least`` needs
``least / (2 - least) * b <= a <= (2 - least) / least * b``.

Before that, a text is passed over if it holds none of a template's anchors: with a bound on how many bigrams of the
template a run may lack, any set of one more contains one that it must have. Both bounds lose nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 0.8
_WORD = re.compile(r"[^\W_]+")
_CUT = re.compile(r"(?<=[.!?])\s+|\n")

# Short notices and the openings of licences as their publishers word them.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "MIT notice": "Released under the MIT License.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0 header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        'applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."
    ),
    "GPL-3.0-or-later header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
        "this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "
        '"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
        "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this "
        "list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def bigrams(words: list[str]) -> Counter:
    return Counter(zip(words, words[1:]))


def dice(left: Counter, right: Counter) -> float:
    """Dice coefficient of two bags; 0 if both are empty."""
    total = left.total() + right.total()
    return 2 * (left & right).total() / total if total else 0.0


@dataclass(frozen=True)
class Template:
    name: str
    bag: Counter
    low: int
    high: int
    anchors: frozenset


def compiled(templates: dict[str, str], least: float) -> list[Template]:
    """Templates with their size bounds and anchors; those of fewer than two words match nothing and are left out."""
    out = []
    for name, text in sorted(templates.items()):
        bag = bigrams(words_of(text))
        size = bag.total()
        if not size:
            continue
        low, high = math.ceil(least / (2 - least) * size - 1e-9), math.floor((2 - least) / least * size + 1e-9)
        # A run of a >= low bigrams shares at least least / 2 * (a + size) of them, so at most this many are lacking.
        lacking = math.floor(size - least / 2 * (low + size) + 1e-9)
        anchors, counted = [], 0
        # Long first words are rare ones, and equal ones make fewer words to look for.
        for pair in sorted(bag, key=lambda p: (-len(p[0]), p)):
            if counted > lacking:
                break
            anchors.append(pair)
            counted += bag[pair]
        out.append(Template(name, bag, low, high, frozenset(anchors)))
    return out


def scan(text: str, templates: list[Template], least: float) -> list[tuple[str, float, int, int]]:
    """``(name, coefficient, start, end)`` of the best run for each template that has one; ``start`` and ``end`` count characters.

    Of equal coefficients the run that starts first, then the shorter one, is taken.
    """
    lower = text.lower()
    possible = [t for t in templates if any(a in lower and b in lower for a, b in t.anchors)]
    if not possible:
        return []
    spans, at = [], 0
    for cut in [*_CUT.finditer(text), None]:
        end = cut.start() if cut else len(text)
        words = words_of(text[at:end])
        if words:
            spans.append((at, end, words))
        at = cut.end() if cut else end
    own = [set(zip(w, w[1:])) for _, _, w in spans]
    found = []
    for t in possible:
        best = None
        useful = [not p.isdisjoint(t.bag) for p in own]
        for i in range(len(spans)):
            words: list[str] = []
            for j in range(i, len(spans)):
                words += spans[j][2]
                if len(words) - 1 > t.high:
                    break
                # A run is no better for a piece without a bigram of the template at either end, joints apart.
                joint = j > i and (spans[j - 1][2][-1], spans[j][2][0]) in t.bag
                if len(words) - 1 < t.low or not (useful[j] or joint) or not (useful[i] or j > i):
                    continue
                value = dice(bigrams(words), t.bag)
                if value >= least and (best is None or value > best[0]):
                    best = (value, spans[i][0], spans[j][1])
        if best:
            found.append((t.name, *best))
    return found


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """``(id, license, dice, start, end)``: the best run of each document for each template that reaches ``least``.

    Null, empty and wordless texts give no rows; equal rows give theirs each; null ids are kept. Texts of any length
    are scanned whole, and the time goes with their length, as a run is bounded by its template's size.
    """
    known = compiled(TEMPLATES if templates is None else templates, least)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(at, *hit) for at, value in enumerate(batch.column(1)) if value.is_valid for hit in scan(value.as_py(), known, least)]
            at, name, value, start, end = zip(*found) if found else [()] * 5
            columns = [pa.array(name, pa.string()), pa.array(value, pa.float64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], ["id", "license", "dice", "start", "end"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, license string, dice double, start bigint, end bigint")


def query(spark, sf_dir: str) -> DataFrame:
    """Licence notices in all documents."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
