"""License scans: winnowed fingerprints of templates, an inverted index, banded alignment (operator 1)."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Words in a fingerprinted gram, and grams in a winnowing window: a run of GRAM + WINNOW - 1 equal words is always found.
GRAM = 3
WINNOW = 2
#: Words by which an alignment may leave its diagonal on either side.
BAND = 12
#: Share of a template's words that a match must cover.
MIN_COVERAGE = 0.8
#: Notices by which public licences are named or granted in texts.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required "
        "by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."
    ),
    "bsd-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:"
    ),
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-nd-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "cc-by-nc-sa-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nd-4.0": "Licensed under CC BY-ND 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "mit": "Released under the MIT License.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software."
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

MATCHES = (
    "license string, coverage double, matched_words int, template_words int, "
    "word_start int, word_end int, char_start int, char_end int, matched_text string"
)
_WORD = re.compile(r"[^\W_]+")
_NONE = np.iinfo(np.int64).max


def words(text: str) -> list[str]:
    """Runs of letters and digits, in lower case."""
    return _WORD.findall(text.lower())


def _gram_codes(ids: np.ndarray, size: int) -> np.ndarray:
    """A mixed code for every run of GRAM word ids; _NONE where a word is none of the vocabulary's (id 0)."""
    n = len(ids) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    code, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for j in range(GRAM):
        part = ids[j : j + n]
        code = code * np.uint64(size) + part.astype(np.uint64)
        known &= part > 0
    code = (code * np.uint64(0x9E3779B97F4A7C15)) & np.uint64((1 << 63) - 1)
    return np.where(known, code.astype(np.int64), _NONE)


def winnow(codes: np.ndarray, window: int = WINNOW) -> np.ndarray:
    """Positions of the least code (the rightmost of equal ones) of every window; none where no code is known."""
    n = len(codes) - window + 1
    if n <= 0:
        return np.flatnonzero(codes != _NONE)
    least, at = codes[window - 1 :].copy(), np.arange(window - 1, len(codes))
    for j in range(window - 2, -1, -1):
        lower = codes[j : j + n] < least
        least = np.where(lower, codes[j : j + n], least)
        at = np.where(lower, np.arange(j, j + n), at)
    return np.unique(at[least != _NONE])


def align(template: list[int], text: list[int], shift: int, band: int = BAND, low: int = 0, high: int | None = None) -> list[tuple[int, int]]:
    """Pairs (template word, text word) of a best alignment with most equal words, kept within ``band`` of ``shift``.

    The diagonal of a pair is text word minus template word. Equal words count 2, each word left out on
    either side between the ends of the template costs 1; text before and after the template is free.
    Text words outside ``low`` and ``high`` match nothing. Of equally good alignments the one that ends
    nearest to the diagonal of ``shift`` is given.
    """
    width, floor = 2 * band + 1, -(10**9)
    low, high = max(low, 0), len(text) if high is None else min(high, len(text))
    rows = [[0] * width]
    moves = []
    for i, t in enumerate(template):
        last, row, move = rows[-1], [floor] * width, [0] * width
        for b in range(width):
            j = i + shift - band + b  # the text word on this cell
            best, how = (last[b + 1] - 1, 1) if b + 1 < width else (floor, 1)  # template word left out
            if low <= j < high:
                if text[j] == t and last[b] + 2 > best:
                    best, how = last[b] + 2, 3
                if b and row[b - 1] - 1 > best:
                    best, how = row[b - 1] - 1, 2  # text word left out
            row[b], move[b] = best, how
        rows.append(row)
        moves.append(move)
    b, i, out = max(range(width), key=lambda x: (rows[-1][x], -abs(x - band))), len(template) - 1, []
    while i >= 0:
        how = moves[i][b]
        if how == 3:
            out.append((i, i + shift - band + b))
            i -= 1
        elif how == 2:
            b -= 1
        else:
            i, b = i - 1, b + 1
            if b >= width:
                break
    return out[::-1]


class Spans:
    """Disjoint half-open spans in order; finds the gap around a word and whether a span is free."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def gap(self, at: int, length: int) -> tuple[int, int]:
        """The free stretch around word ``at``; empty if a span holds it."""
        i = bisect_left(self.starts, at + 1)
        low = self.ends[i - 1] if i else 0
        return (low, self.starts[i] if i < len(self.starts) else length) if low <= at else (at, at)

    def add(self, a: int, b: int) -> bool:
        """Take [a, b) if it is free."""
        i = bisect_left(self.starts, a)
        if (i and self.ends[i - 1] > a) or (i < len(self.starts) and self.starts[i] < b):
            return False
        self.starts.insert(i, a)
        self.ends.insert(i, b)
        return True


def occurrences(template: list[int], text: list[int], anchors: list[tuple[int, int]], least: float, band: int = BAND) -> list[tuple[int, int, int]]:
    """Disjoint matches (equal words, first text word, one past the last) of one template, in text order.

    ``anchors`` are pairs (text word, shift) of shared fingerprints. Every diagonal that carries one is
    aligned by itself, in the free stretch of text around its anchor; of overlapping matches the one with
    most equal words stays, then the first. An anchor that a kept match does not cover is aligned again in
    what is left, until no stretch holds ``least`` of the template's words. A stretch only shrinks, so a
    diagonal that once failed is not tried again.
    """
    n, taken, out = len(template), Spans(), []
    open_ = list(dict.fromkeys(anchors))
    while open_:
        found, tried = [], {}
        for at, shift in open_:
            low, high = taken.gap(at, len(text))
            if high - low < least * n:
                continue
            if (shift, low) not in tried:
                if low <= shift and shift + n <= high and text[shift : shift + n] == template:
                    tried[shift, low] = (n, shift, shift + n)
                else:
                    pairs = align(template, text, shift, band, low, high)
                    tried[shift, low] = (len(pairs), pairs[0][1], pairs[-1][1] + 1) if pairs and len(pairs) >= least * n else None
            if tried[shift, low]:
                found.append((tried[shift, low], (at, shift)))
        for match in sorted({m for m, _ in found}, key=lambda m: (-m[0], m[1], m[2])):
            if taken.add(*match[1:]):
                out.append(match)
        open_ = [x for _, x in found]
    return sorted(out, key=lambda m: m[1])


class LicenseIndex:
    """Inverted index from winnowed fingerprints to (template, word).

    The templates are a parameter, as the index is held by every task; it grows with them, not with the documents.
    """

    def __init__(self, templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE):
        templates = TEMPLATES if templates is None else templates
        self.names, self.min_coverage = sorted(templates), min_coverage
        split = [words(templates[n]) for n in self.names]
        if short := [n for n, w in zip(self.names, split, strict=True) if len(w) < GRAM]:
            raise ValueError(f"templates of fewer than {GRAM} words: {short}")
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for ws in split for w in ws}))}
        self.templates = [[self.vocabulary[w] for w in ws] for ws in split]
        self.longest = max(map(len, self.templates), default=0)
        self.postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        always = set()
        for k, ids in enumerate(self.templates):
            codes = _gram_codes(np.array(ids), len(self.vocabulary) + 1)
            for p in winnow(codes).tolist():
                self.postings[int(codes[p])].append((k, p))
            if len(ids) < GRAM + WINNOW - 1:  # too short for the guarantee of winnowing
                always |= set(codes.tolist())
        self.known = np.array(sorted(self.postings), np.int64)
        self.always = np.array(sorted(always), np.int64)

    def candidates(self, texts: list[str]) -> Iterator[tuple[int, list[int], dict[int, list[tuple[int, int]]]]]:
        """(text number, its word ids, {template: [(text word, shift)]}) of the texts that share a fingerprint with a template."""
        get = self.vocabulary.get
        each = [np.fromiter((get(w, 0) for w in words(x)), np.int64) for x in texts]
        gap = np.zeros(GRAM + WINNOW, np.int64)  # no gram or window spans two texts
        flat = np.concatenate([y for x in each for y in (x, gap)]) if each else gap
        starts = np.cumsum([0, *[len(x) + len(gap) for x in each]])
        codes = _gram_codes(flat, len(self.vocabulary) + 1)
        at = winnow(codes)
        if len(self.always):
            at = np.union1d(at, np.flatnonzero(np.isin(codes, self.always)))
        if not len(self.known) or not len(at):
            return
        slot = np.minimum(np.searchsorted(self.known, codes[at]), len(self.known) - 1)
        at = at[self.known[slot] == codes[at]]
        doc = np.searchsorted(starts, at, side="right") - 1
        for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(doc)) + 1):
            if not len(part):
                continue
            d = int(doc[part[0]])
            anchors: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for p in (at[part] - starts[d]).tolist():
                for k, q in self.postings[int(codes[starts[d] + p])]:
                    anchors[k].append((p, p - q))
            yield d, each[d].tolist(), anchors

    def scan(self, texts: list[str]) -> Iterator[tuple]:
        """(text number, name, coverage, matched, template words, word span, char span, text) of every match.

        Matches of one template never overlap (see ``occurrences``), and a template that stands several
        times in a text, however close, is reported as often. A match goes as a near miss if another
        template's on an overlapping span has no fewer equal words and a larger share of them among the
        words of either side. Whole templates within others are reported with them.
        """
        for d, ids, anchors in self.candidates(texts):
            found = [(a, b, k, n) for k, where in anchors.items() for n, a, b in occurrences(self.templates[k], ids, where, self.min_coverage)]
            if not found:
                continue
            spans = [m.span() for m in _WORD.finditer(texts[d].lower())]
            safe = len(texts[d].lower()) == len(texts[d])  # lower() of a few letters has another length
            found.sort()
            starts, reach = [x[0] for x in found], max(b - a for a, b, _, _ in found)
            for a, b, k, n in found:
                size = len(self.templates[k])
                share = n / (size + b - a - n)
                near = found[bisect_left(starts, a - reach) : bisect_left(starts, b)]
                if any(m >= n and y > a and m / (len(self.templates[q]) + y - x - m) > share for x, y, q, m in near):
                    continue
                at = (spans[a][0], spans[b - 1][1])
                piece = (texts[d] if safe else texts[d].lower())[at[0] : at[1]]
                yield d, self.names[k], n / size, n, size, a, b, *at, piece


def scan(docs: DataFrame, index: LicenseIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every licence match in the whole texts of ``docs``: doc_id (ids of any type), row_id, and MATCHES; spans are half open, characters are code points.

    Null and empty texts match nothing; null ids and repeated rows are scanned like others; an empty
    table gives no rows; other columns are ignored. No row leaves its task, so nothing is shuffled.
    """
    index = index or LicenseIndex()
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row_id"), F.col(text_col).alias("text"))
    out = StructType([*narrow.drop("text").schema, *StructType.fromDDL(MATCHES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.float64(), *[pa.int32()] * 6, pa.string()]
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                found = list(index.scan([x or "" for x in b.column(2).to_pylist()]))
                if found:
                    at, *columns = zip(*found, strict=True)
                    rows = pa.array(at, pa.int64())
                    columns = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), *columns], out.names)

    return narrow.mapInArrow(run, out)
