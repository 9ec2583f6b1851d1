"""License scans: winnowed fingerprints of templates in an inverted index pick candidates, banded alignment reports coverage and spans.

Templates and texts are sequences of words (runs of letters and digits, ASCII lower-cased). Grams of words in a row are
hashed; of every few grams in a row the smallest hash is a fingerprint, of a template as of a text, so that every stretch
of gram + window - 1 words that both hold leaves a fingerprint in common. Gram (GRAM at most) and window (WINNOW at most)
of a template are those of the shortest run that words changed one by one down to `coverage` must leave it (words added
to the text besides may still hide such a copy). An inverted index leads from a fingerprint to the templates and places
that have it; a text's fingerprint there is a hit on a diagonal (place in the text minus place in the template).

Diagonals are taken in blocks of BLOCK; every block with a hit is one candidate, so a candidate's size is bounded,
however its hits run together. A candidate's stretch of the text is aligned with the whole template: local alignment by
words (MATCH for equal words, MISS for a wrong, missing or added one), in a band of BAND words to either side of the
block. For each word of the text the best alignment that ends there counts (of equal ones the one with most equal words,
then the shortest), if it covers at least `coverage` of the template's words. Of reports that overlap in the text the
one with most matched words stays.

Defined cases: null, empty and word-less texts have no reports; a template without words is never reported; ties go to
the template that comes first, then to the leftmost span; copies of a template in one text are reported each; repeated
rows get equal results; a text of any length is scanned whole; an empty table gives an empty result. Extra columns, of
any names, pass through where asked for; a result column replaces one of its name.

Scale: one pass, no shuffle; templates are a mapping or a table of checked size, broadcast. Candidates of a template are
aligned side by side, and are at most a block for every BLOCK words of the text, so work grows with texts and their hits.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import LOWER, arrow_map, buffers, col, gram_hashes, mask_of, word_bounds, word_hashes

WORD = mask_of([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
GRAM, WINNOW, BAND, BLOCK = 3, 2, 8, 16
MATCH, MISS = 2, -1
#: Cells of alignments that are computed side by side.
CELLS = 1 << 18
#: Words that a template may have: what the packed cells of an alignment hold.
MOST_WORDS = 1 << 17
BITS = 20
MOST_BYTES = 8 << 20
#: Fixed texts of notices and license heads.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0-head": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-head": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0-head": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}
REPORT = T.StructType([T.StructField("license", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("matched", T.LongType()), T.StructField("coverage", T.DoubleType())])
_ARROW = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("matched", pa.int64()), ("coverage", pa.float64())]))


def winnowed(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the grams that are the smallest of some `window` in a row, or of all if fewer (the last of equals)."""
    window = min(window, len(grams))
    if window < 2:
        return np.arange(len(grams))
    views = np.lib.stride_tricks.sliding_window_view(grams, window)
    return np.unique(np.arange(len(views)) + window - 1 - np.argmin(views[:, ::-1], axis=1))


_SCORE, _MATCHED = 44, 22  # a cell: score, matched words, first word (from the candidate's begin), so that the largest is the best


def align(words: np.ndarray, begin: np.ndarray, low: np.ndarray, high: np.ndarray, template: np.ndarray, least: int) -> list[tuple[int, int, int, int]]:
    """(candidate, matched, first, end) for each word that ends an alignment of `least` matched words or more.

    Candidates lie side by side: diagonal d of candidate c is place begin[c] + d of words under the template's first word.
    Only places from low[c] to high[c], the candidate's text, are aligned.
    """
    width, m = BLOCK + 2 * BAND, len(template)
    place = begin[:, None] + np.arange(width)
    shift = np.arange(width, dtype=np.int64) << _SCORE
    one, fresh = np.int64(1) << _SCORE, (np.int64(MATCH) << _SCORE) + (np.int64(1) << _MATCHED)
    cells = np.zeros(place.shape, np.int64)
    best: dict[tuple[int, int], int] = {}
    for j in range(m):
        inside = (place >= low[:, None]) & (place < high[:, None])
        equal = inside & (words[np.clip(place, 0, len(words) - 1)] == template[j])
        new = np.where(equal, np.maximum(cells + fresh, fresh + (place - begin[:, None])), cells + MISS * one)  # on along a diagonal, or begin
        new[:, :-1] = np.maximum(new[:, :-1], cells[:, 1:] + MISS * one)  # a word of the template is missing
        # words of the text are added: along the row each costs MISS
        new = np.maximum.accumulate(np.where(inside, new, 0) - MISS * shift, axis=1) + MISS * shift
        new[(new < one) | ~inside] = 0
        if j + 1 >= least:
            for c, b in zip(*(x.tolist() for x in np.nonzero(equal & ((new >> _MATCHED) & ((1 << _MATCHED) - 1) >= least)))):
                key = (c, int(place[c, b]))
                best[key] = max(best.get(key, 0), int(new[c, b]))
        cells = new
        place = place + 1
    low22 = (1 << _MATCHED) - 1
    return [(c, v >> _MATCHED & low22, int(begin[c]) + (v & low22), p + 1) for (c, p), v in best.items()]


def disjoint(found: set[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Of (template, matched, first, end) those with most matched words, then the first template, then the leftmost, that do not overlap."""
    kept: list[tuple[int, int, int, int]] = []  # in the order of the text
    for r in sorted(found, key=lambda r: (-r[1], r[0], r[2], r[3])):
        i = bisect.bisect(kept, r[2], key=lambda x: x[2])
        if (not i or kept[i - 1][3] <= r[2]) and (i == len(kept) or r[3] <= kept[i][2]):
            kept.insert(i, r)
    return kept


class Index:
    def __init__(self, templates: Mapping[str, str], coverage: float):
        if sum(len(t.encode()) for t in templates.values()) > MOST_BYTES:
            raise ValueError(f"templates of more than {MOST_BYTES} bytes: scan with several parts of them")
        self.names, self.words, self.least = list(templates), [], []
        #: (gram, window) -> fingerprint -> (template, place)
        self.index: dict[tuple[int, int], dict[int, list[tuple[int, int]]]] = {}
        for k, t in enumerate(templates.values()):
            data = LOWER[np.frombuffer(t.encode(), np.uint8)]
            w = word_hashes(data, *word_bounds(data, np.array([0, len(data)]), WORD))
            if len(w) > MOST_WORDS:
                raise ValueError(f"template {self.names[k]} has more than {MOST_WORDS} words")
            least = max(1, math.ceil(coverage * len(w) - 1e-9))
            self.words.append(w)
            self.least.append(least)
            if len(w):
                run = -(-least // (len(w) - least + 1))  # words in a row that changes down to coverage leave
                n = min(GRAM, run)
                window = min(WINNOW, run - n + 1)
                own = self.index.setdefault((n, window), {})
                grams = gram_hashes(w, n)
                for i in winnowed(grams, window).tolist():
                    own.setdefault(int(grams[i]), []).append((k, i))
        self.bits = {}
        for key, own in self.index.items():
            self.bits[key] = np.zeros(1 << BITS, bool)
            self.bits[key][np.fromiter((h >> (64 - BITS) for h in own), np.int64, len(own))] = True

    def scan(self, texts: pa.Array) -> list[list[dict]]:
        data, off = buffers(texts)
        low = LOWER[data]
        starts, ends = word_bounds(low, off, WORD)
        first = np.searchsorted(starts, off)
        doc = np.repeat(np.arange(len(texts)), np.diff(first))
        words = word_hashes(low, starts, ends)
        blocks: dict[int, set[tuple[int, int]]] = {}  # template -> (text, block of diagonals)
        for (n, window), index in self.index.items():
            grams = gram_hashes(words, n)
            picked = winnowed(grams, window)
            picked = picked[self.bits[n, window][(grams[picked] >> np.uint64(64 - BITS)).astype(np.int64)]]
            picked = picked[doc[picked] == doc[picked + n - 1]]
            for p in picked.tolist():
                d = int(doc[p])
                for k, i in index.get(int(grams[p]), ()):
                    blocks.setdefault(k, set()).add((d, (p - i - int(first[d])) // BLOCK))
        found: dict[int, set[tuple[int, int, int, int]]] = {}
        for k, own in blocks.items():
            own = np.array(sorted(own), np.int64)
            step = max(1, CELLS // (BLOCK + 2 * BAND))
            for a in range(0, len(own), step):
                d, g = own[a : a + step].T
                begin = first[d] + g * BLOCK - BAND
                for c, matched, x, y in align(words, begin, first[d], first[d + 1], self.words[k], self.least[k]):
                    found.setdefault(int(d[c]), set()).add((k, matched, x, y))
        out: list[list[dict]] = [[] for _ in range(len(texts))]
        if found:
            char = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
            for d, own in found.items():
                base = char[off[d]]
                for k, matched, x, y in disjoint(own):
                    out[d].append({"license": self.names[k], "start": int(char[starts[x]] - base), "end": int(char[ends[y - 1]] - base), "matched": matched, "coverage": matched / len(self.words[k])})
        return out


def read_templates(table: DataFrame, *, name: str = "license", text: str = "text") -> dict[str, str]:
    """Name -> text of a table of templates, by name; an error if its texts have over MOST_BYTES bytes. Null names and texts are left out."""
    rows = table.select(col(name).cast("string").alias("name"), col(text).cast("string").alias("text")).dropna().dropDuplicates(["name"])
    if (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > MOST_BYTES:
        raise ValueError(f"templates of more than {MOST_BYTES} bytes: scan with several parts of them")
    return dict(sorted((r["name"], r["text"]) for r in rows.collect()))


def template_files(spark, path: str) -> DataFrame:
    """The table (license, text) of the text files of a folder or glob: a file's name without its last ending, and its whole text."""
    name = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.[^.]*$", "")
    return spark.read.text(path, wholetext=True).select(F.url_decode(name).alias("license"), F.col("value").alias("text"))


def scan_licenses(docs: DataFrame, *, keep: Sequence[str] = ("doc_id",), text: str = "text", templates: Mapping[str, str] | DataFrame | None = None, coverage: float = 0.8) -> DataFrame:
    """Columns keep of docs, and reports: license, start and end (code points), matched words and coverage, by start.

    templates: name -> text, or a table (license, text); without them the notices and heads above.
    """
    own = read_templates(templates) if isinstance(templates, DataFrame) else TEMPLATES if templates is None else templates
    shared = docs.sparkSession.sparkContext.broadcast(Index(own, coverage))

    def make():
        index = shared.value
        return lambda texts: [pa.array(index.scan(texts), _ARROW)]

    return arrow_map(docs, keep, text, make, [T.StructField("reports", T.ArrayType(REPORT))])


def query(spark, sf_dir: str) -> DataFrame:
    out = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    spans = F.array_join(F.transform("reports", lambda r: F.concat_ws(":", r["license"], r["start"].cast("string"), r["end"].cast("string"), F.round(r["coverage"], 4).cast("string"))), ",")
    return out.select("doc_id", F.size("reports").cast("long").alias("n_reports"), F.array_join(F.array_sort(F.array_distinct(F.transform("reports", lambda r: r["license"]))), ",").alias("licenses"), F.coalesce(F.array_max(F.transform("reports", lambda r: r["coverage"])), F.lit(0.0)).alias("coverage"), spans.alias("spans"))


def brute(text: str | None, templates: Mapping[str, str], coverage: float = 0.8) -> list[tuple[str, int, int, int]]:
    """(license, start, end, matched), by unbanded alignment of the whole text with every template, in plain loops."""
    import re

    def words(t):
        return [(m[0].lower() if m[0].isascii() else "".join(c.lower() if c < "\x80" else c for c in m[0]), m.start(), m.end()) for m in re.finditer(r"[0-9a-zA-Z\x80-\U0010ffff]+", t or "")]

    own, found = words(text), set()
    for k, t in enumerate(templates.values()):
        w = [x[0] for x in words(t)]
        rows: dict[tuple[int, int], tuple[int, int, int]] = {}
        for j in range(len(w)):
            for i in range(len(own)):
                options = [(0, 0, 0)]
                if (d := rows.get((j - 1, i - 1))) or own[i][0] == w[j]:
                    equal = own[i][0] == w[j]
                    if d:
                        options.append((d[0] + (MATCH if equal else MISS), d[1] + equal, d[2]))
                    if equal:
                        options.append((MATCH, 1, i))
                options += [(c[0] + MISS, c[1], c[2]) for c in (rows.get((j - 1, i)), rows.get((j, i - 1))) if c]
                top = max(options)
                if top[0] > 0:
                    rows[j, i] = top
                    if own[i][0] == w[j] and top[1] >= coverage * len(w) - 1e-9:
                        found.add((k, i, top))
    best: dict[tuple[int, int], tuple] = {}
    for k, i, top in found:
        best[k, i] = max(best.get((k, i), (0, 0, 0)), top)
    spans = sorted(((-m, k, x, i + 1) for (k, i), (_, m, x) in best.items()))
    kept: list[tuple] = []
    for r in spans:
        if all(r[3] <= q[2] or q[3] <= r[2] for q in kept):
            kept.append(r)
    names = list(templates)
    return sorted([(names[k], own[x][1], own[y - 1][2], -m) for m, k, x, y in kept], key=lambda r: r[1])
