"""License scans: a trained paragraph classifier over word n-grams, with template comparison.

Paragraphs are runs of lines up to one without words; they are cut into overlapping segments of a few
words, which go on over line ends, so a wrapped notice reads like one on a line. A multinomial logistic
regression over hashed word unigrams and bigrams (sparse) gives each segment a weight for every licence
family and for the class `unknown`. It is trained on notices made from the templates below, embedded in
ordinary words, against a bounded sample of corpus segments (`max_segments`) as unknown. Each family is
judged by its odds against `unknown`, so a segment may hold several; the odds needed are calibrated on
segments held out from the fit, so that at most `false_rate` of the ordinary ones would pass (within `threshold_range`, as
templates confirm what passes). A
prediction counts once a template of that family confirms it: enough of the template's word trigrams
stand in the segment, or, for long templates, enough of the segment's in the template.

One pass over all segments of all texts; null and empty texts have none. Repeated rows are scanned
one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import with_struct
from .wordhash import LOWERED, U, mix, row_ranges, runs, span_hashes, utf8

#: Notices and paragraphs of well-known licences, by family.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership.",
        "The ASF licenses this file to You under the Apache License, Version 2.0",
        "Apache License Version 2.0, January 2004",
        "Apache License 2.0",
        "Apache Software License",
        "License: Apache",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "boost": (
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software",
        "Boost Software License - Version 1.0 - August 17th, 2003",
        "Boost Software License",
        "SPDX-License-Identifier: BSL-1.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "BSD 3-Clause License",
        "BSD 2-Clause License",
        "License: BSD",
        "BSD License",
        "Released under the BSD License", "Licensed under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "cc": (
        "Licensed under CC BY-NC 4.0", "Licensed under CC BY 4.0", "Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
        "Attribution-NonCommercial-NoDerivatives 4.0 International",
        "CC BY-SA", "CC BY-NC",
        "Creative Commons Attribution",
        "Creative Commons License",
        "This work is licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/",
    ),
    "epl": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
        "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE",
        "Eclipse Public License",
        "Licensed under the Eclipse Public License", "SPDX-License-Identifier: EPL-2.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "GNU General Public License",
        "Affero General Public License",
        "GNU GPL",
        "License: GPL",
        "License: GPLv2",
        "License: GPLv3",
        "under the GPL",
        "Released under the GNU GPL v3", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
        "ISC License",
        "License: ISC",
        "Released under the ISC License", "SPDX-License-Identifier: ISC",
    ),
    "lgpl": (
        "licensed under the GNU Lesser General Public License",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, see",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        "Lesser General Public License",
        "Library General Public License",
        "License: LGPL",
        "GNU LGPL",
        "SPDX-License-Identifier: LGPL-2.1-or-later", "SPDX-License-Identifier: LGPL-3.0-only",
    ),
    "mit": (
        "Released under the MIT License", "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "The MIT License (MIT)",
        "MIT License Copyright (c)",
        "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file.",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE",
        "MIT License",
        "License: MIT",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": (
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/",
        "Mozilla Public License", "License: MPL",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", "Licensed under the Mozilla Public License 2.0", "SPDX-License-Identifier: MPL-2.0",
    ),
    "public_domain": (
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law",
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
        "CC0 1.0 Universal", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
        "This work is released into the public domain", "This is free and unencumbered software released into the public domain", "dedicated to the public domain under CC0 1.0", "SPDX-License-Identifier: CC0-1.0", "SPDX-License-Identifier: Unlicense",
    ),
    "reserved": ("All rights reserved",),
    "zlib": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "The zlib License",
        "zlib/libpng license",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", "SPDX-License-Identifier: Zlib",
    ),
}
FAMILIES = ("unknown", *sorted(TEMPLATES))
KEPT = np.zeros(256, bool)
KEPT[48:58] = KEPT[65:91] = KEPT[97:123] = KEPT[128:] = True
HIT = T.StructType([T.StructField("family", T.StringType()), T.StructField("line_no", T.LongType()), T.StructField("probability", T.DoubleType()), T.StructField("overlap", T.DoubleType())])
FIELDS = T.StructType([T.StructField("n_segments", T.LongType()), T.StructField("hits", T.ArrayType(HIT))])


@dataclass(frozen=True)
class LicenseSettings:
    buckets: int = 1 << 14
    segment_words: int = 24
    stride: int = 12
    max_segments: int = 10_000
    copies: int = 240
    epochs: int = 60
    rate: float = 0.5
    decay: float = 1e-5
    false_rate: float = 5e-3
    threshold_range: tuple[float, float] = (0.02, 0.95)
    overlap: float = 0.6
    least_trigrams: int = 6
    seed: int = 3


@dataclass
class Segments:
    """Word hashes of segments: words[first[i]:last[i]] are those of segment i, which begins in row[i], line line[i]."""

    words: np.ndarray
    first: np.ndarray
    last: np.ndarray
    row: np.ndarray
    line: np.ndarray
    line_at: np.ndarray | None = None  # the first word of each line, and the line's number
    number: np.ndarray | None = None

    def line_of(self, word: int) -> int:
        return int(self.number[np.searchsorted(self.line_at, word, "right") - 1])


def segments(data: np.ndarray, offsets: np.ndarray, s: LicenseSettings) -> Segments:
    a, b = runs(data != 10, offsets)
    starts, ends = runs(KEPT[data], offsets)
    lo, hi = np.searchsorted(starts, a), np.searchsorted(starts, b)
    row = np.searchsorted(offsets, a, "right") - 1
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    number = breaks[a] - breaks[offsets[row]]
    held = hi > lo
    lo, hi, row, number = lo[held], hi[held], row[held], number[held]
    opens = np.ones(len(lo), bool)  # a paragraph goes on while the next line has words
    opens[1:] = (row[1:] != row[:-1]) | (number[1:] != number[:-1] + 1)
    first_line = np.flatnonzero(opens)
    begin, end = lo[first_line], hi[np.append(first_line[1:], len(lo)) - 1] if len(lo) else hi
    n = np.maximum(1, -(-(end - begin - (s.segment_words - s.stride)) // s.stride))
    of = np.repeat(np.arange(len(begin)), n)
    first = begin[of] + (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)) * s.stride
    line = np.searchsorted(lo, first, "right") - 1
    return Segments(span_hashes(data, starts, ends, LOWERED), first, np.minimum(first + s.segment_words, end[of]), row[line], number[line], lo, number)


def features(x: Segments, s: LicenseSettings) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, first): the hashed unigrams and bigrams of segment i are buckets[first[i]:first[i+1]]."""
    uni = (x.words % U(s.buckets)).astype(np.int64)
    after = np.append(x.words[1:], U(0)) if len(x.words) else x.words
    bi = (mix(x.words * U(5) + after) % U(s.buckets)).astype(np.int64)
    n = x.last - x.first
    at = np.repeat(x.first, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    ends = np.zeros(len(at), bool)
    ends[np.cumsum(n) - 1] = True  # the last word of a segment starts no bigram
    out = np.stack([uni[at], np.where(ends, -1, bi[at])], 1).ravel()
    return out, np.concatenate([[0], np.cumsum(2 * n)])


class LicenseModel:
    def __init__(self, weights: np.ndarray, bias: np.ndarray, threshold: float, settings: LicenseSettings) -> None:
        self.weights, self.bias, self.threshold, self.settings = weights, bias, threshold, settings
        # a template of two words is compared by its pair
        self.templates = [(f, min(len(w), 3), np.unique(grams(w, min(len(w), 3)))) for f in FAMILIES[1:] for text in TEMPLATES[f] if len(w := _hashed(text)) > 1]

    def odds(self, x: Segments) -> np.ndarray:
        """For each segment and family the probability against `unknown` alone."""
        out = [np.zeros((0, len(FAMILIES) - 1))]
        for lo in range(0, len(x.first), 20_000):
            part = Segments(x.words, x.first[lo : lo + 20_000], x.last[lo : lo + 20_000], x.row, x.line)
            z = _scores(self.weights, self.bias, *features(part, self.settings))
            out.append(1 / (1 + np.exp(np.clip(z[:, :1] - z[:, 1:], -500, 500))))
        return np.concatenate(out)

    def confirmed(self, words: np.ndarray, family: str) -> tuple[float, np.ndarray]:
        """The largest share of a template of the family whose trigrams stand in the segment, or of the
        segment's trigrams, if it has several, that stand in a template; and where those of all templates begin that
        share `overlap` or more."""
        held = {k: grams(words, k) for k in (2, 3)}
        n, best, where = len(np.unique(held[3])), 0.0, np.zeros(0, np.int64)
        for f, k, t in self.templates:
            if f == family and len(held[k]):
                shared = np.isin(t, held[k]).sum()
                share = max(shared / len(t), shared / n if shared >= self.settings.least_trigrams else 0.0)
                best = max(best, float(share))
                if share >= self.settings.overlap:
                    where = np.union1d(where, np.flatnonzero(np.isin(held[k], t)))
        return best, where


def _hashed(text: str) -> np.ndarray:
    data, offsets = utf8(pa.array([text]))
    starts, ends = runs(KEPT[data], offsets)
    return span_hashes(data, starts, ends, LOWERED)


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of two or three words, in order."""
    if len(words) < k:
        return words[:0]
    if k == 2:
        return mix(words[:-1] * U(7) + mix(words[1:] + U(1)))
    return mix(words[:-2] * U(9) + mix(words[1:-1]) * U(3) + mix(mix(words[2:])))


def _scores(weights: np.ndarray, bias: np.ndarray, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
    if len(first) < 2:
        return np.zeros((0, len(bias)))
    n = np.diff(first)[:, None]
    return np.add.reduceat(weights[buckets], first[:-1], axis=0) / np.sqrt(n) + bias


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True)) if len(z) else z
    return p / p.sum(1, keepdims=True) if len(z) else z


def fit_licenses(df: DataFrame, text: str = "text", settings: LicenseSettings | None = None) -> LicenseModel:
    """Trains on the templates and a bounded sample of the corpus's segments: of those whose hash is low,
    the first max_segments."""
    s = settings or LicenseSettings()
    # so many of 2**64 hash values that about four times the sample is found, however large the corpus
    chars = df.agg(F.sum(F.length(text))).first()[0] or 0
    below = min(1.0, 4 * s.max_segments * 6 * s.stride / max(1, chars))

    def sampled(batches):
        for b in batches:
            data, offsets = utf8(b.column(0))
            for lo, hi in row_ranges(offsets):
                x = segments(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], s)
                rank = mix(x.words[x.first] ^ mix(x.words[x.last - 1]) + (x.last - x.first).astype(np.uint64)) if len(x.first) else x.words
                pick = np.flatnonzero(rank <= U(int(below * (2**64 - 1025))))
                yield pa.RecordBatch.from_arrays([pa.array(rank[pick].view(np.int64)), pa.array([x.words[i:j].tobytes() for i, j in zip(x.first[pick].tolist(), x.last[pick].tolist(), strict=True)], pa.binary())], names=["rank", "words"])

    rows = df.select(F.col(text).cast("string").alias("text")).mapInArrow(sampled, "rank long, words binary").orderBy("rank", "words").limit(s.max_segments).toArrow()
    return train([np.frombuffer(x, np.uint64) for x in rows.column("words").to_pylist()], s)


def train(ordinary: list[np.ndarray], s: LicenseSettings) -> LicenseModel:
    rng = np.random.default_rng(s.seed)
    known = LicenseModel(np.zeros((s.buckets + 1, len(FAMILIES))), np.zeros(len(FAMILIES)), 0.5, s)
    every = np.unique(np.concatenate([t for *_, t in known.templates]))
    plain = [w for w in ordinary if not any(np.isin(grams(w, k), every).any() for k in (2, 3))]  # licence notices of the corpus itself aren't `unknown`
    made, labels = [], []
    for i, family in enumerate(FAMILIES[1:], 1):
        for text in TEMPLATES[family]:
            whole = _hashed(text)
            for _ in range(-(-s.copies // len(TEMPLATES[family]))):  # about as many of each family
                cut = rng.integers(0, max(1, len(whole) - s.segment_words + 1))  # of a long one, what a segment holds
                base = whole[cut : cut + s.segment_words]
                kept = base if len(base) < 6 else base[rng.random(len(base)) > rng.uniform(0, 0.15)]
                room = max(0, s.segment_words - len(kept))
                filler = plain[rng.integers(len(plain))] if plain else base[:0]
                filler = filler[: rng.integers(0, room + 1)]
                cut = rng.integers(0, len(filler) + 1)
                made.append(np.concatenate([filler[:cut], kept, filler[cut:]])[: s.segment_words])
                labels.append(i)
    half = len(plain) // 2
    fit, held = made + plain[:half], plain[half:]
    y = np.array(labels + [0] * half)
    weights, bias = fit_sparse(*features(_stack(fit), s), y, s)
    model = LicenseModel(weights, bias, 0.5, s)
    if held:
        model.threshold = float(np.clip(np.quantile(model.odds(_stack(held)).max(1), 1 - s.false_rate), *s.threshold_range))
    return model


def fit_sparse(buckets: np.ndarray, first: np.ndarray, y: np.ndarray, s: LicenseSettings) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases by adaptive gradient steps; only the buckets that occur are touched."""
    n = len(FAMILIES)
    used, at = np.unique(buckets, return_inverse=True)
    row, size = np.repeat(np.arange(len(y)), np.diff(first)), np.sqrt(np.diff(first))
    order = np.argsort(at, kind="stable")
    begins, rows = np.searchsorted(at[order], np.arange(len(used))), row[order]
    w, bias = np.zeros((len(used), n), np.float32), np.zeros(n)
    squares, bias_squares = np.full_like(w, 1e-8), np.full_like(bias, 1e-8)
    share = np.bincount(y, minlength=n).clip(1)
    each, truth = (len(y) / n / share)[y] / len(y), np.eye(n)[y]
    for _ in range(s.epochs):
        z = np.add.reduceat(w[at], first[:-1], axis=0) / size[:, None] + bias
        d = (_softmax(z) - truth) * each[:, None]
        g = np.add.reduceat((d / size[:, None]).astype(np.float32)[rows], begins, axis=0) + s.decay * w
        g[used < 0] = 0  # the bucket of no bigram
        squares += g * g
        w -= s.rate * g / np.sqrt(squares)
        bias_squares += d.sum(0) ** 2
        bias -= s.rate * d.sum(0) / np.sqrt(bias_squares)
    weights = np.zeros((s.buckets + 1, n))
    weights[used] = w
    return weights, bias


def _stack(parts: list[np.ndarray]) -> Segments:
    first = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
    return Segments(np.concatenate(parts) if parts else np.zeros(0, np.uint64), first[:-1], first[1:], np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64))


def claimed(seen: list[tuple]) -> dict[tuple[str, int], tuple[float, float]]:
    """(overlap, probability) by family and line, from the confirmed (family, line, overlap, probability, places) of a text.
    Licences quote each other: of families that match the same places, the one with most places in the text has them."""
    places: dict[str, set[int]] = {}
    for family, *_, where in seen:
        places.setdefault(family, set()).update(where)
    out, taken = {}, set()
    for family in sorted(places, key=lambda f: (-len(places[f]), f)):
        for _, line, overlap, probability, where in (x for x in seen if x[0] == family):
            if 2 * len(where & taken) < len(where):
                out[family, line] = max((overlap, probability), out.get((family, line), (0.0, 0.0)))
        taken |= places[family]
    return out


def scan_licenses(df: DataFrame, model: LicenseModel, text: str = "text", out: str = "licenses") -> DataFrame:
    """df with a struct column: the number of segments, and the confirmed notices, the best one of a
    family at the line of its first matching words; probability is that against `unknown`."""
    s = model.settings
    kind = pa.list_(pa.struct([("family", pa.string()), ("line_no", pa.int64()), ("probability", pa.float64()), ("overlap", pa.float64())]))

    def scanned(column: pa.Array) -> pa.Array:
        data, offsets = utf8(column)
        counts, hits = [np.zeros(0, np.int64)], []
        for lo, hi in row_ranges(offsets):
            x = segments(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], s)
            p = model.odds(x)
            seen: list[list[tuple]] = [[] for _ in range(hi - lo)]
            for i, k in zip(*(c.tolist() for c in np.nonzero(p >= model.threshold)), strict=True):
                overlap, where = model.confirmed(x.words[x.first[i] : x.last[i]], FAMILIES[k + 1])
                if overlap >= s.overlap:
                    seen[x.row[i]].append((FAMILIES[k + 1], x.line_of(x.first[i] + where[0]), overlap, float(p[i, k]), set((x.first[i] + where).tolist())))
            found = [claimed(row) for row in seen]
            counts.append(np.bincount(x.row, minlength=hi - lo))
            hits += [[{"family": f, "line_no": n, "probability": q, "overlap": o} for (f, n), (o, q) in sorted(d.items(), key=lambda e: (e[0][1], e[0][0]))] for d in found]
        return pa.StructArray.from_arrays([pa.array(np.concatenate(counts)), pa.array(hits, kind)], names=["n_segments", "hits"])

    return with_struct(df, text, out, FIELDS, scanned)
