"""The quality classifier, the language model and the licence classifier."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import AWKWARD
from pyspark.sql import functions as F

from nitraflow.llm import hmm_lm, license_scan, mil_quality
from nitraflow.llm.frames import hash_part
from nitraflow.llm.wordhash import mix, utf8

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def test_quality_is_learned_and_holds_on_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    part = hash_part("doc_id", 3) == 1
    model = mil_quality.fit_quality(docs, labels.where(~part))
    scored = mil_quality.score_quality(docs.where(part), model, out="mil").join(labels, "doc_id").select("mil.score", "quality").collect()
    assert np.mean([(r["score"] >= 0.5) == (r["quality"] == 1) for r in scored]) > 0.95
    again = mil_quality.fit_quality(docs.repartition(5), labels.where(~part))
    assert all(np.allclose(model.w[k], again.w[k]) for k in model.w)


def test_quality_gradient_is_the_derivative():
    rng = np.random.default_rng(0)
    settings = mil_quality.MilSettings(hidden=4, gate=3)
    model = mil_quality.train([], np.zeros(0), settings)
    model.w = {k: v + rng.normal(0, 0.3, np.shape(v)) for k, v in model.w.items()}
    x, first, y = rng.normal(0, 1, (7, mil_quality.WIDTH)), np.array([0, 3, 4, 7]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = model.forward(x, first)["y"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    g = model.gradient(x, first, y)
    for k in g:
        at = tuple(rng.integers(0, n) for n in np.shape(model.w[k]))
        old = model.w[k][at] if at else float(model.w[k])
        ends = []
        for step in (1e-5, -1e-5):
            model.w[k] = np.array(model.w[k], float)
            model.w[k][at] = old + step
            ends.append(loss())
        model.w[k][at] = old
        assert abs((ends[0] - ends[1]) / 2e-5 - g[k][at]) < 1e-5


def test_quality_takes_anything(docs_of, spark):
    model = mil_quality.fit_quality(docs_of(AWKWARD), spark.createDataFrame([], "doc_id long, quality int"))
    scores = [r["score"] for r in mil_quality.score_quality(docs_of(AWKWARD), model).select("quality.score").collect()]
    assert len(scores) == len(AWKWARD) and all(s == 0.5 for s in scores)


def lm_rows(df, **settings):
    part = hash_part("doc_id", 5) == 1
    return hmm_lm.hmm_scores(df, ~part, settings=hmm_lm.HmmSettings(**settings)).collect()


def test_base_scores_equal_brute_force(sample_docs, docs_of):
    for df in (sample_docs, docs_of(AWKWARD)):
        tokens = {r["doc_id"]: [*WORD.findall((r["text"] or "").translate(LOWER)), None] for r in df.collect()}
        counts = Counter()
        for i, t in tokens.items():
            if zlib.crc32(str(i).encode()) % 5 != 1:
                counts.update(t)
        n, v = sum(counts.values()), len(counts)
        for r in lm_rows(df, heavy=50, own_classes=20, rounds=1):
            t = tokens[r["doc_id"]]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(counts[w] > 0 for w in t), n)
            assert abs(r["base_score"] - sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) <= 1e-9 * len(t) * 10
            assert r["score"] < 0


def test_forward_is_the_exact_likelihood_and_rounds_raise_it():
    rng = np.random.default_rng(2)
    s = hmm_lm.HmmSettings(states=3, segment=8, cells=40)
    sequences = [rng.integers(0, 5, n).astype(np.uint16) for n in (1, 2, 7, 8, 9, 40, 5000)]
    model = hmm_lm.HmmModel.start(np.bincount(np.concatenate(sequences), minlength=5).astype(float), [], s)

    def plain(x):
        a, log = model.first * model.emit[x[0]], 0.0
        for c in x[1:].tolist():
            log, a = log + np.log10(a.sum()), a / a.sum()
            a = (a @ model.step) * model.emit[c]
        return log + np.log10(a.sum())

    assert np.allclose(model.log10(sequences), [plain(x) for x in sequences])
    before = model.log10(sequences).sum()
    for _ in range(3):
        model = hmm_lm.HmmModel.estimated(model.counts(sequences, s), 5, s)
        after = model.log10(sequences).sum()
        assert after >= before - 0.05
        before = after


@pytest.mark.parametrize("segment", [1, 2, 3, 16])
def test_expected_counts_equal_enumeration(segment):
    """Over all paths, with cuts after each symbol, within the sequences and none at all."""
    s = hmm_lm.HmmSettings(states=2, segment=segment)
    model = hmm_lm.HmmModel(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), np.array([[0.5, 0.1], [0.3, 0.2], [0.2, 0.7]]))
    sequences = [np.array(x, np.uint16) for x in ([0, 2, 1, 1, 0, 2, 2], [1], [2, 0], [0, 1, 2, 0])]
    want = np.zeros(2 + 4 + 6)
    for x in sequences:
        first, step, emit, total = np.zeros(2), np.zeros((2, 2)), np.zeros((3, 2)), 0.0
        for path in np.ndindex(*[2] * len(x)):
            p = model.first[path[0]] * model.emit[x[0], path[0]]
            for t in range(1, len(x)):
                p *= model.step[path[t - 1], path[t]] * model.emit[x[t], path[t]]
            total += p
            first[path[0]] += p
            for t in range(len(x)):
                emit[x[t], path[t]] += p
                if t:
                    step[path[t - 1], path[t]] += p
        want += np.concatenate([first, step.ravel(), emit.ravel()]) / total
    assert np.allclose(model.counts(sequences, s), want, atol=1e-4)


def test_language_model_beats_the_base_on_held_out_documents(spark):
    rows = [r for r in lm_rows(spark.read.parquet(f"{SF}/documents.parquet")) if not r["train"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_language_model_takes_no_training_rows(docs_of):
    rows = hmm_lm.hmm_scores(docs_of(["a b", None]), F.lit(False)).collect()
    assert [(r["n_tokens"], r["n_known"], r["base_score"]) for r in sorted(rows, key=lambda r: r["doc_id"])] == [(3, 0, 0.0), (1, 0, 0.0)]
    assert hmm_lm.hmm_scores(docs_of(["a"]).limit(0), F.lit(True)).count() == 0


def test_licences_are_found_and_nothing_else(spark, docs_of):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = license_scan.fit_licenses(docs)
    cues = {"gpl": "GNU General Public License, version 3", "cc": "Licensed under CC BY-NC 4.0", "mit": "Released under the MIT License", "apache": "Licensed under the Apache License", "reserved": "All rights reserved"}
    for r in license_scan.scan_licenses(docs, model).select("text", "licenses.hits").collect():
        assert {h["family"] for h in r["hits"]} == {f for f, c in cues.items() if c in r["text"]}
    texts = ["Intro line\nthis text is licensed under the mit license, enjoy", "the license plate was reserved for the public", "This work is released into the public domain."]
    hits = [[(h["family"], h["line_no"]) for h in r["hits"]] for r in license_scan.scan_licenses(docs_of(texts), model).orderBy("doc_id").select("licenses.hits").collect()]
    assert hits == [[("mit", 1)], [], [("public_domain", 0)]]
    assert all(not r["hits"] for r in license_scan.scan_licenses(docs_of(AWKWARD), model).select("licenses.hits").collect())


#: Notices as files carry them, wrapped, quoted, commented or shortened, many of them templates word for word.
NOTICES = {
    "/*\n * Permission is hereby granted, free of charge, to any person obtaining\n * a copy of this software and associated documentation files, to deal in the Software\n */": {"mit"},
    "This program is free software; you can redistribute it and/or\nmodify it under the terms of the GNU General Public License\nas published by the Free Software Foundation; either version 2\nof the License, or (at your option) any later version.": {"gpl"},
    "Permission to use, copy, modify, and distribute this software for any\npurpose with or without fee is hereby granted": {"isc"},
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND': {"mit"},
    "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0": {"epl", "reserved"},
    "Distributed under the Boost Software License, Version 1.0.\n(See accompanying file LICENSE_1_0.txt)": {"boost"},
    "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:": {"bsd"},
    "# SPDX-License-Identifier: LGPL-2.1": {"lgpl"},
    "Released under the MIT License. All rights reserved.": {"mit", "reserved"},
    "Licensed under the Apache\nLicense, Version 2.0": {"apache"},
    "This work is\n\nreleased into the public domain.": set(),
    "the software he wrote was provided without charge to any person who asked": set(),
    "rights of way are reserved for all pedestrians in the public park": set(),
    "Permission was granted to the council to use the field for any purpose, with or without a fee": set(),
}


def test_wrapped_and_unseen_notices(spark, docs_of):
    model = license_scan.fit_licenses(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = license_scan.scan_licenses(docs_of(list(NOTICES) * 2), model).orderBy("doc_id").select("licenses.hits").collect()
    assert [{h["family"] for h in r["hits"]} for r in rows] == list(NOTICES.values()) * 2


#: Notices and lines that no template holds as they stand: other versions, names, endings and short forms, licences without a
#: family, and plain prose.
UNSEEN = [
    ('// Use of this source code is governed by a BSD-style\n// license that can be found in the file LICENSE.md.', {'bsd'}),
    ('Use of this source code is governed by an MIT-style\nlicense that can be found in the LICENSE file or at https://opensource.org/licenses/MIT.', {'mit'}),
    ('MIT License\n\nCopyright (c) 2019 A. Person', {'mit'}),
    ('License: GPLv2 or later', {'gpl'}),
    ('License: MIT (see the end of this file)', {'mit'}),
    ('Distributed under GNU GPL version 2', {'gpl'}),
    ('Licensed to the Apache Software Foundation (ASF) under one\nor more contributor license agreements.  See the NOTICE file\ndistributed with this work for additional information', {'apache'}),
    ('The contents of this file are subject to the Mozilla Public License\nVersion 1.1 (the "License"); you may not use this file except in\ncompliance with the License.', {'mpl'}),
    ('This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.', {'cc'}),
    ('Text is available under the Creative Commons Attribution-ShareAlike License', {'cc'}),
    ('Except where otherwise noted, content on this site is licensed under a Creative Commons Attribution 4.0 International license', {'cc'}),
    ('To the extent possible under law, the author(s) have dedicated all copyright\nand related and neighboring rights to this software to the public domain\nworldwide.', {'public_domain'}),
    ('THIS SOFTWARE IS PROVIDED BY THE REGENTS AND CONTRIBUTORS "AS IS" AND\nANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE\nIMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE\nARE DISCLAIMED.', {'bsd'}),
    ('GNU AFFERO GENERAL PUBLIC LICENSE\n   Version 3', {'gpl'}),
    ('ISC License (ISC)\n\nCopyright 2020', {'isc'}),
    ('                    GNU GENERAL PUBLIC LICENSE\n                       Version 1, February 1989', {'gpl'}),
    ('this file is part of a library under the terms of the GNU Lesser General Public License version 3', {'lgpl'}),
    ('SPDX-License-Identifier: GPL-2.0', {'gpl'}),
    ('Code released under the Apache 2.0 license; see Apache License 2.0', {'apache'}),
    ('Boost Software License - Version 1.0', {'boost'}),
    ('Eclipse Public License - v 1.0', {'epl'}),
    ('This Source Code Form is subject to the terms of the Mozilla\nPublic License, v. 2.0.', {'mpl'}),
    ('You are free to: Share, copy and redistribute the material. Creative Commons Attribution 3.0', {'cc'}),
    ('Neither the name of Google Inc. nor the names of its\ncontributors may be used to endorse or promote products derived from\nthis software without specific prior written permission.', {'bsd'}),
    ('Permission to use, copy, modify, and/or distribute this software for any purpose', {'isc'}),
    ('dual licensed under the MIT license and the GNU GPL', {'mit', 'gpl'}),
    ('This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License', {'gpl'}),
    ('COMMON DEVELOPMENT AND DISTRIBUTION LICENSE Version 1.0', set()),
    ('SIL OPEN FONT LICENSE Version 1.1 - 26 February 2007', set()),
    ('DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE', set()),
    ('he renewed his driving license in public', set()),
    ('the general public was invited to the apache museum', set()),
    ('a creative man with common sense and attribution to no one', set()),
    ('software is provided to schools free of charge by the city', set()),
    ('License plates are made of steel', set()),
    # these were written after the first templates; two of them (a second CC form, an LGPL sentence) led to more
    ('Copyright 2021 The Authors. Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.', {'apache'}),
    ('Released under the 3-clause BSD license, see COPYING', {'bsd'}),
    ('Permission is hereby granted, without written agreement and without license or royalty fees', set()),
    ('@license MIT, 2020', {'mit'}),
    ('This is free software, released under the terms of the GNU GPL, version 2 or later.', {'gpl'}),
    ('Photos: CC BY-SA 3.0, Wikimedia Commons', {'cc'}),
    ('You should have received a copy of the GNU Lesser General Public License along with this library', {'lgpl'}),
    ('Altered source versions must be plainly marked as such. Permission is granted to anyone to use this software for any purpose', {'zlib'}),
    ('No Copyright: the person has waived all rights under CC0 1.0 Universal Public Domain Dedication', {'public_domain'}),
    ('Copyright (c) 1998 by the author. All Rights Reserved.', {'reserved'}),
]


def test_notices_that_are_no_templates(spark, docs_of):
    """At least nine in ten of the notices get their families, and no text gets a family that isn't its own."""
    model = license_scan.fit_licenses(spark.read.parquet(f"{SF}/documents.parquet"))
    plain = {" ".join(re.findall(r"[0-9a-z]+", t.lower())) for held in license_scan.TEMPLATES.values() for t in held}
    assert not any(" ".join(re.findall(r"[0-9a-z]+", t.lower())) in plain for t, _ in UNSEEN)
    rows = license_scan.scan_licenses(docs_of([t for t, _ in UNSEEN]), model).orderBy("doc_id").select("licenses.hits").collect()
    found = [{h["family"] for h in r["hits"]} for r in rows]
    assert all(got <= want for got, (_, want) in zip(found, UNSEEN, strict=True))
    notices = [got == want for got, (_, want) in zip(found, UNSEEN, strict=True) if want]
    assert sum(notices) >= 0.9 * len(notices)


def test_calibration_moves_the_threshold():
    """More of the ordinary segments may pass: less odds are needed."""
    rng = np.random.default_rng(2)
    ordinary = [mix(rng.integers(0, 400, 24).astype(np.uint64)) for _ in range(600)]
    at = [license_scan.train(ordinary, license_scan.LicenseSettings(epochs=15, copies=20, false_rate=r, threshold_range=(0.0, 1.0))).threshold for r in (0.001, 0.1, 0.5)]
    assert at[0] > at[1] > at[2]


def test_confirmed_and_claimed_by_brute_force():
    """Overlaps and places against plain word lists; of families that match the same places the one with most has them."""
    model = license_scan.LicenseModel(np.zeros((2**14 + 1, len(license_scan.FAMILIES))), np.zeros(len(license_scan.FAMILIES)), 0.5, license_scan.LicenseSettings())
    split = lambda t: re.findall(r"[0-9a-z]+", t.lower())
    texts = [t for t, _ in UNSEEN] + [t[:150] for held in license_scan.TEMPLATES.values() for t in held]
    seen = []
    for text in texts:
        w = split(text)
        runs = {k: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] for k in (2, 3)}
        for family, templates in license_scan.TEMPLATES.items():
            best, where = 0.0, set()
            for t in map(split, templates):
                k = min(len(t), 3)
                if len(t) > 1 and runs[k]:
                    own = {tuple(t[i : i + k]) for i in range(len(t) - k + 1)}
                    shared = len(own & set(runs[k]))
                    share = max(shared / len(own), shared / len(set(runs[3])) if shared >= 6 else 0.0)
                    best = max(best, share)
                    where |= {i for i, g in enumerate(runs[k]) if g in own} if share >= 0.6 else set()
            got, places = model.confirmed(license_scan._hashed(text), family)
            assert got == pytest.approx(best) and set(places.tolist()) == where, (text, family)
            if best >= 0.6:
                seen.append((family, len(seen), best, 0.9, where))
    few = [("a", 0, 0.7, 0.9, {1, 2, 3}), ("b", 0, 0.9, 0.9, {2, 3}), ("b", 5, 0.8, 0.9, {9}), ("c", 7, 0.8, 0.9, {20, 21})]
    assert license_scan.claimed(few) == {("a", 0): (0.7, 0.9), ("b", 5): (0.8, 0.9), ("c", 7): (0.8, 0.9)} and len(seen) > 60


def test_licence_odds_equal_a_plain_sum():
    s = license_scan.LicenseSettings(buckets=64, segment_words=5, stride=3)
    rng = np.random.default_rng(6)
    n = len(license_scan.FAMILIES)
    model = license_scan.LicenseModel(rng.normal(size=(65, n)), rng.normal(size=n), 0.5, s)
    data, offsets = utf8(pa.array(["one two three four five six seven\neight nine\n\nten", None, "one"]))
    x = license_scan.segments(data, offsets, s)
    assert [(r, line, b - a) for r, line, a, b in zip(x.row, x.line, x.first, x.last, strict=True)] == [(0, 0, 5), (0, 0, 5), (0, 0, 3), (0, 3, 1), (2, 0, 1)]
    model.weights[-1] = 0
    for i, got in enumerate(model.odds(x)):
        words = [int(w) for w in x.words[x.first[i] : x.last[i]]]
        keys = [w % 64 for w in words] + [int(mix(np.array([a], np.uint64) * np.uint64(5) + np.uint64(b))[0]) % 64 for a, b in zip(words, words[1:])]
        z = sum(model.weights[k] for k in keys) / np.sqrt(2 * len(words)) + model.bias
        assert np.allclose(got, 1 / (1 + np.exp(z[0] - z[1:])))


def test_licences_fit_without_a_corpus(docs_of):
    model = license_scan.fit_licenses(docs_of(["a"]).limit(0))
    assert license_scan.scan_licenses(docs_of(["All rights reserved"]), model).count() == 1
