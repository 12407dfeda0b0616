"""Language, quality, fingerprints, licences and the pipeline."""

import base64
import hashlib
import random
import sys
import textwrap
import zlib

import duckdb
import numpy as np
import pytest
from conftest import MID_SF, SMALL_SF
from pyspark.sql import functions as F

import corpus_pipeline
from skyledger.llm import chunk_prints, language, licenses, quality, queries
from skyledger.plans.compare import compare, duck_connect


# --- language -----------------------------------------------------------------------------

def test_language_on_held_out_rows(spark):
    rows = queries.QUERIES["op10_language_id"](spark, MID_SF).collect()
    docs = {d: (t, g) for d, t, g in duckdb.sql(f"SELECT doc_id, text, lang FROM '{MID_SF}/documents.parquet'").fetchall()}
    assert len(rows) == len(docs)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {d for d in docs if zlib.crc32(str(d).encode()) % 4 == 2}
    right = [r.lang_pred == docs[r.doc_id][1] for r in held if language.has_letter(docs[r.doc_id][0])]
    assert np.mean(right) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_texts(spark, docs, no_docs):
    train = spark.createDataFrame([(1, "der die das und ich", "de"), (2, "the and of you are", "en"), (3, None, "fr"),
                                   (4, "nichts", None), (None, "el la los", "es")], "doc_id long, text string, lang string")
    model = language.fit(train)
    assert model.languages == ["de", "en"]
    found = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert found[0].lang_pred == found[1].lang_pred == found[2].lang_pred == "und" and found[0].score == 0
    assert language.classify("12 34 !?", model) == ("und", 0.0)
    assert language.classify("日本", model)[0] in ("de", "en")
    assert language.identify(no_docs, model).collect() == []
    nothing = language.fit(train.where("false"))
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}
    kept = language.keep_identified(docs, model)
    assert kept.columns == docs.columns and not {0, 1, 2} & {r.doc_id for r in kept.collect()}


def test_languages_never_learned_are_rejected(spark):
    table = spark.read.parquet(f"{MID_SF}/documents.parquet")
    model = language.fit(language.training_rows(table))
    foreign = ["日本語の文章はここにあります。これは学習されていない言語です。", "这是一个没有学过的语言的句子。", "xkqz wvbn qqqq zzxx jkjk pwpw mnbv xcvb",
               "Это предложение на русском языке, которого модель не знает.", "To jest zdanie w języku polskim, którego model nie zna."]
    assert all(score >= 0.5 for _, score in language.classify_batch(foreign, model))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(foreign * 2)], "doc_id long, text string")
    assert language.keep_identified(docs, model).collect() == []
    held = table.subtract(language.training_rows(table)).where("text RLIKE '[A-Za-z]'")
    n = held.count()
    assert language.keep_identified(held, model).count() >= 0.99 * n > 0


def test_slices_change_no_counts(monkeypatch):
    text = "Straße über den Fluss, 12 Äpfel. " * 40
    whole = language.gram_counts(text)
    monkeypatch.setattr(language, "SLICE", 17)
    assert (language.gram_counts(text) == whole).all()


def test_batches_score_as_single_texts(monkeypatch):
    rng = np.random.default_rng(2)
    model = language.LanguageModel(["a", "b", "c"], np.log([0.2, 0.3, 0.5]), np.log(rng.random((language.BUCKETS, 3))))
    texts = [None, "", "12", "short", "Straße über den Fluss. " * 400, "aaaa", "日本語 text"]
    want = language.gram_counts(texts[4]) @ model.log_prob
    for size in (7, 1 << 18):
        monkeypatch.setattr(language, "TABLE_SLICE", size)
        table = list(language.gram_table(texts))
        dense = np.zeros((len(texts), language.BUCKETS), np.int64)
        for row, bucket, count in table:
            np.add.at(dense, (row, bucket), count)
        assert (dense == [language.gram_counts(t or "") for t in texts]).all() and (size > 7) == (len(table) == 1)
        assert np.allclose(language.gram_sums(texts, model.log_prob)[4], want)
        found = language.classify_batch(texts, model)
        assert [f[0] for f in found] == [language.classify(t, model)[0] for t in texts]
        assert found[:3] == [("und", 0.0)] * 3
    assert language.classify_batch([], model) == []


# --- quality --------------------------------------------------------------------------------

def test_quality_on_held_out_rows(spark):
    rows = {r.doc_id: r for r in queries.QUERIES["op6_quality_classifier"](spark, MID_SF).collect()}
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{MID_SF}/labels.parquet'").fetchall()
    held = [(rows[d], q) for d, q in labels if rows[d].held_out]
    assert {d for d, r in rows.items() if r.held_out} == {d for d in rows if zlib.crc32(str(d).encode()) % 5 == 0}
    assert np.mean([r.predicted == q for r, q in held]) > 0.95
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows.values())
    good, bad = ([r.score for r, q in held if q == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def test_pairs_learn_an_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    label = (x[:, 0] - 0.5 * x[:, 1] > -1).astype(int)
    model = quality.fit_pairs(x, label)
    strength = (x - model.mean) / model.scale @ model.weights
    assert ((strength >= model.threshold) == label).mean() > 0.97
    one_kind = quality.fit_pairs(x, np.ones(400))
    assert one_kind.weights.tolist() == [0, 0, 0] and one_kind.threshold < 0


def test_quality_of_odd_texts(spark, docs, no_docs):
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(20)] + [(None, 1), (5, None), (6, 0)],
                                   "doc_id long, quality int")
    model = quality.fit(docs, labels)
    rows = quality.score(docs, model).collect()
    assert len(rows) == docs.count() and all(np.isfinite(r.score) for r in rows)
    assert quality.score(no_docs, model).collect() == []
    none = quality.fit(docs, labels.where("false"))
    assert {r.predicted for r in quality.score(docs, none).collect()} == {1}
    assert quality.keep_good(docs, none).count() == docs.count()


def test_every_labelled_document_teaches(spark, monkeypatch):
    n, seen = 20_500, []
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('word ', id) AS text")
    labels = spark.range(n).selectExpr("id AS doc_id", "int(id % 2) AS quality")
    monkeypatch.setattr(quality, "features", lambda text: [float(len(text))] * len(quality.FEATURES))
    monkeypatch.setattr(quality, "fit_groups", lambda rows, good, bad, cut: seen.append((rows.count(), good, bad)))
    quality.fit(docs, labels)
    assert seen == [(n, n // 2, n // 2)]


@pytest.mark.parametrize("rare", [2, 300])
def test_groups_learn_as_one(spark, rare):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(3000, len(quality.FEATURES))), 1)
    label = (x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=3000) / 3 > -1).astype(int)
    if rare == 2:
        label[:] = 1
        label[:2] = 0
    rows = [(i, r.tolist(), int(k)) for i, (r, k) in enumerate(zip(x, label))]
    table = spark.createDataFrame(rows, "doc_id long, f array<double>, label int")
    whole = quality.fit_pairs(x, label)
    n_good, n_bad = int(label.sum()), int((1 - label).sum())
    one = quality.fit_groups(table, n_good, n_bad)
    assert np.allclose(one.weights, whole.weights) and np.isclose(one.threshold, whole.threshold)
    many = quality.fit_groups(table, n_good, n_bad, group_size=500)
    strength = (x - many.mean) / many.scale @ many.weights
    at = np.quantile(strength, quality.LEVELS)
    lost = [np.mean(strength[label == 1] < a) + np.mean(strength[label == 0] >= a) for a in at]
    below = lambda v: max((s for s in strength[label == 0] if s < v), default=None)
    assert np.isclose(many.threshold, quality._threshold(at, np.array(lost), below))
    if rare > 2:
        assert np.corrcoef(many.weights, whole.weights)[0, 1] > 0.98
    groups = [r["label"] for r in quality._dealt(table, 6, n_good, n_bad).collect()]
    assert len(groups) == 6 and all({0, 1} == set(g) for g in groups)


def test_every_text_of_a_language_counts(spark):
    docs = spark.range(20_200).selectExpr("id AS doc_id", "'ab' AS text", "if(id % 101 = 0, 'b', 'a') AS lang")
    model = language.fit(docs)
    assert np.allclose(np.exp(model.log_prior), [100 / 101, 1 / 101], rtol=1e-12)


def test_an_id_of_many_rows_is_one_example(spark, monkeypatch):
    rows = [(1, f"The same id, row {i}. Nothing else here.") for i in range(300)] + [(i, "A text. It ends.") for i in range(2, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 9)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit_pairs", lambda x, label, cut: seen.append((x, label)))
    quality.fit(docs, labels)
    quality.fit(docs, labels, max_training_docs=5)
    (x, label), (bounded, _) = seen
    assert x.shape == (8, len(quality.FEATURES)) and label.tolist() == [1, 0] * 4 and len(bounded) == 5
    assert np.allclose(x[0], np.mean([quality.features(t) for d, t in rows if d == 1], axis=0))


def test_quality_examples_shuffle_no_text(spark, docs):
    """The join with the labels moves features: a text has become numbers below it."""
    marks = spark.range(40).selectExpr("id AS doc_id", "int(id % 2) AS label").groupBy("doc_id").agg(F.max("label").alias("label"))
    rows = quality._examples(quality.id_text(docs, "doc_id", "text"), marks)
    above, below = rows._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")
    assert "Join" in above and "Join" not in below
    found = {r.doc_id: r for r in rows.collect()}
    texts = {r.doc_id: r.text for r in docs.where("doc_id BETWEEN 0 AND 39 AND doc_id <> 20").collect()}
    assert found.keys() == texts.keys() | {20} and all(r.label == i % 2 for i, r in found.items())
    assert all(np.allclose(found[i].f, quality.features(t)) for i, t in texts.items())


# --- fingerprints ------------------------------------------------------------------------------

def plain_ends(data):
    """Boundaries by rolling the 16-byte gear hash byte by byte."""
    ends, start = [], 0
    h = 0
    for i, b in enumerate(data):
        h = (2 * h + int(chunk_prints._GEAR[b])) & 0xFFFF
        size = i + 1 - start
        bits = chunk_prints.STRICT_BITS if size < chunk_prints.NORMAL_SIZE else chunk_prints.LOOSE_BITS
        if size >= chunk_prints.MIN_SIZE and h >> 16 - bits == 0 or size == chunk_prints.MAX_SIZE or i + 1 == len(data):
            ends.append(i + 1)
            start = i + 1
    return ends


def test_chunks_and_likeness(docs, texts):
    for text in texts:
        data = (text or "").encode()
        assert chunk_prints.chunk_ends(data) == plain_ends(data)
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id, r.text or ""))
    sets = [set(chunk_prints.from_text(chunk_prints.fingerprint(r.text)).tolist()) for r in rows]
    want = []
    for i, r in enumerate(rows):
        text, j = r.text or "", (i + 1) % len(rows)
        cut = len(text) // 4
        edited = text[:len(text) - cut] + (rows[j].text or "")[:cut]
        edited_set = set(chunk_prints.from_text(chunk_prints.fingerprint(edited)).tolist())

        def like(a, b):
            weigh = lambda s: sum(v & 127 for v in s)
            low = min(weigh(a), weigh(b))
            return weigh(a & b) / low if low else float(a == b)

        want.append((str(r.doc_id), len(text), hashlib.sha256(edited.encode()).hexdigest(),
                     chunk_prints.fingerprint(text), chunk_prints.fingerprint(edited),
                     round(like(sets[i], edited_set), 9), round(like(sets[i], sets[j]), 9)))
    got = [(str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9),
            round(r.near_next, 9)) for r in chunk_prints.compare_with_next(docs).collect()]
    assert sorted(got) == sorted(want)


def test_rows_of_one_id_are_dealt_apart(spark):
    """A third of all rows under one id and a third under none, with their own texts; some rows repeat."""
    rnd = random.Random(8)
    body = lambda: " ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rnd.randint(0, 40)))
    rows = [(i, body()) for i in range(400)] + [(77, body()) for _ in range(400)] + [(None, body()) for _ in range(400)]
    rows += [(77, "one text"), (77, "one text"), (None, None), (None, ""), (2**62 + 1, "x"), (2**62, "y"), (-5, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    own = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mix")).collect()
    stand = sorted(own, key=lambda r: (-2**63 if r.doc_id is None else r.doc_id, r.mix))
    want = []
    for r, after in zip(stand, stand[1:] + stand[:1]):
        text, following = r.text or "", after.text or ""
        cut = len(text) // 4
        edited = text[:len(text) - cut] + following[:cut]
        prints = [chunk_prints.from_text(chunk_prints.fingerprint(t)) for t in (text, following)]
        want.append((str(r.doc_id), len(text), hashlib.sha256(edited.encode()).hexdigest(),
                     round(chunk_prints.containment(*prints), 9)))
    got = [(str(r.doc_id), r.n_chars, r.edited_sha256, round(r.near_next, 9))
           for r in chunk_prints.compare_with_next(docs).collect()]
    assert sorted(got) == sorted(want)
    dealt = chunk_prints.in_order(docs, "doc_id", "text").where("_ahead = 0").groupBy("_range").count().collect()
    assert max(r["count"] for r in dealt) < len(rows) / 8, sorted(r["count"] for r in dealt)


def test_edits_stay_near():
    rnd = random.Random(6)
    text = " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(400))
    prints = lambda t: chunk_prints.from_text(chunk_prints.fingerprint(t))
    assert chunk_prints.containment(prints(text), prints("shifted " + text)) > 0.95
    assert chunk_prints.containment(prints(text), prints(text[:1200])) > 0.95
    assert chunk_prints.containment(prints(text), prints(text[::-1])) < 0.05
    assert base64.b64decode(chunk_prints.fingerprint("")) == b""


def test_fingerprints_of_one_row_and_none(spark, no_docs):
    one = spark.createDataFrame([(7, "a single document of some length here")], "doc_id long, text string")
    row = chunk_prints.compare_with_next(one).collect()
    assert len(row) == 1 and row[0].near_next == 1.0
    assert chunk_prints.compare_with_next(no_docs).collect() == []
    assert chunk_prints.fingerprints(no_docs).collect() == []


# --- licences -------------------------------------------------------------------------------------

def test_license_scan_equals_sql(spark):
    for sf in (SMALL_SF, MID_SF):
        r = compare(queries.QUERIES["op3_license_scans"](spark, sf), duck_connect(sf), queries.ORACLE["op3_license_scans"])
        assert r["values_match"] and r["types_match"], r


def test_license_rules(spark, no_docs):
    mit = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated\n"
           "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation\n"
           "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,\n"
           "and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
           "The above copyright notice and this permission notice shall be included in all copies or substantial portions\n"
           "of the Software.")
    rows = [(1, mit), (2, "x\nLicensed under the Apache License, Version 2.0.\ny"), (3, None), (4, ""),
            (5, "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation; either version 3 of the License, or (at your "
                "option) any later version. All rights reserved."), (6, "this program is free software."),
            (7, "Released under the MIT License. Licensed under CC BY-NC 4.0. released under the mit license")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, licenses string")
    got = {r.doc_id: (r.licenses, r.n_sentences, r.n_unmatched) for r in licenses.scan_licenses(docs).collect()}
    assert got == {1: ("MIT", 2, 0), 2: ("Apache-2.0", 1, 0), 3: ("", 0, 0), 4: ("", 0, 0),
                   5: ("GPL-3.0-or-later,proprietary", 4, 0), 6: ("", 1, 1), 7: ("MIT,CC-BY-NC-4.0", 3, 0)}
    assert licenses.scan_licenses(no_docs).collect() == []
    assert {i for _, ids in licenses.ALL_RULES for i in ids} <= set(licenses.ALL_SENTENCES.values())


def test_published_notices_wrapped_indented_and_commented(spark):
    gnu = ("This {} is free software{} you can redistribute it and/or modify it under the terms of the GNU {}General Public "
           "License as published by the Free Software Foundation{} either version {} of the License, or (at your option) "
           "any later version.")
    bsd = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
           "the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, "
           "this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the "
           "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
           "materials provided with the distribution.")
    notices = [("GPL-2.0-or-later", gnu.format("program", ";", "", ";", "2")),
               ("GPL-3.0-or-later", gnu.format("program", ":", "", ",", "3")),
               ("LGPL-3.0-or-later", gnu.format("program", ":", "Lesser ", ",", "3")),
               ("LGPL-2.1-or-later", gnu.format("library", ";", "Lesser ", ";", "2.1")),
               ("LGPL-2.0-or-later", gnu.format("library", ";", "Library ", ";", "2")),
               ("AGPL-3.0-or-later", gnu.format("program", ":", "Affero ", ",", "3")),
               ("GPL-3.0-or-later", gnu.format("program", ":", "", ",", "3").replace("This program", "Thing")),
               ("BSD-2-Clause", bsd),
               ("BSD-3-Clause", bsd + "\n3. Neither the name of the copyright holder nor the names of its contributors may be "
                "used to endorse or promote products derived from this software without specific prior written permission."),
               ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
                "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
               ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy "
                "of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
               ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                "except in compliance with the License. You may obtain a copy of the License at\n"
                "    http://www.apache.org/licenses/LICENSE-2.0")]
    rows = []
    for name, notice in notices:
        for width in (25, 40, 72, 1000):
            lines = [line for part in notice.split("\n") for line in textwrap.wrap(part, width) or [""]]
            for start, mark, end in (("", "", ""), ("", "    ", ""), ("/*\n", " * ", "\n */"), ("", "# ", ""), ("", "//", ""),
                                     ("", ";; ", ""), ("", "-- ", ""), ("<!-- ", "  ", " -->"), ("/* ", "   ", " */")):
                for lead in ("", "Copyright (c) 2020 A. Holder\n", "x = 1\n\n"):
                    text = lead + start + "\n".join(mark + line for line in lines) + end + "\nint main() {}"
                    rows += [(len(rows), name, text), (len(rows) + 1, name, text.replace("\n", "\r\n"))]
    docs = spark.createDataFrame(rows, "doc_id long, name string, text string")
    got = {r.doc_id: (r.licenses, r.n_unmatched) for r in licenses.scan_licenses(docs).collect()}
    wrong = [(name, got[i], text) for i, name, text in rows
             if got[i][0] != name or got[i][1]]
    assert not wrong, (len(wrong), len(rows), wrong[:3])
    odd = [(0, " " * 200_000 + "x" + "*" * 200_000 + "x" + "." * 200_000 + "\t" * 200_000 + "x"),
           (1, "This program is free software;\n\nyou can redistribute\n\nit"), (2, "Released under the\n\nMIT License.")]
    got = {r.doc_id: (r.licenses, r.n_sentences)
           for r in licenses.scan_licenses(spark.createDataFrame(odd, "doc_id long, text string")).collect()}
    assert got == {0: ("", 0), 1: ("", 1), 2: ("", 0)}


LICENSE_TEXTS = [
    # the parts of a notice, near each other and far apart
    ("GPL-2.0-or-later", "{free}{gap3}{terms}{gap3}{later}"), ("", "{free}{gap}{terms}{gap}{later}"),
    ("", "{free}{terms}{gap}{later}"), ("MIT", "{free}{gap}Released under the MIT License.{gap}{terms}"),
    # a known sentence behind a subject, before a pointer, and inside what says something else
    ("MIT", "It was released under the MIT license."), ("MIT", "Licensed under the MIT License (see LICENSE)."),
    ("Apache-2.0", "This file is licensed under the Apache License, Version 2.0, see the file COPYING.txt for details."),
    ("MIT", "// The code of this is licensed under\n// the MIT license"),
    ("", "This file is not licensed under the MIT license"), ("", "Nobody licensed under the MIT license"),
    ("", "Licensed under the MIT license of old"),
    # tags
    ("MIT", "// SPDX-License-Identifier: MIT\nimport os"), ("GPL-2.0-only", "/* SPDX-License-Identifier: GPL-2.0 */"),
    ("GPL-2.0-or-later", "# SPDX-License-Identifier: GPL-2.0+\r\nx"), ("BSL-1.0", "SPDX-License-Identifier: BSL-1.0."),
    ("MIT,Apache-2.0", "#!/bin/sh\n#SPDX-License-Identifier: (MIT OR Apache-2.0)\n"), ("", "SPDX-License-Identifier: None"),
    ("", "SPDX-License-Identifier:"), ("", "SPDX-License-Identifier: MIT-like"),
    # further notices
    ("Zlib", "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held "
             "liable for any damages\narising from the use of this software.\n\nPermission is granted to anyone to use this "
             "software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, "
             "subject to the following restrictions:\n"),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, "
                  "publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\n"
                  "binary, for any purpose, commercial or non-commercial, and by any\nmeans.\n"),
    ("BSL-1.0", "//  Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt)"),
    # lines and marks
    ("MIT", "abc **/ -->\n  ** Released under the MIT License. **\n"), ("MIT", "a\nb\nc\nD.\n*x   y\n\t* \t* *\nReleased\nunder the\n"
     "  MIT license"), ("proprietary", "dnl All rights reserved\nREMark\nv. \n2 v.  3"), ("", None), ("", ""), ("", "\n\n \r \t\r\n"),
]


def _license_rows():
    parts = {"free": "This program is free software;\n", "gap": "Words that say nothing. " * 2000, "gap3": "More. Words.\n",
             "terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                      "the Free Software Foundation;\n", "later": "either version 2 of the License, or (at your option) any later "
                                                                "version.\n"}
    for name, value in parts.items():
        parts[name] = "\n" + value
    return [(i, name, text if text is None else text.format(**parts)) for i, (name, text) in enumerate(LICENSE_TEXTS)]


def test_license_gaps_subjects_tags_and_their_sql(spark):
    rows = _license_rows()
    docs = spark.createDataFrame([*rows, (None, "", rows[4][2]), (3, "", rows[3][2])], "doc_id long, name string, text string")
    result = licenses.scan_licenses(docs)
    got = result.collect()
    told = {r.doc_id: r.licenses for r in got if r.doc_id is not None}
    assert [(name, text, told[i]) for i, name, text in rows if told[i] != name] == []
    assert sum(r.doc_id is None and r.licenses == "MIT" for r in got) == 1 and sum(r.doc_id == 3 for r in got) == 2
    connection = duckdb.connect()
    connection.execute("CREATE TABLE documents (doc_id BIGINT, name VARCHAR, text VARCHAR)")
    connection.executemany("INSERT INTO documents VALUES (?, ?, ?)", [tuple(r) for r in docs.collect()])
    want = connection.execute(f"SELECT {', '.join(result.columns)} FROM ({licenses.oracle_sql()})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)


def test_license_plan_is_native(spark):
    plan = licenses.scan_licenses(spark.read.parquet(f"{SMALL_SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))


# --- pipeline -------------------------------------------------------------------------------------

def test_pipeline_stage_by_stage(spark):
    from .test_dedup import closure, plain_fingerprint, plain_repeats
    docs = spark.read.parquet(f"{SMALL_SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "quality_classifier", "simhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]
    result = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SMALL_SF)
        if name != names[-1]:
            assert docs.columns == before.columns
            docs = docs.cache()
        result[name] = docs.collect()
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SMALL_SF}/labels.parquet'").fetchall())
    kept = {r.doc_id for r in result["quality_classifier"]}
    assert np.mean([(d in kept) == bool(q) for d, q in labels.items()]) > 0.95
    rows = result["quality_classifier"]
    prints = [plain_fingerprint(r.text) for r in rows]
    label = closure(len(rows), [(i, j) for i in range(len(rows)) for j in range(i)
                                if bin(prints[i] ^ prints[j]).count("1") <= 4])
    least = {}
    for r, g in zip(rows, label):
        least[g] = min(least.get(g, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in result["simhash_near_dedup"]) == sorted(least.values())
    want = {d: n for d, n, *_ in plain_repeats([(r.doc_id, r.text) for r in result["simhash_near_dedup"]], 50)}
    removed = {d: m for d, _, m, *_ in plain_repeats([(r.doc_id, r.text) for r in result["simhash_near_dedup"]], 50)}
    for r in result["suffix_array_dedup"]:
        gone = want[str(r.doc_id)] - len(r.text.encode())
        assert 0 <= removed[str(r.doc_id)] - gone <= 6 * (removed[str(r.doc_id)] > 0) * 10
        assert r.n_chars == len(r.text) or gone == 0
    packed = result["best_fit_packing"]
    assert {r.doc_id for r in packed} == {r.doc_id for r in result["suffix_array_dedup"]}


def test_pipeline_of_odd_and_empty_tables(spark, docs, no_docs):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for table in (plain, no_docs):
        now = table
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, SMALL_SF)
        ids = [r.doc_id for r in now.collect()]
        assert (len(ids) == 0) == (table is no_docs)


@pytest.mark.parametrize("name", ["corpus_pipeline", "skyledger.llm"])
def test_entry_has_the_queries(name):
    import __spark_entry__ as entry
    assert name in sys.modules
    have = entry.queries()
    assert "pipeline" in have and all(any(q.startswith(f"op{n}_") for q in have) for n in range(1, 11))
    assert set(entry.oracle_sql()) <= set(have)
