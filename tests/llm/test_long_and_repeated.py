"""Texts that are costly for careless patterns, and rows that repeat."""

import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from parterre.llm import licenses, ngram_join, pii


def plain_dice(a, b):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    x, y = (set(zip(w, w[1:])) for w in (words(a), words(b)))
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 0.0


def test_long_words_and_many_numbers(spark):
    texts = ["x" * 1_000_000 + " 7", "7" + "x" * 1_000_000, "+1" + " " * 200_000, "a@" * 100_000, " ".join(str(k) for k in range(6_000)),
             "mail ann@example.com " + "y" * 500_000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    start = time.time()
    found = {r.doc_id: r for r in pii.personal_data(frame).select("doc_id", pii.span_text("spans").alias("spans")).collect()}
    assert time.time() - start < 90
    assert found[5].spans == "email:5:20" and found[0].spans == found[1].spans == ""


def test_places_of_many_matches(spark):
    text = "".join(f"{'-' * (k % 7)}<{k}@m.de>" for k in range(2_600))
    (row,) = spark.createDataFrame([(text,)], "text string").select(pii.base_spans(F.col("text")).alias("s")).collect()
    emails = [(s.start, s.end) for s in row.s if s.kind == "email"]
    assert emails == [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)] and len(emails) == 2_600


def test_licenses_against_plain_dice(spark):
    texts = ["Licensed under the MIT License", "x\nThis project is licensed under the MIT License, see the file.\ny", "All rights reserved.",
             "Copyright (c) 2024 Foo Inc. All rights reserved.", "Some words. Released under the ISC License. More words follow here.",
             "A first line of prose.\nThis project is licensed\nunder the MIT\nLicense. It goes on.", "the licence fee was reserved", None, "",
             "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as\n"
             "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
             "Licensed under the Frob License, permission reserved " * 3, "z " * 5000]
    rows = [(k, t, "x") for k, t in enumerate(texts)]
    once = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string, pair string")).collect()
    twice = licenses.license_scan(spark.createDataFrame(rows + rows, "doc_id long, text string, pair string")).collect()
    assert sorted(map(str, twice)) == sorted(map(str, once + once))
    found = {r.doc_id: r for r in once}
    assert [found[k].licenses for k in range(12)] == ["MIT", "MIT", "Proprietary", "Proprietary", "ISC", "MIT", "", "", "", "GPL-2.0-or-later", "", ""]
    for r in once:
        text = texts[r.doc_id] or ""
        parts = text.split("\n") + [b for b in re.split(r"\n[ \t\r]*\n", text)]
        parts += [s for b in re.split(r"\n[ \t\r]*\n", text) for s in re.split(r"(?<=[.!?;])[ \t-\r]+", b)]
        best = max(plain_dice(p, t) for p in parts for forms in licenses.TEMPLATES.values() for t in forms)
        assert (r.best_dice or 0.0) == (best if best >= licenses.DICE else 0.0) and (r.best_dice or 0.0) <= 1.0


def test_licenses_at_the_threshold_and_without_licence_words(spark):
    clause = ("Distribution and use in source and binary forms, with or without modification, are permitted provided that the following "
              "conditions are met:")
    texts = ["All rights reserved worldwide.", "It starts here. " + clause + "\nand it goes on", "First words. " + clause.replace(" forms", "\nforms"),
             "All rights reserved by nobody.", "Now. " + clause.upper(), "Some prose about forms and conditions. Nothing else."]
    found = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [found[k].licenses for k in range(6)] == ["Proprietary", "BSD-3-Clause", "BSD-3-Clause", "", "BSD-3-Clause", ""]
    assert (found[0].best_dice, found[0].n_segments, found[2].n_segments) == (0.8, 2, 2)
    # given templates and thresholds: each pair of a text and a template that reaches the threshold is met
    rng = random.Random(5)
    words = ["é", "一", "cc", "alpha", "beta", "gamma", "alphabet", "x", "under", "the"]
    sentence = lambda most: " ".join(rng.choice(words) for _ in range(rng.randrange(2, most)))
    templates = {f"t{k}": (sentence(9),) for k in range(12)}
    texts = [sentence(14).title() for _ in range(400)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for dice in (0.3, 0.6, 0.8, 1.0):
        for r in licenses.license_scan(frame, templates, dice).collect():
            best = max(plain_dice(texts[r.doc_id], t) for (t,) in templates.values())
            assert (r.best_dice or 0.0) == (best if best >= dice else 0.0)


def test_bounds_of_enormous_sets():
    """Sets of more shingles than a posting can tell: a set still reaches the overlap with itself."""
    rng = np.random.default_rng(1)
    for n in (ngram_join._SIZE - 1, ngram_join._SIZE + 5, 20_000_000):
        shingles = rng.integers(0, 2**63, n, np.uint64)
        told = np.array([min(n, ngram_join._SIZE)])
        at = ngram_join.coordinates(np.array([ngram_join.point(shingles)]), told)
        true = np.bincount((shingles & np.uint64(ngram_join.GROUPS - 1)).astype(np.int64), minlength=ngram_join.GROUPS)
        assert (at[0] >= true).all() and at.sum() >= ngram_join.needed(n, n, 80)
