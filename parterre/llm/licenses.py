"""License scan: segments of a text against licence templates, by Dice over word bigrams.

A segment is a line, a block of lines up to a blank one, or a sentence of a block
(inside a line or wrapped over several). Its normal form is
its words, lower-cased, without marks. Each segment's bigrams meet the
templates' in one equi-join; a template is only a candidate for segments whose
number of bigrams lets the pair reach the Dice wanted, by the same division that
judges the pair. Before that, segments without any of the templates' cue words are
passed over: without one, too few of any template's bigrams are left to share.

Every row gets one row. Null and empty texts have no segment and no licence; ties
between templates go to the first name. Rows that repeat an id and text have equal
results. A long text is taken apart within one task; the work grows with its length. Only the
``keep`` columns and the text are read, so others may have any name. Empty tables give no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parterre.llm.common import ascii_lower, let, matches, row_key

DICE = 0.8

# Notices and headers of public licences, by SPDX name.
NOTICES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.",),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("Released under CC0 1.0 Universal.",),
    "GPL-2.0-only": ("This work is licensed under the GNU General Public License, version 2.",),
    "GPL-2.0-or-later": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "GPL-3.0-only": ("This work is licensed under the GNU General Public License, version 3.",),
    "GPL-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "ISC": ("Released under the ISC License.",),
    "LGPL-3.0-only": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "MIT": (
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    "Proprietary": ("All rights reserved.",),
    "Unlicense": ("Released into the public domain under the Unlicense.",),
}
# How the licences are called in a sentence.
NAMES = {
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 license"),
    "BSD-2-Clause": ("the BSD 2-Clause License",),
    "BSD-3-Clause": ("the BSD 3-Clause License",),
    "CC-BY-4.0": ("CC BY 4.0", "a Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC0-1.0": ("CC0 1.0 Universal",),
    "GPL-2.0-only": ("the GNU General Public License, version 2", "the GNU GPL v2"),
    "GPL-3.0-only": ("the GNU General Public License, version 3", "the GNU GPL v3"),
    "ISC": ("the ISC License",),
    "LGPL-3.0-only": ("the GNU Lesser General Public License, version 3",),
    "MIT": ("the MIT License",),
    "MPL-2.0": ("the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0"),
}
#: Sentences around a name. They are short, so that a name of one word weighs more than Dice forgives.
FORMS = ("Licensed under {}.", "Released under {}.", "Distributed under {}.", "This project is licensed under {}.", "This work is licensed under {}.",
         "This software is released under {}.", "The code is licensed under {}.")
TEMPLATES = {name: NOTICES[name] + tuple(form.format(called) for form in FORMS for called in NAMES.get(name, ()))
             for name in NOTICES}
#: Words that are cues only where no others suffice, since most texts hold them; this affects time only.
COMMON = frozenset("a an and any are as at be by for in is it not of on or that the this to under with you".split())
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def cue_words(templates: dict[str, tuple[str, ...]], dice: float) -> set[str]:
    """Words of which every segment that reaches ``dice`` with a template holds at least one: fewer of a template's
    bigrams are without them than such a segment shares."""
    cues: set[str] = set()
    for text in sorted((t for texts in templates.values() for t in texts), key=lambda t: (len(t), t)):
        words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text))
        pairs = set(zip(words, words[1:]))
        # a segment of just the shared bigrams needs the fewest
        shared = next((n for n in range(1, len(pairs) + 1) if 2 * n / (n + len(pairs)) >= dice), None)
        if shared is None:
            continue
        rest = {p for p in pairs if not cues.intersection(p)}
        for word in sorted(set(words) - cues, key=lambda w: (w in COMMON, -len(w), w)):
            if len(rest) < shared:
                break
            if any(word in p for p in rest):
                cues.add(word)
                rest = {p for p in rest if word not in p}
    return cues


def cue_pattern(templates: dict[str, tuple[str, ...]], dice: float) -> str:
    """A pattern that is found wherever a cue word is. Words of four letters and more are found inside others too."""
    cues = cue_words(templates, dice)
    inside = {w for w in cues if len(w) > 3}
    part = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
    forms = sorted(w for w in inside if not any(x != w and x in w for x in inside)) + [
        f"(?<!{part}){w}(?!{part})" for w in sorted(cues - inside)]
    return f"(?i)(?:{'|'.join(forms)})" if forms else "(?!)"


def bigrams(text: Column) -> Column:
    """The distinct pairs of neighbouring words, as hashes."""
    words = matches(ascii_lower(text), WORD)
    return let(words, lambda w: F.array_distinct(F.when(F.size(w) < 2, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i))))))


def template_table(spark: SparkSession, templates: dict[str, tuple[str, ...]]) -> DataFrame:
    rows = [(name, k, text) for name, texts in templates.items() for k, text in enumerate(texts)]
    listed = spark.createDataFrame(rows, "license string, variant int, text string")
    return listed.select("license", "variant", bigrams(F.col("text")).alias("pairs")).select(
        "license", "variant", F.size("pairs").alias("template_size"), F.explode("pairs").alias("pair"))


def license_scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, dice: float = DICE,
                 keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, licenses (sorted names, the nearest of each segment), n_segments that match one,
    best_license and best_dice."""
    known = template_table(docs.sparkSession, templates)
    cues = cue_pattern(templates, dice)
    text = F.coalesce("text", F.lit(""))
    cued = F.filter(F.split(text, r"\n[\x20\x09\x0D]*\n"), lambda x: x.rlike(cues))
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("at"), x.alias("part")))
    blocks = F.transform(F.filter(cued, lambda x: x.contains("\n")), lambda x, i: F.struct((-1 - i).alias("at"), x.alias("part")))
    sentences = F.flatten(F.transform(cued, lambda x: F.split(x, r"(?<=[.!?;])[\x20\x09-\x0D]+")))
    sentences = F.transform(sentences, lambda x, i: F.struct((-1_000_000_000 - i).alias("at"), x.alias("part")))
    parts = F.filter(F.concat(lines, blocks, sentences), lambda x: x["part"].rlike(cues))
    keyed = docs.select(F.struct(*keep).alias("kept"), "text", row_key(docs).alias("key"))
    segments = keyed.where(text.rlike(cues)).select("key", F.explode(parts).alias("s")).select(
        "key", "s.at", bigrams(F.col("s.part")).alias("pairs")).withColumn("size", F.size("pairs"))
    bounds = known.agg(F.min("template_size").alias("a"), F.max("template_size").alias("b")).first()
    # the same division as below: sizes are never turned down that the shared bigrams would let reach it
    reach = lambda n, m: 2 * F.least(n, m) / (n + m) >= dice
    size, least, most = F.col("size"), F.lit(bounds["a"] or 1), F.lit(bounds["b"] or 1)
    fit = segments.where((size > 0) & ((size >= least) | reach(size, least)) & ((size <= most) | reach(size, most)))
    # templates are a fixed list, whatever the size of the corpus
    met = fit.select("key", "at", "size", F.explode("pairs").alias("pair")).join(F.broadcast(known), "pair").where(
        reach(size, F.col("template_size")))
    # rows that repeat an id and text share a key: a pair counts once
    value = 2 * F.countDistinct("pair") / (F.col("size") + F.col("template_size"))
    scored = met.groupBy("key", "at", "license", "variant", "size", "template_size").agg(value.alias("dice")).where(
        F.col("dice") >= dice)
    nearest = scored.groupBy("key", "at").agg(F.min(F.struct((-F.col("dice")).alias("d"), "license")).alias("best"))
    found = nearest.groupBy("key").agg(
        F.array_join(F.array_sort(F.collect_set("best.license")), ",").alias("licenses"),
        F.count("*").alias("n_segments"), F.min("best").alias("best"))
    return keyed.drop("text").join(found, "key", "left").select(
        "kept.*", F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("n_segments", F.lit(0)).cast("long").alias("n_segments"),
        F.col("best.license").alias("best_license"), (-F.col("best.d")).alias("best_dice"))
