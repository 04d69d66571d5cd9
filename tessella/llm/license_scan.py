"""Licence notices in paragraphs of documents, on DataFrame functions.

A paragraph is a line, and also a run of lines that are one wrapped text: a run ends
where a line ends in a sentence mark and before and after a blank line. A run counts
where it is confirmed (see below) and none of its lines is a confirmed notice by
itself; the other predictions for its lines then don't count.

A paragraph's features are its words and pairs of neighbouring words, present or
not. A multinomial logistic regression over them, fitted on the notices below
(with usual surroundings) and on sentences that only sound alike, names a family
or "unknown". Its probabilities are calibrated by a temperature, found on
notices held out from the fit, and a prediction below LEAST_PROBABILITY is
unknown. A prediction is confirmed if a notice of the family has at least
LEAST_CONTAINED of its words in the paragraph.

Paragraphs without any word of the model can only be unknown, and are passed
over. All of this happens inside a document's row: nothing is shuffled.

Defined cases: a null or empty text has no paragraphs; a null doc_id and repeated
rows pass through; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_PROBABILITY, LEAST_CONTAINED = 0.6, 0.75

#: Usual notices of each family.
NOTICES = {
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software under the terms of the GNU Affero General Public License.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "Released under AGPL v3.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "You may not use this file except in compliance with the Apache License.",
        "SPDX-License-Identifier: Apache-2.0",
        "Released under Apache 2.0.",
        "This software is available under the Apache License 2.0.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted.",
        "Released under the BSD License.",
        "Licensed under the 3-Clause BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Use of this source code is governed by a BSD-style license.",
    ],
    "boost": [
        "Distributed under the Boost Software License, Version 1.0.",
        "SPDX-License-Identifier: BSL-1.0",
        "Released under the Boost Software License.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
        "Released under CC BY-NC-SA.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "cc0": [
        "Dedicated to the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright, CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "eupl": [
        "Licensed under the EUPL, Version 1.2 or later.",
        "SPDX-License-Identifier: EUPL-1.2",
        "Licensed under the European Union Public Licence.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it under the terms of the GNU General Public License.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Released under the GPL v2.",
        "Licensed under the GNU GPL, version 2 or later.",
    ],
    "isc": [
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted.",
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
        "Released under the ISC License.",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software under the terms of the GNU Lesser General Public License.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "Released under the LGPL.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software.",
        "SPDX-License-Identifier: MIT",
        "MIT licensed.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "Released under MPL 2.0.",
    ],
    "proprietary": [
        "All rights reserved. No part of this publication may be reproduced without written permission.",
        "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
        "Copyright, all rights reserved.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense",
        "Released under the Unlicense.",
    ],
}
#: Sentences with some of the same words that are no notices.
UNKNOWN = [
    "The license of the driver expired in spring.",
    "She is a licensed physician.",
    "The general public may use the library for free.",
    "Version 2.0 of the report was released under pressure.",
    "This work is subject to change.",
    "Permission was granted by the court.",
    "The program is available in source and binary forms.",
    "Terms of use are found on another page.",
    "The Apache helicopter was used in the exercise.",
    "He studied at MIT and joined Mozilla.",
    "The Creative Commons were crowded.",
    "Attribution of the painting is doubtful.",
    "All rights of the public are reserved for later.",
    "A person may copy the file with permission.",
    "The author of the software has a copyright.",
    "Redistribution of wealth was not permitted.",
    "Use of the code is confidential.",
    "Written by an international team in four volumes.",
    "A non commercial project about domain names.",
    "The sa and nc columns are cc and by.",
]
#: What often stands around a notice.
AROUND = ["{}", "Copyright (c) 2019 J. Doe. {}", "{} See the file for details.", "note: {} thanks", "The code and data: {} More text follows here."]
_COMMON = set("a an and are as at be by for from has have he in is it its no not of on or that the this to was were with you may can any she".split())
_WORD = r"[a-z0-9]+(?:\.[0-9]+)?"
#: Line breaks between runs; each takes one character of the text. The break comes first,
#: so that what stands around it is looked at there alone and not at every character.
_BREAK = r"\n(?:(?<=[.!?:;][ \t\r\"')]{0,4}\n)|(?=[ \t\r]{0,80}\n)|(?<=\n[ \t\r]{0,80}\n))"


def _words(text: str) -> list[str]:
    return re.findall(_WORD, text.lower())


def _features(text: str) -> set[str]:
    w = _words(text)
    return {x for x in w if x not in _COMMON} | {f"{a} {b}" for a, b in zip(w, w[1:], strict=False) if not {a, b} <= _COMMON}


@lru_cache(1)
def trained() -> dict:
    """families, vocabulary, weights (a row a family), bias, temperature."""
    families = [*NOTICES, "unknown"]
    rows = [(a.format(t), k, i) for k, f in enumerate(NOTICES) for i, t in enumerate(NOTICES[f]) for a in AROUND]
    rows += [(a.format(t), len(NOTICES), i) for i, t in enumerate(UNKNOWN) for a in AROUND] + [("", len(NOTICES), 1)] * 20
    vocabulary = sorted({x for f in NOTICES.values() for t in f for x in _features(t)})
    number = {x: i for i, x in enumerate(vocabulary)}
    x = np.zeros((len(rows), len(vocabulary)))
    for r, (text, _, _) in enumerate(rows):
        x[r, [number[f] for f in _features(text) if f in number]] = 1
    y = np.eye(len(families))[[k for _, k, _ in rows]]
    held = np.array([i % 4 == 2 for _, _, i in rows])

    def solve(x, y):
        w, b, v, vb = np.zeros((x.shape[1], y.shape[1])), np.zeros(y.shape[1]), 0.0, 0.0
        for _ in range(400):
            z = x @ w + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            g = (p / p.sum(axis=1, keepdims=True) - y) / len(x)
            v, vb = 0.9 * v - 0.5 * (x.T @ g + 2e-4 * w), 0.9 * vb - 0.5 * g.sum(axis=0)
            w, b = w + v, b + vb
        return w, b

    w, b = solve(x[~held], y[~held])

    def loss(t):
        z = (x[held] @ w + b) / t
        z -= z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - (z * y[held]).sum(axis=1)).mean())

    temperature = min(np.arange(0.5, 3.01, 0.1), key=loss)
    w, b = solve(x, y)
    return {"families": families, "vocabulary": vocabulary, "weights": w.T, "bias": b, "temperature": float(temperature)}


def _literal(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def runs(text: Column) -> Column:
    """array<struct<i int, m int, s string>>: runs of two lines or more, with their first line and number of lines."""
    none = F.array().cast("array<struct<i:int,m:int,s:string>>")
    begin = F.struct(F.lit(0).alias("line"), none.alias("out"))

    def step(acc, s):
        breaks = F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))
        one = F.struct(acc["line"].alias("i"), (breaks + 1).alias("m"), s.alias("s"))
        return F.struct((acc["line"] + breaks + 1).alias("line"), F.when(breaks > 0, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(F.split(F.coalesce(text, F.lit("")), _BREAK), begin, step, lambda acc: acc["out"])


def paragraphs(text: Column) -> Column:
    """array<struct<i int, m int, family string, probability double, confirmed boolean>> of
    the lines and runs (first line i, m lines) that a family was predicted for."""
    m = trained()
    words_of = sorted({x for f in m["vocabulary"] for x in f.split(" ") if x not in _COMMON})
    vocabulary, known = _literal(m["vocabulary"]), _literal(words_of)
    # no group is repeated: Java's matcher recurses for each round of one, and long paragraphs hold thousands of signs in a row
    apart = r"[^a-z0-9.]++|\.(?![0-9])|(?<![0-9a-z])\."
    able = lambda s: F.arrays_overlap(F.split(F.lower(s), apart), known)
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda s, i: F.struct(i.alias("i"), F.lit(1).alias("m"), s.alias("s")))
    texts = F.filter(F.concat(lines, runs(text)), lambda x: able(x["s"]))
    # only few paragraphs come this far: their words are read again by the model's own pattern
    read = F.transform(texts, lambda x: F.struct(x["i"].alias("i"), x["m"].alias("m"), F.regexp_extract_all(F.lower(x["s"]), F.lit(f"({_WORD})")).alias("w")))

    def with_features(x):
        w = x["w"]
        pairs = F.zip_with(F.slice(w, 1, F.greatest(F.lit(0), F.size(w) - 1)), F.slice(w, 2, F.greatest(F.lit(0), F.size(w) - 1)), lambda a, b: F.concat_ws(" ", a, b))
        found = F.array_intersect(F.concat(w, pairs), vocabulary)
        places = F.transform(found, lambda f: F.array_position(vocabulary, f).cast("int") - 1)
        return F.struct(x["i"].alias("i"), x["m"].alias("m"), w.alias("w"), places.alias("f"))

    def with_scores(x):
        z = [F.aggregate(x["f"], F.lit(float(b)), _adder(row)) / m["temperature"] for row, b in zip(m["weights"], m["bias"], strict=True)]
        return F.struct(x["i"].alias("i"), x["m"].alias("m"), x["w"].alias("w"), F.array(*z).alias("z"))

    def predicted(x):
        best = F.array_max(x["z"])
        share = 1 / F.aggregate(x["z"], F.lit(0.0), lambda a, v: a + F.exp(v - best))
        family = F.get(_literal(m["families"]), F.array_position(x["z"], best).cast("int") - 1)
        return F.struct(x["i"].alias("i"), x["m"].alias("m"), x["w"].alias("w"), family.alias("family"), share.alias("probability"))

    def confirmed(x):
        right = F.lit(False)
        for family, notices in NOTICES.items():
            sets = [sorted(set(_words(t))) for t in notices]
            met = [F.size(F.array_intersect(_literal(s), x["w"])) >= LEAST_CONTAINED * len(s) for s in sets]
            right = F.when(x["family"] == family, F.greatest(*met) if len(met) > 1 else met[0]).otherwise(right)
        return F.struct(x["i"].alias("i"), x["m"].alias("m"), x["family"].alias("family"), F.round(x["probability"], 4).alias("probability"), right.alias("confirmed"))

    scored = F.transform(F.transform(F.transform(read, with_features), with_scores), predicted)
    named = F.filter(scored, lambda x: (x["family"] != "unknown") & (x["probability"] >= LEAST_PROBABILITY))
    return F.transform(named, confirmed)


def _adder(row):
    weights = _literal([round(float(v), 6) for v in row])
    return lambda a, i: a + F.get(weights, i)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_notices (confirmed), n_unconfirmed, families (of the confirmed, sorted,
    comma-joined; empty if none) and notices (line:family:probability, comma-joined) of each document."""
    found = docs.select("doc_id", paragraphs(F.col("text")).alias("p"))
    within = lambda line, run: line["i"].between(run["i"], run["i"] + run["m"] - 1)
    single, wide = F.filter("p", lambda x: x["m"] == 1), F.filter("p", lambda x: (x["m"] > 1) & x["confirmed"])
    found = found.select("doc_id", single.alias("single"), wide.alias("wide"))
    wide = F.filter("wide", lambda r: ~F.exists("single", lambda x: x["confirmed"] & within(x, r)))
    found = found.select("doc_id", "single", wide.alias("wide"))
    single = F.filter("single", lambda x: x["confirmed"] | ~F.exists("wide", lambda r: within(x, r)))
    found = found.select("doc_id", F.array_sort(F.concat(single, F.col("wide"))).alias("p"))
    sure = F.filter("p", lambda x: x["confirmed"])
    said = F.transform(sure, lambda x: F.concat_ws(":", x["i"].cast("string"), x["family"], x["probability"].cast("string")))
    return found.select(
        "doc_id",
        F.size(sure).cast("long").alias("n_notices"),
        (F.size("p") - F.size(sure)).cast("long").alias("n_unconfirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"),
        F.array_join(said, ",").alias("notices"),
    )
