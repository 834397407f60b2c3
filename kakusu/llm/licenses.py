"""License scans with DataFrame functions only.

Windows of a text overlap so that every run of a template's length lies wholly in one of them. A window's MinHash bands are
joined with those of the templates; one-row bands make a match of containment 0.8 collide with probability above 0.9999
(see :func:`collision`). What meets is verified by exact containment of the template's shingles in the window.

Texts without any gate word are passed over. That loses nothing: gate words are chosen so that more than a fifth of every
template's shingles hold one, hence a text with four fifths of the shingles has one; they are sought in the stripped text that
shingles are made of, so words broken by hyphens, soft hyphens or markup count there too.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GAP, need

BANDS, SHINGLE, CONTAINMENT = 20, 5, 0.8
#: Public license notices, fixed values.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT-license-notice": "Licensed under the MIT License.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}


def plain(text: str) -> list[str]:
    """Words of a template, as texts are cut: lower case, letters and digits only."""
    return [w for w in re.split(GAP, re.sub(r"[^a-z0-9\x20\x09-\x0D]+", "", text.lower())) if w]


#: A text as shingles see it, and its words.
_PLAIN = r"regexp_replace(lower({text}), '[^a-z0-9\\x20\\x09-\\x0D]+', '')"
_WORDS = r"array_remove(split({plain}, '[\\x20\\x09-\\x0D]+'), '')"


def gate_words(templates: dict[str, str], shingle: int, containment: float) -> list[str]:
    """Few long words such that over ``1 - containment`` of each template's shingles hold one, be it inside another word."""
    left = {}
    for name, text in templates.items():
        w = plain(text)
        left[name] = [frozenset(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    whole, gates = {k: len(v) for k, v in left.items()}, []
    covered = lambda k: (whole[k] - len(left[k])) / whole[k] > 1 - containment + 1e-9
    has = lambda g, s: any(g in w for w in s)
    while not all(map(covered, left)):
        open_ = [k for k in left if not covered(k)]
        words = sorted({w for k in open_ for s in left[k] for w in s})
        gain = {g: sum(has(g, s) / whole[k] for k in open_ for s in left[k]) for g in words}
        best = max(words, key=lambda g: (len(g) >= 7, gain[g], len(g)))
        gates.append(best)
        left = {k: [s for s in v if not has(best, s)] for k, v in left.items()}
    return gates


def length_classes(lengths: list[int]) -> dict[int, tuple[int, int]]:
    """Template length in shingles -> window and step in shingles; lengths within a factor of the square root of 2 share one."""
    out, top = {}, 0
    for n in sorted(set(lengths), reverse=True):
        if not top or n * math.sqrt(2) < top:
            top = n
        step = max(1, top // 4)
        out[n] = (top + step, step)
    return out


def collision(containment: float, bands: int = BANDS) -> float:
    """Least probability that a window with ``containment`` of a template's shingles shares one of its bands."""
    least = containment / math.sqrt(2) / (1.25 + (1 - containment) / math.sqrt(2))
    return 1 - (1 - least) ** bands


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, shingle: int = SHINGLE, containment: float = CONTAINMENT) -> DataFrame:
    """``doc_id, license, containment, word_at``: for each row and template that it holds, the best window.

    ``containment``: share of the template's distinct shingles that the window has, at least the given one; ``word_at``: the
    window's first word from 0, the first of equally good ones. Templates shorter than a shingle are one shingle; such, and
    texts that are null or have fewer words than a shingle, match nothing unless the whole sequence is the same. Repeated
    rows (equal id and text) give one result. Empty tables: no rows.
    """
    need(docs, id_col, text_col)
    templates = TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    classes = length_classes([max(1, len(plain(t)) - shingle + 1) for t in templates.values()])
    bound = [(k, plain(t)) for k, t in templates.items()]
    rows = [(k, w, *classes[max(1, len(w) - shingle + 1)]) for k, w in bound]
    shingles = f"transform(sequence(0, greatest(0, size(words) - {shingle})), i -> xxhash64(array_join(slice(words, i + 1, {shingle}), ' ')))"
    marks = "transform(sequence(1, {n}), k -> array_min(transform({set}, s -> xxhash64(s, k))))"
    table = spark.createDataFrame(rows, "license string, words array<string>, span int, step int").withColumn("wanted", F.expr(f"array_distinct({shingles})"))
    table = table.select("license", "span", "wanted", F.posexplode(F.expr(marks.format(n=bands, set="wanted"))).alias("band", "mark"))

    gates = " or ".join(f"contains(_plain, '{g}')" for g in gate_words(templates, shingle, containment))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_copy"))
    texts = texts.withColumn("_plain", F.expr(_PLAIN.format(text="_text"))).filter(F.expr(gates))
    held = texts.select("_id", "_copy", F.expr(_WORDS.format(plain="_plain")).alias("words")).filter("size(words) > 0").select("_id", "_copy", F.expr(shingles).alias("all"))
    spans = F.array(*(F.struct(F.lit(a).alias("span"), F.lit(b).alias("step")) for a, b in sorted(set(classes.values()))))
    windows = held.withColumn("s", F.explode(spans)).select("_id", "_copy", "s.span", F.explode(F.expr("sequence(0, size(all) - 1, s.step)")).alias("at"), "all")
    windows = windows.select("_id", "_copy", "span", "at", F.expr("slice(all, at + 1, span)").alias("window"))
    marked = windows.select("_id", "_copy", "span", "at", "window", F.posexplode(F.expr(marks.format(n=bands, set="window"))).alias("band", "mark"))
    met = marked.join(F.broadcast(table), ["span", "band", "mark"])  # templates x bands rows
    share = "size(array_intersect(wanted, window)) / size(wanted)"
    good = met.select("_id", "_copy", "license", "at", F.expr(share).alias("containment")).filter(F.col("containment") >= containment)
    best = good.groupBy("_id", "_copy", "license").agg(F.max(F.struct("containment", (-F.col("at")).alias("minus")))["containment"].alias("containment"), F.max(F.struct("containment", (-F.col("at")).alias("minus")))["minus"].alias("minus"))
    return best.select(F.col("_id").alias("doc_id"), "license", "containment", (-F.col("minus")).cast("long").alias("word_at")).distinct()
