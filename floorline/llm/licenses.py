"""License scans: normalised texts against licence templates by Dice coefficient over word bigrams; DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

#: Dice coefficient from which on a template is reported.
THRESHOLD = 0.8
#: Templates are part of the plan, so they must stay few.
MOST_BIGRAMS = 20_000

#: Wordings by which well-known licences are named or granted, in their public form.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("all-rights-reserved", "All rights reserved."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
]

#: Words are runs of letters and digits, in lower case.
NOT_WORD = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda w: w != "")


def bigrams_of(words: Column) -> Column:
    """Hashes of the pairs of neighbouring words, in order, repeats included; a single word stands for itself."""
    last = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(words, 1, last), F.slice(words, 2, last), lambda a, b: F.xxhash64(a, b))
    return F.when(F.size(words) >= 2, pairs).otherwise(F.transform(words, lambda w: F.xxhash64(w)))


def template_words(body: str) -> list[str]:
    return re.findall(r"[^\W_]+", body.lower())


def template_column(templates: list[tuple[str, str]], threshold: float) -> Column:
    """The templates as one constant: license, bigrams, their number, the width of a window, and what it has to share at least."""
    split = [(name, template_words(body)) for name, body in templates]
    if sum(len(w) for _, w in split) > MOST_BIGRAMS:
        raise ValueError("too many templates for one scan: scan with them in parts")
    low = threshold / (2 - threshold)
    rows = []
    for i, (name, words) in enumerate(split):
        if not words:
            raise ValueError(f"template {i} has no word")
        pairs = list(dict.fromkeys(zip(words, words[1:]))) or [(words[0],)]
        need = threshold * (low + 1) * len(pairs) / 2  # Dice at the least size that allows the threshold
        rows.append(
            F.struct(
                F.lit(i).alias("template"), F.lit(name).alias("license"), F.array(*(F.xxhash64(*map(F.lit, p)) for p in pairs)).alias("grams"),
                F.lit(len(pairs)).alias("b"), F.lit(max(1, len(words) - 1)).alias("width"), F.lit(need - 1e-9).alias("need"), F.lit(low * len(pairs) - 1e-9).alias("low"),
            )
        )
    return F.array(*rows)


def scan_licenses(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, word, license, template, dice): each place of each text that is worded like a licence.

    A template is held to the windows of a text that are as wide as itself and begin with one of its bigrams (at the end of
    a text, and in a shorter one, to what is left there), by distinct bigrams. Lines don't matter, so wrapped notices and
    sentences within a line are found in texts of any length. Sizes prune: with a and b bigrams Dice is at most
    2 min(a, b) / (a + b), so a text that shares too few bigrams with a template for that isn't held to it at all. Each
    template keeps its best window of a text, the first of equals; of windows that overlap the best stays, of equals that of
    the earlier template. ``word`` counts from 1.

    Null and empty texts match nothing, and an empty table gives no rows. Repeated rows are rows of their own and those with
    null ids match too. Other columns of ``docs`` may have any names. All is worked out within a row: nothing is shuffled.
    """
    known = template_column(templates, threshold)
    vocabulary = F.array_distinct(F.flatten(F.transform(known, lambda t: t["grams"])))
    once = lambda **named: [F.explode(F.array(v)).alias(k) for k, v in named.items()]  # noqa: E731 - a generator's value is worked out once
    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).where(F.col("text").isNotNull())
    words = base.select("doc_id", *once(words=words_of(F.col("text")))).where(F.size("words") > 0)
    grams = words.select("doc_id", *once(grams=bigrams_of(F.col("words"))))
    shared = grams.select("doc_id", "grams", *once(shared=F.array_intersect("grams", vocabulary))).where(F.size("shared") > 0)
    near = lambda t: (F.size("grams") >= t["low"]) & (F.size(F.array_intersect(F.col("shared"), t["grams"])) >= t["need"])
    asked = shared.select("doc_id", "grams", *once(asked=F.filter(known, near))).where(F.size("asked") > 0)

    def window(t: Column, at: Column) -> Column:
        return F.array_distinct(F.slice("grams", at, t["width"]))

    def best(t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size("grams")), lambda i: F.array_contains(t["grams"], F.get("grams", i - 1)))
        tried = F.transform(starts, lambda at: F.struct((2 * F.size(F.array_intersect(window(t, at), t["grams"])) / (F.size(window(t, at)) + t["b"])).alias("dice"), (-at).alias("minus")))
        return F.struct(F.array_max(tried).alias("top"), t["template"].alias("template"), t["license"].alias("license"), t["width"].alias("width"))

    found = asked.select("doc_id", *once(found=F.filter(F.transform("asked", best), lambda x: x["top"]["dice"] >= threshold)))
    beats = lambda y, x: (y["top"]["dice"] > x["top"]["dice"]) | ((y["top"]["dice"] == x["top"]["dice"]) & (y["template"] < x["template"]))
    meets = lambda y, x: (-y["top"]["minus"] <= x["width"] - x["top"]["minus"]) & (-x["top"]["minus"] <= y["width"] - y["top"]["minus"])
    left = found.select("doc_id", F.explode(F.filter("found", lambda x: ~F.exists("found", lambda y: meets(y, x) & beats(y, x)))).alias("x"))
    return left.select(F.col("doc_id").alias(doc_id), (-F.col("x.top.minus")).cast("long").alias("word"), "x.license", "x.template", F.col("x.top.dice").alias("dice"))
