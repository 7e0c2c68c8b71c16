"""Licence scans: Dice coefficient over word bigrams against licence templates, in DataFrame functions only.

A text's segments are its sentences, lines, paragraphs, the whole of it, and runs of its words, so that a
licence is found wherever it stands in a longer text and however it is broken into lines and paragraphs.
A segment is normalised (lower case, everything but letters and digits is a break) and its distinct word
bigrams are compared with those of each template: 2 |A and B| / (|A| + |B|). At a threshold t the sizes
must satisfy t / (2 - t) <= |A| / |B| <= (2 - t) / t, which prunes most templates before any bigram is compared.

Runs are looked for under templates of which the text holds t / (2 - t) of the bigrams, as fewer cannot
match. The places of a template's bigrams in the text form stretches; a run goes from the start of a stretch
to the end of that or a later one, over (2 - t) / t |B| bigrams at most. Longer or shorter runs that end
between stretches are no better: adding a bigram of the template never lowers the coefficient. A run is
reported by its normalised words.

The same bound says how many of a template's bigrams a match may lack, so each template yields a few
words of which every match holds at least one; a text without any of them is done after one regular
expression. Nothing is sampled and nothing is shuffled: all work is within the row, and the templates
are a constant of bounded size (``templates`` is a parameter).

Defined cases: null and empty texts match nothing. Templates need two words at least. Of templates that
tie, the first by name is best. Other columns pass through.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Licence notices and texts.
TEMPLATES = {
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "BSD notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-SA-4.0 notice": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY text notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA text notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MIT notice": "Released under the MIT License.",
    "MIT licensed notice": "Licensed under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "All rights reserved": "Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission.",
}
# Fixed values end.

_BREAK = r"[^\p{L}\p{N}]+"


def plain_bigrams(text: str) -> set[tuple[str, str]]:
    """The distinct word bigrams of a normalised text."""
    words = re.findall(r"[^\W_]+", text.lower())
    return set(zip(words, words[1:], strict=False))


def needed_words(bigrams: set[tuple[str, str]], threshold: float) -> set[str]:
    """Words of which every text at the threshold holds one: together they touch more bigrams than a match may lack."""
    # |A and B| >= t (|A| + |B|) / 2 and |A| >= |A and B|, so |A and B| >= t / (2 - t) |B|
    lacking = len(bigrams) - math.ceil(threshold / (2 - threshold) * len(bigrams) - 1e-9)
    left, chosen = set(bigrams), set()
    weight = Counter(w for pair in bigrams for w in set(pair))
    for word in sorted(weight, key=lambda w: (-min(len(w), 9) - weight[w] / 10, w)):
        if len(bigrams) - len(left) > lacking:
            break
        chosen.add(word)
        left = {pair for pair in left if word not in pair}
    return chosen


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value made once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _pairs(words: Column) -> Column:
    """The bigrams of two words or more, in order."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i)))


def _grams(segment: Column) -> Column:
    words = F.filter(F.split(F.lower(segment), _BREAK), lambda w: w != "")
    return _let(words, lambda w: F.when(F.size(w) > 1, F.array_distinct(_pairs(w))))


def _runs(words: Column, grams: Column, known: Column, least_needed: int, threshold: float) -> Column:
    """Runs of a text's words that match a template: array of dice, license, segment. ``least_needed``: bigrams of templates that any match holds."""
    least, most = threshold / (2 - threshold), (2 - threshold) / threshold

    def matched(x: Column) -> Column:
        need, length = F.ceil(x["size"] * least - 1e-9), F.floor(x["size"] * most + 1e-9)
        places = F.filter(F.sequence(F.lit(0), F.size(grams) - 1), lambda i: F.array_contains(x["grams"], F.get(grams, i)))
        # place and rank among the places
        firsts = lambda at: F.filter(F.transform(at, lambda p, k: F.when((k == 0) | (F.get(at, k - 1) < p - 1), F.struct(p.alias("p"), k.alias("k")))), lambda s: s.isNotNull())
        lasts = lambda at: F.filter(F.transform(at, lambda p, k: F.when((k == F.size(at) - 1) | (F.get(at, k + 1) > p + 1), F.struct(p.alias("p"), k.alias("k")))), lambda s: s.isNotNull())

        def scored(s: Column, e: Column) -> Column:
            own = F.array_distinct(F.slice(grams, s["p"] + 1, e["p"] - s["p"] + 1))
            dice = _let(own, lambda a: F.size(F.array_intersect(a, x["grams"])) * 2.0 / (F.size(a) + x["size"]))
            return F.struct(dice.alias("dice"), s["p"].alias("p"), e["p"].alias("q"))

        def from_start(starts: Column, ends: Column) -> Column:
            near = lambda s, k: F.filter(F.slice(ends, k + 1, length.cast("int") + 1), lambda e: (e["p"] - s["p"] < length) & (e["k"] - s["k"] + 1 >= need))
            return F.array_max(F.transform(starts, lambda s, k: F.array_max(F.transform(near(s, k), lambda e: scored(s, e)))))

        best = _let(places, lambda at: _let(firsts(at), lambda starts: _let(lasts(at), lambda ends: from_start(starts, ends))))
        return _let(best, lambda b: F.when(b["dice"] >= threshold - 1e-9, F.struct(b["dice"].alias("dice"), x["name"].alias("license"), F.array_join(F.slice(words, b["p"] + 1, b["q"] - b["p"] + 2), " ").alias("segment"))))

    def of_own(own: Column) -> Column:
        likely = F.filter(known, lambda x: F.size(F.array_intersect(own, x["grams"])) >= x["size"] * least - 1e-9)
        return F.when(F.size(own) >= least_needed, F.filter(F.transform(likely, matched), lambda r: r.isNotNull()))

    return _let(F.array_intersect(grams, F.col("__all")), of_own)


def scan_licenses(docs: DataFrame, text_col: str = "text", templates: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """``docs`` with licenses (array of license, dice, segment; one per license, best first); it wins over a column of that name."""
    grams = {name: plain_bigrams(text) for name, text in sorted((TEMPLATES if templates is None else templates).items())}
    if not grams or not all(grams.values()):
        raise ValueError("every template needs two words at least")
    words = sorted({w for g in grams.values() for w in needed_words(g, threshold)})
    hit = rf"(?<![\p{{L}}\p{{N}}])(?i:{'|'.join(map(re.escape, words))})(?![\p{{L}}\p{{N}}])"
    listed = json.dumps([{"name": n, "size": len(g), "grams": sorted(" ".join(p) for p in g)} for n, g in grams.items()])
    known = F.from_json(F.lit(listed), "array<struct<name:string,size:int,grams:array<string>>>")
    t, none = threshold, F.array().cast("array<struct<license:string,dice:double,segment:string>>")

    text = F.col(text_col)
    rows = docs.select(F.struct("*").alias("__row"), F.when(text.rlike(hit), F.filter(F.split(F.lower(text), _BREAK), lambda w: w != "")).alias("__words"))
    rows = rows.withColumn("__grams", F.when(F.size("__words") > 1, _pairs(F.col("__words"))))
    text = F.col("__row")[text_col]
    parts = F.concat(F.split(text, "\n"), F.split(text, r"(?<=[.!?])\s+|\n"), F.split(text, r"\n\s*\n"))
    parts = F.filter(F.array_distinct(parts), lambda s: (s != text) & s.rlike(hit))
    parts = F.transform(parts, lambda s: F.struct(F.trim(s).alias("segment"), _grams(s).alias("grams")))
    whole = F.struct(F.trim(text).alias("segment"), F.array_distinct("__grams").alias("grams"))
    rows = rows.withColumn("__parts", F.when(F.col("__words").isNotNull(), F.concat(parts, F.array(whole))))

    def matches(s: Column) -> Column:
        size = F.size(s["grams"])
        near = F.filter(F.col("__known"), lambda x: (size >= x["size"] * (t / (2 - t)) - 1e-9) & (size <= x["size"] * ((2 - t) / t) + 1e-9))
        scored = F.transform(near, lambda x: F.struct((F.size(F.array_intersect(s["grams"], x["grams"])) * 2.0 / (size + x["size"])).alias("dice"), x["name"].alias("license"), s["segment"].alias("segment")))
        return F.filter(scored, lambda x: x["dice"] >= t - 1e-9)

    every = F.array(*[F.lit(g) for g in sorted({" ".join(p) for g in grams.values() for p in g})])
    least_needed = min(math.ceil(len(g) * t / (2 - t) - 1e-9) for g in grams.values())
    rows = rows.withColumn("__known", known).withColumn("__all", every)
    found = F.flatten(F.transform(F.filter("__parts", lambda s: s["grams"].isNotNull()), matches))
    empty = F.array().cast("array<struct<dice:double,license:string,segment:string>>")
    rows = rows.withColumn("__found", F.concat(F.coalesce(found, empty), F.coalesce(_runs(F.col("__words"), F.col("__grams"), F.col("__known"), least_needed, t), empty)))
    best = F.transform(
        F.array_distinct(F.transform("__found", lambda x: x["license"])),
        lambda n: F.array_max(F.transform(F.filter("__found", lambda x: x["license"] == n), lambda x: F.struct(x["dice"], x["license"], x["segment"]))),
    )
    ordered = F.array_sort(F.transform(best, lambda x: F.struct((-x["dice"]).alias("k"), x["license"].alias("license"), x["dice"].alias("dice"), x["segment"].alias("segment"))))
    out = F.transform(ordered, lambda x: F.struct(x["license"], x["dice"], x["segment"]))
    rows = rows.withColumn("__out", F.when(F.size("__found") > 0, out).otherwise(none))
    return rows.select(*[F.col("__row")[c].alias(c) for c in docs.columns if c != "licenses"], F.col("__out").alias("licenses"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: its licences, best first, and the best one's Dice coefficient."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_licenses(docs)
    best = F.get("licenses", F.lit(0))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), best["license"].alias("license"), F.round(best["dice"], 9).alias("dice"), F.array_join(F.transform("licenses", lambda x: x["license"]), ",").alias("licenses"))
