"""License scan: Dice coefficient over word bigrams, in DataFrame functions alone.

A text is one sequence of words (lower case, runs of other characters than
letters and digits to one space), whatever its lines and paragraphs, and every
run of consecutive words is held against a licence template by the Dice
coefficient 2 |A n B| / (|A| + |B|) of the two sets of word bigrams.  A template
matches if its best run reaches TAU.

The best run begins and ends with a bigram of the template, as others at its
ends only add to |A| + |B|, and its first bigram is not found in it again, as
the run after it has the same set.  To reach TAU a run must have
TAU / (2 - TAU) of the template's bigrams and at most (2 - TAU) / TAU times
their number of distinct ones, repeats aside.  So templates with too few of
their bigrams in the text are left out first, and from each place where one of
the others begins the distinct bigrams are followed up to that number.  None of
this loses a run.  All of it happens within the row, so there is no shuffle and
no hot key.

`n_segments` is a count of the text's own parts (lines, blocks between blank
lines, the whole; equal ones once) whose number of bigrams, repeats included,
is within the bounds of some template.  It decides nothing.

Defined results for odd input: null text is the empty text; a text without a
match has no licences, a null `best` and best_dice 0.  Of equal coefficients
the template whose name is first is best.  Repeated rows get equal results.
Extra columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.quality_rules import let

TAU = 0.8

# Notices and texts of public licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.',
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def bigrams_of(template: str) -> list[str]:
    import re

    words = re.sub(r"[\W_]+", " ", template.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def scan(docs: DataFrame, templates: dict[str, str] | None = None, tau: float = TAU) -> DataFrame:
    """doc_id, n_segments (of the size of a template), licences (names by comma, in order), best, best_dice."""
    least, most = tau / (2 - tau), (2 - tau) / tau
    strings = "array<string>"
    sets = [(name, bigrams_of(text)) for name, text in sorted((templates or TEMPLATES).items())]
    known = F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(len(s)).alias("n"), F.lit(math.ceil(len(s) * least - 1e-9)).alias("need"), F.lit(math.floor(len(s) * most + 1e-9)).alias("most"), F.array(*map(F.lit, s)).cast(strings).alias("s"))
        for name, s in sets
    ])
    every = F.array(*map(F.lit, sorted({x for _, s in sets for x in s}))).cast(strings)
    # segments of these numbers of bigrams have a candidate
    lowest, highest = (min(len(s) for _, s in sets) * least, max(len(s) for _, s in sets) * most) if sets else (1, 0)

    def best_run(t: Column, own: Column, begin: Column) -> Column:
        """The best Dice coefficient of the runs from place `begin` on."""
        reach = 3 * t["n"]
        again = F.array_position(F.slice(own, begin + 2, reach), F.get(own, begin)).cast("int")  # places to the next equal one
        near = F.array_distinct(F.slice(own, begin + 1, F.when(again > 0, again).otherwise(reach)))
        ended = (again > 0) | (F.size(near) >= t["most"]) | (begin + reach >= F.size(own))
        followed = F.slice(F.when(ended, near).otherwise(F.array_distinct(F.slice(own, begin + 1, F.size(own)))), F.lit(1), t["most"])

        def step(state: Column, x: Column) -> Column:
            hit = F.array_contains(t["s"], x)
            size, both = state["size"] + 1, state["both"] + hit.cast("int")
            return F.struct(size.alias("size"), both.alias("both"), F.when(hit, F.greatest(state["d"], F.lit(2.0) * both / (t["n"] + size))).otherwise(state["d"]).alias("d"))

        start = F.struct(F.lit(0).alias("size"), F.lit(0).alias("both"), F.lit(0.0).alias("d"))
        return let(followed, lambda run: F.when(F.size(F.array_intersect(t["s"], run)) >= t["need"], F.aggregate(run, start, step, lambda x: x["d"])).otherwise(F.lit(0.0)))

    def matches(own: Column) -> Column:
        def of(common: Column) -> Column:
            candidates = F.filter(known, lambda t: (F.size(common) >= t["need"]) & (F.size(F.array_intersect(t["s"], common)) >= t["need"]))
            begins = lambda t: let(F.array_intersect(t["s"], common), lambda c: F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda i: F.array_contains(c, F.get(own, i))))
            dice = lambda t: F.coalesce(F.array_max(F.transform(begins(t), lambda i: best_run(t, own, i))), F.lit(0.0))
            return F.filter(F.transform(candidates, lambda t: F.struct((-dice(t)).alias("d"), t["name"].alias("name"))), lambda x: x["d"] <= -tau)

        return let(F.array_intersect(own, every), of)

    def bigrams(words: Column) -> Column:
        return F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)))).otherwise(F.array().cast(strings))

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    blocks = F.split(text, r"\n[\x20\t\r]*\n")
    sizes = F.transform(F.array_distinct(F.flatten(F.array(F.split(text, "\n"), blocks, F.array(text)))), lambda s: F.size(F.split(normal(s), " ")) - 1)
    chosen = F.filter(sizes, lambda n: (n >= F.greatest(F.lit(1.0), F.lit(lowest))) & (n <= F.lit(highest)))
    found = F.array_sort(let(let(F.split(normal(text), " "), bigrams), matches))
    out = docs.select(F.col("doc_id").cast("long"), F.size(chosen).cast("long").alias("n_segments"), found.alias("found"))
    names = F.array_join(F.array_sort(F.transform("found", lambda x: x["name"])), ",")
    return out.select("doc_id", "n_segments", names.alias("licences"), F.get("found", 0)["name"].alias("best"), F.coalesce(-F.get("found", 0)["d"], F.lit(0.0)).alias("best_dice"))


def oracle_sql(tau: float = TAU) -> str:
    rows = ", ".join(f"('{name}', {len(s)}, [{', '.join(repr(x) for x in s)}])" for name, s in ((k, bigrams_of(v)) for k, v in sorted(TEMPLATES.items())))
    ns = [len(bigrams_of(v)) for v in TEMPLATES.values()]
    return rf"""
WITH t(name, n, s) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
seg AS (SELECT DISTINCT r, unnest(list_concat(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '\n[\x20\t\r]*\n')), [text])) AS raw FROM d),
w AS (SELECT r, row_number() OVER () AS k, string_split(trim(regexp_replace(lower(raw), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM seg),
c AS (SELECT r, k, len(w) - 1 AS n, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS s FROM w
  WHERE len(w) - 1 >= greatest(1.0, {min(ns)} * {tau}::DOUBLE / (2 - {tau}::DOUBLE)) AND len(w) - 1 <= {max(ns)} * (2 - {tau}::DOUBLE) / {tau}::DOUBLE),
m AS (SELECT c.r, t.name, 2.0::DOUBLE * len(list_intersect(t.s, c.s)) / (t.n + len(c.s)) AS dice FROM c JOIN t
  ON c.n >= t.n * {tau}::DOUBLE / (2 - {tau}::DOUBLE) AND c.n <= t.n * (2 - {tau}::DOUBLE) / {tau}::DOUBLE),
f AS (SELECT r, string_agg(DISTINCT name, ',' ORDER BY name) AS licences, first(name ORDER BY dice DESC, name) AS best, max(dice) AS best_dice FROM m WHERE dice >= {tau}::DOUBLE GROUP BY r),
n AS (SELECT r, count(*) AS n_segments FROM c GROUP BY r)
SELECT d.doc_id, CAST(coalesce(n.n_segments, 0) AS BIGINT) AS n_segments, coalesce(f.licences, '') AS licences, f.best, coalesce(f.best_dice, 0.0::DOUBLE) AS best_dice
FROM d LEFT JOIN n USING (r) LEFT JOIN f USING (r)
"""
