"""Licence notices by Dice coefficient over word bigrams.

A passage (a line of a text, or the whole of it) is lower-cased and cut to its words, and
its set of neighbouring word pairs is compared with that of each template:
2 * common / (pairs of one + pairs of the other). A passage can only reach the threshold
if its size is within bounds of the template's, and if it holds one of a few words
without which too many of the template's pairs are missing; the first is checked before
any pair is compared, the second on the whole text before it is cut at all.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark.functions.once import let
from matchspark.llm.common import whole_text

LEAST = 0.8

#: Public licence notices, and whole texts of the short licences.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License v3.0."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License v2.0."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
}


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def pairs_of(text: str) -> list[str]:
    words = words_of(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def needed_words(pairs: list[str], least: float = LEAST) -> set[str]:
    """Words of which a passage must hold one: without them too few pairs can be common.

    The smallest passage within bounds has least / (2 - least) of the template's pairs, and
    all of them would have to be common.
    """
    common = math.ceil(len(pairs) * least / (2 - least) - 1e-9)
    words, missing = set(), set()
    for word in sorted({w for p in pairs for w in p.split()}, key=lambda w: (-len(w), w)):
        if len(missing) > len(pairs) - common:
            break
        words.add(word)
        missing |= {p for p in pairs if word in p.split()}
    return words


def listed(templates: dict[str, list[str]]) -> list[tuple[str, list[str]]]:
    return [(name, pairs_of(text)) for name, texts in sorted(templates.items()) for text in texts]


def notices(
    docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, list[str]] | None = None, least: float = LEAST,
) -> DataFrame:
    """One row per row of docs: key, license, dice, n_notices, licenses.

    n_notices passages reach the threshold, each for its best template (ties: the later
    name in the alphabet); licenses are their names, sorted and comma-joined; license and
    dice belong to the best passage (null and 0 where there is none). Lines end at a line
    feed. Words are runs of a-z and 0-9 after lower-casing; null texts are empty. Rows are
    judged one by one without a shuffle; other columns are not read.
    """
    known = listed(TEMPLATES if templates is None else templates)
    needed = sorted(set().union(*(needed_words(p, least) for _, p in known)))
    hit = "struct<dice:double,name:string>"
    none = F.array().cast(f"array<{hit}>")

    def score(pairs: Column) -> Column:
        n = F.size(pairs)
        found = [
            F.when(
                (n >= math.ceil(len(p) * least / (2 - least) - 1e-9)) & (n <= math.floor(len(p) * (2 - least) / least + 1e-9)),
                F.struct((F.size(F.array_intersect(pairs, F.array(*map(F.lit, p)))) * F.lit(2.0) / (n + len(p))).alias("dice"),
                         F.lit(name).alias("name")))
            for name, p in known
        ]
        return F.array_max(F.filter(F.array(*found), lambda h: h["dice"] >= least))

    def pairs(passage: Column) -> Column:
        def joined(words: Column) -> Column:
            return F.when(F.size(words) < 2, F.array().cast("array<string>")).otherwise(
                F.array_distinct(F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b))))

        return let(F.split(F.trim(F.regexp_replace(passage, "[^a-z0-9]+", " ")), " "), joined)

    def judged(body: Column) -> Column:
        lines = F.split(body, "\n")
        passages = F.when(F.size(lines) > 1, F.array_append(lines, body)).otherwise(lines)
        return F.filter(F.transform(passages, lambda p: let(pairs(p), score)), lambda h: h.isNotNull())

    body = F.lower(whole_text(text))
    able = lambda b: reduce(lambda x, y: x | y, [F.contains(b, F.lit(w)) for w in needed])
    hits = let(body, lambda b: F.when(able(b), judged(b)).otherwise(none))
    rows = docs.select(F.col(key), hits.cast(f"array<{hit}>").alias("_hits"))
    best = F.array_max("_hits")
    return rows.select(
        key, best["name"].alias("license"), F.coalesce(best["dice"], F.lit(0.0)).alias("dice"), F.size("_hits").cast("long").alias("n_notices"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.transform("_hits", lambda h: h["name"])))).alias("licenses"))


def sql(templates: dict[str, list[str]] | None = None, least: float = LEAST) -> str:
    """DuckDB's form of notices over `documents`, without any pruning."""
    rows = ", ".join("({!r}, [{}])".format(name, ", ".join(f"'{p}'" for p in pairs)) for name, pairs in listed(TEMPLATES if templates is None else templates))
    return f"""
WITH t(name, tp) AS (VALUES {rows}), d AS (
  SELECT row_number() OVER () AS n, doc_id, lower(coalesce(text, '')) AS b FROM documents
), p AS (
  SELECT n, unnest(string_split(b, chr(10))) AS line FROM d UNION ALL SELECT n, b FROM d WHERE contains(b, chr(10))
), w AS (
  SELECT n, row_number() OVER () AS i, regexp_extract_all(line, '[a-z0-9]+') AS ws FROM p
), g AS (
  SELECT n, i, list_distinct(list_transform(range(1, len(ws)), lambda k: ws[k] || ' ' || ws[k + 1])) AS ps FROM w WHERE len(ws) > 1
), s AS (
  SELECT n, i, name, 2.0::DOUBLE * len(list_intersect(ps, tp)) / (len(ps) + len(tp)) AS dice FROM g, t
  WHERE len(ps) BETWEEN len(tp) * {least} / (2 - {least}) - 1e-9 AND len(tp) * (2 - {least}) / {least} + 1e-9
), h AS (
  SELECT n, i, max({{'dice': dice, 'name': name}}) AS hit FROM s WHERE dice >= {least} GROUP BY n, i
), r AS (
  SELECT n, max(hit) AS best, count(*) AS k, string_agg(DISTINCT hit.name, ',' ORDER BY hit.name) AS names FROM h GROUP BY n
)
SELECT doc_id, best.name AS license, coalesce(best.dice, 0)::DOUBLE AS dice, coalesce(k, 0) AS n_notices, coalesce(names, '') AS licenses
FROM d LEFT JOIN r USING (n)
"""
