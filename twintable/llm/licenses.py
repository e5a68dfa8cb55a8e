"""Licence notices in texts: Dice coefficient of word bigrams against templates, in native expressions.

Units of a text are its lines and its paragraphs (parted by blank lines). Texts are normalised to lower-case
words of a-z and 0-9. Units whose number of distinct bigrams cannot reach the threshold with any template
are dropped first, and each unit meets only templates whose size allows it. Nothing is exploded or shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: Notices by which texts name their licence, and the core of some licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def bigrams_of(text: str) -> list[str]:
    words = re.findall("[a-z0-9]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def bounds(size: int, threshold: float) -> tuple[int, int]:
    """Sizes that can reach the threshold with a template of the given size."""
    low = next(n for n in range(1, size + 1) if 2 * n / (n + size) >= threshold)
    high = size
    while 2 * size / (size + high + 1) >= threshold:
        high += 1
    return low, high


def _bigrams(unit: Column) -> Column:
    words = F.filter(F.split(F.regexp_replace(F.lower(unit), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    pairs = lambda w: F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))),
                                 lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.element_at(F.transform(F.array(words), pairs), 1))


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None,
         threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: key, ``license`` (of the best unit; ties: the first by name), its ``dice``, and
    ``n_units``, the units that reach the threshold with any template.

    Null and empty texts, and those without a match, have null, null and 0. A unit with fewer than two words
    has no bigrams and matches nothing. Repeated rows and null keys are rows of their own. Templates without
    bigrams are refused.
    """
    grams = {name: bigrams_of(t) for name, t in sorted((templates or TEMPLATES).items())}
    if not all(grams.values()):
        raise ValueError("a template needs two words at least")
    limits = {name: bounds(len(g), threshold) for name, g in grams.items()}
    low, high = min(a for a, _ in limits.values()), max(b for _, b in limits.values())
    own = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    units = F.array_distinct(F.concat(F.split("text", "\n"), F.split("text", "\n[ \t\r]*\n")))
    # a bigram takes three characters and a blank lies between words: shorter units are too small
    units = F.filter(units, lambda u: F.length(u) >= 2 * low + 1)
    sized = F.filter(F.transform(units, _bigrams), lambda g: F.size(g).between(low, high))

    def against(g: Column) -> Column:
        scores = [F.when(F.size(g).between(*limits[name]),
                         2.0 * F.size(F.array_intersect(g, F.array(*map(F.lit, t)))) / (F.size(g) + len(t)))
                  .otherwise(F.lit(0.0)) for name, t in grams.items()]
        return F.array_max(F.array(*[F.struct(s.alias("dice"), F.lit(-i).alias("rank")) for i, s in enumerate(scores)]))

    found = own.withColumn("sized", sized)
    found = found.withColumn("hits", F.filter(F.transform("sized", against), lambda s: s["dice"] >= threshold))
    best = F.array_max("hits")
    names = F.array(*map(F.lit, grams))
    return found.select("key", F.when(F.size("hits") > 0, F.element_at(names, 1 - best["rank"])).alias("license"),
                        F.when(F.size("hits") > 0, best["dice"]).alias("dice"),
                        F.coalesce(F.when(F.col("text").isNotNull(), F.size("hits")), F.lit(0)).cast("long").alias("n_units"))


def scan_sql(threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for the same rows over ``documents``."""
    rows = ", ".join(f"({i}, '{name}', [{', '.join(repr(g) for g in bigrams_of(t))}])" for i, (name, t) in enumerate(sorted(TEMPLATES.items())))
    return f"""
WITH templates(rank, name, grams) AS (VALUES {rows}),
docs AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
units AS (SELECT rid, unnest(list_distinct(list_concat(string_split(text, chr(10)),
            regexp_split_to_array(text, '\\n[ \\t\\r]*\\n')))) AS unit FROM docs WHERE text IS NOT NULL),
words AS (SELECT rid, list_filter(string_split(regexp_replace(lower(unit), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM units),
sets AS (SELECT rid, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM words WHERE len(w) >= 2),
scored AS (SELECT rid, rank, name, CAST(2.0 AS DOUBLE) * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice, g FROM sets, templates
           WHERE len(g) <= 4 * len(grams)),
best AS (SELECT rid, g, max(dice) AS dice, arg_max(name, (dice, -rank)) AS name, arg_max(rank, (dice, -rank)) AS rank FROM scored WHERE dice >= {threshold} GROUP BY rid, g),
hits AS (SELECT rid, count(*) AS n FROM sets s WHERE EXISTS (SELECT 1 FROM best b WHERE b.rid = s.rid AND b.g = s.g) GROUP BY rid),
top AS (SELECT rid, max(dice) AS dice, arg_max(name, (dice, -rank)) AS name FROM best GROUP BY rid)
SELECT doc_id, name AS license, dice, CAST(coalesce(n, 0) AS BIGINT) AS n_units
FROM docs LEFT JOIN top USING (rid) LEFT JOIN hits USING (rid)"""
