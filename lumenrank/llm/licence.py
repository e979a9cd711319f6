"""Operator 5, licence scans: MinHash bands over overlapping windows retrieve notices, exact containment verifies.

A template is found where a window, or the text as a whole, holds 80 % of its distinct
three-word shingles or more (lower case, letters and digits only; notices are
often a handful of words, so five-word shingles would be too few). The number
of bands makes a pair at the threshold meet with probability 0.9999 at least;
see ``containment`` for the search.

Defined results: null, empty and blank texts hold no notice. Rows with the
same id are searched by their own texts and reported together; documents
without an id are searched like any other; an empty table gives an empty
result. A longer notice that contains a shorter one is reported beside it, and
so are notices that differ in a word or two; ``n_found`` tells the fullest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrank.llm.containment import THRESHOLD, find_inside
from lumenrank.llm.registry import documents, query

SHINGLE = 3

# Notices of public licences, as (licence, text).
TEMPLATES = (
    ("all-rights-reserved", "All rights reserved."),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
            "permit persons to whom the Software is furnished to do so"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
            "License as published by the Free Software Foundation"),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
             "by the Free Software Foundation"),
    ("agpl-3.0", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met"),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution License."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
)


def licence_notices(
    docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text: str = "text",
    threshold: float = THRESHOLD, shingle: int = SHINGLE,
) -> DataFrame:
    """``doc_id, template, licence, n_shingles, n_found``: every template found, by its number in ``templates``."""
    rows = [(i, licence, body) for i, (licence, body) in enumerate(templates)]
    table = docs.sparkSession.createDataFrame(rows, "template int, licence string, body string")
    found = find_inside(docs, table, id_col, text, "template", "body", shingle, threshold, windowed=True)
    best = found.groupBy("doc_id", F.col("item_id").alias("template"), "n_shingles").agg(F.max("n_found").alias("n_found"))
    return best.join(table.select("template", "licence"), "template").select(
        "doc_id", "template", "licence", "n_shingles", "n_found"
    )


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{M}\\p{N}]+')"
SQL = f"""
WITH templates(template, licence, text) AS (VALUES {", ".join(f"({i}, {_quoted(n)}, {_quoted(t)})" for i, (n, t) in enumerate(TEMPLATES))}),
d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (
  SELECT template, licence, w, least(len(w), {SHINGLE}) AS k FROM (SELECT template, licence, {WORDS} AS w FROM templates) WHERE len(w) > 0
),
ds AS (
  SELECT doc_id, i, k, array_to_string(w[i + 1 : i + k], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(0, greatest(len(w) - k + 1, 0))) AS i FROM d, (SELECT DISTINCT k FROM b))
),
bs AS (
  SELECT DISTINCT template, licence, k, array_to_string(w[i + 1 : i + k], ' ') AS g
  FROM (SELECT template, licence, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM b)
),
n AS (
  SELECT template, count(*) AS n, any_value(2 * (1 << floor(log2(p))::BIGINT)) AS step
  FROM bs JOIN (SELECT template, len(w) - k + 1 AS p FROM b) USING (template) GROUP BY template
),
hit AS (
  SELECT doc_id, template, licence, n, g, i // step - o AS win
  FROM ds JOIN bs USING (g, k) JOIN n USING (template), (VALUES (0), (1)) AS s(o)
  WHERE i // step - o >= 0
),
f AS (SELECT doc_id, template, licence, n, win, count(DISTINCT g) AS found FROM hit GROUP BY ALL)
SELECT doc_id, template, licence, n AS n_shingles, max(found) AS n_found
FROM f WHERE found >= {THRESHOLD} * n GROUP BY ALL
"""


@query(SQL)
def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_notices(documents(spark, sf_dir))
