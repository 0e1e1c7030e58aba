"""Licence scan: lines (and whole short texts) against licence templates by the Dice
coefficient over sets of word bigrams.

A unit is one line of a text, or the whole text (unit -1) when it has more than one line.
Units and templates are normalised alike: lower case, everything but letters and digits to
one space. For unit and template sets of ``n`` and ``m`` bigrams Dice is ``2c / (n + m)``; it
reaches ``t`` only if ``n`` lies between ``t / (2 - t) * m`` and ``(2 - t) / t * m``. These
bounds, and then one common bigram, prune nearly all units and templates before sets are
intersected. All of it is DataFrame expressions in one scan; nothing is shuffled or joined.

Defined cases: null and empty texts and lines of fewer than two words have no bigram and match
nothing; a unit that several templates match gives one row for each; repeated rows give
repeated results; an empty table gives no rows; other columns are passed by.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD_PERCENT = 80

# notices and opening sentences of common licences (fixed values)
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                         "except in compliance with the License.",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                 "associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                  "General Public License as published by the Free Software Foundation",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
           "that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "proprietary": "All rights reserved.",
}


def template_bigrams(templates: dict[str, str]) -> dict[str, list[str]]:
    out = {}
    for name, text in templates.items():
        words = re.sub(r"[\W_]+", " ", text.lower()).split()
        out[name] = sorted({f"{a} {b}" for a, b in zip(words, words[1:])})
    return out


def _bigrams(text: Column) -> Column:
    """Distinct bigrams of a normalised text."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")
    pairs = F.zip_with(words, F.slice(F.concat(words, F.array(F.lit(None).cast("string"))), F.lit(2), F.size(words)),
                       lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.filter(pairs, lambda p: p.isNotNull()))


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES,
                  percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """``(doc_id, unit, template, n_bigrams, common, dice)`` of every match."""
    sets = template_bigrams(templates)
    lo = min(len(b) for b in sets.values()) * percent // (200 - percent)
    hi = -(-max(len(b) for b in sets.values()) * (200 - percent) // percent)
    every = F.array(*[F.lit(x) for x in sorted({b for s in sets.values() for b in s})])

    lines = F.split(F.col("text"), "\n")
    units = docs.where(F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long"),
        F.explode(F.concat(
            F.transform(lines, lambda x, i: F.struct(i.alias("unit"), x.alias("line"))),
            F.when(F.instr("text", "\n") > 0, F.array(F.struct(F.lit(-1).alias("unit"), F.col("text").alias("line"))))
             .otherwise(F.array().cast("array<struct<unit:int,line:string>>")))).alias("u"))
    sized = units.select("doc_id", "u.unit", _bigrams(F.col("u.line")).alias("grams"))
    near = (sized.where(F.size("grams").between(max(lo, 1), hi) & F.arrays_overlap("grams", every)))
    judged = [
        F.when(F.size("grams").between(-(-len(b) * percent // (200 - percent)), len(b) * (200 - percent) // percent),
               F.struct(F.lit(name).alias("template"), F.lit(len(b)).alias("m"),
                        F.size(F.array_intersect("grams", F.array(*[F.lit(x) for x in b]))).alias("common")))
        for name, b in sets.items()]
    hits = near.select("doc_id", "unit", F.size("grams").alias("n"), F.explode(F.array_compact(F.array(*judged))).alias("h"))
    return (hits.where(200 * F.col("h.common") >= percent * (F.col("n") + F.col("h.m")))
            .select("doc_id", "unit", F.col("h.template").alias("template"), F.col("n").cast("long").alias("n_bigrams"),
                    F.col("h.common").cast("long").alias("common"),
                    (2.0 * F.col("h.common") / (F.col("n") + F.col("h.m"))).alias("dice")))


def oracle_sql(templates: dict[str, str] = TEMPLATES, percent: int = THRESHOLD_PERCENT) -> str:
    rows = ",\n  ".join(f"('{name}', {b!r})" for name, b in template_bigrams(templates).items())
    return f"""WITH templates(template, b) AS (VALUES
  {rows}),
lines AS (
  SELECT doc_id, (i - 1)::INTEGER AS unit, l[i] AS line
  FROM (SELECT doc_id, l, unnest(generate_series(1, len(l))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
  UNION ALL SELECT doc_id, -1, text FROM documents WHERE text LIKE '%' || chr(10) || '%'),
words AS (SELECT doc_id, unit, string_split(trim(regexp_replace(lower(line), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM lines),
grams AS (SELECT doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM words),
scored AS (SELECT doc_id, unit, template, len(g) AS n, len(b) AS m, len(list_intersect(g, b)) AS common
           FROM grams JOIN templates ON len(g) BETWEEN 1 AND 3 * len(b) AND list_has_any(g, b))
SELECT doc_id, unit, template, n::BIGINT AS n_bigrams, common::BIGINT AS common, 2.0::DOUBLE * common / (n + m) AS dice
FROM scored WHERE 200 * common >= {percent} * (n + m)"""
