"""License scan with DataFrame functions only: MinHash bands over overlapping text windows retrieve templates, exact
shingle containment verifies them.

For every template length there are windows of that many words at every word of the text, so a copied notice has a window
of its own. Windows without any template shingle cannot contain one and are left out before hashing; this loses
nothing. A window and a template at 0.8 containment of 5-word shingles (runs of all words for shorter templates) have a
Jaccard similarity of 2 / 3 or more, and 24 bands of 2 minima meet for such a pair with probability above 0.999999.

The templates are a fixed list, so their band table (under 1 MB) is broadcast. Documents are read in place; only the few
verified windows are shuffled.

Edge cases. Null and blank texts hold nothing. A text shorter than a template is one window of all its words. Rows that
repeat an id are one document and count together, a null id being an id like others. An empty table gives an empty result.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlens.llm.shared import LETTERS, WORD

SHINGLE = 5
BANDS = 24
ROWS = 2
CONTAINED = 0.8

# License notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "MIT": "Released under the MIT License.",
    "MIT-header": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "proprietary": "All rights reserved.",
}


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, *LETTERS), F.lit(WORD), F.lit(0))


def _runs(words: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words (given as an array of word hashes), in order."""
    last = F.size(words) - F.lit(size - 1)
    run = lambda i: F.xxhash64(*[F.element_at(words, i + F.lit(k)) for k in range(size)])
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), run)).otherwise(F.array().cast("array<bigint>"))


def _bands(shingles: Column) -> Column:
    """Band keys of a set of shingles: minima of seeded hashes, ``ROWS`` to a band."""
    least = F.transform(F.sequence(F.lit(1), F.lit(BANDS * ROWS)), lambda s: F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, s))))
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.slice(least, b * ROWS + 1, ROWS)))


def _split(text: str) -> list[str]:
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(WORD, text)]


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """license, length and shingle hashes of each template."""
    rows = [(name, words, len(words)) for name, text in sorted(templates.items()) if (words := _split(text))]
    table = spark.createDataFrame(rows, "license string, words array<string>, length int").withColumn("words", F.transform("words", lambda w: F.xxhash64(w)))
    sizes = sorted({min(SHINGLE, r[2]) for r in rows})
    shingles = reduce(lambda other, k: F.when(F.least(F.lit(SHINGLE), "length") == k, _runs(F.col("words"), k)).otherwise(other), sizes, F.array().cast("array<bigint>"))
    return table.select("license", "length", F.array_distinct(shingles).alias("wanted"))


def _windows_of(length: int, wanted: list[int]) -> Column:
    """The windows of ``length`` words that hold one of the wanted shingles, as structs (length, at, shingles)."""
    k = min(SHINGLE, length)
    runs = F.col(f"runs{k}")
    inside = length - k + 1  # shingles of a window
    own = F.array(*map(F.lit, sorted(set(wanted))))
    last = F.greatest(F.size(runs) - F.lit(inside), F.lit(0))
    hits = F.filter(F.transform(runs, lambda h, i: F.when(F.array_contains(own, h), i)), lambda i: i.isNotNull())
    around = F.transform(hits, lambda i: F.sequence(F.least(F.greatest(i - F.lit(inside - 1), F.lit(0)), last), F.least(i, last)))
    starts = F.array_distinct(F.flatten(around))
    return F.transform(starts, lambda at: F.struct(F.lit(length).alias("length"), at.alias("at"), F.slice(runs, at + 1, inside).alias("shingles")))


def find_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, license, windows (verified windows), first_word (position of the first, from 0) and containment (largest)."""
    known = template_table(docs.sparkSession, templates)
    by_length: dict[int, list[int]] = {}
    for row in known.collect():  # the fixed list of templates
        by_length.setdefault(row.length, []).extend(row.wanted)
    sizes = sorted({min(SHINGLE, n) for n in by_length})
    # Exploding an array of one keeps the optimizer from repeating the tokenizing in every expression that reads it.
    once = lambda c: F.explode(F.array(c))
    hashed = docs.select(F.col(doc_id).alias("doc_id"), once(F.transform(_words(F.col(text)), lambda w: F.xxhash64(w))).alias("words"))
    runs = hashed.select("doc_id", once(F.struct(*[_runs(F.col("words"), k).alias(f"runs{k}") for k in sizes])).alias("r")).select("doc_id", "r.*")
    wanted_of = lambda k: sorted({h for n, w in by_length.items() if min(SHINGLE, n) == k for h in w})
    any_hit = reduce(lambda a, b: a | b, [F.arrays_overlap(f"runs{k}", F.array(*map(F.lit, wanted_of(k)))) for k in sizes])
    touched = runs.where(any_hit)

    classes = [_windows_of(length, wanted) for length, wanted in sorted(by_length.items())]
    windows = touched.select("doc_id", F.explode(F.concat(*classes)).alias("w")).select("doc_id", "w.*")
    banded = windows.withColumn("band", F.explode(_bands(F.col("shingles"))))
    templates_by_band = known.withColumn("band", F.explode(_bands(F.col("wanted"))))
    pairs = banded.join(F.broadcast(templates_by_band), ["length", "band"])
    share = F.size(F.array_intersect("wanted", "shingles")) / F.size("wanted")
    verified = pairs.select("doc_id", "license", "at", share.alias("containment")).where(F.col("containment") >= CONTAINED)
    once = verified.groupBy("doc_id", "license", "at").agg(F.max("containment").alias("containment"))
    return once.groupBy("doc_id", "license").agg(F.count("*").alias("windows"), F.min("at").cast("long").alias("first_word"), F.max("containment").alias("containment"))


def licenses_sql() -> str:
    """The same rows over table documents by counting shingles, without hashing."""
    rows = ", ".join("('{}', {})".format(name, "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in _split(text)) + "]") for name, text in sorted(TEMPLATES.items()))
    return f"""
        WITH templates(license, w) AS (VALUES {rows}),
        sized AS (SELECT license, w, len(w) AS length, least(len(w), {SHINGLE}) AS k FROM templates),
        wanted AS (SELECT DISTINCT license, length, k, array_to_string(w[s:s + k - 1], ' ') AS g
                   FROM (SELECT *, unnest(range(1, length - k + 2)) AS s FROM sized)),
        totals AS (SELECT license, count(*) AS total FROM wanted GROUP BY license),
        docs AS (SELECT doc_id, regexp_extract_all(translate(text, '{LETTERS[0]}', '{LETTERS[1]}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
        runs AS (SELECT doc_id, n, k, p, array_to_string(w[p + 1:p + k], ' ') AS g
                 FROM (SELECT doc_id, w, len(w) AS n, k, unnest(range(0, len(w) - k + 1)) AS p FROM docs CROSS JOIN (SELECT DISTINCT k FROM sized))),
        hits AS (SELECT doc_id, license, g, unnest(range(greatest(0, p - (length - k)), least(p, greatest(n - length, 0)) + 1)) AS pos
                 FROM runs JOIN wanted USING (k, g)),
        found AS (SELECT doc_id, license, pos, count(DISTINCT g) / CAST(any_value(total) AS DOUBLE) AS containment
                  FROM hits JOIN totals USING (license) GROUP BY doc_id, license, pos)
        SELECT doc_id, license, count(*) AS windows, min(pos) AS first_word, max(containment) AS containment
        FROM found WHERE containment >= {CONTAINED} GROUP BY doc_id, license"""
