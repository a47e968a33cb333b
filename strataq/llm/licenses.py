"""License scans with a positional rare-token index, in DataFrame functions only.

Templates are key phrases and clauses of licences.  The inverted index maps a word to
its postings, the templates and places where it stands; a word's inverse document
frequency is taken among the templates.  A template is filed under its two rarest words
(ties go to the longer, then the earlier word), as a pair with the distance between
them.  A file is looked up once: its words are met with the index's words, and where it
has both words of a template, their places in the file are shifted to the start of the
template and intersected by relative position.  A start that is left is verified
against every word of the mandatory phrase, and its agreement is the share of the
template's words that stand where they should.

Nothing is shuffled or exploded: postings are arrays of one row, made only for words of
templates that a row may hold, so a row without such words costs one intersection
however many templates there are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The base phrases with their labels.
BASE = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

# Well-known wording of further public licences and notices.
OWN = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "licensed under mit"),
    ("mit", "spdx license identifier mit"),
    ("apache-2", "licensed under the apache license"),
    ("apache-2", "you may not use this file except in compliance with the license"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2", "spdx license identifier apache 2"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("bsd", "under the bsd license"),
    ("gpl", "gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("mpl-2", "mozilla public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("boost", "boost software license version 1 0"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("cc-by", "this work is licensed under a creative commons attribution"),
    ("cc0", "creative commons zero"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("all-rights-reserved", "all rights reserved"),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def rare_words(phrases: list[list[str]]) -> list[list[tuple[str, int]]]:
    """For each phrase its two words of the highest IDF among the phrases, with
    their first places; ties go to the longer, then the earlier word."""
    df: dict[str, int] = {}
    for p in phrases:
        for w in set(p):
            df[w] = df.get(w, 0) + 1
    out = []
    for p in phrases:
        first = {w: i for i, w in reversed(list(enumerate(p)))}
        idf = {w: math.log(len(phrases) / df[w]) for w in first}
        best = sorted(first, key=lambda w: (-round(idf[w], 9), -len(w), first[w]))[:2]
        out.append([(w, first[w]) for w in best])
    return out


def index(templates: list[tuple[str, str]]) -> list[tuple[str, list[str], list[tuple[str, int]]]]:
    """(label, words, index words with places) for each template."""
    phrases = [p.split(" ") for _, p in templates]
    return [(label, words, rare) for (label, _), words, rare in zip(templates, phrases, rare_words(phrases))]


def _postings(word: str, offset: int) -> Column:
    """Starts a phrase would have, from each place of one of its words."""
    places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get(F.col("words"), i) == word)
    return F.transform(places, lambda i: i - offset)


def _verified(starts: str, phrase: list[str]) -> Column:
    """The starts at which every word of the phrase stands."""
    whole = F.array(*map(F.lit, phrase))
    inside = F.filter(starts, lambda i: i >= 0)
    return F.filter(inside, lambda i: F.slice("words", i + 1, len(phrase)) == whole)


def _agreement(starts: str, phrase: list[str]) -> Column:
    """The largest number of the phrase's words that stand in their place at some start."""
    whole = F.array(*map(F.lit, phrase))

    def standing(i: Column) -> Column:
        return F.size(F.filter(F.sequence(F.lit(0), F.lit(len(phrase) - 1)), lambda k: (i + k >= 0) & (F.get("words", i + k) == F.get(whole, k))))

    return F.array_max(F.transform(starts, standing))


def scan(files: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence findings per file: base places, labels and score.

    The score is the largest agreement of a template, as a share of its words: 1 where
    one is verified, 0 where no template's two index words stand at their distance.
    Null text: empty.  Files without words or findings have n_base 0, null first and
    last word, empty labels and score 0.  Several starts of one template count each;
    null ids stay null, repeated rows stay repeated, an empty table gives no rows,
    further columns are not read.
    """
    nothing = F.array().cast("array<int>")
    rows = files.select(
        F.col(id_col).alias("doc_id"), F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER).alias("low")
    ).select("doc_id", F.array_remove(F.split("low", GAP), "").alias("words"))
    templates = index(BASE + OWN)
    every, base = range(len(templates)), range(len(BASE))
    listed = sorted({w for _, _, rare in templates for w, _ in rare})
    rows = rows.select("doc_id", "words", F.array_intersect("words", F.array(*map(F.lit, listed))).alias("rare"))
    shared, found, agreed = [], [], []
    for n, (_, words, rare) in enumerate(templates):
        both = F.array_contains("rare", rare[0][0]) & F.array_contains("rare", rare[1][0])
        starts = F.array_distinct(F.array_intersect(*[_postings(w, o) for w, o in rare]))
        shared.append(F.when((F.size("rare") > 1) & both, starts).otherwise(nothing).alias(f"at{n}"))
        some = F.size(f"at{n}") > 0
        found.append(F.when(some, _verified(f"at{n}", words)).otherwise(nothing).alias(f"in{n}"))
        agreed.append(F.when(some, _agreement(f"at{n}", words) / F.lit(float(len(words)))).otherwise(0.0).alias(f"like{n}"))
    rows = rows.select("doc_id", "words", *shared)
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), *found, *agreed)
    starts = F.concat(*[F.col(f"in{n}") for n in base])

    def labels(which) -> Column:
        hits = [F.when(F.size(f"in{n}") > 0, F.lit(templates[n][0])) for n in which]
        return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*hits)))), ",")

    return rows.select(
        "doc_id",
        "n_words",
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(every).alias("labels"),
        F.greatest(*[F.col(f"like{n}") for n in every]).alias("score"),
    )


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence scan of every whole text of ``documents``."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_sql() -> str:
    """The same findings in DuckDB SQL: the rare words are found in SQL, places of a
    phrase by comparing every window of words, agreement by looking at every start."""
    listed = ", ".join(f"({n}, '{label}', {n < len(BASE)}, string_split('{p}', ' '))" for n, (label, p) in enumerate(BASE + OWN))
    return rf"""
WITH t(n, label, base, p) AS (VALUES {listed}),
o AS (SELECT n, len(p) AS size, unnest(p) AS w, generate_subscripts(p, 1) - 1 AS k FROM t),
f AS (SELECT n, w, min(k) AS k FROM o GROUP BY n, w),
d AS (SELECT w, count(*) AS df FROM f GROUP BY w),
r AS (SELECT n, w, k, row_number() OVER (PARTITION BY n ORDER BY df, len(w) DESC, k) AS rank FROM f JOIN d USING (w)),
x AS (SELECT t.*, a.w AS wa, a.k AS ka, b.w AS wb, b.k AS kb FROM t JOIN r a ON a.n = t.n AND a.rank = 1 JOIN r b ON b.n = t.n AND b.rank = 2),
v AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
c AS (SELECT v.rid, words, x.* FROM v JOIN x ON list_contains(words, wa) AND list_contains(words, wb)),
s AS (SELECT *, list_filter(range(0, len(words)), lambda i: words[i + 1] = wa AND i - ka + kb >= 0 AND words[CASE WHEN i - ka + kb >= 0 THEN i - ka + kb + 1 ELSE 1 END] = wb) AS places FROM c),
g AS (SELECT rid, label, base, p, list_filter(list_transform(places, lambda i: i - ka), lambda i: i >= 0 AND words[CASE WHEN i >= 0 THEN i + 1 ELSE 1 END : i + len(p)] = p) AS hits,
  list_max(list_transform(places, lambda i: len(list_filter(range(0, len(p)), lambda k: i - ka + k >= 0 AND words[CASE WHEN i - ka + k >= 0 THEN i - ka + k + 1 ELSE 1 END] = p[k + 1])))) / len(p) AS share FROM s WHERE len(places) > 0),
h AS (SELECT rid, coalesce(sum(len(hits)) FILTER (base), 0) AS n_base, min(list_min(hits)) FILTER (base) AS a, max(list_max(hits)) FILTER (base) AS z, max(share) AS score,
  list_sort(list(DISTINCT label) FILTER (base AND len(hits) > 0)) AS bl, list_sort(list(DISTINCT label) FILTER (len(hits) > 0)) AS al FROM g GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(z AS BIGINT) AS last_word,
  coalesce(array_to_string(bl, ','), '') AS base_labels, coalesce(array_to_string(al, ','), '') AS labels, CAST(coalesce(score, 0.0) AS DOUBLE) AS score
FROM v LEFT JOIN h USING (rid)"""
