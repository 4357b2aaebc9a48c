"""Licence scan by a positional index of rare words. DataFrame functions only.

Templates are sentences of licence texts with a label and a mandatory key phrase; their postings
(word, template, position) are the index. The document frequency of every template word is counted
over all documents. A file looks up, for each template, the ``RARE`` rarest of the template's words
that it has (those of the highest inverse document frequency), and their positions in the file meet
the postings: a word at position p of the file and q of the template speaks for a copy that starts
at p - q. Postings that agree on the start are added up. A copy counts when the words of the key
phrase stand at their places and the words found hold ``SHARE`` or more of the weight looked for.

The base phrases are templates of their own, all of whose words are key.

Only files that have all key words of some template give rows for the index; they carry the words of
templates alone. A file with very many copies is spread over tasks by start.

Defined results: null and empty texts have no words, no places, empty labels and a score of 0; a row
is judged by itself, repeated rows and ids included; extra columns are ignored. What is broadcast are
the templates and their words' counts, whose number is fixed here.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Words of a template that a file looks up, the rarest first.
RARE = 8
#: Part of the looked-up weight that a copy must hold.
SHARE = 0.7


class Template(NamedTuple):
    label: str
    text: str
    key: str
    base: bool = False


# Fixed: the base phrases and their labels.
BASE = (
    Template("gpl", "gnu general public license", "gnu general public license", True),
    Template("apache", "apache license", "apache license", True),
    Template("cc-by", "cc by", "cc by", True),
    Template("mit", "mit license", "mit license", True),
)

# Fixed: sentences as the licences themselves have them, in words of the scan.
SENTENCES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted"),
    Template("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "except in compliance with the license"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "you can redistribute it"),
    Template("gpl", "this work is licensed under the gnu general public license version 3", "general public license version"),
    Template("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", "attribution noncommercial"),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "related or neighboring rights"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "without any express or implied warranty"),
)

TEMPLATES = (*BASE, *SENTENCES)

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words in small letters: digits, a to z, and all characters beyond ASCII; A to Z count as a to z."""
    plain = F.char_length(text) == F.octet_length(text)  # ASCII alone: lower() changes nothing else
    small = F.when(plain, F.lower(text)).otherwise(F.translate(text, _CAPITALS, _SMALL))
    return F.array_remove(F.split(F.coalesce(small, F.lit("")), _BETWEEN), "")


def _literal(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def weights(texts: DataFrame, templates: Sequence[Template]) -> dict[str, float]:
    """Inverse document frequency of every template word: ln((documents + 1) / (documents with it + 0.5)).

    One row per template word reaches the driver.
    """
    vocabulary = sorted({w for t in templates for w in t.text.split()})
    held = texts.select(F.array_intersect("words", _literal(vocabulary)).alias("held"))
    counts = held.select(F.explode("held").alias("word")).groupBy("word").count()
    total = held.agg(F.count(F.lit(1)).alias("count")).select(F.lit("").alias("word"), "count")
    n_docs = {r["word"]: r["count"] for r in counts.unionByName(total).collect()}
    return {w: math.log((n_docs[""] + 1) / (n_docs.get(w, 0) + 0.5)) for w in vocabulary}


class _Posting(NamedTuple):
    template: int
    word: str
    place: int
    key: bool
    ppm: int  # weight of the word at this place, in millionths of what the template's rarest words weigh


def _index(templates: Sequence[Template], idf: dict[str, float]) -> tuple[list[_Posting], list[list[str]]]:
    """The postings of all templates, and each template's words, the rarest first."""
    postings, rarest = [], []
    for n, t in enumerate(templates):
        words, key = t.text.split(), t.key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        order = sorted(set(words), key=lambda w: (-idf[w], w))
        total = sum(idf[w] for w in order[:RARE])
        postings += [_Posting(n, w, i, at <= i < at + len(key), round(1e6 * idf[w] / words.count(w) / total)) for i, w in enumerate(words)]
        rarest.append(order)
    return postings, rarest


def _table(docs: DataFrame, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small table of fixed rows."""
    said = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x).lower() for x in r) + ")" for r in rows)
    return docs.sparkSession.sql(f"SELECT * FROM VALUES {said} AS t({schema})")


def _scanned(texts: DataFrame, templates: Sequence[Template], rarest: list[list[str]]) -> DataFrame:
    """A numbered row per document: n_words, and for files with all key words of some template what they
    look up: ``look`` (template, words) and ``at`` (word, position) of all template words."""
    fits = [F.when(F.size(F.array_except(_literal(sorted(set(t.key.split()))), "held")) == 0, F.lit(n)) for n, t in enumerate(templates)]
    order, vocabulary = F.array(*[_literal(w) for w in rarest]), _literal(sorted(set().union(*rarest)))
    looked = F.transform("fits", lambda n: F.struct(n.alias("template"), F.slice(F.array_intersect(F.get(order, n), F.col("held")), 1, RARE).alias("words")))
    placed = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("position"))), lambda x: F.array_contains("held", x["word"]))
    some = F.size("fits") > 0
    rows = texts.withColumn("held", F.array_intersect("words", vocabulary))
    rows = rows.withColumn("fits", F.when(F.size("held") > 0, F.array_compact(F.array(*fits))).otherwise(F.array().cast("array<int>")))
    return rows.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"), F.when(some, looked).alias("look"), F.when(some, placed).alias("at")
    )


def license_places(rows: DataFrame, postings: list[_Posting], templates: Sequence[Template]) -> DataFrame:
    """Rows (row, template, label, base, start, share) of the copies of templates in scanned files."""
    index = F.broadcast(_table(rows, postings, "template, word, place, key, ppm"))
    about = F.broadcast(_table(rows, [(n, t.label, t.base, len(t.key.split())) for n, t in enumerate(templates)], "template, label, base, n_key"))
    found = rows.where("at is not null").select("row", "look", F.inline("at")).join(index, "word")
    found = found.withColumn("mine", F.filter("look", lambda x: x["template"] == F.col("template"))).where(F.size("mine") > 0)
    looked = F.array_contains(F.col("mine")[0]["words"], F.col("word"))
    copies = found.groupBy("row", "template", (F.col("position") - F.col("place")).alias("start")).agg(F.sum(F.when(looked, F.col("ppm")).otherwise(0)).alias("ppm"), F.count_if("key").alias("keys"))
    share = F.when(F.col("base"), 1.0).otherwise(F.least(F.lit(1.0), F.col("ppm") / 1e6))
    copies = copies.join(about, "template").where("keys = n_key").withColumn("share", share)
    return copies.where(F.col("share") >= SHARE).select("row", "template", "label", "base", F.col("start").cast("long").alias("start"), "share")


def _labels(condition: Column | None = None) -> Column:
    label = F.col("label") if condition is None else F.when(condition, F.col("label"))
    return F.array_join(F.array_sort(F.collect_set(label)), ",")


def scanned_licenses(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """One row per document: n_words, n_base, first_word, last_word, base_labels, labels, score and n_copies (of sentences).

    ``n_base`` counts the places of base phrases, ``first_word`` and ``last_word`` are the smallest and
    the largest start of one, ``score`` is the highest share of a copy.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words"))
    postings, rarest = _index(templates, weights(texts, templates))
    rows = stored(_scanned(texts, templates, rarest), "licenses")
    base = F.col("base")
    found = license_places(rows, postings, templates).groupBy("row").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        _labels(base).alias("base_labels"),
        _labels().alias("labels"),
        F.max("share").alias("score"),
        F.count_if(~base).alias("n_copies"),
    )
    out = rows.select("row", "doc_id", "n_words").join(found, "row", "left")
    defaults = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0), "n_copies": F.lit(0).cast("long")}
    names = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_copies")
    return out.select(*[F.coalesce(n, defaults[n]).alias(n) if n in defaults else F.col(n) for n in names])


def oracle(templates: Sequence[Template] = TEMPLATES) -> str:
    """DuckDB SQL for ``scanned_licenses`` over ``documents``."""
    rows = []
    for n, t in enumerate(templates):
        words, key = t.text.split(), t.key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        rows += [f"({n}, '{t.label}', {t.base}, {len(key)}, '{w}', {i}, {at <= i < at + len(key)})" for i, w in enumerate(words)]
    return rf"""
WITH p(n, label, base, n_key, word, place, is_key) AS (VALUES {", ".join(rows)}),
d AS (SELECT row_number() OVER () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_SMALL}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
o AS (SELECT r, unnest(w) word, generate_subscripts(w, 1) - 1 AS position FROM d),
m AS (SELECT r, o.word, position FROM o SEMI JOIN p ON o.word = p.word),
c AS (SELECT word, count(DISTINCT r) n_docs FROM m GROUP BY word),
idf AS (SELECT word, ln(((SELECT count(*) FROM d) + 1) / (coalesce(n_docs, 0) + 0.5)) idf FROM (SELECT DISTINCT word FROM p) LEFT JOIN c USING (word)),
t AS (SELECT n, word, idf, count(*) times, row_number() OVER (PARTITION BY n ORDER BY idf DESC, word) k FROM p JOIN idf USING (word) GROUP BY n, word, idf),
total AS (SELECT n, sum(idf) whole FROM t WHERE k <= {RARE} GROUP BY n),
weight AS (SELECT n, word, k, round(1000000 * idf / times / whole)::BIGINT ppm FROM t JOIN total USING (n)),
has AS (SELECT DISTINCT r, n, m.word, k FROM m JOIN weight ON weight.word = m.word),
look AS (SELECT r, n, word FROM has QUALIFY row_number() OVER (PARTITION BY r, n ORDER BY k) <= {RARE}),
copy AS (SELECT m.r, p.n, label, base, n_key, position - place AS start, count_if(is_key) AS n_found, sum(CASE WHEN look.word IS NOT NULL THEN ppm ELSE 0 END) ppm
         FROM m JOIN p ON p.word = m.word JOIN weight ON weight.n = p.n AND weight.word = m.word LEFT JOIN look ON look.r = m.r AND look.n = p.n AND look.word = m.word
         GROUP BY m.r, p.n, label, base, n_key, start),
ok AS (SELECT r, label, base, start, CASE WHEN base THEN 1.0 ELSE least(1.0, ppm / 1000000) END share FROM copy WHERE n_found = n_key),
f AS (SELECT r, count_if(base) n_base, min(CASE WHEN base THEN start END) first_word, max(CASE WHEN base THEN start END) last_word,
             coalesce(string_agg(DISTINCT CASE WHEN base THEN label END, ',' ORDER BY CASE WHEN base THEN label END), '') base_labels,
             string_agg(DISTINCT label, ',' ORDER BY label) labels, max(share) score, count_if(NOT base) n_copies FROM ok WHERE share >= {SHARE} GROUP BY r)
SELECT doc_id, len(w) n_words, coalesce(n_base, 0)::BIGINT n_base, first_word::BIGINT first_word, last_word::BIGINT last_word, coalesce(base_labels, '') base_labels,
       coalesce(labels, '') labels, coalesce(score, 0)::DOUBLE score, coalesce(n_copies, 0)::BIGINT n_copies FROM d LEFT JOIN f USING (r)
"""
