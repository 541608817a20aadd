r"""License scans: phrases, and an exact set-similarity join of text blocks with notice templates.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z. Two results
are joined by document:

* places where the words of a base phrase stand consecutively;
* every template whose words a window of the text contains: shared distinct words over
  the template's distinct words reach the threshold, or, for templates of up to SHORT
  distinct words, all of them are there. A window runs over as many consecutive words
  as the template has, a quarter more for long templates, and begins anywhere; line
  ends are white space, so a notice is found however it is wrapped.

The windows are found by a set-similarity join of blocks with templates:

1. The templates' words are ordered by the number of documents that have them, over
   the whole corpus, rarest first. A template of |T| words that needs ``need`` of them
   can't be met without one of its |T| - need + 1 rarest ones, its prefix.
2. A block is two spans of consecutive words, a span being the least power of two that
   holds a template's window; blocks overlap by a span, so each window lies in one.
   Only blocks with a prefix word are formed. A block's tokens are its words that
   templates of its span have, in the global order; its prefix is what is left of it
   less the least need of those templates but one.
3. Prefixes are joined. Length filter: the block has ``need`` tokens. Positional filter:
   if the first shared token stands at places i of the template and j of the block,
   no more than the lesser of |T| - i and |B| - j can be shared.
4. What is left is counted, over the block and then over its windows.

Everything is DataFrame operations. Templates are a parameter of fixed size, so
what is broadcast doesn't grow with the corpus; the corpus counts are one row per
template word. Blocks never meet other blocks, so hot passages make no hot groups.

Defined results: null text is empty (0 words, labels empty, score 0); repeated
rows each get their row; an empty table gives an empty result; further columns
play no part.
"""

from __future__ import annotations

import functools
import math
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewood.llm.common import lower_ascii, materialize

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Notices of common public licenses.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
)
THRESHOLD = 0.8
#: Templates of up to so many distinct words must be there whole.
SHORT = 16


def words_of(text: Column) -> Column:
    """The words of a lower-cased text."""
    return F.filter(F.split(text, NOT_WORD), lambda w: w != "")


class Template(NamedTuple):
    number: int
    label: str
    words: list[str]
    need: int
    window: int
    span: int


def compiled(templates: tuple[tuple[str, str], ...], threshold: float) -> list[Template]:
    """The templates' distinct words, the least overlap, the window's words and the span that holds it."""
    out = []
    for number, (label, text) in enumerate(templates):
        said = re.findall(r"[0-9a-z]+", text.lower())
        words = sorted(set(said))
        short = len(words) <= SHORT
        window = len(said) if short else math.ceil(1.25 * len(said))
        need = len(words) if short else max(1, math.ceil(len(words) * threshold - 1e-9))
        out.append(Template(number, label, words, need, window, 1 << (window - 1).bit_length()))
    return out


def literals(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def document_counts(texts: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Number of documents that have each of the words, over all texts (lowered)."""
    counted = texts.select(F.explode(F.array_intersect(literals(vocabulary), F.split("lowered", NOT_WORD))).alias("word")).groupBy("word").count()
    return {r["word"]: r["count"] for r in counted.collect()}  # at most one row per template word


def ordered(templates: list[Template], df: dict[str, int]) -> list[Template]:
    """The templates with their words in the global order, rarest first."""
    return [t._replace(words=sorted(t.words, key=lambda w: (df.get(w, 0), w))) for t in templates]


def prefix(t: Template) -> list[str]:
    return t.words[: len(t.words) - t.need + 1]


def blocks_of(texts: DataFrame, templates: list[Template], df: dict[str, int]) -> DataFrame:
    """(row, span, block, words, tokens) of the blocks with a prefix word; tokens in the global order."""
    parts = []
    for span in sorted({t.span for t in templates}):
        own = [t for t in templates if t.span == span]
        wanted = literals(sorted({w for t in own for w in prefix(t)}))
        vocabulary = literals(sorted({w for t in own for w in t.words}, key=lambda w: (df.get(w, 0), w)))
        least = min(t.need for t in own)
        marked = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.array_contains(wanted, F.get("words", i)))
        # A word stands in the block of its span and in the one before.
        numbers = F.array_distinct(F.flatten(F.transform(marked, lambda i: F.filter(F.array(F.floor(i / span).cast("int"), F.floor(i / span).cast("int") - 1), lambda k: k >= 0))))
        met = texts.where((F.size("words") > 0) & F.arrays_overlap("words", wanted)).select("row", "words", F.explode(numbers).alias("block"))
        cut = met.select("row", F.lit(span).alias("span"), "block", F.slice("words", F.col("block") * span + 1, F.lit(2 * span)).alias("words"))
        parts.append(cut.withColumn("tokens", F.array_intersect(vocabulary, "words")).where(F.size("tokens") >= least).withColumn("rest", F.lit(least)))
    return functools.reduce(DataFrame.unionByName, parts)


def candidates(blocks: DataFrame, templates: list[Template]) -> DataFrame:
    """The blocks with each template that the prefix, length and positional filters leave."""
    spark = blocks.sparkSession
    index = spark.createDataFrame([(t.span, w, t.number, i, len(t.words), t.need) for t in templates for i, w in enumerate(prefix(t))], "span int, token string, template int, i int, size int, need int")
    own = F.slice("tokens", 1, F.size("tokens") - F.col("rest") + 1)
    probes = blocks.select("*", F.posexplode(own).alias("j", "token"))
    met = probes.join(F.broadcast(index), ["span", "token"])
    # The first shared token stands for the pair; later ones would find it again.
    first = F.element_at(F.array_intersect("tokens", "ranked"), 1) == F.col("token")
    ranked = spark.createDataFrame([(t.number, t.words, t.window) for t in templates], "template int, ranked array<string>, window int")
    pairs = met.where("size(tokens) >= need AND size - i >= need AND size(tokens) - j >= need").join(F.broadcast(ranked), "template")
    return pairs.where(first).where(F.size(F.array_intersect("tokens", "ranked")) >= F.col("need"))


def contained(texts: DataFrame, templates: list[Template], df: dict[str, int]) -> DataFrame:
    """(row, template, size, shared) of the templates that a window of a text meets; ``shared`` of its best window in a block."""
    pairs = candidates(blocks_of(texts, templates, df), templates)
    begins = F.filter(F.sequence(F.lit(1), F.size("words")), lambda i: F.array_contains("ranked", F.get("words", i - 1)))
    best = F.array_max(F.transform(begins, lambda i: F.size(F.array_intersect("ranked", F.slice("words", i, F.col("window"))))))
    return pairs.select("row", "template", "size", "need", best.alias("shared")).where("shared >= need").drop("need")


def license_scan(docs: DataFrame, threshold: float = THRESHOLD, templates: tuple[tuple[str, str], ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    texts = docs.select(docs[id_col].alias("doc_id"), lower_ascii(F.coalesce(docs[text_col], F.lit(""))).alias("lowered"))
    plain = compiled(templates, threshold)
    df = document_counts(texts, sorted({w for t in plain for w in t.words}))
    own_templates = ordered(plain, df)
    # One more pass keeps the words of the texts that can hold a phrase or a template.
    has_phrase = F.lit(False)
    for phrase in PHRASES:
        has_phrase = has_phrase | F.col("lowered").contains(phrase.split(" ")[-1])
    can_match = F.arrays_overlap("words", literals(sorted({w for t in own_templates for w in prefix(t)})))
    split = texts.withColumn("words", words_of(F.col("lowered")))
    scanned = materialize(split.select("doc_id", F.monotonically_increasing_id().alias("row"), F.size("words").cast("long").alias("n_words"), F.when(has_phrase | can_match, F.col("words")).alias("words")))
    found = contained(scanned, own_templates, df)
    labels = literals([label for label, _ in templates])
    by_row = found.groupBy("row").agg(
        F.collect_set(F.element_at(labels, F.col("template") + 1)).alias("found"),
        F.max(F.col("shared") / F.col("size")).alias("containment"),
    )
    places = F.flatten(F.array(*[phrase_places(F.col("words"), phrase.split(" "), label) for phrase, label in PHRASES.items()]))
    based = scanned.withColumn("places", F.when(F.size("words") > 0, places)).drop("words")
    starts = F.transform("places", lambda p: p["at"])
    own = F.coalesce(F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"]))), F.array().cast("array<string>"))
    out = based.join(by_row, "row", "left").withColumn("own", own)
    found_labels = F.coalesce("found", F.array().cast("array<string>"))
    n_base = F.coalesce(F.size("places"), F.lit(0))
    return out.select(
        "doc_id",
        "n_words",
        F.greatest(n_base, F.lit(0)).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join("own", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("own", found_labels)), ",").alias("labels"),
        F.when(F.size("own") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )


def phrase_places(words: Column, parts: list[str], label: str) -> Column:
    """(at, label) of every place where the phrase's words stand consecutively."""

    def here(i: Column) -> Column:
        same = F.lit(True)
        for j, part in enumerate(parts):
            same = same & F.get(words, i + F.lit(j)).eqNullSafe(F.lit(part))
        return same

    found = F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)
    return F.transform(found, lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))


def oracle() -> str:
    """DuckDB SQL of the query on documents: every window of every text that has the words somewhere."""
    rows = ", ".join(f"({t.number}, '{t.label}', {t.words!r}, {t.need}, {t.window})" for t in compiled(TEMPLATES, THRESHOLD))
    phrases = ", ".join(f"('{phrase}', '{label}')" for phrase, label in PHRASES.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS MATERIALIZED (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM d),
p(phrase, label) AS (VALUES {phrases}),
places AS (SELECT r, label, unnest(range(0, len(words))) AS i, phrase, words FROM w, p WHERE contains(t, 'license')),
base AS (SELECT r, i, label FROM places WHERE array_to_string(words[i + 1 : i + len(string_split(phrase, ' '))], ' ') = phrase),
based AS (SELECT r, count(*) AS n, min(i) AS lo, max(i) AS hi, list_distinct(list(label)) AS ls FROM base GROUP BY r),
tpl(k, label, ws, need, size) AS (VALUES {rows}),
met AS MATERIALIZED (SELECT r, label, ws, need, size, words FROM w, tpl WHERE len(list_filter(ws, lambda x: list_contains(words, x))) >= need),
best AS (SELECT r, label, ws, need, list_max(list_transform(list_filter(range(1, len(words) + 1), lambda s: list_contains(ws, words[s])),
  lambda s: len(list_filter(ws, lambda x: list_contains(words[s : s + size - 1], x))))) AS n FROM met),
hit AS (SELECT r, label, n / len(ws) AS c FROM best WHERE n >= need),
hits AS (SELECT r, list_distinct(list(label)) AS ls, max(c) AS c FROM hit GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(based.ls), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(based.ls, []), coalesce(hits.ls, [])))), ','), '') AS labels,
  CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(hits.c, 0)::DOUBLE END AS score
FROM w LEFT JOIN based USING (r) LEFT JOIN hits USING (r)
"""
