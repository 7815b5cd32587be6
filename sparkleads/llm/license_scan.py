"""License scans by an exact set-similarity join (DataFrame functions only).

A text block is a stretch of words twice as long as a template's span, one beginning at every multiple of the span, so a
notice of up to a span's words lies whole in one block. A block meets a template if it holds at least `THRESHOLD` of the
template's distinct words. Words are ordered by how often the corpus has them, rarest first. In that order a template
that needs `a` of its `n` words must share one of its first n - a + 1 with the block, the prefix; a block with fewer than `a`
words of any template is too short; and the positions of the last common prefix word on either side bound what may still follow.
What passes these filters is compared exactly. Only blocks around prefix words are ever made, next to their text, so no text is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, left_join_any, scratch, text_id, written

# The base phrases and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Opening sentences of public licenses and the usual one-line notices, by label.
TEMPLATES = [
    ("agpl", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "the author has waived all copyright and related or neighboring rights to this work to the extent possible under law"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

#: Share of a template's distinct words that a block must hold.
THRESHOLD = 0.9
#: Least span of a template, in words; spans are powers of two.
LEAST_SPAN = 8
#: Whatever isn't part of a word, after A-Z are lower-cased.
GAPS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


@dataclass(frozen=True)
class Template:
    """A label, the template's distinct words, how many of them a block must hold, and its span."""

    label: str
    words: tuple[str, ...]
    least: int
    span: int


def template(label: str, text: str, threshold: float = THRESHOLD) -> Template:
    """The template of a notice; its words are the ASCII ones, lower-cased."""
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in text).lower().split()
    distinct = tuple(sorted(set(words)))
    return Template(label, distinct, math.ceil(round(threshold * len(distinct), 6)), max(LEAST_SPAN, 1 << (len(words) - 1).bit_length()))


def production_templates() -> list[Template]:
    return [template(label, text) for label, text in TEMPLATES]


def spaced_words(text: Column) -> Column:
    """The words of a text, lower-cased and joined by single spaces; "" for null."""
    return F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), GAPS, " "))


def _held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """`df` with a column that is computed once, however often the plan reads it."""
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def rarity(texts: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary of the templates, rarest in the corpus first, ties by word. `texts` has `_norm`. What comes to the driver
    is a count for each word of the templates."""
    found = texts.select(F.explode(F.filter(F.split("_norm", " ", -1), lambda w: w.isin(vocabulary))).alias("w")).groupBy("w").count()
    counts = {r["w"]: r["count"] for r in found.collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def _block(span: int, vocabulary: Column) -> Callable[[Column], Column]:
    """From a block's number to its struct."""

    def block(b: Column) -> Column:
        held = F.array_intersect(vocabulary, F.slice("_words", b * span + 1, F.lit(2 * span)))
        return F.struct(F.lit(span).alias("span"), (b * span).alias("start"), held.alias("held"))

    return block


def blocks(texts: DataFrame, templates: list[Template], order: list[str]) -> DataFrame:
    """text_id, span, start and `held` of each block with a prefix word of a template of its span: `held` are the block's words of
    such templates, rarest first."""
    place = {w: k for k, w in enumerate(order)}
    prefix = {w for t in templates for w in sorted(t.words, key=place.__getitem__)[: len(t.words) - t.least + 1]}
    marked = _held(texts.select("text_id", "_norm"), "_words", F.split("_norm", " ", -1))
    at = F.filter(F.transform("_words", lambda w, i: F.when(w.isin(sorted(prefix)), i)), lambda i: i.isNotNull())
    marked = _held(marked.select("text_id", "_words"), "_at", at).filter(F.size("_at") > 0)
    made = []
    for span in sorted({t.span for t in templates}):
        vocabulary = F.array(*[F.lit(w) for w in order if any(w in t.words for t in templates if t.span == span)])
        own = F.transform("_at", lambda i: F.floor(i / span).cast("int"))
        numbers = F.array_union(own, F.filter(F.transform(own, lambda b: b - 1), lambda b: b >= 0))

        made.append(F.transform(numbers, _block(span, vocabulary)))
    return marked.select("text_id", F.explode_outer(F.concat(*made)).alias("x")).select("text_id", "x.*").filter("held IS NOT NULL")


def template_matches(texts: DataFrame, templates: list[Template]) -> DataFrame:
    """text_id, span, start, label and containment of each pair of a block and a template that meet the threshold. `texts`: text_id, _norm."""
    spark = texts.sparkSession
    order = rarity(texts, sorted({w for t in templates for w in t.words}))
    place = {w: k for k, w in enumerate(order)}
    ordered = [sorted(t.words, key=place.__getitem__) for t in templates]
    right = spark.createDataFrame(
        [(k, t.label, t.span, len(t.words), t.least, w, i, o) for k, (t, o) in enumerate(zip(templates, ordered, strict=True)) for i, w in enumerate(o[: len(o) - t.least + 1])],
        "template int, label string, span int, n int, least int, word string, i int, words array<string>",
    )
    shortest = {span: min(t.least for t in templates if t.span == span) for span in {t.span for t in templates}}
    most = F.lit(0)
    for span, least in shortest.items():
        most = F.when(F.col("span") == span, F.size("held") - least + 1).otherwise(most)
    # Length filter for the shortest template of the span, then the words that may be the first in common.
    left = blocks(texts, templates, order).withColumn("_most", most).filter("_most > 0")
    left = left.select("text_id", "span", "start", "held", F.posexplode(F.slice("held", F.lit(1), F.col("_most"))).alias("j", "word"))
    # As many rows as templates have prefix words: a parameter's size, so it is broadcast.
    met = left.join(F.broadcast(right), ["span", "word"]).filter((F.size("held") >= F.col("least")) & (F.col("j") <= F.size("held") - F.col("least")))
    pair = ["text_id", "span", "start", "template"]
    pairs = met.groupBy(*pair).agg(
        F.count(F.lit(1)).alias("c"), F.max("i").alias("i"), F.max("j").alias("j"), *[F.first(x).alias(x) for x in ("held", "words", "label", "n", "least")]
    )
    possible = pairs.filter(F.col("c") + F.least(F.col("n") - 1 - F.col("i"), F.size("held") - 1 - F.col("j")) >= F.col("least"))
    shared = possible.withColumn("shared", F.size(F.array_intersect("words", "held"))).filter("shared >= least")
    return shared.select("text_id", "span", "start", "label", (F.col("shared") / F.col("n")).alias("containment"))


def _words_in(piece: Column) -> Column:
    """Words of a stretch in which each word has a space on both sides."""
    return ((F.char_length(piece) - F.char_length(F.replace(piece, F.lit(" "), F.lit("")))) / 2).cast("long")


def base_statistics(df: DataFrame, phrases: dict[str, str]) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word and base_labels; `df` has `_norm`. Phrases are words that don't overlap themselves."""
    n_words = F.when(F.col("_norm") == "", 0).otherwise(F.char_length("_norm") - F.char_length(F.replace("_norm", F.lit(" "), F.lit(""))) + 1).cast("long")
    df = _held(df.withColumn("n_words", n_words), "_spaced", F.concat(F.lit(" "), F.replace("_norm", F.lit(" "), F.lit("  ")), F.lit(" ")))
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases.items():
        needle = f" {phrase.replace(' ', '  ')} "
        there, pieces = F.contains("_spaced", F.lit(needle)), F.split("_spaced", needle, -1)
        counts.append(F.when(there, F.size(pieces) - 1).otherwise(0))
        firsts.append(F.when(there, _words_in(F.get(pieces, F.lit(0)))))
        lasts.append(F.when(there, F.col("n_words") - _words_in(F.element_at(pieces, -1)) - len(phrase.split(" "))))
        labels.append((label, there))
    total = counts[0]
    for c in counts[1:]:
        total = total + c
    by_label = {label: [there for other, there in labels if other == label] for label, _ in labels}
    named = [F.when(F.array_contains(F.array(*by_label[label]), True), label) for label in sorted(by_label)]
    return df.select(
        *[c for c in df.columns if c != "_spaced"], total.cast("long").alias("n_base"), F.least(*firsts, F.lit(None).cast("long")).alias("first_word"),
        F.greatest(*lasts, F.lit(None).cast("long")).alias("last_word"), F.concat_ws(",", *named).alias("base_labels"),
    )


def scanned(docs: DataFrame, templates: list[Template] | None = None, phrases: dict[str, str] = BASE_PHRASES, text: str = "text") -> DataFrame:
    """Every row of `docs` with n_words, n_base, first_word, last_word, base_labels, labels and score.

    Labels are those of base phrases and of templates that some block meets, distinct, sorted and comma-joined; the score is 1 with a base
    phrase, else the best containment, else 0. Null texts are empty: no words, nulls for the places, empty strings, score 0. Repeated rows
    stay, each with its result; columns with the added names are replaced; an empty table gives no rows.
    """
    templates = production_templates() if templates is None else templates
    added = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    rows = docs.drop(*added).withColumn("_text_id", text_id(F.col(f"`{text}`")))
    normal = _held(docs.select(text_id(F.col(f"`{text}`")).alias("text_id"), F.col(f"`{text}`").alias("_text")), "_norm", spaced_words(F.col("_text"))).drop("_text")
    found = template_matches(normal, templates).groupBy("text_id").agg(F.collect_set("label").alias("_labels"), F.max("containment").alias("_best"))
    found = written(found.withColumnRenamed("text_id", "_text_id"), scratch(docs.sparkSession), "licenses")
    counted = base_statistics(_held(rows, "_norm", spaced_words(F.col(f"`{text}`"))), phrases).drop("_norm")
    out = left_join_any(counted, found, "_text_id")
    split = F.when(F.col("base_labels") == "", F.array().cast("array<string>")).otherwise(F.split("base_labels", ",", -1))
    none = F.array().cast("array<string>")
    return out.withColumn("labels", F.array_join(F.array_sort(F.array_union(split, F.coalesce("_labels", none))), ",")).withColumn(
        "score", F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("_best", F.lit(0.0)))
    ).drop("_text_id", "_labels", "_best")
