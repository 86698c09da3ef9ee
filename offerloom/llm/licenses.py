"""License statements by an exact set-similarity join on text blocks, in DataFrame expressions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.llm.common import ascii_lower, once, pick

#: Words are runs of 0-9, a-z and characters beyond ASCII.
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
# The base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Usual license statements, by label; a block that holds most of their words is labelled.
TEMPLATES = [
    ("agpl", "This program is free software under the terms of the GNU Affero General Public License version 3"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]
CONTAINED = 0.8
# Consecutive words without which a template of TEMPLATES, in the same order, is not held, whatever its share.
KEYS = [
    ["gnu affero general public license"], [], ["in compliance with the license"], ["unless required by applicable law"], ["redistribution and use"],
    ["attribution 4 0"], [], [], ["gnu general public license", "version 3"], ["gnu general public license"], ["fee"], ["gnu lesser general public license"],
    [], ["free of charge", "any person"], ["mozilla public license"]]
#: Templates of so few words are held only whole (in license_statements, their words consecutive).
WHOLE = 9
#: Windows of WINDOW words begin every STEP words: a statement of at most WINDOW - STEP words lies in one.
WINDOW, STEP = 64, 32


def _words(text: str) -> list[str]:
    return [w for w in re.split(GAP, text.lower()) if w]


def _spaced(text: Column) -> Column:
    """A lower-cased text as words with one space around each."""
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(ascii_lower(text), GAP, " ")), F.lit(" "))


def token_order(docs: DataFrame, templates=TEMPLATES) -> list[str]:
    """The words of the templates, rarest in the corpus first.

    Blocks (lines) that hold a word are counted over all documents, aggregated map-side; the result
    has one row per template word, however large the corpus. Ties go by code point.
    """
    vocabulary = sorted({w for _, text in templates for w in _words(text)})
    literal = F.array(*[F.lit(w) for w in vocabulary])
    blocks = pick(docs, "text").select(F.explode(F.split("text", "\n", -1)).alias("block"))
    seen = blocks.select(F.explode(F.array_intersect(literal, F.split(_spaced(F.col("block")), " "))).alias("w"))
    counts = {r.w: r.n for r in seen.groupBy("w").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def _needed(text: str, threshold: float) -> int:
    """How many distinct words of a template a block must have: all of a short one, else the share."""
    size = len(set(_words(text)))
    return size if len(_words(text)) <= WHOLE else -int(-threshold * size // 1)


def _template_literals(order: list[str], threshold: float, templates, keys) -> Column:
    """One struct per template: its distinct words in global order, the overlap it needs, its prefix and its keys.

    A block that shares ``need`` words with the template shares at least one of its first
    size - need + 1 words, the prefix.
    """
    rank = {w: i for i, w in enumerate(order)}
    structs = []
    for (label, text), needed in zip(templates, keys, strict=True):
        words = sorted(set(_words(text)), key=rank.__getitem__)
        need = _needed(text, threshold)
        prefix = words[: len(words) - need + 1]
        structs.append(F.struct(
            F.lit(label).alias("label"), F.array(*map(F.lit, words)).alias("words"), F.lit(need).alias("need"),
            F.array(*map(F.lit, prefix)).alias("prefix"), F.array(*[F.lit(f" {k} ") for k in needed]).cast("array<string>").alias("keys")))
    return F.array(*structs)


def _template_hits(text: Column, order: list[str], threshold: float, templates, keys) -> Column:
    """``label, share`` of every template that a block of the text holds.

    The words of a block that no template has come first in the order and can match nothing, so a
    block is its template words in global order. Length filter: it has at least ``need`` of them.
    Prefix filter: it shares a word of the prefix. Positional filter: from the first shared prefix
    word on, both sides still have ``need`` words. Survivors are verified by their full overlap, and by
    the template's keys, which tell it from statements that resemble it.
    """
    vocabulary, literals = F.array(*map(F.lit, order)), _template_literals(order, threshold, templates, keys)
    fewest = min(_needed(t, threshold) for _, t in templates)

    def of_block(row: Column) -> Column:
        block = row["words"]

        def candidate(t: Column) -> Column:
            first = F.get(F.array_intersect(t["prefix"], block), F.lit(0))
            left = F.least(F.size(t["words"]) - F.array_position(t["words"], first), F.size(block) - F.array_position(block, first)) + 1
            return (F.size(block) >= t["need"]) & F.arrays_overlap(t["prefix"], block) & (left >= t["need"]) & (
                F.size(F.array_intersect(t["words"], block)) >= t["need"]) & F.forall(t["keys"], lambda k: F.contains(row["line"], k))

        found = F.filter(literals, candidate)
        return F.transform(found, lambda t: F.struct(t["label"].alias("label"), (F.size(F.array_intersect(t["words"], block)) / F.size(t["words"])).alias("share")))

    blocks = F.transform(F.split(text, "\n", -1), lambda line: once(
        _spaced(line), lambda s: F.struct(s.alias("line"), F.array_intersect(vocabulary, F.split(s, " ")).alias("words"))))
    return F.flatten(F.transform(F.filter(blocks, lambda b: F.size(b["words"]) >= fewest), of_block))


def scan_licenses(docs: DataFrame, threshold: float = CONTAINED, phrases=PHRASES, templates=TEMPLATES, keys=KEYS) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of every document.

    One pass counts the template words over the corpus; the second is map-only: every document is
    compared with the templates, a constant of the code, so nothing is shuffled and no key is hot.
    A text block is a line; a template is contained when the block holds ``threshold`` of its distinct
    words (all of them, if it has WHOLE words or fewer) and, word by word, each of its ``keys``. Base phrases are counted wherever their words stand consecutively, across lines too.
    score: 1 for a base phrase, else the largest share of a template found, else 0.

    A null text is empty: no words, null positions, empty labels and score 0. Repeated rows and null
    ids are scanned row by row; an empty table gives no rows.
    """
    order = token_order(docs, templates)
    rows = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.inline(F.array(F.struct(_spaced(F.col("text")).alias("flat")))))

    def places(flat: Column) -> Column:
        """Per phrase that occurs: label, number of places, first and last word."""
        per_phrase = []
        for phrase, label in phrases.items():
            parts = F.split(flat, f"(?<= ){re.escape(phrase)}(?= )", -1)
            here = once(parts, lambda p: F.struct(
                F.lit(label).alias("label"), (F.size(p) - 1).cast("long").alias("n"), _count(p[0]).alias("first"),
                (_count(flat) - _count(F.element_at(p, -1)) - len(phrase.split())).alias("last")))
            per_phrase.append(F.when(F.contains(flat, F.lit(f" {phrase} ")), here))
        return F.filter(F.array(*per_phrase), lambda p: p.isNotNull())

    n_words = _count(F.col("flat"))
    base = rows.select(
        "doc_id", n_words.alias("n_words"), F.inline(F.array(F.struct(
            places(F.col("flat")).alias("places"), _template_hits(F.col("text"), order, threshold, templates, keys).alias("hits")))))
    base_labels = F.array_distinct(F.transform("places", lambda p: p["label"]))
    all_labels = F.array_distinct(F.concat(F.transform("places", lambda p: p["label"]), F.transform("hits", lambda h: h["label"])))
    best = F.coalesce(F.array_max(F.transform("hits", lambda h: h["share"])), F.lit(0.0))
    return base.select(
        "doc_id", "n_words", F.aggregate("places", F.lit(0).cast("long"), lambda n, p: n + p["n"]).alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["first"])).alias("first_word"), F.array_max(F.transform("places", lambda p: p["last"])).alias("last_word"),
        F.array_join(F.sort_array(base_labels), ",").alias("base_labels"), F.array_join(F.sort_array(all_labels), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"))


def license_statements(docs: DataFrame, threshold: float = CONTAINED, templates=TEMPLATES, keys=KEYS) -> DataFrame:
    """``doc_id, labels, score`` of every document: the license statements it holds, however they are wrapped.

    Blocks are overlapping word windows of bounded length over the whole text, so line breaks and comment
    signs do not matter. A short template must stand there whole; another one needs ``threshold`` of
    its distinct words in one window, and there its distinguishing words too, so a statement does not get the label
    of a license that it resembles. score: the largest share of a template held. One map-only pass; windows are
    made only where all distinguishing words of a template occur.
    """
    rows = pick(docs, "doc_id", "text").select("doc_id", F.inline(F.array(F.struct(_spaced(F.coalesce("text", F.lit(""))).alias("flat")))))
    words = F.split(F.btrim("flat"), " ")
    starts = F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)), F.lit(STEP))
    windows = once(words, lambda w: F.transform(starts, lambda i: F.slice(w, i, WINDOW)))
    found = []
    for (label, text), needed in zip(templates, keys, strict=True):
        held, parts = sorted(set(_words(text))), _words(text)
        if len(parts) <= WHOLE:
            share = F.when(F.contains("flat", F.lit(f" {' '.join(parts)} ")), 1.0)
        else:
            here = _all(F.contains("flat", F.lit(f" {key} ")) for key in needed)
            best = F.when(here, F.array_max(F.transform(windows, _share_in(held, needed))))
            share = F.when(best >= threshold, best)
        found.append(F.struct(F.lit(label).alias("label"), share.alias("share")))
    hits = rows.select("doc_id", F.filter(F.array(*found), lambda h: h["share"].isNotNull()).alias("hits"))
    return hits.select(
        "doc_id", F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["label"]))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["share"])), F.lit(0.0)).alias("score"))


def _share_in(held: list[str], needed: list[str]):
    """Share of the words of a template that a window holds; null without all distinguishing words."""
    def share(window: Column) -> Column:
        near = F.concat(F.lit(" "), F.array_join(window, " "), F.lit(" "))
        keyed = _all(F.contains(near, F.lit(f" {key} ")) for key in needed)
        return F.when(keyed, F.size(F.array_intersect(window, F.array(*map(F.lit, held)))) / len(held))

    return share


def _all(conditions) -> Column:
    out = F.lit(True)
    for condition in conditions:
        out = out & condition
    return out


def _count(part: Column) -> Column:
    return F.regexp_count(part, F.lit("[^ ]+")).cast("long")
