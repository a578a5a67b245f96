"""License scans: exact set-similarity join of text blocks with license templates.

A block is a run of at most ``RUN_LINES`` consecutive lines of a document, a set of words, so a license
is found on one line as well as wrapped. A template is found where at least ``threshold`` of its distinct
words stand in the block. As a run holds what its parts hold, only runs of full length are tried, one
from each line on. Texts are cut into words once: what is stored, counted and joined are the template
words of each line. The join is exact and pruned three ways under one global order of words, rarest first:

* prefix: a block that holds ceil(t*|T|) words of T holds one of T's first
  |T| - ceil(t*|T|) + 1 words, so only those are joined, and only runs around a line with such
  a word are built;
* length: a block with fewer template words than ceil(t*|T|) cannot match;
* position: after the first shared word, the words left on both sides bound the overlap.

Templates are a parameter of fixed size; they are the only data that is broadcast.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formatpulse.llm.common import KEY, WORD, fold, text_key
from formatpulse.session import store

#: Lines of a block at most.
RUN_LINES = 6

#: Phrase -> label, found as consecutive words anywhere in the text.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: Label -> template texts of the similarity join.
TEMPLATES = {
    "apache": ["Licensed under the Apache License, Version 2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are"
            " permitted provided that the following conditions are met"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0"],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike License"],
    "gnu": ["This work is licensed under the GNU General Public License, version 3"],
    "mit": ["Released under the MIT License",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
            " software and associated documentation files, to deal in the Software without"
            " restriction"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License"],
}


def template_words(text: str) -> list[str]:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return sorted(set(re.findall(WORD, lowered)))


def _places(words: Column, phrase: str) -> Column:
    """Starts of the phrase in an array of words."""
    parts = phrase.split(" ")

    def here(i: Column) -> Column:
        cond = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            cond = cond & (F.get(words, i + k) == part)
        return F.coalesce(cond, F.lit(False))

    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)


def base_scan(docs: DataFrame, phrases: dict[str, str]) -> DataFrame:
    """Word counts and phrase places; only texts that a linear pattern accepts get their word
    array built."""
    gap = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    maybe = "|".join(p.replace(" ", gap) for p in phrases)
    one = docs.select("doc_id", fold(F.col("text")).alias("__low"), *text_key(F.col("text")))
    one = one.withColumn("n_words", F.regexp_count("__low", F.lit(WORD)).cast("long"))
    one = one.withColumn("__words", F.when(
        F.col("__low").rlike(maybe), F.regexp_extract_all("__low", F.lit(WORD), F.lit(0))))
    found = F.array(*[
        F.struct(F.lit(label).alias("label"), _places(F.col("__words"), phrase).alias("at"))
        for phrase, label in phrases.items()])
    one = one.withColumn("__found", F.when(
        F.size("__words") > 0, F.filter(found, lambda x: F.size(x["at"]) > 0)))
    places = F.flatten(F.transform("__found", lambda x: x["at"]))
    labels = F.coalesce(F.transform("__found", lambda x: x["label"]), F.array().cast("array<string>"))
    return one.select(
        "doc_id", *KEY, "n_words",
        F.greatest(F.size(places), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(labels)).alias("__base"))


def lines(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """A row per line that holds a word of ``vocabulary``, with those words."""
    line = docs.select(*text_key(F.col("text")), F.posexplode(
        F.split(fold(F.col("text")), "\n")).alias("line", "__line"))
    listed = F.array(*[F.lit(w) for w in vocabulary])
    words = F.regexp_extract_all(F.col("__line"), F.lit(WORD), F.lit(0))
    # copies of a text have the same lines
    return line.select(*KEY, "line", F.array_intersect(listed, words).alias("tokens")).where(
        F.size("tokens") > 0)


def runs(held: DataFrame, anchors: list[str], order: list[str], run_lines: int = RUN_LINES) -> DataFrame:
    """(key, block, tokens) of the runs of full length, named by their first line, that hold a line with one of
    ``anchors``; tokens stand in ``order``."""
    near = held.where(F.arrays_overlap("tokens", F.array(*[F.lit(w) for w in anchors])))
    starts = near.select(*KEY, F.explode(F.sequence(
        F.greatest(F.col("line") - (run_lines - 1), F.lit(0)), F.col("line"))).alias("block")).distinct()
    wanted = starts.select(*KEY, "block", F.explode(F.sequence(
        F.col("block"), F.col("block") + (run_lines - 1))).alias("line"))
    found = wanted.join(held, [*KEY, "line"]).groupBy(*KEY, "block").agg(
        F.flatten(F.collect_list("tokens")).alias("tokens"))  # run_lines lines of the vocabulary's words at most
    return found.withColumn("tokens", F.array_intersect(F.array(*[F.lit(w) for w in order]), F.col("tokens")))


def block_matches(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES,
                  threshold: float = 0.8, run_lines: int = RUN_LINES) -> DataFrame:
    """(text key, block, label, template, overlap, containment) of every matching run of full length."""
    spark = docs.sparkSession
    sets = [(label, k, ws) for label, texts in sorted(templates.items())
            for k, ws in enumerate(map(template_words, texts)) if ws]
    vocabulary = sorted({w for *_, ws in sets for w in ws})
    cut = lines(docs, vocabulary)
    held = store(cut.groupBy(*KEY, "line", "tokens").agg(F.count("*").alias("n")), "lines")
    counts = {r["word"]: r["n"] for r in held.select("n", F.explode("tokens").alias("word")).groupBy("word").agg(
        F.sum("n").alias("n")).collect()}  # a row a word of the templates
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    index = []
    for label, k, ws in sets:
        ws = sorted(ws, key=rank.__getitem__)
        need = max(1, math.ceil(threshold * len(ws) - 1e-9))
        index += [(w, i, label, k, need, ws) for i, w in enumerate(ws[: len(ws) - need + 1])]
    prefixes = spark.createDataFrame(
        index, "word string, at int, label string, template int, need int, wanted array<string>")
    blocks = runs(held.select(*KEY, "line", "tokens"), sorted({row[0] for row in index}), order, run_lines)
    probe = blocks.select(*KEY, "block", "tokens", F.posexplode("tokens").alias("pos", "word"))
    left = F.least(F.size("wanted") - F.col("at"), F.size("tokens") - F.col("pos"))
    hits = (probe.join(F.broadcast(prefixes), "word")
            .where((F.size("tokens") >= F.col("need")) & (left + F.least("at", "pos") >= F.col("need")))
            .withColumn("shared", F.array_intersect("wanted", "tokens"))
            # the first shared word alone reports the pair
            .where((F.get("shared", F.lit(0)) == F.col("word"))
                   & (F.size("shared") >= F.col("need"))))
    return hits.select(*KEY, "block", "label", "template", F.size("shared").alias("overlap"),
                       (F.size("shared") / F.size("wanted")).alias("containment"))


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES,
                  templates: dict[str, list[str]] = TEMPLATES, threshold: float = 0.8,
                  run_lines: int = RUN_LINES) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, n_blocks.

    Null and empty texts have no words, empty labels and score 0; repeated rows give repeated
    results; an empty table gives no rows; further columns of ``docs`` are ignored. The score is
    the best containment over all blocks, and 1 where a phrase stands in the text; n_blocks counts
    the matching runs that are the last to hold their template (a run from the next line on does not).
    """
    found = block_matches(docs, templates, threshold, run_lines)
    after = Window.partitionBy(*KEY, "label", "template").orderBy("block")
    found = found.withColumn("__last", F.coalesce(F.lead("block").over(after) != F.col("block") + 1, F.lit(True)))
    matched = found.groupBy(*KEY).agg(
        F.collect_set("label").alias("__more"), F.max("containment").alias("__best"),
        F.count_distinct(F.when(F.col("__last"), F.col("block"))).alias("n_blocks"))
    both = base_scan(docs, phrases).join(matched, list(KEY), "left")
    labels = F.array_sort(F.array_union("__base", F.coalesce("__more", F.array().cast("array<string>"))))
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("__base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("__best", F.lit(0.0))).alias("score"),
        F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"))
