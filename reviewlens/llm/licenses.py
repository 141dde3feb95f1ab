"""License scans with a positional rare-token index.

The index posts every licence word of the templates (all their words but the
function words) with template and position. One pass over the texts keeps, for
texts that hold licence words, where these stand, and which mandatory key
phrases occur. Document frequencies of the licence words over the whole corpus
give their IDF. A place p of a word posted at t votes for the offset p - t, and
votes of one template at one offset add their IDF. A template whose votes reach
``least_share`` of its weight from at least two places, and whose key phrase
the text holds, gives its label.

Rare words pick the (template, offset) pairs and all posted words verify them:
a template's rarest postings that weigh more than 1 - ``least_share`` of it are
its probes, so an offset without a probe cannot reach the share and is left
out without loss. What else a text holds does not matter.

The vocabulary, and with it the frequencies, the postings and all that is
broadcast, is bounded by the templates and not by the corpus. Texts never
shuffle; votes are grouped by text, so no group exceeds one text's own words.

Base places are the fixed phrases' words standing consecutively. Everything is
DataFrame expressions. Defined results: a null, empty or wordless text has no
words, places or labels and score 0; repeated rows are scanned each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .common import running, text_or_empty, written

#: phrase and label (fixed values)
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: label, template, mandatory key phrase
TEMPLATES = (
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "public license version 3"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", "public license version 2"),
    ("gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public license "
            "as published by the free software foundation", "gnu general public license"),
    ("lgpl", "redistribute it and or modify it under the terms of the gnu lesser general public license",
     "lesser general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in "
                   "compliance with the license", "in compliance with the license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files", "granted free of charge"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met", "source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted", "with or without fee"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0",
     "mozilla public license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution international license",
     "creative commons attribution"),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     "unencumbered software"),
)
#: Words too common to post.
FUNCTION_WORDS = frozenset("a an and any are as at be by can except for from in into is it may not of on or that the "
                           "this to use with without you 0 2 3 4 v".split())
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def postings() -> list[tuple[str, int, int]]:
    """(word, template, position)."""
    return [(w, t, i) for t, (_, text, _) in enumerate(TEMPLATES)
            for i, w in enumerate(text.split()) if w not in FUNCTION_WORDS]


def word_line(text: Column) -> Column:
    """The words of a text, one blank apart. (lower() also changes letters
    beyond A-Z, but never whether a character belongs to a word, and none of
    those becomes a letter of a phrase.)"""
    return F.trim(F.regexp_replace(F.lower(text), GAPS, " "))


def n_blanks(x: Column) -> Column:
    return F.char_length(x) - F.char_length(F.replace(x, F.lit(" "), F.lit("")))


def places(line: Column, phrase: str) -> Column:
    """Word indices where a phrase starts: words before it, counted by the
    blank in front of each."""
    n = len(phrase.split())
    found = let(F.split(line, f" {phrase}(?= )", -1), lambda pieces: F.transform(
        running(F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda piece: n_blanks(piece) + n)), lambda end: end - n))
    return F.when(line.contains(f" {phrase} "), found).otherwise(F.array().cast("array<int>"))


def scan(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One pass over the texts: (row, id, n_words, base, words, hits, keys)."""
    vocabulary = sorted({w for w, _, _ in postings()})
    vocab = F.array(*[F.lit(w) for w in vocabulary])
    line = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                     word_line(text_or_empty(text_col)).alias("line"))
    line = line.withColumn("list", F.split("line", " ")).withColumn("words", F.array_intersect("list", vocab))
    some = F.size("words") > 0
    hits = F.filter(F.transform("list", lambda w, i: F.struct(w.alias("word"), i.alias("pos"))),
                    lambda x: F.array_contains(F.col("words"), x["word"]))
    padded = F.concat(F.lit(" "), F.col("line"), F.lit(" "))
    keys = F.filter(F.array(*[F.when(padded.contains(f" {key} "), F.lit(t)) for t, (_, _, key) in enumerate(TEMPLATES)]),
                    lambda t: t.isNotNull())
    return line.select(
        "row", "id", F.when(F.col("line") == "", 0).otherwise(n_blanks(F.col("line")) + 1).cast("long").alias("n_words"),
        F.array(*[places(padded, phrase) for phrase, _ in BASE]).alias("base"), "words",
        F.when(some, hits).alias("hits"), F.when(some, keys).alias("keys"))


def probes(posted: list[tuple[str, int, int]], idf: dict[str, float], least_share: float) -> set[tuple[str, int, int]]:
    """Each template's rarest postings, as many as weigh more than
    1 - ``least_share`` of it."""
    out: set[tuple[str, int, int]] = set()
    for t in range(len(TEMPLATES)):
        mine = sorted((p for p in posted if p[1] == t), key=lambda p: (-idf[p[0]], p))
        total, got = sum(idf[p[0]] for p in mine), 0.0
        for p in mine:
            if got > (1 - least_share) * total + 1e-6:
                break
            out.add(p)
            got += idf[p[0]]
    return out


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  least_share: float = 0.6) -> DataFrame:
    """(id, n_words, base, base_labels, labels, score) of every row; ``base``
    has the places of each base phrase, the labels are sorted arrays."""
    spark = df.sparkSession
    rows = written(scan(df, id_col, text_col), "licenses")
    seen = dict(rows.select(F.explode("words").alias("w")).groupBy("w").count().collect())  # the vocabulary at most
    total, posted = rows.count(), postings()
    idf = {w: math.log((total + 1) / (seen.get(w, 0) + 1)) + 1 for w, _, _ in posted}
    weight = [sum(idf[w] for w, t, _ in posted if t == i) for i in range(len(TEMPLATES))]
    rare = probes(posted, idf, least_share)
    index = F.broadcast(spark.createDataFrame(
        [(w, t, i, idf[w], weight[t], TEMPLATES[t][0], (w, t, i) in rare) for w, t, i in posted],
        "word string, template int, at int, idf double, weight double, label string, probe boolean"))
    votes = (rows.filter(F.size("keys") > 0).select("row", "keys", F.explode("hits").alias("h"))
             .select("row", "keys", "h.word", "h.pos").join(index, "word").filter(F.array_contains("keys", F.col("template")))
             .groupBy("row", "template", "label", (F.col("pos") - F.col("at")).alias("offset"))
             .agg((F.sum("idf") / F.first("weight")).alias("share"), F.count(F.lit(1)).alias("n"), F.max("probe").alias("picked")))
    own = (votes.filter(F.col("picked") & (F.col("n") >= 2) & (F.col("share") >= least_share)).groupBy("row")
           .agg(F.collect_set("label").alias("own"), F.max("share").alias("share")))
    base_labels = F.array_compact(F.array(*[F.when(F.size(F.col("base")[i]) > 0, F.lit(label))
                                            for i, (_, label) in enumerate(BASE)]))
    rows = rows.select("row", "id", "n_words", "base", F.array_sort(F.array_distinct(base_labels)).alias("base_labels"))
    floor = F.when(F.size("base_labels") > 0, F.lit(0.5)).otherwise(F.lit(0.0))  # a bare phrase
    labels = F.concat("base_labels", F.coalesce("own", F.array().cast("array<string>")))
    return rows.join(own, "row", "left").select(
        "id", "n_words", "base", "base_labels", F.array_sort(F.array_distinct(labels)).alias("labels"),
        F.greatest(floor, F.least(F.coalesce("share", F.lit(0.0)), F.lit(1.0))).alias("score"))
