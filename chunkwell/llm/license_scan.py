"""License scans as an exact set-similarity join of text blocks with notice templates.

Templates are data: label, text and containment threshold.  A template of m words is sought in blocks of twice its class, the
power of two from ``SMALLEST`` on that m does not exceed, which start at each multiple of the class: so any run of m words, and of a few more, lies in one block.
Block and template are sets of words, ordered by their counts over all documents, rarest
first.  A template T is contained in a block B when ``|T & B| >= need = ceil(threshold * |T|)``.  Then the
join's filters hold: B has one of the first ``|T| - need + 1`` words of T (prefix); B has ``need``
words at least (length); and a match at position i of T leaves room for ``need`` common words
(position).  The join is on the prefix words; the containment is then counted exactly.

A document's words are first cut into segments of twice the largest class, which overlap by half, so that a row stays small however long its
text is; a block belongs to the segment in whose first half it starts.

Base phrases have threshold 1; an exact check then finds the places where their words stand consecutively.  Only DataFrame functions
run here.  Templates are a parameter of at most ``MOST_WORDS`` words, so their table is broadcast.

Defined cases: null or wordless texts give 0 words, no labels and score 0; repeated rows give
one row each; ids may be null; equal words of a block or a template count once; an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words_of

SMALLEST, MOST_WORDS, THRESHOLD = 8, 100_000, 0.9

#: Fixed phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices as their licences print them, with the labels of this method.
NOTICES = {
    "mit-notice": "Released under the MIT License",
    "mit-grant": "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit-warranty": "The software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache-2.0-notice": "Licensed under the Apache License Version 2.0",
    "gpl-3-notice": "This work is licensed under the GNU General Public License version 3",
    "gpl-free-software": "This program is free software you can redistribute it and or modify it under the terms of the GNU General Public License",
    "bsd-redistribution": "Redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License v 2.0",
    "cc-by-nc-notice": "Licensed under CC BY NC 4.0",
    "all-rights-reserved": "All rights reserved",
}


def template_words(text: str) -> list[str]:
    return [w for w in "".join(c if c.isalnum() else " " for c in text.lower()).split() if w]


class Template:
    def __init__(self, label: str, words: list[str], threshold: float = THRESHOLD, base: bool = False):
        self.label, self.words, self.threshold, self.base = label, words, threshold, base
        self.need = math.ceil(threshold * len(set(words)) - 1e-9)
        self.size = max(SMALLEST, 1 << (len(words) - 1).bit_length())  # its class


def templates(notices: dict[str, str] = NOTICES, threshold: float = THRESHOLD) -> list[Template]:
    """The base phrases, and a template for each notice."""
    return [Template(label, phrase.split(), 1.0, True) for phrase, label in BASE.items()] + [Template(label, w, threshold) for label, t in notices.items() if (w := template_words(t))]


def word_counts(docs: DataFrame, vocabulary: list[str], text_col: str) -> dict[str, int]:
    """Occurrences over all documents of the templates' words."""
    kept = F.filter(words_of(F.col(text_col)), lambda x: x.isin(vocabulary))
    rows = docs.select(F.explode(kept).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    return {r.word: r.n for r in rows}


def prefix_table(counts: dict[str, int], wanted: list[Template]) -> list[dict]:
    """A row for each template and each word of its prefix."""
    out = []
    for t in wanted:
        ordered = sorted(set(t.words), key=lambda w: (counts.get(w, 0), w))
        out += [{"word": w, "i": i, "label": t.label, "need": t.need, "size": t.size, "tokens": ordered, "phrase": t.words if t.base else None} for i, w in enumerate(ordered[: len(ordered) - t.need + 1])]
    return out


def places(words: Column, phrase: Column) -> Column:
    """Offsets in words where the phrase's words stand consecutively."""
    n = F.size(phrase)
    return F.filter(F.transform(words, lambda w, i: F.when((w == phrase[0]) & (F.slice(words, i + 1, n) == phrase), i)), lambda i: i.isNotNull())


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: dict[str, str] = NOTICES, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and blocks: every block that meets a notice's
    threshold, with its label, its first and last word and the share of the template that it holds."""
    spark = docs.sparkSession
    wanted = templates(notices, threshold)
    if sum(len(t.words) for t in wanted) > MOST_WORDS:
        raise ValueError(f"templates have more than {MOST_WORDS} words")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    prefixes = prefix_table(word_counts(rows, sorted({w for t in wanted for w in t.words}), "text"), wanted)
    schema = "word string, i int, label string, need int, size int, tokens array<string>, phrase array<string>"
    table = spark.createDataFrame([tuple(p.values()) for p in prefixes], schema)
    rare, step = sorted({p["word"] for p in prefixes}), max(t.size for t in wanted)

    words = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", words_of(F.col("text")).alias("w"))
    # segments: step words and the step that follows; only those with a prefix word go on
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size("w") / step).cast("int") - 1, F.lit(0)))
    cut = F.transform(starts, lambda s: F.struct((s * step).alias("base"), F.slice("w", s * step + 1, F.lit(2 * step)).alias("words")))
    parts = F.filter(cut, lambda s: F.exists(s["words"], lambda x: x.isin(rare)))
    parts = words.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), F.explode_outer(parts).alias("s")).select("row", "doc_id", "n_words", "s.base", "s.words")
    at = F.filter(F.transform("words", lambda x, i: F.when(x.isin(rare), F.struct(x.alias("word"), i.alias("at")))), lambda x: x.isNotNull())
    hits = parts.select("*", F.explode_outer(at).alias("h")).select("row", "doc_id", "n_words", "base", "words", "h.word", "h.at")

    joined = hits.join(F.broadcast(table), "word", "left")
    # word `at` lies in the block that starts at its multiple of the class, and in the one before
    own = (F.col("at") / F.col("size")).cast("int") * F.col("size")
    blocks = F.filter(F.array(own, own - F.col("size")), lambda b: (b >= 0) & (b < step))
    joined = joined.withColumn("b", F.explode_outer(blocks))
    joined = joined.withColumn("block", F.when(F.col("b").isNotNull(), F.slice("words", F.coalesce("b", F.lit(0)) + 1, F.coalesce(2 * F.col("size"), F.lit(1))))).drop("words")
    possible = (F.size(F.array_distinct("block")) >= F.col("need")) & (F.size("tokens") - F.col("i") >= F.col("need"))  # length and position
    joined = joined.withColumn("common", F.when(F.col("b").isNotNull() & possible, F.size(F.array_intersect("tokens", "block"))).otherwise(0))
    joined = joined.withColumn("matched", (F.col("common") >= F.col("need")) & (F.col("common") > 0))
    # the exact check of base phrases; blocks overlap, so places are kept as a set
    first = (F.col("base") + F.col("b")).cast("long")
    is_base = F.col("phrase").isNotNull()
    starts = F.when(F.col("matched") & is_base, F.transform(places(F.col("block"), F.col("phrase")), lambda i: F.struct((first + i).alias("at"), F.col("label").alias("label"))))
    label = F.when(F.col("matched") & (~is_base | (F.size("starts") > 0)), F.col("label"))
    share = F.col("common") / F.size("tokens")
    block = F.when(F.col("matched") & ~is_base, F.struct(F.col("label").alias("label"), first.alias("first_word"), (first + F.size("block") - 1).alias("last_word"), share.alias("share")))
    scored = joined.withColumn("starts", starts).select("row", "doc_id", "n_words", "starts", label.alias("found"), F.when(label.isNotNull(), share).otherwise(0.0).alias("share"), block.alias("block"))
    out = scored.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_set("starts"))).alias("at"),
        F.array_sort(F.collect_set("found")).alias("labels"),
        F.max("share").alias("score"),
        F.array_sort(F.collect_set("block")).alias("blocks"),
    )
    offsets, base_labels = F.transform("at", lambda x: x["at"]), F.array_sort(F.array_distinct(F.transform("at", lambda x: x["label"])))
    return out.select(
        "doc_id",
        "n_words",
        F.size("at").cast("long").alias("n_base"),
        F.array_min(offsets).alias("first_word"),
        F.array_max(offsets).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        F.col("score"),
        F.col("blocks"),
    )
