"""License notices in texts: exact set-similarity joins of text blocks with templates, and fixed phrases.

A template is a set of words.  A block meets it where it holds at least THRESHOLD of them.  Blocks are stretches of
2 * s words that begin at multiples of s, s being the least power of two that is no less than the template's word
count, so any stretch as long as the template lies whole in a block.

All tokens of templates are ordered by how often the whole corpus has them, rarest first.  A block that meets a template
of n tokens in `need` of them must hold one of its first n - need + 1 (prefix filter), so only words that are such tokens
propose blocks.  A block with fewer than `need` template tokens goes (length filter); so does one where, from the
proposing token on, too few tokens are left on either side (positional filter); the intersection of the rest is counted.
No block that meets a template is lost.

Templates, and with them the token order and the prefix index, are a parameter of bounded size; everything else is
expressions within a row and one aggregation of small rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 0.85
#: Score of a text with base phrases alone.
BASE_SCORE = 0.5

# Phrases and their labels, notices of well-known public licenses.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
]


def needed(tokens: int, threshold: float) -> int:
    """How many of a template's tokens a block must hold."""
    return max(1, math.ceil(threshold * tokens - 1e-9))


def words_of(text: Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(WORDS), F.lit(0))


def parsed(spark: SparkSession, templates: list[tuple[str, str]]) -> list[tuple[str, list[str], int]]:
    """(label, distinct tokens, stride of its blocks) of each template with words, by the engine's own word rule."""
    if not templates:
        return []
    rows = spark.createDataFrame(templates, "label string, text string").select("label", words_of(F.col("text")).alias("words")).collect()
    return [(r.label, sorted(set(r.words)), 1 << (len(r.words) - 1).bit_length()) for r in rows if r.words]


def token_order(words: DataFrame, tokens: list[str]) -> list[str]:
    """The templates' tokens, rarest in words(words) first, ties by the token; the result is as long as `tokens`."""
    if not tokens:
        return []
    held = words.select(F.explode(F.filter("words", lambda w: w.isin(tokens))).alias("token"))
    n = {r.token: r.n for r in held.groupBy("token").agg(F.count("*").alias("n")).collect()}
    return sorted(tokens, key=lambda t: (n.get(t, 0), t))


def prefix_index(spark: SparkSession, parts: list[tuple[str, list[str], int]], order: list[str], threshold: float) -> DataFrame:
    """A row per template and token of its prefix: token, template, label, stride, need, tokens, left (of the template
    from the token on) and later (tokens of all templates from the token on)."""
    rank = {t: i for i, t in enumerate(order)}
    rows = []
    for number, (label, tokens, stride) in enumerate(parts):
        ranked, need = sorted(tokens, key=rank.__getitem__), needed(len(tokens), threshold)
        rows += [(t, number, label, stride, need, ranked, len(ranked) - i, order[rank[t] :]) for i, t in enumerate(ranked[: len(ranked) - need + 1])]
    return spark.createDataFrame(rows, "token string, template int, label string, stride int, need int, tokens array<string>, left_over int, later array<string>")


def _phrases(words: Column) -> list[Column]:
    """label, places, first and last start (words) of each base phrase, by what lies between its places."""
    line = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    blanks = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
    out = []
    for phrase, label in PHRASES.items():
        parts = F.split(line, f" {phrase}(?= )", -1)
        last = F.size(words) - (blanks(F.element_at(parts, -1)) - 1) - len(phrase.split())
        some = F.size(parts) > 1
        out.append(F.struct(F.when(some, F.lit(label)).alias("label"), (F.size(parts) - 1).cast("long").alias("places"), F.when(some, blanks(parts[0])).cast("long").alias("first"), F.when(some, last).cast("long").alias("last")))
    return out


def _hits(words: Column, prefix: list[str], reach: int) -> Column:
    """Each place of a prefix token with the words up to `reach` places around it, and where those begin."""
    at = F.filter(F.transform(words, lambda w, i: F.when(w.isin(prefix), i)), lambda i: i.isNotNull())
    begin = lambda i: F.greatest(i - reach, F.lit(0))
    return F.transform(at, lambda i: F.struct(F.get(words, i).alias("token"), i.alias("at"), begin(i).alias("begin"), F.slice(words, begin(i) + 1, F.lit(2 * reach)).alias("around")))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels (arrays), score, matches for each row of docs.

    matches: struct(label, template, start, overlap, share) of every block (by its first word) that meets a template.
    score: the largest share of a template met, at least BASE_SCORE with a base phrase, else 0.  Null or empty texts have
    no words; rows that repeat come out as often; a null doc_id stays null; an empty table gives no rows.  Extra columns
    are ignored.
    """
    spark = docs.sparkSession
    parts = parsed(spark, TEMPLATES if templates is None else templates)
    vocabulary = sorted({t for _, tokens, _ in parts for t in tokens})
    words = id_text(docs).select(F.struct("doc_id", F.xxhash64("text").alias("told")).alias("kid"), words_of(F.col("text")).alias("words"))
    order = token_order(words, vocabulary)
    index = prefix_index(spark, parts, order, threshold)
    prefix = sorted({r.token for r in index.select("token").collect()})
    reach = 2 * max((s for _, _, s in parts), default=1)
    # Within rows: base phrases, and the places that propose blocks behind a first piece without one, which counts the row.
    piece = "array<struct<token:string,at:int,begin:int,around:array<string>>>"
    hits = _hits(F.col("words"), prefix, reach) if prefix else F.array().cast(piece)
    rows = words.select("kid", F.size("words").cast("long").alias("n_words"), F.array(*_phrases(F.col("words"))).alias("base"), F.concat(F.array(F.lit(None)).cast(piece), hits.cast(piece)).alias("pieces"))
    rows = rows.select("kid", "n_words", "base", F.posexplode("pieces").alias("piece", "hit"))
    # The index has at most a row per template and token.
    near = rows.join(F.broadcast(index), F.col("hit.token") == F.col("token"), "left")
    own = F.floor(F.col("hit.at") / F.col("stride")).cast("int")
    blocks = F.filter(F.array(own - 1, own), lambda b: b >= 0)
    near = near.withColumn("start", F.explode_outer(F.transform(blocks, lambda b: b * F.col("stride"))))
    block = F.slice("hit.around", F.greatest(F.col("start") - F.col("hit.begin"), F.lit(0)) + 1, F.least(F.lit(0), F.col("start") - F.col("hit.begin")) + F.lit(2) * F.col("stride"))
    near = near.withColumn("held", F.when(F.col("start").isNotNull(), F.array_intersect(block, F.array(*map(F.lit, order)).cast("array<string>"))))
    enough = (F.size("held") >= F.col("need")) & (F.least(F.col("left_over"), F.size(F.array_intersect("held", "later"))) >= F.col("need"))
    near = near.withColumn("overlap", F.when(enough, F.size(F.array_intersect("held", "tokens"))))
    match = F.when(F.col("overlap") >= F.col("need"), F.struct("label", "template", F.col("start").cast("long").alias("start"), F.col("overlap").cast("long").alias("overlap"), (F.col("overlap") / F.size("tokens")).alias("share")))
    # Equal rows come together and are dealt out again.
    got = near.groupBy("kid").agg(F.first("n_words").alias("n_words"), F.first("base").alias("base"), F.collect_set(match).alias("matches"), F.sum(F.when(F.col("piece") == 0, 1).otherwise(0)).alias("rows"))
    base = F.col("base")
    some = F.filter(base["label"], lambda x: x.isNotNull())
    n_base = sum((base[i]["places"] for i in range(1, len(PHRASES))), base[0]["places"])
    x = got.select(
        F.explode(F.array_repeat("kid", F.col("rows").cast("int"))).alias("kid"), "n_words", n_base.alias("n_base"), F.array_min(base["first"]).alias("first_word"), F.array_max(base["last"]).alias("last_word"),
        F.sort_array(some).alias("base_labels"), F.sort_array(F.array_distinct(F.concat(some, F.col("matches")["label"]))).alias("labels"),
        F.greatest(F.coalesce(F.array_max(F.col("matches")["share"]), F.lit(0.0)), F.when(F.size(some) > 0, F.lit(BASE_SCORE)).otherwise(F.lit(0.0))).alias("score"), F.sort_array("matches").alias("matches"),
    )
    return x.select(F.col("kid.doc_id").alias("doc_id"), *x.columns[1:])
