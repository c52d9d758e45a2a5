"""License scans: phrases of licenses, and an exact set-similarity join of text blocks with license notices.

A template is the word set of a license notice. Its blocks are windows of the text's words, whatever lines these stand in:
windows of 2 m words that start every m words, m being the notice's number of words rounded up to a power of two. So each m
consecutive words lie in some block, and a block of a long line without breaks holds no more words than any other. A block
meets a template if it holds at least the share t of the template's words. The join is exact and has the usual filters. One
global order of words, from rare to frequent, comes from counts over all documents. Of a template with a = ceil(t |T|)
words needed, the first |T| - a + 1 in that order are its prefix: a block that meets it holds one of them, so blocks are made
only around places of prefix words. Length filter: a block with fewer than a words of the templates' vocabulary cannot meet
it. Positional filter: a shared word at place i of T and j of B leaves at most 1 + min(|T| - i - 1, |B| - j - 1) shared words.
What passes is verified on the whole sets. Words outside the templates' vocabulary can't be shared and are dropped.

A match is dropped where another one, whose block overlaps its block, shares all of its shared words, and shares more or has
fewer words that the block lacks ("cc by" and "cc by nc nd" give way to "cc by nc"). All of it runs on DataFrame functions;
the templates are a small table that the caller may pass.

A hot word costs a row for each of its places; a place carries at most a few hundred words around it, not its text.

Defined cases: null or empty text has 0 words, no places, empty labels and score 0; rows that repeat an id are judged
each by its own text; null ids are ids like any other; a text of any length is read whole; an empty table gives no rows;
further columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARE = 0.85
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: License notices, as (label, notice).
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Licensed under the BSD 3-Clause License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0"),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0"),
    ("cc0", "Licensed under CC0 1.0 Universal Public Domain Dedication"),
)


def _lower(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())


def _words(lowered: Column) -> Column:
    return F.regexp_extract_all(lowered, F.lit(f"({WORD})"), F.lit(1))


def _template_words(notice: str) -> list[str]:
    return sorted(set(re.findall(WORD, notice.lower())))


def _base(df: DataFrame) -> DataFrame:
    """Adds n_words, and for each phrase the starts of its places."""
    df = df.withColumn("n_words", F.regexp_count("t", F.lit(WORD)).cast("long"))
    df = df.withColumn("w", F.when(F.col("t").contains("license"), _words(F.col("t"))))
    for phrase, label in PHRASES:
        parts = phrase.split()
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size("w") - len(parts), F.lit(0))), _fits(parts))
        df = df.withColumn(f"at_{label}", F.when(F.size("w") >= len(parts), starts))
    return df


def _fits(parts: list[str]):
    return lambda i: reduce(Column.__and__, [F.get(F.col("w"), i + k) == p for k, p in enumerate(parts)])


def _stride(notice: str) -> int:
    """How far apart blocks start: the notice's number of words, rounded up to a power of two."""
    return 1 << max(3, (len(re.findall(WORD, notice.lower())) - 1).bit_length())


def _order(templates: Sequence[tuple[str, str]], counts: dict[str, int]) -> dict[str, int]:
    """Place of each word of the templates in the global order."""
    return {w: i for i, w in enumerate(sorted({w for _, notice in templates for w in _template_words(notice)}, key=lambda w: (counts.get(w, 0), w)))}


def _postings(spark: SparkSession, templates: Sequence[tuple[str, str]], order: dict[str, int], share: float) -> tuple[DataFrame, list[str]]:
    """Postings of the prefixes (word, template, label, m, i, need, ranks), and the prefix words."""
    posts, words = [], {r: w for w, r in order.items()}
    for number, (label, notice) in enumerate(templates):
        ranks = sorted(order[w] for w in _template_words(notice))
        need = math.ceil(share * len(ranks) - 1e-9)
        posts += [(words[ranks[i]], number, label, _stride(notice), i, need, ranks) for i in range(len(ranks) - need + 1)]
    schema = "prefix string, template int, label string, m int, i int, need int, ranks array<int>"
    return spark.createDataFrame(posts, schema), sorted({p[0] for p in posts})


def word_counts(docs: DataFrame, text_col: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES) -> dict[str, int]:
    """Counts of the templates' words over all documents: at most as many rows as the templates have words."""
    vocabulary = sorted({w for _, notice in templates for w in _template_words(notice)})
    known = docs.sparkSession.createDataFrame([(w,) for w in vocabulary], "word string")
    each = docs.select(F.explode(_words(_lower(F.col(text_col)))).alias("word"))
    return {r["word"]: r["count"] for r in each.join(F.broadcast(known), "word", "left_semi").groupBy("word").count().collect()}


def notice_blocks(docs: DataFrame, counts: dict[str, int], share: float = SHARE, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """doc_id, key, start, m, template, label, containment: the blocks that meet a template, dropped ones left out. docs has doc_id, key and t (the lowered text)."""
    order = _order(templates, counts)
    postings, prefixes = _postings(docs.sparkSession, templates, order, share)
    far = 2 * max(_stride(notice) for _, notice in templates)
    any_prefix = r"(?<![^\x00-\x2F\x3A-\x60\x7B-\x7F])(?:" + "|".join(re.escape(w) for w in prefixes) + r")(?![^\x00-\x2F\x3A-\x60\x7B-\x7F])"
    w, at = F.col("w"), F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.get(F.col("w"), i).isin(*prefixes))
    around = lambda p: F.struct(p.alias("p"), F.greatest(p - far, F.lit(0)).alias("low"), F.slice(w, F.greatest(p - far, F.lit(0)) + 1, F.lit(2 * far + 1)).alias("words"))
    texts = docs.filter(F.col("t").rlike(any_prefix)).select("doc_id", "key", _words(F.col("t")).alias("w"))
    places = texts.select("doc_id", "key", F.explode(F.transform(at, around)).alias("a")).select("doc_id", "key", "a.*")
    met = places.join(F.broadcast(postings), F.element_at("words", F.col("p") - F.col("low") + 1) == F.col("prefix"))
    first = F.floor(F.col("p") / F.col("m")).cast("int")
    met = met.withColumn("b", F.explode(F.array_distinct(F.array(first, F.greatest(first - 1, F.lit(0)))))).withColumn("start", F.col("b") * F.col("m"))
    rank_of = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    own = F.slice("words", F.col("start") - F.col("low") + 1, 2 * F.col("m"))
    block = F.array_sort(F.array_distinct(F.filter(F.transform(own, lambda x: F.try_element_at(rank_of, x)), lambda r: r.isNotNull())))
    met = met.withColumn("b", block).withColumn("j", F.array_position("b", F.get("ranks", F.col("i"))) - 1)
    left = F.least(F.size("ranks") - F.col("i"), F.size("b") - F.col("j"))
    met = met.filter((F.size("b") >= F.col("need")) & (left >= F.col("need"))).withColumn("shared", F.array_intersect("b", "ranks")).filter(F.size("shared") >= F.col("need"))
    key = ["doc_id", "key", "start", "m", "template"]
    met = met.groupBy(*key).agg(F.first("label").alias("label"), F.first("shared").alias("shared"), F.first(F.size("ranks")).alias("size"))
    # overlapping blocks share a stretch of the text as long as the longest block; a stretch holds few matches
    met = met.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("start") / far), F.floor((F.col("start") + 2 * F.col("m") - 1) / far))))
    one = F.struct("start", "m", "template", "label", "shared", "size")
    beats = lambda y, x: (F.size(y["shared"]) > F.size(x["shared"])) | ((F.size(y["shared"]) == F.size(x["shared"])) & (y["size"] < x["size"]))
    meets = lambda y, x: (y["start"] < x["start"] + 2 * x["m"]) & (x["start"] < y["start"] + 2 * y["m"])
    groups = met.groupBy("doc_id", "key", "stretch").agg(F.collect_list(one).alias("met"))
    each = groups.select("doc_id", "key", F.explode("met").alias("x"), "met")
    lost = F.exists("met", lambda y: beats(y, F.col("x")) & meets(y, F.col("x")) & (F.size(F.array_except(F.col("x.shared"), y["shared"])) == 0))
    each = each.select("doc_id", "key", "x.start", "x.m", "x.template", "x.label", (F.size("x.shared") / F.col("x.size")).alias("containment"), lost.alias("lost"))
    kept = each.groupBy(*key).agg(F.first("label").alias("label"), F.first("containment").alias("containment"), F.max("lost").alias("lost"))
    return kept.filter("not lost").drop("lost")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row per row of docs.

    score is the largest containment that a block reaches, 1 where a phrase stands, else 0.
    """
    counts = word_counts(docs, text_col, templates)
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("key"), _lower(F.col(text_col)).alias("t"))
    blocks = notice_blocks(keyed, counts, share, templates).groupBy("doc_id", "key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    starts = [F.col(f"at_{label}") for _, label in PHRASES]
    n_base = reduce(Column.__add__, [F.coalesce(F.size(s), F.lit(0)) for s in starts])
    own = F.filter(F.array(*[F.when(F.size(s) > 0, F.lit(label)) for s, (_, label) in zip(starts, PHRASES, strict=True)]), lambda x: x.isNotNull())
    based = _base(keyed).select("doc_id", "key", "n_words", n_base.cast("long").alias("n_base"), F.least(*[F.array_min(s) for s in starts]).cast("long").alias("first_word"), F.greatest(*[F.array_max(s) for s in starts]).cast("long").alias("last_word"), F.array_sort(own).alias("own"))
    blocks = blocks.withColumnsRenamed({"doc_id": "d", "key": "k"})
    out = based.join(blocks, based["doc_id"].eqNullSafe(blocks["d"]) & (based["key"] == blocks["k"]), "left")
    labels = F.array_sort(F.array_union("own", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("own", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))
