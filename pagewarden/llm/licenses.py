"""License scans by diagonal voting, in DataFrame operations only.

Texts and templates are cut into words; every rolling word k-gram of a text (three words, two where a phrase
has no more) is hashed and joined with the templates' gram hashes, and joined grams are compared word by
word. A hit of word i with template word j votes for the diagonal i - j. Votes are summed a diagonal; diagonals
at most DRIFT apart are one place, as words put in or left out move what follows to a neighbour. A place
is a span of the template when the grams voting for it cover at least COVER of the template's words and the span
isn't over STRETCH times as long.

Phrases are templates that count word for word: a phrase has a single gram, so each hit is a place.

The hits of all texts are staged, a row a hit and a row a document; texts are read once and never moved.
Templates are broadcast; more than MOST_GRAMS grams are refused.

A-Z are lower-cased; words are runs of a-z, 0-9 and characters beyond ASCII. `lower` also changes characters beyond
ASCII, always into such, but for the Kelvin sign, which is replaced before; templates are ASCII, so
no comparison can tell.

Cases: a null text counts as empty; a text without words has no spans and score 0; rows that repeat a
doc_id, null or not, are documents each; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage

TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Diagonals this far apart are one place; share of a template's words that must be matched; how much longer a span may be.
DRIFT = 4
COVER = 0.75
STRETCH = 1.5
MOST_GRAMS = 100_000
#: Phrases of the contract, and the usual wording of license notices, with their labels.
PHRASES = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]
NOTICES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "has dedicated the work to the public domain by waiving all of his or her rights to the work"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased."""
    return F.regexp_extract_all(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u00e9"))), F.lit(TOKEN), F.lit(0))


def _grams(w: str) -> Column:
    """(first, second, third) from each word on; null beyond the end."""
    return F.arrays_zip(F.col(w).alias("a"), F.slice(w, F.lit(2), F.greatest(F.size(w), F.lit(1))).alias("b"), F.slice(w, F.lit(3), F.greatest(F.size(w), F.lit(1))).alias("c"))


def templates(spark: SparkSession, phrases: list[tuple[str, str]], notices: list[tuple[str, str]]) -> DataFrame:
    """t, label, phrase, size (words), j and the gram's words and hash, a row a gram; c is null in grams of two words."""
    given = [F.struct(F.lit(t).alias("t"), F.lit(label).alias("label"), F.lit(t < len(phrases)).alias("phrase"), F.lit(text).alias("text")) for t, (label, text) in enumerate([*phrases, *notices])]
    cut = spark.range(1).select(F.inline(F.array(*given))).withColumn("w", words(F.col("text"))).withColumn("size", F.size("w"))
    grams = cut.select("t", "label", "phrase", "size", F.posexplode(_grams("w")).alias("j", "g")).select("*", "g.*").drop("g")
    whole = F.when(F.col("size") == 2, F.col("j") == 0).otherwise(F.col("j") <= F.col("size") - 3)
    grams = grams.filter(whole).withColumn("k", F.least("size", F.lit(3))).withColumn("hash", F.xxhash64("a", "b"))
    if (n := grams.count()) > MOST_GRAMS:
        raise ValueError(f"{n} grams of templates; {MOST_GRAMS} are broadcast at most")
    if cut.filter((F.col("size") < 2) | F.col("phrase") & (F.col("size") > 3)).count():
        raise ValueError("templates need two words, phrases two or three")
    return grams


def hits(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """Staged: row (a number), doc_id, n_words and the hits (i, t, j, ...), with a row for each document at least."""
    cut = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), words(F.col("text")).alias("w"))
    each = cut.select("row", "doc_id", F.size("w").alias("n_words"), F.posexplode_outer(_grams("w")).alias("i", "g"))
    each = each.select("row", "doc_id", "n_words", "i", F.xxhash64("g.a", "g.b").alias("hash"), F.col("g.a").alias("x"), F.col("g.b").alias("y"), F.col("g.c").alias("z"))
    same = (each["hash"] == grams["hash"]) & (F.col("x") == F.col("a")) & (F.col("y") == F.col("b")) & (F.col("c").isNull() | (F.col("z") == F.col("c")))
    met = each.join(F.broadcast(grams), same, "left")  # at most MOST_GRAMS rows
    return stage(met.filter(F.col("t").isNotNull() | (F.coalesce("i", F.lit(0)) == 0)).select("row", "doc_id", "n_words", "i", "t", "label", "phrase", "size", "j", "k"), "hits")


def spans(found: DataFrame) -> DataFrame:
    """row, label, phrase, first_word, end_word (after the last), coverage: the verified spans of hits."""
    diagonals = found.filter("t IS NOT NULL").groupBy("row", "t", "label", "phrase", "size", (F.col("i") - F.col("j")).alias("diagonal")).agg(
        F.min("i").alias("first"), F.max(F.col("i") + F.col("k")).alias("end"), F.collect_set(F.struct("j", "k")).alias("votes")
    )
    along = Window.partitionBy("row", "t").orderBy("diagonal")
    apart = F.col("phrase") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > DRIFT, F.lit(True))
    places = diagonals.withColumn("apart", apart.cast("long")).withColumn("place", F.sum("apart").over(along))
    places = places.groupBy("row", "t", "label", "phrase", "size", "place").agg(F.min("first").alias("first_word"), F.max("end").alias("end_word"), F.flatten(F.collect_list("votes")).alias("votes"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("votes", lambda v: F.sequence(v["j"], v["j"] + v["k"] - 1)))))
    places = places.withColumn("coverage", covered / F.col("size"))
    whole = (F.col("coverage") >= COVER) & (F.col("end_word") - F.col("first_word") <= F.col("size") * STRETCH)
    return places.filter(whole).select("row", "label", "phrase", "first_word", "end_word", "coverage")


def scan(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES) -> tuple[DataFrame, DataFrame]:
    """The documents (row, doc_id, n_words), a row each, and their spans, by row."""
    found = hits(docs, templates(docs.sparkSession, phrases, notices))
    return found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").cast("long").alias("n_words")), spans(found)


def summary(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """A row a document: places of phrases, first and last of them, labels of phrases and of all spans, the best coverage."""
    every, found = scan(docs, phrases, notices)
    start = F.when(F.col("phrase"), F.col("first_word")).cast("long")
    sums = found.groupBy("row").agg(
        F.count(start).alias("n_base"), F.min(start).alias("first_word"), F.max(start).alias("last_word"),
        F.collect_set(F.when(F.col("phrase"), F.col("label"))).alias("base"), F.collect_set("label").alias("all"), F.max("coverage").alias("best"),
    )
    joined = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))
    return every.join(sums, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        joined("base").alias("base_labels"), joined("all").alias("labels"), F.coalesce("best", F.lit(0.0)).alias("score"),
    )


def oracle() -> str:
    """The same in DuckDB's SQL; phrases are found by comparing words in place."""
    token = TOKEN.replace("'", "''")
    cut = lambda text: f"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{token}')"
    phrase = ", ".join(f"('{label}', string_split('{text}', ' '))" for label, text in PHRASES)
    notice = ", ".join(f"({t}, '{label}', {cut(f"'{text}'")})" for t, (label, text) in enumerate(NOTICES))
    return f"""
    WITH d AS (SELECT doc_id, {cut("coalesce(text, '')")} AS w FROM documents),
    p(label, v) AS (VALUES {phrase}), n(t, label, v) AS (VALUES {notice}),
    x AS (SELECT doc_id, w, i FROM d, unnest(range(1, len(w) + 1)) AS u(i)),
    b AS (SELECT doc_id, label, i - 1 AS i FROM x JOIN p ON w[i] = v[1] AND w[i:i + len(v) - 1] = v),
    g AS (SELECT t, label, len(v) AS size, j - 1 AS j, v[j] AS a, v[j:j + 2] AS gram FROM n, unnest(range(1, len(v) - 1)) AS u(j)),
    h AS (SELECT doc_id, t, label, size, x.i - 1 AS i, g.j, x.i - 1 - g.j AS diagonal FROM x JOIN g ON x.w[x.i] = g.a AND x.w[x.i:x.i + 2] = g.gram),
    s AS (SELECT doc_id, t, diagonal, diagonal - lag(diagonal) OVER (PARTITION BY doc_id, t ORDER BY diagonal) AS gap FROM (SELECT DISTINCT doc_id, t, diagonal FROM h) AS o),
    o AS (SELECT doc_id, t, diagonal, sum(CASE WHEN gap <= {DRIFT} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, t ORDER BY diagonal) AS place FROM s),
    c AS (SELECT doc_id, label, size, len(list_distinct(flatten(list([j, j + 1, j + 2])))) / size AS coverage, max(i) + 3 - min(i) AS long FROM h JOIN o USING (doc_id, t, diagonal) GROUP BY doc_id, t, label, size, place),
    m AS (SELECT doc_id, label, coverage FROM c WHERE coverage >= {COVER} AND long <= {STRETCH} * size UNION ALL SELECT doc_id, label, 1.0 FROM b),
    e AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score FROM m GROUP BY doc_id),
    f AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
    FROM d LEFT JOIN e USING (doc_id) LEFT JOIN f USING (doc_id)"""
