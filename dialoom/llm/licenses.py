"""License scans by diagonal voting, in DataFrame functions alone.

Every rolling k-gram of a text's words is joined by its hash to the places where license templates hold it. A hit
votes for its diagonal, the text's place less the template's: a passage copied whole puts all its votes on one, a
passage with words added or left out on neighbouring ones, which are merged. A merged span is verified: hits hold
equal words, not equal hashes alone, and the span must be no longer than twice its template. Phrases are templates
of pairs of words of which every pair has to vote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Words of a k-gram of phrases and of texts.
PHRASE_K, TEXT_K = 2, 4
#: How far apart neighbouring diagonals of one span may be, and which share of its template's k-grams a span needs.
DRIFT, LEAST = 4, 0.5
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The base phrases with their labels; fixed values.
PHRASES = (("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license"))
#: The notices by which licenses are given, with their labels; fixed values, from the licenses' own texts.
TEXTS = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
)


def words(text: Column) -> Column:
    """A text's words with A-Z in lower case; none for null.

    lower() folds other letters too, which changes no word's bounds. The one letter beyond ASCII that it would make
    an ASCII word of, U+212A, is replaced first; U+0130 becomes i and a mark, which no template's word holds.
    """
    return F.regexp_extract_all(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("é"))), F.lit(WORD), 0)


def _rolling(parts: Column, step: int) -> Column:
    """Each part joined to the one step places on: pairs of words, and of those, with a step of two, four words."""
    n = F.greatest(F.size(parts) - step, F.lit(0))
    return F.zip_with(F.slice(parts, 1, n), F.slice(parts, step + 1, n), lambda a, b: F.concat(a, F.lit(" "), b))


def _grams(all_words: Column) -> Column:
    """The pairs of an array of words, then its runs of four words, then an empty string, which stands for the text itself."""

    def both(pairs: Column) -> Column:
        return F.concat(pairs, _rolling(pairs, 2), F.array(F.lit("")))

    return F.get(F.transform(F.array(_rolling(all_words, 1)), both), F.lit(0))


def _hashed(df: DataFrame) -> DataFrame:
    """A row for each k-gram: k (0 for the text itself), place and hash beside the columns of df, which has words."""
    pairs = F.greatest(F.col("n_words") - 1, F.lit(0))
    kind = F.when(F.col("gram") == "", 0).when(F.col("i") < pairs, PHRASE_K).otherwise(TEXT_K)
    rows = df.withColumn("n_words", F.size("words")).select(*[c for c in df.columns if c != "words"], "n_words", F.posexplode(_grams(F.col("words"))).alias("i", "gram"))
    return rows.select("*", kind.alias("k"), (F.col("i") - F.when(kind == TEXT_K, pairs).otherwise(0)).alias("place"), F.xxhash64("gram").alias("hash"))


def templates(spark: SparkSession, phrases: tuple = PHRASES, texts: tuple = TEXTS) -> DataFrame:
    """gram, hash, template, label, phrase, grams (how many it has) and t_place: a row for each k-gram of each template, and one for texts themselves.

    Its size is that of the given templates.
    """
    rows = [(i, label, i < len(phrases), text) for i, (label, text) in enumerate((*phrases, *texts))]
    given = F.inline(F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(r, ("template", "label", "phrase", "text"))]) for r in rows]))
    all_grams = _hashed(spark.range(1).select(given).select("template", "label", "phrase", words(F.col("text")).alias("words")))
    used = all_grams.where(F.col("k") == F.when(F.col("phrase"), PHRASE_K).otherwise(TEXT_K))
    k = F.when(F.col("phrase"), PHRASE_K).otherwise(TEXT_K)
    of_texts = used.select("gram", "hash", "template", "label", "phrase", (F.col("n_words") - k + 1).alias("grams"), F.col("place").alias("t_place"))
    itself = spark.range(1).select(F.lit("").alias("gram"), F.xxhash64(F.lit("")).alias("hash"), F.lit(-1).alias("template"), F.lit("").alias("label"), F.lit(False).alias("phrase"), F.lit(0).alias("grams"), F.lit(0).alias("t_place"))
    return of_texts.unionByName(itself)


def spans(docs: DataFrame, marks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, n_words, template, label, phrase, grams, votes, first, last: merged diagonals of each row of docs.

    first and last are the words, from 0, that the span begins and ends at. Each row of docs also has a span of
    template -1 without votes that count, so that rows without a hit stay. row tells rows of one id apart; it is a row's
    place in docs, which had best be a table, so that a lost task finds its rows in the same order. Only hits
    are shuffled, by row: no license and no passage that many documents share meets in one place.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("words"))
    mine = _hashed(rows).withColumnRenamed("gram", "own_gram").withColumnRenamed("hash", "own_hash")
    equal = (F.col("own_hash") == F.col("hash")) & (F.col("own_gram") == F.col("gram"))
    hits = mine.join(F.broadcast(marks), equal)  # the templates are given, so their size is
    of = ["row", "doc_id", "n_words", "template", "label", "phrase", "grams"]
    voted = hits.groupBy(*of, (F.col("place") - F.col("t_place")).alias("diagonal")).agg(F.count("*").alias("votes"), F.min("place").alias("first"), F.max("place").alias("last"))
    in_order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("phrase") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(in_order) > DRIFT, F.lit(True))
    merged = voted.withColumn("span", F.sum(apart.cast("int")).over(in_order)).groupBy(*of, "span")
    k = F.when(F.col("phrase"), PHRASE_K).otherwise(TEXT_K)
    return merged.agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last")).withColumn("last", F.col("last") + k - 1)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: tuple = PHRASES, texts: tuple = TEXTS) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans of every row of docs; other columns are ignored, whatever their names.

    base_labels are those of phrases, labels those and the ones of verified spans; both are distinct, sorted and joined
    by commas, empty without any. score is 1 with a phrase, else the largest share of a template's k-grams that a
    verified span has, 0 without one. n_spans counts verified spans of texts. Null and empty texts have no words;
    rows that are alike, or share an id or have none, each keep a row.
    """
    found = spans(docs, templates(docs.sparkSession, phrases, texts), id_col, text_col)
    place = F.col("phrase") & (F.col("votes") == F.col("grams"))
    share = F.least(F.col("votes") / F.col("grams"), F.lit(1.0))
    words_of = F.col("grams") + TEXT_K - 1
    verified = ~F.col("phrase") & (F.col("template") >= 0) & (F.col("last") - F.col("first") + 1 <= 2 * words_of)
    labelled = verified & (share >= LEAST)
    names = lambda cond: F.array_join(F.sort_array(F.collect_set(F.when(cond, F.col("label")))), ",")  # noqa: E731  at most as many as there are labels
    out = found.groupBy("row", "doc_id", "n_words").agg(
        F.count_if(place).alias("n_base"), F.min(F.when(place, F.col("first"))).cast("long").alias("first_word"), F.max(F.when(place, F.col("first"))).cast("long").alias("last_word"),
        names(place).alias("base_labels"), names(place | labelled).alias("labels"),
        F.coalesce(F.max(F.when(place, F.lit(1.0)).when(verified, share)), F.lit(0.0)).alias("score"), F.count_if(labelled).alias("n_spans"),
    )
    return out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_spans")


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base phrases, labels and score."""
    return scan(table(spark, sf_dir, "documents"))
