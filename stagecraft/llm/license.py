"""License scans by diagonal voting, in DataFrame functions only.

Every rolling 3-word hash of every document is joined with the positions of the
templates' 3-word hashes (a fixed set, so its broadcast is bounded).  A hit at
word p of the document and word t of the template votes for the diagonal p - t.
Votes are added up by diagonal, neighbouring diagonals (words put in or left out)
merge, and a merged span is accepted if it covers enough of the template within a
bounded length.  The base phrases are templates that must match in full on one
diagonal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagecraft.llm import common as C

K = 3
#: Diagonals this close merge; a span may be this much longer than its template.
NEAR, STRETCH = 3, 1.5
COVERAGE = 0.6

BASE = {"the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Well-known sentences of public licenses, in normalised words.
NOTICES = {
    "the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0 you may not use this file except in compliance with the license": "apache-2",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "licensed under the gnu general public license": "gpl",
    "subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
}


def words_of(text: Column) -> Column:
    """Words after lower-casing A-Z.  The Kelvin sign, the only other character
    that lower-cases to one plain letter, is replaced first; it stays a word character."""
    low = F.lower(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("\u212a"), F.lit("\u03ba")))
    return F.filter(F.split(low, r"[\x00-/:-`{-\x7F]+"), lambda w: w != "")


def _grams(words: Column) -> Column:
    """xxhash64 of every K consecutive words."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    grams = F.element_at(F.transform(F.array(hashes), lambda h: F.transform(
        F.sequence(F.lit(0), F.size(h) - K), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(K)]))), 1)
    return F.when(F.size(words) < K, F.array().cast("array<bigint>")).otherwise(grams)


def templates(spark, phrases: dict[str, str] = BASE) -> DataFrame:
    """(gram, tid, tpos, n_grams, label, base): one row per template position."""
    short = [p for p in phrases if len(p.split()) < K]
    if short:
        raise ValueError(f"phrases of fewer than {K} words: {', '.join(short)}")
    rows = [(i, label, text, base) for base, group in ((True, phrases), (False, NOTICES))
            for i, (text, label) in enumerate(group.items(), 0 if base else len(phrases))]
    t = spark.createDataFrame(rows, "tid int, label string, text string, base boolean")
    t = t.withColumn("g", _grams(words_of(F.col("text"))))
    return t.select("tid", "label", "base", F.size("g").alias("n_grams"), F.posexplode("g").alias("tpos", "gram"))


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = BASE) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score.  ``phrases`` are the base phrases and their labels.  Null text is empty; documents without a label have empty
    strings, null places and score 0; rows that repeat an id and its text get the
    same result."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("words", words_of(F.col("text")))
    rows = rows.select("doc_id", F.xxhash64("text").alias("th"), F.size("words").cast("long").alias("n_words"), _grams(F.col("words")).alias("g"))
    # One more element per row, joined like a gram, brings every row through the same pass.
    grams = rows.select("doc_id", "th", "n_words", F.posexplode(F.concat("g", F.array(F.lit(None).cast("bigint")))).alias("pos", "gram"))
    at = templates(spark, phrases)
    found = grams.join(F.broadcast(at.withColumnRenamed("gram", "tgram")), F.col("gram") == F.col("tgram"), "left") \
        .filter(F.col("gram").isNull() | F.col("tid").isNotNull()).drop("tgram", "gram")
    found = C.save(found, "license-hits")
    base_rows = found.filter(F.col("tid").isNull()).select("doc_id", "th", "n_words")

    votes = (found.filter(F.col("tid").isNotNull()).withColumn("diagonal", F.col("pos") - F.col("tpos"))
             .groupBy("doc_id", "th", "tid", "label", "base", "n_grams", "diagonal")
             .agg(F.collect_set("tpos").alias("tset"), F.min("pos").alias("lo"), F.max("pos").alias("hi")))
    places = votes.filter(F.col("base") & (F.size("tset") == F.col("n_grams"))) \
        .select("doc_id", "th", "tid", "label", F.col("diagonal").cast("long").alias("place"))
    line = Window.partitionBy("doc_id", "th", "tid").orderBy("diagonal")
    merged = (votes.filter(~F.col("base"))
              .withColumn("new", F.when(F.col("diagonal") - F.lag("diagonal").over(line) <= NEAR, 0).otherwise(1))
              .withColumn("run", F.sum("new").over(line))
              .groupBy("doc_id", "th", "tid", "label", "n_grams", "run")
              .agg(F.size(F.array_distinct(F.flatten(F.collect_list("tset")))).alias("hit"), F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    spans = merged.withColumn("share", F.col("hit") / F.col("n_grams")) \
        .filter((F.col("share") >= COVERAGE) & (F.col("hi") - F.col("lo") + K <= STRETCH * (F.col("n_grams") + K)))
    found_base = places.groupBy("doc_id", "th").agg(
        F.count_distinct("tid", "place").alias("n_base"), F.min("place").alias("first_word"), F.max("place").alias("last_word"),
        F.collect_set("label").alias("b"))
    found_more = spans.groupBy("doc_id", "th").agg(F.collect_set("label").alias("m"), F.max("share").alias("share"))
    same = "a.doc_id <=> {0}.doc_id and a.th = {0}.th"
    none = F.array().cast("array<string>")
    out = (base_rows.alias("a").join(found_base.alias("b"), F.expr(same.format("b")), "left")
           .join(found_more.alias("m"), F.expr(same.format("m")), "left"))
    label = F.coalesce(F.col("b.b"), none)
    return out.select("a.doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
                      F.array_join(F.array_sort(label), ",").alias("base_labels"),
                      F.array_join(F.array_sort(F.array_union(label, F.coalesce(F.col("m.m"), none))), ",").alias("labels"),
                      F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))
