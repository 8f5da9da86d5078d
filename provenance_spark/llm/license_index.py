"""License scans with a positional index of rare words.

Each template's words are indexed by position. Document frequencies of all template words are counted over all files; each
template's ``ANCHORS`` rarest words, those of the highest IDF, are its anchors. All of a file's anchors are looked up, at
most ``ANCHORS`` for each template, and every pair of a place in the file and a posting votes for the template starting at the
difference. Where enough of a template's anchors agree on a start, its mandatory key phrases must stand in the words
there; the share of template words in place is the score.

Beside the templates, plain phrases give base labels wherever their words stand consecutively. All of it is
DataFrame operations: one pass over the texts makes a narrow row each, and only files with enough anchors are read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provenance_spark.llm.common import fits
from provenance_spark.session import cut_lineage

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose places are counted, and the labels they give.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Label, text of the notice in lower-case words, mandatory key phrases.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
            "files the software to deal in the software without restriction including without limitation the rights to use copy modify "
            "merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is "
            "furnished to do so", ("permission is hereby granted free of charge", "sublicense and or sell copies")),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org "
               "licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is "
               "distributed on an as is basis without warranties or conditions of any kind either express or implied",
     ("except in compliance with the license", "unless required by applicable law")),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
            "published by the free software foundation either version", ("you can redistribute it and or modify it", "gnu general public license")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
            "conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the "
            "following disclaimer", ("redistribution and use in source and binary forms", "must retain the above copyright notice")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided "
            "that the above copyright notice and this permission notice appear in all copies",
     ("permission to use copy modify and or distribute this software", "appear in all copies")),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with "
            "this file you can obtain one at", ("subject to the terms of the mozilla public license",)),
    ("gpl", "this work is licensed under the gnu general public license version", ("gnu general public license",)),
    ("apache", "licensed under the apache license version 2 0", ("under the apache license",)),
    ("mit", "released under the mit license", ("under the mit license",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("under cc by nc",)),
)
ANCHORS = 5
#: Anchors of a template that must agree on a start (all, if it has fewer).
VOTES = 3
#: Words beside a template's place in which its key phrases may stand: a few words may be put in or left out.
SLACK = 5
#: Files with anchors whose keys may be broadcast; beyond, texts are joined by shuffling.
FILES = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text with A-Z in lower case; none of a null text."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def postings(spark: SparkSession) -> DataFrame:
    """``(word, template, place)`` of every template word: a fixed few hundred rows."""
    rows = [(w, t, p) for t, (_, text, _) in enumerate(TEMPLATES) for p, w in enumerate(text.split())]
    return spark.createDataFrame(rows, "word string, template int, place int").coalesce(1)


def _starts(w: str, phrase: list[str]) -> Column:
    """Places, from 1, where the phrase's words stand consecutively in the word array ``w``."""
    places = F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1)))
    here = F.filter(places, lambda i: F.slice(w, i, len(phrase)) == F.array(*map(F.lit, phrase)))
    return F.when(F.array_contains(w, phrase[-1]), here).otherwise(F.array().cast("array<int>"))


def _base(w: str) -> tuple[Column, Column]:
    """Starts of all base phrases in the word array ``w``, and their labels, sorted."""
    found = [(_starts(w, phrase.split()), label) for phrase, label in sorted(PHRASES.items(), key=lambda x: x[1])]
    labels = F.array(*[F.when(F.size(own) > 0, F.lit(label)) for own, label in found])
    return F.concat(*[own for own, _ in found]), F.array_compact(labels)


def narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each file: id, key (a hash of its text), n_words, base places and labels, and its licence words."""
    vocabulary = sorted({w for _, text, _ in TEMPLATES for w in text.split()})
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"), words(F.col(text_col)).alias("w"))
    starts, labels = _base("w")
    return cut_lineage(rows.select("id", "key", F.size("w").cast("long").alias("n_words"), starts.alias("starts"), labels.alias("base"),
                                   F.array_intersect("w", F.array(*map(F.lit, vocabulary))).alias("known")))


def anchors(files: DataFrame) -> DataFrame:
    """``(word, template, place, idf, n_anchors)``: postings of each template's rarest words; ties in order of the word."""
    spark = files.sparkSession
    seen = files.select(F.explode("known").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    posted = postings(spark).join(seen, "word", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rank = F.dense_rank().over(Window.partitionBy("template").orderBy("df", "word"))
    found = posted.withColumn("rank", rank).where(F.col("rank") <= ANCHORS)
    n = F.max("rank").over(Window.partitionBy("template"))
    total = files.count()
    return cut_lineage(found.select("word", "template", "place", F.log((total + 1.0) / (F.col("df") + 1.0)).alias("idf"), n.alias("n_anchors")))


def matches(docs: DataFrame, files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, key, label, score)`` of every template found in a file, its best place only."""
    index = anchors(files)
    # A template needs this many of the file's words before its text is read again.
    need = F.least(F.col("n_anchors"), F.lit(VOTES))
    per = index.select("word", "template", need.alias("need")).distinct()
    own = files.select("id", "key", F.explode("known").alias("word"))
    near = (own.join(F.broadcast(per), "word").groupBy("id", "key", "template", "need").agg(F.count_distinct("word").alias("n")).where("n >= need")
            .select("id", "key").distinct())
    near = cut_lineage(near)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"), F.col(text_col).alias("text"))
    keys = near.select(F.col("id").alias("i"), F.col("key").alias("k"))
    picked = rows.join(F.broadcast(keys) if fits(keys, FILES) else keys, F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left_semi")
    texts = cut_lineage(picked.select("id", "key", words(F.col("text")).alias("w")))
    placed = texts.select("id", "key", F.posexplode("w").alias("at", "word")).join(F.broadcast(index), "word").distinct()
    votes = (placed.withColumn("start", F.col("at") - F.col("place")).groupBy("id", "key", "template", "start", "n_anchors")
             .agg(F.count_distinct("word").alias("n")).where(F.col("n") >= need).select("id", "key", "template", "start"))
    joined = texts.dropDuplicates(["id", "key"]).join(votes.withColumnsRenamed({"id": "i", "key": "k"}), F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")))
    body = F.element_at(F.array(*[F.split(F.lit(t), " ") for _, t, _ in TEMPLATES]), F.col("template") + 1)
    phrases = F.element_at(F.array(*[F.array(*map(F.lit, p)) for _, _, p in TEMPLATES]), F.col("template") + 1)
    label = F.element_at(F.array(*[F.lit(x) for x, _, _ in TEMPLATES]), F.col("template") + 1)
    first = F.greatest(F.col("start") - SLACK, F.lit(0))
    region = F.concat(F.lit(" "), F.array_join(F.slice("w", first + 1, F.col("start") + F.size(body) + SLACK - first), " "), F.lit(" "))
    in_place = F.size(F.filter(F.transform(body, lambda x, i: x == F.get("w", F.col("start") + i)), lambda x: x))
    return (joined.where(F.forall(phrases, lambda p: F.contains(region, F.concat(F.lit(" "), p, F.lit(" ")))))
            .select("id", "key", label.alias("label"), (in_place / F.size(body)).alias("score"))
            .groupBy("id", "key", "label").agg(F.max("score").alias("score")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The score is the best template's share of words in place; base labels alone score 0.5, a file without labels 0. Null and
    empty texts have no words and no labels. Rows with the same id and text are the same file. An empty table gives no rows.
    """
    files = narrow(docs, id_col, text_col)
    found = (matches(docs, files, id_col, text_col).groupBy(F.col("id").alias("i"), F.col("key").alias("k"))
             .agg(F.collect_set("label").alias("found"), F.max("score").alias("best")))
    rows = files.join(found, F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left")
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("found", F.array().cast("array<string>")))))
    return rows.select(
        F.col("id").alias("doc_id"), "n_words", F.size("starts").cast("long").alias("n_base"),
        (F.array_min("starts") - 1).cast("long").alias("first_word"), (F.array_max("starts") - 1).cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.size("base") > 0, 0.5).otherwise(0.0)).alias("score"))
