"""License scan by diagonal voting, with DataFrame functions only.

The words of a document are cut into rolling k-grams, whose hashes are joined
to the positions they have in the license templates.  Where a document follows
a template, position in the document minus position in the template stays the
same, so hits are counted by that offset, the diagonal; words put in or left out
move it a little, so neighbouring diagonals are merged.  A span counts if enough
of the template's words are covered in their order, if it holds the words that
make the license what it is and none of another, and if no better template
covers the same place.

The templates are a fixed, short list, so their k-grams (a few hundred rows,
whatever the input) are broadcast and the k-grams of documents never move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.llm.tables import stored, whole

#: Words in a k-gram; the shortest phrase has as many.
GRAM = 3
#: Diagonals this close belong to one occurrence.
NEIGHBOURS = 4
#: Share of a template's words that a span must have to be named.
LEAST_SCORE = 0.6

# Phrases that name a license wherever their words stand together.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
# Opening passages and notices of public licenses, the words a span must hold together, and those it must not hold.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation"
     " files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy,"
     " modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software"
     " is furnished to do so", "permission is hereby granted free of charge", ""),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with"
     " the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "apache license version 2", ""),
    ("apache-2", "Licensed under the Apache License, Version 2.0", "apache license version 2", ""),
    ("mit", "Released under the MIT License", "mit license", ""),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3", "gnu general public license version 3", ""),
    ("gpl-2", "This work is licensed under the GNU General Public License, version 2", "gnu general public license version 2", ""),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as"
     " published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
     "gnu general public license", ""),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"
     " conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the"
     " following disclaimer", "source and binary forms", ""),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", "cc by nc", ""),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", "attribution",
     "noncommercial sharealike noderivatives noderivs"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
     "attribution noncommercial", "sharealike noderivatives noderivs"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla public license v 2", ""),
)
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What stands between words, all of it ASCII; texts are cut there, since collecting the words by a pattern takes four times as long.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _runs(text: Column) -> Column:
    """Runs of ASCII letters, digits and characters beyond ASCII."""
    return F.array_remove(F.split(text, _BETWEEN), "")


def words(text: Column | str) -> Column:
    """Words of a text after A-Z are lower-cased."""
    return _runs(F.translate(whole(text), _LETTERS, _LETTERS.lower()))


def _grams(words: Column) -> Column:
    """Hash of the k-gram at each position; null if there are too few words for one."""
    places = F.when(F.size(words) >= GRAM, F.sequence(F.lit(1), F.size(words) - (GRAM - 1)))
    return F.transform(places, lambda i: F.xxhash64(*(F.element_at(words, (i + k).cast("int")) for k in range(GRAM))))


def _templates(spark: SparkSession, phrases, templates) -> DataFrame:
    """template, label, base, words and what a span must and must not hold: one row each, as literals."""
    rows = [
        F.struct(
            F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(i < len(phrases)).alias("base"), F.lit(text).alias("text"),
            F.lit(needs).alias("needs"), F.split(F.lit(without), " ").alias("without"),
        )
        for i, (label, text, needs, without) in enumerate((*((*p, "", "") for p in phrases), *templates))
    ]
    listed = spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.*")
    return listed.select("template", "label", "base", "needs", "without", words("text").alias("t_words"))


def _hits(texts: DataFrame, grams: DataFrame) -> DataFrame:
    """Votes by document, template and diagonal: how many k-grams, and the first and last of them in both."""
    # No condition on the words here: it would be pushed below them and cut every text twice.
    cut = texts.select("doc_id", "text_key", words("text").alias("words"))
    placed = cut.select("doc_id", "text_key", F.posexplode(_grams(F.col("words"))).alias("place", "gram"))
    return (
        placed.join(F.broadcast(grams), "gram")
        .groupBy("doc_id", "text_key", "template", (F.col("place") - F.col("t_place")).alias("diagonal"))
        .agg(
            F.collect_set("t_place").alias("t_places"), F.min("place").alias("first"), F.max("place").alias("last"),
        )
    )


def _occurrences(hits: DataFrame) -> DataFrame:
    """Neighbouring diagonals of a document and template merged into one occurrence each."""
    by = Window.partitionBy("doc_id", "text_key", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by) > NEIGHBOURS, F.lit(True))
    return (
        hits.withColumn("occurrence", F.sum(apart.cast("int")).over(by))
        .groupBy("doc_id", "text_key", "template", "occurrence")
        .agg(
            F.flatten(F.collect_set("t_places")).alias("t_places"), F.min("first").alias("first"), F.max("last").alias("last"),
            F.max(F.size("t_places")).alias("best"), F.max_by("diagonal", F.size("t_places")).alias("diagonal"),
        )
        .withColumn("covered", F.size(F.array_distinct(F.flatten(F.transform("t_places", lambda p: F.sequence(p, p + GRAM - 1))))))
    )


def _best_of_overlapping(spans: DataFrame) -> DataFrame:
    """Without each span that overlaps a better one: of a higher score, then longer, then of an earlier template.

    Spans are compared within runs that hang together by overlaps, so a text full of notices has many short runs.
    """
    by = Window.partitionBy("doc_id", "text_key").orderBy("start", "end", "template")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("run", F.sum(F.coalesce(F.col("start") >= before, F.lit(True)).cast("int")).over(by))
    fields = ("score", "length", "earlier", "start", "end", "label")
    one = F.struct("score", (F.col("end") - F.col("start")).alias("length"), (-F.col("template")).alias("earlier"), "start", "end", "label")
    grouped = runs.groupBy("doc_id", "text_key", "run").agg(F.collect_list(one).alias("all"))
    kept = F.filter("all", lambda a: ~F.exists("all", lambda b: (b > a) & (b["start"] < a["end"]) & (a["start"] < b["end"])))
    return grouped.select("doc_id", "text_key", F.explode(kept).alias("s")).select("doc_id", "text_key", *(f"s.{n}" for n in fields))


def license_spans(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES, least_score: float = LEAST_SCORE
) -> DataFrame:
    """One row per verified span: doc_id, text_key, label, base, start, end (words, end exclusive) and score.

    Rows are told apart by id and text, so rows that repeat both share their
    spans.  Null and empty texts have none.
    """
    spark = df.sparkSession
    known = _templates(spark, phrases, templates)
    grams = known.select("template", F.posexplode(_grams(F.col("t_words"))).alias("t_place", "gram"))
    texts = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(whole(text_col)).alias("text_key"), whole(text_col).alias("text"))
    sizes = F.broadcast(known.withColumn("t_size", F.size("t_words")))
    hits = stored(_hits(texts, grams), "diagonals")
    # A phrase is on one diagonal from its first to its last k-gram; a template may drift.
    phrase = hits.join(sizes.where("base"), "template").where(F.size("t_places") == F.col("t_size") - (GRAM - 1)).select(
        "doc_id", "text_key", "template", F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("t_size")).alias("end")
    )
    drifting = _occurrences(hits.join(sizes.where("not base").select("template"), "template")).join(
        sizes.select("template", "t_size"), "template"
    ).where(F.col("covered") >= least_score * F.col("t_size")).select(
        "doc_id", "text_key", "template", F.col("first").alias("start"), (F.col("last") + GRAM).alias("end"), "covered"
    )
    spans = phrase.withColumn("covered", F.col("end") - F.col("start")).union(drifting)
    per_text = spans.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("template", "start", "end", "covered")).alias("spans"))
    # The texts are shuffled at any size: found documents grow with the corpus, so they are never broadcast.
    again = texts.join(per_text.hint("merge"), (texts["doc_id"].eqNullSafe(per_text["doc_id"])) & (texts["text_key"] == per_text["text_key"])).select(
        texts["doc_id"], texts["text_key"], words("text").alias("words"), "spans"
    ).dropDuplicates(["doc_id", "text_key"])
    own = F.transform("spans", lambda x: F.struct(
        x["template"].alias("template"), x["start"].alias("start"), x["end"].alias("end"), x["covered"].alias("covered"),
        F.slice("words", x["start"] + 1, x["end"] - x["start"]).alias("own"),
    ))
    shown = again.select("doc_id", "text_key", F.explode(own).alias("span")).select("doc_id", "text_key", "span.*").join(sizes, "template")
    score = F.col("covered") / F.greatest(F.col("t_size"), F.col("end") - F.col("start"))
    together = lambda words: F.concat(F.lit(" "), words, F.lit(" "))
    named = together(F.array_join("own", " ")).contains(together(F.col("needs"))) & ~F.arrays_overlap("own", "without")
    checked = shown.where(F.when(F.col("base"), F.col("own") == F.col("t_words")).otherwise((score >= least_score) & named))
    keys = ("doc_id", "text_key", "label", "base", "start", "end", "score")
    checked = stored(checked.withColumn("score", F.when(F.col("base"), F.lit(1.0)).otherwise(score)).select(*keys, "template"), "license-spans")
    best = _best_of_overlapping(checked.where("not base")).withColumn("base", F.lit(False))
    return checked.where("base").select(*keys).unionByName(best.select(*keys))


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A null or empty text has no words and no labels (empty strings, score 0).
    Repeated rows repeat their result, other columns are not looked at, and an
    empty table gives no rows.
    """
    spans = license_spans(df, id_col, text_col)
    named = lambda labels: F.array_join(F.array_sort(labels), ",")
    base = F.col("base")
    found = spans.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        named(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"), named(F.collect_set("label")).alias("labels"),
        F.max("score").alias("score"),
    )
    rows = df.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(whole(text_col)).alias("text_key"),
        F.size(_runs(whole(text_col))).cast("long").alias("n_words"),
    )
    return rows.join(found, rows["doc_id"].eqNullSafe(found["_id"]) & (rows["text_key"] == found["_key"]), "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
