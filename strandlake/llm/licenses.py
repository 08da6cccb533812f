"""License scan by diagonal voting.

All rolling word k-gram hashes of a document are joined to the positions at which a template has them. Hits on one
diagonal (document position minus template position) are one vote each; neighbouring diagonals, as left by a few added or
missing words, are merged; a span is verified on its words and counts by the share of the template that it covers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.llm.catalog import query
from strandlake.llm.common import row_key, table

#: Words of a text once A-Z is in lower case: ASCII letters and digits and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notices as their licences ask one to put them into files.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
#: Words of a k-gram, shift between diagonals that are merged, and the share of a template that verifies a span.
K, SHIFT, COVER = 3, 2, 0.6


def doc_words(text):
    """Words of the lower-cased text.

    Two letters beyond ASCII become ASCII ones in Unicode lower case (Kelvin sign, dotted capital I); they are put
    out of the way first, so that words are ASCII exactly where lowering A-Z alone makes them so.
    """
    safe = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("é")), F.lit("İ"), F.lit("é"))
    return F.regexp_extract_all(F.lower(safe), F.lit(WORD), F.lit(0))


def _template_grams(spark: SparkSession, templates, k: int) -> DataFrame:
    """``(gram_hash, gram, template, label, words, at)``: one row per position of a template; a fixed, small table."""
    rows = []
    for number, (label, text) in enumerate(templates):
        words = text.split()
        for at in range(len(words) - k + 1):
            rows.append((number, label, len(words), at, words[at : at + k]))
    listed = spark.createDataFrame(rows, "template int, label string, words int, at int, gram array<string>")
    return listed.withColumn("gram_hash", F.xxhash64(*[F.col("gram")[i] for i in range(k)]))


def template_spans(docs: DataFrame, templates=TEMPLATES, k: int = K, shift: int = SHIFT, cover: float = COVER) -> DataFrame:
    """``doc_id, text_key, label, template, first_word, last_word, score``: verified spans of templates in whole texts."""
    grams = _template_grams(docs.sparkSession, templates, k)
    hashes = F.expr(
        "transform(if(size(w) >= {k}, sequence(0, size(w) - {k}), cast(array() as array<int>)), i -> xxhash64({g}))".format(
            k=k, g=", ".join(f"w[i + {j}]" for j in range(k))
        )
    )
    rolled = (
        docs.select("doc_id", row_key(F.col("text")).alias("text_key"), doc_words(F.col("text")).alias("w"))
        .select("doc_id", "text_key", "w", F.posexplode(hashes).alias("pos", "gram_hash"))
    )
    # The template table is fixed in this module (some hundred rows), so it is broadcast whatever the corpus.
    hits = (
        rolled.join(F.broadcast(grams), "gram_hash")
        .where(F.slice("w", F.col("pos") + 1, F.lit(k)) == F.col("gram"))
        .select("doc_id", "text_key", "template", "label", "words", "pos", "at", (F.col("pos") - F.col("at")).alias("diagonal"))
    )
    key = ["doc_id", "text_key", "template", "label", "words"]
    votes = hits.groupBy(*key, "diagonal").agg(
        F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.sort_array(F.collect_set("at")).alias("ats")
    )
    # A diagonal joins the one before it if it is near and goes on where that one was, not somewhere else in the text.
    line = Window.partitionBy(*key).orderBy("diagonal")
    fresh = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(line) > shift) | (F.col("lo") - F.lag("hi").over(line) > F.col("words")), F.lit(True))
    merged = (
        votes.withColumn("fresh", fresh.cast("int")).withColumn("part", F.sum("fresh").over(line.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*key, "part")
        .agg(F.min("lo").alias("first_word"), F.max("hi").alias("hi"), F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"))
    )
    # Template words under a verified k-gram, each once.
    covered = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + (k - 1))))))
    return (
        merged.withColumn("score", covered / F.col("words")).where(F.col("score") >= cover)
        .select("doc_id", "text_key", "label", "template", "first_word", (F.col("hi") + (k - 1)).alias("last_word"), "score")
    )


def _phrase_places(phrases):
    """Array of ``(at, label)``: where a phrase's words stand consecutively in the array ``w``."""
    arms = []
    for phrase, label in phrases:
        words = phrase.split()
        here = " and ".join(f"w[i + {j}] <=> '{x}'" for j, x in enumerate(words))
        arms.append(
            f"transform(filter(if(size(w) >= {len(words)} and array_contains(w, '{words[-1]}'), sequence(0, size(w) - {len(words)}), cast(array() as array<int>)), "
            f"i -> {here}), i -> named_struct('at', i, 'label', '{label}'))"
        )
    return F.expr(f"concat({', '.join(arms)})")


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``n_base``, ``first_word`` and ``last_word`` (smallest and largest start) speak of the phrases, ``labels`` of phrases
    and templates; ``score`` is the largest covered share of a template, 0 without one. Null and empty texts have no
    words, null positions and empty labels; rows that repeat an id are scanned on their own; an empty table gives no
    rows. Columns other than doc_id and text are not read.
    """
    places = (
        docs.select("doc_id", row_key(F.col("text")).alias("text_key"), doc_words(F.col("text")).alias("w"))
        .select("doc_id", "text_key", F.size("w").cast("long").alias("n_words"), _phrase_places(phrases).alias("base"))
    )
    spans = (
        template_spans(docs, templates).groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
        .agg(F.collect_set("label").alias("found"), F.max("score").alias("best"))
    )
    none = F.expr("cast(array() as array<string>)")
    named = F.array_distinct(F.transform("base", lambda x: x["label"]))
    starts = F.transform("base", lambda x: x["at"].cast("long"))
    return places.join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left").select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.sort_array(named), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(named, F.coalesce("found", none))), ",").alias("labels"),
        F.coalesce("best", F.lit(0.0)).alias("score"),
    )


@query("op8_license_diagonals")
def run(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))
