"""License scans by diagonal voting, in DataFrame functions only.

A template is a known license phrase or notice as a list of words.  All
rolling word k-grams of the texts are hashed and joined with the hashes of
the templates' k-grams; a hit is kept when the words themselves are equal.
A hit at word ``p`` of a text and word ``q`` of a template lies on the offset
diagonal ``p - q``.  Hits are aggregated by (text, template, diagonal);
diagonals next to each other (words left out or put in move the offset) are
merged to one span, and a span is verified by the share of the template's
words that its hits cover.

Templates that must be whole (``least`` 1) are found at every place, one
diagonal each, without merging.

Texts are cut into pieces of at most ``PIECE`` words, each with the few
words after it that its last k-grams reach into, so no row of k-grams grows
with a text's length.  The template table is a parameter: it is broadcast up
to ``BROADCAST_GRAMS`` k-grams and joined by a shuffle above.

Defined cases: a null, empty or wordless text has no words and no spans;
rows that repeat id and text get the same result each; rows that share an id
but not the text are told apart by a digest of the text; null ids are ids.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.spread import spread
from .common import id_text

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = "".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
WORD = "[^ ]++"  # once all separators are spaces
PIECE = 2048  # words of a text exploded from one row
SLACK = 3  # diagonals this close belong to one span
BROADCAST_GRAMS = 100_000


class Template(NamedTuple):
    label: str
    words: str  # lower case, one space between words
    least: float  # share of the words that a span must cover
    base: bool = False
    k: int = 4

    @property
    def size(self) -> int:
        return len(self.words.split(" "))


# The phrases that the base columns count.
BASE = (
    Template("mit", "mit license", 1.0, True, 2),
    Template("apache", "apache license", 1.0, True, 2),
    Template("gpl", "general public license", 1.0, True, 2),
)
# Sentences of public license notices, as they are printed.
NOTICES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
                    "documentation files the software to deal in the software without restriction", 0.8),
    Template("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", 0.8),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
                    "license as published by the free software foundation", 0.8),
    Template("lgpl", "gnu lesser general public license", 0.8),
    Template("agpl", "gnu affero general public license", 0.8),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
                    "following conditions are met", 0.8),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license", 0.8),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 0.8),
    Template("unlicense", "this is free and unencumbered software released into the public domain", 0.8),
    Template("cc-by", "licensed under cc by 4 0", 0.8),
    Template("cc-by-sa", "licensed under cc by sa 4 0", 0.8),
    Template("cc-by-nc", "licensed under cc by nc 4 0", 0.8),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", 0.8),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", 0.8),
    Template("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", 0.8),
)
TEMPLATES = BASE + NOTICES


def _pieces(rows: DataFrame, most: int) -> DataFrame:
    """``low`` as runs of at most ``PIECE`` words (``piece``, ``run``), each with the up to ``most`` words ``after`` it."""
    word = f"(?: *+{WORD})"  # possessive: matched without a call per word
    runs = rows.select("doc_id", "digest", F.regexp_extract_all("low", F.lit(f"{word}{{1,{PIECE}}}+"), F.lit(0)).alias("runs"))
    heads = runs.select("*", F.transform("runs", lambda run: F.regexp_extract(run, f"^{word}{{0,{most}}}+", 0)).alias("heads"))
    return heads.select("doc_id", "digest", "heads", F.posexplode_outer("runs").alias("piece", "run")).where("run is not null").select(
        "doc_id", "digest", "piece", "run", F.coalesce(F.get("heads", F.col("piece") + 1), F.lit("")).alias("after"))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, digest of the text, and ``low``: the text in lower case (of A-Z) with a space for every separator."""
    rows = spread(id_text(docs, id_col, text_col))
    return rows.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"),
                       F.translate(F.coalesce("text", F.lit("")), UPPER + SEPARATORS, LOWER + " " * len(SEPARATORS)).alias("low"))


def _grams(words: Column, own: Column, k: int) -> Column:
    """(k, place, hash) of the k-grams that start at the first ``own`` words."""
    starts = F.greatest(F.least(own, F.size(words) - k + 1), F.lit(0))
    return F.transform(F.slice(words, F.lit(1), starts), lambda w, i: F.struct(
        F.lit(k).alias("k"), i.alias("i"), F.xxhash64(w, *[F.get(words, i + j) for j in range(1, k)]).alias("h")))


def _template_grams(spark: SparkSession, templates: Sequence[Template]) -> DataFrame:
    rows = []
    for n, t in enumerate(templates):
        w, k = t.words.split(" "), min(t.k, t.size)
        rows += [(n, t.label, t.base, len(w), t.least, k, q, " ".join(w[q:q + k])) for q in range(len(w) - k + 1)]
    parts = F.split("gram", " ")
    table = spark.createDataFrame(rows, "template int, label string, base boolean, size int, least double, k int, q int, gram string")
    table = table.withColumn("h", F.coalesce(*[F.when(F.col("k") == k, F.xxhash64(*[F.get(parts, F.lit(j)) for j in range(k)]))
                                               for k in sorted({r[5] for r in rows})]))
    return F.broadcast(table) if len(rows) <= BROADCAST_GRAMS else table


def license_hits(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every place ``p`` of a text where the words of a template's k-gram at ``q`` stand, with the template's columns."""
    sizes = sorted({min(t.k, t.size) for t in templates})
    words = _pieces(_rows(docs, id_col, text_col), sizes[-1] - 1).select(
        "doc_id", "digest", "piece", _words(F.concat_ws(" ", "run", "after")).alias("words"),
        F.when(F.col("after") == "", F.lit(1 << 30)).otherwise(F.lit(PIECE)).alias("own"))
    # the arrays are built in a step of their own, so that exploding and joining them is one compiled loop
    arrays = words.select("doc_id", "digest", "piece", "words", F.concat(*[_grams(F.col("words"), F.col("own"), k) for k in sizes]).alias("gs"))
    grams = arrays.select("doc_id", "digest", "piece", "words", F.explode_outer("gs").alias("g"))
    table = _template_grams(docs.sparkSession, templates)
    hits = grams.select("doc_id", "digest", "piece", "words", F.col("g.k").alias("k"), F.col("g.i").alias("i"), F.col("g.h").alias("h")).join(table, ["k", "h"])
    same = F.array_join(F.slice("words", F.col("i") + 1, F.col("k")), " ") == F.col("gram")
    return hits.where(same | F.isnull("gram")).select(  # not a plain equality, which would become a join key and be built for every k-gram
        "doc_id", "digest", "template", "label", "base", "size", "least", "k", "q",
        (F.col("piece").cast("long") * PIECE + F.col("i")).alias("p"))


def license_spans(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verified spans: ``doc_id, digest, label, base, first_word, end_word`` (exclusive), ``score`` (share of the template covered)."""
    of = ["doc_id", "digest", "template", "label", "base", "size", "least", "k"]
    diagonals = license_hits(docs, templates, id_col, text_col).groupBy(*of, (F.col("p") - F.col("q")).alias("d")).agg(
        F.min("p").alias("first_word"), (F.max("p") + F.max("k")).alias("end_word"), F.collect_set("q").alias("qs"))
    near = Window.partitionBy("doc_id", "digest", "template").orderBy("d")
    far = F.coalesce((F.col("least") >= 1) | (F.col("d") - F.lag("d").over(near) > SLACK), F.lit(True))
    spans = diagonals.withColumn("new", far.cast("int")).withColumn("span", F.sum("new").over(near)).groupBy(*of, "span").agg(
        F.min("first_word").alias("first_word"), F.max("end_word").alias("end_word"), F.flatten(F.collect_list("qs")).alias("qs"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("qs", lambda q: F.sequence(q, q + F.col("k") - 1)))))
    return spans.withColumn("score", covered / F.col("size")).where("score >= least").select(
        "doc_id", "digest", "label", "base", "first_word", "end_word", "score")


def scan_licenses(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_base`` (places of base phrases), ``first_word, last_word`` (their smallest and
    largest start, null without any), ``base_labels, labels`` (distinct, sorted, comma-joined), ``score`` (of the best span, 0 without any)."""
    names = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    base = F.when(F.col("base"), F.col("first_word"))
    found = license_spans(docs, templates, id_col, text_col).groupBy(F.col("doc_id").alias("id"), F.col("digest").alias("of")).agg(
        F.count(base).alias("n_base"), F.min(base).alias("first_word"), F.max(base).alias("last_word"),
        names(F.when(F.col("base"), F.col("label"))).alias("base_labels"), names("label").alias("labels"), F.max("score").alias("score"))
    rows = _rows(docs, id_col, text_col)
    rows = rows.select("doc_id", "digest", F.regexp_count("low", F.lit(WORD)).cast("long").alias("n_words"))
    none = F.lit("")
    return rows.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of")), "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
