"""License scans by diagonal voting, with SQL functions only.

All rolling word pairs of a text are hashed and joined to the positions of the same pairs in the
templates. A hit at word p of the text and word t of a template votes for the diagonal p - t. Votes
are counted per diagonal, neighbouring diagonals (a word more or less) that overlap are merged to
one span, and a span is verified: a phrase must be complete, and of a license text the span must hold
``MIN_SHARE`` of the pairs in the order of the template, each counted once. So a pair of words that is
repeated, which votes for many diagonals, is no license.

The templates are the fixed list below, so the table of their pairs has a known size and is
broadcast; the pairs of the texts stay in the task that read the text, and only votes are shuffled,
of which a diagonal gets one row from its task.

Edge cases: a null or empty text, or one without words, has 0 words, no place, empty labels and
score 0; rows are told apart by id and text, so equal rows give equal rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import checkpointed

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MIN_SHARE = 0.5
#: Diagonals this far apart, at most, are one span (words put in or left out), if so many words lie between them at most.
SHIFT, GAP = 3, 8

# Base phrases with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Opening lines of well-known license texts, as words.
TEXTS = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "apache": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
}


def templates(spark: SparkSession, phrases: dict[str, str] = PHRASES, texts: dict[str, str] = TEXTS) -> DataFrame:
    """Pairs of all templates: hash, pair, template, base, label, at (word of the template), pairs."""
    rows = [(f"p{i}", True, label, phrase.split()) for i, (phrase, label) in enumerate(phrases.items())]
    rows += [(f"t{i}", False, label, text.split()) for i, (label, text) in enumerate(texts.items())]
    table = spark.createDataFrame(rows, "template string, base boolean, label string, words array<string>")
    pairs = table.select("template", "base", "label", (F.size("words") - 1).alias("pairs"), F.posexplode(_pairs(F.col("words"))).alias("at", "pair"))
    return pairs.filter("pair IS NOT NULL").select(F.xxhash64("pair").alias("hash"), "pair", "template", "base", "label", "at", "pairs")


def _pairs(words: Column) -> Column:
    """Every word and the next, with a blank between; null at the last word."""
    return F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))


def words_of(text: Column) -> Column:
    """Words of the lowered text: letters and digits of ASCII, and all characters beyond it; empty without words.

    Lowering turns no word character into a separator or back, and only the Kelvin sign into an ASCII letter (k).
    """
    trimmed = F.btrim(F.lower(text), F.lit("".join(c for c in map(chr, range(128)) if not c.isalnum())))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SEPARATORS))


def votes(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct hits (id, text_key, template, base, label, pairs, diagonal, p) and the rows read, without a template.

    The last word of a text has no pair; its entry stands for the row and tells the number of words (p + 1,
    null without words) and, counted in ``copies``, how many equal rows there are. So each text is read once.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_key"), words_of(text).alias("words"))
    rolling = words.select("id", "text_key", F.posexplode_outer(_pairs(F.col("words"))).alias("p", "pair"))
    rolling = rolling.select("id", "text_key", "p", "pair", F.xxhash64("pair").alias("hash"))
    known = F.broadcast(pairs.withColumnRenamed("pair", "known"))
    hits = rolling.join(known, (rolling["hash"] == known["hash"]) & (rolling["pair"] == known["known"]), "left").filter("template IS NOT NULL OR pair IS NULL")
    return hits.groupBy("id", "text_key", "template", "base", "label", "pairs", (F.col("p") - F.col("at")).alias("diagonal"), "p").agg(F.count(F.lit(1)).alias("copies"))


def spans(found: DataFrame) -> DataFrame:
    """Verified spans: id, text_key, template, base, label, first word, last word (exclusive), share of the template.

    Votes of one text and template come together in one task; they are fewer than the words of the text.
    """
    keys = ["id", "text_key", "template", "base", "label", "pairs"]
    hits = found.filter("template IS NOT NULL")
    diagonals = hits.groupBy(*keys, "diagonal").agg(F.min("p").alias("first"), (F.max("p") + 2).alias("last"), F.count(F.lit(1)).alias("n"))
    # A complete phrase is a span of its own, on its own diagonal.
    phrase = diagonals.filter("base AND n = pairs").withColumn("share", F.lit(1.0))
    by_text = Window.partitionBy("id", "text_key", "template").orderBy("first", "diagonal")
    texts = diagonals.filter("NOT base").select(
        "*", F.lag("diagonal").over(by_text).alias("diagonal_before"), F.max("last").over(by_text.rowsBetween(Window.unboundedPreceding, -1)).alias("last_before"),
    )
    apart = (F.abs(F.col("diagonal") - F.col("diagonal_before")) > SHIFT) | (F.col("first") > F.col("last_before") + GAP)
    texts = texts.withColumn("span", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(by_text))
    spanned = texts.select(*keys, "diagonal", "n", "span", F.sum("n").over(Window.partitionBy("id", "text_key", "template", "span")).alias("votes"))
    # Only spans with enough votes are verified; those of one pair that repeats have votes, but no chain.
    likely = spanned.filter(F.col("votes") >= MIN_SHARE * F.col("pairs")).select("id", "text_key", "template", "diagonal", "span")
    places = hits.join(likely, ["id", "text_key", "template", "diagonal"]).groupBy(*keys, "span").agg(
        F.min("p").alias("first"), (F.max("p") + 2).alias("last"), F.array_sort(F.collect_list(F.struct("p", (-(F.col("p") - F.col("diagonal"))).alias("back")))).alias("places"))
    whole = places.withColumn("share", chain_length("places") / F.col("pairs")).filter(F.col("share") >= MIN_SHARE)
    columns = ["id", "text_key", "template", "base", "label", "first", "last", "share"]
    return phrase.select(*columns).unionByName(whole.select(*columns))


def chain_length(places: str) -> Column:
    """Most places whose words of the text and of the template both increase; ``places`` are structs (p, back = -word of the template) in order.

    The ends of the chains of each length are kept; there are no more than the template has pairs.
    """
    def put(ends: Column, place: Column) -> Column:
        at = -place["back"]
        shorter = F.size(F.filter(ends, lambda e: e < at))
        return F.concat(F.slice(ends, 1, shorter), F.array(at), F.slice(ends, shorter + 2, F.greatest(F.size(ends) - shorter - 1, F.lit(0))))

    return F.aggregate(places, F.array().cast("array<int>"), put, F.size)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """Verified license spans of every text: ``id_col``, ``text_key`` and the columns of ``spans``.

    ``known`` is another table of ``templates``, small enough to be sent to all tasks.
    """
    pairs = known if known is not None else templates(docs.sparkSession)
    return spans(checkpointed(votes(docs, pairs, id_col, text_col))).withColumnRenamed("id", id_col)


def summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: words, base places, labels and a score (best share among its spans)."""
    pairs = known if known is not None else templates(docs.sparkSession)
    found = checkpointed(votes(docs, pairs, id_col, text_col))  # read by several branches
    place = F.when(F.col("base"), F.col("first"))
    no_span = [F.lit(None).cast(t).alias(n) for n, t in (("base", "boolean"), ("label", "string"), ("first", "int"), ("share", "double"))]
    rows = found.filter("template IS NULL").select("id", "text_key", F.coalesce(F.col("p") + 1, F.lit(0)).alias("n_words"), "copies", *no_span)
    marks = spans(found).select("id", "text_key", F.lit(None).cast("int").alias("n_words"), F.lit(None).cast("long").alias("copies"), "base", "label", "first", "share")
    per_text = rows.unionByName(marks).groupBy("id", "text_key").agg(
        F.max("n_words").cast("long").alias("n_words"), F.max("copies").alias("copies"), F.count(place).alias("n_base"),
        F.min(place).cast("long").alias("first_word"), F.max(place).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"), F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
    )
    per_row = per_text.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return per_row.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
