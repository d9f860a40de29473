"""License scan: an exact set-similarity join of text blocks with license notices.

Texts are lower-cased (A-Z only) and cut into words.  A block is a run of ``lines``
consecutive lines, reduced to its set of words that occur in any template.  All
sets are ordered by how many texts hold a word, rarest first.  A block is a
match where it holds at least ``percent`` of a template's words.  Such a pair
shares a word of both prefixes (the rarest words, as many as may be missing and one
more), so blocks and templates are joined on prefix words; a pair goes on only if
the block has enough words (length) and enough words are left from the shared word on in
both orders (position), and is then confirmed on the whole sets.

Phrases are found apart from that, as places where their words stand
consecutively.  Everything runs in SQL functions.  The templates, their words and
the word counts are of fixed size; blocks never leave their rows but as short arrays of word
ranks, and only rows with a match are shuffled, by a row number.

Null, empty and wordless texts have no words, places or labels and score 0.
Very long texts are scanned whole, line by line.  Repeated rows are rows of
their own, whatever their id; ties of word counts go by the word.  An empty
table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import written

# Phrases with their labels, and the wording of public license notices.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("epl", "made available under the terms of the eclipse public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("boost", "distributed under the boost software license version 1 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "to the extent possible under law waived all copyright and related or neighboring rights to this work"),
    ("cc-by", "this work is licensed under a creative commons attribution license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("reserved", "all rights reserved"),
]
PERCENT, LINES = 90, 3
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z to a-z.  Of all other characters only the Kelvin sign and the dotted
    capital I have ASCII letters as lower case; they become another letter first."""
    text = F.coalesce(text, F.lit(""))
    odd = text.contains("K") | text.contains("İ")
    return F.lower(F.when(odd, F.translate(text, "Kİ", "ßß")).otherwise(text))


def spaced(low: Column) -> Column:
    """The words of a lower-cased text, each between two blanks of its own; empty without words."""
    words = F.trim(F.regexp_replace(low, _GAPS, "  "))
    return F.when(words == "", "").otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def count_words(line: Column) -> Column:
    """Number of words of a ``spaced`` text."""
    return F.when(line == "", 0).otherwise(F.length(line) - F.length(F.replace(line, F.lit("  "), F.lit(" "))) + 1).cast("long")


def with_phrases(df: DataFrame, line: str, phrases: Mapping[str, str]) -> DataFrame:
    """``df`` with n_words, n_base (all places of all phrases), first_word,
    last_word and base_set (labels) of the ``spaced`` column ``line``."""
    df = df.withColumn("n_words", count_words(F.col(line)))
    places, firsts, lasts, found = [], [], [], []
    for phrase, label in phrases.items():
        own = "  ".join(phrase.split())
        key = F.lit(f" {own} ")
        has = F.col(line).contains(key)
        # words keep blanks of their own, so neighbouring places do not overlap
        places.append(F.when(has, F.size(F.split(line, f" {own} ")) - 1).otherwise(0))
        firsts.append(F.when(has, count_words(F.substring_index(line, f" {own} ", 1))))
        lasts.append(F.when(has, F.col("n_words") - count_words(F.substring_index(line, f" {own} ", -1)) - len(phrase.split())))
        found.append(F.when(has, F.lit(label)))
    return df.withColumns({
        "n_base": sum(places, F.lit(0)).cast("long"),
        "first_word": F.least(*firsts, F.lit(None).cast("long")), "last_word": F.greatest(*lasts, F.lit(None).cast("long")),
        "base_set": F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))})


def word_order(lines: DataFrame, line: str, templates: Sequence[tuple[str, str]]) -> list[str]:
    """The templates' words, those of the fewest texts first; the driver gets
    one count a template word."""
    words = sorted({w for _, body in templates for w in body.split()})
    held = F.array_intersect(F.split(line, " +"), F.lit(words))
    got = {r[0]: r[1] for r in lines.select(F.explode(held).alias("word")).groupBy("word").count().collect()}
    return sorted(words, key=lambda w: (got.get(w, 0), w))


def template_table(order: Sequence[str], templates: Sequence[tuple[str, str]], percent: int) -> list[tuple[str, list[int], int]]:
    """(label, ascending word ranks from 1, number of words needed) of each template."""
    at = {w: i for i, w in enumerate(order, 1)}
    sets = [(label, sorted({at[w] for w in body.split()})) for label, body in templates]
    return [(label, ranks, -(-percent * len(ranks) // 100)) for label, ranks in sets]


def blocks(low: Column, order: Sequence[str], table: Sequence[tuple[str, list[int], int]], lines: int) -> Column:
    """Ascending word ranks of the blocks of a lower-cased text that hold a prefix word of any template."""
    rare = sorted({order[r - 1] for _, ranks, need in table for r in ranks[:len(ranks) - need + 1]})
    pattern = f"(?<= )(?:{'|'.join(rare)})(?= )"
    rows = F.split(low, r"[\x0A-\x0D]+")
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(rows) - (lines - 1), F.lit(1))),
                       lambda i: spaced(F.concat_ws(" ", F.slice(rows, i, lines))))
    known = F.lit(list(order))
    ranks = F.transform(F.filter(runs, lambda b: b.rlike(pattern)), lambda b: F.array_sort(
        F.transform(F.array_intersect(F.split(b, " +"), known), lambda w: F.array_position(known, w).cast("int"))))
    return F.when(F.col("line").rlike(pattern), F.array_distinct(ranks))


def matches(found: DataFrame, table: Sequence[tuple[str, list[int], int]]) -> DataFrame:
    """(row, label, share) of every block (row, ranks) and template of which it holds enough words."""
    spark = found.sparkSession
    fewest = min(need for _, _, need in table)
    rows = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(own).alias("own"), F.lit(need).alias("need")) for label, own, need in table])
    rules = spark.range(1).select(F.explode(rows).alias("t")).select("t.*")
    heads = rules.select("label", "own", "need", F.posexplode(F.slice("own", F.lit(1), F.size("own") - F.col("need") + 1)).alias("j", "word"))
    long = found.where(F.size("ranks") >= fewest)
    sides = long.select("row", "ranks", F.posexplode(F.slice("ranks", F.lit(1), F.size("ranks") - fewest + 1)).alias("i", "word"))
    # the templates are a fixed list, so that side is always small
    pairs = sides.join(F.broadcast(heads), "word").where(F.size("ranks") >= F.col("need")).where(
        F.least(F.size("ranks") - F.col("i"), F.size("own") - F.col("j")) >= F.col("need"))
    shared = F.size(F.array_intersect("ranks", "own"))
    return pairs.withColumn("shared", shared).where("shared >= need").select("row", "label", (F.col("shared") / F.size("own")).alias("share"))


def scan(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES,
         percent: int = PERCENT, lines: int = LINES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score)
    of every row; ``score`` is the largest share of a matched template's words,
    1 where a phrase stands, else 0."""
    base = docs.select(key, lowered(F.col(text)).alias("low")).withColumn("line", spaced(F.col("low")))
    order = word_order(base.select("line"), "line", templates)
    table = template_table(order, templates, percent)
    held = with_phrases(base, "line", phrases).withColumn("blocks", blocks(F.col("low"), order, table, lines))
    rows = written(held.drop("low", "line").withColumn("row", F.monotonically_increasing_id()), "license-blocks")
    hits = matches(rows.where("blocks is not null").select("row", F.explode("blocks").alias("ranks")), table)
    per_row = hits.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    labels = F.array_sort(F.array_union("base_set", F.coalesce("more", F.array().cast("array<string>"))))
    out = rows.drop("blocks").join(per_row, "row", "left")
    return out.select(key, "n_words", "n_base", "first_word", "last_word", F.array_join("base_set", ",").alias("base_labels"),
                      F.array_join(labels, ",").alias("labels"),
                      F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))
