"""License phrases and notices in texts, by an exact set-similarity join in built-in functions only.

A text's words are cut into blocks per template: block b of a template of L words holds the words
from b * L on, 2 * L of them, so every stretch of L words lies whole in one block. A block matches if it
holds at least the share `containment` of the template's distinct words.

Tokens are ordered by their document frequency over all texts, rarest first. A block with
enough of a template's n words must hold one of its n - needed + 1 rarest (its prefix); so only texts with such a
word go on, and only blocks around one. They are joined to the templates by it, and blocks too
short, without a common token in both prefixes, or whose places of the first common token leave too few
tokens behind them are out before the sets are compared. Phrases are joined the same way by their rarest word and compared in order.

The templates are a parameter and as small as a plan; nothing else is collected or broadcast by force.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.session import staged

#: Phrases that are counted wherever their words stand consecutively, with their labels.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

#: Notices as their publishers word them, with labels of this operator.
NOTICES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mit", "Released under the MIT License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
            "License as published by the Free Software Foundation"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc0-1.0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

#: The least share of a template's distinct words.
CONTAINMENT = 0.9

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: All but digits, letters and what is not ASCII.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none of a null one."""
    cut = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BETWEEN)
    return F.array_remove(cut, "")


def plain_words(text: str) -> list[str]:
    """`words` of a template, in Python: ASCII letters and digits, and whatever is not ASCII."""
    lowered = "".join(c.lower() if c.isascii() else c for c in text)
    return "".join(c if c.isalnum() or not c.isascii() else " " for c in lowered).split(" ") if text else []


def template_table(notices: list[tuple[str, str]], phrases: list[tuple[str, str]], containment: float) -> list[dict]:
    """Templates with their words, distinct tokens and the number of tokens needed; phrases need all, in order."""
    made = []
    for kind, listed in (("notice", notices), ("phrase", [(label, phrase) for phrase, label in phrases])):
        for label, text in listed:
            found = [w for w in plain_words(text) if w]
            distinct = sorted(set(found))
            needed = len(distinct) if kind == "phrase" else next(
                n for n in range(len(distinct) + 1) if n >= containment * len(distinct) - 1e-9)
            made.append({"kind": kind, "label": label, "words": found, "tokens": distinct, "needed": needed})
    return made


def token_frequencies(docs: DataFrame, text: str, vocabulary: list[str]) -> dict[str, int]:
    """In how many texts each token of the templates is; as many rows as the templates have tokens."""
    known = F.array(*map(F.lit, vocabulary))
    distinct = docs.select(F.explode(F.array_intersect(words(F.col(text)), known)).alias("token"))
    return {r["token"]: r["n"] for r in distinct.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}


def prefix_index(templates: list[dict], frequency: dict[str, int]) -> list[tuple]:
    """Rows (token, template, kind, label, words, tokens, needed, place, offset) of the prefixes; tokens are in the global order."""
    rows = []
    for n, t in enumerate(templates):
        ordered = sorted(t["tokens"], key=lambda w: (frequency.get(w, 0), w))
        for place, token in enumerate(ordered[:len(ordered) - t["needed"] + 1]):
            rows.append((token, n, t["kind"], t["label"], t["words"], ordered, t["needed"], place, t["words"].index(token)))
    return rows


_INDEX = ("token string, template int, kind string, label string, words array<string>, tokens array<string>, needed int, "
          "place int, offset int")


def scan(docs: DataFrame, notices: list[tuple[str, str]] = NOTICES, phrases: list[tuple[str, str]] = PHRASES,
         containment: float = CONTAINMENT, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (row, doc_id, n_words) of all rows of `docs`, and their matches (row, kind, label, at, n, score).

    A phrase matches at every word `at` where its words stand consecutively (score 1); a notice in every block of `n`
    words from word `at` on that holds enough of its distinct words, `score` being their share. Whole texts are read; a
    null text is an empty one. Rows are taken as they are, null and repeated ids too; other columns are not read. An empty
    table has no matches.
    """
    spark = docs.sparkSession
    templates = template_table(notices, phrases, containment)
    vocabulary = sorted({w for t in templates for w in t["tokens"]})
    frequency = token_frequencies(docs, text, vocabulary)
    index = prefix_index(templates, frequency)
    longest = max(len(t["words"]) for t in templates)
    prefixes = F.array(*map(F.lit, sorted({r[0] for r in index})))
    found = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("doc_id"), words(F.col(text)).alias("words"))
    rows = staged(found.select("row", "doc_id", F.size("words").cast("long").alias("n_words"),
                               F.when(F.arrays_overlap("words", prefixes), F.col("words")).alias("words")), "licensed")
    # every place of a prefix token, with the words around it that any block over it can hold
    places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.array_contains(prefixes, F.get("words", i)))
    around = F.transform(places, lambda i: F.struct(
        i.alias("at"), F.get("words", i).alias("token"), F.greatest(i - 2 * longest, F.lit(0)).alias("first"),
        F.slice("words", F.greatest(i - 2 * longest, F.lit(0)) + 1, F.lit(4 * longest)).alias("near")))
    hits = rows.where("words IS NOT NULL").select("row", "n_words", F.explode(around).alias("x")).select("row", "n_words", "x.*")
    met = hits.join(spark.createDataFrame(index, _INDEX), "token")
    start = F.col("at") - F.col("offset")
    in_order = met.where("kind = 'phrase'").where(start >= 0).where(
        F.slice("near", start - F.col("first") + 1, F.size("words")) == F.col("words"))
    placed = in_order.select("row", "kind", "label", start.cast("long").alias("at"), F.size("words").cast("long").alias("n"),
                             F.lit(1.0).alias("score"))
    step = F.size("words")
    last = F.floor(F.col("at") / step).cast("int")
    blocks = met.where("kind = 'notice'").withColumn("step", step).withColumn(
        "block", F.explode(F.array_distinct(F.array(F.greatest(last - 1, F.lit(0)), last))))
    blocks = blocks.withColumn("n", F.least(F.col("n_words") - F.col("block") * F.col("step"), 2 * F.col("step").cast("long")))
    blocks = blocks.where(F.col("n") >= F.col("needed"))  # the length filter
    held = F.slice("near", F.col("block") * F.col("step") - F.col("first") + 1, F.col("n").cast("int"))
    # the block's tokens of the templates in the global order: what else it holds matches nothing
    ranks = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
    order = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])
    known = F.array(*map(F.lit, vocabulary))
    sorted_tokens = F.transform(F.array_sort(F.transform(F.array_intersect(known, held), lambda w: F.struct(F.element_at(order, w).alias("r"), w.alias("w")))),
                                lambda x: x["w"])
    kept = blocks.withColumn("have", sorted_tokens).withColumn("spot", F.array_position("have", F.col("token")))
    in_prefix = F.col("spot") <= F.size("have") - F.col("needed") + 1
    # tokens from the common one on, on both sides; earlier ones are no common prefix token of this row's kind
    left = F.least(F.size("tokens") - F.col("place"), F.size("have") - F.col("spot") + 1)
    first_common = F.get(F.array_intersect("tokens", "have"), F.lit(0)) == F.col("token")
    verified = kept.where(in_prefix & (left >= F.col("needed")) & first_common).withColumn(
        "both", F.size(F.array_intersect("tokens", "have"))).where(F.col("both") >= F.col("needed"))
    blocked = verified.select("row", "kind", "label", (F.col("block") * F.col("step")).cast("long").alias("at"), "n",
                              (F.col("both") / F.size("tokens")).alias("score"), "template").distinct().drop("template")
    return rows.select("row", "doc_id", "n_words"), placed.unionByName(blocked)


def licensed_documents(docs: DataFrame, **options) -> DataFrame:
    """Per row of `docs` (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score); options of `scan`.

    `n_base` counts the places of phrases, `first_word` and `last_word` are their smallest and largest start; labels are distinct,
    sorted and comma-joined, `labels` holds those of notices too. `score` is the highest share of a match (1 for a phrase), else 0.
    """
    rows, matches = scan(docs, **options)
    base = F.col("kind") == "phrase"
    per_row = matches.groupBy("row").agg(  # a row has at most as many labels as there are templates
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("at"))).alias("first_word"),
        F.max(F.when(base, F.col("at"))).alias("last_word"), F.collect_set(F.when(base, F.col("label"))).alias("base"),
        F.collect_set("label").alias("all"), F.max("score").alias("score"))
    empty = F.lit("")
    return rows.join(per_row, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce(F.array_join(F.array_sort("base"), ","), empty).alias("base_labels"),
        F.coalesce(F.array_join(F.array_sort("all"), ","), empty).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))

