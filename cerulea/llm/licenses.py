"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a line of a text. Tokens of the templates are ordered by their frequency in the whole corpus, rarest first. For a template with n tokens of which
a block must hold m = ceil(0.8 n), a block that qualifies holds at least one of the n - m + 1 rarest (prefix filter), at least m template tokens at all
(length filter), and at the first shared token enough tokens follow on both sides (positional filter). The pairs left are verified by counting.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cerulea.llm.common import ascii_lower, read_table, row_key

#: Words of lower-cased text, and what lies between words; the second pair is for text in any case.
WORD, GAP = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

TEMPLATES = (
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("isc", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)
CONTAINMENT = 0.8


def tokens(text: str) -> list[str]:
    return sorted(set(re.findall(WORD, text.translate({c: c + 32 for c in range(65, 91)}))))


def needed(n: int, containment: float) -> int:
    return math.ceil(containment * n - 1e-9)


def folding(vocabulary: list[str]):
    """A lower-casing that finds every word of ``vocabulary``: the quick lower(), where all of them are ASCII, as only ASCII words become those; else that of A-Z alone."""
    return F.lower if all(t.isascii() for t in vocabulary) else lambda c: ascii_lower(F.col(c))


def token_counts(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How often each template token occurs in all texts. One row a token comes back: as many as the templates have."""
    spark = docs.sparkSession
    known = spark.createDataFrame([(t,) for t in vocabulary], "token string")
    words = docs.select(F.explode(F.split(F.col("text"), f"(?:{ANY_WORD.replace('[^', '[').rstrip('+')})+")).alias("word"))
    # the exact rule, A-Z only, is applied to what the quick one finds
    hits = words.join(F.broadcast(known), (folding(vocabulary)("word") == F.col("token")) & (ascii_lower(F.col("word")) == F.col("token")))
    return {t: 0 for t in vocabulary} | {r["token"]: r["n"] for r in hits.groupBy("token").agg(F.count("*").alias("n")).collect()}


def matching_blocks(docs: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, own, line, template, label, overlap, containment): every line that holds at least ``containment`` of a template's tokens.

    Sets of distinct words of A-Z lower-cased lines; null and empty texts have no lines that match. Exact for any template with a token. own is the key of id and text,
    so lines of null ids, and of rows with one id and other texts, are told apart; rows that repeat both give their lines once. An empty table gives no rows.
    """
    spark = docs.sparkSession
    sets = [(label, tokens(text)) for label, text in templates]
    vocabulary = sorted({t for _, ts in sets for t in ts})
    counts = token_counts(docs, vocabulary)
    ranks = {t: k for k, t in enumerate(sorted(vocabulary, key=lambda t: (counts[t], t)))}
    index, whole = [], []
    for k, (label, ts) in enumerate(sets):
        order, m = sorted(ranks[t] for t in ts), needed(len(ts), containment)
        index += [(r, k, i, len(ts), m) for i, r in enumerate(order[: len(ts) - m + 1])]
        whole.append((k, label, order, len(ts), m))
    prefixes = sorted({t for t, r in ranks.items() if any(r == x[0] for x in index)})
    index = spark.createDataFrame(index, "rank int, template int, i int, n int, need int")
    whole = spark.createDataFrame(whole, "template int, label string, ranks array<int>, n int, need int")

    known = F.array(*[F.lit(t) for t in prefixes])
    likely = docs.select("doc_id", "text").where(F.arrays_overlap(F.split(folding(vocabulary)("text"), GAP), known))
    lines = likely.select("doc_id", row_key().alias("own"), F.posexplode(F.split("text", "\n")).alias("line", "block"))
    rank_of = F.create_map(*[x for t, r in ranks.items() for x in (F.lit(t), F.lit(r))])
    held = F.array_sort(F.array_compact(F.transform(F.array_distinct(F.split(ascii_lower(F.col("block")), GAP)), lambda t: F.try_element_at(rank_of, t))))
    blocks = lines.select("doc_id", "own", "line", held.alias("held")).where(F.size("held") > 0)
    shared = blocks.select("doc_id", "own", "line", "held", F.posexplode("held").alias("j", "rank"))
    position = 1 + F.least(F.col("n") - F.col("i") - 1, F.size("held") - F.col("j") - 1) >= F.col("need")
    pairs = shared.join(F.broadcast(index), "rank").where((F.size("held") >= F.col("need")) & position).select("doc_id", "own", "line", "held", "template").distinct()
    overlap = F.size(F.array_intersect("held", "ranks"))
    return pairs.join(F.broadcast(whole), "template").withColumn("overlap", overlap).where(F.col("overlap") >= F.col("need")).select("doc_id", "own", "line", "template", "label", "overlap", (F.col("overlap") / F.col("n")).alias("containment"))


def _spaces(col):
    return F.length(col) - F.length(F.replace(col, F.lit(" "), F.lit("")))


def phrase_places(docs: DataFrame) -> DataFrame:
    """(doc_id, own, n_words, n_base, first_word, last_word, base_labels): where the words of a phrase stand consecutively; null texts count as empty."""
    text = F.coalesce("text", F.lit(""))
    rough = "(?i)cc|license|reserved"
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(F.col("text")), GAP, " ")), F.lit(" "))
    rows = docs.select("doc_id", row_key().alias("own"), F.regexp_count(text, F.lit(ANY_WORD)).cast("long").alias("n_words"), F.when(F.col("text").rlike(rough), plain).alias("plain"))
    counts, firsts, lasts = [], [], []
    for k, (phrase, _) in enumerate(PHRASES):
        spaced, long = f" {phrase} ", len(phrase) + 1
        n = F.coalesce((F.length("plain") - F.length(F.regexp_replace("plain", f" {phrase}(?= )", ""))) / long, F.lit(0)).cast("long")
        found = F.col("plain").contains(spaced)
        counts.append(n.alias(f"n{k}"))
        firsts.append(F.when(found, _spaces(F.substring_index("plain", spaced, 1))))
        lasts.append(F.when(found, F.col("n_words") - _spaces(F.substring_index("plain", spaced, -1)) - len(phrase.split())))
    labels = [F.when(F.col(f"n{k}") > 0, label) for k, (_, label) in enumerate(PHRASES)]
    rows = rows.select("*", *counts).select("*", F.least(*firsts).cast("long").alias("first_word"), F.greatest(*lasts).cast("long").alias("last_word"))
    return rows.select("doc_id", "own", "n_words", sum((F.col(f"n{k}") for k in range(1, len(PHRASES))), F.col("n0")).alias("n_base"), "first_word", "last_word", F.array_sort(F.array_compact(F.array(*labels))).alias("base"))


def scanned(docs: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """A row for each document: the places of the phrases, and the labels of phrases and of templates that a line matches.

    score: 1 with a phrase, else the highest containment of a template found, else 0. Every row has the labels of its own text, null ids and
    rows with one id and other texts included; rows that repeat both stay and are alike. An empty table gives no rows.
    """
    found = matching_blocks(docs, templates, containment).groupBy("own").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"), F.count("*").alias("n_blocks"))
    more = F.coalesce("more", F.array().cast("array<string>"))
    return (
        phrase_places(docs)
        .join(found, "own", "left")
        .select(
            "doc_id",
            "n_words",
            "n_base",
            "first_word",
            "last_word",
            F.array_join("base", ",").alias("base_labels"),
            F.array_join(F.array_sort(F.array_union("base", more)), ",").alias("labels"),
            F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
            F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"),
        )
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(read_table(spark, sf_dir, "documents"))


def _sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    phrases = ", ".join(f"('{p}', string_split('{p}', ' '), '{label}')" for p, label in PHRASES)
    templates = ", ".join(f"({k}, '{label}', {tokens(text)!r}, {needed(len(tokens(text)), CONTAINMENT)})" for k, (label, text) in enumerate(TEMPLATES))
    return rf"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), '{upper}', '{lower}') AS text FROM documents),
d AS (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS words FROM low),
p(phrase, parts, label) AS (VALUES {phrases}),
places AS (
  SELECT doc_id, label, unnest(list_filter(range(len(words) - len(parts) + 1), lambda i: words[i + 1 : i + len(parts)] = parts)) AS spot FROM d CROSS JOIN p
),
base AS (SELECT doc_id, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word, list_sort(list(DISTINCT label)) AS labels FROM places GROUP BY 1),
t(k, label, toks, need) AS (VALUES {templates}),
blocks AS (SELECT doc_id, list_distinct(regexp_extract_all(line, '{WORD}')) AS held FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM low)),
hits AS (SELECT doc_id, label, len(list_intersect(held, toks)) / len(toks) AS containment FROM blocks JOIN t ON len(list_intersect(held, toks)) >= need),
more AS (SELECT doc_id, list(DISTINCT label) AS labels, max(containment) AS best, count(*) AS n_blocks FROM hits GROUP BY 1)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(base.labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ','), '') AS labels,
  CASE WHEN coalesce(n_base, 0) > 0 THEN 1.0 ELSE coalesce(best, 0) END::DOUBLE AS score, coalesce(n_blocks, 0)::BIGINT AS n_blocks
FROM d LEFT JOIN base ON base.doc_id = d.doc_id LEFT JOIN more ON more.doc_id = d.doc_id
"""


ORACLE_SQL = {"op2_license_scan": _sql()}
