"""License scan: fixed phrases, and an exact set-similarity join with license templates.

DataFrame functions only. A *block* is a line of a text, or two lines that follow one another and
have at most ``WRAPPED`` characters each, as a notice that is broken over two lines has; a block
matches a template where it holds at least ``THRESHOLD`` of the template's distinct words. The join finds every such pair:

* words are ordered by how many blocks of the corpus have them, rarest first;
* *prefix filter*: a template of ``n`` words that needs ``o`` of them shares one of its first
  ``n - o + 1`` with any block that matches, so only these are joined with the blocks' words;
* *length filter*: the block has at least ``o`` words of the templates' vocabulary;
* *positional filter*: the words after the common one, on the shorter side, can still make up ``o``;
* the overlap of the pairs that are left is counted.

Texts are never shuffled: a block is reduced at once to its words of the vocabulary, which the
templates bound, and what is joined back to the documents are the matches.

Null texts are empty: no words, no labels, score 0. Rows that agree in ``doc_id`` and text get the
same result; a null ``doc_id`` is kept. An empty table gives no rows. Columns other than
``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import stash, table

THRESHOLD, WRAPPED = 0.9, 120

#: Phrases and their labels: every place of one counts.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Label and words of each template.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(lower, _GAP), lambda w: w != "")


def _places(words: Column, phrase: str) -> Column:
    """The word numbers at which a phrase starts."""
    parts = phrase.split()
    starts = F.sequence(F.lit(0), F.size(words) - len(parts))

    def here(i: Column) -> Column:
        found = F.get(words, i) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            found = found & (F.get(words, i + k) == p)
        return found

    return F.when(F.size(words) >= len(parts), F.filter(starts, here)).otherwise(F.array().cast("array<int>"))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k1"), F.xxhash64(text).alias("k2"))


def phrase_places(docs: DataFrame) -> DataFrame:
    """k1, k2, doc_id, n_words, places (word numbers) and base_labels (sorted) of each document."""
    text = F.col("text")
    # every phrase ends in this word; the others never reach the splitting
    split = F.when(text.rlike("(?i)license"), _words(text)).otherwise(F.array().cast("array<string>"))
    some = _keyed(docs).select("k1", "k2", "doc_id", F.regexp_count(text, F.lit(_WORD_ANY_CASE)).cast("long").alias("n_words"), split.alias("words"))
    found = some.withColumns({f"at_{label}": _places(F.col("words"), p) for p, label in PHRASES.items()})
    labels = F.array_sort(F.array_compact(F.array(*(F.when(F.size(f"at_{x}") > 0, x) for x in PHRASES.values()))))
    return found.select("k1", "k2", "doc_id", "n_words", F.flatten(F.array(*(f"at_{x}" for x in PHRASES.values()))).alias("places"), labels.alias("base_labels"))


def template_matches(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(k1, k2, block, lines, label, containment) of each block, by its first line and their number, and template that reach the threshold."""
    spark = docs.sparkSession
    bags = [(k, label, sorted(set(words.split()))) for k, (label, words) in enumerate(templates)]
    need = {k: math.ceil(threshold * len(bag) - 1e-9) for k, _, bag in bags}
    vocabulary = sorted({w for _, _, bag in bags for w in bag})
    split = F.split("text", "\n")
    pairs = F.arrays_zip(split.alias("line"), F.slice(split, F.lit(2), F.size(split)).alias("after"))
    lines = _keyed(docs).select("k1", "k2", F.posexplode(pairs).alias("block", "pair")).select("k1", "k2", "block", "pair.line", "pair.after")
    known = lambda text: F.array_intersect(_words(text), F.array(*map(F.lit, vocabulary)))
    wrapped = (F.length("line") <= WRAPPED) & (F.length("after") <= WRAPPED)
    both = F.when(wrapped, known(F.concat_ws(" ", "line", "after")))
    each = F.array(F.struct(F.lit(1).alias("lines"), known(F.col("line")).alias("words")), F.struct(F.lit(2).alias("lines"), both.alias("words")))
    blocks = lines.select("k1", "k2", "block", F.explode(each).alias("x")).select("k1", "k2", "block", "x.lines", "x.words")
    blocks = stash(blocks.where(F.size("words") > 0), "blocks")

    # at most one row for each word of the vocabulary
    counts = {r["word"]: r["n"] for r in blocks.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    rank = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    prefixes, whole = [], []
    for k, label, bag in bags:
        ordered = sorted(rank[w] for w in bag)
        whole.append((k, label, ordered, len(bag), need[k]))
        prefixes += [(k, r, at) for at, r in enumerate(ordered[: len(bag) - need[k] + 1])]
    prefix = spark.createDataFrame(prefixes, "template int, rank int, template_at int")
    full = spark.createDataFrame(whole, "template int, label string, ranks array<int>, n int, need int")
    probe = F.broadcast(prefix.join(F.broadcast(full), "template"))  # a few rows for each template

    ranks = F.create_map(*(F.lit(x) for w, r in rank.items() for x in (w, r)))
    mine = F.array_sort(F.transform("words", lambda w: ranks[w]))
    long_enough = blocks.where(F.size("words") >= min(need.values())).select("k1", "k2", "block", "lines", mine.alias("mine"))
    dealt = long_enough.select("k1", "k2", "block", "lines", "mine", F.posexplode("mine").alias("block_at", "rank"))
    left = F.least(F.col("n") - F.col("template_at"), F.size("mine") - F.col("block_at"))
    pairs = dealt.join(probe, "rank").where((F.size("mine") >= F.col("need")) & (left >= F.col("need")))
    overlap = F.size(F.array_intersect("mine", "ranks"))
    checked = pairs.where(overlap >= F.col("need")).select("k1", "k2", "block", "lines", "template", "label", (overlap / F.col("n")).alias("containment"))
    return checked.distinct().drop("template")


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document: its phrases' places and labels, and all labels with the best containment.

    ``score`` is 1 where a phrase stands, else the best containment of a template, else 0.
    """
    matched = template_matches(docs, templates, threshold).groupBy("k1", "k2").agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"))
    rows = phrase_places(docs).join(matched, ["k1", "k2"], "left")
    base, found = F.col("base_labels"), F.coalesce("found", F.array().cast("array<string>"))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, found)), ",").alias("labels"),
        F.when(F.size(base) > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    values = ", ".join(f"({k}, '{label}', {sorted(set(words.split()))!r}, {math.ceil(THRESHOLD * len(set(words.split())) - 1e-9)})" for k, (label, words) in enumerate(TEMPLATES))
    places = []
    for p, label in PHRASES.items():
        parts = p.split()
        test = " AND ".join(f"words[i + {k}] = '{w}'" for k, w in enumerate(parts))
        places.append(f"SELECT doc_id, i - 1 AS place, '{label}' AS label FROM starts WHERE {test}")
    lower = f"translate(%s, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    split = "list_filter(regexp_split_to_array(" + lower + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, {split % "text"} AS words FROM t),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w WHERE list_contains(words, 'license')),
places AS ({" UNION ALL ".join(places)}),
base AS (SELECT doc_id, count(*) AS n, min(place) AS lo, max(place) AS hi, list(DISTINCT label) AS ls FROM places GROUP BY doc_id),
templates(k, label, bag, need) AS (VALUES {values}),
listed AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM t),
placed AS (SELECT doc_id, ls, unnest(range(1, len(ls))) AS i FROM listed),
blocks AS (SELECT doc_id, unnest(ls) AS line FROM listed UNION ALL SELECT doc_id, ls[i] || ' ' || ls[i + 1] FROM placed WHERE len(ls[i]) <= {WRAPPED} AND len(ls[i + 1]) <= {WRAPPED}),
bags AS (SELECT doc_id, {split % "line"} AS words FROM blocks),
hits AS (SELECT doc_id, label, len(list_intersect(bag, words)) / len(bag) AS c FROM bags JOIN templates ON len(list_intersect(bag, words)) >= need),
found AS (SELECT doc_id, list(DISTINCT label) AS ls, max(c) AS best FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(base.n, 0) AS BIGINT) AS n_base,
       CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word,
       coalesce(array_to_string(list_sort(base.ls), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.ls, []), coalesce(found.ls, [])))), ','), '') AS labels,
       CAST(CASE WHEN base.n > 0 THEN 1.0 ELSE coalesce(best, 0.0) END AS DOUBLE) AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)
"""


ORACLE = _oracle()
