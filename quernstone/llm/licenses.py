r"""License scans: an exact set-similarity join of text blocks with templates (DataFrame only).

A block is a run of a text's words, whatever line breaks and marks stand between them: runs of 2S words
start at every S-th word, so each passage of up to S + 1 words is whole in one of them. S is 24 for the
templates of up to 25 words and 96 for the longer ones. A template is the word set of a license
statement; a block matches where it holds at least `threshold` of the template's distinct words and
all those that tell its license from others (`MUST`).

Words are ordered by their count in the corpus, rarest first; of a block only words of templates
count. Candidates come from an equi-join on prefix words: a matching block must hold one of a
template's first |T| - need + 1 words, need = ceil(threshold * |T|). The length filter drops blocks with
fewer than need such words. The positional filter looks at the first shared word, at place p of the
template's words and q of the block's: no more than min(|T| - p, |B| - q) can be shared.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import checkpoint, read
from quernstone.llm.spans import prefix_sums

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
THRESHOLD = 0.85
STRIDES = (24, 96)
#: (label, statement); a fixed list, so the join's broadcast side has a known size.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the "
            "software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
            "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject "
            "to the following conditions"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
            "the above copyright notice and this permission notice appear in all copies"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you "
               "may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is "
               "basis without warranties or conditions of any kind either express or implied"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
            "published by the free software foundation either version 3 of the license or at your option any later version this program is "
            "distributed in the hope that it will be useful but without any warranty"),
    ("lgpl", "licensed under the gnu lesser general public license version 3"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
            "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in "
            "the documentation and or other materials provided with the distribution"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced without written permission"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
#: Words without which a block is no statement of this license.
MUST = {
    "mit": (), "isc": ("fee",), "apache": (), "gpl": ("general", "public"), "lgpl": ("lesser",), "bsd": (), "cc-by-nc": ("cc", "nc"),
    "cc-by-sa": ("cc", "sa"), "cc-by": ("creative", "commons", "attribution"), "cc0": ("waived",), "mpl": ("mozilla",),
    "proprietary": ("reserved", "reproduced"), "unlicense": ("unencumbered",),
}
#: The same for single statements whose license is told by one word only.
NAMES = ("mit", "apache", "gnu", "lesser", "mozilla")


def normal(text: Column) -> Column:
    """Words of the text, lower-cased in A-Z, between single spaces: ' a b ', or ' ' without words."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.concat(F.lit(" "), lower, F.lit(" ")), SEPARATORS, " ")


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, " ", ""))


def phrase_places(norm: Column, phrase: str) -> Column:
    """array<int>: the first words' places wherever the phrase's words stand consecutively.

    Splitting at ' ' + first word + ' ' would hide overlaps, so the split is at the phrase behind a
    space that is looked at but not consumed; no phrase here overlaps itself.
    """
    parts = F.split(norm, "(?<= )" + phrase + "(?= )", -1)
    before = F.slice(parts, F.lit(1), F.size(parts) - 1)
    more = len(phrase.split()) - 1
    gaps = F.transform(before, _spaces)
    # each part but the last ends with the space before the phrase; the next starts with the one after
    places = F.zip_with(gaps, prefix_sums(F.transform(gaps, lambda n: n + more)), lambda n, at: at + n - 1)
    return F.when(norm.contains(" " + phrase + " "), places).otherwise(F.expr("cast(array() as array<int>)"))


def word_counts(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """Occurrences of each of `words` (a fixed list) in all texts; pre-aggregated before the shuffle."""
    found = docs.select(F.explode(F.split(normal(F.col("text")), " ")).alias("word")).where(F.col("word").isin(words))
    return {r[0]: r[1] for r in found.groupBy("word").agg(F.count("*")).collect()}


def must(label: str, words: set[str]) -> set[str]:
    """Words of a statement that a block has to hold."""
    return {w for w in (*MUST.get(label, ()), *NAMES) if w in words}


def template_index(templates: tuple[tuple[str, str], ...], order: dict[str, int], threshold: float) -> list[tuple]:
    """(stride, word, place, template, label, words in order, need, must): one row per prefix word of a template."""
    rows = []
    for t, (label, statement) in enumerate(templates):
        words = sorted(set(statement.split()), key=lambda w: order[w])
        need = math.ceil(threshold * len(words) - 1e-9)
        prefix = words[: len(words) - need + 1]
        rows += [(stride_of(statement), w, i, t, label, words, need, sorted(must(label, set(words)))) for i, w in enumerate(prefix)]
    return rows


def stride_of(statement: str) -> int:
    """The least stride whose blocks hold the statement whole."""
    return next(s for s in STRIDES if len(statement.split()) <= s + 1)


def frequency_order(words: list[str], counts: dict[str, int]) -> dict[str, int]:
    """Each word's place, rarest in the corpus first."""
    return {w: i for i, w in enumerate(sorted(set(words), key=lambda w: (counts.get(w, 0), w)))}


INDEX = "stride int, word string, place int, template int, label string, template_words array<string>, need int, must array<string>"
FILTERS = {
    "length": "size(words) >= need",
    "first": "place = first_place",  # the pair's first shared word; later meetings are the same pair
    "position": "least(size(template_words) - place, size(words) - at) >= need",
}


def candidates(blocks: DataFrame, index: list[tuple]) -> DataFrame:
    """Every meeting of a block and a template at a prefix word, with what FILTERS need; blocks: (key.., stride, words in order)."""
    table = blocks.sparkSession.createDataFrame(index, INDEX)
    tokens = blocks.select("*", F.posexplode("words").alias("at", "word"))
    pairs = tokens.join(F.broadcast(table), ["stride", "word"])
    first = F.array_position("template_words", F.element_at(F.array_intersect("template_words", "words"), 1)) - 1
    return pairs.withColumn("first_place", first)


def license_join(blocks: DataFrame, index: list[tuple], key: str = "rid") -> DataFrame:
    """(key, block, stride, label, containment) for every block and template at or above the threshold.

    blocks: (key, block, stride, words: distinct words of templates in the index's order). One row per matching
    block and template; the prefix index is a fixed small table and is broadcast.
    """
    pairs = candidates(blocks, index)
    for condition in FILTERS.values():
        pairs = pairs.where(condition)
    shared = F.size(F.array_intersect("words", "template_words"))
    return (
        pairs.withColumn("shared", shared)
        .where("shared >= need and size(array_except(must, words)) = 0")
        .select(key, "block", "stride", "label", (F.col("shared") / F.size("template_words")).alias("containment"))
    )


def windows(words: Column, stride: int, prefix: list[str], order: list[str]) -> Column:
    """array<struct<block, stride, words>>: the runs that hold a prefix word, with their words of templates in order."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - stride - 1, F.lit(0)), F.lit(stride))
    runs = F.transform(starts, lambda s: F.struct((s / stride).cast("int").alias("block"), F.slice(words, s + 1, F.lit(2 * stride)).alias("run")))
    runs = F.filter(runs, lambda r: F.arrays_overlap(r["run"], F.array(*map(F.lit, prefix))))
    known = F.array(*map(F.lit, order))
    return F.transform(
        runs, lambda r: F.struct(r["block"].alias("block"), F.lit(stride).alias("stride"), F.array_intersect(known, r["run"]).alias("words"))
    )


def scan(
    docs: DataFrame,
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    threshold: float = THRESHOLD,
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """`keep`, n_words, places (phrases' words), base_labels, matches and score for every row.

    Null texts count as empty: no words, no places, empty labels, score 0. Rows that repeat are
    separate rows; an empty table gives an empty result; other columns are ignored. `matches` is
    array<struct<stride, block, label, containment>>, a block being the run of 2 * stride words from word
    block * stride. The texts are read twice, for the words' order and for the scan; what is
    checkpointed and joined afterwards holds only the few runs that own a prefix word of some template.
    """
    words = sorted({w for _, s in templates for w in s.split()})
    order = frequency_order(words, word_counts(docs, words))
    index = template_index(templates, order, threshold)
    gate = "(?<= )(?:" + "|".join(sorted({r[1] for r in index})) + ")(?= )"
    labels = [phrase_places(F.col("_n"), p) for p, _ in PHRASES]
    split = F.split(F.trim("_n"), " ")
    runs = []
    for stride in sorted({r[0] for r in index}):
        mine = {w for _, s in templates if stride_of(s) == stride for w in s.split()}
        prefix = sorted({r[1] for r in index if r[0] == stride})
        runs.append(windows(split, stride, prefix, sorted(mine, key=lambda w: order[w])))
    shortest = min(r[6] for r in index)
    runs = F.filter(F.concat(*runs), lambda r: F.size(r["words"]) >= shortest)
    scanned = (
        docs.select(*keep, F.coalesce("text", F.lit("")).alias("_t"))
        .withColumn("_n", normal(F.col("_t")))
        .select(
            *keep,
            F.monotonically_increasing_id().alias("rid"),
            (_spaces(F.col("_n")) - 1).cast("bigint").alias("n_words"),
            F.array(*[F.struct(F.lit(label).alias("label"), at.alias("at")) for at, (_, label) in zip(labels, PHRASES)]).alias("_base"),
            F.when(F.col("_n").rlike(gate), runs).otherwise(F.expr("cast(array() as array<struct<block:int,stride:int,words:array<string>>>)")).alias("_runs"),
        )
    )
    scanned = checkpoint(scanned)
    blocks = scanned.select("rid", F.explode("_runs").alias("x")).select("rid", "x.block", "x.stride", "x.words")
    found = license_join(blocks, index).groupBy("rid").agg(
        F.array_sort(F.collect_list(F.struct("stride", "block", "label", "containment"))).alias("matches")
    )
    none = F.expr("cast(array() as array<struct<stride:int,block:int,label:string,containment:double>>)")
    places = F.flatten(F.transform("_base", lambda b: b["at"]))
    base_labels = F.array_sort(F.transform(F.filter("_base", lambda b: F.size(b["at"]) > 0), lambda b: b["label"]))
    joined = scanned.join(found, "rid", "left").withColumn("matches", F.coalesce("matches", none))
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0))
    return joined.select(
        *keep,
        "n_words",
        places.alias("places"),
        base_labels.alias("base_labels"),
        "matches",
        F.when(F.size(places) > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"))
    labels = F.array_union("base_labels", F.transform("matches", lambda m: m["label"]))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min("places").cast("bigint").alias("first_word"),
        F.array_max("places").cast("bigint").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        "score",
    )


def _sql() -> str:
    """The query in DuckDB SQL, with every run of words held against every template instead of the filtered join."""
    words = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    places = ", ".join(
        "list_transform(list_filter(range(len(w)), lambda i: "
        + " AND ".join(f"w[i + {k + 1}] = '{word}'" for k, word in enumerate(phrase.split()))
        + f"), lambda i: {{'at': i, 'label': '{label}'}})"
        for phrase, label in PHRASES
    )
    rows = []
    for label, statement in TEMPLATES:
        distinct = sorted(set(statement.split()))
        need = math.ceil(THRESHOLD * len(distinct) - 1e-9)
        rows.append(f"({stride_of(statement)}, '{label}', {distinct!r}, {need}, CAST({sorted(must(label, set(distinct)))!r} AS VARCHAR[]))")
    runs = " UNION ALL ".join(
        f"SELECT doc_id, {s} AS stride, unnest(list_transform(range(0, greatest(len(w) - {s}, 1), {s}), lambda i: list_distinct(w[i + 1:i + {2 * s}]))) AS words "
        "FROM worded" for s in STRIDES
    )
    return f"""
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
worded AS (SELECT doc_id, {words.format('low')} AS w FROM t),
placed AS (SELECT doc_id, len(w) AS n_words, list_concat({places}) AS found FROM worded),
template(stride, label, words, need, must) AS (VALUES {', '.join(rows)}),
run AS ({runs}),
held AS (
  SELECT doc_id, label, len(list_intersect(run.words, template.words)) / len(template.words) AS containment
  FROM run JOIN template USING (stride)
  WHERE len(list_intersect(run.words, template.words)) >= need AND list_has_all(run.words, must)),
matched AS (SELECT doc_id, list(DISTINCT label) AS labels, max(containment) AS best FROM held GROUP BY doc_id),
based AS (SELECT *, list_transform(found, lambda x: x.at) AS places, list_distinct(list_transform(found, lambda x: x.label)) AS base FROM placed)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base,
  CAST(list_min(places) AS BIGINT) AS first_word, CAST(list_max(places) AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(base, coalesce(labels, [])))), ','), '') AS labels,
  CAST(CASE WHEN len(places) > 0 THEN 1.0 ELSE coalesce(best, 0.0) END AS DOUBLE) AS score
FROM based LEFT JOIN matched USING (doc_id)
"""


OP6_SQL = _sql()
