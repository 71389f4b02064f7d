"""License scans: an exact set-similarity join between text blocks and license templates, and fixed phrases.

A block is a line or the whole text, cut into windows that overlap by half. Templates come in two classes, short wordings
and long notices; each class has windows of its own length in BLOCKS, so that a notice of up to half of that stands whole
in a window wherever its lines are broken. A block meets a template if it holds PERCENT of the template's distinct words.
Template words are put in order of their document frequency over the whole corpus, rarest first; of n words with `need`
to be shared, one of the first n - need + 1 must be in a matching block (prefix filter), a block needs `need` template
words (length filter), and the places of the first common word in both orders bound what can still be shared (positional
filter). Survivors are verified on whole sets, so every block at the threshold is found.

DataFrame functions only. The templates are fixed and few, so their words, frequencies and index are small constants.

Defined cases: a null or word-free text has no places, no labels and score 0. Rows that repeat or lack a doc_id are
scanned each. Extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words in a window: for templates of up to half of the first, and for longer ones.
BLOCKS, PERCENT = (40, 160), 90
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Phrases that give base labels, and wordings of common licenses.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights"),
    ("gpl", "this work is licensed under the gnu general public license version"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use reproduce display distribute execute and transmit the software"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
]


def lower_ascii(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, GAP), "")


def template_rows() -> list[tuple[int, str, list[str], int, int]]:
    """(number, label, distinct words, words to share, words in a window) of each template."""
    out = []
    for k, (label, text) in enumerate(TEMPLATES):
        w = sorted(set(text.split()))
        out.append((k, label, w, -(-len(w) * PERCENT // 100), next(b for b in BLOCKS if len(text.split()) <= b // 2)))
    return out


def phrase_columns(docs: DataFrame) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word and base_labels from `norm`, the words between single blanks."""
    places, firsts, lasts, labels = [], [], [], []
    blanks = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    for phrase, label in PHRASES.items():
        inside = F.contains(F.col("norm"), F.lit(f" {phrase} "))
        places.append(F.when(inside, F.regexp_count("norm", F.lit(f" {phrase}(?= )"))).otherwise(0))
        firsts.append(F.when(inside, blanks(F.substring_index("norm", f" {phrase} ", 1))))
        lasts.append(F.when(inside, F.col("n_words") - len(phrase.split()) - blanks(F.substring_index("norm", f" {phrase} ", -1))))
        labels.append(F.when(inside, F.lit(label)))
    return docs.select(
        "*", sum(places[1:], places[0]).cast("long").alias("n_base"), F.least(*firsts).cast("long").alias("first_word"),
        F.greatest(*lasts).cast("long").alias("last_word"), F.array_sort(F.array_compact(F.array(*labels))).alias("base"),
    )


def template_matches(docs: DataFrame, frequency: dict[str, int], block: int) -> DataFrame:
    """(doc_id, digest, label, containment) for each window of `block` words in docs(doc_id, digest, low) that meets a template."""
    spark, rows = docs.sparkSession, [r for r in template_rows() if r[4] == block]
    order = {w: k for k, w in enumerate(sorted({w for r in rows for w in r[2]}, key=lambda w: (frequency.get(w, 0), w)))}
    ranked = [(k, label, sorted(order[w] for w in ws), need) for k, label, ws, need, _ in rows]
    index = [(ranks[i], k, label, ranks, need, len(ranks) - i) for k, label, ranks, need in ranked for i in range(len(ranks) - need + 1)]
    prefixes = F.broadcast(spark.createDataFrame(index, "rank int, template int, label string, ranks array<int>, need int, left int"))
    by_rank = list(order)
    first = F.array(*(F.lit(w) for w in sorted({by_rank[r[0]] for r in index})))
    vocabulary = F.array(*(F.lit(w) for w in by_rank))
    ranks = F.map_from_arrays(vocabulary, F.array(*(F.lit(order[w]) for w in by_rank)))
    least = min(r[3] for r in ranked)
    some = docs.where(F.arrays_overlap(F.col("w"), first) & (F.size(F.array_intersect("w", vocabulary)) >= least))
    lines = F.split("low", "\n")
    apart = F.when(F.size(lines) > 1, F.transform(lines, words)).otherwise(F.array().cast("array<array<string>>"))
    runs = some.select("doc_id", "digest", F.explode(F.concat(F.array("w"), apart)).alias("w")).where(F.arrays_overlap("w", first))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - block // 2), F.lit(block // 2))
    windows = F.transform(starts, lambda at: F.slice("w", at, block))
    blocks = runs.select("doc_id", "digest", F.explode(windows).alias("w")).where(F.arrays_overlap("w", first))
    held = blocks.select("doc_id", "digest", F.array_sort(F.transform(F.array_intersect("w", vocabulary), lambda x: F.element_at(ranks, x))).alias("have"))
    held = held.where(F.size("have") >= least)
    tokens = held.select("doc_id", "digest", "have", F.posexplode("have").alias("place", "rank"))
    close = tokens.join(prefixes, "rank").where((F.size("have") >= F.col("need")) & (F.least(F.col("left"), F.size("have") - F.col("place")) >= F.col("need")))
    shared = F.size(F.array_intersect("have", "ranks"))
    return close.where(shared >= F.col("need")).select("doc_id", "digest", "label", (shared / F.size("ranks")).alias("containment"))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of docs(doc_id, text)."""
    low = docs.select("doc_id", F.xxhash64("text", F.length("text")).alias("digest"), lower_ascii(F.col("text")).alias("low"))
    cut = low.select("*", words(F.col("low")).alias("w"))
    vocabulary = F.array(*(F.lit(w) for w in sorted({w for r in template_rows() for w in r[2]})))
    counts = cut.select(F.explode(F.array_intersect("w", vocabulary)).alias("word")).groupBy("word").count()
    frequency = {r["word"]: r["count"] for r in counts.limit(10_000).collect()}  # at most one row for each template word
    met = [template_matches(cut, frequency, block) for block in BLOCKS]
    found = met[0].unionByName(met[1]).groupBy("doc_id", "digest").agg(F.collect_set("label").alias("own"), F.max("containment").alias("best"))
    based = phrase_columns(cut.select("doc_id", "digest", F.size("w").cast("long").alias("n_words"), F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("norm"))).drop("norm")
    a, b = based.alias("a"), found.alias("b")
    both = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & F.col("a.digest").eqNullSafe(F.col("b.digest")), "left")
    every = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("own", F.array().cast("array<string>")))))
    return both.select(
        "a.doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
