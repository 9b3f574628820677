"""License scanning by an exact set-similarity join between text blocks and license templates.

Built from DataFrame functions alone. A template is the wording of a notice, as a set of words. A block is a line of a
text, or a window of words across its lines, since notices are wrapped: for a template whose wording has L words, windows are
twice the first power of 2 from L / ``containment`` on, and start at every such power, so that any run of L /
containment words lies within one of them. A block meets a template if it holds at least ``containment`` of the
template's words, and those that tell it from notices worded alike. The join that finds every such pair:

* frequency order: the templates' words are ranked by the number of lines that hold them, over all
  documents, rarest first (other words cannot contribute to an overlap and are dropped on reading);
* prefix filter: a pair with overlap o shares a word among the first |x| - o + 1 of both sides, so only these
  prefixes are joined, on the word, and a block without a word of any template's prefix is left out before;
* length filter: a block with fewer than o template words cannot meet the template;
* positional filter: a shared word at places i and j leaves an overlap of at most
  1 + min(|t| - 1 - i, |b| - 1 - j);
* candidates that pass are verified on the whole sets.

Windows are cut only in texts of several lines that hold enough of a template's words somewhere; the prefix filter (which any
order of words makes exact) says which texts are counted for that. They then go through the same join as lines.

The templates' side is a small table (a row per template and prefix word), broadcast; blocks are never
joined with blocks.

Base places are where a phrase's words stand consecutively, by word number within the text. They add their
labels to those that the join finds. The score is the best containment among the blocks that met a
template, 0 without any.

Edge cases: a null text has no words; a line without template words is no block; rows that repeat an id
are kept apart by a row number; an empty table gives an empty result; columns other than the id
and the text are ignored; a very long line is a block like any other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width, written

#: Words as the contract has them, on text with A-Z lower-cased.
LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same characters listed, not excluded: Java's matcher takes a tenth of the time for that.
_JAVA_WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"

# Phrases whose places are the base, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# The labels and wordings of public license notices, openings and whole ones; and, where others are worded alike, the words
# that tell a notice from them.
TEMPLATES: tuple[tuple[str, ...], ...] = (
    ("gpl", "this work is licensed under the gnu general public license version 3", "gnu"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu program"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lesser"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "affero"),
    ("apache", "licensed under the apache license version 2 0", "apache"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("mit", "released under the mit license", "mit"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "organization accompanying"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse"),
    ("cc-by", "licensed under cc by 4 0", "cc"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "commons"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "nc"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "noncommercial"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "sa"),
    ("cc0", "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved no part of this work may be reproduced without prior written permission"),
)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_JAVA_WORD), F.lit(0))


def _matchable(text: Column) -> Column:
    """Lower-cased for comparison with ASCII words. lower() also changes other letters, which no phrase or template
    has; the two that would become ASCII (Kelvin sign, dotted capital I) are put out of the way first. Word
    ends stay where they are, since letters beyond ASCII stay beyond it."""
    apart = F.replace(F.replace(text, F.lit("\u212a"), F.lit("\u00f8")), F.lit("\u0130"), F.lit("\u00f8"))
    return F.lower(apart)


def _literal(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _places(words: Column, phrase: str) -> Column:
    """Numbers of the words at which the phrase starts; null without words enough. words must be a plain column."""
    first, *rest = phrase.split(" ")

    def at(i: Column) -> Column:
        found = F.get(words, i) == first
        for k, word in enumerate(rest, 1):
            found = found & (F.get(words, i + k) == word)
        return found

    last = F.size(words) - len(rest) - 1
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), at))


def _all_held(words: list[str]) -> Column:
    """Whether each of the words is in some line of the text."""

    def held(word: str) -> Column:
        return F.exists("held", lambda line: F.array_contains(line, word))

    found = held(words[0])
    for word in words[1:]:
        found = found & held(word)
    return found


def template_table(templates: tuple[tuple[str, ...], ...], containment: float) -> list[dict]:
    """template, label, words (distinct), need (how many of them a block must hold), must (which in any case) and step (of its windows)."""
    table = []
    for number, (label, wording, *must) in enumerate(templates):
        words = list(dict.fromkeys(wording.split(" ")))
        run = math.ceil(len(wording.split(" ")) / containment - 1e-9)
        table.append({"template": number, "label": label, "words": words, "step": 1 << (run - 1).bit_length(), "need": math.ceil(containment * len(words) - 1e-9), "must": " ".join(must).split()})
    return table


def _prefix(words: list[str], need: int) -> list[str]:
    """Words of an ordered template of which every block that meets it holds one."""
    return words[: len(words) - need + 1]


def license_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: tuple[tuple[str, ...], ...] = TEMPLATES,
    phrases: dict[str, str] = PHRASES,
    containment: float = 0.8,
) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of docs."""
    spark = docs.sparkSession
    table = template_table(templates, containment)
    phrase_words = {w for p in phrases for w in p.split(" ")}
    vocabulary = sorted({w for t in table for w in t["words"]} | phrase_words)
    least = min(t["need"] for t in table)

    lower = _matchable(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    lines = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), lower.alias("lower"))
    lines = lines.withColumn("lines", F.transform(F.split("lower", "\n"), _words))
    known = lambda words: F.array_distinct(F.filter(words, lambda w: w.isin(vocabulary)))
    held = F.filter(F.transform("lines", known), lambda x: F.size(x) > 0)
    lines = lines.select(
        "row", "id", "lines",
        F.aggregate("lines", F.lit(0).cast("long"), lambda n, x: n + F.size(x)).alias("n_words"),
        held.alias("held"),
    )
    # words are numbered only in texts that hold all of some phrase's, and put in a column of their own first: a lambda
    # that held the expression would make the list anew for each place
    some = F.lit(False)
    for phrase in phrases:
        some = some | _all_held(phrase.split(" "))
    enough = F.lit(False)
    for t in table:
        enough = enough | (F.size(F.array_intersect("whole", _literal(t["words"]))) >= t["need"])
    # long words first is a guess at rarity; the frequencies are not known yet
    likely = sorted({w for t in table for w in _prefix(sorted(t["words"], key=lambda w: (-len(w), w)), t["need"])})
    lines = lines.withColumn("whole", F.array_distinct(F.flatten("held")))
    several = (F.size("held") > 1) & F.arrays_overlap("whole", _literal(likely)) & enough
    lines = lines.withColumn("wrapped", F.when(several, F.flatten("lines")))
    lines = lines.withColumn("words", F.when(some, F.flatten("lines"))).drop("lines")
    nothing = F.array().cast("array<int>")
    columns = []
    for phrase, label in phrases.items():
        columns.append(F.coalesce(_places(F.col("words"), phrase), nothing).alias(f"at_{label}"))
    read = written(lines.select("row", "id", "n_words", "held", "wrapped", *columns), "license-lines")

    # the global order: rarest first over all lines; a row per vocabulary word
    of_lines = read.select("row", F.posexplode("held").alias("block", "words"))
    counts = {r["word"]: r["n"] for r in of_lines.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    ranked = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(ranked)}
    prefix_rows, set_rows = [], []
    for t in table:
        t["words"].sort(key=rank.__getitem__)
        size = len(t["words"])
        prefix_rows += [(t["template"], t["step"], size, t["need"], i, w) for i, w in enumerate(_prefix(t["words"], t["need"]))]
        set_rows.append((t["template"], t["label"], t["words"], t["must"]))
    prefixes = spark.createDataFrame(prefix_rows, "template int, t_step int, size int, need int, i int, word string")
    sets = spark.createDataFrame(set_rows, "template int, label string, t_words array<string>, must array<string>")

    # windows by their step; lines are blocks of step 0; few rows with much work each, so their number of tasks is given
    width = shuffle_width(spark)
    texts = read.filter("wrapped IS NOT NULL").select("row", "wrapped").repartition(width, "row")
    steps = F.array(*[F.lit(x) for x in sorted({t["step"] for t in table})])
    cut = texts.select("row", "wrapped", F.explode(steps).alias("step"))
    cut = cut.withColumn("start", F.explode(F.sequence(F.lit(0), F.greatest(F.size("wrapped") - 1, F.lit(0)), F.col("step"))))
    windows = cut.select("row", "step", F.col("start").alias("block"), known(F.slice("wrapped", F.col("start") + 1, 2 * F.col("step"))).alias("words"))
    rare = _literal(sorted({r[5] for r in prefix_rows}))
    possible = (F.size("words") >= least) & F.arrays_overlap("words", rare)
    blocks = of_lines.filter(possible).select("row", F.lit(0).alias("step"), "block", "words").repartition(width, "row", "block").unionByName(windows.filter(possible))

    ordered = F.filter(_literal(ranked), lambda w: F.array_contains("words", w))
    kept = blocks.withColumn("words", ordered)
    probes = kept.select("row", "step", "block", "words", F.posexplode(F.slice("words", F.lit(1), F.size("words") - least + 1)).alias("j", "word"))
    pairs = probes.join(F.broadcast(prefixes), "word").filter("step = 0 OR step = t_step")
    room = 1 + F.least(F.col("size") - 1 - F.col("i"), F.size("words") - 1 - F.col("j"))
    pairs = pairs.filter((F.size("words") >= F.col("need")) & (room >= F.col("need")))
    met = (
        pairs.join(F.broadcast(sets), "template")
        .withColumn("overlap", F.size(F.array_intersect("words", "t_words")))
        .filter((F.col("overlap") >= F.col("need")) & (F.size(F.array_except("must", "words")) == 0))
        .groupBy("row").agg(F.collect_set("label").alias("found"), F.max(F.col("overlap") / F.col("size")).alias("best"))
    )
    places = F.concat(*[F.col(f"at_{label}") for label in phrases.values()])
    base = F.array_sort(F.array_compact(F.array(*[F.when(F.size(f"at_{label}") > 0, F.lit(label)) for label in phrases.values()])))
    everything = read.withColumn("places", places).withColumn("base", base).drop("held", "wrapped").join(met, "row", "left")
    return everything.select(
        F.col("id").alias(id_col),
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.coalesce("best", F.lit(0.0)).alias("score"),
    )


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)


def oracle(templates: tuple[tuple[str, ...], ...] = TEMPLATES, phrases: dict[str, str] = PHRASES, containment: float = 0.8) -> str:
    """Rows by brute force: each line, and each window of a template's step, against each template, each word against each
    phrase."""
    t_rows = [(t["template"], t["label"], " ".join(t["words"]), t["need"], t["step"], " ".join(t["must"])) for t in template_table(templates, containment)]
    return f"""
WITH t AS (
  SELECT template, label, string_split(words, ' ') AS tw, need, step, CASE WHEN must = '' THEN []::VARCHAR[] ELSE string_split(must, ' ') END AS must FROM (VALUES {_values(t_rows)}) v(template, label, words, need, step, must)
), p AS (
  SELECT string_split(phrase, ' ') AS pw, label FROM (VALUES {_values(list(phrases.items()))}) v(phrase, label)
), d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower FROM documents
), w AS (
  SELECT doc_id, lower, regexp_extract_all(lower, '{LICENSE_WORD}') AS words FROM d
), n AS (
  SELECT doc_id, words, unnest(range(len(words))) AS i FROM w
), b AS (
  SELECT n.doc_id, n.i, p.label FROM n JOIN p ON n.words[n.i + 1] = p.pw[1] AND list_slice(n.words, n.i + 1, n.i + len(p.pw)) = p.pw
), base AS (
  SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM b GROUP BY doc_id
), l AS (
  SELECT doc_id, list_distinct(regexp_extract_all(line, '{LICENSE_WORD}')) AS lw FROM (SELECT doc_id, unnest(string_split(lower, chr(10))) AS line FROM d)
), s AS (
  SELECT DISTINCT step FROM t
), cut AS (
  SELECT w.doc_id, w.words, s.step, unnest(range(0, len(w.words), s.step)) AS start FROM w, s
), x AS (
  SELECT doc_id, step, list_distinct(list_slice(words, start + 1, start + 2 * step)) AS lw FROM cut
), m AS (
  SELECT l.doc_id, t.label, len(list_intersect(l.lw, t.tw)) AS overlap, len(t.tw) AS size FROM l JOIN t ON len(list_intersect(l.lw, t.tw)) >= t.need AND list_has_all(l.lw, t.must)
  UNION ALL
  SELECT x.doc_id, t.label, len(list_intersect(x.lw, t.tw)) AS overlap, len(t.tw) AS size FROM x JOIN t ON x.step = t.step AND len(list_intersect(x.lw, t.tw)) >= t.need AND list_has_all(x.lw, t.must)
), best AS (
  SELECT doc_id, max(overlap / size) AS score FROM m GROUP BY doc_id
), bl AS (
  SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT doc_id, label FROM b) GROUP BY doc_id
), al AS (
  SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels
  FROM (SELECT doc_id, label FROM b UNION SELECT doc_id, label FROM m) GROUP BY doc_id
)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(base.n_base, 0)::BIGINT AS n_base, base.first_word::BIGINT AS first_word,
       base.last_word::BIGINT AS last_word, coalesce(bl.labels, '') AS base_labels, coalesce(al.labels, '') AS labels,
       coalesce(best.score, 0)::DOUBLE AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN bl USING (doc_id) LEFT JOIN al USING (doc_id) LEFT JOIN best USING (doc_id)
"""
