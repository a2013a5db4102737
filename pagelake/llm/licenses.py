"""Licence scan as an exact set-similarity join between blocks of text and licence templates.

A template is contained in a block of words to the share of its distinct words that the block has; the join
finds every pair of block and template that reaches the template's share. Words are put into one global
order, rarest in the corpus first. In that order:

* prefix filter: a pair that qualifies shares a word among the first size - need + 1 words of the template and
  the same of the block, so only those words of a block meet the index of the templates' first words;
* length filter: the block has at least `need` words of the templates' vocabulary;
* positional filter: from the first shared word on, both have at least `need` words left.

What passes is counted in full. Blocks are windows of twice the longest template's words of their class,
half of it apart, so a template that stands in a text in one piece lies wholly in some block.

Everything on the executors is DataFrame functions. The index and the vocabulary are as large as the
templates, whatever the corpus. Texts never move: a document leaves its small row of counts and the
blocks that hold a first word of some template.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .divergence import LOWER, UPPER, lower_ascii
from .util import free, scratch

#: ASCII letters and digits and whatever is beyond ASCII, after lower-casing A-Z.
WORD_RX = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A licence's wording. `least`: the share of its distinct words that a block must hold."""

    label: str
    text: str
    least: float = 0.8

    def words(self) -> list[str]:
        return re.findall(WORD_RX, self.text.translate(str.maketrans(UPPER, LOWER)))

    def need(self) -> int:
        return math.ceil(round(self.least * len(set(self.words())), 6))

    def width(self) -> int:
        """Words of a block: 32, or twice the power of two that the template's words fit into."""
        return max(32, 2 << (len(self.words()) - 1).bit_length())


# The base phrases with their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# The notices by which the licences ask to be stated, and short statements in use; the short ones must be there in full.
TEMPLATES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    Template("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    Template("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    Template("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    Template("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    Template("creative-commons", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    Template("mit", "Released under the MIT License", 1.0),
    Template("mit", "Licensed under the MIT License", 1.0),
    Template("apache", "Licensed under the Apache License, Version 2.0", 1.0),
    Template("gpl", "Licensed under the GNU General Public License, version 3", 1.0),
    Template("gpl", "Licensed under the GNU General Public License, version 2", 1.0),
    Template("lgpl", "GNU Lesser General Public License", 1.0),
    Template("agpl", "GNU Affero General Public License", 1.0),
    Template("mpl", "Mozilla Public License, version 2.0", 1.0),
    Template("bsd", "Licensed under the BSD License", 1.0),
    Template("creative-commons", "Licensed under CC BY 4.0", 1.0),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", 1.0),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0", 1.0),
    Template("cc-by-nd", "Licensed under CC BY-ND 4.0", 1.0),
)


def words_of(text: Column) -> Column:
    """The words of a text; none for a null one."""
    return F.coalesce(F.filter(F.split(lower_ascii(text), _NOT_WORD), lambda w: w != ""), F.array().cast("array<string>"))


def word_order(words: DataFrame, vocabulary: list[str]) -> list[str]:
    """vocabulary, the word in the fewest documents first, ties by the word; words(words) has a row a document."""
    hits = words.select(F.explode(F.array_intersect(_strings(vocabulary), "words")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    found = {r.word: r.n for r in hits.collect()}  # a row a word of the vocabulary at most
    return sorted(vocabulary, key=lambda w: (found.get(w, 0), w))


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _prefix(template: Template, order: dict[str, int]) -> list[str]:
    """The template's words in order, as many as a qualifying block must share one of."""
    own = sorted(set(template.words()), key=order.__getitem__)
    return own[: len(own) - template.need() + 1]


def _base_places(words: Column, phrases: tuple[tuple[str, str], ...]) -> list[Column]:
    """For each phrase the places where it starts."""
    split = [p.split(" ") for p, _ in phrases]
    last = sorted({p[-1] for p in split})
    spots = F.filter(F.transform(words, lambda w, i: F.when(w.isin(last), i)), lambda i: i.isNotNull())
    spots = F.when(F.arrays_overlap(words, _strings(last)), spots).otherwise(F.array().cast("array<int>"))

    def starts(p: list[str]) -> Column:
        def there(i: Column) -> Column:
            out = F.get(words, i) == p[-1]
            for back, w in enumerate(reversed(p[:-1]), 1):
                out &= (i >= back) & F.coalesce(F.get(words, i - back) == w, F.lit(False))
            return out

        return F.transform(F.filter(F.col("spots"), there), lambda i: i - (len(p) - 1))

    return [spots, *map(starts, split)]


def _blocks(width: int, order: list[str], first: list[str]) -> Column:
    """The blocks of a width that hold a word of `first`: their words of the vocabulary, in the global order."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(width // 2))
    sets = F.transform(starts, lambda s: F.struct(F.lit(width).alias("width"), F.array_intersect(_strings(order), F.slice("words", s + 1, width)).alias("own")))
    having = F.filter(sets, lambda b: F.arrays_overlap(b["own"], _strings(first)))
    return F.when(F.arrays_overlap("words", _strings(first)), having).otherwise(F.array()).cast("array<struct<width:int,own:array<string>>>")


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = BASE) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    n_base counts the places of the base phrases, first_word and last_word are the least and the largest
    start among them (null without any). labels are the base labels and those of the templates contained
    in some block. score is the largest share of a template that qualifies, 1 where a base phrase stands (it
    is wholly there), 0 without any. Null and empty texts have no words and no labels. One row for each row of
    docs, each by its own text, whether or not they share a doc_id.
    """
    spark = docs.sparkSession
    number, key = "row_number", "doc_id"
    rows = docs.select(docs[key].alias(key), words_of(docs["text"]).alias("words"))
    vocabulary = sorted({w for t in templates for w in t.words()})
    order = word_order(rows, vocabulary) if templates else []
    at = {w: i for i, w in enumerate(order)}
    spots, *places = _base_places(F.col("words"), phrases)
    rows = rows.withColumn("spots", spots).withColumns({f"place{i}": p for i, p in enumerate(places)})
    blocks = [_blocks(width, order, sorted({w for t in templates if t.width() == width for w in _prefix(t, at)})) for width in sorted({t.width() for t in templates})]
    everywhere = F.concat(*(F.col(f"place{i}") for i in range(len(places)))) if places else F.array().cast("array<int>")
    left = scratch(
        rows.select(
            F.monotonically_increasing_id().alias(number), key, F.size("words").cast("long").alias("n_words"), everywhere.alias("places"),
            F.filter(F.array(*(F.when(F.size(f"place{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(phrases))).cast("array<string>"), lambda x: x.isNotNull()).alias("base"),
            (F.concat(*blocks) if blocks else F.array().cast("array<struct<width:int,own:array<string>>>")).alias("blocks"),
        ),
        "licenses",
    )
    index = [(t.width(), w, i, t.label, len(set(t.words())), t.need(), sorted(set(t.words()))) for t in templates for i, w in enumerate(_prefix(t, at))]
    least = {w: min(t.need() for t in templates if t.width() == w) for w in {t.width() for t in templates}}
    index = [(*x, least[x[0]]) for x in index]
    found = _contained(left.select(number, F.inline("blocks")), spark.createDataFrame(index, "width int, word string, place int, label string, size int, need int, words array<string>, least int"), least, number)
    zero = F.lit(0.0)
    hit, best = free(left, "found", "best")
    out = left.drop("blocks").join(found.select(F.col(number), F.col("labels").alias(hit), F.col("score").alias(best)), number, "left")
    has = F.size("places") > 0
    return out.select(
        key, "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", F.coalesce(hit, F.array().cast("array<string>"))))), ",").alias("labels"),
        F.when(has, 1.0).otherwise(F.coalesce(best, zero)).alias("score"),
    )


def _contained(blocks: DataFrame, index: DataFrame, least: dict[int, int], number: str) -> DataFrame:
    """blocks(number, width, own) joined with the index -> (number, labels, score) of the rows with a contained template.

    A block's words are in the global order; its first size - least + 1 words meet the index.
    """
    needed = F.lit(0)
    for width, n in least.items():
        needed = F.when(F.col("width") == width, n).otherwise(needed)
    sized = blocks.withColumn("own_size", F.size("own")).where(F.col("own_size") >= needed)
    firsts = sized.select(number, F.col("width").alias("of"), "own", "own_size", F.posexplode(F.slice("own", F.lit(1), F.col("own_size") - needed + 1)).alias("own_place", "own_word"))
    # the index is as large as the templates
    met = firsts.join(F.broadcast(index), (F.col("of") == F.col("width")) & (F.col("own_word") == F.col("word")))
    met = met.where((F.col("own_size") >= F.col("need")) & (F.least(F.col("size") - F.col("place"), F.col("own_size") - F.col("own_place")) >= F.col("need")))
    shared = met.select(number, "label", "size", "need", F.size(F.array_intersect("own", "words")).alias("shared")).where("shared >= need")
    return shared.groupBy(number).agg(F.collect_set("label").alias("labels"), F.max(F.col("shared").cast("double") / F.col("size").cast("double")).alias("score"))


def scan_sql(templates: tuple[Template, ...] = TEMPLATES, phrases: tuple[tuple[str, str], ...] = BASE, docs: str = "documents") -> str:
    """The same result for DuckDB: every template against every block, every phrase at every place."""
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    rows = ", ".join(f"({t.width()}, {quoted(t.label)}, {len(set(t.words()))}, {t.need()}, [{', '.join(map(quoted, sorted(set(t.words()))))}])" for t in templates)
    widths = ", ".join(f"({w})" for w in sorted({t.width() for t in templates}))
    starts = [f"list_filter(range(1, len(words) + 1), lambda i: words[i:i + {len(p.split()) - 1}] = [{', '.join(map(quoted, p.split()))}])" for p, _ in phrases]
    return f"""
    WITH d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD_RX}') AS words FROM {docs}),
    p AS (SELECT id, doc_id, words, {', '.join(f'{s} AS p{i}' for i, s in enumerate(starts))} FROM d),
    t(width, label, size, need, own) AS (VALUES {rows}),
    w(width) AS (VALUES {widths}),
    s AS (SELECT id, width, words, unnest(range(0, greatest(len(words), 1), width // 2)) AS lo FROM d, w),
    b AS (SELECT id, width, list_distinct(words[lo + 1:lo + width]) AS block FROM s),
    h AS (SELECT id, label, size, need, len(list_intersect(block, own)) AS shared FROM b JOIN t USING (width)),
    f AS (SELECT id, list(DISTINCT label) AS labels, max(CAST(shared AS DOUBLE) / CAST(size AS DOUBLE)) AS score FROM h WHERE shared >= need GROUP BY id),
    a AS (SELECT p.id, doc_id, len(words) AS n_words, {' || '.join(f'p{i}' for i in range(len(phrases)))} AS places,
        list_filter([{', '.join(f"CASE WHEN len(p{i}) > 0 THEN {quoted(label)} END" for i, (_, label) in enumerate(phrases))}], lambda x: x IS NOT NULL) AS base, labels, score FROM p LEFT JOIN f USING (id))
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, CAST(list_min(places) - 1 AS BIGINT) AS first_word, CAST(list_max(places) - 1 AS BIGINT) AS last_word,
        coalesce(array_to_string(list_sort(list_distinct(base)), ','), '') AS base_labels, coalesce(array_to_string(list_sort(list_distinct(base || coalesce(labels, []))), ','), '') AS labels,
        CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0.0::DOUBLE) END AS score FROM a
    """
