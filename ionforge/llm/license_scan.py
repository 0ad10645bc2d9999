"""Operator 3 [native], licence scan by a positional rare-token index.

1. Every text is split once.  Its occurrences of licence words, as numbers made
   of position and word, are written; all that follows reads these numbers only.
2. Document frequencies of the licence words are counted over all documents.
3. The index holds, for each key phrase, postings (phrase, offset) of its
   ``RARE`` highest-IDF words.  Each occurrence of such a word gives, by its
   posting's offset, the place where the phrase would begin; the places by the
   first, second and third of the words are intersected, which leaves places
   where all of them stand in their relative positions.
4. At these places the whole phrase is verified.  Every word of a phrase stands
   at its places, so none is lost.  A template is found where its first
   mandatory phrase stands, if the others stand behind, within twice the
   template's length: names and years may be filled in between.

``score`` is the share of a template's words that stand in their positions
relative to the first phrase, the greatest over all that is found; a base phrase
alone mentions a licence but is not its text, and scores ``BASE_SCORE``.

Nothing is shuffled but the counts, so rows of any source and copies of any
number cost the same.

Defined results: null or empty text has no words, no labels and score 0;
repeated rows are scanned one by one; null ids are carried; an empty table
gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a phrase that the index holds.
RARE = 3
BASE_SCORE = 0.5

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Licence texts and notices by label, and the phrases that must stand in them, in order.
TEMPLATES = [
    (
        "apache-2.0",
        """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
        you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing
        software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied
        see the license for the specific language governing permissions and limitations under the license""",
        ["apache license version 2 0"],
    ),
    (
        "bsd",
        """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
        redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
        redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation
        and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is
        and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed""",
        ["redistribution and use in source and binary forms"],
    ),
    (
        "boost-1.0",
        """permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
        the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software""",
        ["permission is hereby granted free of charge to any person or organization", "prepare derivative works of the software"],
    ),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-nc-nd-4.0", "licensed under cc by nc nd 4 0", ["cc by nc nd 4 0"]),
    ("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0", ["cc by nc sa 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0 international"]),
    ("cc0-1.0", "released under cc0 1 0 universal public domain dedication", ["cc0 1 0"]),
    (
        "gpl-2.0",
        """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
        as published by the free software foundation either version 2 of the license or at your option any later version""",
        ["gnu general public license as published by the free software foundation", "version 2 of the license"],
    ),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    (
        "gpl-3.0",
        """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
        as published by the free software foundation either version 3 of the license or at your option any later version""",
        ["gnu general public license as published by the free software foundation", "version 3 of the license"],
    ),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    (
        "isc",
        """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
        provided that the above copyright notice and this permission notice appear in all copies the software is provided as is
        and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness""",
        ["permission to use copy modify", "with or without fee is hereby granted"],
    ),
    ("lgpl-3.0", "this work is licensed under the gnu lesser general public license version 3", ["gnu lesser general public license version 3"]),
    (
        "mit",
        """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software
        to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell
        copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions
        the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
        the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
        fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability
        whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software""",
        ["permission is hereby granted free of charge to any person obtaining"],
    ),
    (
        "mpl-2.0",
        """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file
        you can obtain one at http mozilla org mpl 2 0""",
        ["mozilla public license"],
    ),
    (
        "unlicense",
        """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute
        this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means""",
        ["free and unencumbered software released into the public domain"],
    ),
    (
        "zlib",
        """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
        permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely""",
        ["in no event will the authors be held liable", "alter it and redistribute it freely"],
    ),
]


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    #: (offset within the template, words) of each mandatory phrase
    phrases: tuple[tuple[int, tuple[str, ...]], ...]
    base: bool


def template(label: str, text: str, phrases: list[str], base: bool = False) -> Template:
    words = tuple(text.split())
    found = []
    for p in phrases:
        w = tuple(p.split())
        found.append((next(i for i in range(len(words)) if words[i : i + len(w)] == w), w))
    return Template(label, words, tuple(found), base)


def all_templates() -> list[Template]:
    return [template(label, p, [p], True) for p, label in BASE.items()] + [template(*t) for t in TEMPLATES]


def words_of(text: Column) -> Column:
    """The words of a text, by cutting at what lies between them; that is several times faster than extracting."""
    return F.array_remove(F.split(ascii_lower(text), BETWEEN), "")


class Slots:
    """A number for each licence word, found by one look at a table: the word's hash is its place there."""

    def __init__(self, spark: SparkSession, vocabulary: list[str]):
        hashes = spark.range(1).select(F.array(*(F.xxhash64(F.lit(w)) for w in vocabulary)).alias("h")).first()["h"] if vocabulary else []
        self.size = 1 << max(8, (len(vocabulary) ** 2 // 4).bit_length())
        while True:
            for self.shift in range(0, 40):
                at = [((h % 2**64) >> self.shift) % self.size for h in hashes]
                if len(set(at)) == len(at):
                    self.of = dict(zip(vocabulary, at, strict=True))
                    return
            self.size *= 2

    def numbers(self, words: Column) -> Column:
        """The number of each of ``words``, or -1 for one that no licence has."""
        by_slot = {s: w for w, s in self.of.items()}
        table = F.split(F.lit(" ".join(by_slot.get(s, "-") for s in range(self.size))), " ")
        slot = lambda w: F.pmod(F.shiftrightunsigned(F.xxhash64(w), self.shift), F.lit(self.size))
        # the slot is looked up in the table, and kept where it holds this very word
        return F.transform(words, lambda w: F.when(F.get(table, slot(w).cast("int")) == w, slot(w).cast("int")).otherwise(-1))

    def codes(self, numbers: Column) -> Column:
        """position * size + number of each licence word, in order."""
        return F.filter(F.transform(numbers, lambda s, i: F.when(s >= 0, i.cast("long") * self.size + s)), lambda c: c.isNotNull())


def _longs(values) -> str:
    return f"array({', '.join(f'{v}L' for v in values)})" if values else "cast(array() as array<bigint>)"


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[Template] | None = None) -> DataFrame:
    """Per row: id, n_words, hits (label, base, place, coverage) and the digest columns."""
    templates = all_templates() if templates is None else templates
    slots = Slots(df.sparkSession, sorted({w for t in templates for w in t.words}))
    size = slots.size
    words = df.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words"))
    rows = written(words.select("id", F.size("words").cast("long").alias("n_words"), slots.numbers(F.col("words")).alias("at")), "licence-words")
    # in how many documents each word stands; at most one row for each licence word reaches the driver
    counted = rows.select(F.explode(F.array_distinct("at")).alias("w")).filter("w >= 0").groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    frequency = {r["w"]: r["n"] for r in counted.collect()}

    # phrases: (template, number within it, words' slots, offset within the template)
    phrases = [(t, k, [slots.of[w] for w in p], o) for t, x in enumerate(templates) for k, (o, p) in enumerate(x.phrases)]
    rare = [sorted(range(len(p)), key=lambda j, p=p: (frequency.get(p[j], 0), p[j], j))[:RARE] for _, _, p, _ in phrases]
    n = len(phrases)

    def places(r: int) -> str:
        """SQL: place * n + phrase, by the occurrences of each phrase's r-th rarest word."""
        postings: dict[int, list[int]] = {}
        for k, (_, _, p, _) in enumerate(phrases):
            j = rare[k][min(r, len(rare[k]) - 1)]
            postings.setdefault(p[j], []).append(k - j * n)
        known = sorted(postings)
        lists = f"array({', '.join(_longs(postings[w]) for w in known)})"
        listed = _longs(known)
        hits = f"filter(codes, c -> array_contains({listed}, c % {size}))"
        return f"filter(flatten(transform({hits}, c -> transform({lists}[array_position({listed}, c % {size}) - 1], o -> (c div {size}) * {n} + o))), x -> x >= 0)"

    # of most texts no rarest word stands anywhere: each further step is behind the one before
    rows = rows.withColumn("codes", slots.codes(F.col("at"))).withColumn("found", F.expr(places(0)))
    given = lambda x: F.when(F.size("found") > 0, F.expr(x))
    for r in range(1, min(RARE, max((len(x) for x in rare), default=1))):
        rows = rows.withColumn("found", F.coalesce(given(f"array_intersect(found, {places(r)})"), F.expr("cast(array() as array<bigint>)")))
    listed = f"array({', '.join(_longs(p) for _, _, p, _ in phrases)})"
    # what stands at a place is looked up there, so that the work grows with the places and not with places times words
    stands = f"size(filter({listed}[x % {n}], (w, j) -> not coalesce(get(at, cast(x div {n} as int) + j) = w, false))) = 0"
    rows = rows.withColumn("found", F.coalesce(given(f"filter(array_distinct(found), x -> {stands})"), F.expr("cast(array() as array<bigint>)")))

    # a template's first phrase gives the place; each further phrase stands behind, not farther than twice the template's length
    more: dict[int, list[int]] = {}
    for k, (t, number, _, _) in enumerate(phrases):
        if number:
            more.setdefault(t, []).append(k)
    first = [k for k, (_, number, _, _) in enumerate(phrases) if not number]
    of = f"array({', '.join(str(t) for t, _, _, _ in phrases)})"
    here = lambda j: " and ".join(f"coalesce(get(at, q + {i}) = {w}, false)" for i, w in enumerate(phrases[j][2]))
    behind = " ".join(
        f"when x % {n} = {k} then " + " and ".join(f"exists(sequence(cast(x div {n} as int), cast(x div {n} as int) + {2 * len(templates[phrases[k][0]].words)}), q -> {here(j)})" for j in more[phrases[k][0]])
        for k in first
        if phrases[k][0] in more
    )
    rows = rows.withColumn("found", F.coalesce(given(f"filter(found, x -> array_contains({_longs(first)}, x % {n}) and " + (f"case {behind} else true end)" if behind else "true)")), F.col("found")))
    texts = f"array({', '.join(_longs([slots.of[w] for w in t.words]) for t in templates)})"
    offsets = f"array({', '.join(str(o) for _, _, _, o in phrases)})"
    t_of = f"{of}[x % {n}]"
    aligned = f"size(filter({texts}[{t_of}], (w, j) -> coalesce(get(at, cast(x div {n} as int) - {offsets}[x % {n}] + j) = w, false))) / cast(size({texts}[{t_of}]) as double)"
    base = sum(t.base for t in templates)
    labels = ", ".join(f"'{t.label}'" for t in templates)
    hit = f"named_struct('label', array({labels})[{t_of}], 'base', {t_of} < {base}, 'place', x div {n}, 'coverage', if({t_of} < {base}, {BASE_SCORE}D, {aligned}))"
    none = "cast(array() as array<struct<label:string,base:boolean,place:bigint,coverage:double>>)"
    rows = rows.select("id", "n_words", F.coalesce(given(f"array_sort(transform(found, x -> {hit}))"), F.expr(none)).alias("hits"))
    ours = "filter(hits, h -> h.base)"
    return rows.select(
        F.col("id").alias(id_col),
        "n_words",
        F.expr(f"cast(size({ours}) as bigint)").alias("n_base"),
        F.expr(f"array_min(transform({ours}, h -> h.place))").alias("first_word"),
        F.expr(f"array_max(transform({ours}, h -> h.place))").alias("last_word"),
        F.expr(f"array_join(array_sort(array_distinct(transform({ours}, h -> h.label))), ',')").alias("base_labels"),
        F.expr("array_join(array_sort(array_distinct(transform(hits, h -> h.label))), ',')").alias("labels"),
        F.expr("coalesce(array_max(transform(hits, h -> h.coverage)), 0D)").alias("score"),
        "hits",
    )
