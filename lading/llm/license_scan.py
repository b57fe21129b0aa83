"""Licence scan by a positional index of licence words. Built-in functions only."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lading.llm.common import CASED_GAP, LOWER, UPPER, WORD_GAP, materialise, q

# Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Labels and the mandatory key phrases of their templates, in order.
TEMPLATES = {
    "apache-2.0": ("apache license", "version 2 0"),
    "bsd": ("bsd license",),
    "cc-by-nc": ("cc by nc",),
    "cc-by-sa": ("cc by sa",),
    "cc0": ("cc0",),
    "gpl-2.0": ("general public license", "version 2"),
    "gpl-3.0": ("general public license", "version 3"),
    "lgpl": ("lesser general public license",),
    "mit": ("mit license",),
    "mpl-2.0": ("mozilla public license",),
}
# Licence bodies (the passage that every copy shares) and the key phrases that
# must stand in them, of words that other texts seldom have: postings of frequent words are many.
BODIES = {
    "apache-2.0": (
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required
        by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
        ("apache license", "governing permissions"),
    ),
    "bsd": (
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution.""",
        ("binary forms", "following disclaimer"),
    ),
    "gpl-3.0": (
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details.""",
        ("general public license", "version 3"),
    ),
    "isc": (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
        OF MERCHANTABILITY AND FITNESS.""",
        ("permission notice appear", "author disclaims"),
    ),
    "mit": (
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS
        PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
        ("documentation files", "substantial portions"),
    ),
    "mpl-2.0": (
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
        ("mozilla public license", "source code form"),
    ),
    "unlicense": (
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means.""",
        ("unencumbered software", "public domain"),
    ),
    "zlib": (
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
        any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original
        software.""",
        ("commercial applications", "misrepresented"),
    ),
}
#: Words that may lie between the starts of a template's key phrases.
REACH = 40
#: Body words that are indexed have so many letters at least.
LETTERS = 6
#: Licence words of highest IDF by which a file is looked up among the bodies.
FILE_WORDS = 12
#: Places of a body that must agree on where it would begin.
VOTES = 4
#: Words by which a key phrase may lie outside an aligned body.
SLACK = 8


def body_words(text: str) -> list[str]:
    """A template's words, as those of the documents are counted."""
    return [w for w in re.split(WORD_GAP, text.translate(_FOLD)) if w]


_FOLD = str.maketrans(UPPER, LOWER)


def _phrase_words(spark: SparkSession, phrases: list[str]) -> DataFrame:
    rows = [(p, len(p.split()), k, w) for p in phrases for k, w in enumerate(p.split())]
    return spark.createDataFrame(rows, "phrase string, len int, k int, term string")


def _postings(docs: DataFrame, vocabulary: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, n_words, term, pos) for each licence word, and a row with null term for each document."""
    words = docs.select(q(id_col).alias("id"), F.xxhash64(q(text_col)).alias("th"), F.explode_outer(F.array(F.split(F.coalesce(q(text_col), F.lit("")), CASED_GAP))).alias("words")).withColumn("words", F.array_remove("words", ""))
    rows = words.select("id", "th", F.size("words").alias("n_words"), F.posexplode_outer("words").alias("pos", "word"))
    rows = rows.join(F.broadcast(vocabulary), F.lower("word") == F.col("term"), "left")
    rows = rows.withColumn("term", F.when(F.translate("word", UPPER, LOWER) == F.col("term"), F.col("term")))
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    posting, document = F.struct("term", "pos"), F.struct(F.lit(None).cast("string").alias("term"), F.lit(None).cast("int").alias("pos"))
    kinds = F.when(first & F.col("term").isNotNull(), F.array(document, posting)).when(first, F.array(document)).otherwise(F.array(posting))
    return rows.filter(F.col("term").isNotNull() | first).select("id", "th", "n_words", F.inline_outer(kinds))


def _same_text(a: str, b: str):
    return F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.th") == F.col(f"{b}.th"))


def _followed(places: DataFrame, templates: dict[str, tuple[str, ...]], reach: int) -> DataFrame:
    """(id, th, label) of the templates whose phrases follow each other within ``reach``.
    A place meets the next phrase's places in its own and the next cell of ``reach`` words."""
    spark = places.sparkSession
    state, done = None, None
    for step in range(max(map(len, templates.values()), default=0)):
        here = [(label, ps[step], step + 1 == len(ps)) for label, ps in templates.items() if len(ps) > step]
        own = places.join(F.broadcast(spark.createDataFrame(here, "label string, phrase string, last boolean")), "phrase").withColumn("cell", F.floor(F.col("start") / reach))
        if state is None:
            found = own.select("id", "th", "label", "start", "last")
        else:
            before = state.withColumn("cell", F.explode(F.array(F.floor(F.col("start") / reach), F.floor(F.col("start") / reach) + 1))).alias("a")
            near = _same_text("a", "b") & (F.col("a.label") == F.col("b.label")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("b.start") > F.col("a.start")) & (F.col("b.start") <= F.col("a.start") + reach)
            found = before.join(own.alias("b"), near).select("a.id", "a.th", "a.label", "b.start", "b.last").distinct()
        ends = found.filter("last").select("id", "th", "label")
        done, state = ends if done is None else done.unionByName(ends), found.filter("not last").select("id", "th", "label", "start")
    return done


def _bodies_found(hits: DataFrame, places: DataFrame, rarity: DataFrame, bodies: dict[str, tuple[str, tuple[str, ...]]]) -> DataFrame:
    """(id, th, label, found) of the bodies that a file's ``FILE_WORDS`` rarest body words
    place: at least ``VOTES`` of their postings agree with the body's on where it would
    begin, and all its key phrases stand within it."""
    spark = hits.sparkSession
    rows = [(label, k, w) for label, (text, _) in bodies.items() for k, w in enumerate(body_words(text)) if len(w) >= LETTERS]
    index = spark.createDataFrame(rows, "label string, k int, term string")  # fixed size, as are all tables made of it
    known = index.select("term").distinct().join(F.broadcast(rarity), "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"))
    terms = hits.join(F.broadcast(known), "term").select("id", "th", "term", "df").distinct()
    order = Window.partitionBy("id", "th").orderBy("df", "term")
    rare = terms.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= FILE_WORDS).select("id", "th", "term")
    a, b = hits.alias("a"), rare.alias("b")
    looked = a.join(b, _same_text("a", "b") & (F.col("a.term") == F.col("b.term"))).select("a.id", "a.th", "a.term", "a.pos")
    votes = looked.join(F.broadcast(index), "term").groupBy("id", "th", "label", (F.col("pos") - F.col("k")).alias("start")).agg(F.size(F.collect_set("k")).alias("found")).filter(F.col("found") >= VOTES)
    keys = spark.createDataFrame([(label, p, len(ps), len(body_words(text))) for label, (text, ps) in bodies.items() for p in ps], "label string, phrase string, n int, len int")
    # keys and alignments meet in cells longer than any body
    width = max(len(body_words(text)) for text, _ in bodies.values()) + 2 * SLACK
    at = places.join(F.broadcast(keys), "phrase").withColumn("cell", F.floor(F.col("start") / width)).alias("b")
    spread = votes.withColumn("cell", F.explode(F.array(*(F.floor(F.col("start") / width) + d for d in (-1, 0, 1))))).alias("a")
    inside = (F.col("b.start") >= F.col("a.start") - SLACK) & (F.col("b.start") <= F.col("a.start") + F.col("b.len") + SLACK)
    met = spread.join(at, _same_text("a", "b") & (F.col("a.label") == F.col("b.label")) & (F.col("a.cell") == F.col("b.cell")) & inside)
    sure = met.groupBy("a.id", "a.th", "a.label", "a.start").agg(F.size(F.collect_set("b.phrase")).alias("keys"), F.max("b.n").alias("n"), F.max("a.found").alias("found")).filter("keys = n")
    return sure.groupBy("id", "th", "label").agg(F.max("found").alias("found"))


def license_scan(docs: DataFrame, base: dict[str, str] | None = None, templates: dict[str, tuple[str, ...]] | None = None, bodies: dict[str, tuple[str, tuple[str, ...]]] | None = None, reach: int = REACH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: id, ``n_words``, ``n_base`` (places where the words
    of a base phrase stand consecutively), ``first_word`` and ``last_word`` (the smallest
    and largest start of such places, words counted from 0; else null), ``base_labels``,
    ``labels`` (with those of the templates and bodies; distinct, sorted, joined by commas, empty if
    none) and ``score``: the largest share of a phrase's words found in place around its
    rarest word (1 for a whole phrase, 0 without any), or, if more, the share of
    ``FILE_WORDS`` that place a body.

    Each phrase is looked up by its word with the highest inverse document frequency in
    ``docs``; the other words' postings, shifted by their place in the phrase, must agree
    with it. A template's label needs its key phrases in order, the starts of neighbours
    at most ``reach`` words apart. A body's label needs ``VOTES`` postings of the file's
    ``FILE_WORDS`` licence words of highest IDF that agree on its place, and its key
    phrases there. Words are runs of letters, digits and non-ASCII
    characters, A-Z folded; null or empty texts have none. Null ids are allowed; rows that
    share an id and a text get the same row each. Other columns are ignored; an empty
    table gives no rows."""
    spark = docs.sparkSession
    base, templates, bodies = BASE if base is None else base, TEMPLATES if templates is None else templates, BODIES if bodies is None else bodies
    phrase_words = _phrase_words(spark, sorted({*base, *(p for ps in templates.values() for p in ps), *(p for _, ps in bodies.values() for p in ps)}))
    rare_words = sorted({w for text, _ in bodies.values() for w in body_words(text) if len(w) >= LETTERS})
    vocabulary = phrase_words.select("term").union(spark.createDataFrame([(w,) for w in rare_words], "term string")).distinct()
    index = materialise(_postings(docs, vocabulary, id_col, text_col), "licences")
    hits = index.filter("term is not null")
    rarity = materialise(hits.select("id", "th", "term").distinct().groupBy("term").agg(F.count("*").alias("df")), "rarity")
    ranked = phrase_words.join(F.broadcast(rarity), "term", "left").withColumn("r", F.row_number().over(Window.partitionBy("phrase").orderBy(F.coalesce("df", F.lit(0)), "k")))
    lookup = ranked.select("phrase", "len", "k", "term", (F.col("r") == 1).alias("rarest"))
    votes = hits.join(F.broadcast(lookup), "term").withColumn("start", F.col("pos") - F.col("k")).filter("start >= 0")
    places = votes.groupBy("id", "th", "phrase", "start").agg(F.size(F.collect_set("k")).alias("found"), F.max("len").alias("len"), F.max("rarest").alias("rarest")).filter("rarest")
    places = materialise(places, "places")
    whole = places.filter("found = len").select("id", "th", "phrase", "start")
    labels = spark.createDataFrame(list(base.items()), "phrase string, label string")
    own = whole.join(F.broadcast(labels), "phrase").select("id", "th", "label", "start", F.lit(1.0).alias("share"), F.lit(True).alias("base"))
    none = [F.lit(None).cast("int").alias("start"), F.lit(False).alias("base")]
    parts = [own, places.select("id", "th", F.lit(None).cast("string").alias("label"), (F.col("found") / F.col("len")).alias("share"), *none)]
    if templates:
        parts.append(_followed(whole, templates, reach).select("id", "th", "label", F.lit(1.0).alias("share"), *none))
    if bodies:
        parts.append(_bodies_found(hits, whole, rarity, bodies).select("id", "th", "label", F.least(F.col("found") / FILE_WORDS, F.lit(1.0)).alias("share"), *none))
    found = reduce(DataFrame.unionByName, parts)
    joined = lambda x: F.array_join(F.array_sort(F.collect_set(x)), ",")
    is_base = lambda x: F.when(F.col("base"), x)
    files = found.groupBy("id", "th").agg(F.max("share").alias("score"), F.count(is_base(F.lit(1))).alias("n_base"), F.min("start").alias("first_word"), F.max("start").alias("last_word"), joined(is_base(F.col("label"))).alias("base_labels"), joined(F.col("label")).alias("labels"))
    a, b = index.filter("term is null").alias("a"), files.alias("b")
    out = a.join(b, _same_text("a", "b"), "left")
    return out.select(
        F.col("a.id").alias(id_col),
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
