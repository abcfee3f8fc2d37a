"""Operator 9: licence scan with a positional rare-token index, in DataFrame functions only.

Texts are lower-cased in A-Z and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. A template is one or several passages of a licence and
its mandatory key phrases. Document frequencies of the passages' words over the whole corpus give each word's IDF, and the
``RARE`` words of highest IDF of each passage, with all their places in it, make the index (word -> passage, place).

In every file all occurrences of indexed words are looked up. Each gives the passages' starts that it allows (its place in the file minus the place in
the passage); the postings are intersected by relative position: equal (passage, start) are counted, and a passage stands where ``AGREE`` or more
of its indexed places agree on one start. A template is reported where half of its passages or more stand and all of its key
phrases are verified in the file. ``score`` is the best passage's share of agreeing places (0.5 at least where a base phrase stands). The
three base phrases are found at all places: the rarest word of a phrase is looked up, and the phrase's words are verified around each of its occurrences.

Null and empty texts have no words and no labels; repeated rows give repeated rows; ties between words of one IDF go by
the word; an empty table gives no rows; extra columns are not read. Texts of any length are scanned whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base phrases and their labels.
BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
# Label -> passages of the published licence texts and notices, and key phrases that must stand in the file.
TEMPLATES = {
    "mit": (
        (
            "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
            "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
            "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
            "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
        ),
        ("permission is hereby granted", "free of charge"),
    ),
    "bsd-3-clause": (
        (
            "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
            "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
            "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
            "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        ),
        ("redistribution and use", "binary forms", "neither the name"),
    ),
    "bsd": (
        (
            "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
            "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
        ),
        ("redistribution and use", "binary forms"),
    ),
    "apache-2.0": (
        (
            "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
            "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        ),
        ("apache license",),
    ),
    "gpl-3.0": (
        (
            "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
            "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
            "you should have received a copy of the gnu general public license along with this program if not see",
        ),
        ("gnu general public license", "free software"),
    ),
    "lgpl-2.1": (
        (
            "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
            "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details",
        ),
        ("gnu lesser general public license",),
    ),
    "isc": (
        (
            "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
            "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        ),
        ("with or without fee",),
    ),
    "zlib": (
        (
            "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
            "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
            "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
        ),
        ("redistribute it freely", "must not be misrepresented"),
    ),
    "unlicense": (
        (
            "this is free and unencumbered software released into the public domain",
            "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        ),
        ("unencumbered software", "public domain"),
    ),
    "mpl": (
        ("this source code form is subject to the terms of the mozilla public license v 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at"),
        ("mozilla public license",),
    ),
    "gpl-notice": (("this work is licensed under the gnu general public license version 3 or later",), ("gnu general public license",)),
    "cc-by-notice": (("this work is licensed under a creative commons attribution cc by 4 0 international license",), ("creative commons", "attribution")),
    "cc-by-short": (("this work is licensed under cc by 4 0",), ("licensed under cc by",)),
    "copyright-notice": (("copyright c all rights reserved",), ("copyright", "all rights reserved")),
}
#: Words of highest IDF of a passage that are indexed, and the share of their places that must agree on one start.
RARE, AGREE = 10, 0.6
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.filter(parts, lambda w: w != "")


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _phrase_at(words_: Column, start: Column, phrase: list[str]) -> Column:
    """Whether the phrase's words stand at ``start``."""
    found = F.lit(True)
    for k, w in enumerate(phrase):
        found = found & F.coalesce(F.get(words_, start + k) == w, F.lit(False))
    return found


def index(passages: list[list[str]], rank: dict[str, int]) -> tuple[dict[str, list[tuple[int, int]]], list[int]]:
    """Postings of each passage's ``RARE`` words of highest IDF (``rank``: the rarest word first), and how many places a passage has in them."""
    postings: dict[str, list[tuple[int, int]]] = {}
    size = []
    for t, own in enumerate(passages):
        rare = set(sorted(set(own), key=rank.get)[:RARE])
        places = [(w, at) for at, w in enumerate(own) if w in rare]
        for w, at in places:
            postings.setdefault(w, []).append((t, at))
        size.append(len(places))
    return postings, size


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict | None = None) -> DataFrame:
    """Per row: word count, base places, base labels, all labels and the best passage's share of agreeing places."""
    templates = TEMPLATES if templates is None else templates
    passages = [p.split() for v in templates.values() for p in v[0]]
    of = [n for n, v in enumerate(templates.values()) for _ in v[0]]
    phrases = {label: p.split() for label, p in BASE.items()}
    keys = {k: [p.split() for p in v[1]] for k, v in templates.items()}
    every = [*passages, *phrases.values(), *(p for v in keys.values() for p in v)]
    vocabulary = sorted({w for p in every for w in p})

    src = df.select(F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("words"))
    # document frequency of the vocabulary, all documents counted; at most one row per vocabulary word
    seen = src.select(F.explode(F.array_intersect("words", _strings(vocabulary))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    frequency = {r["word"]: r["df"] for r in seen.collect()}
    rank = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}  # rarest, so highest IDF, first
    rarest = {id(p): min(range(len(p)), key=lambda k, p=p: rank[p[k]]) for p in every}
    postings, size = index(passages, rank)
    anchors = {p[rarest[id(p)]] for p in [*phrases.values(), *(q for v in keys.values() for q in v)]}
    indexed = sorted(postings.keys() | anchors)
    hit = F.filter(
        F.transform("words", lambda w, i: F.struct(i.cast("long").alias("at"), w.alias("word"))),
        lambda x: x["word"].isin(indexed),
    )
    # the words are filtered first, so that files without any indexed word cost one scan
    src = src.withColumn("hits", hit)

    def places(phrase: list[str]) -> Column:
        k = rarest[id(phrase)]
        starts = F.transform(F.filter("hits", lambda h: h["word"] == phrase[k]), lambda h: (h["at"] - k).cast("int"))
        return F.filter(starts, lambda s: (s >= 0) & _phrase_at(F.col("words"), s, phrase))

    src = src.withColumns({f"base_{k}": places(p) for k, p in enumerate(phrases.values())})
    # all of the file's hits are looked up; a start of a passage is start * 2^16 + passage, so that equal ones stand together when sorted
    posting = F.create_map(*[x for w in sorted(postings) for x in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(at).alias("at")) for t, at in postings[w]]))])
    starts = F.sort_array(
        F.flatten(
            F.transform(
                F.filter("hits", lambda h: h["word"].isin(sorted(postings))),
                lambda h: F.transform(F.element_at(posting, h["word"]), lambda p: (h["at"] - p["at"]) * 65536 + p["t"]),
            )
        )
    )
    none = F.array().cast("array<bigint>")
    src = src.withColumn("starts", F.when(F.size("hits") > 0, starts).otherwise(none))
    # a passage stands on a start that enough of its places agree on: in the sorted array the value repeats that many times
    need = [max(1, math.ceil(AGREE * n - 1e-9)) for n in size]
    needs, sizes = F.array(*[F.lit(n) for n in need]), F.array(*[F.lit(n) for n in size])
    passage = lambda x: x.bitwiseAND(F.lit(65535)).cast("int")
    first = F.filter(
        F.transform(
            "starts",
            lambda x, i: F.when(((i == 0) | (F.get("starts", i - 1) != x)) & (F.get("starts", i + F.get(needs, passage(x)) - 1) == x), F.struct(passage(x).alias("t"), i.alias("i"), x.alias("x"))),
        ),
        lambda s: s.isNotNull(),
    )
    src = src.withColumn("standing", first)
    src = src.withColumn("standing", F.transform("standing", lambda s: F.struct(s["t"].alias("t"), (F.size(F.filter("starts", lambda x: x == s["x"])) / F.get(sizes, s["t"])).alias("share"))))

    def mandatory(name: str) -> Column:
        found = F.lit(True)
        for p in keys[name]:
            found = found & (F.size(places(p)) > 0)
        return found

    found = F.array_distinct(F.transform("standing", lambda s: s["t"]))
    src = src.withColumn("found", found)
    more = []
    for n, name in enumerate(templates):
        own = [t for t, o in enumerate(of) if o == n]
        stand = F.size(F.array_intersect("found", F.array(*[F.lit(t) for t in own])))
        more.append(F.when((F.size("found") > 0) & (2 * stand >= len(own)) & mandatory(name), F.lit(name)))
    base = [F.when(F.size(f"base_{k}") > 0, F.lit(label)) for k, label in enumerate(phrases)]
    out = src.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.sort_array(F.concat(*[f"base_{k}" for k in range(len(phrases))])).alias("bases"),
        F.sort_array(F.array_compact(F.array(*base))).alias("base"),
        F.array_compact(F.array(*more)).alias("more"),
        F.coalesce(F.array_max(F.transform("standing", lambda s: s["share"])), F.lit(0.0)).alias("share"),
    )
    return out.select(
        "doc_id",
        "n_words",
        F.size("bases").cast("long").alias("n_base"),
        F.get("bases", F.lit(0)).cast("long").alias("first_word"),
        F.get("bases", F.size("bases") - 1).cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("base", "more")), ",").alias("labels"),
        F.when(F.size("base") > 0, F.greatest("share", F.lit(0.5))).otherwise(F.col("share")).cast("double").alias("score"),
    )


def query(spark, sf_dir):
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
