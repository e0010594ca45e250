"""License scans with a positional index of rare licence words.

One pass over the texts writes the index: for every file, the places of the words that
licence templates consist of, common words aside. Document frequencies come from the index
and give every word's IDF. Two kinds of templates are found in it.

*Phrases* label a file where their words stand consecutively. Each is looked up by its
highest-IDF word: where a file holds that, the phrase's other words must stand at their
relative positions. The phrase's words are all in the index and a file's places are sorted,
so they are neighbours in the file's list of places: checking takes one step over the list,
however often a word repeats.

*Bodies* are whole licence texts, which files carry reworded and rewrapped. For each, the
``RARE`` highest-IDF words of it that the file holds are looked up: a place of such a word less
its positions in the template is where the template would begin, and beginnings on which
``VOTES`` postings agree (but for ``DRIFT`` words put in or left out) are laid over the file. The
IDF-weighted share of the body's words that stand there must reach ``SHARE``, and the body's
mandatory key phrase must stand there too; then the file gets the label.

The score is the largest share of any template found, 0 to 1.

Defined results: a null text is an empty text; a file without words gets zeros, nulls and
empty strings; an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routegraph.llm.common import alnum_words, ascii_lower, let, owner, text_or_empty, written

#: The base phrases of the query's contract, as (label, key phrase).
BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
#: Our own templates, as (label, key phrase, template); "_" stands for any word.
TEMPLATES = (
    ("cc-by", "cc by", "licensed under cc by"),
    ("gpl", "general public license", "licensed under _ gnu general public license"),
    ("reserved", "all rights reserved", "copyright all rights reserved"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa"),
    ("gpl-3", "general public license version 3", "licensed under _ gnu general public license version 3"),
    ("lgpl", "lesser general public license", "gnu lesser general public license"),
    ("mit", "mit license", "released under _ mit license"),
    ("apache", "apache license", "licensed under _ apache license version 2"),
    ("mpl", "mozilla public license", "subject to _ terms _ _ mozilla public license"),
    ("bsd", "redistribution and use in source", "redistribution and use in source and binary forms"),
    ("proprietary", "proprietary and confidential", "proprietary and confidential"),
)
ANY = "_"
#: Public licence texts, as (label, key phrase, body); only words that are not COMMON count.
BODIES = (
    (
        "mit", "hereby granted free",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions",
    ),
    (
        "isc", "copy modify",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "bsd", "binary forms",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met redistributions of source code must retain the above copyright notice this list of "
        "conditions and the following disclaimer",
    ),
    (
        "zlib", "implied warranty",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable "
        "for any damages arising from the use of this software permission is granted to anyone to use this software for any "
        "purpose including commercial applications and to alter it and redistribute it freely subject to the following "
        "restrictions",
    ),
    (
        "apache", "apache license",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the "
        "license you may obtain a copy of the license at unless required by applicable law or agreed to in writing software "
        "distributed under the license is distributed on an as is basis without warranties or conditions of any kind either "
        "express or implied",
    ),
    (
        "unlicense", "unencumbered software",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use "
        "compile sell or distribute this software either in source code form or as a compiled binary for any purpose "
        "commercial or non commercial and by any means",
    ),
)
#: Words too common to be worth a posting.
COMMON = frozenset(
    "a an and any anyone are arising as at basis be by do either event files following for form free from held in into is it kind "
    "law list may means met must no non not of on or person persons provided so that the this to under use using whom will with "
    "without writing you 0".split()
)
#: A body's highest-IDF words that are looked up in a file, postings that must agree, words by
#: which they may be apart, and the share of a body that must stand.
RARE, VOTES, DRIFT, SHARE = 12, 3, 8, 0.6


def positions(body: str) -> list[tuple[int, str]]:
    """The words of a body that count, with their positions."""
    return [(i, w) for i, w in enumerate(body.split()) if w not in COMMON]


def vocabulary(templates, bodies=()) -> list[str]:
    phrases = {w for _, phrase, text in templates for w in (phrase + " " + text).split() if w != ANY}
    keys = {w for _, phrase, _ in bodies for w in phrase.split()}
    return sorted(phrases | keys | {w for _, _, body in bodies for _, w in positions(body)})


def license_index(docs: DataFrame, words_of: list[str], key: str, text: str) -> DataFrame:
    """(_key, n_words, _hits): the places of the vocabulary's words, as (place, word number)."""
    known = F.lit(words_of)
    lowered = docs.select(F.col(key).alias("_key"), alnum_words(ascii_lower(text_or_empty(text))).alias("_words"))
    # a set lookup for every word, a search through the list only for those that are in it
    held = F.transform("_words", lambda w, i: F.when(w.isin(words_of), F.struct(i.alias("at"), w.alias("word"))))
    numbered = F.transform(
        F.array_compact(held), lambda h: F.struct(h["at"].alias("at"), F.array_position(known, h["word"]).cast("int").alias("word"))
    )
    return lowered.select("_key", F.size("_words").cast("long").alias("n_words"), numbered.alias("_hits"))


def idf_of(index: DataFrame, words_of: list[str]) -> dict[str, float]:
    """IDF of the vocabulary's words; one row per word of the templates reaches the driver."""
    files = index.count()
    seen = index.select(F.explode(F.array_distinct(F.transform("_hits", lambda h: h["word"]))).alias("word"))
    df = {r["word"]: r["n"] for r in seen.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {w: math.log((files + 1) / (df.get(i + 1, 0) + 0.5)) for i, w in enumerate(words_of)}


def phrase_places(phrase: list[str], words_of: list[str], idf: dict[str, float]) -> Column:
    """array<struct<at, near>>: starts of the phrase, looked up by its highest-IDF word."""
    number = {w: i + 1 for i, w in enumerate(words_of)}
    rare = max(range(len(phrase)), key=lambda j: (idf[phrase[j]], -j))

    def look(hit: Column, k: Column) -> Column:
        # k: the rare word's number in the list; its neighbours must be the phrase's words
        ok = hit["word"] == number[phrase[rare]]
        for j, w in enumerate(phrase):
            if j != rare:
                near = F.get("_hits", k + (j - rare))
                ok = ok & (near["word"] == number[w]) & (near["at"] == hit["at"] + (j - rare))
        return F.when(F.coalesce(ok, F.lit(False)), F.struct((hit["at"] - rare).alias("at"), k.alias("near")))

    return F.array_compact(F.transform("_hits", look))


def template_share(start: Column, near: Column, text: list[str], words_of: list[str], idf: dict[str, float]) -> Column:
    """IDF-weighted share of the template's words at their places when it begins at ``start``."""
    number = {w: i + 1 for i, w in enumerate(words_of)}
    around = F.slice("_hits", F.greatest(near - len(text), F.lit(0)) + 1, F.lit(2 * len(text) + 1))
    words = [(j, w) for j, w in enumerate(text) if w != ANY]
    weight = sum(max(idf[w], 1e-9) for _, w in words)

    def stands(j: int, w: str) -> Column:
        there = F.exists(around, lambda h: (h["at"] == start + j) & (h["word"] == number[w]))
        return F.when(there, max(idf[w], 1e-9) / weight).otherwise(0.0)

    got = reduce(lambda a, b: a + b, [stands(j, w) for j, w in words])
    return F.least(got, F.lit(1.0))


def body_shares(label: tuple[str, str, str], words_of: list[str], idf: dict[str, float]) -> Column:
    """array<double>: the share of a body at every beginning that enough of the file's rare words
    agree on and around which the key phrase stands."""
    _, phrase, body = label
    number = {w: i + 1 for i, w in enumerate(words_of)}
    placed = positions(body)
    length = len(body.split())
    by_idf = sorted({w for _, w in placed}, key=lambda w: (-idf[w], w))
    of_word = {w: [p for p, x in placed if x == w] for w in by_idf}
    postings = F.array(*[F.array(*[F.lit(p) for p in of_word.get(w, [])]).cast("array<int>") for w in words_of])
    present = F.array_distinct(F.transform("_hits", lambda h: h["word"]))

    def beginnings(rare: Column) -> Column:
        """Sorted (beginning, number of the hit) of all postings of the rare words."""
        votes = F.transform(
            "_hits",
            lambda h, k: F.when(
                F.array_contains(rare, h["word"]),
                F.transform(F.get(postings, h["word"] - 1), lambda p: F.struct((h["at"] - p).alias("at"), k.alias("near"))),
            ),
        )
        return F.sort_array(F.flatten(F.array_compact(votes)))

    def agreed(votes: Column) -> Column:
        """The first of each run of beginnings on which enough postings agree."""
        many = F.filter(votes, lambda v, i: F.coalesce(F.get(votes, i + VOTES - 1)["at"] - v["at"] <= DRIFT, F.lit(False)))
        return let(many, lambda m: F.filter(m, lambda v, i: (i == 0) | (v["at"] - F.get(m, i - 1)["at"] > DRIFT)))

    weight = sum(max(idf[w], 1e-9) for _, w in placed)

    def share(v: Column) -> Column:
        reach = length + 2 * DRIFT
        around = F.slice("_hits", F.greatest(v["near"] - reach, F.lit(0)) + 1, F.lit(2 * reach + 1))

        def laid(near: Column) -> Column:
            def stands(p: int, w: str) -> Column:
                there = F.exists(near, lambda h: (h["word"] == number[w]) & (h["at"] - v["at"]).between(p, p + 2 * DRIFT))
                return F.when(there, max(idf[w], 1e-9) / weight).otherwise(0.0)

            return reduce(lambda a, b: a + b, [stands(p, w) for p, w in placed])

        return F.least(let(around, laid), F.lit(1.0))

    keys = phrase_places(phrase.split(), words_of, idf)
    near_key = lambda v, found: F.exists(found, lambda s: (s["at"] - v["at"]).between(-DRIFT, length + 2 * DRIFT))
    rare = F.slice(F.filter(F.lit([number[w] for w in by_idf]), lambda w: F.array_contains(present, w)), 1, RARE)
    shares = let(
        rare,
        lambda r: let(
            beginnings(r),
            lambda votes: let(
                keys, lambda found: F.transform(F.filter(agreed(votes), lambda v: near_key(v, found)), share)
            ),
        ),
    )
    return F.when(F.array_contains(present, number[phrase.split()[0]]), shares).otherwise(F.array().cast("array<double>"))


@owner
def find_licenses(
    docs: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES, bodies=BODIES, share: float = SHARE
) -> DataFrame:
    """(key, n_words, places, bodies, score) for every row: ``places`` lists each phrase's starts,
    ``bodies`` the labels of the licence texts found."""
    words_of = vocabulary(templates, bodies)
    index = written(license_index(docs, words_of, key, text), "license-index")
    idf = idf_of(index, words_of)

    def best_share(n: int) -> Column:
        phrase, body = templates[n][1].split(), templates[n][2].split()
        offset = next(i for i in range(len(body)) if body[i : i + len(phrase)] == phrase)
        return F.array_max(
            F.transform(f"_t{n}", lambda s: template_share(s["at"] - offset, s["near"], body, words_of, idf))
        )

    found = [phrase_places(t[1].split(), words_of, idf).alias(f"_t{n}") for n, t in enumerate(templates)]
    laid = [F.array_max(body_shares(b, words_of, idf)).alias(f"_b{n}") for n, b in enumerate(bodies)]
    with_places = index.filter(F.size("_hits") > 0).select("_key", "n_words", "_hits", *found, *laid)
    shares = [best_share(n) for n in range(len(templates))]
    enough = [F.when(F.col(f"_b{n}") >= share, F.lit(b[0])) for n, b in enumerate(bodies)]
    # a body that falls short counts for nothing: its words may stand there for other reasons
    shares += [F.when(F.col(f"_b{n}") >= share, F.col(f"_b{n}")) for n in range(len(bodies))]
    # nothing to look up in the other files
    without = index.filter(F.size("_hits") == 0).select(
        F.col("_key").alias(key), "n_words",
        F.array(*[F.array().cast("array<int>") for _ in templates]).alias("places"), F.array().cast("array<string>").alias("bodies"),
        F.lit(0.0).alias("score"),
    )
    return with_places.select(
        F.col("_key").alias(key),
        "n_words",
        F.array(*[F.transform(f"_t{n}", lambda s: s["at"]) for n in range(len(templates))]).alias("places"),
        F.array_compact(F.array(*enough, F.lit(None).cast("string"))).alias("bodies"),
        F.coalesce(F.greatest(*shares, F.lit(0.0)), F.lit(0.0)).alias("score"),
    ).unionByName(without)


def op4_license_scan(docs: DataFrame) -> DataFrame:
    def named(numbers: list[int]) -> Column:
        found = [F.when(F.size(F.get("places", F.lit(n))) > 0, F.lit(TEMPLATES[n][0])) for n in numbers]
        return F.array_compact(F.array(*found))

    def told(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    base = [next(n for n, t in enumerate(TEMPLATES) if t[:2] == b) for b in BASE]
    starts = F.concat(*[F.get("places", F.lit(n)) for n in base])
    return find_licenses(docs).select(
        "doc_id",
        "n_words",
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        told(named(base)).alias("base_labels"),
        told(F.concat(named(list(range(len(TEMPLATES)))), "bodies")).alias("labels"),
        F.round("score", 6).alias("score"),
    )
