"""License scans by a positional rare-token index (DataFrame functions only).

Licence templates are indexed as postings word -> (template, position). Of
each template the places whose words have the highest IDF are looked up in
every file, as many of them that wherever enough of all its words agree, at
least ``MIN_VOTES`` of those do; postings that agree on the template's place
in the file (file position minus template position) are intersected, and a
template is reported where its mandatory key phrase stands there word by
word, and enough of all its words do. Nothing depends on the file's length
or on its other notices, and the IDF decides only which places are looked
up, not what is found. Plain phrase counts stand beside it.

Document frequencies of the templates' words, a vocabulary of fixed size,
are counted over all documents.

Cases: null or empty text has no words and no labels; rows without an id
and repeated rows are scanned like any other; an empty table gives an empty
table; other columns are kept, and one with the name of an output column is
replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, bind

#: phrase -> label (fixed values)
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: label -> (opening of the licence's own notice, its mandatory key phrase)
TEMPLATES = {
    "apache-notice": ("licensed under the apache license version 2 0", "apache license"),
    "bsd-terms": ("redistribution and use in source and binary forms with or without modification are "
                  "permitted provided that the following conditions are met",
                  "redistribution and use in source and binary forms"),
    "cc-by-nc": ("licensed under cc by nc 4 0", "cc by nc"),
    "cc-by-sa": ("licensed under cc by sa 4 0", "cc by sa"),
    "gpl-notice": ("this program is free software you can redistribute it and or modify it under the terms of "
                   "the gnu general public license as published by the free software foundation",
                   "gnu general public license"),
    "gpl-work": ("this work is licensed under the gnu general public license version",
                 "gnu general public license"),
    "isc-grant": ("permission to use copy modify and or distribute this software for any purpose with or "
                  "without fee is hereby granted", "with or without fee is hereby granted"),
    "lgpl-notice": ("under the terms of the gnu lesser general public license as published by the free "
                    "software foundation", "gnu lesser general public license"),
    "mit-grant": ("permission is hereby granted free of charge to any person obtaining a copy of this software "
                  "and associated documentation files", "permission is hereby granted"),
    "mit-release": ("released under the mit license", "mit license"),
    "mpl-notice": ("this source code form is subject to the terms of the mozilla public license v 2 0",
                   "mozilla public license"),
}
MIN_VOTES = 2
MIN_SHARE = 0.6

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _line(text: Column) -> Column:
    """The words of the text, one space between two; empty without words."""
    return F.trim(F.regexp_replace(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), _SEPARATORS, " "))


def _words(line: Column) -> Column:
    return F.when(line == "", F.array().cast("array<string>")).otherwise(F.split(line, " ", -1))


def _n_words(padded: Column) -> Column:
    """Words of a stretch in which each stands between two spaces of its own."""
    return ((F.length(padded) - F.length(F.replace(padded, F.lit(" "), F.lit("")))) / 2).cast("long")


def _base(line: Column) -> Column:
    """(n_base, first_word, last_word, labels) of the phrases."""
    def places(s: Column, phrase: str) -> Column:
        key = " " + phrase.replace(" ", "  ") + " "
        width = len(phrase.split())
        n = ((F.length(s) - F.length(F.replace(s, F.lit(key), F.lit("")))) / len(key)).cast("long")
        return F.when(F.contains(s, F.lit(key)), F.struct(
            n.alias("n"), _n_words(F.substring_index(s, key, 1)).alias("first"),
            (_n_words(s) - _n_words(F.substring_index(s, key, -1)) - width).alias("last"),
            F.lit(PHRASES[phrase]).alias("label")))

    def of(s: Column) -> Column:
        return F.array_compact(F.array(*[places(s, p) for p in PHRASES]))

    return bind(F.concat(F.lit(" "), F.replace(line, F.lit(" "), F.lit("  ")), F.lit(" ")), of)


def word_idf(docs: DataFrame, text_col: str = "text") -> dict[str, float]:
    """IDF of the templates' words over all documents."""
    vocabulary = sorted({w for t, _ in TEMPLATES.values() for w in t.split()})
    known = F.array(*[F.lit(w) for w in vocabulary])
    found = docs.select(F.array_intersect(_words(_line(F.col(f"`{text_col}`"))), known).alias("w"))
    # one pass: the documents and those with each word (a fixed number of groups)
    counts = {r["w"]: r["n"] for r in found.select(F.explode(F.concat(F.array(F.lit("")), "w")).alias("w"))
              .groupBy("w").agg(F.count("*").alias("n")).collect()}
    n = counts.pop("", 0)
    return {w: math.log((n + 1) / (counts.get(w, 0) + 1)) for w in vocabulary}


def _looked_up(body: list[str], idf: dict[str, float]) -> list[int]:
    """The places of a template that are looked up, those with the highest
    IDF: one more than may disagree for each vote, so that none is missed."""
    need = next(n for n in range(len(body) + 1) if n / len(body) >= MIN_SHARE)
    order = sorted(range(len(body)), key=lambda p: (-idf.get(body[p], 0.0), body[p], p))
    return order[:len(body) - need + MIN_VOTES]


def _templates_found(words: Column, idf: dict[str, float]) -> Column:
    """(label, share of the template's words that agree) of each template."""
    none = F.array().cast("array<struct<label:string,share:double>>")
    posting: dict[str, list[tuple[int, int]]] = {}
    for t, (body, _) in enumerate(TEMPLATES.values()):
        for pos in _looked_up(body.split(), idf):
            posting.setdefault(body.split()[pos], []).append((t, pos))
    order = sorted(posting)
    rank = F.create_map(*[F.lit(x) for k, w in enumerate(order) for x in (w, k)])
    postings = F.array(*[F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p"))
                                   for t, p in posting[w]]) for w in order])
    table = F.array(*[F.struct(
        F.lit(label).alias("label"), F.array(*[F.lit(w) for w in body.split()]).alias("body"),
        F.lit(" " + key + " ").alias("key")) for label, (body, key) in TEMPLATES.items()])

    def of(ws: Column) -> Column:
        # (rank, place) of the file's licence words
        ranked = F.filter(F.transform(ws, lambda w, i: F.struct(
            F.when(w.isin(order), rank[w]).alias("r"), i.alias("at"))), lambda h: h["r"].isNotNull())
        return bind(ranked, lambda hits: F.when(F.size(hits) < MIN_VOTES, none).otherwise(looked_up(ws, hits)))

    def looked_up(ws: Column, hits: Column) -> Column:
        votes = F.array_sort(F.flatten(F.transform(
            hits, lambda h: F.transform(F.get(postings, h["r"]), lambda p: F.struct(
                p["t"].alias("t"), (h["at"] - p["p"]).alias("off"), p["p"].alias("p"))))))
        return bind(votes, lambda v: verified(ws, v))

    def verified(ws: Column, v: Column) -> Column:
        # sorted: a vote whose MIN_VOTES - 1st successor has its template and place
        def enough(x: Column, i: Column) -> Column:
            then = F.get(v, i + (MIN_VOTES - 1))
            return F.coalesce((then["t"] == x["t"]) & (then["off"] == x["off"]), F.lit(False))

        places = F.array_distinct(F.transform(F.filter(v, enough), lambda x: F.struct(x["t"], x["off"])))

        def judge(x: Column) -> Column:
            return bind(F.get(table, x["t"]), lambda m: bind(
                F.transform(F.sequence(F.lit(0), F.size(m["body"]) - 1),
                            lambda k: F.when(x["off"] + k >= 0, F.get(ws, x["off"] + k))),
                lambda here: F.struct(
                    m["label"].alias("label"),
                    (F.aggregate(F.zip_with(here, m["body"], lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0))),
                                 F.lit(0), lambda a, b: a + b) / F.size(m["body"])).alias("share"),
                    F.contains(F.concat(F.lit(" "), F.array_join(here, " ", "\x00"), F.lit(" ")), m["key"]).alias("key"))))

        good = F.filter(F.transform(places, judge), lambda x: x["key"] & (x["share"] >= MIN_SHARE))
        return F.transform(good, lambda x: F.struct(x["label"], x["share"]))

    return bind(words, of)


def scan(docs: DataFrame, text_col: str = "text", idf: dict[str, float] | None = None) -> DataFrame:
    """``docs`` with ``n_words``, ``n_base``, ``first_word``, ``last_word``,
    ``base_labels``, ``labels`` (comma-joined) and ``score`` (the best
    template's share of agreeing words, 0 without one)."""
    idf = word_idf(docs, text_col) if idf is None else idf

    def of(line: Column) -> Column:
        return bind(F.struct(_base(line).alias("base"), _words(line).alias("words")), both)

    def both(b: Column) -> Column:
        return bind(_templates_found(b["words"], idf), lambda found: F.struct(
            F.size(b["words"]).cast("long").alias("n_words"),
            F.aggregate(b["base"], F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_base"),
            F.array_min(F.transform(b["base"], lambda x: x["first"])).alias("first_word"),
            F.array_max(F.transform(b["base"], lambda x: x["last"])).alias("last_word"),
            F.array_join(F.array_sort(F.transform(b["base"], lambda x: x["label"])), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.array_distinct(F.concat(
                F.transform(b["base"], lambda x: x["label"]),
                F.transform(found, lambda x: x["label"])))), ",").alias("labels"),
            F.coalesce(F.array_max(F.transform(found, lambda x: x["share"])), F.lit(0.0)).alias("score")))

    from tessera.llm.common import fresh
    got = fresh(docs, "got")
    out = docs.withColumn(got, bind(_line(F.col(f"`{text_col}`")), of))
    for name in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"):
        out = out.withColumn(name, F.col(got)[name])
    return out.drop(got)
