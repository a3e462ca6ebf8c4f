"""Operator 4 [native]: licence scan by a positional rare-token index.

Words are runs of ASCII letters (lower-cased), digits and characters beyond ASCII.  The base looks up four phrases word by
word.  The method then takes each template's rarest word of its mandatory key phrase (IDF over all documents), looks it up in
the file's postings (word, position) of licence words, and so gets relative positions (file position less template position);
where the key phrase stands, the template is scored over all its licence words: it is accepted when the IDF weight found at
one relative position is MATCH of the whole.  A place without the key phrase can't be accepted, so none is missed.

Only texts that contain a trigger are looked up; every base phrase and every mandatory key phrase contains one.  The IDF
counts the words of all texts.  No shuffle but for the IDF.

Null and empty texts have no words, no labels and score 0.  Ties in IDF go by the word.  Repeated rows give repeated rows;
an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .quality import once

#: The base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Label, mandatory key phrase and opening words of public licence notices.
TEMPLATES = (
    ("gpl", "general public license", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "general public license", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "lesser general public license", "it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "affero general public license", "it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("apache", "apache license", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    ("apache", "apache license", "licensed under the apache license version 2 0"),
    ("mit", "mit license", "released under the mit license"),
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    ("cc-by-nd", "cc by nd", "licensed under cc by nd 4 0"),
    ("cc-by", "creative commons attribution", "this work is licensed under a creative commons attribution 4 0 international license"),
)
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: One of these is in every base phrase and in every template's mandatory key phrase.
TRIGGER = r"creative[\x00-\x2F\x3A-\x60\x7B-\x7F]+commons|license|licensed|permission|redistribut|(?<![0-9a-z\x80-\x{10FFFF}])cc[\x00-\x2F\x3A-\x60\x7B-\x7F]+by(?![0-9a-z\x80-\x{10FFFF}])"
MATCH = 0.6
#: Words of a template that say nothing about licences.
COMMON = frozenset("a and any are as at be by can for form free i in is it may not of on or that the this to under use version with without you".split())


def vocabulary() -> list[str]:
    return sorted({w for _, _, t in TEMPLATES for w in t.split()} - COMMON)


def _low() -> Column:
    return F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def worded(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, words (null unless the text has a trigger)."""
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _low().alias("low"))
    x = x.withColumn("n_words", F.regexp_count("low", F.lit(WORD)).cast("long"))
    quick = F.col("low").contains("licens") | F.col("low").contains("permission") | F.col("low").contains("redistribut") | F.col("low").contains("cc") | F.col("low").contains("commons")
    return once(x, "words", F.when(quick & F.col("low").rlike(TRIGGER), F.array_remove(F.split("low", SEPARATOR, -1), ""))).drop("low")


def idf(docs: DataFrame) -> dict[str, float]:
    """log((documents + 1) / (documents with the word + 1)) of the template words, over all documents; one row a word."""
    names = vocabulary()
    words = F.split(_low(), SEPARATOR, -1)
    hits = docs.select(F.explode(F.array_intersect(words, F.array(*map(F.lit, names)))).alias("w")).groupBy("w").count().collect()
    total, df = docs.count(), {r["w"]: r["count"] for r in hits}
    return {w: math.log((total + 1) / (df.get(w, 0) + 1)) + 1e-9 for w in names}


def _places(phrase: str, ws: Column) -> Column:
    """Starts of a phrase in an array of words, from 0."""
    words = phrase.split()
    n = len(words)
    same = lambda i: F.slice(ws, i + 1, n) == F.array(*map(F.lit, words))
    head = F.filter(F.transform(ws, lambda w, i: F.when(w == words[0], i)), lambda i: i.isNotNull())
    return F.filter(head, same)


def _stands(key: list[str], start: int, words: Column):
    """Whether the key phrase stands in its place, of a template at a relative position."""
    return lambda o: (o + start >= 0) & (F.slice(words, F.greatest(F.lit(1), o + start + 1), len(key)) == F.array(*map(F.lit, key)))


def _offsets(word: str, k: int) -> Column:
    """The relative positions at which a template's k-th word stands."""
    return F.transform(F.filter("hits", lambda h: h["w"] == word), lambda h: h["i"] - k)


def _share(post: list[tuple[str, int]], weight: dict[str, float], words: Column):
    """The share of a template's IDF weight that stands at a relative position."""
    table = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(k).alias("k"), F.lit(weight[w]).alias("x")) for w, k in post])
    total = F.lit(sum(weight[w] for w, _ in post))
    return lambda o: F.least(F.lit(1.0), F.aggregate(table, F.lit(0.0), lambda s, p: s + F.when(F.get(words, o + p["k"]) == p["w"], p["x"]).otherwise(0.0)) / total)


def scanned(docs: DataFrame, match: float = MATCH) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    weight = idf(docs)
    x = worded(docs)
    words = F.col("words")
    hit = lambda w, i: F.struct(w.alias("w"), i.alias("i"))
    names = F.array(*map(F.lit, vocabulary()))
    none = F.array().cast("array<struct<w:string,i:int>>")
    x = once(x, "hits", F.when(words.isNotNull(), F.filter(F.transform(words, hit), lambda h: F.array_contains(names, h["w"]))).otherwise(none))
    # the base: every place of every phrase
    place = lambda p, label: F.transform(_places(p, words), lambda i: F.struct(i.alias("i"), F.lit(label).alias("label")))
    base = F.concat(*[place(p, label) for p, label in PHRASES.items()])
    x = once(x, "base", F.when(words.isNotNull(), base).otherwise(F.array().cast("array<struct<i:int,label:string>>")))
    found = []
    for label, key, text in TEMPLATES:
        tw, kw = text.split(), key.split()
        post = [(w, k) for k, w in enumerate(tw) if w not in COMMON]
        start = next(k for k in range(len(tw)) if tw[k : k + len(kw)] == kw)
        # the key phrase's rarest word gives the relative positions
        at = max((k for k in range(start, start + len(kw)) if tw[k] not in COMMON), key=lambda k: (weight[tw[k]], tw[k]))
        offsets = _offsets(tw[at], at)
        share = F.transform(F.filter(offsets, _stands(kw, start, words)), _share(post, weight, words))
        x = once(x, f"s{len(found)}", F.when(F.size("hits") > 0, F.coalesce(F.array_max(share), F.lit(0.0))).otherwise(0.0))
        found.append((label, F.col(f"s{len(found)}")))
    more = F.array_compact(F.array(*[F.when(s >= match, F.lit(label)) for label, s in found]))
    own = F.transform("base", lambda b: b["label"])
    starts = F.transform("base", lambda b: b["i"])
    joined = lambda a: F.array_join(F.sort_array(F.array_distinct(a)), ",")
    score = F.greatest(*[s for _, s in found], F.when(F.size("base") > 0, 1.0).otherwise(0.0))
    return x.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"), joined(own).alias("base_labels"), joined(F.concat(own, more)).alias("labels"), score.alias("score"))
