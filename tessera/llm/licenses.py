"""License scans as an exact set-similarity join, in DataFrame operations only.

A template is a set of words with a containment threshold t: a text block matches if it holds at least ceil(t * |T|) of
the |T| words. Blocks are runs of 2 * S words, one from every S-th word on, S being the number of words of the longest
template: so every notice lies in one block as a whole, and long texts do not match by words that they hold far apart. Words
are ordered by their frequency over all texts, rarest first. A match must share a word with the template's prefix, its
|T| - need + 1 rarest words; so texts without any prefix word (nearly all) are settled by one array intersection, and of the
others only blocks with a prefix word are looked at. For these, the length filter (enough words), the positional filter
(enough words left in the template from the first shared prefix word on) and then the exact overlap decide. The templates
are a fixed list, so the side that every task holds is bounded; texts are read twice (counts, matches) and never shuffled.

Phrases are templates with t = 1 over the whole text, whose match is followed by an exact check that their words stand
consecutively.

Null is the empty text: no words, no places, labels '' and score 0. Repeated rows get a row each. Very long texts are handled
block by block within one row. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notices of public licences, matched at NOTICE_SHARE of their distinct words.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("this work is licensed under a creative commons attribution international license", "cc-by"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
)
NOTICE_SHARE = 0.8


def words(text: Column) -> Column:
    """Words, A-Z in lower case: runs of letters, digits and characters beyond ASCII."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def need(size: int, share: float) -> int:
    return max(1, math.ceil(share * size - 1e-9))


def word_counts(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> dict[str, int]:
    """Number of texts that hold each word of the (fixed) vocabulary, over all texts."""
    found = docs.select(F.explode(F.array_intersect(words(F.col(text_col)), F.array(*map(F.lit, vocabulary)))).alias("w"))
    return {r.w: r["count"] for r in found.groupBy("w").count().collect()}


def templates(counts: dict[str, int], phrases=PHRASES, notices=NOTICES, share: float = NOTICE_SHARE) -> list[dict]:
    out = []
    for text, label, t, phrase in [(p, lab, 1.0, True) for p, lab in phrases] + [(n, lab, share, False) for n, lab in notices]:
        ordered = sorted(set(text.split()), key=lambda w: (counts.get(w, 0), w))
        least = need(len(ordered), t)
        out.append({"label": label, "ordered": ordered, "need": least, "prefix": ordered[: len(ordered) - least + 1], "phrase": text if phrase else "", "notice": not phrase})
    return out


def _starts(doc_words: Column, phrase: str) -> Column:
    """Word numbers at which the words of the phrase stand one after the other."""
    parts = phrase.split()

    def here(i: Column) -> Column:
        at = F.get(doc_words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            at = at & (F.get(doc_words, i + k) == part)
        return at

    n = F.size(doc_words)
    return F.when(n >= len(parts), F.filter(F.sequence(F.lit(0), n - len(parts)), here)).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES, share: float = NOTICE_SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words long, places array<struct<label, start>>, notices array<struct<label, containment, start, end>>) of every row.

    Of the blocks that match a notice, the one of largest containment is told, the first among equals; words from 0, end exclusive.
    """
    vocabulary = sorted({w for t, _ in [*phrases, *notices] for w in t.split()})
    found = templates(word_counts(docs, vocabulary, text_col), phrases, notices, share)
    prefixes = sorted({w for t in found for w in t["prefix"]})
    base = docs.select(F.col(id_col), words(F.col(text_col)).alias("w"))
    hits = base.withColumn("hit", F.array_intersect("w", F.array(*map(F.lit, prefixes))))

    step = max(len(t.split()) for t, *_ in notices) if notices else 1
    block = lambda i: F.array_distinct(F.slice("w", i + 1, 2 * step))
    near = F.filter(F.sequence(F.lit(0), F.size("w") - 1, F.lit(step)), lambda i: F.arrays_overlap(F.slice("w", i + 1, 2 * step), F.col("hit")))
    blocks = F.transform(near, lambda i: F.struct(i.alias("at"), block(i).alias("w")))
    matched = hits.withColumn("blocks", F.when(F.size("hit") > 0, blocks).otherwise(F.array().cast("array<struct<at:int,w:array<string>>>")))

    def joined(t: dict, w: Column) -> Column:
        first = F.array_min(F.transform(F.array_intersect(F.array(*map(F.lit, t["prefix"])), w), lambda p: F.array_position(F.array(*map(F.lit, t["ordered"])), p).cast("int")))
        return first.isNotNull() & (F.size(w) >= t["need"]) & (len(t["ordered"]) - first + 1 >= t["need"])

    def notice(t: dict) -> Column:
        shared = F.transform(F.filter("blocks", lambda b: joined(t, b["w"])), lambda b: F.struct(F.size(F.array_intersect(F.array(*map(F.lit, t["ordered"])), b["w"])).alias("n"), (-b["at"]).alias("before")))
        best = F.array_max(F.filter(shared, lambda x: x["n"] >= t["need"]))
        end = F.least(2 * step - best["before"], F.size("w"))
        return F.when(best.isNotNull(), F.struct(F.lit(t["label"]).alias("label"), (best["n"] / len(t["ordered"])).alias("containment"), (-best["before"]).cast("long").alias("start"), end.cast("long").alias("end")))

    place = "array<struct<label:string,start:long>>"

    def places(phrase: str, label: str) -> Column:
        found = F.transform(_starts(F.col("w"), phrase), lambda i: F.struct(F.lit(label).alias("label"), i.cast("long").alias("start")))
        whole = F.array(*map(F.lit, sorted(set(phrase.split()))))
        return F.when(F.size(F.array_intersect(whole, "w")) == len(set(phrase.split())), found).otherwise(F.array().cast(place))

    at = [places(*p) for p in phrases]
    shares = F.array_compact(F.array(*[notice(t) for t in found if t["notice"]])) if notices else F.array().cast("array<struct<label:string,containment:double,start:long,end:long>>")
    return matched.select(id_col, F.size("w").cast("long").alias("n_words"), F.concat(*at).alias("places"), shares.alias("notices"))
