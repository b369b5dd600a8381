"""Licence scan by a positional index of rare licence words.

The index lists, for each word of the licence templates that isn't a function
word, the templates and positions where it stands.  For each template the file's
words of the highest inverse document frequency are looked up, so one licence
can't crowd out another; postings agree on a template where the differences of
positions agree, and a template counts once
its mandatory key phrase stands at that place word by word.  DataFrame
expressions only; one pass over the texts, everything after it on licence words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textstrata.functions.arrays import let
from textstrata.llm.shared import ascii_lower, materialise

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that count wherever their words stand consecutively, with labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Fixed values: (label, template words, mandatory key phrase inside the template).
TEMPLATES = (
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc0", "creative commons cc0 1 0 universal public domain dedication", "cc0 1 0 universal"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute"),
    ("unlicense", "free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
)
FUNCTION_WORDS = frozenset("a and any are as by can for in into is it of or that the this to under with without you 0 1 2 3 4 v".split())
PHRASE_WORDS = max(len(p.split()) for _, _, p in TEMPLATES)


def _postings() -> dict[str, list[tuple[int, int]]]:
    found: dict[str, list[tuple[int, int]]] = {}
    for t, (_, words, _) in enumerate(TEMPLATES):
        for at, w in enumerate(words.split()):
            if w not in FUNCTION_WORDS:
                found.setdefault(w, []).append((t, at))
    return found


def _phrase_start(t: int) -> int:
    words, phrase = TEMPLATES[t][1].split(), TEMPLATES[t][2].split()
    return next(i for i in range(len(words)) if words[i:i + len(phrase)] == phrase)


def read_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, id, n_words, base, hits`` per input row, from one pass over the texts.

    ``base``: (start, label) of each base phrase; ``hits``: word, position and
    the following words of each licence word; positions count from 0.
    """
    index = sorted(set(_postings()) | {p.split()[0] for p, _ in BASE})
    words = F.array_remove(F.split(ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), NOT_WORD), "")

    def stands(w: Column, at: Column, phrase: str) -> Column:
        ok = F.lit(True)
        for i, part in enumerate(phrase.split()):
            ok = ok & F.coalesce(F.get(w, at + i) == part, F.lit(False))
        return ok

    def places_of(w: Column, at: Column, phrase: str, label: str) -> Column:
        return F.transform(F.filter(at, lambda i: stands(w, i, phrase)), lambda i: F.named_struct(F.lit("at"), i, F.lit("label"), F.lit(label)))

    def fields(w: Column) -> Column:
        places = F.filter(F.transform(w, lambda x, i: F.when(x.isin(*index), i)), lambda i: i.isNotNull())

        def collect(at: Column) -> Column:
            base = F.flatten(F.array(*[places_of(w, at, phrase, label) for phrase, label in BASE]))
            hits = F.transform(at, lambda i: F.struct(F.get(w, i).alias("w"), i.alias("at"), F.concat_ws(" ", F.slice(w, i + 1, F.lit(PHRASE_WORDS))).alias("text")))
            return F.struct(F.size(w).cast("long").alias("n_words"), base.alias("base"), hits.alias("hits"))
        return let(places, collect)

    return (docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), let(words, fields).alias("f"))
            .select("row", "id", "f.n_words", "f.base", "f.hits"))


def match_templates(rows: DataFrame, lookups: int = 8, min_share: float = 0.5) -> DataFrame:
    """``(row, found, score)`` for rows with licence words.

    A row looks up, for each template, its ``lookups`` distinct words of the
    highest inverse document frequency over all rows.  ``score`` is the largest share
    of a template's weight found at one relative position, halved where the
    key phrase isn't there; ``found`` lists the labels of templates that have
    the key phrase and at least ``min_share``.
    """
    postings = _postings()
    n = rows.count()
    counted = rows.select(F.explode(F.array_distinct("hits.w")).alias("w")).groupBy("w").agg(F.count("*").alias("df")).collect()  # one row per index word at most
    idf = {r.w: math.log(1 + n / r.df) for r in counted if r.w in postings}
    if not idf:
        return rows.sparkSession.createDataFrame([], "row long, found array<string>, score double")
    weight = F.create_map(*[F.lit(x) for pair in sorted(idf.items()) for x in pair])
    code = {pair: i for i, pair in enumerate(sorted({(t, w) for w in idf for t, _ in postings[w]}))}
    entry = F.create_map(*[x for w in sorted(idf) for x in (F.lit(w), F.array(*[
        F.struct(F.lit(t).alias("t"), F.lit(at).alias("t_at"), F.lit(code[t, w]).alias("code")) for t, at in postings[w]]))])
    full = []
    for _, words, _ in TEMPLATES:
        per_place = sorted((idf.get(w, 0.0) for w in words.split()), reverse=True)
        full.append(sum(per_place[:lookups]))

    def rarest(t: int, seen: Column) -> Column:
        words = sorted((w for u, w in code if u == t), key=lambda w: (-idf[w], w))
        known = F.array(*[F.when(F.array_contains(seen, w), F.lit(code[t, w])) for w in words])
        return F.slice(F.array_compact(known), 1, lookups)

    rare = let(F.array_distinct("hits.w"), lambda seen: F.flatten(F.array(*[rarest(t, seen) for t in sorted({t for t, _ in code})])))
    looked = rows.where(F.size("hits") > 0).select("row", rare.alias("rare"), F.explode("hits").alias("h"))
    placed = (looked.where(F.col("h.w").isin(*idf))
              .select("row", "rare", weight[F.col("h.w")].alias("weight"), F.col("h.at").alias("at"), F.col("h.text").alias("text"), F.explode(entry[F.col("h.w")]).alias("p"))
              .withColumn("weight", F.when(F.array_contains("rare", F.col("p.code")), F.col("weight")).otherwise(0.0)))
    key = F.lit(False)
    for t, (_, _, phrase) in enumerate(TEMPLATES):
        here = (F.col("p.t") == t) & (F.col("p.t_at") == _phrase_start(t))
        key = key | (here & F.startswith(F.concat("text", F.lit(" ")), F.lit(phrase + " ")))
    total = F.array(*[F.lit(x) for x in full])[F.col("t")]
    share = F.when(total > 0, F.least(F.col("weight") / total, F.lit(1.0))).otherwise(0.0)
    label = F.array(*[F.lit(x) for x, _, _ in TEMPLATES])[F.col("t")]
    return (placed.groupBy("row", F.col("p.t").alias("t"), (F.col("at") - F.col("p.t_at")).alias("offset")).agg(F.sum("weight").alias("weight"), F.max(key).alias("key"))
            .select("row", label.alias("label"), share.alias("share"), "key")
            .groupBy("row").agg(F.collect_set(F.when(F.col("key") & (F.col("share") >= min_share), F.col("label"))).alias("found"), F.max(F.when(F.col("key"), F.col("share")).otherwise(F.col("share") / 2)).alias("score")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lookups: int = 8, min_share: float = 0.5) -> DataFrame:
    """``id, n_words, n_base, first_word, last_word, base_labels, labels, score`` per input row.

    Null and empty texts have no words, no labels and score 0; repeated rows
    each get a row; an empty table gives an empty result.  ``first_word`` and
    ``last_word`` are null without a base phrase.
    """
    rows = materialise(read_words(docs, id_col, text_col), "licence-words")
    found = match_templates(rows, lookups, min_share)
    labels = lambda more: F.concat_ws(",", F.array_sort(F.array_distinct(F.concat(F.col("base.label"), more))))
    none = F.array().cast("array<string>")
    return rows.join(found, "row", "left").select(
        "id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min("base.at").cast("long").alias("first_word"), F.array_max("base.at").cast("long").alias("last_word"),
        labels(none).alias("base_labels"), labels(F.coalesce("found", none)).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
