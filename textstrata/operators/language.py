"""P5(b) by learned profiles: the language whose words begin and end as the text's do.

A profile is the naive Bayes table of the first and last three characters of
words, learned from rows whose language is known (``operators.bayes``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textstrata.functions.arrays import argmax
from textstrata.operators import bayes
from textstrata.operators.labels import label_to_id

TARGET = "lang"


def learn_profiles(df: DataFrame, text_col: str, lang_col: str, languages: Mapping[str, int]) -> DataFrame:
    """The profile table of the languages in ``languages`` (name -> id); rows of other languages, or of none, are left out."""
    known = df.select(F.col(text_col).alias("_text"), label_to_id(lang_col, languages).alias("_lang"))
    return bayes.train(known, "_text", {TARGET: "_lang"}, max(languages.values()) + 1, tokens="edges")


def detect(df: DataFrame, key_cols: Sequence[str], text_col: str, profiles: DataFrame, languages: Mapping[str, int],
           out_col: str = "detected") -> DataFrame:
    """The key columns and the likeliest language; ties go to the smaller id.

    A text without letters has no language (null), so ``drop_detected`` keeps it.
    """
    names = {i: n for n, i in languages.items()}
    rows = df.select(*key_cols, F.col(text_col).alias("_text"))
    scored = bayes.score(rows, key_cols, "_text", profiles, [TARGET], max(names) + 1, tokens="edges", prefix="_s_")
    blank = rows.select(*key_cols, (F.size(bayes.edge_grams("_text")) == 0).alias("_blank")).where("_blank")
    lookup = F.create_map(*[F.lit(x) for i, n in names.items() for x in (i, n)])
    found = scored.select(*key_cols, F.try_element_at(lookup, argmax(f"_s_{TARGET}")).alias(out_col))
    return found.join(blank, list(key_cols), "left").select(*key_cols, F.when(F.col("_blank").isNull(), F.col(out_col)).alias(out_col))


def drop_detected(df: DataFrame, key_cols: Sequence[str], detected: DataFrame, lang: str = "fr", out_col: str = "detected") -> DataFrame:
    """P5: the rows of ``df`` whose detected language isn't ``lang``."""
    return df.join(detected.where(F.col(out_col) == lang).select(*key_cols), list(key_cols), "left_anti")
