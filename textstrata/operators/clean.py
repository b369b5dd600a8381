"""Selection, filling and cleaning of descriptions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textstrata.functions.arrays import let
from textstrata.functions.text import is_multi_interval, normalise
from textstrata.operators.labels import NONE_LABEL
from textstrata.operators.order import CHUNK_WIDTH, expand_idem

# Fixed values (our own, not the reference's): short function words that occur
# in one language only; a text is scored by how many of its words each list has.
DEFAULT_LANGUAGE_WORDS: dict[str, tuple[str, ...]] = {
    "de": ("der", "die", "und", "das", "nicht", "ein", "eine", "mit", "ist", "auf", "zu", "ich"),
    "en": ("the", "and", "of", "with", "is", "are", "this", "for", "by", "from"),
    "es": ("el", "los", "las", "y", "con", "por", "para", "del", "como", "pero"),
    "fr": ("le", "les", "des", "une", "et", "qui", "du", "dans", "pour", "avec", "est", "sur"),
    "nl": ("het", "een", "van", "niet", "zijn", "op", "ook", "maar", "bij", "naar"),
}


def apply_text_hook(df: DataFrame, text_col: str,
                    hook: Callable[[Column], Column] | Callable[[str], str],
                    on_column: bool = False) -> DataFrame:
    """Apply a caller's function to the text column and keep the result.

    By default ``hook`` is a ``str -> str`` Python function (the reference's
    form); it runs as an Arrow-batched pandas UDF and null stays null.  With
    ``on_column=True`` it is a ``Column -> Column`` function and stays in the JVM.
    """
    if on_column:
        return df.withColumn(text_col, hook(F.col(text_col)))

    @F.pandas_udf(StringType())
    def _apply(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else hook(v))

    return df.withColumn(text_col, _apply(F.col(text_col)))


def prepare(df: DataFrame, input_cols: Sequence[str], output_cols: Sequence[str],
            text_col: str | None = None, fill_value: str = NONE_LABEL,
            process_text: Callable | None = None, process_on_column: bool = False) -> DataFrame:
    """P1 (+P2): keep the input and output columns and fill missing values.

    Output (target) columns are labels and become strings, so they are filled
    too; string input columns (the text) are filled; other inputs keep their type.
    """
    out = []
    for c in input_cols:
        is_str = isinstance(df.schema[c].dataType, StringType)
        out.append(F.coalesce(F.col(c), F.lit(fill_value)).alias(c) if is_str else F.col(c))
    for c in output_cols:
        out.append(F.coalesce(F.col(c).cast("string"), F.lit(fill_value)).alias(c))
    res = df.select(*out)
    if process_text is not None:
        res = apply_text_hook(res, text_col or input_cols[0], process_text, process_on_column)
    return res


def normalise_text(df: DataFrame, text_col: str, out_col: str | None = None) -> DataFrame:
    """P3 as a table operator."""
    return df.withColumn(out_col or text_col, normalise(text_col))


def drop_multi_interval(df: DataFrame, text_col: str) -> DataFrame:
    """Drop descriptions that describe several intervals (null text stays)."""
    return df.where(~is_multi_interval(text_col))


def detect_language(text: str | Column,
                    word_table: Mapping[str, Sequence[str]] = DEFAULT_LANGUAGE_WORDS) -> Column:
    """P5(b): the language whose word list has the most words of the text.

    Row-local, so no explode and no shuffle: the text's words are looked up
    in a literal word -> language map, the hits kept, and counted per
    language.  Null when no word is known or the best count is shared (such
    rows are kept by ``drop_language``).
    """
    langs = sorted(word_table)
    pairs = []
    for lang in langs:
        for w in word_table[lang]:
            pairs += [F.lit(w), F.lit(lang)]
    lookup = F.create_map(*pairs)
    names = F.array(*[F.lit(x) for x in langs])
    # Empty pieces of the split match no word, so the raw split is looked up.
    tokens = F.split(F.lower(F.col(text) if isinstance(text, str) else text), r"[^\p{L}]+")
    hits = F.filter(F.transform(tokens, lambda w: F.try_element_at(lookup, w)),
                    lambda h: h.isNotNull())
    return let(hits, lambda hs: let(
        F.transform(names, lambda lang: F.size(F.filter(hs, lambda h: h == lang))), lambda counts: let(
            F.array_max(counts), lambda best: F.when(
                (best > 0) & (F.size(F.filter(counts, lambda c: c == best)) == 1),
                names[F.array_position(counts, best) - 1]))))


def drop_language(df: DataFrame, lang: str = "fr", lang_col: str | None = None,
                  text_col: str | None = None,
                  word_table: Mapping[str, Sequence[str]] = DEFAULT_LANGUAGE_WORDS,
                  detected_col: str | None = None) -> DataFrame:
    """P5: drop rows in ``lang``, by a language column (a) or by word scores (b).

    ``detected_col`` keeps variant (b)'s detected language as a column; it is
    produced by a one-element generator so that the filter above it cannot be
    pushed down with a second copy of the detection.
    """
    if lang_col is not None:
        return df.where(~F.coalesce(F.col(lang_col) == F.lit(lang), F.lit(False)))
    if text_col is None:
        raise ValueError("give lang_col or text_col")
    detected = detect_language(text_col, word_table)
    if detected_col is None:
        return df.where(~F.coalesce(detected == F.lit(lang), F.lit(False)))
    tagged = df.select("*", F.explode(F.array(detected)).alias(detected_col))
    return tagged.where(~F.coalesce(F.col(detected_col) == F.lit(lang), F.lit(False)))


def clean_chain(df: DataFrame, site_cols: Sequence[str], order_col: str, text_col: str,
                lang: str = "fr", lang_col: str | None = None,
                word_table: Mapping[str, Sequence[str]] = DEFAULT_LANGUAGE_WORDS,
                rest_match: str = "exact", chunk_width: int = CHUNK_WIDTH) -> DataFrame:
    """Idem expansion, then the language filter, then the interval filter.

    The order matters: idem rows are expanded before their base rows can be
    dropped.
    """
    return (df.transform(lambda d: expand_idem(d, site_cols, order_col, text_col,
                                               rest_match=rest_match, chunk_width=chunk_width))
            .transform(lambda d: drop_language(d, lang, lang_col=lang_col,
                                               text_col=None if lang_col else text_col,
                                               word_table=word_table))
            .transform(lambda d: drop_multi_interval(d, text_col)))


def drop_columns(df: DataFrame, *cols: str) -> DataFrame:
    """P11."""
    return df.drop(*cols)
