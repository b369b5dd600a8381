"""Text rules as JVM-side column expressions (P3, P4, W1 predicates, tokens)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
# The multi-interval rule of the reference: a description that starts with two
# "van .. tot .." ranges, or with a depth range in metres, describes several
# intervals.  It is matched from the start of the text, case-insensitively.
MULTI_INTERVAL_PATTERN = r"van [0-9]+ tot [0-9]+ .* van .* tot .*|(^|KERNSTROOK [0-9]*|Kern)[ ]?[0-9\.\,]+[ m]?([- ]+|tot )[0-9\.\,]+[ ]?m"
# The marker of a row that repeats the description of the row above it.
IDEM_MARKER = "idem"

# Normalisation keeps letters, digits, "_" and white space (Python's \w and \s,
# which count U+001C..U+001F as space) and deletes everything else.
_NOT_WORD_OR_SPACE = r"(?U)[^\p{L}\p{N}_\s\x{1c}-\x{1f}]"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise(text: str | Column) -> Column:
    """Lower-case, then delete every character that is not a word character
    or white space."""
    return F.regexp_replace(F.lower(_c(text)), _NOT_WORD_OR_SPACE, "")


def is_multi_interval(text: str | Column, pattern: str = MULTI_INTERVAL_PATTERN) -> Column:
    """P4 predicate: the pattern matches at the start of the text (any case).

    ``(?d)`` makes ``.`` stop at a line feed only; null text is "not multi-interval".
    """
    return F.coalesce(_c(text).rlike(f"(?idu)^(?:{pattern})"), F.lit(False))


def starts_with_idem(text: str | Column, marker: str = IDEM_MARKER) -> Column:
    """W1 predicate: the text starts with the marker in any case (null: no)."""
    return F.coalesce(F.startswith(F.lower(_c(text)), F.lit(marker)), F.lit(False))


def after_marker(text: str | Column, marker: str = IDEM_MARKER, ignore_case: bool = False) -> Column:
    """What stands after the first occurrence of the marker ('' when none).

    The reference looks for the marker in lower case only (``ignore_case=False``).
    """
    t = _c(text)
    hay = F.lower(t) if ignore_case else t
    pos = F.instr(hay, marker)
    rest = t.substr(pos + F.lit(len(marker)), F.lit(2 ** 31 - 1))
    return F.when(pos > 0, rest).otherwise(F.lit(""))

