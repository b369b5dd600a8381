"""Secrets: fixed patterns, and password guess cost in credential contexts.

Base spans come from three patterns.  The method adds spans of kind ``guess``:
the value of a credential-like assignment is cut into words, dates, repeats,
keyboard walks and brute-force spans so that the product of the guesses is
smallest (a dynamic program over the value); a value whose cheapest reading
still needs many guesses is a secret, while ``password: changeme`` isn't.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textstrata.llm.shared import materialise, parts

KINDS = ("assign", "access", "hex", "guess")

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
#: Runs are maximal, so a minimum length in the pattern drops the same runs as a check after it.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Wider contexts than the base pattern: more names, and values of printable ASCII.
CONTEXT = re.compile(
    r"""(?i:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|credentials?|auth)["']?[\x20\t]*(?:=>|:=|[:=])[\x20\t]*(?:"([^"\n]{4,})"|'([^'\n]{4,})'|([^\s"',;]{4,}))""",
    re.A)

# Words that guessers try first, most frequent first.
COMMON_WORDS = (
    "password pass admin user login welcome letmein qwerty monkey dragon master hello secret token key test demo "
    "example sample default changeme change root guest access system server service database data value string "
    "config account client private public super summer winter spring autumn love money football baseball shadow "
    "sunshine princess michael jordan hunter killer batman trustno magic office work home house computer internet "
    "google apple orange banana cookie coffee chocolate flower silver golden diamond tiger lion eagle falcon star "
    "moon night light black white green blue purple yellow happy lucky angel devil power forever friend family "
    "mother father sister brother number first second monday friday january march april june july august december "
    "none null true false your my the and for with not here insert placeholder dummy fake redacted hidden"
).split()
RANK = {w: i + 1 for i, w in enumerate(COMMON_WORDS)}
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
LEET = str.maketrans("4310$5@7!", "aeiossati")
DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d)")
NEIGHBOUR = {row[i + s:i + s + 1] + c for row in KEY_ROWS for i, c in enumerate(row) for s in (-1, 1) if 0 <= i + s < len(row)}


def _alphabet(value: str) -> int:
    size = 0
    for pattern, n in (("[a-z]", 26), ("[A-Z]", 26), ("[0-9]", 10), (r"[^A-Za-z0-9]", 33)):
        size += n if re.search(pattern, value) else 0
    return 16 if re.fullmatch("[0-9a-f]+|[0-9A-F]+", value) else max(size, 2)


#: Bits to guess how often a block repeats, or how far a keyboard walk goes.
LENGTH_BITS = 5.0
#: Longest block whose repetitions are one segment.
LONGEST_BLOCK = 8
#: Characters that join words, and the bits to guess one of them.
JOINTS, JOINT_BITS = "-_./ ", 3.0
#: Costs of values up to this length are remembered; longer ones are worked out each time.
REMEMBERED = 256


class Guesser:
    """Costs of values under the fixed words and, behind them, ``words`` of the corpus by frequency."""

    def __init__(self, words: Sequence[str] = ()):
        more = [w for w in dict.fromkeys(words) if w not in RANK]
        self.rank = RANK | {w: len(RANK) + 1 + i for i, w in enumerate(more)}
        self.longest = max(map(len, self.rank))
        self._remembered = lru_cache(maxsize=20_000)(self._cheapest)

    def cost(self, value: str) -> float:
        """log2 of the guesses of the cheapest segmentation of a whole ``value``.

        Segments are words (capital letters and leet cost extra), dates, blocks that
        repeat, keyboard walks, single joints between words, and brute force at log2
        of the alphabet that the value uses per character.  Every segment but the
        last two also costs one bit for the choice of its kind.  The program is exact:
        it tries every start of every segment in time linear in the value.
        """
        return self._remembered(value) if len(value) <= REMEMBERED else self._cheapest(value)

    def word_cost(self, piece: str) -> float:
        """Bits of ``piece`` as one word; infinite if it isn't one."""
        lower, leet = piece.lower(), 0.0
        rank = self.rank.get(lower)
        if rank is None:
            rank, leet = self.rank.get(lower.translate(LEET)), 2.0
        if rank is None:
            return math.inf
        case = 0.0 if piece == lower else 1.0 if piece[1:] == lower[1:] or piece == piece.upper() else len(piece) / 2
        return math.log2(rank + 1) + leet + case + 1

    def _cheapest(self, value: str) -> float:
        n, lower = len(value), value.lower()
        if len(lower) != n:  # a few letters have longer lower cases
            lower = value
        plain, brute, known = lower.translate(LEET), math.log2(_alphabet(value)), self.rank
        best = [0.0] + [math.inf] * n
        again = [[math.inf] * p for p in range(LONGEST_BLOCK + 1)]  # readings that end in a repetition, a block back
        run = [0] * (LONGEST_BLOCK + 1)  # characters up to i that equal the one a block before
        walk = math.inf  # cheapest reading that ends in a keyboard walk
        dates: dict[int, list[int]] = {}
        for m in range(n - 3):
            for size in (4, 8, 10):
                if m + size <= n and DATE.fullmatch(value, m, m + size):
                    dates.setdefault(m + size, []).append(m)
        for i in range(1, n + 1):
            cost = best[i - 1] + min(brute, JOINT_BITS if value[i - 1] in JOINTS else math.inf)
            for size in range(2, min(i, self.longest) + 1):
                if lower[i - size:i] in known or plain[i - size:i] in known:
                    cost = min(cost, best[i - size] + self.word_cost(value[i - size:i]))
            for a in dates.get(i, ()):
                cost = min(cost, best[a] + date_cost(i - a))
            for p in range(1, min(LONGEST_BLOCK, i - 1) + 1):
                run[p] = run[p] + 1 if lower[i - 1] == lower[i - 1 - p] else 0
                if run[p] >= p:  # the last block equals the one before: it opens a repetition or goes on with one
                    again[p][i % p] = min(again[p][i % p], best[i - 2 * p] + p * brute + LENGTH_BITS + 1)
                    cost = min(cost, again[p][i % p])
                else:
                    again[p][i % p] = math.inf
            if i > 1 and lower[i - 2:i] in NEIGHBOUR:
                walk = min(walk, best[i - 2] + WALK_BITS)
                cost = min(cost, walk)
            else:
                walk = math.inf
            best[i] = cost
        return best[n]


#: A walk's first key, direction, length and kind.
WALK_BITS = math.log2(47 * 2) + LENGTH_BITS + 1


def date_cost(size: int) -> float:
    """Bits of a year (four characters) or a date with or without separators."""
    return (math.log2(200) if size == 4 else math.log2(200 * 372) + (1 if size > 8 else 0)) + 1


#: The fixed words alone.
PLAIN = Guesser()


def guess_cost(value: str) -> float:
    """``Guesser.cost`` with the fixed words alone."""
    return PLAIN.cost(value)


def corpus_words(docs: DataFrame, text_col: str = "text", limit: int = 20_000, least: int = 5) -> list[str]:
    """The words of 4 to 16 letters a-z in most documents, most frequent first: at most ``limit``.

    Counted over all whole texts, combined map-side.  Values of credential contexts
    are cut out first, so that a secret doesn't become a word by being copied.
    Words of ``least`` or more documents fall into levels of frequency, eight to a
    doubling; the highest levels that hold at most ``limit`` words together are
    taken whole, so no more than ``limit`` short rows reach the driver.
    """
    prose = F.regexp_replace(F.lower(F.col(text_col).cast("string")), CONTEXT.pattern, " ")
    words = F.array_distinct(F.filter(F.split(prose, "[^a-z]+"), lambda w: F.length(w).between(4, 16)))
    counts = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    counts = materialise(counts.withColumn("level", F.floor(F.log2("n") * 8).cast("int")), "corpus-words")
    room, lowest = limit, None
    for r in sorted(counts.groupBy("level").agg(F.count("*").alias("words")).collect(), key=lambda r: -r.level):  # some hundred levels
        room -= r.words
        if room < 0:
            break
        lowest = r.level
    if lowest is None:
        return []
    rows = counts.where(F.col("level") >= lowest).collect()
    return [r.word for r in sorted(rows, key=lambda r: (-r.n, r.word))]


#: No credential name with its sign is longer.
LONGEST_NAME = 16


def _values(text: str, covered, min_bits: float, cost) -> Iterator[tuple[int, int]]:
    """Spans of values that are hard to guess; ``covered(a, e)`` says that a base span has them.

    A value that isn't one is searched for names of its own, so that in
    ``credentials: password: x`` the last name has its value costed too.
    """
    m, done = CONTEXT.search(text), 0
    while m:
        g = m.lastindex
        a, e = m.span(g)
        at = a
        if e <= done or covered(a, e):
            at = max(a, e - LONGEST_NAME)
        elif cost(m[g]) >= min_bits:
            yield a, e
            at, done = max(a, e - LONGEST_NAME), e
        # bare values inside a span end where it ends at the latest; only a name at its very end can have a value beyond
        m = CONTEXT.search(text, at)


def find_spans(text: str | None, min_bits: float = 40.0, cost=guess_cost) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` in code points, ordered; ``kind`` indexes ``KINDS``.

    An ``assign`` span is the whole match, name and value.  A ``guess`` span is
    the value alone; it is added where guessing takes at least ``2**min_bits``
    tries and no base span covers the value.  Names inside a value that isn't
    a span have their own values costed.
    """
    if not text:
        return []
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base = sorted(spans)
    starts, reach = [a for a, _, _ in base], list(accumulate((e for _, _, e in base), max))
    covered = lambda a, e: (before := bisect_right(starts, a)) > 0 and reach[before - 1] >= e
    spans += [(a, 3, e) for a, e in _values(text, covered, min_bits, cost)]
    return sorted(spans)


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{e}" for a, k, e in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bits: float = 40.0) -> DataFrame:
    """One row per input row: ``id``, counts per base kind, ``base_sha256``, ``spans``, ``n_guess``.

    Whole texts are searched row by row, once the words of the corpus are counted
    (``corpus_words``).  Null and empty texts have no spans; repeated rows each get
    a row; an empty table gives an empty result.
    """
    words = corpus_words(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost = Guesser(words).cost
        for b in parts(batches):
            found = [find_spans(t, min_bits, cost) for t in b.column(1).to_pylist()]
            count = lambda kind: pa.array([sum(k == kind for _, k, _ in s) for s in found], pa.int64())
            digest = [hashlib.sha256(_joined(x for x in s if x[1] < 3).encode()).hexdigest() for s in found]
            yield pa.RecordBatch.from_arrays([b.column(0), count(0), count(1), count(2), count(3), pa.array(digest, pa.string()), pa.array(map(_joined, found), pa.string())],
                                             names=["id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string")


def redact_text(text: str | None, min_bits: float = 40.0, mark: str = "[SECRET]", cost=guess_cost) -> str | None:
    """The text with every span replaced by ``mark``; overlapping spans become one."""
    out, at = [], 0
    for a, _, e in find_spans(text, min_bits, cost):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, e)
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame, text_col: str = "text", min_bits: float = 40.0) -> DataFrame:
    """``docs`` with the secrets of ``text_col`` replaced; all columns and rows stay.

    Words are learned from ``docs`` as in ``scan``.  Null and empty texts stay as
    they are; an empty table stays empty.
    """
    words = corpus_words(docs, text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost = Guesser(words).cost
        for b in parts(batches):
            cols = list(b.columns)
            cols[at] = pa.array([redact_text(t, min_bits, cost=cost) for t in cols[at].to_pylist()], b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
