"""Toxicity after noisy-channel deobfuscation.

Tokens that look disguised (letters swapped for digits or signs, letters spaced
out, letters repeated) become lattices of intended letters.  A Viterbi decoder
picks the reading that a character language model of the corpus finds most
likely, given what each disguise costs.  A text is scored on its words and on
the restored ones together: learned words and word beginnings vote, and a
calibrated logistic curve turns the votes into a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textstrata.llm.shared import crc_bucket, materialise, parts, utf8

# What a character may stand for besides itself.
STANDS_FOR = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
              "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "*": "aeiou", "#": "aeiou"}
SEPARATORS = ".-_*~ "
SWAP_COST, WILD_COST, REPEAT_COST, GAP_COST, CUT_COST = 0.7, 2.0, 0.3, 0.2, 0.2
#: Character classes of the language model: 0 other, 1-26 letters, 27 a byte outside ASCII, 28 a digit.
CLASSES = 29
CLASS_OF = np.zeros(256, np.int64)
CLASS_OF[ord("a"):ord("z") + 1] = CLASS_OF[ord("A"):ord("Z") + 1] = np.arange(1, 27)
CLASS_OF[128:] = 27
CLASS_OF[ord("0"):ord("9") + 1] = 28
ASCII_CLASS = {chr(i): int(CLASS_OF[i]) for i in range(128)}
#: A word that isn't in the vocabulary costs this much, and this much more for each letter.
STRANGE_COST, LETTER_COST = 9.0, 3.3
#: Longer words don't enter the vocabulary; no spaced-out word is expected to be one.
LONGEST_WORD = 40
RUN_BYTES = 1 << 20
#: Decoded tokens that a task remembers.
CACHED = 50_000
#: Distinct strings a task counts before it passes them on; one in so many rows is rare (``at_least``).
HELD, RARE = 1 << 18, 100_000

TRIM = ".,;:!?\"'()[]{}<>|&%#$*`~-_+="
#: A token of letters and signs that stand for letters, with one of each; three passes, so linear in its length.
DISGUISE, LETTER, SIGN = re.compile(r"[a-z0-9@$!|+(€*#]+"), re.compile(r"[a-z]"), re.compile(r"[0-9@$!|+(€*#]")
SPACED = re.compile(r"(?<![^\s\"'`(\[{<“”‘’«»„‚])(?:[a-z0-9@$!|+][ .\-_*~]{1,2}){3,}[a-z0-9@$!|+](?![^\s.,;:!?\"'`)\]}>“”‘’«»])")
#: Stands in every spaced-out run, and is looked for faster.
SINGLES = re.compile(r"[ .\-_*~][a-z0-9@$!|+][ .\-_*~]{1,2}[a-z0-9@$!|+][ .\-_*~]")
TRIPLE = re.compile(r"([a-z])\1\1")
PREFIXES = (4, 5, 6)


def character_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(key, n)``: counts of character trigrams over all whole texts; at most ``CLASSES ** 3`` rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES ** 3, np.int64)
        for b in batches:
            data = np.frombuffer(b"\n".join(t or b"" for t in utf8(b.column(0))), np.uint8)
            for a in range(0, len(data), RUN_BYTES):
                c = CLASS_OF[data[a:a + RUN_BYTES + 2]]
                total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES ** 3)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["key", "n"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "key int, n long").groupBy("key").agg(F.sum("n").alias("n"))


class CharacterModel:
    """Interpolated trigram model over character classes."""

    def __init__(self, counts: dict[int, int]):
        n = np.full(CLASSES ** 3, 0.0)
        for k, v in counts.items():
            n[k] = v
        tri = n.reshape(CLASSES, CLASSES, CLASSES)
        bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
        part = lambda x: (x + 1e-3) / (x + 1e-3).sum(axis=-1, keepdims=True)
        self.cost = -np.log(0.75 * part(tri) + 0.2 * part(bi)[None] + 0.05 * part(uni)[None, None])


def _class(c: str) -> int:
    return ASCII_CLASS.get(c, 27)


class Decoder:
    """Viterbi decoding of a disguised token.

    ``vocabulary`` has the number of texts of each plain word; ``words_of``
    cuts spaced-out runs by it, and without one by the character model.
    """

    def __init__(self, counts: dict[int, int], vocabulary: dict[str, int] | None = None):
        self.cost = CharacterModel(counts).cost.tolist()
        self.known: dict[tuple[str, bool], str] = {}
        self.learn_words(vocabulary or {})

    def learn_words(self, vocabulary: dict[str, int]) -> None:
        total = sum(vocabulary.values())
        self.words = {w: math.log(total / n) for w, n in vocabulary.items() if len(w) <= LONGEST_WORD}
        self.starts: set[str] = set()
        self.known.clear()

    def __getstate__(self):
        return {"cost": self.cost, "known": {}, "words": self.words, "starts": set()}  # tasks start with an empty memory

    def decode(self, token: str, cut: bool = False) -> str:
        """``read`` with a bounded memory of what was read before."""
        if (token, cut) not in self.known:
            if len(self.known) >= CACHED:
                self.known.clear()
            self.known[token, cut] = self.read(token, cut)
        return self.known[token, cut]

    def read(self, token: str, cut: bool = False) -> str:
        """The likeliest plain reading; the empty string stays empty.

        States are the last two characters of a reading.  At each character a
        reading may take what it stands for, or drop it as a separator or as a
        repetition of the character before.  With ``cut`` a separator may also
        be the boundary of two words, a blank.
        """
        states = {("\n", "\n"): (0.0, None)}
        table, of = self.cost, ASCII_CLASS.get
        for c in token:
            emit = [(c, 0.0)] if c not in SEPARATORS else [(" ", CUT_COST)] if cut else []
            swaps = STANDS_FOR.get(c, "")
            emit += [(s, WILD_COST if len(swaps) > 2 else SWAP_COST) for s in swaps]
            emit = [(e, price, _class(e)) for e, price in emit]
            letters, gap = {e for e, _, _ in emit}, c in SEPARATORS
            now: dict[tuple[str, str], tuple[float, tuple | None]] = {}
            for (a, b), (cost, path) in states.items():
                row = table[of(a, 27)][of(b, 27)]
                for e, price, cls in emit:
                    k, v = (b, e), cost + price + row[cls]
                    if k not in now or v < now[k][0]:
                        now[k] = (v, (e, path))
                drop = GAP_COST if gap else REPEAT_COST if b in letters else None
                if drop is not None:
                    k, v = (a, b), cost + drop
                    if k not in now or v < now[k][0]:
                        now[k] = (v, path)
            states = now
        end = min(states.items(), key=lambda s: (s[1][0] + self.cost[_class(s[0][0])][_class(s[0][1])][0], s[0]))
        out, path = [], end[1][1]
        while path is not None:
            out.append(path[0])
            path = path[1]
        return "".join(reversed(out))

    def words_of(self, token: str) -> str:
        """The words of a spaced-out run, with blanks between them; any separator may be a boundary."""
        if not self.words:
            return self.decode(token, cut=True)
        if (token, True) not in self.known:
            if len(self.known) >= CACHED:
                self.known.clear()
            self.known[token, True] = " ".join(self.cut_words([c for c in token if c not in SEPARATORS]))
        return self.known[token, True]

    def cut_words(self, letters: list[str]) -> list[str]:
        """The cheapest words that the letters may stand for.

        A word costs what its rarity says and what its disguise costs (swapped
        and repeated letters); letters of no known word form a strange one.
        """
        if not self.starts:
            self.starts = {w[:n] for w in self.words for n in range(1, len(w) + 1)}
        emit = [[(c, 0.0)] + [(s, SWAP_COST) for s in STANDS_FOR.get(c, "")] for c in letters]
        n = len(letters)
        best: list[tuple[float, int, str]] = [(0.0, 0, "")] + [(math.inf, 0, "")] * n
        strange = (math.inf, 0)  # cheapest strange word so far that is still open, and where it began
        open_words: dict[str, tuple[float, int]] = {}  # beginnings of known words likewise
        for i in range(n):
            strange = min(strange, (best[i][0] + STRANGE_COST, i))
            strange = (strange[0] + LETTER_COST, strange[1])
            best[i + 1] = (*strange, "")
            open_words[""] = (best[i][0], i)
            now: dict[str, tuple[float, int]] = {}
            for w, (cost, a) in open_words.items():
                for c, price in emit[i]:
                    if w + c in self.starts and (v := (cost + price, a)) < now.get(w + c, (math.inf, 0)):
                        now[w + c] = v
                    if w and w[-1] == c and (v := (cost + REPEAT_COST, a)) < now.get(w, (math.inf, 0)):
                        now[w] = v
            open_words = now
            for w, (cost, a) in now.items():
                if w in self.words and cost + self.words[w] < best[i + 1][0]:
                    best[i + 1] = (cost + self.words[w], a, w)
        out, j = [], n
        while j > 0:
            out.append(best[j][2] or "".join(letters[best[j][1]:j]))
            j = best[j][1]
        return out[::-1]


def has_triple(text: str) -> bool:
    """Whether ``TRIPLE`` is found; neighbouring bytes are compared all at once."""
    c = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    same = c[1:] == c[:-1]
    at = np.flatnonzero(same[1:] & same[:-1])
    return bool(((c[at] >= ord("a")) & (c[at] <= ord("z"))).any())


def disguised(text: str, words: set[str]) -> set[str]:
    """Tokens of a lower-case text that look disguised."""
    found = {m.group(0) for m in SPACED.finditer(text)} if SINGLES.search(text) else set()
    for w in words:
        if not w.isalpha() and not (w := w.strip(".,;:?\"'()[]{}<>&%`~-_=")).isalpha() and SIGN.search(w):
            for form in {w, w.strip(TRIM)}:
                if not form.isalpha() and DISGUISE.fullmatch(form) and LETTER.search(form) and SIGN.search(form):
                    found.add(form)
    if has_triple(text):  # the words stand in the text
        found |= {w.strip(TRIM) for w in words if TRIPLE.search(w)}
    return found


def tokens(text: bytes | None, decoder: Decoder) -> tuple[list[str], set[str], set[str]]:
    """The lower-case words of a whole text in order, the restored ones, and the distinct words."""
    lower = (text or b"").decode("utf-8", "replace").lower()
    words = lower.split()
    distinct = set(words)
    found = disguised(lower, distinct)
    # a spaced-out run is read both as one word and as words
    restored = {decoder.decode(t) for t in found} | {decoder.words_of(t) for t in found if SPACED.fullmatch(t)}
    return words, {p.strip(TRIM) for r in restored for p in r.split()} - {""}, distinct


def at_least(least: int, rows: int) -> int:
    """``least`` rows, or one in ``RARE`` of many: what is rarer teaches nothing, so a model's size doesn't grow with the rows."""
    return max(least, -(-rows // RARE))


def _counted(names: list[str], seen: Iterator[set[str]]) -> Iterator[pa.RecordBatch]:
    """Number of sets each string is in, passed on whenever ``HELD`` strings are held."""
    total: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=names)
        total.clear()
        return out

    for strings in seen:
        total.update(strings)
        if len(total) >= HELD:
            yield flush()
    yield flush()


def vocabulary_of(train: DataFrame, least_texts: int = 2) -> dict[str, int]:
    """Number of texts of each plain word in ``least_texts`` or more of them (``at_least``); all texts are counted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = ({w.strip(TRIM) for w in (t or b"").decode("utf-8", "replace").lower().split()} for b in parts(batches) for t in utf8(b.column(0)))
        yield from _counted(["w", "n"], ({w for w in words if w.isalpha() and len(w) <= LONGEST_WORD} for words in every))

    counts = train.select("text").mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    kept = counts.where(F.col("n") >= at_least(least_texts, train.count())).toArrow()  # a row object per word would take many times its bytes
    return dict(zip(kept.column("w").to_pylist(), kept.column("n").to_pylist()))


def features_of(word: str) -> list[str]:
    return [word] + [word[:n] + "*" for n in PREFIXES if len(word) > n]


class Lexicon:
    """Weights of words and of word beginnings (``abcd*``)."""

    def __init__(self, weights: dict[str, float]):
        self.words = {k: v for k, v in weights.items() if not k.endswith("*")}
        self.starts = [(n, {k[:-1]: v for k, v in weights.items() if k.endswith("*") and len(k) == n + 1}) for n in PREFIXES]
        self.starts = [(n, d) for n, d in self.starts if d]
        self.known: dict[str, float] = {}

    def votes(self, words: set[str]) -> list[float]:
        """The weight of each trimmed word that has one, largest first; a trimmed word has one vote."""
        trimmed = {w.strip(TRIM) for w in words}
        voting = trimmed & self.words.keys()
        for n, starts in self.starts:  # most words have no weight and go no further
            voting |= {w for w in trimmed if w[:n] in starts}
        out = []
        for w in voting:
            best = self.known.get(w)
            if best is None:
                best = self.words.get(w, 0.0)
                for n, starts in self.starts:
                    if (v := starts.get(w[:n], 0.0)) > best and len(w) > n:
                        best = v
                if len(w) <= LONGEST_WORD:
                    if len(self.known) >= CACHED:
                        self.known.clear()
                    self.known[w] = best
            if best > 0:
                out.append(best)
        return sorted(out, reverse=True)


def evidence(text: bytes | None, decoder: Decoder, lexicon: Lexicon) -> list[float]:
    """Largest vote, second largest, log of the number of votes, log of the number of words."""
    words, restored, distinct = tokens(text, decoder)
    votes = lexicon.votes(distinct | restored)
    return [votes[0] if votes else 0.0, votes[1] if len(votes) > 1 else 0.0, math.log1p(len(votes)), math.log1p(len(words)) / 10]


def fit_logistic(rows: DataFrame, ridge: float = 1.0) -> np.ndarray:
    """Weights and intercept (last) from all ``(x, label)`` rows by Newton steps.

    Each step is one pass whose slope and curvature are summed in the tasks, a
    row of sums per task; the sums don't depend on the tasks' order.
    """
    w = None
    for _ in range(25):
        def sums(batches: Iterator[pa.RecordBatch], w=w) -> Iterator[pa.RecordBatch]:
            found = 0.0
            for b in batches:
                if b.num_rows:
                    z = np.array(b.column(0).to_pylist())
                    z, y = np.hstack([z, np.ones((len(z), 1))]), b.column(1).to_numpy()
                    p = 1 / (1 + np.exp(-np.clip(z @ (np.zeros(z.shape[1]) if w is None else w), -30, 30)))
                    found = found + np.concatenate([z.T @ (y - p), ((z * (p * (1 - p))[:, None]).T @ z).ravel()])
            if np.ndim(found):
                yield pa.RecordBatch.from_arrays([pa.array([found], pa.list_(pa.float64()))], names=["s"])

        flat = np.array([math.fsum(v) for v in zip(*(r.s for r in rows.select("x", "label").mapInArrow(sums, "s array<double>").collect()))])
        n = int((math.isqrt(4 * len(flat) + 1) - 1) // 2)
        w = np.zeros(n) if w is None else w
        penalty = np.full(n, ridge)
        penalty[-1] = 1e-3
        step = np.linalg.solve(flat[n:].reshape(n, n) + np.diag(penalty), flat[:n] - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn_lexicon(train: DataFrame, decoder: Decoder, least_contexts: int = 3, least_weight: float = 1.0) -> Lexicon:
    """Log-odds weights from ``(text binary, label)`` rows.

    In label 1 a feature counts once per distinct word before it, so copies of
    one document don't make its words look toxic; in label 0 it counts once
    per document.
    """
    shared = train.sparkSession.sparkContext.broadcast(decoder)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = shared.value
        for b in parts(batches):
            pairs = set()
            for t in utf8(b.column(0)):
                words, restored, _ = tokens(t, decoder)
                words = [w.strip(TRIM) for w in words]
                pairs |= {(f, prev) for prev, w in zip([""] + words, words) if w for f in features_of(w)}
                pairs |= {(f, w) for w in restored for f in features_of(w)}
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in pairs], pa.string()), pa.array([p for _, p in pairs], pa.string())], names=["f", "prev"])

    share = {r.label: r["count"] for r in train.groupBy("label").count().collect()}
    toxic = train.where("label = 1").select("text").mapInArrow(seen, "f string, prev string").distinct().groupBy("f").agg(F.count("*").alias("n1"))
    toxic = toxic.where(F.col("n1") >= at_least(least_contexts, share.get(1, 0)))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (tokens(t, shared.value) for b in parts(batches) for t in utf8(b.column(0)))
        yield from _counted(["f", "n"], ({f for w in {w.strip(TRIM) for w in distinct} | restored for f in features_of(w)} for _, restored, distinct in every))

    plain = train.where("label = 0").select("text").mapInArrow(clean, "f string, n long").groupBy("f").agg(F.sum("n").alias("n0"))
    base = (share.get(1, 0) + 1) / (sum(share.values()) + 2)
    odds = F.log((F.col("n1") + base) / (F.coalesce("n0", F.lit(0)) + 1 - base)) - math.log(base / (1 - base))
    # what has a weight is all that reaches the driver
    kept = toxic.join(plain, "f", "left").select("f", odds.alias("w")).where(F.col("w") >= least_weight).toArrow()
    return Lexicon(dict(zip(kept.column("f").to_pylist(), kept.column("w").to_pylist())))


class Scorer:
    """A fitted scorer: decoder, lexicon and curve, or one constant share."""

    def __init__(self, decoder: Decoder, lexicon: Lexicon, curve: np.ndarray | None, constant: float = 0.5):
        self.decoder, self.lexicon, self.curve, self.constant = decoder, lexicon, curve, constant

    def __call__(self, texts: list[bytes | None]) -> np.ndarray:
        if self.curve is None:
            return np.full(len(texts), self.constant)
        x = np.array([evidence(t, self.decoder, self.lexicon) + [1.0] for t in texts]).reshape(-1, len(self.curve))
        return 1 / (1 + np.exp(-np.clip(x @ self.curve, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Scorer:
    """A scorer from ``docs`` and ``labels`` (``id, label``), the labels to learn from.

    The language model counts all texts.  The classifier is fitted on all
    labelled rows; two thirds teach the lexicon, a third the curve.  Labels that are null or neither 0
    nor 1, and ids without a document, are left out.  Without labels of both
    kinds every score is the share of label 1 among them (0.5 without any).
    """
    decoder = Decoder({r.key: r.n for r in character_counts(docs, text_col).collect()})
    known = labels.where("label in (0, 1) and id is not null").select(F.col("id").cast("long").alias("label_id"), F.col("label").cast("int").alias("label")).distinct()
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # rows that repeat an id count once, with the smallest text
    # texts are shuffled by id once for join and grouping, at every size
    train = materialise(src.join(known.hint("merge"), F.col("id") == F.col("label_id")).groupBy("id", "label").agg(F.min("text").alias("text"))
                        .select("text", "label", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)).alias("fold")), "toxicity-training")
    decoder.learn_words(vocabulary_of(train))
    lexicon = learn_lexicon(train.where("fold < 2"), decoder)

    shared = docs.sparkSession.sparkContext.broadcast((decoder, lexicon))

    def evidences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            x = [evidence(t, *shared.value) for t in utf8(b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], names=["x", "label"])

    held = materialise(train.where("fold = 2").select("text", "label").mapInArrow(evidences, "x array<double>, label int"), "toxicity-evidence")
    if held.agg(F.count_distinct("label")).first()[0] == 2:
        return Scorer(decoder, lexicon, fit_logistic(held))
    share = train.agg(F.avg("label")).first()[0]
    return Scorer(decoder, lexicon, None, 0.5 if share is None else share)


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)`` per input row: the probability of label 1; row-local.

    Null and empty texts are scored like any other (they have no votes);
    repeated rows each get a row; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value
        for b in parts(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scorer(utf8(b.column(1))), pa.float64())], names=["id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, score double")


def drop_toxic(docs: DataFrame, scorer: Scorer, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns; row-local."""
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value
        for b in parts(batches):
            yield b.filter(pa.array(scorer(utf8(b.column(at))) < threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def training_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """``(id, label)`` without the held-out rows (crc32 of the id's text mod 4 is 2)."""
    return labels.where(crc_bucket(F.col(id_col), 4) != 2).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
