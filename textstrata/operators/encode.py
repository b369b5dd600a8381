"""Text encoding and token masking.

Content ids come from one of three places: a table of word pieces
(``piece_ids``: distinct words are cut once, by joins), a hash of each word
(``word_ids``), or a tokenizer file (``token_ids``), the one form that runs
Python: ``mapInArrow`` over batches, with the file shipped with
``SparkContext.addFile`` and loaded once per task.  Truncation, special tokens,
padding, masks and masking are array expressions in the JVM for all three.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textstrata.functions.arrays import let
from textstrata.session import written

#: Vocabulary file used when none is given; ``TEXTSTRATA_VOCABULARY`` names another.
DEFAULT_VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"

MAX_LENGTH = 512
#: Hashed word ids lie below this, the start and end ids follow.
WORD_IDS = 49_406
MLM_PROBABILITY = 0.15
#: Rules by which a tokenizer cuts a text into pieces without blanks, none of which depends on what stands beyond a blank.
BLANK_SPLITS = (r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",)
#: About so many bytes of words and ids a task remembers.
HELD_BYTES = 64 << 20
IGNORE_INDEX = -100
#: Pieces are looked up by so many first characters.
HEAD = 3
#: Pieces cut from each word one after the other.
CUTS = 6


def default_vocabulary() -> str:
    """The public lower-case word BPE file (49,408 ids; start 49406, end 49407)."""
    return os.environ.get("TEXTSTRATA_VOCABULARY", DEFAULT_VOCABULARY)


def token_ids(df: DataFrame, text_col: str, key_cols: Sequence[str], vocabulary: str | None = None,
              out_col: str = "ids", slice_rows: int = 256, max_ids: int | None = None) -> DataFrame:
    """Content token ids of each whole text (no special tokens).

    Returns ``key_cols + [out_col: array<int>]``; null text gives an empty array.
    Whole texts are encoded; ``max_ids`` passes on no more of a text's ids than a
    later truncation keeps.  Where the tokenizer's own rules say that no piece
    reaches over a blank (``BLANK_SPLITS``), a task encodes each distinct word
    once and puts texts together from the words' ids, with a bounded memory.
    Tasks are the parallel units: the tokenizer starts no threads of its own.
    """
    vocab = vocabulary or default_vocabulary()
    df.sparkSession.sparkContext.addFile(vocab)
    name, blank_splits, held_bytes = os.path.basename(vocab), BLANK_SPLITS, HELD_BYTES
    keys = list(key_cols)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields]
                       + [f"`{out_col}` array<int>"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Self-contained (imports inside): executors need no copy of this package.
        import json

        import numpy as np
        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import SparkFiles as _files
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(_files.get(name))  # once per task, then reused for all its batches
        with open(_files.get(name), encoding="utf-8") as f:
            rules = json.load(f)
        steps = (rules.get("normalizer") or {}).get("normalizers", [])
        cuts = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
        by_word = (all(n in ({"type": "NFC"}, {"type": "Lowercase"}) or (n["type"], n.get("pattern"), n.get("content")) == ("Replace", {"Regex": r"\s+"}, " ") for n in steps)
                   and len(cuts) == 2 and cuts[0]["type"] == "Split" and cuts[0]["pattern"].get("Regex") in blank_splits
                   and (cuts[0]["behavior"], cuts[0]["invert"]) == ("Removed", True)
                   and cuts[1]["type"] == "ByteLevel" and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"]
                   and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["content"].split() != [t["content"]] for t in rules["added_tokens"])
                   and not rules.get("truncation") and not rules.get("padding") and not rules["model"].get("dropout"))
        known: dict[bytes, bytes] = {}  # the ids of a word as 32-bit numbers
        held = 0

        def whole(texts: list[bytes]) -> Iterator[bytes]:
            for text in texts:
                yield np.array(tok.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, np.int32).tobytes()

        def learn(new: list[bytes]) -> None:
            nonlocal held
            plain = [w.decode("utf-8", "replace") for w in new]
            begins = np.cumsum([0, *(len(w) + 1 for w in plain)])
            e = tok.encode(" ".join(plain), add_special_tokens=False)
            ids = np.array(e.ids, np.int32).tobytes()
            of = np.searchsorted(begins, np.array([o[0] for o in e.offsets], np.int64), "right") - 1
            ends = 4 * np.cumsum(np.bincount(of, minlength=len(new)))
            start = 0
            for w, end in zip(new, ends.tolist()):
                known[w] = ids[start:end]
                held += len(w) + end - start + 160  # what the two objects and their entry take besides
                start = end

        def from_words(texts: list[bytes]) -> Iterator[bytes]:
            nonlocal held
            for at in range(0, len(texts), 16):
                some = [text.split() for text in texts[at:at + 16]]  # at ASCII blanks, which are blanks to the tokenizer as well
                if held > held_bytes:
                    known.clear()
                    held = 0
                new = list(set().union(*some).difference(known))
                for k in range(0, len(new), 512):
                    learn(new[k:k + 512])
                for words in some:
                    yield b"".join([known[w] for w in words])

        for b in batches:
            for at in range(0, b.num_rows, slice_rows):
                part = b.slice(at, slice_rows)
                texts = [t or b"" for t in part.column(len(keys)).cast(pa.large_binary()).to_pylist()]
                rows = [ids if max_ids is None else ids[:4 * max_ids] for ids in (from_words if by_word else whole)(texts)]
                offsets = np.cumsum([0, *(len(ids) // 4 for ids in rows)]).astype(np.int32)
                out = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), np.int32)))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keys))), out], names=[*keys, out_col])

    return df.select(*keys, F.col(text_col).cast("string").alias("_text")).mapInArrow(encode, schema)


def _framed(ids: Column, max_length: int, start_id: int, end_id: int) -> Column:
    """Truncate to ``max_length - 2`` content ids and add the start/end ids."""
    return F.concat(F.array(F.lit(start_id)), F.slice(ids, 1, max_length - 2), F.array(F.lit(end_id)))


def word_ids(df: DataFrame, text_col: str, key_cols: Sequence[str], vocab_size: int,
             out_col: str = "ids", max_words: int | None = None) -> DataFrame:
    """``token_ids`` without a vocabulary file: each word of the whole text gets the
    number made of the first 32 bits of its md5, modulo ``vocab_size``.  JVM
    expressions only; null text gives an empty array.  ``max_words`` hashes no more
    words than a later truncation keeps (``max_length - 2``)."""
    return df.select(*key_cols, F.transform(
        _words(text_col, max_words), lambda w: (_md5_number(F.md5(w), 0) % vocab_size).cast("int")).alias(out_col))


def _words(text_col: str, max_words: int | None) -> Column:
    """The words of a text between blanks, the first ``max_words`` if given; null text has none."""
    # an empty piece may stand first and the uncut rest last, beside the words that are kept
    limit = -1 if max_words is None else max_words + 2
    words = F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", limit), "")
    return words if max_words is None else F.slice(words, 1, max_words)


def cut_words(words: DataFrame, vocabulary: DataFrame, continuation: str = "##", longest_word: int = 100) -> DataFrame:
    """``(word, ids)``: the distinct ``word`` rows that can be cut into known pieces, the longest first from their start on.

    ``vocabulary`` is ``(piece string, id int)``; a piece inside a word stands in it
    behind ``continuation``, and a repeated piece counts with its smallest id.  A
    word that can't be cut to its end, or has more than ``longest_word``
    characters, has no row (the rule of greedy word-piece tokenizers, which give
    it one unknown id).  A word's next piece is looked up by ``HEAD`` characters,
    which bring all pieces that begin so, longest first, and by each smaller
    number; these joins are planned by the vocabulary's bytes.  ``CUTS`` pieces of
    every word are cut so, a row per word; words of more pieces, which are few,
    have all their other places looked up at once.
    """
    pieces = written(vocabulary.where("piece is not null and id is not null").groupBy("piece").agg(F.min("id").alias("id")), "pieces")
    inside = pieces.where(F.startswith("piece", F.lit(continuation))).select(F.expr(f"substring(piece, {len(continuation) + 1})").alias("body"), "id")
    stems = pieces.select(F.lit(False).alias("inner"), F.col("piece").alias("body"), "id").union(inside.select(F.lit(True), "body", "id"))
    # size and id as one number, the longest the largest
    size = F.length("body")
    stems = stems.select("inner", "body", (F.shiftleft(size.cast("long"), 32) + F.col("id").cast("long") + F.lit(1 << 31)).alias("m"))
    long = stems.where(size >= HEAD).groupBy("inner", F.substring("body", 1, HEAD).alias("head")).agg(
        F.sort_array(F.collect_list(F.struct("m", "body")), asc=False).alias("found"))
    shorter = [stems.where(size == n).select("inner", F.col("body").alias("head"), F.col("m").alias(f"m{n}")) for n in range(1, HEAD)]

    def next_piece(df: DataFrame, at: str) -> DataFrame:
        """``m`` beside each row: size and id of the longest piece of ``word`` at the place ``at``, or null."""
        keys = df.columns
        for n, table in [(HEAD, long), *enumerate(shorter, 1)]:
            df = (df.withColumn("inner", F.col(at) > 1).withColumn("head", F.expr(f"substring(word, {at}, {n})"))
                  .join(table, ["inner", "head"], "left").drop("inner", "head"))
        longest = F.get(F.filter("found", lambda p: F.startswith(F.expr(f"substring(word, {at})"), p["body"])), F.lit(0))["m"]
        return df.select(*keys, F.coalesce(longest, *(f"m{n}" for n in range(HEAD - 1, 0, -1))).alias("m"))

    def after(at: Column, m: Column) -> Column:
        return (at + F.shiftright(m, 32)).cast("int")

    def with_id(ids: Column, m: Column) -> Column:
        return F.concat(ids, F.array((m % (1 << 32) - (1 << 31)).cast("int")))

    length, m = F.length("word"), F.col("m")
    state = words.where((F.col("word") != "") & (length <= longest_word)).select("word", F.lit(1).alias("next"), F.array().cast("array<int>").alias("ids"))
    for _ in range(CUTS):
        state = next_piece(state, "next").where(m.isNotNull() | (F.col("next") > length)).select(
            "word", F.when(m.isNull(), F.col("next")).otherwise(after(F.col("next"), m)).alias("next"),
            F.when(m.isNull(), F.col("ids")).otherwise(with_id(F.col("ids"), m)).alias("ids"))
    state = written(state, "cut-words")
    done, rest = state.where(F.col("next") > length), state.where(F.col("next") <= length)
    places = next_piece(rest.select("word", F.explode(F.sequence("next", length)).alias("at")), "at").where(m.isNotNull())
    found = places.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("at", "m"))).alias("longest"))
    here = F.col("longest")
    walk = F.aggregate(
        F.sequence("next", length), F.struct("next", "ids"),
        lambda s, at: F.when((at == s["next"]) & here[at].isNotNull(), F.struct(after(at, here[at]).alias("next"), with_id(s["ids"], here[at]).alias("ids"))).otherwise(s),
        lambda s: F.when(s["next"] > length, s["ids"]))
    return done.select("word", "ids").union(rest.join(found, "word").select("word", walk.alias("ids")).where("ids is not null"))


def piece_ids(df: DataFrame, text_col: str, key_cols: Sequence[str], vocabulary: DataFrame, unknown_id: int,
              out_col: str = "ids", max_words: int | None = None, continuation: str = "##",
              longest_word: int = 100) -> DataFrame:
    """``token_ids`` by a dictionary of words: each distinct word is cut once (``cut_words``).

    The words of all rows are told apart map-side, cut and written with their
    ids; each row's words then take theirs by a join that is planned by the
    dictionary's bytes (broadcast, or a shuffle that AQE splits at frequent words)
    and come together again under the row's number, so rows with equal keys stay
    apart.  Texts never leave the JVM.  A word without a cut is ``unknown_id``.
    Null and empty texts give an empty array.  ``max_words`` as in ``word_ids``:
    every word has one id at least.
    """
    keys = list(key_cols)
    rows = written(df.select(*keys, _words(text_col, max_words).alias("_words"))
                   .withColumn("_row", F.monotonically_increasing_id()), "row-words")
    distinct = rows.select(F.explode(F.array_distinct("_words")).alias("word")).distinct()
    dictionary = written(cut_words(distinct, vocabulary, continuation, longest_word), "word-pieces")
    placed = (rows.select("_row", F.posexplode("_words").alias("_at", "word")).join(dictionary, "word", "left")
              .select("_row", "_at", F.coalesce("ids", F.array(F.lit(unknown_id))).alias("ids")))
    # partial lists of one row would only make the shuffled records larger
    found = placed.repartition("_row").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_at", "ids"))).alias("_cut"))
    ids = F.flatten(F.transform("_cut", lambda c: c["ids"]))
    return rows.join(found, "_row", "left").select(*keys, F.coalesce(ids, F.array().cast("array<int>")).alias(out_col))


def pad_ids(ids: DataFrame, key_cols: Sequence[str], max_length: int = MAX_LENGTH, start_id: int = 49406,
            end_id: int = 49407, pad_id: int = 0, ids_col: str = "ids") -> DataFrame:
    """E1 on content ids: truncated, framed and padded to ``max_length``."""
    framed = _framed(F.col(ids_col), max_length, start_id, end_id)
    return ids.select(*key_cols, let(framed, lambda f: F.struct(
        F.concat(f, F.array_repeat(F.lit(pad_id), F.lit(max_length) - F.size(f))).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), F.size(f)),
                 F.array_repeat(F.lit(0), F.lit(max_length) - F.size(f))).alias("attention_mask"))
    ).alias("_e")).select(*key_cols, "_e.*")


def frame_ids(ids: DataFrame, key_cols: Sequence[str], max_length: int = MAX_LENGTH, start_id: int = 49406,
              end_id: int = 49407, ids_col: str = "ids") -> DataFrame:
    """E2 on content ids: truncated and framed, with both masks, no padding."""
    framed = _framed(F.col(ids_col), max_length, start_id, end_id)
    return ids.select(*key_cols, let(framed, lambda f: F.struct(
        f.alias("input_ids"),
        F.array_repeat(F.lit(1), F.size(f)).alias("attention_mask"),
        F.concat(F.array(F.lit(1)), F.array_repeat(F.lit(0), F.size(f) - 2), F.array(F.lit(1)))
        .alias("special_tokens_mask"))
    ).alias("_e")).select(*key_cols, "_e.*")


def encode_padded(df: DataFrame, text_col: str, key_cols: Sequence[str], vocabulary: str | None = None,
                  max_length: int = MAX_LENGTH, start_id: int = 49406, end_id: int = 49407,
                  pad_id: int = 0) -> DataFrame:
    """``input_ids`` and ``attention_mask``, truncated and padded to ``max_length``."""
    return pad_ids(token_ids(df, text_col, key_cols, vocabulary, max_ids=max_length - 2), key_cols, max_length, start_id, end_id, pad_id)


def encode_variable(df: DataFrame, text_col: str, key_cols: Sequence[str], vocabulary: str | None = None,
                    max_length: int = MAX_LENGTH, start_id: int = 49406, end_id: int = 49407) -> DataFrame:
    """``input_ids`` truncated to ``max_length`` (no padding), ``attention_mask``
    and ``special_tokens_mask`` (1 on the start and end ids)."""
    return frame_ids(token_ids(df, text_col, key_cols, vocabulary, max_ids=max_length - 2), key_cols, max_length, start_id, end_id)


def _md5_number(digest: Column, word: int) -> Column:
    """The ``word``-th 32 bits of an md5 in hex as a number."""
    return F.conv(F.substring(digest, 8 * word + 1, 8), 16, 10).cast("long")


def _uniform(seed: int, epoch: int, salt: int, key: Column, pos: Column) -> Column:
    """A uniform double in [0, 1) from a 64-bit hash of (seed, epoch, salt, key, position)."""
    h = F.xxhash64(F.lit(seed), F.lit(epoch), F.lit(salt), key, pos)
    return F.shiftrightunsigned(h, 11).cast("double") * F.lit(2.0 ** -53)


def mask_tokens(df: DataFrame, key_col: str, mask_id: int, vocab_size: int,
                probability: float = MLM_PROBABILITY, seed: int = 2023, epoch: int = 0,
                ids_col: str = "input_ids", special_col: str = "special_tokens_mask",
                portable: bool = False) -> DataFrame:
    """Masked-word inputs and targets.

    Each non-special position is chosen with ``probability``; of the chosen,
    80 % become ``mask_id``, 10 % a random id below ``vocab_size``, 10 % stay.
    ``labels`` hold the original id at chosen positions and -100 elsewhere.
    Draws are hashes of (seed, epoch, row key, position): the same on retry,
    different per epoch.  With ``portable`` the three draws of a position are the
    32-bit pieces of one md5, which other engines can recompute.  One ``transform`` per output with the special mask
    bound once, so nothing is recomputed per element.
    """
    key = F.col(key_col)

    def masked(m: Column, x: Column, i: Column, low: Column, how: Column, which: Column) -> Column:
        chosen = (m[i] == 0) & low
        rand_id = (which * F.lit(vocab_size)).cast("int")
        new = F.when(how < 0.8, F.lit(mask_id)).when(how < 0.9, rand_id).otherwise(x)
        return F.struct(F.when(chosen, new).otherwise(x).alias("i"),
                        F.when(chosen, x).otherwise(F.lit(IGNORE_INDEX)).alias("l"))

    def choose(m: Column) -> Column:
        def per_position(x: Column, i: Column) -> Column:
            if portable:
                digest = F.md5(F.concat_ws(":", F.lit(f"{seed}:{epoch}"), key.cast("string"), i.cast("string")))
                # the first draw is compared as text: eight hex digits order as the number they stand for
                below = F.lit(f"{math.ceil(probability * 2 ** 32):08x}") if probability < 1 else F.lit("g")
                return let(digest, lambda d: masked(m, x, i, F.substring(d, 1, 8) < below, *(
                    _md5_number(d, n) / F.lit(4294967296.0) for n in (1, 2))))
            low, how, which = (_uniform(seed, epoch, salt, key, i) for salt in (1, 2, 3))
            return masked(m, x, i, low < F.lit(probability), how, which)
        return F.transform(F.col(ids_col), per_position)

    pairs = df.withColumn("_ts_pairs", let(F.col(special_col), choose))
    return (pairs.withColumn(ids_col, F.transform("_ts_pairs", lambda p: p["i"]))
            .withColumn("labels", F.transform("_ts_pairs", lambda p: p["l"]))
            .drop("_ts_pairs"))
