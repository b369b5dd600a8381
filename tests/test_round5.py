"""Findings of round 3: CPU seconds of op2_toxicity and op12_lm, and encode_pieces."""
import random

import pyarrow as pa

from textstrata.llm import maxent, toxicity
from textstrata.operators import encode


def test_words_without_a_weight_go_no_further():
    """The memory of votes holds voting words only; votes are those of a plain loop over all weights."""
    rng = random.Random(4)
    weights = {"stupid": 2.0, "stup*": 1.5, "stupid*": 3.0, "stupi*": 1.0, "loser": 1.0, "xé#a*": 4.0}
    lexicon = toxicity.Lexicon(weights)
    words = {"".join(rng.choices("stupidxé#a!", k=rng.randrange(0, 8))) for _ in range(3000)} | {"(stupid)", "stupid", "stupidity,", "loser", "stup", "plain", "xé#ab"}
    want = []
    for w in {w.strip(toxicity.TRIM) for w in words}:
        best = max((v for k, v in weights.items() if w == k or (k[-1] == "*" and w.startswith(k[:-1]) and len(w) >= len(k))), default=0.0)
        want += [best] if best else []
    assert lexicon.votes(words) == sorted(want, reverse=True) == lexicon.votes(words)
    assert "stupidity" in lexicon.known and "plain" not in lexicon.known


def test_faster_looks_find_what_the_slow_ones_do():
    rng = random.Random(5)
    for _ in range(20000):
        text = "".join(rng.choices("ab1 .-_*!\n\té", k=rng.randrange(0, 24)))
        assert toxicity.has_triple(text) == bool(toxicity.TRIPLE.search(text))
        if toxicity.SPACED.search(text):
            assert toxicity.SINGLES.search(text)
            assert {m.group(0) for m in toxicity.SPACED.finditer(text)} <= toxicity.disguised(text, set(text.split()))
    assert not toxicity.has_triple("") and toxicity.disguised("looool", {"looool"}) == {"looool"}


def test_tokens_of_slices_are_those_of_a_plain_loop():
    """Arrow cuts the words; arrays that are slices of others, nulls, blanks of all kinds and other scripts give what bytes.split does."""
    rng = random.Random(6)
    texts = [None, "", " \t\n\v\f\r ", "A b", " É x \x1f\x85 ÀB c "] + ["".join(rng.choices("aBé \t\n\x1c　", k=rng.randrange(0, 30))) for _ in range(400)]
    column = pa.array(texts, pa.string())
    for first in (0, 3, 200):
        batch = pa.RecordBatch.from_arrays([column.slice(first)], names=["t"])
        got = []
        for part, some in maxent.token_batches(iter([batch]), 0, limit=500):
            kinds = some.kinds.to_pylist()
            assert kinds[0] == maxent.END and maxent.byte_strings(some.kinds) == kinds and part.num_rows == len(some.starts)
            words = [kinds[i] for i in some.at]
            got += [words[a:a + n] for a, n in zip(some.starts, some.lengths)]
            assert [p.encode().split() for p in some.plain.to_pylist()] == [w[:-1] for w in got[-part.num_rows:]]
        assert got == [[*(t or "").encode().lower().split(), maxent.END] for t in texts[first:]]


def test_counts_don_t_depend_on_the_words_held(spark, monkeypatch):
    texts = spark.range(300).selectExpr("concat('W', id % 7, ' x  w', id, ' ', null) as none", "concat(' W', id % 7, ' x  w', id) as text")
    whole = {bytes(r.word): r.c for r in maxent.count_words(texts.select("text")).collect()}
    monkeypatch.setattr(maxent, "HELD", 3)
    assert {bytes(r.word): r.c for r in maxent.count_words(texts.select("text")).collect()} == whole
    assert whole[b""] == 300 and whole[b"x"] == 300 and whole[b"w1"] == 44 and whole[b"w299"] == 1
    assert {bytes(r.word): r.c for r in maxent.count_words(texts.select("none")).collect()} == {b"": 300}


def test_codes_are_the_same_at_once_and_one_by_one():
    codes = maxent.Codes({b"": 0, b"a": 1, "é".encode(): 2}, 100)
    some = maxent.Tokens(pa.array(["a é b", None, "bb a " + "z" * 200]))
    assert codes.of(some).tolist() == [codes[some.kinds[i].as_py()] for i in some.at]


def test_words_are_cut_without_a_row_per_substring(spark, monkeypatch):
    """A word stays one row while its pieces are cut; results don't depend on the first characters looked up or the pieces cut one by one."""
    rng = random.Random(7)
    pieces = sorted({"".join(rng.choices("abé#", k=rng.randrange(0, 6))) for _ in range(60)} | {"##a", "##b", "##é", "##abab", "a", "aaaaaa"})
    ids = {p: i for i, p in enumerate(pieces)}
    vocabulary = spark.createDataFrame([(p, i) for p, i in ids.items()] + [("a", 999), (None, 3), ("b#", None)], "piece string, id int")
    every = sorted({"".join(rng.choices("abé#", k=rng.randrange(0, 14))) for _ in range(600)} | {"a" * 100, "a" * 101, "abx"})
    words = spark.createDataFrame([(w,) for w in every], "word string")
    want = {}
    for w in every:
        at, cut = 0, []
        while at < len(w) <= 100:
            n = max((n for n in range(1, len(w) - at + 1) if ("##" if at else "") + w[at:at + n] in ids), default=0)
            if not n:
                break
            cut.append(ids[("##" if at else "") + w[at:at + n]])
            at += n
        if cut and at == len(w):
            want[w] = cut
    plans, write = [], encode.written
    monkeypatch.setattr(encode, "written", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, name))
    for head, cuts in ((3, 2), (2, 4)):
        monkeypatch.setattr(encode, "HEAD", head)
        monkeypatch.setattr(encode, "CUTS", cuts)
        got = [(r.word, list(r.ids)) for r in encode.cut_words(words, vocabulary).collect()]
        assert dict(got) == want and len(got) == len(want) > 100
        assert len(want["a" * 100]) > 10
    assert plans and not any("Generate" in p for p in plans)
    assert encode.cut_words(words, vocabulary.where("false")).count() == 0 == encode.cut_words(words.where("false"), vocabulary).count()
