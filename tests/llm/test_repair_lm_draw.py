"""Repair, language model and importance resampling against brute force, on odd and on empty tables."""
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from odd_tables import no_docs, odd_docs, rows_of  # noqa: F401
from pyspark.sql import types as T

from conftest import SF001
from textstrata.llm import importance, maxent, repair

TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
                      T.StructField("audit", T.LongType()), T.StructField("conv", T.StringType()), T.StructField("cost", T.StringType()), T.StructField("digest", T.StringType())])


# ------------------------------------------------ repair

def brute_repair(rows):
    """All edit sequences with at most three inserted rows before each row and at the end; rows are (role, text), in order."""
    seen, faults = set(), []
    for r in rows:
        last = r[1].rstrip(" \t\n\x0b\x0c\r")[-1:]
        faults.append("blank" if not last else "duplicate" if r in seen else "truncated" if last not in ".!?" else "")
        seen.add(r)
    found = []

    def go(i, cost, audit, out):
        if not re.match(r"^s?(ua)*u?$", "".join(r[:1] for r, _ in out)) or any(not r for r, _ in out):
            return
        if i == len(rows):
            for n in range(4):
                more = [(["user", "assistant"][(len(out) - bool(out and out[0][0][:1] == "s") + k) % 2], "") for k in range(n)]
                if re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] for r, _ in out + more)):
                    found.append((cost + 2 * n, audit + "I" * n, out + more))
            return
        for n in range(4):
            for more in itertools.product(("user", "assistant"), repeat=n):
                base, c, a = out + [(r, "") for r in more], cost + 2 * n, audit + "I" * n
                go(i + 1, c + 3, a + "D", base)
                if faults[i] not in ("blank", "duplicate"):
                    late = faults[i] == "truncated"
                    go(i + 1, c + late, a + "K", base + [rows[i]])
                    for r in ("user", "assistant"):
                        go(i + 1, c + 2 + late, a + "R", base + [(r, rows[i][1])])

    go(0, 0, "", [])
    cost, audit, out = min(found, key=lambda f: f[:2])
    count = Counter(faults)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, digest


def expected(table):
    by = defaultdict(list)
    for conv, turn, role, text, *_ in table:
        role, text = " " if role is None else role, " " if text is None else text
        by[conv].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), text))
    out = {}
    for conv, rows in by.items():
        rows.sort()
        turns = {t for given, t, *_ in rows if given}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *brute_repair([(r[2], r[4]) for r in rows]))
    return out


def test_repair_equals_brute_force(spark):
    rng = random.Random(11)
    roles, texts = ["system", "user", "assistant", "tool", "", None], ["Fine.", "Well?", "cut off", "", " \t", "Oh! ", None, "ünd ß。"]
    table = [(c, rng.choice([None, 0, 1, 2, 3, 7]), rng.choice(roles), rng.choice(texts), 1, "x", "y", "z") for c in range(60) for _ in range(rng.randrange(1, 5))]
    table += [(None, 1, "user", "Hi.", 1, "x", "y", "z"), (None, None, "assistant", "Yes.", 1, "x", "y", "z")]
    table += [(100, i, "user" if i % 2 == 0 else "assistant", f"{'long ' * 20_000}{i}.", 1, "x", "y", "z") for i in range(4)]
    got = repair.repair(spark.createDataFrame(table, TURNS).repartition(3)).collect()
    want = expected(table)
    assert {r.conv: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got} == want and len(got) == len(want)


def test_repair_of_nothing(spark):
    out = repair.repair(spark.createDataFrame([], TURNS))
    assert out.collect() == [] and "repaired_sha256" in out.columns


def test_each_suffix_is_one_node(monkeypatch):
    made = []
    extend = repair.extend
    monkeypatch.setattr(repair, "extend", lambda symbol, rest: made.append(1) or extend(symbol, rest))
    strings = ["".join(s) for n in range(5) for s in itertools.product("AEI", repeat=n)]
    solved = list(repair.solve_sorted(sorted(strings, key=lambda s: s[::-1])))
    suffixes = {s[k:] for s in strings for k in range(len(s))}
    assert len(made) == len(suffixes) and len(solved) == len(strings)


def test_long_conversation_is_not_recursive():
    (_, audit, node), = repair.solve_sorted(iter(["EI" * 50_000]))  # user and assistant, clean, in turn
    assert audit == "K" * 100_000 and node.cost[repair.START] == 0


# ------------------------------------------------ language model

def plain_scores(docs, counts, vocab, weights):
    """Token by token, without batches, tables or joins."""
    out = []
    for text in docs:
        words = (text or "").encode().lower().split() + [b""]
        total = base = 0.0
        before = [b"", b"", b""]
        for w in words:
            codes = vocab.codes()
            c = counts.get(w, 0)
            b = [m[codes[x]] for m, x in zip(vocab.context, before)]
            second = vocab.context[2][codes[before[1]]]
            o = vocab.output[codes[w]]
            cls, member = vocab.cls[o], vocab.member[o]
            one = (b[0] * sum(maxent.MIDDLE) + b[1]) * sum(maxent.FAR) + b[2]
            two = (cls * sum(maxent.NEAR) + b[0]) * sum(maxent.FAR) + second
            p = maxent.log_softmax(weights, maxent.feature_rows(0, np.array([one])))[0][cls] + maxent.log_softmax(weights, maxent.feature_rows(1, np.array([two])))[0][member]
            total += p / math.log(10)
            if o >= maxent.HEAD:
                own = sum(n for x, n in counts.items() if vocab.output[codes[x]] == o), sum(1 for x in counts if vocab.output[codes[x]] == o)
                total += math.log10((c + 0.5) / (own[0] + 0.5 * (own[1] + 1)))
            base += math.log10((c + 0.5) / (vocab.tokens + 0.5 * (vocab.kinds + 1)))
            before = [w, *before[:2]]
        out.append((len(words), sum(counts.get(w, 0) > 0 for w in words), base, total))
    return out


def test_scores_equal_a_plain_loop(spark, odd_docs):
    texts = odd_docs.select("text")
    counts = maxent.materialise(maxent.count_words(texts), "t")
    plain = Counter(w for r in texts.collect() for w in (r.text or "").encode().lower().split() + [b""])
    assert {bytes(r.word): r.c for r in counts.collect()} == plain
    for lookup in (maxent.HEAD + 2, maxent.LOOKUP):  # most words outside the bounded table, and none
        vocab = maxent.vocabulary(counts, lookup)
        weights = maxent.train(maxent.context_cells(texts, vocab), 3)
        short = [t for t in dict.fromkeys(r[1] for r in rows_of()) if t is None or len(t) < 2000]
        docs = spark.createDataFrame(list(enumerate([*short, "never seen WORDS here"])), "doc_id long, text string")
        got = sorted(maxent.score(docs, counts, vocab, weights).collect())
        for r, (n, known, base, total) in zip(got, plain_scores([*short, "never seen WORDS here"], plain, vocab, weights)):
            assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, sum(plain.values()))
            assert r.base_score == pytest.approx(base, rel=1e-9, abs=1e-9) and r.score == pytest.approx(total, rel=1e-4, abs=1e-4)


def test_probabilities_add_up_to_one(spark):
    docs = spark.createDataFrame([("a b c a b. " * 3,), ("b c d e f",)], "text string")
    counts = maxent.materialise(maxent.count_words(docs), "t")
    vocab = maxent.vocabulary(counts)
    weights = maxent.train(maxent.context_cells(docs, vocab), 5)
    classes = np.exp(maxent.log_softmax(weights, maxent.feature_rows(0, np.array([0, 5, 999]))))
    members = np.exp(maxent.log_softmax(weights, maxent.feature_rows(1, np.arange(40))))
    assert np.allclose(classes.sum(axis=1), 1) and np.allclose(members.sum(axis=1), 1)
    assert sorted(zip(vocab.cls, vocab.member)) == [(c, m) for c in range(maxent.CLASSES) for m in range(maxent.WIDTH)]


def test_updates_raise_the_likelihood_and_held_out_texts_gain(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    train, held = docs.where("doc_id % 5 <> 0"), docs.where("doc_id % 5 = 0")
    out = maxent.fit_and_score(held, train).selectExpr("sum(score) s", "sum(base_score) b").first()
    assert out.s > out.b
    texts = train.select("text")
    vocab = maxent.vocabulary(maxent.materialise(maxent.count_words(texts), "t"))
    cells = maxent.materialise(maxent.context_cells(texts, vocab), "t")
    assert maxent.gradient(cells, maxent.train(cells, 20))[1] > maxent.gradient(cells, maxent.train(cells, 4))[1]


def test_language_model_without_rows(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(maxent, "UPDATES", 2)
    rows = maxent.fit_and_score(odd_docs, no_docs).collect()
    assert len(rows) == odd_docs.count() and {r.n_known for r in rows} == {0} and all(math.isfinite(r.score) and abs(r.base_score) < 1e-6 for r in rows)
    assert maxent.fit_and_score(no_docs, odd_docs).collect() == []


# ------------------------------------------------ importance

def runs(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute_resample(docs, target, per_cent, least):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = Counter(bucket(f) for _, x in docs for f in runs(x)[1]), Counter(bucket(f) for x in target for f in runs(x)[1])
    S, TT = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (S + 10000.0) / ((s[b] + 1.0) * (TT + 10000.0))))
    out = []
    for i, x in docs:
        words, feats = runs(x)
        weight = sum(gain(bucket(f)) for f in feats)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(feats), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    order = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    take = len(order) * per_cent // 100
    ranked = [(*r[:4], k + 1 if k < take else None) for k, r in enumerate(order)]
    return sorted([*ranked, *((*r[:4], None) for r in out if r[4] < least)], key=str)


@pytest.mark.parametrize("per_cent,least", [(5, 20), (60, 1), (100, 0)])
def test_resample_equals_brute_force(spark, odd_docs, per_cent, least):
    target = spark.createDataFrame([("Licensed under the quick brown fox",), (None,), ("a b c",)], "text string")
    got = importance.resample(odd_docs, target, per_cent, least)
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_resample(docs, [r.text for r in target.collect()], per_cent, least)


def test_resample_of_nothing(spark, odd_docs, no_docs):
    assert importance.resample(no_docs, odd_docs).collect() == []
    assert importance.resample(odd_docs, no_docs).count() == odd_docs.count()
