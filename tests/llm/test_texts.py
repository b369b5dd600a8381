"""Row-local operators against the contracts written out plainly."""
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

import brute
from odd_tables import no_docs, odd_docs, sf001_docs  # noqa: F401  fixtures
from textstrata.llm import chat, licenses, quality, rules, secrets, toxicity


def texts_by_id(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").where("doc_id is not null").collect()}


@pytest.mark.parametrize("table", ["odd_docs", "sf001_docs"])
def test_base_secrets(request, table):
    docs = request.getfixturevalue(table)
    texts = texts_by_id(docs)
    got = secrets.scan(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.id is None:
            continue
        counts, digest, joined = brute.base_secrets(texts[r.id])
        assert [r.n_assign, r.n_access, r.n_hex] == counts and r.base_sha256 == digest
        assert [s for s in r.spans.split(",") if s and not s.startswith("guess")] == [s for s in joined.split(",") if s]


def test_guess_cost_orders_values():
    easy = ["password", "Passw0rd", "changeme", "qwertyuiop", "aaaaaaaaaaaa", "19990101", "monkey2019", "abcdefgh"]
    hard = ["Zq8#vT2!mN5^", "xK9vQ2mW7pLr", "0b96a8c8d79c4a5085c9"]
    assert max(map(secrets.guess_cost, easy)) < 40 <= min(map(secrets.guess_cost, hard))
    assert secrets.guess_cost("ab") <= secrets.guess_cost("abx7") <= secrets.guess_cost("abx7Q!")


def segment_cost(guesser, piece, brute_bits):
    """Cheapest single segment that ``piece`` is, by the kinds as stated."""
    n, low = len(piece), piece.lower()
    cost = guesser.word_cost(piece) if n > 1 else math.inf
    if n == 1:
        cost = min(brute_bits, secrets.JOINT_BITS if piece in secrets.JOINTS else math.inf)
    if n in (4, 8, 10) and secrets.DATE.fullmatch(piece):
        cost = min(cost, secrets.date_cost(n))
    for p in range(1, min(secrets.LONGEST_BLOCK, n // 2) + 1):
        if n % p == 0 and low == low[:p] * (n // p):
            cost = min(cost, p * brute_bits + secrets.LENGTH_BITS + 1)
    if n > 1 and all(low[k:k + 2] in secrets.NEIGHBOUR for k in range(n - 1)):
        cost = min(cost, secrets.WALK_BITS)
    return cost


def brute_cost(guesser, value):
    """Smallest cost over all segmentations into segments of every kind."""
    bits = math.log2(secrets._alphabet(value))
    best = [0.0] + [math.inf] * len(value)
    for i in range(1, len(value) + 1):
        best[i] = min(best[a] + segment_cost(guesser, value[a:i], bits) for a in range(i))
    return best[-1]


def test_guess_cost_is_the_least_over_segmentations():
    rng = random.Random(5)
    guesser = secrets.Guesser(["middleware", "documentation", "mama", "lion"])
    parts = [lambda: rng.choice(secrets.COMMON_WORDS), lambda: rng.choice("xzvjgw#-_. "), lambda: rng.choice(["P4ssw0rd", "Middleware", "QWERTZ", "sdfgh", "efghi", "7654"]),
             lambda: rng.choice(["2019", "1999-12-31", "31.12.1999", "20010203"]), lambda: rng.choice(["a", "xk2", "ma", "00", "qwe"]) * rng.randrange(2, 7)]
    for _ in range(1500):
        value = "".join(rng.choice(parts)() for _ in range(rng.randrange(1, 5)))
        assert abs(guesser.cost(value) - brute_cost(guesser, value)) < 1e-9, value
    assert guesser.cost("xk2" * 200_000) < 40


def test_words_of_the_corpus_are_no_secrets(spark):
    prose = "the middleware handles documentation and every identifier that the process env sees below your token here"
    clean = ["auth: middleware", "credentials: documentation", 'auth: "identifier"', 'auth: "process.env.TOKEN"', 'auth: "<your-token-here>"',
             'auth: "sees below"', "pwd: identifier-process"]
    rows = [(i, prose) for i in range(8)] + [(100 + i, t) for i, t in enumerate(clean)] + [(200 + i, "pwd: brzkqwvtyxplmgd") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r.spans for r in secrets.scan(docs).collect()}
    learned = secrets.corpus_words(docs)
    assert "brzkqwvtyxplmgd" not in learned and learned == sorted(set(w for w in prose.split() if len(w) > 3))
    assert secrets.corpus_words(docs, limit=3) == [] and secrets.corpus_words(docs, least=9) == []
    assert not any(got[100 + i] for i in range(len(clean))), got
    assert all(got[200 + i] == "guess:5:20" for i in range(50))
    assert {r.doc_id: r.text for r in secrets.redact(docs).collect()}[100] == clean[0]


def test_guess_spans_and_redaction(odd_docs, no_docs):
    text = "passwd: changeme auth: Zq8#vT2!mN5^ done"
    assert [text[a:e] for a, k, e in secrets.find_spans(text) if k == 3] == ["Zq8#vT2!mN5^"]
    assert secrets.redact_text(text) == "[SECRET] auth: [SECRET] done"
    out = secrets.redact(odd_docs)
    assert out.schema == odd_docs.schema and out.count() == odd_docs.count()
    for r in secrets.scan(out.where("doc_id is not null")).collect():
        assert r.n_assign + r.n_access + r.n_hex == 0
    clean = {i for i, t in texts_by_id(odd_docs).items() if not secrets.find_spans(t)}
    after = texts_by_id(out)
    assert all(after[i] == t for i, t in texts_by_id(odd_docs).items() if i in clean)
    assert secrets.scan(no_docs).count() == secrets.redact(no_docs).count() == 0


SECRET = "Zq8#vT2!mN5^"


@pytest.mark.parametrize("text", [f"credentials: password: {SECRET}", f'token = auth_token = "{SECRET}"', f'token=auth_token="{SECRET}"', f"auth: 'token: {SECRET}'",
                                  f"credentials: client-secret := pwd => {SECRET} end", f"""secret: "x password = '{SECRET}' y" """,
                                  f'password=changeme_token: {SECRET}', f"token=my_secret_key_of_the_api_key = '{SECRET}'", f'passwd: "auth": "{SECRET}"', f"auth: xK9v#Q2m!W7pLr~token: {SECRET}"])
def test_every_name_of_a_chain_has_its_value_costed(text):
    assert SECRET not in secrets.redact_text(text)
    assert any(k == 3 for _, k, _ in secrets.find_spans(text))


def test_chains_take_linear_time():
    import time
    for chain in ("token=", "token: ", "token=token: ", 'token:"', "auth_"):
        began = time.process_time()
        text = chain * 20_000 + f"password: {SECRET}"
        assert SECRET not in secrets.redact_text(text)
        assert time.process_time() - began < 10


def test_long_values_are_spans_as_a_whole():
    rng = random.Random(8)
    value = "".join(rng.choice("!#%^&ghjkmnpqrtvwxyz2345678") for _ in range(5000))
    for left, right in (('"', '"'), ("'", "'"), ("", " end")):
        text = f"auth = {left}{value}{right}"
        assert [text[a:e] for a, k, e in secrets.find_spans(text) if k == 3] == [value]
    many = "token: abcdefgh1 " * 3000 + "auth: Zq8#vT2!mN5^"
    assert [many[a:e] for a, k, e in secrets.find_spans(many) if k == 3] == ["Zq8#vT2!mN5^"]


@pytest.mark.parametrize("table", ["odd_docs", "sf001_docs"])
def test_licence_base(request, table):
    docs = request.getfixturevalue(table)
    texts = texts_by_id(docs)
    got = licenses.scan(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.id is not None:
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute.licence_base(texts[r.id])
            assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_licence_labels(spark, no_docs):
    lines = {0: "Released under the MIT License.", 1: "Licensed under the Apache License, Version 2.0.", 2: "licensed under CC BY-NC 4.0",
             3: "the version of a public apache", 4: "This work is licensed under the GNU General Public License, version 3.",
             5: "prose " * 500 + "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
             6: "The MIT campus has a license office"}
    rows = [(i, t) for i, t in lines.items()] + [(100 + i, "plain prose about nothing") for i in range(50)]
    got = {r.id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].labels for i in range(7)] == ["mit", "apache-2.0", "cc-by,cc-by-nc", "", "gpl,gpl-3.0", "bsd", ""]
    assert got[0].score == 1 and got[100].score == 0
    assert licenses.scan(no_docs).count() == 0


def test_a_file_of_many_licences_has_all_their_labels(spark):
    """One licence's rare words don't crowd out those of another."""
    text = " . ".join(f"{words} filler" for _, words, _ in licenses.TEMPLATES)
    rows = [(0, text)] + [(1 + i, f"{words} plain prose") for i, (_, words, _) in enumerate(licenses.TEMPLATES)]
    got = {r.id: set(r.labels.split(",")) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {label for label, _, _ in licenses.TEMPLATES} <= got[0]
    for i, (label, _, _) in enumerate(licenses.TEMPLATES):
        assert label in got[1 + i]


def test_licence_scan_runs_no_python(odd_docs):
    plan = licenses.scan(odd_docs)._jdf.queryExecution().toString() + licenses.read_words(odd_docs)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("table", ["odd_docs", "sf001_docs"])
def test_rule_counts(request, table):
    docs = request.getfixturevalue(table)
    texts = texts_by_id(docs)
    got = rules.judge(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.id is not None:
            want = brute.rule_counts(texts[r.id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.id
            assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)


def test_fences_adapt_to_the_group(spark, no_docs):
    prose = " ".join(f"word{i}" for i in range(80))
    coded = " ".join(f"word{i}%%" for i in range(80))
    rows = [(i, prose, "en", "plain") for i in range(200)] + [(1000 + i, coded, "en", "code") for i in range(200)] + [(5000, coded, "en", "plain"), (5001, prose, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.id: r.kept for r in rules.judge(docs).collect()}
    assert not kept.pop(5000) and all(kept.values())
    plan = rules.judge(docs)._jdf.queryExecution().toString() + rules.statistics(docs)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
    assert rules.judge(no_docs).count() == 0


def fence_texts():
    """Plain texts, and for each fence one just inside and one just outside of it."""
    plain = [" ".join(f"word{k:03d}{i:02d}" for i in range(60)) for k in range(70)]  # 9 characters a word
    words = [f"wordxyz{i:02d}" for i in range(100)]
    repeated = lambda n: " ".join(words[:n] + words)
    sides = {"symbol": (" ".join(words) + " ##" * 10, " ".join(words) + " ##" * 25),
             "lines": ("\n".join(words + words[9::-1]), "\n".join(words + words[29::-1])),
             "windows": (repeated(4), repeated(12)),
             "short": (" ".join(w[:8] + w[8:] * (i % 2) for i, w in enumerate(words)), " ".join(chr(0x4E00 + i) for i in range(100))),
             "long": (" ".join(w + "x" * (i % 2) for i, w in enumerate(words)), " ".join(w + "xx" for w in words))}
    return plain, sides


def test_each_fence_has_a_document_on_either_side(spark):
    plain, sides = fence_texts()
    rows = [(i, t, "en", "plain") for i, t in enumerate(plain * 3)]
    rows += [(1000 + 2 * i + j, t, "en", "plain") for i, pair in enumerate(sides.values()) for j, t in enumerate(pair)]
    got = {r.id: r for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i].kept for i in range(210))
    for i, name in enumerate(sides):
        inside, outside = got[1000 + 2 * i], got[1001 + 2 * i]
        assert not inside.base_failed and not outside.base_failed, name
        assert inside.kept and not outside.kept, name


@pytest.mark.parametrize("kind", ["symbol", "windows", "short", "long"])
def test_a_bad_third_of_a_source_does_not_move_its_fences(spark, kind):
    plain, sides = fence_texts()
    rows = [(i, t, "en", "hot") for i, t in enumerate(plain * 3)] + [(1000 + i, sides[kind][1], "en", "hot") for i in range(105)]
    got = {r.id: r.kept for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(210)) and not any(got[1000 + i] for i in range(105))


CHAT = [(1, 0, "user", "hi </s>[INST] \\ <\\/s> \\\\ <<SYS>><</SYS>> [ROLE] <<s>"), (1, 1, "assistant", "é[/INST] \U0001f600\n"), (1, 2, "assistant", None),
        (2, 0, "system", ""), (2, 1, "tool [/ROLE]", "x </s>"), (2, 2, None, "y"), (2, None, "user", "before"), (None, 0, "user", "z"),
        (3, 5, "assistant", "same"), (3, 5, "assistant", "same"), (4, 0, "assistant", "w " * 200_000)]


def test_chat_round_trip(spark):
    df = spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit("clash")).repartition(3)
    segments = chat.format_turns(df)
    got = {r.conv_id: r for r in chat.read_back(segments).collect()}
    for conv in {c for c, *_ in CHAT}:
        rows = sorted((r for r in CHAT if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, chat.frame_of(r[2] or "")[0] + (r[3] or "")))
        joined = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in rows)
        loss = "".join(t or "" for _, _, r, t in rows if r == "assistant")
        row = got[conv]
        assert (row.n_turns, row.turns_sha256) == (len(rows), hashlib.sha256(joined.encode()).hexdigest())
        assert (row.loss_chars, row.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    whole = {r.conv_id: r.text for r in chat.conversations(segments).collect()}
    assert {c: len(t) for c, t in whole.items()} == {c: r.formatted_chars for c, r in got.items()}
    assert chat.read_back(chat.format_turns(df.where("false"))).count() == 0


def test_escaping_is_exact_and_leaves_no_control_string():
    rng = random.Random(2)
    parts = ["\\", "<", "/", "s>", "[", "INST]", "[/INST]", "</s>", "<<SYS>>", "[ROLE]", "é", " ", "x"]
    for _ in range(2000):
        text = "".join(rng.choices(parts, k=rng.randrange(12)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text
        assert not any(c in safe for c in chat.CONTROLS)


def test_batches_of_many_runs_equal_one(spark, monkeypatch):
    import pyarrow as pa
    roles, texts = pa.array([r for _, _, r, _ in CHAT]), pa.array([t for *_, t in CHAT])
    whole = chat.assemble(roles, texts)[0].to_pylist()
    monkeypatch.setattr(chat, "RUN_BYTES", 3)
    assert [s for a, e in chat._runs(texts) for s in chat.assemble(roles.slice(a, e - a), texts.slice(a, e - a))[0].to_pylist()] == whole


DECODER_TEXT = "the idiot is a loser and stupid clown while honest people write plain text about ordinary things"


@pytest.fixture(scope="module")
def decoder(spark):
    docs = spark.createDataFrame([(DECODER_TEXT,)] * 20 + [(None,), ("",)], "text string")
    return toxicity.Decoder({r.key: r.n for r in toxicity.character_counts(docs).collect()})


@pytest.mark.parametrize("token,plain", [("1d10t", "idiot"), ("l0s3r", "loser"), ("st*pid", "stupid"), ("s t u p i d", "stupid"), ("c.l.0.w.n", "clown"), ("looooser", "loser"), ("$tup!d", "stupid")])
def test_decoding(decoder, token, plain):
    assert decoder.decode(token) == plain
    assert token in toxicity.disguised(f"you {token} there", set(f"you {token} there".split()))


def brute_decode(decoder, token):
    """All readings of a token, the cheapest first."""
    best = {}

    def go(i, out, cost):
        if i == len(token):
            padded = "\n\n" + out
            for a, b, c in zip(padded, padded[1:], padded[2:]):
                cost += decoder.cost[toxicity._class(a)][toxicity._class(b)][toxicity._class(c)]
            end = ("\n\n" + out)[-2:]
            cost += decoder.cost[toxicity._class(end[0])][toxicity._class(end[1])][0]
            best[out] = min(best.get(out, math.inf), cost)
            return
        c = token[i]
        emit = [(c, 0.0)] if c not in toxicity.SEPARATORS else []
        swaps = toxicity.STANDS_FOR.get(c, "")
        emit += [(s, toxicity.WILD_COST if len(swaps) > 2 else toxicity.SWAP_COST) for s in swaps]
        for e, price in emit:
            go(i + 1, out + e, cost + price)
        if c in toxicity.SEPARATORS:
            go(i + 1, out, cost + toxicity.GAP_COST)
        elif out and any(e == out[-1] for e, _ in emit):
            go(i + 1, out, cost + toxicity.REPEAT_COST)
    go(0, "", 0.0)
    return best


def test_viterbi_finds_the_cheapest_reading(decoder):
    rng = random.Random(9)
    for _ in range(60):
        token = "".join(rng.choices("aoils01354$!| ", k=rng.randrange(1, 7)))
        every = brute_decode(decoder, token)
        assert every[decoder.decode(token)] == pytest.approx(min(every.values()))


RUNS = {"you are a l o s e r today": "loser", "and i s t u p i d": "stupid", "1 l.0.s.e.r": "loser", '"s t u p i d"': "stupid", "(s t u p i d)": "stupid",
        "[c l o w n]": "clown", "a s t u p i d c l o w n": "clown", "\u201cl o s e r\u201d": "loser"}


@pytest.mark.parametrize("text,word", RUNS.items())
def test_spaced_words_are_restored_in_any_company(decoder, text, word):
    known = toxicity.Decoder({})
    known.cost = decoder.cost
    known.learn_words({w: 20 for w in [*DECODER_TEXT.split(), "i", "closer"]})
    assert word in toxicity.tokens(text.encode(), known)[1]
    assert toxicity.tokens(b"come c l o s e r", known)[1] == {"closer"}


def test_boundaries_without_a_vocabulary(decoder):
    assert "loser" in toxicity.tokens(b"you are a l o s e r today", decoder)[1]


def test_spaced_toxic_words_get_a_vote_after_fitting(spark):
    plain = "honest people write a plain text about ordinary things"
    rows = [(i, plain + (f" w{i} stupid v{i} loser" if i % 2 else "")) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scorer = toxicity.fit(docs, docs.selectExpr("doc_id as id", "cast(doc_id % 2 as int) as label"))
    for text in ("people write a s t u p i d things", 'people write "s t u p i d" things', "people write a l o s e r things"):
        assert toxicity.evidence(text.encode(), scorer.decoder, scorer.lexicon)[0] > 0
    assert toxicity.evidence(b"people write o r d i n a r y things", scorer.decoder, scorer.lexicon)[0] == 0


def test_scores_of_odd_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(25)] + [(3, None), (None, 1), (4, 7), (999, 1)], "id long, label int")
    scored = toxicity.score(odd_docs, toxicity.fit(odd_docs, labels)).collect()
    assert len(scored) == odd_docs.count() and all(0 <= r.score <= 1 for r in scored)
    nothing = labels.where("false")
    assert {r.score for r in toxicity.score(odd_docs, toxicity.fit(odd_docs, nothing)).collect()} == {0.5}
    assert toxicity.score(no_docs, toxicity.fit(no_docs, labels)).count() == 0
    scored = quality.score(odd_docs, labels).collect()
    assert len(scored) == odd_docs.count() and all(0 <= r.score <= 1 for r in scored)
    assert {r.score for r in quality.score(odd_docs, nothing).collect()} == {0.5}
    assert quality.score(no_docs, labels).count() == 0


def test_language_model_counts_every_text(spark):
    docs = spark.createDataFrame([("abc",), ("xab",), (None,)], "text string")
    k = lambda s: (toxicity._class(s[0]) * toxicity.CLASSES + toxicity._class(s[1])) * toxicity.CLASSES + toxicity._class(s[2])
    got = {r.key: r.n for r in toxicity.character_counts(docs.coalesce(1)).collect()}
    assert got[k("abc")] == 1 and got[k("xab")] == 1 and sum(got.values()) == len("abc\nxab\n") - 2


def test_discriminant_equals_the_densities():
    import numpy as np
    rng = np.random.default_rng(1)
    d = 3
    x0, x1 = rng.normal(size=(200, d)), rng.normal(size=(300, d)) * 2 + 1
    model = quality.Discriminant({c: (len(x), x.sum(axis=0), x.T @ x) for c, x in ((0, x0), (1, x1))}, to_pooled=0, to_diagonal=0)
    at = rng.normal(size=(20, d))

    def log_density(x, pts):
        cov = np.cov(x.T, bias=True) + 1e-9 * np.eye(d)
        diff = pts - x.mean(axis=0)
        return math.log(len(x) / 500) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff)
    want = 1 / (1 + np.exp(log_density(x0, at) - log_density(x1, at)))
    assert np.allclose(model.score(at), want)


def test_disguised_tokens_are_found_in_linear_time():
    import random
    import re
    import time

    old = re.compile(r"(?=.*[a-z])[a-z0-9@$!|+(€*#]*[0-9@$!|+(€*#][a-z0-9@$!|+(€*#]*")
    rng = random.Random(2)
    for _ in range(3000):
        token = "".join(rng.choice("ab1@#xé-(") for _ in range(rng.randrange(1, 7)))
        form = token.strip(toxicity.TRIM)
        assert (form in toxicity.disguised(token, {token})) >= (bool(form) and not form.isalpha() and bool(old.fullmatch(form)))
    began = time.time()
    assert toxicity.disguised("", {"a1" * 500_000 + "é"}) == set()
    assert time.time() - began < 5


def test_a_document_of_monstrous_words_fails(spark):
    rows = [(i, " ".join(f"{'x' * 19}{i:03d}{j:03d}" for j in range(60)), "en", "s") for i in range(200)]
    rows.append((999, " ".join("y" * 1997 + f"{j:03d}" for j in range(60)), "en", "s"))
    kept = {r.id: r.kept for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not kept[999] and all(kept[i] for i in range(200))


def plain_verdicts(rows):
    """Verdicts by the rule as stated: rows are (id, lang, source, base_failed, bins by metric)."""
    def quantile(values, num, den):
        return values[-(-len(values) * num // den) - 1]

    def points(values):
        values = sorted(values)
        return [quantile(values, 2 * i + 1, 2 * rules.POINTS) for i in range(rules.POINTS)] * rules.POINT_ROWS

    worded = [r for r in rows if r[4]["word_length"] is not None]
    kept = {}
    for i, lang, source, failed, bins in rows:
        ok = not failed
        for m, least in rules.METRICS.items():
            if not ok:
                break
            whole = points([r[4][m] for r in worded])
            of_lang = points([r[4][m] for r in worded if r[1] == lang] + whole)
            values = sorted([r[4][m] for r in worded if (r[1], r[2]) == (lang, source)] + of_lang)
            q1, q2, q3 = (quantile(values, n, 4) for n in (1, 2, 3))
            width = max(min(q2 - q1, q3 - q2), least) * rules.FENCE
            ok = q2 - width <= bins[m] <= q2 + width
        kept[i] = ok
    return kept


def test_verdicts_against_plain_quantiles(spark):
    rng = random.Random(8)
    rows = []
    for i in range(900):
        lang, source = rng.choice(["de", "en", None]), rng.choice(["hot"] * 6 + ["a", "b", None])
        size, sign, again = rng.randrange(1, 12), rng.choice([0, 0, 1, 6]), rng.choice([0, 0, 0, 20])
        words = [f"w{'x' * size}{rng.randrange(10 ** 6)}{'#' * sign}" for _ in range(rng.choice([0, 30, 60, 90]))]
        rows.append((i, "\n".join([" ".join(words[k:k + 9]) for k in range(0, len(words), 9)] + [" ".join(words[:9])] * again), lang, source))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    bins = {r.doc_id: r for r in rules.with_bins(rules.statistics(docs)).collect()}
    got = {r.id: r for r in rules.judge(docs).collect()}
    want = plain_verdicts([(i, lang, source, got[i].base_failed, {m: bins[i][m] for m in rules.METRICS}) for i, _, lang, source in rows])
    assert {i: r.kept for i, r in got.items()} == want
    assert 0 < sum(want.values()) < len(want)


def test_a_group_of_any_size_is_judged_without_a_step(spark):
    """Symbol-rich files of one source stay on either side of 100 rows, beside a larger plain source."""
    coded = " ".join(f"word{i:02d}{'%' * (i % 3)}" for i in range(80))
    prose = " ".join(f"word{i:02d}" for i in range(80))
    for n in (99, 100, 101, 300):
        rows = [(i, prose, "en", "plain") for i in range(300)] + [(1000 + i, coded, "en", "code") for i in range(n)]
        got = {r.id: r.kept for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
        assert all(got.values()), n
