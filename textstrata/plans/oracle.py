"""DuckDB oracle queries for the bindings, one per query name.

Written in a different form from the Spark plans: a plain ``row_number``
within each stratum instead of hash buckets, dense chi-square instead of the
sparse sum, anti-joins instead of the pick fold, ``unnest`` + join instead of
the word-count fold.
"""

from __future__ import annotations

from textstrata.functions.text import MULTI_INTERVAL_PATTERN
from textstrata.operators.clean import DEFAULT_LANGUAGE_WORDS
from textstrata.operators.labels import LITHOLOGY_LABELS, NONE_LABEL

SEED = 2023
TEST_SIZE = 0.15
CUTOFF = 0.1
TARGETS = ("HL", "NL1", "NL2")
#: How far the 64 elements are turned before they are summed into a target's ten logits.
TURNS = (0, 3, 7)
TEN = (*LITHOLOGY_LABELS, NONE_LABEL)

# RE2 forms of the normalisation class: RE2's \s is ASCII, so the other
# Unicode white-space characters (and U+000B, U+001C-U+001F) are listed.
_RE2_NOT_WORD_OR_SPACE = (r"[^\pL\pN_\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}"
                          r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _dbl(x: float) -> str:
    return f"CAST({_q(repr(float(x)))} AS DOUBLE)"


def _names_values() -> str:
    return "(VALUES " + ", ".join(f"({i}, {_q(n)})" for i, n in enumerate(TEN)) + ") AS names(label_id, label)"


def split_ctes(table_sql: str, key: str, stratum: str, test_size: float = TEST_SIZE,
               seed: int = SEED) -> str:
    """CTEs ending in ``split_rows`` (all columns of ``src`` + ``split``)."""
    return f"""
src AS ({table_sql}),
cls AS (SELECT {stratum} AS s, count(*) AS n_c FROM src GROUP BY 1),
tot AS (SELECT sum(n_c) AS n, CAST(ceil({_dbl(test_size)} * sum(n_c)) AS BIGINT) AS n_test FROM cls),
q AS (SELECT c.s, c.n_c, (c.n_c * (t.n - t.n_test)) // t.n AS base,
             (c.n_c * (t.n - t.n_test)) % t.n AS rem, t.n - t.n_test AS n_train
      FROM cls c CROSS JOIN tot t),
q2 AS (SELECT *, row_number() OVER (ORDER BY rem DESC, s NULLS FIRST) AS rk,
              n_train - sum(base) OVER () AS short FROM q),
quota AS (SELECT s, base + CASE WHEN rk <= short THEN 1 ELSE 0 END AS quota FROM q2),
ranked AS (SELECT src.*, row_number() OVER (PARTITION BY {stratum}
             ORDER BY md5('{seed}:' || CAST({key} AS VARCHAR)), {key}) AS rn_ FROM src),
split_rows AS (SELECT ranked.* EXCLUDE (rn_),
             CASE WHEN rn_ <= quota.quota THEN 'train' ELSE 'test' END AS split
             FROM ranked JOIN quota ON ranked.{stratum} IS NOT DISTINCT FROM quota.s)"""


_LABELLED_DOCS = ("SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), 'none') AS quality "
                  "FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
_LABELLED_DOCS_TEXT = ("SELECT d.doc_id, coalesce(d.text, 'none') AS text, "
                       "coalesce(CAST(l.quality AS VARCHAR), 'none') AS quality "
                       "FROM documents d JOIN labels l ON d.doc_id = l.doc_id")


def _dense_association(table: str, a: str, b: str, pair: str | None = None) -> str:
    pair_col = f"{_q(pair)} AS pair, " if pair else ""
    return f"""(WITH o AS (SELECT CAST({a} AS VARCHAR) AS a, CAST({b} AS VARCHAR) AS b, count(*) AS n
           FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2),
r AS (SELECT a, sum(n) AS rt FROM o GROUP BY a),
c AS (SELECT b, sum(n) AS ct FROM o GROUP BY b),
t AS (SELECT sum(n) AS nt, (SELECT count(*) FROM r) AS nr, (SELECT count(*) FROM c) AS nc FROM o),
e AS (SELECT CAST(r.rt AS DOUBLE) * c.ct / t.nt AS ex, coalesce(o.n, 0) AS obs
      FROM r CROSS JOIN c CROSS JOIN t LEFT JOIN o ON o.a = r.a AND o.b = c.b),
x AS (SELECT sum((obs - ex) * (obs - ex) / ex) AS chi2 FROM e)
SELECT {pair_col}CAST(t.nt AS BIGINT) AS n, round(x.chi2, 6) AS chi2,
       CASE WHEN least(t.nr, t.nc) > 1 THEN round(sqrt(x.chi2 / t.nt / (least(t.nr, t.nc) - 1)), 9) END AS cramers_v
FROM t CROSS JOIN x)"""


def _logits() -> str:
    """``embeddings`` with ``embedding`` replaced by ten sums per target over all 64 elements."""
    sums = [" + ".join(f"CAST(embedding[{j + 1}] AS DOUBLE)" for j in range(64) if (j + turn) % 10 == c)
            for turn in TURNS for c in range(10)]
    return f"(SELECT vec_id, label, [{', '.join(sums)}] AS embedding FROM embeddings)"


_LOGITS = _logits()
_ARGMAX = "list_position(list_slice(embedding, 1, 10), list_max(list_slice(embedding, 1, 10))) - 1"


def _target_scores() -> str:
    """Long table (vec_id, label, tgt, tord, label_id, score): softmax of 20x slices."""
    tv = "(VALUES " + ", ".join(f"({_q(t)}, {i})" for i, t in enumerate(TARGETS)) + ") AS tg(tgt, tord)"
    return f"""
lg AS (SELECT e.vec_id, e.label, tg.tgt, tg.tord, g.i AS label_id,
              CAST(e.embedding[tg.tord * 10 + g.i + 1] AS DOUBLE) * 20.0 AS x
       FROM {_LOGITS} e CROSS JOIN {tv} CROSS JOIN range(0, 10) AS g(i)),
ex AS (SELECT *, exp(x - max(x) OVER (PARTITION BY vec_id, tgt)) AS ee FROM lg),
sc AS (SELECT vec_id, label, tgt, tord, label_id, ee / sum(ee) OVER (PARTITION BY vec_id, tgt) AS score FROM ex)"""


def _picks(extra_key: str = "", cutoff_expr: str = _dbl(CUTOFF), source: str = "sc") -> str:
    """CTEs pick_HL, pick_NL1, pick_NL2 by anti-joins against earlier picks."""
    key = f"{extra_key}, " if extra_key else ""
    join_key = f" AND p.{extra_key} = s.{extra_key}" if extra_key else ""
    ctes = []
    for i, t in enumerate(TARGETS):
        anti = " ".join(
            f"AND NOT EXISTS (SELECT 1 FROM pick_{u} p WHERE p.vec_id = s.vec_id{join_key} AND p.label_id = s.label_id)"
            for u in TARGETS[:i])
        ctes.append(f"""pick_{t} AS (SELECT {key}vec_id, label_id, score FROM (
    SELECT s.*, row_number() OVER (PARTITION BY {key}s.vec_id ORDER BY s.score DESC, s.label_id) AS rn
    FROM {source} s WHERE s.tgt = {_q(t)} AND s.score >= {cutoff_expr} {anti}) WHERE rn = 1)""")
    return ",\n".join(ctes)


def _cutoffs_values(cutoffs) -> str:
    return "(VALUES " + ", ".join(f"({_dbl(c)})" for c in cutoffs) + ") AS cv(cutoff)"


def _sweep_sql(cutoffs) -> str:
    picks = _picks("cutoff", "s.cutoff", "scc")
    hits = " UNION ALL ".join(
        f"SELECT b.cutoff, {_q(t)} AS target, CASE WHEN coalesce(p.label_id, 9) = b.label THEN 1.0 ELSE 0.0 END AS hit "
        f"FROM base b LEFT JOIN pick_{t} p ON p.vec_id = b.vec_id AND p.cutoff = b.cutoff" for t in TARGETS)
    return f"""WITH {_target_scores()},
scc AS (SELECT sc.*, cv.cutoff FROM sc CROSS JOIN {_cutoffs_values(cutoffs)}),
base AS (SELECT e.vec_id, e.label, cv.cutoff FROM {_LOGITS} e CROSS JOIN {_cutoffs_values(cutoffs)}),
{picks},
hits AS ({hits}),
sweep AS (SELECT cutoff, target, avg(hit) AS accuracy FROM hits GROUP BY cutoff, target)"""


def _words_values() -> str:
    rows = [f"({_q(w)}, {_q(lang)})" for lang in sorted(DEFAULT_LANGUAGE_WORDS)
            for w in DEFAULT_LANGUAGE_WORDS[lang]]
    return "(VALUES " + ", ".join(rows) + ") AS wt(word, lang)"


def _detect_cte(table: str, key: str, text: str) -> str:
    """CTE ``det`` (key columns, detected): unique best-scoring language by word hits."""
    return f"""
tok AS (SELECT {key}, unnest(regexp_split_to_array(lower({text}), '[^\\pL]+')) AS word FROM {table}),
hitc AS (SELECT {key}, wt.lang, count(*) AS c FROM tok JOIN {_words_values()} ON tok.word = wt.word
         GROUP BY ALL),
best AS (SELECT {key}, max(c) AS mc FROM hitc GROUP BY ALL),
det AS (SELECT {key}, CASE WHEN count(*) = 1 THEN min(h.lang) END AS detected
        FROM hitc h JOIN best b USING ({key}) WHERE h.c = b.mc GROUP BY ALL)"""


def _idem_rows_sql(with_intervals: bool) -> str:
    inner = ("CASE WHEN role = 'assistant' THEN 'idem ' || text WHEN turn >= 5 THEN 'Idem, ' || text "
             "WHEN starts_with(text, 'L') THEN 'IDEM met idem ' || text ELSE text END")
    if with_intervals:
        inner = (f"CASE WHEN turn = 2 THEN 'van ' || CAST(turn AS VARCHAR) || ' tot ' || CAST(turn + 1 AS VARCHAR) "
                 f"|| ' m zand van 3 tot 4 m ' || text ELSE {inner} END")
    return f"SELECT conv_id, turn, {inner} AS t FROM conversations"


def _idem_ctes(with_intervals: bool, rows: str | None = None) -> str:
    return f"""
c AS ({rows or _idem_rows_sql(with_intervals)}),
f AS (SELECT *, coalesce(starts_with(lower(t), 'idem'), false) AS is_idem FROM c),
b AS (SELECT *, last_value(CASE WHEN NOT is_idem THEN t END IGNORE NULLS) OVER (
        PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base FROM f),
x AS (SELECT conv_id, turn,
        CASE WHEN is_idem AND base IS NOT NULL
             THEN base || CASE WHEN strpos(t, 'idem') > 0 THEN substr(t, strpos(t, 'idem') + 4) ELSE '' END
             ELSE t END AS text,
        (is_idem AND base IS NULL) AS idem_unresolved FROM b)"""


def _interval_texts_sql() -> str:
    s = "CAST(p_size AS VARCHAR)"
    return f"""SELECT p_partkey, CASE
  WHEN p_size <= 8 THEN 'van ' || {s} || ' tot ' || CAST(p_size + 10 AS VARCHAR) || ' m ' || p_name
       || ' van ' || CAST(p_size + 10 AS VARCHAR) || ' tot ' || CAST(p_size + 20 AS VARCHAR) || ' m klei'
  WHEN p_size <= 16 THEN '0,' || {s} || ' - 1,' || {s} || ' m ' || p_name
  WHEN p_size <= 24 THEN 'Kern ' || {s} || '.0-' || CAST(p_size + 1 AS VARCHAR) || '.0 m ' || p_name
  WHEN p_size <= 32 THEN p_name || ' 0,' || {s} || ' - 1,' || {s} || ' m'
  WHEN p_size <= 40 THEN 'KERNSTROOK ' || {s} || ' 3.0 m - 4,5m ' || p_name
  WHEN p_size <= 44 THEN 'VAN ' || {s} || ' TOT ' || CAST(p_size + 10 AS VARCHAR) || ' a van b tot c'
  ELSE p_name END AS text FROM part"""


def _multi_interval(text: str) -> str:
    return f"coalesce(regexp_matches({text}, {_q('^(?:' + MULTI_INTERVAL_PATTERN + ')')}, 'i'), false)"


# Words as hashed ids, truncated and framed for 512 positions.
_WORD_IDS = r"""
w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
      FROM documents),
ids AS (SELECT doc_id, [49406] || list_transform(ws[1:510],
               lambda x: CAST(CAST('0x' || substr(md5(x), 1, 8) AS BIGINT) % 49406 AS INTEGER)) || [49407] AS ids FROM w)"""


def _nb_ctes(train_sql: str, rows_sql: str, key: str, targets: dict[str, list[int]], grams: str) -> str:
    """CTEs ending in ``nb`` (key, target, label_id, score): balanced naive Bayes.

    ``train_sql`` gives text and a ``<target>`` label id column, ``rows_sql`` the
    key and text to score; ``grams`` is the list of tokens of a text.
    """
    stacked = " UNION ALL ".join(f"SELECT {_q(t)} AS target, {t} AS y, text FROM train_ WHERE {t} IS NOT NULL" for t in targets)
    return f"""
train_ AS ({train_sql}), rows_ AS ({rows_sql}),
lab AS ({stacked}),
cls_ AS (SELECT target, y, count(*) AS n_c FROM lab GROUP BY ALL),
w_ AS (SELECT *, sum(n_c) OVER (PARTITION BY target)::DOUBLE / (count(*) OVER (PARTITION BY target) * n_c) AS w,
              1.0::DOUBLE / count(*) OVER (PARTITION BY target) AS share FROM cls_),
tc AS (SELECT target, y, token, count(*) AS n FROM (SELECT target, y, unnest({grams}) AS token FROM lab) GROUP BY ALL),
tot_ AS (SELECT target, y, sum(n) AS t FROM tc GROUP BY ALL),
voc AS (SELECT DISTINCT target, token FROM tc),
size_ AS (SELECT target, count(*) AS v FROM voc GROUP BY ALL),
model AS (SELECT v.target, v.token, w.y, round(ln((w.w * coalesce(tc.n, 0)::DOUBLE + 1.0) / (w.w * coalesce(t.t, 0)::DOUBLE + 1.0 * s.v)) * 1000000)::BIGINT AS lw
          FROM voc v JOIN w_ w USING (target) JOIN size_ s USING (target)
          LEFT JOIN tot_ t ON t.target = v.target AND t.y = w.y LEFT JOIN tc ON tc.target = v.target AND tc.token = v.token AND tc.y = w.y),
hit AS (SELECT {key}, token, count(*) AS tf FROM (SELECT {key}, unnest({grams}) AS token FROM rows_) GROUP BY ALL),
sums AS (SELECT h.{key}, m.target, m.y, sum(h.tf * m.lw)::BIGINT AS s FROM hit h JOIN model m USING (token) GROUP BY ALL),
logs AS (SELECT r.{key}, w.target, w.y, (coalesce(s.s, 0) + round(ln(w.share) * 1000000)::BIGINT)::DOUBLE * 0.000001 AS x
         FROM rows_ r CROSS JOIN w_ w LEFT JOIN sums s ON s.{key} = r.{key} AND s.target = w.target AND s.y = w.y),
exps AS (SELECT *, exp(x - max(x) OVER (PARTITION BY {key}, target)) AS e FROM logs),
nb AS (SELECT {key}, target, y AS label_id, e / sum(e) OVER (PARTITION BY {key}, target) AS score FROM exps)"""


_NB_WORDS = r"regexp_extract_all(lower(text), '[\pL\pN]+')"
_LETTERS = r"regexp_extract_all(lower(text), '\pL+')"
_NB_EDGES = f"(list_transform({_LETTERS}, lambda w: '^' || left(w, 3)) || list_transform({_LETTERS}, lambda w: right(w, 3) || '$'))"


def _nb_documents() -> str:
    labelled = ("SELECT d.doc_id, coalesce(d.text, 'none') AS text, coalesce(CAST(l.quality AS VARCHAR), 'none') AS quality, "
                "CAST(l.toxic AS VARCHAR) AS toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
    train = "SELECT text, TRY_CAST(quality AS INTEGER) AS quality, TRY_CAST(toxic AS INTEGER) AS toxic FROM split_rows WHERE split = 'train'"
    return f"WITH {split_ctes(labelled, 'doc_id', 'quality')}, " + _nb_ctes(
        train, "SELECT doc_id, text FROM documents", "doc_id", {"quality": [0, 1], "toxic": [0, 1]}, _NB_WORDS)


def _epochs_sql(rate: float) -> str:
    """Ten full-gradient epochs in a recursive query: one list of 10 x 65 weights per epoch."""
    return f"""
WITH RECURSIVE rows_ AS (
    SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) || [1.0::DOUBLE] AS x, left(md5('{SEED}:' || vec_id), 1) < '4' AS test FROM embeddings
), cls AS (SELECT label, count(*) AS n_c FROM rows_ WHERE NOT test GROUP BY ALL),
wt AS (SELECT label, (SELECT sum(n_c) FROM cls)::DOUBLE / ((SELECT count(*) FROM cls) * n_c) AS w FROM cls),
train_ AS (SELECT vec_id, label, x, w FROM rows_ JOIN wt USING (label) WHERE NOT test),
total AS (SELECT sum(w) AS t FROM train_),
weights(epoch, k, w) AS (
    SELECT 0, k, list_transform(range(65), lambda i: 0.0::DOUBLE) FROM range(10) g(k)
    UNION ALL
    (WITH z AS (SELECT r.vec_id, r.label, r.x, r.w, m.epoch, m.k, m.w AS wk, list_inner_product(r.x, m.w) AS z FROM train_ r CROSS JOIN weights m WHERE m.epoch < 10),
          e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM z),
          p AS (SELECT *, (e / sum(e) OVER (PARTITION BY vec_id) - CASE WHEN label = k THEN 1.0 ELSE 0.0 END) * w AS off FROM e),
          g AS (SELECT epoch, k, i, any_value(wk)[i + 1] - {_dbl(rate)} / (SELECT t FROM total) * sum(off * x[i + 1]) AS v FROM p CROSS JOIN range(65) d(i) GROUP BY epoch, k, i)
     SELECT epoch + 1, k, list(v ORDER BY i) FROM g GROUP BY epoch, k)
), logits AS (
    SELECT m.epoch, r.vec_id, r.label, r.test, m.k, list_inner_product(r.x, m.w) AS z FROM rows_ r CROSS JOIN weights m WHERE m.epoch > 0
), choice AS (
    SELECT epoch, vec_id, label, test, arg_max(k, {{'z': z, 'k': -k}}) AS k, max(z) + ln(sum(exp(z - top))) - 0.0 AS norm, max(CASE WHEN k = label THEN z END) AS own
    FROM (SELECT *, max(z) OVER (PARTITION BY epoch, vec_id) AS top FROM logits) GROUP BY ALL
), measured AS (
    SELECT epoch, sum(w * (norm - own)) FILTER (NOT test) / (SELECT t FROM total) AS loss,
           count(*) FILTER (test AND k = label)::DOUBLE / count(*) FILTER (test) AS accuracy, count(*) FILTER (test) AS n_test
    FROM choice LEFT JOIN wt USING (label) GROUP BY epoch
)
SELECT epoch::INTEGER AS epoch, round(loss, 9) AS loss, round(accuracy, 12) AS accuracy, n_test,
       row_number() OVER (ORDER BY accuracy DESC, epoch) = 1 AS best FROM measured
"""


def _sweep_counts_sql(cutoffs, own_split: bool = False) -> str:
    """CTEs ending in ``cnt`` (cutoff, target, truth, pick, n) and ``met`` (cutoff, target and three metrics)."""
    own = {t: f" WHERE b.vec_id % 3 = {i}" if own_split else "" for i, t in enumerate(TARGETS)}
    hits = " UNION ALL ".join(
        f"SELECT b.cutoff, {_q(t)} AS target, b.label AS truth, coalesce(p.label_id, 9)::INTEGER AS pick "
        f"FROM base b LEFT JOIN pick_{t} p ON p.vec_id = b.vec_id AND p.cutoff = b.cutoff{own[t]}" for t in TARGETS)
    return f"""WITH {_target_scores()},
scc AS (SELECT sc.*, cv.cutoff FROM sc CROSS JOIN {_cutoffs_values(cutoffs)}),
base AS (SELECT e.vec_id, e.label, cv.cutoff FROM {_LOGITS} e CROSS JOIN {_cutoffs_values(cutoffs)}),
{_picks("cutoff", "s.cutoff", "scc")},
cnt AS (SELECT cutoff, target, truth, pick, count(*) AS n FROM ({hits}) GROUP BY ALL),
lab AS (SELECT cutoff, target, k, sum(t) AS t, sum(p) AS p, sum(d) AS d FROM (
    SELECT cutoff, target, truth AS k, n AS t, 0 AS p, CASE WHEN truth = pick THEN n ELSE 0 END AS d FROM cnt
    UNION ALL SELECT cutoff, target, pick, 0, n, 0 FROM cnt) GROUP BY ALL),
met AS (SELECT cutoff, target, sum(d)::DOUBLE / sum(t) AS accuracy, avg(d::DOUBLE / t) FILTER (t > 0) AS balanced_accuracy,
    CASE WHEN (sum(t)::DOUBLE * sum(t) - sum(p::DOUBLE * p)) * (sum(t)::DOUBLE * sum(t) - sum(t::DOUBLE * t)) = 0 THEN 0.0
         ELSE (sum(d)::DOUBLE * sum(t) - sum(t::DOUBLE * p)) / (sqrt(sum(t)::DOUBLE * sum(t) - sum(p::DOUBLE * p)) * sqrt(sum(t)::DOUBLE * sum(t) - sum(t::DOUBLE * t))) END AS mcc
    FROM lab GROUP BY ALL)"""


_ROUNDED = "SELECT cutoff, target, round(accuracy, 9) AS accuracy, round(balanced_accuracy, 9) AS balanced_accuracy, round(mcc, 9) AS mcc FROM met"


def _model_queries(cutoffs, fine_cutoffs, languages, rate) -> dict[str, str]:
    picked = ", ".join(f"coalesce(CAST(p_{t}.label_id AS VARCHAR), 'none') AS {t}_label, coalesce(round(p_{t}.score, 9), -1.0) AS {t}_score" for t in ("quality", "toxic"))
    lang = "CASE lang " + " ".join(f"WHEN {_q(n)} THEN {i}" for n, i in languages.items()) + " END"
    name = "CASE label_id " + " ".join(f"WHEN {i} THEN {_q(n)}" for n, i in languages.items()) + " END"
    best = " UNION ALL ".join(f"SELECT {_q(m)} AS metric, arg_max(cutoff, {{'v': {m}, 'c': -cutoff}}) AS cutoff, max({m}) AS value FROM mean_" for m in ("accuracy", "balanced_accuracy", "mcc"))
    return {
        "train_and_score_nb": f"""{_nb_documents()}
SELECT doc_id, """ + ", ".join(f"round(max(score) FILTER (target = '{t}' AND label_id = {i}), 9) AS {t}_{i}" for t in ("quality", "toxic") for i in (0, 1)) + """
FROM nb GROUP BY doc_id""",
        "batch_predict_nb": f"""{_nb_documents()},
p_quality AS (SELECT doc_id, arg_max(label_id, {{'s': score, 'l': -label_id}}) AS label_id, max(score) AS score FROM nb WHERE target = 'quality' AND score >= {_dbl(CUTOFF)} GROUP BY doc_id),
p_toxic AS (SELECT n.doc_id, arg_max(n.label_id, {{'s': n.score, 'l': -n.label_id}}) AS label_id, max(n.score) AS score
    FROM nb n LEFT JOIN p_quality q ON q.doc_id = n.doc_id WHERE n.target = 'toxic' AND n.score >= {_dbl(CUTOFF)} AND n.label_id IS DISTINCT FROM q.label_id GROUP BY n.doc_id)
SELECT d.doc_id, {picked} FROM documents d LEFT JOIN p_quality ON p_quality.doc_id = d.doc_id LEFT JOIN p_toxic ON p_toxic.doc_id = d.doc_id""",
        "best_epoch": _epochs_sql(rate),
        "language_profiles": "WITH " + _nb_ctes(
            f"SELECT text, {lang} AS lang FROM documents WHERE left(md5('{SEED}:' || doc_id), 1) < '8'", "SELECT doc_id, text FROM documents", "doc_id", {"lang": []}, _NB_EDGES) + f""",
det AS (SELECT doc_id, arg_max({name}, {{'s': score, 'l': -label_id}}) AS detected FROM nb GROUP BY doc_id)
SELECT d.doc_id, d.lang, CASE WHEN regexp_matches(lower(d.text), '\\pL') THEN det.detected END AS detected
FROM documents d JOIN det ON det.doc_id = d.doc_id WHERE NOT (regexp_matches(lower(d.text), '\\pL') AND det.detected = 'fr')""",
        "cutoff_metrics": f"{_sweep_counts_sql(cutoffs)} {_ROUNDED}",
        "tune_cutoffs": f"{_sweep_counts_sql(cutoffs, own_split=True)} {_ROUNDED}",
        "best_cutoffs": f"""{_sweep_counts_sql(cutoffs)},
mean_ AS (SELECT cutoff, round(avg(accuracy), 9) AS accuracy, round(avg(balanced_accuracy), 9) AS balanced_accuracy, round(avg(mcc), 9) AS mcc FROM met GROUP BY cutoff)
{best}""",
        "sweep_counts_fine": f"{_sweep_counts_sql(fine_cutoffs)} SELECT cutoff, target, truth, pick, n FROM cnt",
    }


def oracle_sql(cutoffs, fine_cutoffs, languages, epoch_rate) -> dict[str, str]:
    base = _base_queries(cutoffs)
    masked = base["mask_words"].replace(f"'{SEED}:0:'", f"'{SEED}:1:'")
    pretrain = f"""SELECT m.doc_id, s.split, m.ids_md5, m.labels_md5 FROM ({masked}) m JOIN ({base['unstratified_split']}) s USING (doc_id)"""
    return _model_queries(cutoffs, fine_cutoffs, languages, epoch_rate) | base | {"pretrain_words": pretrain, "stream_once": base["pick_labels"]}


def _base_queries(cutoffs) -> dict[str, str]:
    names_case = "CASE label " + " ".join(f"WHEN {i} THEN {_q(n)}" for i, n in enumerate(TEN)) + " END"
    picks_select = ", ".join(
        f"coalesce(n_{t}.label, 'none') AS {t}_label, coalesce(round(p_{t}.score, 9), -1.0) AS {t}_score"
        for t in TARGETS)
    picks_joins = " ".join(
        f"LEFT JOIN pick_{t} p_{t} ON p_{t}.vec_id = e.vec_id "
        f"LEFT JOIN {_names_values().replace('names(', f'n_{t}(')} ON n_{t}.label_id = p_{t}.label_id"
        for t in TARGETS)
    return {
        "class_weights": f"""
WITH {split_ctes(_LABELLED_DOCS, 'doc_id', 'quality')},
counts AS (SELECT CASE quality WHEN '0' THEN 0 WHEN '1' THEN 1 END AS label_id, count(*) AS n_c
           FROM split_rows WHERE split = 'train' GROUP BY 1),
classes AS (SELECT * FROM (VALUES (0, '0'), (1, '1')) v(label_id, label))
SELECT c.label_id, c.label, CAST(coalesce(k.n_c, 0) AS BIGINT) AS n,
       CAST(sum(k.n_c) OVER () AS DOUBLE) / CAST(count(k.n_c) OVER () * k.n_c AS DOUBLE) AS weight
FROM classes c LEFT JOIN counts k ON c.label_id = k.label_id""",

        "fill_and_map_labels": """
SELECT d.doc_id, coalesce(d.text, 'none') AS text,
       coalesce(CAST(l.quality AS VARCHAR), 'none') AS quality,
       coalesce(CAST(l.toxic AS VARCHAR), 'none') AS toxic,
       CASE coalesce(CAST(l.quality AS VARCHAR), 'none') WHEN '0' THEN 0 WHEN '1' THEN 1 END AS quality_id,
       CASE coalesce(CAST(l.toxic AS VARCHAR), 'none') WHEN '0' THEN 0 WHEN '1' THEN 1 WHEN 'none' THEN 2 END AS toxic_id
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",

        "labels_by_first_seen": """
SELECT lang AS label, CAST(row_number() OVER (ORDER BY first_seen, lang) - 1 AS INTEGER) AS label_id
FROM (SELECT lang, min(doc_id) AS first_seen FROM documents GROUP BY lang)""",

        "export_label_names": f"SELECT vec_id, label, {names_case} AS label_name FROM embeddings",

        "normalise_text": f"""
SELECT doc_id, md5(regexp_replace(lower(text), {_q(_RE2_NOT_WORD_OR_SPACE)}, '', 'g')) AS text_md5,
       CAST(length(regexp_replace(lower(text), {_q(_RE2_NOT_WORD_OR_SPACE)}, '', 'g')) AS BIGINT) AS n_chars_norm
FROM documents""",

        "drop_multi_interval": f"SELECT * FROM ({_interval_texts_sql()}) WHERE NOT {_multi_interval('text')}",

        "drop_language": "SELECT doc_id, lang FROM documents WHERE lang IS DISTINCT FROM 'fr'",

        "drop_language_words": f"""
WITH {_detect_cte('documents', 'doc_id', 'text').lstrip()}
SELECT d.doc_id, d.lang, det.detected FROM documents d LEFT JOIN det ON det.doc_id = d.doc_id
WHERE det.detected IS DISTINCT FROM 'fr'""",

        "idem_expand": f"WITH {_idem_ctes(False).lstrip()} SELECT * FROM x",

        "clean_chain": f"""
WITH {_idem_ctes(True).lstrip()},
{_detect_cte('x', 'conv_id, turn', 'text').lstrip()}
SELECT x.* FROM x LEFT JOIN det ON det.conv_id = x.conv_id AND det.turn = x.turn
WHERE det.detected IS DISTINCT FROM 'fr' AND NOT {_multi_interval('x.text')}""",

        "stratified_split": f"""
WITH {split_ctes('SELECT o_orderkey, o_orderpriority FROM orders', 'o_orderkey', 'o_orderpriority')}
SELECT o_orderkey, o_orderpriority, split FROM split_rows""",

        "unstratified_split": f"""
WITH {split_ctes('SELECT doc_id, 0 AS one FROM documents', 'doc_id', 'one')}
SELECT doc_id, split FROM split_rows""",

        "split_counts": f"""
WITH {split_ctes('SELECT o_orderkey, o_orderpriority FROM orders', 'o_orderkey', 'o_orderpriority')}
SELECT split, count(*) AS n FROM split_rows GROUP BY split""",

        "exact_sample": f"""
SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders
ORDER BY md5('{SEED}:' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 500""",

        "exact_sample_large": f"""
SELECT o_orderkey, o_orderpriority FROM orders
ORDER BY md5('{SEED}:' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 12000""",

        "seeded_shuffle": f"""
SELECT o_orderkey, CAST(row_number() OVER (
    ORDER BY md5('{SEED}:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) - 1 AS BIGINT) AS position
FROM orders""",

        "minority_select_wide": f"""
WITH d AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
             PARTITION BY p_brand, p_type, p_name ORDER BY p_partkey) AS rn FROM part) WHERE rn = 1),
g AS (SELECT p_brand, p_type, count(*) AS c FROM d
      WHERE p_brand IS NOT NULL AND p_type IS NOT NULL GROUP BY ALL),
gc AS (SELECT *, sum(c) OVER (ORDER BY c, p_brand, p_type
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM g),
minor AS (SELECT d.*, 'minor' AS pool FROM d SEMI JOIN (SELECT * FROM gc WHERE cum <= 225) k USING (p_brand, p_type)),
rnd AS (SELECT d.*, 'random' AS pool FROM d SEMI JOIN (SELECT * FROM gc WHERE cum > 150) k USING (p_brand, p_type)
        ORDER BY md5('{SEED}:' || CAST(p_partkey AS VARCHAR)), p_partkey LIMIT 75)
SELECT * FROM minor UNION ALL SELECT * FROM rnd""",

        "idem_chunks": "WITH " + _idem_ctes(False, "SELECT conv_id % 3 AS conv_id, conv_id * 1000 + turn AS turn, t FROM ("
                                            + _idem_rows_sql(False) + ")").lstrip()
        + " SELECT conv_id AS site, turn AS place, text, idem_unresolved FROM x",

        "text_hook": """
SELECT doc_id, coalesce(lang, 'none') AS lang,
       md5(regexp_replace(coalesce(text, 'none'), '[0-9]', '#', 'g')) AS text_md5 FROM documents""",

        "drop_columns": "SELECT doc_id, lang, source FROM documents",

        "read_delimited_inferred": """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS price,
       CAST(o_orderkey % 100 AS VARCHAR) || 'D' AS code,
       row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id FROM orders""",

        "dataset_job": f"""
WITH {_WORD_IDS.lstrip().replace("w AS", "words_ AS", 1).replace("FROM w)", "FROM words_)")}, {split_ctes(_LABELLED_DOCS_TEXT, 'doc_id', 'quality')},
n AS (SELECT quality, count(*) AS n_c FROM split_rows WHERE split = 'train' AND quality <> 'none' GROUP BY quality),
w AS (SELECT quality, round(CAST(sum(n_c) OVER () AS DOUBLE) / CAST(count(n_c) OVER () * n_c AS DOUBLE), 9) AS weight
      FROM n)
SELECT s.doc_id, md5(s.text) AS text_md5, CASE s.quality WHEN '0' THEN 0 WHEN '1' THEN 1 END AS label, s.split, w.weight,
       md5(array_to_string(ids.ids || list_transform(range(512 - len(ids.ids)), lambda x: 0), ',')) AS ids_md5
FROM split_rows s LEFT JOIN w USING (quality) JOIN ids USING (doc_id)""",

        "stream_pick": f"""
WITH {_target_scores().lstrip()},
{_picks()}
SELECT e.vec_id, {picks_select} FROM {_LOGITS} e {picks_joins}""",

        "encode_words": f"""
WITH {_WORD_IDS.lstrip()}
SELECT doc_id, md5(array_to_string(ids || list_transform(range(512 - len(ids)), lambda x: 0), ',')) AS ids_md5,
       md5(array_to_string(list_transform(range(512), lambda x: CASE WHEN x < len(ids) THEN 1 ELSE 0 END), ',')) AS mask_md5
FROM ids""",

        "encode_pieces": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')[1:510] AS ws
      FROM documents),
b AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[\x20\x09-\x0D]+')) AS w FROM benchmark),
parts AS (SELECT w FROM b WHERE w <> '' UNION SELECT substr(w, 1, n) FROM b, range(1, 5) t(n) WHERE w <> ''),
vocab AS (SELECT piece, CAST('0x' || substr(md5(piece), 1, 7) AS INTEGER) AS id
          FROM (SELECT w AS piece FROM parts UNION SELECT '##' || w FROM parts)),
dict AS (SELECT DISTINCT unnest(ws) AS word FROM w),
starts AS (SELECT word, unnest(range(1, length(word) + 1)) AS s FROM dict WHERE length(word) <= 100),
tried AS (SELECT word, s, unnest(range(1, least(length(word) - s + 1, (SELECT max(length(piece)) FROM vocab)) + 1)) AS n FROM starts),
m AS (SELECT t.word, t.s, max(t.n) AS n, arg_max(v.id, t.n) AS id
      FROM tried t JOIN vocab v ON v.piece = CASE WHEN t.s > 1 THEN '##' ELSE '' END || substr(t.word, t.s, t.n) GROUP BY t.word, t.s),
seg AS (SELECT word, 1 AS s, CAST([] AS INTEGER[]) AS ids FROM dict
        UNION ALL SELECT g.word, g.s + m.n, list_append(g.ids, m.id) FROM seg g JOIN m ON m.word = g.word AND m.s = g.s),
cut AS (SELECT d.word, coalesce(any_value(g.ids), [-1]) AS ids
        FROM dict d LEFT JOIN seg g ON g.word = d.word AND g.s = length(d.word) + 1 GROUP BY d.word),
p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
j AS (SELECT p.doc_id, flatten(list(c.ids ORDER BY p.pos)) AS ids FROM p JOIN cut c USING (word) GROUP BY p.doc_id),
ids AS (SELECT w.doc_id, [49406] || coalesce(j.ids, [])[1:510] || [49407] AS ids FROM w LEFT JOIN j USING (doc_id))
SELECT doc_id, CAST(len(list_filter(ids, lambda x: x = -1)) AS BIGINT) AS n_unknown,
       md5(array_to_string(ids || list_transform(range(512 - len(ids)), lambda x: 0), ',')) AS ids_md5,
       md5(array_to_string(list_transform(range(512), lambda x: CASE WHEN x < len(ids) THEN 1 ELSE 0 END), ',')) AS mask_md5
FROM ids""",

        "mask_words": f"""
WITH {_WORD_IDS.lstrip()},
p AS (SELECT doc_id, unnest(ids) AS id, generate_subscripts(ids, 1) - 1 AS pos, len(ids) AS n FROM ids),
h AS (SELECT *, md5('{SEED}:0:' || CAST(doc_id AS VARCHAR) || ':' || CAST(pos AS VARCHAR)) AS h FROM p),
u AS (SELECT *, CAST(CAST('0x' || substr(h, 1, 8) AS BIGINT) AS DOUBLE) / 4294967296 AS u1,
             CAST(CAST('0x' || substr(h, 9, 8) AS BIGINT) AS DOUBLE) / 4294967296 AS u2,
             CAST(CAST('0x' || substr(h, 17, 8) AS BIGINT) AS DOUBLE) / 4294967296 AS u3 FROM h),
m AS (SELECT doc_id, pos, id, pos > 0 AND pos < n - 1 AND u1 < CAST('0.15' AS DOUBLE) AS chosen,
             CASE WHEN u2 < CAST('0.8' AS DOUBLE) THEN 49408
                  WHEN u2 < CAST('0.9' AS DOUBLE) THEN CAST(floor(u3 * 49408) AS INTEGER) ELSE id END AS new FROM u)
SELECT doc_id, count(*) AS n_ids, count(*) FILTER (chosen) AS n_targets,
       md5(string_agg(CAST(CASE WHEN chosen THEN new ELSE id END AS VARCHAR), ',' ORDER BY pos)) AS ids_md5,
       md5(string_agg(CAST(CASE WHEN chosen THEN id ELSE -100 END AS VARCHAR), ',' ORDER BY pos)) AS labels_md5
FROM m GROUP BY doc_id""",

        "minority_select": f"""
WITH d AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
             PARTITION BY p_brand, p_type, p_name ORDER BY p_partkey) AS rn FROM part) WHERE rn = 1),
g AS (SELECT p_brand, p_type, count(*) AS c FROM d
      WHERE p_brand IS NOT NULL AND p_type IS NOT NULL GROUP BY ALL),
gc AS (SELECT *, sum(c) OVER (ORDER BY c, p_brand, p_type
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM g),
minor AS (SELECT d.*, 'minor' AS pool FROM d WHERE (p_brand, p_type) IN
            (SELECT (p_brand, p_type) FROM gc WHERE cum <= 90)),
rnd AS (SELECT d.*, 'random' AS pool FROM d WHERE (p_brand, p_type) IN
            (SELECT (p_brand, p_type) FROM gc WHERE cum > 90 - 210)
        ORDER BY md5('{SEED}:' || CAST(p_partkey AS VARCHAR)), p_partkey LIMIT 210)
SELECT * FROM minor UNION ALL SELECT * FROM rnd""",

        "replicate_by_count": """
SELECT p_brand, p_type, n, unnest(range(n)) AS copy
FROM (SELECT p_brand, p_type, count(*) AS n FROM part
      WHERE p_brand IS NOT NULL AND p_type IS NOT NULL GROUP BY ALL)""",

        "crosstab": """
SELECT p_type, p_brand, count(*) AS n FROM part
WHERE p_type IS NOT NULL AND p_brand IS NOT NULL GROUP BY ALL""",

        "association": "SELECT * FROM " + _dense_association("part", "p_type", "p_brand"),

        "association_orders": "SELECT * FROM " + _dense_association("orders", "o_orderstatus", "o_orderpriority"),

        "association_pairs": " UNION ALL ".join(
            "SELECT * FROM " + _dense_association("lineitem", a, b, f"{a}|{b}")
            for a, b in (("l_returnflag", "l_linestatus"), ("l_returnflag", "l_linenumber"),
                         ("l_linestatus", "l_linenumber"))),

        "confusion_counts": f"""
WITH p AS (SELECT label AS y_true, CAST({_ARGMAX} AS INTEGER) AS y_pred FROM {_LOGITS}),
l AS (SELECT y_true AS v FROM p UNION SELECT y_pred FROM p),
c AS (SELECT y_true, y_pred, count(*) AS n FROM p GROUP BY ALL)
SELECT a.v AS y_true, b.v AS y_pred, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM l a CROSS JOIN l b LEFT JOIN c ON c.y_true = a.v AND c.y_pred = b.v""",

        "confusion_normalised": f"""
WITH p AS (SELECT label AS y_true, CAST({_ARGMAX} AS INTEGER) AS y_pred FROM {_LOGITS}),
l AS (SELECT y_true AS v FROM p UNION SELECT y_pred FROM p),
c AS (SELECT y_true, y_pred, count(*) AS n FROM p GROUP BY ALL),
r AS (SELECT y_true, count(*) AS rt FROM p GROUP BY ALL)
SELECT a.v AS y_true, b.v AS y_pred, CAST(coalesce(c.n, 0) AS BIGINT) AS n,
       round(CASE WHEN r.rt > 0 THEN coalesce(c.n, 0) / r.rt ELSE 0.0 END, 12) AS value
FROM l a CROSS JOIN l b LEFT JOIN c ON c.y_true = a.v AND c.y_pred = b.v LEFT JOIN r ON r.y_true = a.v""",

        "argmax_accuracy": f"""
SELECT avg(CASE WHEN {_ARGMAX} = label THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS n FROM {_LOGITS}""",

        "weighted_ce": f"""
WITH w AS (SELECT label, CAST((SELECT count(*) FROM {_LOGITS}) AS DOUBLE)
                  / (CAST((SELECT count(DISTINCT label) FROM {_LOGITS}) AS DOUBLE) * count(*)) AS weight
           FROM {_LOGITS} GROUP BY label),
x AS (SELECT e.vec_id, e.label, CAST(v.x AS DOUBLE) AS x, v.i
      FROM {_LOGITS} e, unnest(list_slice(e.embedding, 1, 10)) WITH ORDINALITY AS v(x, i)),
lse AS (SELECT vec_id, label, m + ln(s) AS lse FROM (
          SELECT vec_id, label, max(m) AS m, sum(ex) AS s FROM (
            SELECT vec_id, label, max(x) OVER (PARTITION BY vec_id) AS m,
                   exp(x - max(x) OVER (PARTITION BY vec_id)) AS ex FROM x) GROUP BY vec_id, label)),
nll AS (SELECT l.vec_id, l.label, l.lse - CAST(e.embedding[l.label + 1] AS DOUBLE) AS nll
        FROM lse l JOIN {_LOGITS} e ON e.vec_id = l.vec_id)
SELECT round(sum(w.weight * nll.nll) / sum(w.weight), 9) AS loss, count(*) AS n
FROM nll JOIN w ON w.label = nll.label""",

        "metric_trio": f"""
WITH p AS (SELECT label AS t, CAST({_ARGMAX} AS INTEGER) AS pr FROM {_LOGITS}),
k AS (SELECT v FROM (SELECT t AS v FROM p UNION SELECT pr FROM p)),
per AS (SELECT k.v, CAST((SELECT count(*) FROM p WHERE p.t = k.v) AS DOUBLE) AS tk,
               CAST((SELECT count(*) FROM p WHERE p.pr = k.v) AS DOUBLE) AS pk,
               CAST((SELECT count(*) FROM p WHERE p.t = k.v AND p.pr = k.v) AS DOUBLE) AS dk FROM k),
s AS (SELECT sum(tk) AS s, sum(dk) AS c, sum(tk * pk) AS tp, sum(pk * pk) AS pp, sum(tk * tk) AS tt,
             avg(CASE WHEN tk > 0 THEN dk / tk END) AS bal FROM per)
SELECT round(c / s, 12) AS accuracy, round(bal, 12) AS balanced_accuracy,
       round(CASE WHEN (s * s - pp) * (s * s - tt) = 0 THEN 0.0
                  ELSE (c * s - tp) / sqrt((s * s - tt) * (s * s - pp)) END, 12) AS mcc FROM s""",

        "pick_labels": f"""
WITH {_target_scores().lstrip()},
{_picks()}
SELECT e.vec_id, {picks_select} FROM {_LOGITS} e {picks_joins}""",

        "cutoff_sweep": f"{_sweep_sql(cutoffs)} SELECT cutoff, target, round(accuracy, 12) AS accuracy FROM sweep",

        "cutoff_wide": f"""{_sweep_sql(cutoffs)}
SELECT cutoff, """ + ", ".join(
            f"round(max(CASE WHEN target = {_q(t)} THEN accuracy END), 12) AS {t}" for t in TARGETS) +
        " FROM sweep GROUP BY cutoff",

        "csv_round_trip": "SELECT doc_id, text, lang, source, n_chars FROM documents",

        "split_sets": f"""
WITH {split_ctes(_LABELLED_DOCS_TEXT, 'doc_id', 'quality')}
SELECT text, CASE quality WHEN '0' THEN 0 WHEN '1' THEN 1 END AS label FROM split_rows WHERE split = 'test'""",

        "weights_text": f"""
WITH {split_ctes(_LABELLED_DOCS, 'doc_id', 'quality')},
counts AS (SELECT CASE quality WHEN '0' THEN 0 WHEN '1' THEN 1 END AS label_id, count(*) AS n_c
           FROM split_rows WHERE split = 'train' GROUP BY 1),
w AS (SELECT label_id, CAST(sum(n_c) OVER () AS DOUBLE) / CAST(count(n_c) OVER () * n_c AS DOUBLE) AS weight
      FROM counts)
SELECT string_agg(printf('%10.5f', weight), ' ' ORDER BY label_id) AS value FROM w""",

        "export_splits": f"""
WITH {split_ctes(_LABELLED_DOCS_TEXT, 'doc_id', 'quality')}
SELECT doc_id AS row_id, text, quality AS label, split FROM split_rows""",

        "best_cutoff": f"""{_sweep_sql(cutoffs)}
SELECT cutoff, round(avg(accuracy), 12) AS mean_accuracy FROM sweep GROUP BY cutoff
ORDER BY mean_accuracy DESC, cutoff LIMIT 1""",

        "group_sizes": """
SELECT p_brand, p_type, count(*) AS count,
       CAST(sum(count(*)) OVER (ORDER BY count(*), p_brand, p_type
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum
FROM part WHERE p_brand IS NOT NULL AND p_type IS NOT NULL GROUP BY p_brand, p_type""",

        "dedup_first": """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
    PARTITION BY p_brand, p_type, p_name ORDER BY p_partkey) AS rn FROM part) WHERE rn = 1""",

        "semi_join_keys": """
SELECT l_orderkey, l_partkey, l_linenumber, l_quantity FROM lineitem
WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'SMALL')""",

        "top_labels": f"""
WITH {_target_scores().lstrip()},
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id, tgt ORDER BY score DESC, label_id) AS rk FROM sc),
n AS (SELECT * FROM {_names_values()})
SELECT e.vec_id, """ + ", ".join(
            f"max(CASE WHEN r.tgt = {_q(t)} AND r.rk = 1 THEN n.label END) AS {t}_top, "
            f"max(CASE WHEN r.tgt = {_q(t)} AND r.rk = 1 THEN round(r.score, 9) END) AS {t}_top_score, "
            f"max(CASE WHEN r.tgt = {_q(t)} AND r.rk = 2 THEN n.label END) AS {t}_second, "
            f"CAST(count(CASE WHEN r.tgt = {_q(t)} AND r.score >= {_dbl(CUTOFF)} THEN 1 END) AS INTEGER) AS {t}_n_above"
            for t in TARGETS) + f"""
FROM {_LOGITS} e JOIN r ON r.vec_id = e.vec_id JOIN n ON n.label_id = r.label_id GROUP BY e.vec_id""",
    }
