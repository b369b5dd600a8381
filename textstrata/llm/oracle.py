"""DuckDB SQL of the queries that SQL can express whole."""

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op1_topk"] = """
WITH v AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.r <> q.r
), r AS (
    SELECT query_id, row_number() OVER (PARTITION BY s.r ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""

_CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")
_ESCAPES = " + ".join(f"(length(t) - length(replace(t, '{c}', ''))) // {len(c)}" for c in ("\\", *_CONTROLS))

ORACLE_SQL["op6_chat"] = f"""
WITH turns AS (
    SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), s AS (
    SELECT *, length(t) + {_ESCAPES}
        + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 9 WHEN 'system' THEN 20 ELSE length(role) + 24 END AS chars
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(t)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""


# ------------------------------------------------ CRC-32 of a text, from a list of 256 values made by the usual rule
_CRC_TABLE = """(SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) r(i)))"""


def _crc(text: str, table: str) -> str:
    """CRC-32 of the UTF-8 bytes of a SQL text, looked up in a list column."""
    byte = f"CAST('0x' || substr(hex(encode({text})), 2 * k + 1, 2) AS BIGINT)"
    steps = f"list_transform(range(octet_length(encode({text}))), lambda k: {byte})"
    return f"xor(4294967295, list_reduce({steps}, lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1]), 4294967295))"


def _moves() -> str:
    """(role, fault, from, to, cost, letters, inserted lines, line): up to three inserted rows, then one edit.

    States: 0 start, 1 after s, 2 after u, 3 after a; roles s u a o; faults c t x (must go).
    """
    after = {0: 2, 1: 2, 2: 3, 3: 2}
    name = {2: "user", 3: "assistant"}
    out = []
    for role in "suao":
        for fault in "ctx":
            late = int(fault == "t")
            for start in range(4):
                at, lines = start, ""
                for n in range(4):
                    edits = [(at, 3, "D", "")]
                    if fault != "x":
                        edits.append((after[at], 2 + late, "R", name[after[at]]))
                        stays = {"s": (at == 0, 1), "u": (at != 2, 2), "a": (at == 2, 3)}.get(role, (False, 0))
                        if stays[0]:
                            edits.append((stays[1], late, "K", "K"))
                    out += [f"('{role}', '{fault}', {start}, {to}, {cost + 2 * n}, '{'I' * n + letter}', '{lines}', '{line}')" for to, cost, letter, line in edits]
                    at = after[at]
                    lines += name[at] + ":|"
    return ", ".join(out)


ORACLE_SQL["op11_repair"] = f"""
WITH RECURSIVE crc AS {_CRC_TABLE},
src AS (
    SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           {_crc("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))", "t")} % 20 AS d
    FROM conversations, crc
), damaged AS (
    SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role,
           CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
    FROM src, range(2) c(copy) WHERE d <> 0 AND (copy = 0 OR d = 3)
), numbered AS (
    SELECT *, sha256(length(role) || ':' || role || text) AS h,
           regexp_matches(text, '[^\x20\x09-\x0D]') AS has_word,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
           regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS ends
    FROM damaged
), rows_ AS (
    SELECT *, CASE WHEN NOT has_word THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN NOT ends THEN 'truncated' ELSE '' END AS fault,
           left(role, 1) AS initial, row_number() OVER o AS k, lag(left(role, 1)) OVER o AS earlier
    FROM numbered WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, h, copy)
), facts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) AS n,
           count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (k > 1 AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM rows_ GROUP BY conv_id
), moves(r, f, a, z, cost, letters, inserted, line) AS (VALUES {_moves()}),
coded AS (
    SELECT conv_id, k, role, text, CASE WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'o' END AS r,
           CASE fault WHEN '' THEN 'c' WHEN 'truncated' THEN 't' ELSE 'x' END AS f FROM rows_
), dp(conv_id, k, state, cost, audit, lines) AS (
    SELECT conv_id, 0::BIGINT, 0, 0, '', '' FROM facts
    UNION ALL
    SELECT s.conv_id, s.k, s.z, min(s.cost), arg_min(s.audit, {{'c': s.cost, 'a': s.audit}}), arg_min(s.lines, {{'c': s.cost, 'a': s.audit}}) FROM (
        SELECT d.conv_id, c.k, m.z, d.cost + m.cost AS cost, d.audit || m.letters AS audit,
               d.lines || replace(m.inserted, '|', chr(10)) || CASE m.line WHEN '' THEN '' WHEN 'K' THEN c.role || ':' || c.text || chr(10) ELSE m.line || ':' || c.text || chr(10) END AS lines
        FROM dp d JOIN coded c ON c.conv_id IS NOT DISTINCT FROM d.conv_id AND c.k = d.k + 1 JOIN moves m ON m.r = c.r AND m.f = c.f AND m.a = d.state
    ) s GROUP BY s.conv_id, s.k, s.z
), ended AS (
    SELECT d.conv_id, d.cost + e.cost AS cost, d.audit || e.letters AS audit, d.lines || replace(e.inserted, '|', chr(10)) AS lines
    FROM dp d JOIN facts f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.n = d.k
    JOIN (VALUES (0, 0, '', ''), (1, 4, 'II', 'user:|assistant:|'), (2, 2, 'I', 'assistant:|'), (3, 0, '', '')) e(state, cost, letters, inserted) ON e.state = d.state
), best AS (
    SELECT conv_id, min(cost) AS cost, arg_min(audit, {{'c': cost, 'a': audit}}) AS audit, arg_min(lines, {{'c': cost, 'a': audit}}) AS lines FROM ended GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.cost, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(left(lines, -1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id::BIGINT AS conv_id FROM conversations) o
LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def _features(table: str, id_: str) -> str:
    """(id, w): every run of one to three consecutive words of a table's texts."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""(SELECT row, {id_} AS id, unnest(list_transform(range(len(ws)), lambda i: ws[i + 1])
        || list_transform(range(greatest(len(ws) - 1, 0)), lambda i: ws[i + 1] || ' ' || ws[i + 2])
        || list_transform(range(greatest(len(ws) - 2, 0)), lambda i: ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3])) AS w
        FROM (SELECT row_number() OVER () AS row, {id_}, {words} AS ws FROM {table}))"""


ORACLE_SQL["op13_importance"] = f"""
WITH crc AS {_CRC_TABLE},
d AS MATERIALIZED {_features("documents", "doc_id")}, b AS MATERIALIZED {_features("benchmark", "item_id")},
buckets AS MATERIALIZED (SELECT w, {_crc("w", "t")} % 10000 AS bucket FROM (SELECT w FROM d UNION SELECT w FROM b), crc),
s AS (SELECT bucket, count(*) AS n FROM d JOIN buckets USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM b JOIN buckets USING (w) GROUP BY bucket),
gain AS (
    SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM d) + 10000)::DOUBLE
        / ((s.n + 1)::DOUBLE * ((SELECT count(*) FROM b) + 10000)::DOUBLE)))::BIGINT AS g
    FROM s LEFT JOIN t USING (bucket)
), weight AS (
    SELECT row, count(*) AS n_features, sum(g)::BIGINT AS weight FROM d JOIN buckets USING (w) JOIN gain USING (bucket) GROUP BY row
), scored AS (
    SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('42:' || doc_id), 8))::BIGINT + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score
    FROM (SELECT row_number() OVER () AS row, doc_id FROM documents) LEFT JOIN weight USING (row)
), ranked AS (
    SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 57
)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 5 * n // 100 THEN r END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""
