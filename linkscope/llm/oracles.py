r"""DuckDB SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

from .decontaminate import MASKS, SIMILARITY, WINDOW
from .line_dedup import EDITS, MIN_CHARS

OP1 = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS txt, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT doc_id, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS p FROM w)),
rep AS (
  SELECT doc_id, count(DISTINCT p + k) AS n
  FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win), (SELECT unnest([0, 1, 2]) AS k)
  WHERE c > 1 GROUP BY doc_id),
m AS (
  SELECT w.doc_id, txt, ws, len(ws) AS n_words, length(regexp_replace(txt, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(regexp_replace(txt, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) AS n_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
         length(regexp_replace(txt, '[^\p{L}]+', '', 'g')) AS letters, length(regexp_replace(txt, '[^\p{Lu}]+', '', 'g')) AS capitals
  FROM w LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 4 * n_words OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 10 * capitals > 6 * letters OR 10 * letters < 5 * word_chars OR 10 * len(list_filter(ws, lambda x: ends_with(x, '!!'))) > 3 * n_words) AS kept
FROM b
"""


def _op5() -> str:
    tokens = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    longest = max(map(len, MASKS))
    all_masks = [*MASKS, *("1" * n for n in range(1, longest))]

    def seeds(t: str, asked: str) -> str:
        return " UNION ALL ".join(
            f"SELECT id, ws, {n} AS mask, p, concat_ws(' ', {', '.join(f'ws[p + {k}]' for k, c in enumerate(m) if c == '1')}) AS h "
            f"FROM (SELECT id, ws, unnest(range(1, len(ws) - {len(m) - 2})) AS p FROM {t}" + ("" if "0" in m else asked.format(n=len(m))) + ")"
            for n, m in enumerate(all_masks)
        )

    span = min(map(len, MASKS))
    return f"""
WITH d AS (SELECT doc_id AS id, {tokens} AS ws FROM documents),
b AS (SELECT DISTINCT item_id AS id, {tokens} AS ws FROM benchmark),
ds AS ({seeds("d", " WHERE EXISTS (SELECT 1 FROM b WHERE len(b.ws) = {n})")}),
bs AS ({seeds("b", " WHERE len(ws) = {n}")}),
hits AS (
  SELECT ds.id AS doc_id, bs.id AS item_id, ds.p - bs.p AS first_word, bs.p - 1 AS q, len(bs.ws) AS n, least({WINDOW}, len(bs.ws)) AS w,
         list_transform(range(1, len(bs.ws) + 1), lambda j: CASE WHEN ds.p - bs.p + j >= 1 AND ds.ws[ds.p - bs.p + j] = bs.ws[j] THEN 1 ELSE 0 END) AS eq
  FROM ds JOIN bs USING (mask, h)),
verified AS (
  SELECT * FROM hits
  WHERE len(list_filter(range(greatest(0, q + least({span}, w) - w), greatest(0, least(q, n - w)) + 1), lambda s: list_sum(eq[s + 1:s + w]) >= {SIMILARITY} * w)) > 0)
SELECT doc_id, item_id, max(n)::BIGINT AS item_words, count(*) AS n_hits, min(first_word)::BIGINT AS first_word, max(list_sum(eq))::BIGINT AS agreeing
FROM verified GROUP BY doc_id, item_id
"""


def _op9() -> str:
    from .secrets import BASE_KINDS, RULES

    def part(no, rule):
        p = "'" + rule.pattern.replace("'", "''") + "'"
        return f"""
  SELECT doc_id, rid, {no} AS no, '{rule.kind}' AS kind,
         coalesce(list_sum(list_transform(b[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS "at", length(m[i]) AS chars
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i
        FROM (SELECT doc_id, rid, regexp_extract_all(txt, {p}) AS m, regexp_extract_all(txt, {p}, {rule.group}) AS g, regexp_split_to_array(txt, {p}) AS b FROM d))
  WHERE length(g[i]) >= {rule.least}"""

    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE_KINDS)
    base = ", ".join(f"'{k}'" for k in BASE_KINDS)
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS txt FROM documents),
s AS ({" UNION ALL ".join(part(n, r) for n, r in enumerate(RULES))}),
said AS (SELECT *, kind || ':' || "at"::BIGINT || ':' || ("at" + chars)::BIGINT AS x FROM s)
SELECT d.doc_id, {counts},
       sha256(coalesce(string_agg(x, ',' ORDER BY "at", no) FILTER (kind IN ({base})), '')) AS base_sha256,
       coalesce(string_agg(x, ',' ORDER BY "at", no), '') AS spans
FROM d LEFT JOIN said USING (rid) GROUP BY rid, d.doc_id
"""


OP10 = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS no FROM documents),
d AS (SELECT line, length(line) AS n, min((doc_id, no)) AS first FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY line),
long AS (SELECT * FROM d WHERE n >= {MIN_CHARS}),
pairs AS (
  SELECT a.line AS x, b.line AS y, a.first AS fx, b.first AS fy
  FROM long a JOIN long b ON a.n BETWEEN b.n AND b.n + {EDITS} AND a.line <> b.line AND ({
      " OR ".join(f"contains(a.line, substr(b.line, ({i} * b.n) // {EDITS + 1} + 1, (({i + 1} * b.n) // {EDITS + 1}) - (({i} * b.n) // {EDITS + 1})))" for i in range(EDITS + 1))})
  WHERE levenshtein(a.line, b.line) <= {EDITS}),
near AS (SELECT x AS line FROM pairs WHERE fy < fx UNION SELECT y FROM pairs WHERE fx < fy),
judged AS (
  SELECT l.doc_id, l.no, l.line, d.line IS NOT NULL AND d.first <> (l.doc_id, l.no) AS again, near.line IS NOT NULL AND d.first = (l.doc_id, l.no) AS near
  FROM l LEFT JOIN d USING (line) LEFT JOIN near USING (line))
, kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (again) AS n_exact, count(*) FILTER (near) AS n_near,
         coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT again AND NOT near), '') AS t
  FROM judged GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_exact, 0) AS n_exact, coalesce(n_near, 0) AS n_near,
       length(t) AS kept_chars, sha256(t) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)
"""

OP7 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                               ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g
  FROM w),
e AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
pairs AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT DISTINCT a AS doc_id, a AS other FROM pairs UNION SELECT reach.doc_id, pairs.b FROM reach JOIN pairs ON reach.other = pairs.a)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, coalesce(m.c, s.doc_id) AS component_id
FROM s LEFT JOIN (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id) m USING (doc_id)
"""

OP11 = r"""
WITH t AS (
  SELECT c, x, n, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, x) AS k
  FROM (SELECT conv_id AS c, turn, substr(sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS x, length(coalesce(text, '')) AS n
        FROM conversations WHERE conv_id IS NOT NULL)),
cv AS (
  -- CRC-32 bit by bit: a number of 0 or more is a byte to take in, -1 one shift.
  SELECT c, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(c::VARCHAR, ''), lambda b: [ascii(b)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                            lambda acc, b: CASE WHEN b >= 0 THEN xor(acc, b) ELSE xor(acc >> 1, (acc % 2) * 3988292384) END), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT c FROM t)),
r AS (
  SELECT cv.c, k, x, n FROM cv JOIN t USING (c) WHERE k > h
  UNION ALL SELECT cv.c, k, x, n FROM cv JOIN t ON t.c = cv.c - cv.c % 100 WHERE k <= h),
s AS (SELECT cv.c, coalesce(xs, []) AS xs, ns FROM cv LEFT JOIN (SELECT c, list(x ORDER BY k) AS xs, list(n ORDER BY k) AS ns FROM r GROUP BY c) USING (c)),
m AS MATERIALIZED (
  SELECT c, d, array_to_string(xs[1:d], ',') AS key, CASE WHEN d > 0 THEN array_to_string(xs[1:d - 1], ',') END AS up, CASE WHEN d > 0 THEN ns[d] ELSE 0 END AS n, d = len(xs) AS ends
  FROM (SELECT *, unnest(range(0, len(xs) + 1)) AS d FROM s)),
node AS MATERIALIZED (
  SELECT key, d, max(up) AS up, min(c) AS conv_id, count(*) AS n_convs, max(n) AS n, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY key, d),
kids AS (SELECT up AS key, d - 1 AS d, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL),
v AS (SELECT node.*, coalesce(n_children, 0) AS n_children, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf, (n_convs - 1) * n AS saved FROM node LEFT JOIN kids USING (key, d)),
sub AS (SELECT m.key, m.d, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM v JOIN m ON m.c = v.conv_id AND m.d <= v.d GROUP BY m.key, m.d)
SELECT v.conv_id, v.d AS depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, v.ends_sha256
FROM v JOIN sub USING (key, d) LEFT JOIN node p ON p.key = v.up AND p.d = v.d - 1
"""


def _op12() -> str:
    """Each round as a few common table expressions."""
    from .vector_codes import ENTRIES, PARTS, ROUNDS, SCALE

    gap = "list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i])))"
    nearest = lambda n: f"""a{n} AS MATERIALIZED (
  SELECT vec_id, part, x, entry, gap FROM (
    SELECT vec_id, part, x, entry, gap, row_number() OVER (PARTITION BY vec_id, part ORDER BY gap, entry) AS place
    FROM (SELECT p.vec_id, p.part, p.x, b.entry, {gap} AS gap FROM p JOIN b{n} b USING (part))) WHERE place = 1)"""  # noqa: E731
    floored = "(s - ((s % n) + n) % n) // n"
    rounds = "".join(
        f"""{nearest(n)},
b{n + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{n} b LEFT JOIN (
    SELECT part, entry, list({floored} ORDER BY i) AS x FROM (
      SELECT part, entry, i, sum(y)::BIGINT AS s, count(*) AS n FROM (SELECT part, entry, unnest(x) AS y, unnest(range(1, len(x) + 1)) AS i FROM a{n}) GROUP BY ALL) GROUP BY part, entry) m USING (part, entry)),
"""
        for n in range(ROUNDS)
    )
    return f"""
WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, v[part * (len(v) // {PARTS}) + 1:(part + 1) * (len(v) // {PARTS})] AS x FROM k, (SELECT unnest(range({PARTS})) AS part)),
b0 AS MATERIALIZED (SELECT part, entry, x FROM (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM p) WHERE entry < {ENTRIES}),
{rounds}{nearest(ROUNDS)},
c AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(gap)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM b{ROUNDS}) AS codebooks_sha256
FROM c JOIN k USING (vec_id)
"""


def _op13() -> str:
    from .substring_dedup import WINDOW as W

    return rf"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS rid, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT rid, p, md5(array_to_string(ws[p:p + {W - 1}], ' ')) AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - {W - 2})) AS p FROM w)),
rep AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY g) AS c FROM win) WHERE c > 1),
gone AS (SELECT DISTINCT rid, p + k AS i FROM rep, (SELECT unnest(range({W})) AS k)),
kept AS (
  SELECT rid, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t
  FROM (SELECT rid, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM w) ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (rid)
"""


SQL = {"op7_ngram_join": OP7, "op1_quality_rules": OP1, "op5_decontamination": _op5(), "op9_secret_scan": _op9(), "op10_line_dedup": OP10, "op11_prefix_trie": OP11, "op12_vector_codes": _op12(), "op13_substring_dedup": _op13()}
