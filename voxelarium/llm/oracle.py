"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP2 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
pos AS (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) > 8),
win AS (SELECT rid, i, words[i:i + 7] AS g FROM pos),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) x WHERE n > 1),
gaps AS (SELECT rid, least(8, coalesce(i - lag(i) OVER (PARTITION BY rid ORDER BY i), 8)) AS c FROM twice),
rep AS (SELECT rid, sum(c) AS n_repeat_words FROM gaps GROUP BY rid),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
m AS (
  SELECT rid, line, n,
    (n < 5 AND NOT regexp_matches(regexp_replace(line, '[\x20\x09\x0B-\x0D]+$', ''), '[.!?:;…]["'')\]”’»]*$'))
      OR (len(line) - len(regexp_replace(line, '[#*$%&|<>]', '', 'g'))) * 100 > len(line) * 10
      OR len(line) - len(regexp_replace(line, '[|»›•]', '', 'g')) >= greatest(2, ceil(n / 4))
      OR (n <= 30 AND regexp_matches(lower(line), '(all rights reserved|cookie policy|privacy policy|terms of use|terms of service|enable javascript|click here|sign up for|subscribe to|licensed under|released under|share this)')) AS bad
  FROM (SELECT rid, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l) x WHERE n > 0),
s AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (WHERE bad) AS n_lines_failed,
    coalesce(sum(n) FILTER (WHERE bad), 0) AS n_words_lost FROM m GROUP BY rid),
c AS (
  SELECT d.doc_id, CAST(len(w.words) AS BIGINT) AS n_words,
    CAST(len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(n_lines_failed, 0) AS BIGINT) AS n_lines_failed,
    CAST(coalesce(n_words_lost, 0) AS BIGINT) AS n_words_lost
  FROM d JOIN w USING (rid) LEFT JOIN s USING (rid) LEFT JOIN rep USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * n_words_lost <= 50 * n_words AS kept,
  n_lines_failed, n_words_lost
FROM c
"""

#: A private-use character marks the cuts, which DuckDB then splits at. 30 words make a run of repeated units a passage.
OP3 = r"""
WITH p AS (
  SELECT doc_id, string_split(replace(regexp_replace(coalesce(text, ''), '([.!?])([ \t\r])', '\1' || chr(57344) || '\2', 'g'), chr(10), chr(10) || chr(57344)), chr(57344)) AS ps
  FROM documents),
u AS (SELECT doc_id, unnest(ps) AS unit, unnest(range(1, len(ps) + 1)) AS k FROM p),
o AS (SELECT doc_id, unit, k, sum(len(unit)) OVER (PARTITION BY doc_id ORDER BY k) AS end_at FROM u),
n AS (SELECT doc_id, CAST(end_at - len(unit) AS BIGINT) AS start_at, CAST(end_at AS BIGINT) AS end_at, len(w) AS words,
    lower(array_to_string(w, ' ')) AS norm, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS nth
  FROM (SELECT *, regexp_extract_all(unit, '[^\x20\x09-\x0D]+') AS w FROM o) x WHERE len(w) > 0),
r AS (SELECT *, row_number() OVER g AS rn, first_value(doc_id) OVER g AS first_doc_id, first_value(start_at) OVER g AS first_start_at
  FROM n WINDOW g AS (PARTITION BY norm ORDER BY doc_id, start_at)),
q AS (SELECT *, nth - row_number() OVER (PARTITION BY doc_id ORDER BY nth) AS run FROM r WHERE rn > 1),
t AS (SELECT *, sum(words) OVER (PARTITION BY doc_id, run) AS total FROM q)
SELECT doc_id, start_at, end_at, first_doc_id, first_start_at FROM t WHERE total >= 30
"""

OP9 = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS k FROM documents),
w AS (SELECT doc_id, line, k, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM l),
n AS (SELECT doc_id, k, len(ws) AS c, array_to_string(ws, ' ') AS s FROM w WHERE len(ws) > 0),
win AS (SELECT doc_id, k, c, s, lead(s, 1) OVER d AS s1, lead(s, 2) OVER d AS s2, lead(k, 1) OVER d AS k1, lead(k, 2) OVER d AS k2
  FROM n WINDOW d AS (PARTITION BY doc_id ORDER BY k)),
t AS (SELECT *, row_number() OVER (PARTITION BY s, s1, s2 ORDER BY doc_id, k) AS rn FROM win WHERE s2 IS NOT NULL),
g AS (
  SELECT doc_id, k FROM t WHERE rn > 1 UNION SELECT doc_id, k1 FROM t WHERE rn > 1 UNION SELECT doc_id, k2 FROM t WHERE rn > 1
  UNION SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY s ORDER BY doc_id, k) AS rn FROM n WHERE c >= 50) x WHERE rn > 1)
SELECT l.doc_id, count(*) AS n_lines, count(g.k) AS n_removed,
  coalesce(string_agg(CAST(g.k AS VARCHAR), ',' ORDER BY g.k), '') AS removed_lines,
  md5(coalesce(string_agg(l.line, chr(10) ORDER BY l.k) FILTER (WHERE g.k IS NULL), '')) AS clean_md5
FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.k = g.k GROUP BY l.doc_id
"""

#: Five hexadecimal digits are four of base 32.
OP6 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS x FROM p),
b AS (SELECT page_id, n, list_aggregate(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(x, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))::INT) & 31), 1)), 'string_agg', '') AS payload_digest FROM d),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, n) AS first FROM b)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""



def _crc_step(c: str) -> str:
    """CRC-32 over the low four bits of ``c``; the sixteen values follow from the polynomial (fixed value of the format)."""
    table = []
    for v in range(16):
        for _ in range(4):
            v = v >> 1 ^ 0xEDB88320 * (v & 1)
        table.append(v)
    return f"xor(({c}) >> 4, CAST({table} AS BIGINT[])[CAST((({c}) & 15) + 1 AS BIGINT)])"


def _runs_sql(levels: int = 22) -> str:
    """Runs by equal blocks of 1, 2, 4, ... words.

    Level k has the class of each block of 2^k words that occurs again in its text. Within a run of period q, and 2^k the least
    power not under q, each block's next occurrence is q words on, and nowhere else is that so for longer than a run allows.
    """
    parts = []
    for k in range(levels):
        if k == 0:
            parts.append("c0 AS MATERIALIZED (SELECT rid, i, hash(w) AS c FROM t)")
        else:
            step = 1 << (k - 1)
            parts.append(f"c{k} AS MATERIALIZED (SELECT a.rid, a.i, hash(a.c, b.c) AS c FROM r{k - 1} a JOIN r{k - 1} b ON a.rid = b.rid AND b.i = a.i + {step})")
        parts.append(
            f"r{k} AS MATERIALIZED (SELECT rid, i, c, d FROM (SELECT *, lead(i) OVER g - i AS d, count(*) OVER (PARTITION BY rid, c) AS many FROM c{k} WINDOW g AS (PARTITION BY rid, c ORDER BY i)) x WHERE many > 1)"
        )
        parts.append(
            f"f{k} AS (SELECT rid, min(i) AS start, max(i) - min(i) + {1 << k} + d AS length, d AS period FROM "
            f"(SELECT *, i - row_number() OVER (PARTITION BY rid, d ORDER BY i) AS island FROM r{k} WHERE d <= {1 << k} AND 2 * d > {1 << k}) x GROUP BY rid, d, island)"
        )
    every = " UNION ALL ".join(f"SELECT * FROM f{k}" for k in range(levels))
    crc = f"list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: {_crc_step(_crc_step('xor(c, b)'))})"
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-]+') AS ws, xor({crc}, 4294967295) AS h FROM documents),
e AS (SELECT *, len(ws) AS n, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM d),
o AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM e),
u AS (SELECT rid, ws, h, a, p, unnest(range(n)) AS i FROM o),
t AS MATERIALIZED (SELECT rid, i, ws[1 + CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END] AS w FROM u),
{", ".join(parts)},
r AS MATERIALIZED (SELECT rid, start, length, period FROM ({every}) x WHERE length >= greatest(6, 4 * period)),
x AS (SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS s FROM r GROUP BY rid),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY length DESC, start, period) AS nth FROM r) y WHERE nth = 1),
k AS (SELECT rid, string_agg(w, ' ' ORDER BY i) AS s FROM t WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.rid = t.rid AND t.i >= r.start + r.period AND t.i < r.start + r.length) GROUP BY rid)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
  CAST(1000 * length // period AS BIGINT) AS exponent_milli, sha256(coalesce(x.s, '')) AS runs_sha256, sha256(coalesce(k.s, '')) AS collapsed_sha256
FROM d LEFT JOIN x USING (rid) LEFT JOIN b USING (rid) LEFT JOIN k USING (rid)
"""


ORACLE_SQL = {"op2_quality_rules": OP2, "op3_substring_dedup": OP3, "op6_warc_revisits": OP6, "op9_line_dedup": OP9, "op12_periodic_runs": _runs_sql()}
