"""DuckDB SQL for the queries that SQL expresses."""

from __future__ import annotations

from .quality_rules import RULES, STOP_WORDS
from .sharding import SEED

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP1 = f"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), {_AZ}) AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(verdict, h, pre) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
         ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), m AS (
  SELECT page_id, host, path, h || pre AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(h || pre) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""

# CRC-32 by its definition: a table made by the reflected polynomial, then one step a byte.
OP7 = f"""
WITH t AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b::BIGINT)) AS tab
), c AS (
  SELECT doc_id, source, coalesce(source, chr(0)) AS stratum, coalesce(strlen(text), 0) + 1 AS size,
         xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT),
             lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32
  FROM documents, t
), d AS (
  SELECT *, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || text_crc32), 1, 15))::BIGINT AS h FROM c
), f AS (
  SELECT *, ((row_number() OVER (PARTITION BY stratum ORDER BY h, doc_id, text_crc32, size)) - 1 + 0.5::DOUBLE)
            / (count(*) OVER (PARTITION BY stratum)) AS fraction FROM d
), p AS (
  SELECT *, row_number() OVER (ORDER BY fraction, stratum, h, doc_id, text_crc32, size) - 1 AS position, count(*) OVER () AS n FROM f
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (position * 16 // n)::INTEGER AS shard,
       (position - ((position * 16 // n) * n + 15) // 16)::BIGINT AS slot, NULL::INTEGER AS grown_shard, source, position
FROM p
"""


def _table(rules) -> str:
    parts = []
    for r in rules:
        parts += [f"{r.measure} >= {r.least}"] * (r.least is not None) + [f"{r.measure} <= {r.most}"] * (r.most is not None)
    return " AND ".join(parts)


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
OP9 = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents
), win AS (
  SELECT doc_id, i, list_slice(w, i, i + 7) AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
), dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM dup) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         greatest(len(w), 1) AS nw, greatest(len(lines), 1) AS nl, len(list_filter(w, lambda x: x IN ({_STOP}))) AS n_stop
  FROM d LEFT JOIN rep ON d.doc_id = rep.doc_id
), r AS (
  SELECT *, n_repeat_words / nw AS repeat_ratio, word_chars / nw AS mean_word_chars, n_symbols / nw AS symbol_ratio,
         n_dup_lines / nl AS dup_line_ratio, n_stop / nw AS stop_ratio,
         n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND ({_table(RULES)}) AS kept FROM r
"""

OP3 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, x FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: list_slice(w, i, i + 2)) ELSE [w] END) AS x
    FROM w WHERE len(w) > 0)
), h AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY x) AS x FROM s
), n AS (
  SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id
), e AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM h a JOIN h b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT e.a, e.b FROM e JOIN n p ON e.a = p.doc_id JOIN n q ON e.b = q.doc_id WHERE 100 * k >= 85 * (p.n + q.n - k)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (
  SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a
)
SELECT c.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON c.doc_id = n.doc_id
"""

ORACLE: dict[str, str] = {"op1_url_filter": OP1, "op3_near_dedup": OP3, "op7_sharding": OP7, "op9_quality_rules": OP9}
