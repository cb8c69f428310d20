"""SQL that operators which SQL can express must agree with."""

from __future__ import annotations

from . import quality, sharding

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACED = r"'[^\x20\x09-\x0D]+'"
ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, {ALNUM}) AS ws FROM documents),
b AS (SELECT item_id, ws, least(10, len(ws)) AS k FROM (SELECT item_id, regexp_extract_all({LOWER}, {ALNUM}) AS ws FROM benchmark) WHERE len(ws) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i+k-1], ' ') AS w FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS i FROM b)),
spans AS (SELECT doc_id, k, i, array_to_string(ws[i:i+k-1], ' ') AS w FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM b) WHERE len(ws) >= k)),
hits AS (SELECT doc_id, i, spans.k, item_id FROM spans JOIN windows ON spans.w = windows.w AND spans.k = windows.k),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY ALL),
items AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY ALL)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, words.n IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

NEAR_DEDUP = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, {SPACED}) AS ws FROM documents),
shingles AS (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, array_to_string(ws[i:i+3], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 2)) AS i FROM d WHERE len(ws) >= 4)
  UNION ALL SELECT doc_id, len(ws) || ' ' || array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND 3)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY ALL),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles, m AS component_id, doc_id = m AS kept FROM d JOIN (SELECT a, min(b) AS m FROM reach GROUP BY ALL) ON a = doc_id LEFT JOIN sizes USING (doc_id)
"""

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {SPACED}) AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i+34], ' ') AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY w) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM twice),
words AS (SELECT doc_id, p, ws[p] AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM d)),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY ALL),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY ALL)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(removed.n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLES: dict[str, str] = {"op4_sharding": sharding.ORACLE, "op5_quality_rules": quality.ORACLE, "op6_decontamination": DECONTAMINATION, "op7_near_dedup": NEAR_DEDUP, "op9_substring_dedup": SUBSTRING_DEDUP}
