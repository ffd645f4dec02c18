"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

#: A-Z to a-z only.
LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE["op10_decontaminate"] = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({LOWER.format('text')}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWER.format('text')}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS p
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM bw), dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS p
  FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS r(i)
), hits AS (SELECT doc_id, item, i, bw.n FROM dw JOIN bw ON dw.p = bw.p AND dw.n = bw.n
), words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM hits, unnest(range(i, i + n)) AS r(k) GROUP BY doc_id
), found AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""

ORACLE["op2_near_dedup"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({LOWER.format('text')}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 3) - 1], ' ') AS g
  FROM d, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS r(i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM pair JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)
), edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach(doc_id, top) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT edge.b, reach.top FROM reach JOIN edge ON edge.a = reach.doc_id WHERE reach.top < edge.b
), least AS (SELECT doc_id, min(top) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN least USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def _url_filter(steps: int = 12, damping: str = "0.85") -> str:
    """The fixed number of steps as one table each."""
    host = "translate(regexp_extract(substr(url, instr(url, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rules = "('allow','com','/'),('block','example.com','/en/'),('allow','www.example.com','/en/'),('block','net','/es/'),('block','net','/fr/')"
    turns = "".join(
        f""", m{k} AS (
  SELECT kind, host, sum(mass) AS mass FROM (
    SELECT s.kind, s.too AS host, m.mass * s.share * {damping} AS mass FROM share s JOIN m{k - 1} m ON m.kind = s.kind AND m.host = s.host
    UNION ALL SELECT kind, host, mass * (1 - {damping}) FROM m0) GROUP BY kind, host
)"""
        for k in range(1, steps + 1)
    )
    return f"""
WITH p AS (
  SELECT row_number() OVER () AS uid, page_id, html, CASE WHEN instr(url, '://') > 0 THEN {host} ELSE '' END AS host,
    CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages
), r(verdict, h, q) AS (VALUES {rules}), fit AS (
  SELECT uid, arg_max(h || q, length(h || q)) AS rule, arg_max(verdict, length(h || q)) AS ruled
  FROM p JOIN r ON (p.host = h OR ends_with(p.host, '.' || h)) AND starts_with(p.path, q) GROUP BY uid
), ruled AS (SELECT p.*, rule, ruled FROM p LEFT JOIN fit USING (uid)
), link AS (
  SELECT host AS src, translate(unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']?\\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\\s>]+)', 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst
  FROM p WHERE host <> ''
), edge AS (SELECT src, dst, count(*) AS n FROM link WHERE src <> dst GROUP BY ALL
), flow AS (SELECT 'trust' AS kind, src AS host, dst AS too, n FROM edge UNION ALL SELECT 'distrust', dst, src, n FROM edge
), share AS (SELECT kind, host, too, n / sum(n) OVER (PARTITION BY kind, host) AS share FROM flow
), seed AS (
  SELECT CASE ruled WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) AS n FROM ruled WHERE ruled IS NOT NULL AND host <> '' GROUP BY ALL
), m0 AS (SELECT kind, host, n / sum(n) OVER (PARTITION BY kind) AS mass FROM seed){turns}
, blocked AS (
  SELECT host FROM m{steps} GROUP BY host
  HAVING coalesce(sum(mass) FILTER (WHERE kind = 'distrust'), 0) > coalesce(sum(mass) FILTER (WHERE kind = 'trust'), 0)
)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN host IN (SELECT host FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict FROM ruled
"""


ORACLE["op5_url_filter"] = _url_filter()
