"""DuckDB SQL for the queries that SQL can express. The views documents and pages hold the whole tables."""

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op1_exact_dedup"] = r"""
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""

ORACLE_SQL["op5_url_filter"] = r"""
WITH p AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), r AS (
  SELECT page_id, host, path,
         CASE WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/') THEN 'example.com/de/'
              WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/') THEN 'example.net/en/'
              WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') THEN 'org/fr/'
              WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') THEN 'net/' END AS rule
  FROM p
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""

_FILL = """
, open{k} AS (
  SELECT t.source, t.rest - coalesce((SELECT sum(size) FROM h{j} h WHERE h.hit = 1 AND h.source IS NOT DISTINCT FROM t.source), 0) AS open FROM src t
), pick{k} AS (
  SELECT row FROM (
    SELECT h.row, row_number() OVER (PARTITION BY h.source ORDER BY {order} h.rank, h.doc_id, h.row) AS n
    FROM h{j} h JOIN open{k} o ON h.source IS NOT DISTINCT FROM o.source WHERE h.hit = 0 AND h.rank IS NOT NULL AND {fits}
  ) WHERE n = 1
), h{k} AS (
  SELECT h.* REPLACE (CASE WHEN p.row IS NOT NULL THEN 1 ELSE h.hit END AS hit) FROM h{j} h LEFT JOIN pick{k} p ON h.row = p.row
)
"""
ORACLE_SQL["op10_pareto_mix"] = (
    r"""
WITH docs AS (
  SELECT *, CASE WHEN size <= 250 THEN 3 WHEN size <= 2500 THEN 2 ELSE 1 END AS dw FROM (
    SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) AS row,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
           (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
    FROM documents)
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, coalesce(sum(size) FILTER (dw = 3), 0)::DOUBLE AS n0, coalesce(sum(size) FILTER (dw = 2), 0)::DOUBLE AS n1, coalesce(sum(size) FILTER (dw = 1), 0)::DOUBLE AS n2
  FROM docs GROUP BY source
), weighed AS (
  SELECT *, (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::DOUBLE AS w, 3::DOUBLE * source_size AS cap FROM per
), levels AS (
  SELECT *, row_number() OVER o2 AS k, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0::DOUBLE)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0::DOUBLE)) AS level
  FROM weighed WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                        o2 AS (ORDER BY cap / w, source NULLS LAST)
), goal AS (
  SELECT source, source_size, n0, n1, n2, least(cap, coalesce((SELECT arg_min(level, k) FROM levels WHERE level <= cap / w) * w, cap)) AS target FROM levels
), shares AS (
  SELECT *, target / nullif(3 * n0 + 2 * n1 + n2, 0) AS c0, (target - 3 * n0) / nullif(2 * n1 + n2, 0) AS c1, (target - 3 * (n0 + n1)) / nullif(n2, 0) AS c2 FROM goal
), cs AS (
  SELECT *, CASE WHEN c0 * 3 <= 3 THEN c0 WHEN c1 * 2 <= 3 THEN c1 WHEN c2 <= 3 THEN c2 ELSE 3::DOUBLE END AS c FROM shares
), src AS (
  SELECT source, source_size, target, c, target - (floor(least(3::DOUBLE, c * 3)) * n0 + floor(least(3::DOUBLE, c * 2)) * n1 + floor(least(3::DOUBLE, c)) * n2) AS rest FROM cs
), r0 AS (
  SELECT d.*, s.source_size, s.target, s.rest, least(3::DOUBLE, s.c * d.dw) AS r FROM docs d JOIN src s ON d.source IS NOT DISTINCT FROM s.source
), r1 AS (
  SELECT *, floor(r) AS whole, r - floor(r) AS p FROM r0
), r2 AS (
  SELECT *, CASE WHEN size > 0 AND p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds FROM r1
), r3 AS (SELECT *, odds / (1 + odds) AS rank FROM r2
), h0 AS (
  SELECT *, CASE WHEN rank IS NOT NULL AND sum(CASE WHEN rank IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id, row ROWS UNBOUNDED PRECEDING) <= rest THEN 1 ELSE 0 END AS hit FROM r3
)"""
    + "".join(_FILL.format(j=k - 1, k=k, order="abs(h.size - o.open), h.size DESC," if k == 3 else "", fits="abs(h.size - o.open) < o.open" if k == 3 else "h.size <= o.open") for k in (1, 2, 3))
    + """
SELECT doc_id, size, source_size, target, ((whole + hit) * size)::BIGINT AS taken, (CASE WHEN size > 0 THEN whole + hit ELSE 0 END)::BIGINT AS copies FROM h3
"""
)
