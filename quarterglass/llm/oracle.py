"""SQL beside the registered queries, where SQL can express the operator over whole tables."""

ORACLE: dict[str, str] = {}

ORACLE["op7_mixing"] = r"""
WITH base AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         length(text) AS chars
  FROM documents),
weighed AS (
  SELECT *, CASE WHEN size = 0 THEN 0.1::DOUBLE
            ELSE greatest(coalesce(least(chars::DOUBLE / (size::DOUBLE * 6.5::DOUBLE), 1.0::DOUBLE / (chars::DOUBLE / (size::DOUBLE * 6.5::DOUBLE))), 0.1::DOUBLE), 0.1::DOUBLE) END AS quality
  FROM base),
keyed AS (
  SELECT *, pow((CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':7'), 1, 13)) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE, 1.0::DOUBLE / quality) AS key
  FROM weighed),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sizes),
capped AS (
  SELECT *, [5, 2, 1][place % 3 + 1] AS weight, source_size * 3 AS cap FROM ranked),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::DOUBLE AS level
  FROM capped WINDOW o AS (ORDER BY cap::DOUBLE / weight::DOUBLE, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
filled AS (
  SELECT (SELECT level FROM levels WHERE cap > level * weight ORDER BY cap::DOUBLE / weight::DOUBLE, place LIMIT 1) AS fill),
targets AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce(fill * weight, cap::DOUBLE)) AS target FROM levels, filled),
placed AS (
  SELECT k.doc_id, k.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN least(floor(t.target / t.source_size), 3)::BIGINT ELSE 0 END AS epochs,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key DESC, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + CASE WHEN before + size / 2.0 <= target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed
"""

ORACLE["op1_warc"] = r"""
WITH base AS (
  SELECT page_id, coalesce(html, '') AS payload, sha256(coalesce(html, '')) AS payload_digest,
         CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes
  FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM base),
refs AS (SELECT *, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM firsts)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM refs
"""

ORACLE["op12_divergence"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
occurrences AS (
  SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM occurrences GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
counted AS (
  SELECT o.lang, o.source, o.term, count(*) AS n
  FROM occurrences o JOIN kept k ON k.lang = o.lang AND k.term = o.term GROUP BY o.lang, o.source, o.term),
source_groups AS (SELECT DISTINCT lang, source FROM docs),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
source_sums AS (SELECT lang, source, sum(n)::BIGINT AS total FROM counted GROUP BY lang, source),
lang_sums AS (SELECT lang, sum(n)::BIGINT AS total FROM counted GROUP BY lang),
lang_counts AS (SELECT lang, term, sum(n)::BIGINT AS n FROM counted GROUP BY lang, term),
given AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (coalesce(s.total, 0) + 2 * v.v) AS p
  FROM source_groups g JOIN kept k ON k.lang = g.lang JOIN sizes v ON v.lang = g.lang
  LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN source_sums s ON s.lang = g.lang AND s.source = g.source),
lang_given AS (
  SELECT l.lang, l.term, 1 + (1000000000 * (l.n + 2)) // (s.total + 2 * v.v) AS q
  FROM lang_counts l JOIN lang_sums s ON s.lang = l.lang JOIN sizes v ON v.lang = l.lang),
pair_sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value
  FROM given a JOIN given b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source),
pair_values AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM source_groups a JOIN source_groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair_sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term_values AS (
  SELECT g.lang, g.source, g.term AS item, (((g.p - l.q) * (g.p - l.q)) // (g.p + l.q))::BIGINT AS value
  FROM given g JOIN lang_given l ON l.lang = g.lang AND l.term = g.term
  WHERE g.n > 0 AND g.p > l.q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank
  FROM pair_values
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER
  FROM term_values)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
