"""SQL for DuckDB that gives the rows of queries by a plain path: windows are named one by one.

The other queries have none: their results come from pseudorandom draws, trained models, tokenizers, media formats or
hashes that SQL lacks. The tests hold them against brute force.
"""

#: Windows of 50 words, cut from parts of 100 starts each; a word goes if one of the 50 windows that may cover it has to.
OP10_RECOMPRESSION = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), parts AS (
  SELECT doc_id, len(ws) AS n, unnest(range(0, len(ws), 100)) AS c, ws[c + 1:c + 149] AS part FROM w
), starts AS (
  SELECT doc_id, c, part, unnest(range(1, least(100, n - 49 - c) + 1)) AS q FROM parts
), named AS (
  SELECT doc_id, c + q AS p, min(doc_id) OVER (PARTITION BY md5(array_to_string(part[q:q + 49], ' '))) < doc_id AS again FROM starts
), words AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w
), judged AS (
  SELECT x.doc_id, i, word, coalesce(max(CASE WHEN again THEN i END) OVER (PARTITION BY x.doc_id ORDER BY i), -50) > i - 50 AS gone
  FROM words x LEFT JOIN named n ON n.doc_id = x.doc_id AND n.p = x.i
), kept AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS text FROM judged GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
"""

#: Strings of 200 bytes, in hexadecimal digits, cut from parts of 200 starts each; runs of starts that overlap are spans.
OP7_SUFFIX_ARRAY = r"""
WITH b AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents
), parts AS (
  SELECT doc_id, len(hx) // 2 AS n, unnest(range(0, len(hx) // 2, 200)) AS c, substring(hx, 2 * c + 1, 798) AS part FROM b
), starts AS (
  SELECT doc_id, c, part, unnest(range(0, least(200, n - 199 - c))) AS q FROM parts
), named AS (
  SELECT doc_id, c + q AS p, count(*) OVER (PARTITION BY md5(substring(part, 2 * q + 1, 400))) > 1 AS again FROM starts
), again AS (
  SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS gap FROM named WHERE again
), runs AS (
  SELECT doc_id, p, count(*) FILTER (gap IS NULL OR gap > 200) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM again
), spans AS (
  SELECT doc_id, run, min(p) AS a, max(p) + 200 AS z FROM runs GROUP BY doc_id, run
), removed AS (
  SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id
), edges AS (
  SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM spans
  UNION ALL
  SELECT b.doc_id, len(hx) // 2, NULL, coalesce(m.z, 0) FROM b LEFT JOIN (SELECT doc_id, max(z) AS z FROM spans GROUP BY doc_id) m USING (doc_id)
), kept AS (
  SELECT e.doc_id, string_agg(substring(hx, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS hx FROM edges e JOIN b USING (doc_id) GROUP BY e.doc_id
)
SELECT b.doc_id, len(b.hx) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k.hx, ''))) AS kept_sha256
FROM b LEFT JOIN removed USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
