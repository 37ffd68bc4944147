"""Operators in SQL, by plain definition, for tables of test size."""

#: Repeated strings of 400 bytes: every window's digest, all of them counted. Texts
#: are cut into parts that overlap, as long ones slice slowly.
REPEATED_STRINGS = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
parts AS (SELECT r, 1000 * c AS base, substr(h, 2000 * c + 1, 2798) AS p FROM (SELECT r, h, unnest(range(0, length(h) // 2000 + 1)) AS c FROM d)),
w AS (
  SELECT r, n, base + j AS i, hash(substr(p, 2 * j - 1, 2 * n)) AS k
  FROM (SELECT r, n, base, p, unnest(range(1, least(1000, length(p) // 2 - n + 1) + 1)) AS j FROM parts, (VALUES (400), (300)) AS v(n))),
twice AS (SELECT n, k FROM w GROUP BY n, k HAVING count(*) > 1),
fresh AS (SELECT r, n, i, CASE WHEN i - lag(i) OVER (PARTITION BY r, n ORDER BY i) <= n THEN 0 ELSE 1 END AS f FROM w WHERE (n, k) IN (SELECT (n, k) FROM twice)),
numbered AS (SELECT r, n, i, sum(f) OVER (PARTITION BY r, n ORDER BY i) AS run FROM fresh),
every AS (SELECT r, n, min(i) AS a, max(i) + n AS b FROM numbered GROUP BY r, n, run),
spans AS (SELECT r, a, b FROM every WHERE n = 400),
edges AS (
  SELECT r, a AS upto, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 1) AS since FROM spans
  UNION ALL SELECT d.r, length(h) // 2 + 1, coalesce(max(b), 1) FROM d LEFT JOIN spans s ON s.r = d.r GROUP BY d.r, h),
kept AS (SELECT e.r, string_agg(substr(h, 2 * since - 1, 2 * (upto - since)), '' ORDER BY upto, since) AS k FROM edges e JOIN d ON d.r = e.r GROUP BY e.r),
gone AS (SELECT r, sum(b - a) AS n, count(*) AS spans FROM spans GROUP BY r),
seen AS (SELECT r, sum(b - a) AS repeated FROM every WHERE n = 300 GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       CAST(coalesce(repeated, 0) AS BIGINT) AS n_repeated, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (r) LEFT JOIN gone USING (r) LEFT JOIN seen USING (r)
"""

#: The Jaccard join: all texts that share a gram, compared.
JACCARD_JOIN = """
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
grams AS (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT r, count(*) AS n FROM grams GROUP BY r),
pairs AS (SELECT a.r AS x, b.r AS y, count(*) AS overlap FROM grams a JOIN grams b ON a.g = b.g AND a.r <> b.r GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN sizes p ON p.r = x JOIN sizes q ON q.r = y WHERE 9 * overlap >= 4 * (p.n + q.n)),
reach AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
low AS (SELECT x, min(doc_id) AS m FROM reach JOIN docs ON r = y GROUP BY x),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_links, CASE WHEN m IS NULL THEN doc_id ELSE least(doc_id, m) END AS class_id
FROM docs LEFT JOIN counts c ON c.x = r LEFT JOIN low l ON l.x = r
"""

#: Embedding links: all pairs of a label. The forest finds them all while the
#: table fits into one leaf.
EMBEDDING_LINKS = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
sound AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND list_aggregate([CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END FOR x IN e], 'sum') = 0 AND list_aggregate([abs(x) FOR x IN e], 'max') > 0),
links AS (SELECT a.r AS x, b.r AS y FROM sound a JOIN sound b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
low AS (SELECT x, min(vec_id) AS m FROM reach JOIN v ON r = y GROUP BY x),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM v LEFT JOIN counts c ON c.x = r LEFT JOIN low l ON l.x = r
"""
