"""DuckDB SQL of the queries that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op3_warc_transactions"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS s FROM p),
f AS (SELECT s, max(page_id) AS first FROM d WHERE n >= 1000 GROUP BY s)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.s AS payload_digest,
       CASE WHEN f.first IS NULL OR f.first = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first <> d.page_id THEN f.first END AS refers_to
FROM d LEFT JOIN f ON d.s = f.s AND d.n >= 1000
"""

ORACLES["op7_host_reputation"] = r"""
WITH u AS (
  SELECT page_id, coalesce(lower(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1)), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
marks AS (SELECT doc_id, max(CAST(quality = 0 OR toxic = 1 AS INT)) AS bad FROM labels
          WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id),
h AS (SELECT host, count(m.bad) AS n, coalesce(sum(m.bad), 0) AS bad FROM u LEFT JOIN marks m ON u.page_id = m.doc_id GROUP BY host),
hs AS (SELECT *, regexp_extract(host, '([^.]*\.)?[^.]*$') AS domain, regexp_extract(host, '[^.]*$') AS suffix FROM h),
ds AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM hs GROUP BY ALL),
ss AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM ds GROUP BY ALL),
o AS (SELECT (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1.0) AS m FROM h),
s1 AS (SELECT ss.*, o.m FROM ss, o),
k1 AS (SELECT sum(n * pow(bad / n - m, 2)) AS spread, count(*) AS g, avg(m * (1 - m)) AS chance, sum(n) AS t, sum(n * n) AS q FROM s1 WHERE n > 0),
w1 AS (SELECT ((spread - (g - 1) * chance) / (t - q / t)) / chance AS rho FROM k1),
x1 AS (SELECT CASE WHEN rho IS NULL OR isnan(rho) OR rho <= 0 THEN 1e6 ELSE least(greatest((1 - rho) / rho, 1.0), 1e6) END AS s FROM w1),
p1 AS (SELECT suffix, (m * s + bad) / (s + n) AS m FROM s1, x1),
s2 AS (SELECT ds.*, p1.m FROM ds JOIN p1 USING (suffix)),
k2 AS (SELECT sum(n * pow(bad / n - m, 2)) AS spread, count(*) AS g, avg(m * (1 - m)) AS chance, sum(n) AS t, sum(n * n) AS q FROM s2 WHERE n > 0),
w2 AS (SELECT ((spread - (g - 1) * chance) / (t - q / t)) / chance AS rho FROM k2),
x2 AS (SELECT CASE WHEN rho IS NULL OR isnan(rho) OR rho <= 0 THEN 1e6 ELSE least(greatest((1 - rho) / rho, 1.0), 1e6) END AS s FROM w2),
p2 AS (SELECT suffix, domain, (m * s + bad) / (s + n) AS m FROM s2, x2),
s3 AS (SELECT hs.*, p2.m FROM hs JOIN p2 USING (suffix, domain)),
k3 AS (SELECT sum(n * pow(bad / n - m, 2)) AS spread, count(*) AS g, avg(m * (1 - m)) AS chance, sum(n) AS t, sum(n * n) AS q FROM s3 WHERE n > 0),
w3 AS (SELECT ((spread - (g - 1) * chance) / (t - q / t)) / chance AS rho FROM k3),
x3 AS (SELECT CASE WHEN rho IS NULL OR isnan(rho) OR rho <= 0 THEN 1e6 ELSE least(greatest((1 - rho) / rho, 1.0), 1e6) END AS s FROM w3),
p3 AS (SELECT host, m * s + bad AS a, (1 - m) * s + n - bad AS b FROM s3, x3),
r AS (SELECT host, a / (a + b) - 1.645 * sqrt((a / (a + b)) * (1 - a / (a + b)) / (a + b + 1)) AS bound FROM p3),
rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fit AS (SELECT u.page_id, arg_max(rules.h || rules.p, length(rules.h || rules.p)) AS rule,
               arg_max(rules.verdict, length(rules.h || rules.p)) AS verdict
        FROM u JOIN rules ON (u.host = rules.h OR ends_with(u.host, '.' || rules.h)) AND starts_with(u.path, rules.p)
        GROUP BY u.page_id)
SELECT u.page_id, u.host, u.path, fit.rule AS rule,
       coalesce(fit.verdict, CASE WHEN r.bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN fit USING (page_id) LEFT JOIN r USING (host)
"""

ORACLES["op8_ngram_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * k >= 75 * (nx.n + ny.n - k)),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles,
       least(w.doc_id, coalesce((SELECT min(y) FROM reach WHERE reach.x = w.doc_id), w.doc_id)) AS component_id,
       (SELECT count(*) FROM links WHERE links.x = w.doc_id) AS n_links
FROM w LEFT JOIN n USING (doc_id)
"""

ORACLES["op10_wu_manber"] = r"""
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
t AS (
  SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS g
  FROM (SELECT item_id, ws, least(10, len(ws)) AS m, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i
        FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT m FROM t),
v AS (
  SELECT doc_id, i, m, array_to_string(ws[i:i + m - 1], ' ') AS g
  FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, lens WHERE len(ws) >= m)),
hits AS (SELECT v.doc_id, v.i, v.m, t.item_id FROM v JOIN t ON v.m = t.m AND v.g = t.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT w.doc_id, len(w.ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLES["op13_ball_tree"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT row_number() OVER () AS q, item_id, list_distinct(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS ws FROM benchmark),
a AS (SELECT count(*) AS n_docs, coalesce(sum(len(ws)), 0)::BIGINT AS n_terms FROM d WHERE len(ws) > 0),
asked AS (SELECT q, item_id, unnest(ws) AS t FROM b),
f AS (SELECT r, doc_id, n, t, count(*) AS tf
      FROM (SELECT r, doc_id, len(ws)::BIGINT AS n, unnest(ws) AS t FROM d)
      WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, a GROUP BY t, n_docs),
v AS (SELECT r, doc_id, t, w.w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * n_docs) // n_terms)))) AS x
      FROM f JOIN w USING (t), a),
s AS (SELECT q, item_id, r, doc_id, sum(x)::BIGINT AS score FROM asked JOIN v USING (t) GROUP BY ALL HAVING sum(x) > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id ASC NULLS LAST)::INTEGER AS rank FROM s)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10
"""
