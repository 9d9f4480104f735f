"""SQL twins of the corpus queries, where SQL can express them."""

from __future__ import annotations

HOST = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^.*@', ''), ':[0-9]*$', ''), '\.+$', ''), '^www\.', '')"

URL_LISTS = rf"""
WITH pages_h AS (SELECT page_id, url, CAST((page_id * 37) % 730 AS INT) AS fetched_day, {HOST} AS host FROM pages),
codes AS (SELECT host, CAST(min(length(url)) * 31 + length(host) * 17 + ascii(host) * 7 AS INT) AS code FROM pages_h WHERE host <> '' GROUP BY host),
listed AS (SELECT CASE WHEN code % 2 = 0 THEN host WHEN length(host) - length(replace(host, '.', '')) >= 2 THEN substr(host, strpos(host, '.') + 1) ELSE host END AS domain, 'list' || CAST(code % 4 AS VARCHAR) AS list_name, code, (code * 13) % 500 AS day FROM codes WHERE code % 3 <> 1),
entries AS (SELECT domain, list_name, 'add' AS action, day FROM listed UNION ALL SELECT domain, list_name, 'remove', day + 90 + code % 126 FROM listed UNION ALL SELECT domain, list_name, CASE WHEN code % 2 = 1 THEN 'add' ELSE 'remove' END, day + 230 FROM listed),
daily AS (SELECT domain, list_name, day, max(action) AS action FROM entries GROUP BY ALL),
changes AS (SELECT * FROM (SELECT *, lag(action) OVER (PARTITION BY list_name, domain ORDER BY day) AS was FROM daily) x WHERE action IS DISTINCT FROM was),
spans AS (SELECT * FROM (SELECT domain, list_name, action, day AS from_day, lead(day) OVER (PARTITION BY list_name, domain ORDER BY day) AS to_day FROM changes) y WHERE action = 'add'),
captures AS (SELECT page_id, url, host, fetched_day, count(*) AS copies FROM pages_h GROUP BY ALL),
hits AS (SELECT c.page_id, c.url, c.fetched_day, s.domain, s.list_name, s.from_day, row_number() OVER (PARTITION BY c.page_id, c.url, c.fetched_day ORDER BY length(s.domain) DESC, s.list_name, s.domain, s.from_day) AS place
  FROM captures c JOIN spans s ON (c.host = s.domain OR ends_with(c.host, '.' || s.domain)) AND (strpos(s.domain, '.') > 0 OR c.host = s.domain) AND c.fetched_day >= s.from_day AND (s.to_day IS NULL OR c.fetched_day < s.to_day))
SELECT c.page_id, c.url, c.host, c.fetched_day, h.domain IS NOT NULL AS blocked, h.domain, h.list_name, h.from_day, c.copies
FROM captures c LEFT JOIN hits h ON h.place = 1 AND c.page_id IS NOT DISTINCT FROM h.page_id AND c.url IS NOT DISTINCT FROM h.url AND c.fetched_day IS NOT DISTINCT FROM h.fetched_day"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0) t),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS met FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * met >= 85 * (x.n + y.n - met)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS reached FROM documents UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.reached = e.a)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.reached) AS component_id, d.doc_id = min(r.reached) AS kept
FROM documents d LEFT JOIN sizes s ON d.doc_id = s.doc_id JOIN reach r ON d.doc_id = r.node GROUP BY d.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op7_url_lists": URL_LISTS, "op8_near_duplicates": NEAR_DUPLICATES}
