"""SQL forms of operators 2, 3, 8 and 9, by plain joins of all shingles or windows."""

from __future__ import annotations

PLAIN = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _words(text: str, pattern: str, lower: bool = True) -> str:
    text = f"translate({text}, '{_UPPER}', '{_UPPER.lower()}')" if lower else text
    return f"regexp_extract_all({text}, '{pattern}')"


def _slice(words: str, at: str, n: str) -> str:
    return f"array_to_string(list_slice({words}, {at}, {at} + {n} - 1), ' ')"


NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words("coalesce(text, '')", PLAIN)} AS w FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, {_slice("w", "i", "least(len(w), 5)")} AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0) x),
size AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
link AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN size x ON x.doc_id = a.doc_id JOIN size y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents
  UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.other),
part AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM part LEFT JOIN size USING (doc_id)
"""

SUBSTRING = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_words("coalesce(text, '')", PLAIN, False)} AS w FROM documents),
win AS MATERIALIZED (SELECT doc_id, i, {_slice("w", "i", "50")} AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50) x),
first AS (SELECT s, min(doc_id) AS low FROM win GROUP BY s HAVING count(DISTINCT doc_id) > 1),
cut AS MATERIALIZED (SELECT DISTINCT doc_id, i + k AS i FROM win JOIN first USING (s), range(0, 50) t(k) WHERE doc_id > low),
kept AS (SELECT u.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY u.i) AS t
  FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d) u LEFT JOIN cut ON cut.doc_id = u.doc_id AND cut.i = u.i
  WHERE cut.i IS NULL GROUP BY u.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

DECONTAMINATION = f"""
WITH it AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words("text", ALNUM)} AS w FROM benchmark WHERE text IS NOT NULL),
iw AS MATERIALIZED (SELECT DISTINCT item, least(len(w), 10) AS n, {_slice("w", "i", "least(len(w), 10)")} AS s
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM it WHERE len(w) > 0) x),
d AS MATERIALIZED (SELECT doc_id, {_words("coalesce(text, '')", ALNUM)} AS w FROM documents),
dw AS MATERIALIZED (SELECT doc_id, n, i, {_slice("w", "i", "n")} AS s FROM
  (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw) l WHERE len(w) >= n) x),
hit AS MATERIALIZED (SELECT DISTINCT dw.doc_id, dw.n, i, item FROM dw JOIN iw ON dw.n = iw.n AND dw.s = iw.s),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM hit, range(0, 10) t(k) WHERE k < hit.n GROUP BY doc_id),
own AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) x GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(cov.n, 0)::BIGINT AS n_hit, coalesce(own.n, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(cov.n, 0) > 0 AS contaminated
FROM d LEFT JOIN cov ON cov.doc_id = d.doc_id LEFT JOIN own ON own.doc_id = d.doc_id
"""

SUFFIX = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS n FROM documents),
win AS MATERIALIZED (SELECT doc_id, i, md5(substr(h, 2 * i - 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(1, n - 98)) AS i FROM d WHERE n >= 100) x),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM win) x WHERE k > 1),
mark AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM dup),
run AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM mark) x GROUP BY doc_id, r),
gap AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 1) AS a, a AS b FROM run
  UNION ALL SELECT d.doc_id, coalesce(max(run.b), 1), d.n + 1 FROM d LEFT JOIN run ON run.doc_id = d.doc_id GROUP BY d.doc_id, d.n),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a - 1, 2 * (b - a)), '' ORDER BY a) AS t FROM gap JOIN d USING (doc_id) GROUP BY doc_id),
cut AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM run GROUP BY doc_id)
SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(t)) AS kept_sha256
FROM d JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN cut ON cut.doc_id = d.doc_id
"""
