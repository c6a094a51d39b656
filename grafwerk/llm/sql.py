"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from grafwerk.llm.fingerprint import BASE, HEAD, PRIME
from grafwerk.llm.jaccard import N, THRESHOLD
from grafwerk.llm.repeats import LEAST

EXACT = """
SELECT doc_id, first AS copy_of
FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first,
             row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) AS nth
      FROM documents WHERE text IS NOT NULL)
WHERE nth > 1
"""

FINGERPRINTS = f"""
WITH marks AS (
  SELECT doc_id, text, length(text) AS n_chars,
         CAST(CASE WHEN text = '' THEN 0 ELSE list_reduce(
           list_prepend(0::HUGEINT, list_reverse(list_transform(string_split(text, ''), lambda c: unicode(c)::HUGEINT))),
           lambda h, c: (h * {BASE}::HUGEINT + c) % {PRIME}::HUGEINT) END AS BIGINT) AS fingerprint
  FROM documents),
contents AS (
  SELECT substring(text, 1, {HEAD}) AS head, fingerprint, min(doc_id) AS of_id, any_value(text) AS text
  FROM marks WHERE n_chars >= {HEAD} GROUP BY 1, 2),
pairs AS (
  SELECT a.fingerprint, a.text, b.of_id AS near_id, b.text AS near_text
  FROM contents a JOIN contents b ON a.head = b.head AND a.fingerprint <> b.fingerprint),
shared AS (
  SELECT fingerprint, near_id,
         coalesce(list_position(list_transform(list_zip(string_split(text, ''), string_split(near_text, '')),
                                               lambda x: coalesce(x[1] = x[2], false)), false) - 1,
                  least(length(text), length(near_text))) AS common
  FROM pairs WHERE near_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY common DESC, near_id) = 1)
SELECT m.doc_id, m.n_chars, m.fingerprint, coalesce(s.near_id, -1) AS near_id, CAST(coalesce(s.common, 0) AS BIGINT) AS common
FROM marks m LEFT JOIN shared s ON m.fingerprint = s.fingerprint
"""


PASSAGES = f"""
WITH rows AS (
  SELECT row_number() OVER () AS k, doc_id, text
  FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)),
words AS (SELECT k, doc_id, list_filter(string_split_regex(text, '[\\t\\n\\x0b\\f\\r ]+'), lambda w: w <> '') AS w FROM rows),
windows AS (
  SELECT k, doc_id, i, array_to_string(w[i + 1 : i + {LEAST}], ' ') AS text
  FROM (SELECT k, doc_id, w, unnest(range(len(w) - {LEAST} + 1)) AS i FROM words WHERE len(w) >= {LEAST})),
shared AS (SELECT text, min(doc_id) AS first FROM windows GROUP BY text HAVING count(DISTINCT k) > 1),
marked AS (
  SELECT k, doc_id, i, first, CASE WHEN i > lag(i) OVER (PARTITION BY k ORDER BY i) + {LEAST} THEN 1 ELSE 0 END AS new
  FROM windows JOIN shared USING (text)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY i) AS nth FROM marked)
SELECT doc_id, CAST(min(i) AS BIGINT) AS begin, CAST(max(i) + {LEAST} AS BIGINT) AS end, min(first) AS first_id
FROM numbered GROUP BY k, doc_id, nth
"""

JACCARD = f"""
WITH RECURSIVE rows AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
texts AS (
  SELECT text, row_number() OVER () AS k, regexp_extract_all(lower(text), '[^\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+') AS w
  FROM rows GROUP BY text),
grams AS (
  SELECT k, unnest(list_distinct(list_transform(range(greatest(1, len(w) - {N} + 1)), lambda i: array_to_string(w[i + 1 : i + {N}], ' ')))) AS g
  FROM texts WHERE len(w) > 0),
sizes AS (SELECT k, count(*) AS n FROM grams GROUP BY k),
shared AS (SELECT a.k AS a, b.k AS b, count(*) AS common FROM grams a JOIN grams b ON a.g = b.g AND a.k <= b.k GROUP BY 1, 2),
near AS (
  SELECT a, b, common / CAST(x.n + y.n - common AS DOUBLE) AS jaccard
  FROM shared JOIN sizes x ON a = x.k JOIN sizes y ON b = y.k WHERE common >= {THRESHOLD} * (x.n + y.n - common) - 1e-9),
docs AS (SELECT doc_id, text, k FROM rows JOIN texts USING (text) WHERE len(w) > 0),
held AS (SELECT k, count(*) AS n, min(doc_id) AS first FROM docs GROUP BY k),
edges AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
links AS (SELECT a AS k, sum(n) - 1 AS links FROM edges JOIN held ON b = k GROUP BY a),
reach AS (SELECT k, k AS j FROM held UNION SELECT reach.k, edges.b FROM reach JOIN edges ON reach.j = edges.a),
classes AS (SELECT reach.k, min(first) AS class_id FROM reach JOIN held ON reach.j = held.k GROUP BY reach.k)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, CAST(coalesce(links, 0) AS BIGINT) AS links
FROM documents d LEFT JOIN docs USING (doc_id, text) LEFT JOIN links USING (k) LEFT JOIN classes USING (k)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_jaccard_join": JACCARD, "op9_repeated_passages": PASSAGES, "op8_exact_dedup": EXACT, "op10_fingerprints": FINGERPRINTS}
