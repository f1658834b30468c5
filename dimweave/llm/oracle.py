"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

_OP7 = """
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*(.*)$', 1, 's'), '') AS rest
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
  END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
    WHEN rule IS NOT NULL THEN 'allow'
    WHEN host <> '' AND (contains(host || rest, '?sessionid=') OR contains(host || rest, '/wp-login.php')) THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _similar(words: int, percent: int, more: str = "") -> str:
    """All pairs that share a shingle, their exact coefficient, and the components by a recursive query."""
    shingle = " || ' ' || ".join(f"w[i + {j}]" for j in range(words))
    return f"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {words - 2}), lambda i: {shingle}) END) AS s
  FROM split),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM flat x JOIN flat y ON x.shingle = y.shingle AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n
  HAVING 100 * count(*) >= {percent} * (x.n + y.n - count(*))),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (
  SELECT doc_id, doc_id FROM sets
  UNION
  SELECT r.a, l.b FROM reach r JOIN ways l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id{more}
FROM sets JOIN least ON sets.doc_id = least.doc_id
"""


# crc32 by a table of 256 remainders; words one edit apart share what is left without one code point.
_OP11 = f"""
WITH remainders AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), '{_UPPER}', '{_LOWER}') AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run),
bytes AS (
  SELECT run, n, list_concat(
    list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':', ''), lambda c: CAST(unicode(c) AS BIGINT)),
    flatten(list_transform(string_split(run, ''), lambda c:
      CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, CAST(unicode(c) - 64 AS BIGINT)] END))) AS b
  FROM counted),
hashed AS (
  SELECT run, n, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS h
  FROM bytes, remainders),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM words, unnest(range(1, length(word) + 1)) AS u(i)),
pairs AS (
  SELECT x.word AS a, y.word AS b, y.n AS b_n FROM cut x JOIN cut y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
  UNION SELECT w.word, c.word, c.n FROM words w JOIN cut c ON c.rest = w.word
  UNION SELECT c.word, w.word, w.n FROM words w JOIN cut c ON c.rest = w.word),
best AS (SELECT a, count(*) AS n_near, max(b_n) AS top FROM pairs GROUP BY a),
forms AS (
  SELECT w.word, w.n, coalesce(best.n_near, 0) AS n_near, top,
         CASE WHEN top >= 10 * w.n THEN (SELECT min(b) FROM pairs p WHERE p.a = w.word AND p.b_n = top) END AS form
  FROM words w LEFT JOIN best ON best.a = w.word),
chain AS (
  SELECT word, word AS reached, 0 AS steps FROM forms
  UNION ALL SELECT chain.word, forms.form, steps + 1 FROM chain JOIN forms ON forms.word = chain.reached WHERE forms.form IS NOT NULL),
roots AS (SELECT word, arg_max(reached, steps) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, CASE WHEN form IS NOT NULL THEN top END AS form_n
FROM forms JOIN roots USING (word)
""".replace("WITH remainders", "WITH RECURSIVE remainders", 1)


_OP12 = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM split GROUP BY lang),
places AS (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM split, (SELECT unnest(range(1, 6)) AS m)),
grams AS (SELECT lang, w[i:i + m - 1] AS g, count(*) AS a FROM places GROUP BY lang, w[i:i + m - 1] HAVING count(*) >= 100),
cuts AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM grams WHERE len(g) > 1),
scored AS (
  SELECT c.lang, c.g, c.a, x.a AS l, y.a AS r, t.n, c.k,
         CAST((CAST(1000 AS HUGEINT) * c.a * t.n) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM cuts c JOIN grams x ON x.lang = c.lang AND x.g = c.g[1:c.k]
  JOIN grams y ON y.lang = c.lang AND y.g = c.g[c.k + 1:] JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
spans AS (SELECT lang, g, a, unnest(range(2, len(g))) AS m FROM grams WHERE len(g) > 2),
inside AS (
  SELECT lang, g[i:i + m - 1] AS g, max(a) AS longer
  FROM (SELECT lang, g, a, m, unnest(range(1, len(g) - m + 2)) AS i FROM spans) GROUP BY lang, g[i:i + m - 1]),
ranked AS (
  SELECT b.lang, array_to_string(b.g, ' ') AS phrase, a, l, r, n, score,
         row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, array_to_string(b.g, ' ')) AS rank
  FROM best b LEFT JOIN inside ON inside.lang = b.lang AND inside.g = b.g
  WHERE longer IS NULL OR 100 * longer < 100 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""


ORACLE_SQL: dict[str, str] = {
    "op4_ngram_join": _similar(5, 80),
    "op7_url_filter": _OP7,
    "op11_spelling_variants": _OP11,
    "op12_collocations": _OP12,
    "op13_super_minhash": _similar(3, 85, ", sets.doc_id = component_id AS kept"),
}
