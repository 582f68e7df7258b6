"""DuckDB SQL of the training-data queries that SQL can express."""

from newsprism.llm.quality_rules import MAX_REPEAT_PERCENT, MIN_WORDS, RULES, STOP_WORDS


def _ratio(measure: str) -> str:
    top, bottom = (x.strip() for x in measure.split("/"))
    return f"CASE WHEN {bottom} > 0 THEN CAST({top} AS DOUBLE) / {bottom} ELSE 0.0 END"


_PASSED = " AND ".join(f"{_ratio(r.measure)} {sign} {bound}" for r in RULES
                       for sign, bound in ((">=", r.low), ("<=", r.high)) if bound is not None)
_STOP = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))

OP1 = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0),
r AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

OP7 = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS l
  FROM d),
p AS (
  SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
k AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM p),
c AS (
  SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM k WHERE n > 1) GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines,
         len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS n_stop_words
  FROM w LEFT JOIN c USING (r)),
b AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {_PASSED} AS kept
FROM b
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11 = f"""
WITH p AS (
  SELECT row_number() OVER () AS id, page_id,
         {_LOWER.format("coalesce(regexp_extract(url, '://([^/?#]*)', 1), '')")} AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(verdict, rule_host, rule_path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
         ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits AS (
  SELECT id, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY id ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS r
  FROM p JOIN rules ON starts_with(path, rule_path) AND (host = rule_host OR ends_with(host, '.' || rule_host)))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM p LEFT JOIN (SELECT * FROM fits WHERE r = 1) USING (id)
"""

_TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
OP12 = f"""
WITH d AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_TERM}') AS t FROM documents),
b AS (
  SELECT row_number() OVER () AS b, item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_TERM}') AS t FROM benchmark),
q AS (SELECT b, item_id, term, count(*) AS qtf FROM (SELECT b, item_id, unnest(t) AS term FROM b) GROUP BY ALL),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d WHERE len(t) > 0),
f AS (SELECT d, doc_id, any_value(len(t)) AS n, term, count(*) AS tf FROM (SELECT d, doc_id, t, unnest(t) AS term FROM d)
      WHERE term IN (SELECT term FROM q) GROUP BY d, doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
      FROM f, s GROUP BY term),
p AS (SELECT d, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms))) AS part
      FROM f JOIN w USING (term), s),
r AS (SELECT b, item_id, doc_id, CAST(sum(qtf * part) AS BIGINT) AS score FROM q JOIN p USING (term) GROUP BY b, item_id, d, doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 20
"""

OP13 = f"""
WITH pieces AS (
  SELECT row_number() OVER () AS p, lang, piece FROM (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
c AS (
  SELECT lang, w[i:i + k - 1] AS g, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)
  GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM c WHERE len(g) = 1 GROUP BY lang),
e AS (SELECT * FROM c WHERE f >= 30),
cuts AS (
  SELECT x.lang, x.g, x.f AS a, k, l.f AS l, r.f AS r,
         CAST((2000000 * CAST(x.f AS HUGEINT)) // (l.f + r.f) AS BIGINT) AS score
  FROM (SELECT lang, g, f, unnest(range(1, len(g))) AS k FROM e WHERE len(g) > 1) x
  JOIN e l ON l.lang = x.lang AND l.g = x.g[:k] JOIN e r ON r.lang = x.lang AND r.g = x.g[k + 1:]),
best AS (
  SELECT lang, g, any_value(a) AS a, arg_min(l, score * 8 + k) AS l, arg_min(r, score * 8 + k) AS r, min(score) AS score
  FROM cuts GROUP BY lang, g),
parts AS (
  SELECT lang, f, g[i:j] AS g FROM (
    SELECT lang, f, g, i, unnest(range(i + 1, len(g) + 1)) AS j FROM (
      SELECT lang, f, g, unnest(range(1, len(g))) AS i FROM e WHERE len(g) > 2))
  WHERE j - i + 1 < len(g)),
cover AS (SELECT lang, g, max(f) AS f FROM parts GROUP BY lang, g),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank,
         array_to_string(g, ' ') AS phrase, a, l, r, score
  FROM best LEFT JOIN cover USING (lang, g) WHERE cover.f IS NULL OR 100 * cover.f < 80 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

ORACLE: dict[str, str] = {"op1_topk_threshold": OP1, "op7_quality_rules": OP7, "op11_url_filter": OP11,
                          "op12_shared_queries": OP12, "op13_collocations": OP13}
