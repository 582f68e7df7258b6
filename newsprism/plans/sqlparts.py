"""DuckDB SQL building blocks for the oracle queries (same definitions as plans.views)."""

from __future__ import annotations

from newsprism.functions.stopwords import ENGLISH_STOP_WORDS
from newsprism.functions.text import DATE_PATTERNS, MONTHS, PIVOT, TIME_PATTERN, WEEKDAY_PATTERN, WHITESPACE_CHARS, WORD_RUN

WS_SQL = "||".join(f"chr({ord(c)})" for c in WHITESPACE_CHARS)
TOKEN_RE = r"[\p{L}\p{N}_]{2,}"
STOP_SQL = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH_STOP_WORDS) + "]"


def strip(x: str) -> str:
    return f"trim({x}, {WS_SQL})"


def word_count(x: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, '{WORD_RUN}')) AS BIGINT)"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, '{WORD_RUN}')"


def tokens(x: str) -> str:
    """lower-cased tokens of >= 2 word characters, stop words removed."""
    return (f"list_filter(regexp_extract_all(lower({x}), '{TOKEN_RE}'), "
            f"lambda w: NOT list_contains({STOP_SQL}, w))")


def ngrams(toks: str, n: int) -> str:
    if n == 1:
        return toks
    return (f"CASE WHEN len({toks}) >= {n} THEN list_transform(range(1, len({toks}) - {n - 2}), "
            f"lambda i: array_to_string({toks}[i:i + {n - 1}], ' ')) ELSE [] END")


def parse_date(x: str) -> str:
    s = f"regexp_replace(regexp_replace(lower({strip(x)}), '{TIME_PATTERN}', ''), '{WEEKDAY_PATTERN}', '')"
    tried = []
    for order, pattern in DATE_PATTERNS:
        part = {kind: f"regexp_extract({s}, '{pattern}', {at})" for at, kind in enumerate(order, 1)}
        number = lambda k: f"TRY_CAST({part[k]} AS INTEGER)"  # noqa: E731, B023
        if "n" in part:
            names = ", ".join(f"'{m[:3]}'" for m in MONTHS)
            month, day = f"list_position([{names}], substr({part['n']}, 1, 3))", number("d")
        else:
            month, day = number("m"), number("d")
        if order == "mdy":
            month, day = (f"CASE WHEN {month} > 12 THEN {day} ELSE {month} END", f"CASE WHEN {month} > 12 THEN {month} ELSE {day} END")
        year = (f"CASE WHEN length({part['y']}) = 2 THEN {number('y')} + CASE WHEN {number('y')} >= {PIVOT} THEN 1900 ELSE 2000 END "
                f"ELSE {number('y')} END")
        tried.append(f"CASE WHEN regexp_matches({s}, '{pattern}') AND {year} > 0 "
                     f"THEN TRY_CAST(printf('%04d-%02d-%02d', {year}, {month}, {day}) AS DATE) END")
    return f"coalesce({', '.join(tried)})"


CTES = {
    "articles": f"""articles AS (
  SELECT d.doc_id AS row_id,
         split_part(d.text, chr(10), 1) AS title,
         CASE WHEN d.text IS NULL THEN NULL
              WHEN strpos(d.text, chr(10)) > 0 THEN substr(d.text, strpos(d.text, chr(10)) + 1)
              ELSE '' END AS text,
         d.source AS subject,
         CAST(NULL AS VARCHAR) AS date,
         CAST(l.quality AS INTEGER) AS label
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""",
    "labeled_articles": "labeled_articles AS (SELECT * FROM articles WHERE label IS NOT NULL)",
    "normed": f"""normed AS (
  SELECT row_id,
         {strip("coalesce(title, '')")} AS title,
         {strip("coalesce(text, '')")} AS text,
         {strip("coalesce(subject, '')")} AS subject,
         {strip("coalesce(date, '')")} AS date,
         label
  FROM articles)""",
    "cleaned": f"""cleaned AS (
  SELECT row_id, title, text, subject, date, label,
         {strip("title || ' ' || text")} AS content,
         {word_count("title")} AS title_words,
         {word_count("text")} AS text_words
  FROM (SELECT *, row_number() OVER (PARTITION BY title, text ORDER BY row_id) AS _rn FROM normed)
  WHERE _rn = 1)""",
    "labeled": f"""labeled AS (
  SELECT row_id, title, text, subject, date, label, {strip("title || ' ' || text")} AS content,
         {word_count("title")} AS title_words, {word_count("text")} AS text_words
  FROM (SELECT *, row_number() OVER (PARTITION BY title, text ORDER BY row_id) AS _rn
        FROM normed WHERE label IS NOT NULL)
  WHERE _rn = 1)""",
    "ranked": """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(row_id AS VARCHAR) || ':42'), row_id) AS _r,
         count(*) OVER (PARTITION BY label) AS _n
  FROM labeled)""",
    "splitted": """splitted AS (
  SELECT * EXCLUDE (_r, _n, _hold),
         CASE WHEN _r <= _n - _hold THEN 'train'
              WHEN _r <= _n - _hold + (_hold - ceil(_hold * CAST(0.5 AS DOUBLE))) THEN 'validation'
              ELSE 'test' END AS split
  FROM (SELECT *, ceil(_n * CAST(0.3 AS DOUBLE)) AS _hold FROM ranked))""",
    "predictions": """predictions AS (
  SELECT row_id, split, label, p, CAST(p >= 0.5 AS INTEGER) AS prediction
  FROM (SELECT *, CAST(length(text) AS DOUBLE) / (length(text) + 1000) AS p FROM splitted))""",
    "dated": """dated AS (
  SELECT o_orderkey AS row_id,
         CASE o_orderkey % 16
              WHEN 0 THEN strftime(o_orderdate, '%B %-d, %Y')
              WHEN 1 THEN strftime(o_orderdate, '%b %-d, %Y') || ' '
              WHEN 2 THEN strftime(o_orderdate, '%-d-%b-%y')
              WHEN 4 THEN strftime(o_orderdate, '%Y-%m-%d')
              WHEN 5 THEN strftime(o_orderdate, '%-m/%-d/%Y')
              WHEN 6 THEN strftime(o_orderdate, '%-d %B %Y')
              WHEN 7 THEN strftime(o_orderdate, '%-d %b %Y')
              WHEN 8 THEN strftime(o_orderdate, '%b. %-d, %Y')
              WHEN 9 THEN strftime(o_orderdate, '%Y-%m-%dT10:00:00Z')
              WHEN 10 THEN strftime(o_orderdate, '%-d/%-m/%Y')
              WHEN 11 THEN strftime(o_orderdate, '%Y%m%d')
              WHEN 12 THEN upper(strftime(o_orderdate, '%b %-d %Y'))
              WHEN 13 THEN strftime(o_orderdate, '%A, %B %-d, %Y')
              WHEN 14 THEN strftime(o_orderdate, '%-m/%-d/%y')
              ELSE o_orderpriority END AS date,
         CAST(o_orderkey % 2 AS INTEGER) AS label
  FROM orders)""",
    "answers": """answers AS (
  SELECT row_id, label AS true_label,
         CASE WHEN row_id % 7 = 0 THEN ''
              ELSE CASE row_id % 5 WHEN 0 THEN 'FAKE' WHEN 1 THEN 'fake.' WHEN 2 THEN 'REAL'
                                   WHEN 3 THEN 'Real news' ELSE 'unknown' END END AS answer,
         CASE WHEN row_id % 7 = 0 THEN NULL ELSE CAST(length(text) AS DOUBLE) / 1000.0 END AS latency_seconds,
         CASE WHEN row_id % 7 = 0 THEN 'generation failed' ELSE NULL END AS error
  FROM labeled_articles)""",
}
DEPENDS = {
    "articles": [], "labeled_articles": ["articles"], "normed": ["articles"], "cleaned": ["normed"],
    "labeled": ["normed"], "ranked": ["labeled"], "splitted": ["ranked"], "predictions": ["splitted"], "dated": [],
    "answers": ["labeled_articles"],
}


def with_(*names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        for d in DEPENDS[n]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(CTES[n] for n in order) + "\n"
