"""DuckDB oracle SQL for the registered queries (same column names as the Spark side)."""

from __future__ import annotations

from newsprism.functions.text import MARKERS, SYSTEM_PROMPT, USER_PROMPT_PREFIX
from newsprism.operators.inference import MAX_INPUT_TOKENS, prompt_tokens
from newsprism.operators.models import EXPERIMENT_GRID
from newsprism.plans.sqlparts import parse_date, strip, with_, word_count, words

ORACLE: dict[str, str] = {}


def sql(key: str, text: str) -> None:
    ORACLE[key] = text


def _marker_name(m: str) -> str:
    return "m_" + "".join(ch if ch.isalnum() else "_" for ch in m)


def _upper_words(x: str) -> str:
    return (f"CAST(len(list_filter({words(x)}, lambda w: regexp_matches(w, '\\p{{Lu}}') "
            f"AND NOT regexp_matches(w, '[\\p{{Ll}}\\p{{Lt}}]'))) AS BIGINT)")


def _count_char(x: str, ch: str) -> str:
    pat = "\\" + ch if not ch.isalnum() else ch
    return f"CAST(len(regexp_extract_all({x}, '{pat}')) AS BIGINT)"


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


STYLE_SQL = f"""styled AS (
  SELECT *, {_count_char('title', '!')} AS exclamation_count,
            {_count_char('title', '?')} AS question_count,
            {_upper_words('title')} AS uppercase_words
  FROM cleaned)"""


STYLE_LABELED = STYLE_SQL.replace("FROM cleaned", "FROM labeled")


def _parse_answer(x: str) -> str:
    n = f"upper({strip(x)})"
    return (f"CASE WHEN starts_with({n}, 'FAKE') THEN 0 WHEN starts_with({n}, 'REAL') THEN 1 "
            f"ELSE CAST(NULL AS INTEGER) END")


# ---- 2.1 sources -----------------------------------------------------------
sql("load_labeled", with_("labeled_articles") + "SELECT * FROM labeled_articles")
sql("load_labeled_csv", with_("labeled_articles") + """
SELECT nullif(title, '') AS title, nullif(text, '') AS text, nullif(subject, '') AS subject, label FROM labeled_articles""")
sql("source_files", "SELECT 'documents.parquet' AS file_name, count(*) AS count FROM documents")
sql("source_shape", with_("cleaned") + """
SELECT 'fake' AS source, count(*) AS rows, 6 AS columns FROM articles WHERE label = 0
UNION ALL SELECT 'real', count(*), 6 FROM articles WHERE label = 1
UNION ALL SELECT 'cleaned', count(*), 9 FROM cleaned""")
sql("validate_columns", with_("articles") + "SELECT row_id, title, text, subject, date, label FROM articles")

# ---- 2.2 projections -------------------------------------------------------
sql("normalize_text_fields", with_("normed") + "SELECT * FROM normed")
sql("build_content", with_("normed") + f"SELECT row_id, {strip("title || ' ' || text")} AS content FROM normed")
sql("word_counts", with_("normed") + f"""
SELECT row_id, {word_count('title')} AS title_words, {word_count('text')} AS text_words FROM normed""")
sql("style_features", with_("cleaned") + f""", {STYLE_SQL}
SELECT row_id, exclamation_count, question_count, uppercase_words, title_words FROM styled""")
sql("marker_flags", with_("cleaned") + "SELECT row_id, " + ", ".join(
    f"coalesce(strpos(lower(content), '{m}') > 0, false) AS {_marker_name(m)}" for m in MARKERS)
    + " FROM cleaned")
sql("parse_dates", with_("dated") + f"SELECT row_id, date, {parse_date('date')} AS date_clean FROM dated")
sql("date_year", with_("dated") + f"""
SELECT row_id, year(d) AS year FROM (SELECT row_id, {parse_date('date')} AS d FROM dated) WHERE d IS NOT NULL""")
sql("decode_label", with_("labeled") + """
SELECT row_id, label, CASE label WHEN 0 THEN 'Fake' WHEN 1 THEN 'Real' END AS label_name FROM labeled""")
sql("parse_binary_answer", with_("answers") + f"SELECT row_id, answer, {_parse_answer('answer')} AS prediction FROM answers")
sql("build_prompt", with_("cleaned") + """
SELECT row_id, CAST(0 AS BIGINT) AS turn, 'system' AS role, """ + _literal(SYSTEM_PROMPT) + """ AS content FROM cleaned
UNION ALL
SELECT row_id, CAST(1 AS BIGINT), 'user', """ + _literal(USER_PROMPT_PREFIX) + """ || content FROM cleaned""")
sql("content_preview", with_("cleaned") + "SELECT row_id, substr(content, 1, 500) AS preview FROM cleaned")
sql("correct_flag", with_("answers") + f"""
SELECT row_id, true_label, prediction, coalesce(prediction = true_label, false) AS correct
FROM (SELECT *, {_parse_answer('answer')} AS prediction FROM answers)""")
_HALVES = ", ".join(f"list_sum(list_transform(embedding[{part}], lambda v: CAST(v AS DOUBLE))) AS {name}"
                    for part, name in (("1:len(embedding) // 2", "a"), ("len(embedding) // 2 + 1:", "b")))
sql("softmax_predict", f"""
SELECT vec_id, CASE WHEN b > a THEN 1 ELSE 0 END AS prediction,
       round(exp(b - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))), 6) AS p_real
FROM (SELECT vec_id, {_HALVES} FROM embeddings)""")

# ---- 2.3 filters -----------------------------------------------------------
sql("blank_rows", with_("articles") + f"SELECT row_id, title, label FROM articles WHERE {strip("coalesce(text, '')")} = ''")
sql("blank_label_dist", with_("articles") + f"""
SELECT label, count, round(100.0 * count / sum(count) OVER (), 6) AS pct FROM (
  SELECT label, count(*) AS count FROM articles WHERE {strip("coalesce(text, '')")} = '' GROUP BY label)""")
sql("invalid_dates", with_("dated") + f"SELECT row_id, date, label FROM dated WHERE {parse_date('date')} IS NULL")
sql("quarantine", with_("articles") + f""", routed AS (
  SELECT CASE WHEN {strip("coalesce(title, '')")} = '' AND {strip("coalesce(text, '')")} = '' THEN 'blank'
              WHEN NOT coalesce(label IN (0, 1), false) THEN 'label' END AS reason FROM articles)
SELECT CASE WHEN reason IS NULL THEN 'good' ELSE 'bad' END AS output, reason, count(*) AS rows,
       CAST(sum(count(*)) OVER (PARTITION BY reason IS NULL) AS BIGINT) AS observed FROM routed GROUP BY reason""")
sql("class_subset", with_("labeled") + "SELECT row_id, title FROM labeled WHERE label = 0")
sql("misclassified", with_("predictions") + """
SELECT row_id, split, label, prediction, p FROM predictions
WHERE NOT coalesce(prediction = label, false) ORDER BY row_id LIMIT 20""")
sql("label_domain_check", with_("articles") + """
SELECT count(*) FILTER (WHERE NOT coalesce(label IN (0, 1), false)) AS invalid_labels,
       count(DISTINCT label) AS distinct_labels FROM articles""")

# ---- 2.4 joins -------------------------------------------------------------
sql("class_balance_by_split", with_("splitted") + """
SELECT label,
       max(CASE WHEN split = 'train' THEN share END) AS train,
       max(CASE WHEN split = 'validation' THEN share END) AS validation,
       max(CASE WHEN split = 'test' THEN share END) AS test
FROM (SELECT split, label, round(n / sum(n) OVER (PARTITION BY split), 4) AS share
      FROM (SELECT split, label, count(*) AS n FROM splitted GROUP BY split, label))
GROUP BY label""")
sql("select_split_rows", with_("splitted") + "SELECT row_id, label, title FROM splitted WHERE split = 'test'")
sql("counts_reindexed", with_("labeled") + """
SELECT d.label, c.count FROM (VALUES (0), (1)) d(label)
LEFT JOIN (SELECT label, count(*) AS count FROM labeled GROUP BY label) c ON c.label = d.label""")
sql("same_text_diff_title", with_("articles") + """
SELECT row_id, title, label FROM articles WHERE text IN (
  SELECT text FROM articles WHERE text IS NOT NULL AND title IS NOT NULL
  GROUP BY text HAVING count(DISTINCT title) > 1)""")

# ---- 2.5 aggregations --------------------------------------------------------
sql("class_counts", with_("labeled") + "SELECT label, count(*) AS count FROM labeled GROUP BY label")
sql("class_share", with_("labeled") + """
SELECT label, count, round(count / sum(count) OVER (), 6) AS share
FROM (SELECT label, count(*) AS count FROM labeled GROUP BY label)""")
sql("split_sizes", with_("splitted") + "SELECT split, count(*) AS rows FROM splitted GROUP BY split")
sql("null_counts", with_("articles") + """
SELECT 'row_id' AS column, count(*) FILTER (WHERE row_id IS NULL) AS nulls FROM articles
UNION ALL SELECT 'title', count(*) FILTER (WHERE title IS NULL) FROM articles
UNION ALL SELECT 'text', count(*) FILTER (WHERE text IS NULL) FROM articles
UNION ALL SELECT 'subject', count(*) FILTER (WHERE subject IS NULL) FROM articles
UNION ALL SELECT 'date', count(*) FILTER (WHERE date IS NULL) FROM articles
UNION ALL SELECT 'label', count(*) FILTER (WHERE label IS NULL) FROM articles
UNION ALL SELECT 'total', count(*) FILTER (WHERE row_id IS NULL) + count(*) FILTER (WHERE title IS NULL)
  + count(*) FILTER (WHERE text IS NULL) + count(*) FILTER (WHERE subject IS NULL)
  + count(*) FILTER (WHERE date IS NULL) + count(*) FILTER (WHERE label IS NULL) FROM articles""")
sql("quality_report", with_("articles") + f"""
SELECT 'missing_values' AS metric, CAST(count(*) FILTER (WHERE row_id IS NULL) + count(*) FILTER (WHERE title IS NULL)
  + count(*) FILTER (WHERE text IS NULL) + count(*) FILTER (WHERE subject IS NULL)
  + count(*) FILTER (WHERE date IS NULL) + count(*) FILTER (WHERE label IS NULL) AS BIGINT) AS value FROM articles
UNION ALL SELECT 'blank_texts', count(*) FILTER (WHERE {strip("coalesce(text, '')")} = '') FROM articles
UNION ALL SELECT 'duplicate_title_text', count(*) - (SELECT count(*) FROM (SELECT DISTINCT title, text FROM articles)) FROM articles""")
sql("duplicate_counts", with_("articles") + """
SELECT 'title' AS subset, count(*) - (SELECT count(*) FROM (SELECT DISTINCT title FROM articles)) AS duplicates FROM articles
UNION ALL SELECT 'text', count(*) - (SELECT count(*) FROM (SELECT DISTINCT text FROM articles)) FROM articles
UNION ALL SELECT 'title+text', count(*) - (SELECT count(*) FROM (SELECT DISTINCT title, text FROM articles)) FROM articles""")
sql("label_conflicts", with_("articles") + """
SELECT count(*) FILTER (WHERE n > 1) AS conflicting_groups FROM (
  SELECT count(DISTINCT label) AS n FROM articles WHERE title IS NOT NULL AND text IS NOT NULL GROUP BY title, text)""")
sql("length_summary", with_("labeled") + """
SELECT label,
       round(avg(title_words), 6) AS title_words_mean, median(title_words) AS title_words_median,
       min(title_words) AS title_words_min, max(title_words) AS title_words_max,
       round(avg(text_words), 6) AS text_words_mean, median(text_words) AS text_words_median,
       min(text_words) AS text_words_min, max(text_words) AS text_words_max
FROM labeled GROUP BY label""")
_DESC = """SELECT '{c}' AS feature, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
       CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont({c}, 0.25), 6) AS p25,
       round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75,
       CAST(max({c}) AS DOUBLE) AS max FROM cleaned"""
sql("describe_lengths", with_("cleaned") + _DESC.format(c="title_words") + "\nUNION ALL\n"
    + _DESC.format(c="text_words"))
sql("subject_crosstab", with_("labeled") + """
SELECT subject, count(*) FILTER (WHERE label = 0) AS fake, count(*) FILTER (WHERE label = 1) AS real
FROM labeled GROUP BY subject""")
sql("year_crosstab", with_("dated") + f"""
SELECT year, count(*) FILTER (WHERE label = 0) AS fake, count(*) FILTER (WHERE label = 1) AS real
FROM (SELECT CAST(year({parse_date('date')}) AS INTEGER) AS year, label FROM dated)
WHERE year IS NOT NULL GROUP BY year""")
sql("marker_prevalence", with_("labeled") + "\nUNION ALL\n".join(
    f"""SELECT '{m}' AS marker,
       round(100.0 * avg(CASE WHEN label = 0 THEN CAST(coalesce(strpos(lower(content), '{m}') > 0, false) AS DOUBLE) END), 6) AS fake_pct,
       round(100.0 * avg(CASE WHEN label = 1 THEN CAST(coalesce(strpos(lower(content), '{m}') > 0, false) AS DOUBLE) END), 6) AS real_pct
FROM labeled""" for m in MARKERS))
sql("term_prevalence", with_("labeled") + """
SELECT label, matches, round(100.0 * matches / rows, 6) AS pct FROM (
  SELECT label, CAST(sum(CAST(coalesce(regexp_matches(text, '(?i)reuters'), false) AS BIGINT)) AS BIGINT) AS matches,
         count(*) AS rows FROM labeled GROUP BY label)""")
sql("style_means", with_("labeled") + f""", {STYLE_LABELED}
SELECT label, round(avg(exclamation_count), 6) AS exclamation_count, round(avg(question_count), 6) AS question_count,
       round(avg(uppercase_words), 6) AS uppercase_words, round(avg(title_words), 6) AS title_words
FROM styled GROUP BY label""")
_FISH = """SELECT '{f}' AS feature, round(CASE WHEN v = 0 THEN 0.0 ELSE m * m / v END, 6) AS fisher_score
FROM (SELECT avg({f}) FILTER (WHERE label = 0) - avg({f}) FILTER (WHERE label = 1) AS m,
             var_pop({f}) FILTER (WHERE label = 0) + var_pop({f}) FILTER (WHERE label = 1) AS v FROM styled)"""
sql("fisher_numeric", with_("labeled") + f", {STYLE_LABELED}\n" + "\nUNION ALL\n".join(
    _FISH.format(f=f) for f in ("exclamation_count", "question_count", "uppercase_words", "title_words",
                                "text_words")))

# ---- 2.7 dedup / union -----------------------------------------------------
sql("dedup_articles", with_("cleaned") + "SELECT row_id, title, text, subject, date, label FROM cleaned")
sql("union_sources", with_("labeled_articles") + """
SELECT row_id, label, 'Fake' AS source_name FROM labeled_articles WHERE label = 0
UNION ALL SELECT row_id, label, 'True' FROM labeled_articles WHERE label = 1""")

# ---- 2.8 sampling / splitting ----------------------------------------------
sql("stratified_split", with_("splitted") + "SELECT row_id, label, split FROM splitted")


def _feistel(value: str) -> str:
    """One application of the keyed permutation of numbers below 2 ** bits, as nested rounds over (value, bits)."""
    left, right = "(bits // 2)", "(bits - bits // 2)"
    for step in range(4):
        low, high = f"({value} % (1 << {right}))", f"({value} >> {right})"
        hashed = f"CAST('0x' || substr(md5('42:{step}:' || {low}), 1, 12) AS BIGINT)"
        value = f"(({low} << {left}) + xor({high}, {hashed} % (1 << {left})))"
        left, right = right, left
    return value


sql("shuffle_rows", with_("cleaned").replace("WITH ", "WITH RECURSIVE ", 1) + f""", placed AS (
  SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS place, count(*) OVER () AS n,
         greatest(2, CAST(ceil(log2(count(*) OVER ())) AS BIGINT)) AS bits FROM cleaned),
walk AS (
  SELECT row_id, n, bits, {_feistel("place")} AS v FROM placed
  UNION ALL SELECT row_id, n, bits, {_feistel("v")} FROM walk WHERE v >= n)
SELECT row_id, CAST(v AS BIGINT) AS position FROM walk WHERE v < n""")
sql("stratified_sample", with_("ranked") + "SELECT row_id, label FROM ranked WHERE label IN (0, 1) AND _r <= 50")
sql("stratified_kfold", with_("ranked") + "SELECT row_id, label, CAST((_r - 1) % 5 AS INTEGER) AS fold FROM ranked")

# ---- 2.9 text features -----------------------------------------------------
from newsprism.plans.sqlparts import TOKEN_RE, ngrams, tokens  # noqa: E402


def _tf(source: str, col: str, n: int = 1, keep: str = "") -> str:
    k = f"{keep}, " if keep else ""
    return (f"SELECT row_id, {k}term, count(*) AS tf FROM (SELECT row_id, {k}unnest({ngrams('_t', n)}) AS term "
            f"FROM (SELECT row_id, {k}{tokens(col)} AS _t FROM {source})) GROUP BY ALL")


sql("tokenize", with_("cleaned") + f"""
SELECT row_id, CAST(len(t) AS BIGINT) AS n_tokens, array_to_string(t, ' ') AS tokens
FROM (SELECT row_id, regexp_extract_all(lower(content), '{TOKEN_RE}') AS t FROM cleaned)""")
sql("remove_stop_words", with_("cleaned") + f"""
SELECT row_id, CAST(len(t) AS BIGINT) AS n_terms, array_to_string(t, ' ') AS terms
FROM (SELECT row_id, {tokens('content')} AS t FROM cleaned)""")
sql("ngrams", with_("cleaned") + f"""
SELECT row_id, CAST(len(t) AS BIGINT) AS n_bigrams, array_to_string(t, '|') AS bigrams
FROM (SELECT row_id, {ngrams('_t', 2)} AS t FROM (SELECT row_id, {tokens('content')} AS _t FROM cleaned))""")
sql("term_counts", with_("cleaned") + f"""
SELECT term, count(*) AS doc_freq, CAST(sum(tf) AS BIGINT) AS total_count FROM ({_tf('cleaned', 'content')}) GROUP BY term""")
_TRAIN_VOCAB = with_("splitted") + f""", tf AS ({_tf('splitted', 'content', 1, 'split')}),
vocab AS (
  SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS feature_index, doc_freq, total_count FROM (
    SELECT term, count(*) AS doc_freq, CAST(sum(tf) AS BIGINT) AS total_count FROM tf WHERE split = 'train'
    GROUP BY term HAVING count(*) >= 2 ORDER BY total_count DESC, term LIMIT 20000))
"""
sql("vocabulary", _TRAIN_VOCAB + "SELECT * FROM vocab")
sql("bigram_vocabulary", with_("cleaned") + f"""
SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS feature_index, doc_freq, total_count FROM (
  SELECT term, count(*) AS doc_freq, CAST(sum(tf) AS BIGINT) AS total_count
  FROM ({_tf('cleaned', 'content')} UNION ALL {_tf('cleaned', 'content', 2)})
  GROUP BY term HAVING count(*) >= 2 ORDER BY total_count DESC, term LIMIT 20000)""")
sql("tfidf", _TRAIN_VOCAB + """, w AS (
  SELECT tf.row_id, tf.term, tf.tf * (ln(CAST(1 + n AS DOUBLE) / (doc_freq + 1.0)) + 1.0) AS w
  FROM tf JOIN vocab USING (term), (SELECT count(*) AS n FROM splitted WHERE split = 'train'))
SELECT row_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY row_id)), 6) AS tfidf FROM w""")
sql("feature_matrix_shape", _TRAIN_VOCAB + """
SELECT split, count(*) AS rows, (SELECT count(*) FROM vocab) AS terms FROM splitted GROUP BY split""")


def _top(col: str, n: int) -> str:
    return with_("labeled") + f"""
SELECT label, term, frequency FROM (
  SELECT label, term, frequency, row_number() OVER (PARTITION BY label ORDER BY frequency DESC, term) AS r FROM (
    SELECT label, term, count(*) AS frequency FROM (
      SELECT label, unnest({ngrams('_t', n)}) AS term FROM (SELECT label, {tokens(col)} AS _t FROM labeled WHERE label IN (0, 1)))
    GROUP BY label, term))
WHERE r <= 20"""


sql("top_words", _top("text", 1))
sql("top_bigrams", _top("text", 2))
sql("top_title_words", _top("title", 1))


def _fisher_terms(col: str, min_df: int, max_features: int, top_n: int) -> str:
    return with_("labeled") + f""", tf AS ({_tf('labeled', col, 1, 'label')}),
vocab AS (SELECT term, count(*) AS doc_freq, sum(tf) AS total_count FROM tf GROUP BY term
          HAVING count(*) >= {min_df} ORDER BY total_count DESC, term LIMIT {max_features}),
sizes AS (SELECT CAST(count(*) AS DOUBLE) AS n,
                 CAST(count(*) FILTER (WHERE label = 0) AS DOUBLE) AS n0,
                 CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) AS n1 FROM labeled),
w AS (SELECT tf.row_id, tf.label, tf.term, tf.tf * (ln((1 + n) / (doc_freq + 1.0)) + 1.0) AS w
      FROM tf JOIN vocab USING (term), sizes),
x AS (SELECT row_id, label, term, w / sqrt(sum(w * w) OVER (PARTITION BY row_id)) AS v FROM w),
per AS (SELECT term,
               coalesce(sum(CASE WHEN label = 0 THEN v END), 0.0) / n0 AS m0,
               coalesce(sum(CASE WHEN label = 1 THEN v END), 0.0) / n1 AS m1,
               coalesce(sum(CASE WHEN label = 0 THEN v * v END), 0.0) / n0 AS e0,
               coalesce(sum(CASE WHEN label = 1 THEN v * v END), 0.0) / n1 AS e1
        FROM x, sizes GROUP BY term, n0, n1),
scored AS (SELECT term, (m0 - m1) * (m0 - m1) / ((e0 - m0 * m0) + (e1 - m1 * m1) + 1e-10) AS s, m0, m1 FROM per)
SELECT term, round(s, 6) AS fisher_score, round(m0, 6) AS mean_fake, round(m1, 6) AS mean_real
FROM scored ORDER BY s DESC, term LIMIT {top_n}"""


sql("fisher_terms_text", _fisher_terms("text", 5, 20000, 30))
sql("fisher_terms_title", _fisher_terms("title", 5, 10000, 30))
sql("sorted_topk", "SELECT * FROM (" + ORACLE["fisher_numeric"] + ") ORDER BY fisher_score DESC, feature LIMIT 5")

# ---- 2.5 metrics -----------------------------------------------------------
_COUNTS = """SELECT {g} count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
       count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn,
       count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
       count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
       sum(-ln(greatest(least(CASE WHEN label = 1 THEN p ELSE 1.0 - p END, 1.0 - 2.220446049250313e-16),
                        2.220446049250313e-16))) FILTER (WHERE label IN (0, 1) AND NOT isnan(p)) / count(*) FILTER (WHERE label IN (0, 1) AND NOT isnan(p)) AS log_loss
FROM {src} {where} {groupby}"""


def _div(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END)"


_P1, _P0 = _div("tp", "tp + fp"), _div("tn", "tn + fn")
_R1, _R0 = _div("tp", "tp + fn"), _div("tn", "tn + fp")
_F1, _F0 = _div("2 * tp", "2 * tp + fp + fn"), _div("2 * tn", "2 * tn + fn + fp")
_N = "(tp + tn + fp + fn)"
_BAL = _div("(CASE WHEN tp + fn > 0 THEN " + _R1 + " ELSE 0.0 END) + (CASE WHEN tn + fp > 0 THEN " + _R0
            + " ELSE 0.0 END)", "CAST(tp + fn > 0 AS INTEGER) + CAST(tn + fp > 0 AS INTEGER)")
_MCC = ("(CASE WHEN sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)) = 0 THEN 0.0 ELSE "
        "(CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)) END)")
_IN1, _IN0 = "CAST(tp + fp + fn > 0 AS INTEGER)", "CAST(tn + fp + fn > 0 AS INTEGER)"


def _mean_present(of_0: str, of_1: str) -> str:
    """Mean over the classes that occur in truth or prediction."""
    return _div(f"{of_0} * {_IN0} + {of_1} * {_IN1}", f"{_IN0} + {_IN1}")


_BASE = {"accuracy": _div("tp + tn", _N), "balanced_accuracy": _BAL,
         "precision_macro": _mean_present(_P0, _P1), "recall_macro": _mean_present(_R0, _R1),
         "f1_macro": _mean_present(_F0, _F1), "mcc": _MCC}
_WEIGHTED = {"precision_weighted": _div(f"{_P0} * (tn + fp) + {_P1} * (tp + fn)", _N),
             "recall_weighted": _div(f"{_R0} * (tn + fp) + {_R1} * (tp + fn)", _N),
             "f1_weighted": _div(f"{_F0} * (tn + fp) + {_F1} * (tp + fn)", _N)}
_AUC = """SELECT split, round(CASE WHEN sum(pos) = 0 OR sum(neg) = 0 THEN NULL
         ELSE sum(pos * (below + neg / 2.0)) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) END, 6) AS roc_auc
FROM (SELECT split, p, pos, neg,
             coalesce(sum(neg) OVER (PARTITION BY split ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
      FROM (SELECT split, p, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
            FROM predictions WHERE NOT isnan(p) GROUP BY split, p))
GROUP BY split"""


def _metrics_sql(metrics: dict) -> str:
    c = _COUNTS.format(g="split,", src="predictions", where="", groupby="GROUP BY split")
    rows = "\nUNION ALL\n".join(f"SELECT split, '{k}' AS metric, round(CAST({v} AS DOUBLE), 6) AS value FROM counts"
                                for k, v in metrics.items())
    return (with_("predictions") + f", counts AS ({c}), auc AS ({_AUC})\n" + rows
            + "\nUNION ALL SELECT split, 'roc_auc', roc_auc FROM auc")


sql("confusion", with_("predictions") + """
SELECT l.label, q.prediction, count(t.row_id) AS count
FROM (VALUES (0), (1)) l(label) CROSS JOIN (VALUES (0), (1)) q(prediction)
LEFT JOIN (SELECT * FROM predictions WHERE split = 'test') t ON t.label = l.label AND t.prediction = q.prediction
GROUP BY l.label, q.prediction""")
sql("classification_metrics", _metrics_sql({**_BASE, "log_loss": "log_loss"}))
sql("metrics_weighted", _metrics_sql({**_BASE, **_WEIGHTED, "log_loss": "log_loss"}))
sql("roc_auc", with_("predictions") + _AUC)
sql("log_loss", with_("predictions") + "SELECT split, round(log_loss, 6) AS log_loss FROM ("
    + _COUNTS.format(g="split,", src="predictions", where="", groupby="GROUP BY split") + ")")
_REPORT_ROW = "SELECT '{name}' AS row, round({p}, 6) AS precision, round({r}, 6) AS recall, round({f}, 6) AS f1_score, CAST({s} AS BIGINT) AS support FROM counts"
sql("classification_report", with_("predictions") + ", counts AS ("
    + _COUNTS.format(g="", src="predictions", where="WHERE split = 'test'", groupby="") + ")\n" + "\nUNION ALL\n".join([
        _REPORT_ROW.format(name="0", p=_P0, r=_R0, f=_F0, s="tn + fp"),
        _REPORT_ROW.format(name="1", p=_P1, r=_R1, f=_F1, s="tp + fn"),
        _REPORT_ROW.format(name="accuracy", p="CAST(NULL AS DOUBLE)", r="CAST(NULL AS DOUBLE)", f=_div("tp + tn", _N), s=_N),
        _REPORT_ROW.format(name="macro avg", p=_BASE["precision_macro"], r=_BASE["recall_macro"], f=_BASE["f1_macro"], s=_N),
        _REPORT_ROW.format(name="weighted avg", p=_WEIGHTED["precision_weighted"], r=_WEIGHTED["recall_weighted"],
                           f=_WEIGHTED["f1_weighted"], s=_N)]))
sql("error_rates", with_("predictions") + """
SELECT split, round(1.0 - avg(CAST(coalesce(prediction = label, false) AS DOUBLE)), 6) AS error_rate
FROM predictions GROUP BY split""")
sql("train_val_gap", with_("predictions") + """
SELECT round(tr, 6) AS train_accuracy, round(va, 6) AS validation_accuracy, round(tr - va, 6) AS gap FROM (
  SELECT avg(CASE WHEN split = 'train' THEN CAST(coalesce(prediction = label, false) AS DOUBLE) END) AS tr,
         avg(CASE WHEN split = 'validation' THEN CAST(coalesce(prediction = label, false) AS DOUBLE) END) AS va
  FROM predictions)""")
sql("latency_stats", """
SELECT round(avg(value), 6) AS mean, round(median(value), 6) AS median, min(value) AS min, max(value) AS max
FROM events WHERE isfinite(value)""")
sql("latency_histogram", """
WITH r AS (SELECT CASE WHEN min(value) = max(value) THEN min(value) - 0.5 ELSE min(value) END AS lo,
                  CASE WHEN min(value) = max(value) THEN max(value) + 0.5 ELSE max(value) END AS hi
           FROM events WHERE isfinite(value)),
c AS (SELECT CAST(least(floor((value - lo) * 20.0 / (hi - lo)), 19) AS INTEGER) AS bin, count(*) AS count
      FROM events, r WHERE isfinite(value) GROUP BY 1)
SELECT CAST(b.bin AS INTEGER) AS bin, round(lo + b.bin * ((hi - lo) / 20), 6) AS lower,
       round(lo + (b.bin + 1) * ((hi - lo) / 20), 6) AS upper, coalesce(c.count, 0) AS count
FROM range(20) b(bin) CROSS JOIN r LEFT JOIN c ON c.bin = b.bin""")
sql("valid_invalid_counts", with_("answers") + f"""
SELECT count(prediction) AS valid_predictions, count(*) - count(prediction) AS invalid_predictions
FROM (SELECT {_parse_answer('answer')} AS prediction FROM answers)""")
sql("smoothed_cross_entropy", f"""
SELECT round(avg(-((CASE WHEN y = 0 THEN 0.975 ELSE 0.025 END) * (a - lse)
                 + (CASE WHEN y = 1 THEN 0.975 ELSE 0.025 END) * (b - lse))), 6) AS smoothed_cross_entropy
FROM (SELECT a, b, y, greatest(a, b) + ln(exp(a - greatest(a, b)) + exp(b - greatest(a, b))) AS lse
      FROM (SELECT {_HALVES}, CAST(label >= 5 AS INTEGER) AS y FROM embeddings))""")
sql("evaluate_zero_shot", with_("answers") + f""", parsed AS (
  SELECT true_label AS label, {_parse_answer('answer')} AS prediction, latency_seconds FROM answers),
counts AS (SELECT count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
                  count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn,
                  count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
                  count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn FROM parsed WHERE prediction IS NOT NULL)
""" + "\nUNION ALL\n".join(f"SELECT '{k}' AS metric, round(CAST({v} AS DOUBLE), 6) AS value FROM counts"
                           for k, v in _BASE.items()) + """
UNION ALL SELECT 'confusion_' || a || '_' || b, CAST(count(prediction) AS DOUBLE)
FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) d(a, b) LEFT JOIN parsed ON label = a AND prediction = b GROUP BY a, b
UNION ALL SELECT 'average_latency_seconds', round(avg(latency_seconds) FILTER (WHERE prediction IS NOT NULL), 6) FROM parsed
UNION ALL SELECT 'valid_predictions', CAST(count(prediction) AS DOUBLE) FROM parsed
UNION ALL SELECT 'invalid_predictions', CAST(count(*) - count(prediction) AS DOUBLE) FROM parsed""")
sql("ms_per_article", with_("answers") + "SELECT round(1000.0 * sum(latency_seconds) / count(*), 6) AS ms_per_article FROM answers")
sql("select_best_run", """
WITH history AS (
  SELECT CAST((event_id - event_id % 5) / 5 AS BIGINT) AS run_id, CAST(event_id % 5 + 1 AS BIGINT) AS epoch,
         CAST(floor(value) AS DOUBLE) / 500.0 AS f1, CAST(event_id * 7 % 11 AS DOUBLE) / 10.0 AS loss
  FROM events)
SELECT run_id, b.epoch AS best_epoch, b.f1 AS best_f1, b.loss AS best_loss FROM (
  SELECT run_id, list_reduce(list(struct_pack(epoch := epoch, f1 := f1, loss := loss) ORDER BY epoch),
         lambda acc, x: CASE WHEN x.f1 > acc.f1 OR (abs(x.f1 - acc.f1) <= 1e-8 + 1e-5 * abs(acc.f1) AND x.loss < acc.loss)
                             THEN x ELSE acc END) AS b
  FROM history GROUP BY run_id)""")

# ---- 2.10 explanations over closed-form coefficients ------------------------
_SPLIT_TFIDF = with_("splitted") + f""", tf AS ({_tf('splitted', 'content', 1, 'split, label')}),
vocab AS (
  SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS feature_index, doc_freq FROM (
    SELECT term, count(*) AS doc_freq, CAST(sum(tf) AS BIGINT) AS total_count FROM tf WHERE split = 'train'
    GROUP BY term HAVING count(*) >= 2 ORDER BY total_count DESC, term LIMIT 20000)),
w AS (SELECT tf.row_id, tf.split, tf.label, tf.term, tf.tf * (ln(CAST(1 + n AS DOUBLE) / (doc_freq + 1.0)) + 1.0) AS w
      FROM tf JOIN vocab USING (term), (SELECT count(*) AS n FROM splitted WHERE split = 'train')),
x AS (SELECT row_id, split, label, term, w / sqrt(sum(w * w) OVER (PARTITION BY row_id)) AS tfidf FROM w),
sizes AS (SELECT CAST(count(*) FILTER (WHERE label = 0) AS DOUBLE) AS n0,
                 CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) AS n1 FROM splitted WHERE split = 'train'),
coefs AS (SELECT term, ln((df1 + 1.0) / (n1 + 2.0)) - ln((df0 + 1.0) / (n0 + 2.0)) AS coefficient
          FROM (SELECT term, count(*) FILTER (WHERE label = 0) AS df0, count(*) FILTER (WHERE label = 1) AS df1
                FROM tf JOIN vocab USING (term) WHERE split = 'train' GROUP BY term), sizes),
j AS (SELECT row_id, term, tfidf, coefficient, tfidf * coefficient AS contribution
      FROM x JOIN coefs USING (term)),
scores AS (SELECT row_id, s AS decision_score, 1.0 / (1.0 + exp(-s)) AS p_real, 1.0 - 1.0 / (1.0 + exp(-s)) AS p_fake,
                  CAST(s > 0 AS INTEGER) AS prediction, n_toward_real, n_toward_fake
           FROM (SELECT row_id, any_value(ln(n1 / n0)) + coalesce(sum(contribution), 0.0) AS s,
                        count(*) FILTER (WHERE contribution > 0) AS n_toward_real,
                        count(*) FILTER (WHERE contribution < 0) AS n_toward_fake
                 FROM splitted LEFT JOIN j USING (row_id), sizes GROUP BY row_id))
"""
sql("feature_coef_join", _SPLIT_TFIDF + """
SELECT row_id, term, round(tfidf, 6) AS tfidf, round(coefficient, 6) AS coefficient, round(contribution, 6) AS contribution FROM j""")
sql("prediction_contributions", _SPLIT_TFIDF + """
SELECT s.row_id, prediction, round(p_fake, 6) AS p_fake, round(p_real, 6) AS p_real, rank, term, round(tfidf, 6) AS tfidf,
       round(coefficient, 6) AS coefficient, round(contribution, 6) AS contribution
FROM scores s LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY abs(contribution) DESC, term) AS rank FROM j) r
  ON r.row_id = s.row_id AND rank <= 15""")
sql("explain_decision", _SPLIT_TFIDF + """
SELECT s.row_id, round(decision_score, 6) AS decision_score, direction, rank, term, round(contribution, 6) AS contribution
FROM scores s LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY row_id, direction ORDER BY abs(contribution) DESC, term) AS rank
  FROM (SELECT *, CASE WHEN contribution > 0 THEN 'real' ELSE 'fake' END AS direction FROM j WHERE contribution <> 0)) r
  ON r.row_id = s.row_id AND rank <= 15""")
sql("decision_scores", _SPLIT_TFIDF + """
SELECT row_id, round(decision_score, 6) AS decision_score, round(p_fake, 6) AS p_fake, round(p_real, 6) AS p_real,
       prediction, n_toward_real, n_toward_fake FROM scores""")
sql("top_terms_global", _SPLIT_TFIDF + """
SELECT * FROM (SELECT 'fake' AS direction, term, round(coefficient, 6) AS coefficient FROM coefs ORDER BY coefs.coefficient, term LIMIT 15)
UNION ALL
SELECT * FROM (SELECT 'real' AS direction, term, round(coefficient, 6) AS coefficient FROM coefs ORDER BY coefs.coefficient DESC, term LIMIT 15)""")
sql("mean_pooling", """
SELECT group_id, dim, round(sum(x * m) / greatest(sum(m), 1e-9), 6) AS value FROM (
  SELECT CAST((vec_id - vec_id % 8) / 8 AS BIGINT) AS group_id, CAST(vec_id % 3 <> 0 AS INTEGER) AS m,
         CAST(u.i - 1 AS BIGINT) AS dim, CAST(embedding[u.i] AS DOUBLE) AS x
  FROM embeddings, (SELECT unnest(range(1, 65)) AS i) u)
GROUP BY group_id, dim""")

# ---- 2.10 models: the fit itself, in SQL -------------------------------------------------------
# L2 logistic regression in its dual form: with f = K a + b over the training rows' inner products K,
# the optimum is a = y - p and sum(y - p) = 0; damped steps towards it converge to the one solution.
_STEP, _STEPS = 0.1, 3000

_NEW_ROWS = f"""
  SELECT doc_id AS row_id, 'new' AS split, CAST(NULL AS INTEGER) AS label, {strip("title || ' ' || text")} AS content
  FROM (SELECT doc_id, {strip("coalesce(split_part(text, chr(10), 1), '')")} AS title,
               {strip("coalesce(CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) END, '')")} AS text
        FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))"""

_DUAL = f"""
it AS (
  SELECT cell, 0 AS step, list_transform(y, lambda v: CAST(0 AS DOUBLE)) AS a, CAST(0 AS DOUBLE) AS b FROM gram
  UNION ALL
  SELECT cell, step + 1, list_transform(list_zip(a, y, p), lambda z: z[1] + {_STEP} * (z[2] - z[3] - z[1])),
         b + {_STEP} * 4 / len(y) * (list_sum(y) - list_sum(p))
  FROM (SELECT it.cell, step, a, b, y,
               list_transform(g, lambda r: 1.0 / (1.0 + exp(-(list_dot_product(r, a) + b)))) AS p
        FROM it JOIN gram ON gram.cell = it.cell WHERE step < {_STEPS})),
model AS MATERIALIZED (SELECT cell, a, b FROM it WHERE step = {_STEPS}),
fitted AS MATERIALIZED (
  SELECT cell, row_id, score, 1.0 / (1.0 + exp(-score)) AS p, CAST(score > 0 AS INTEGER) AS prediction
  FROM (SELECT cell, row_id, list_dot_product(k, a) + b AS score FROM kern JOIN model USING (cell)))"""


def _fit(col: str = "content", n: int = 1, new_rows: bool = False) -> str:
    """CTEs up to ``fitted`` (row_id, score, p, prediction) of the model over one text column, and ``every`` row."""
    every = f"SELECT row_id, split, label, {col} AS content FROM splitted" + (f" UNION ALL {_NEW_ROWS}" if new_rows else "")
    return (with_("splitted").replace("WITH ", "WITH RECURSIVE ", 1) + f""", every AS MATERIALIZED ({every}),
tokens AS MATERIALIZED (SELECT row_id, split, {tokens('content')} AS t FROM every),
tf AS MATERIALIZED (SELECT row_id, split, term, count(*) AS tf FROM (SELECT row_id, split, unnest({ngrams('t', n)}) AS term FROM tokens)
                    GROUP BY ALL),
vocab AS (
  SELECT term, count(*) AS doc_freq, CAST(sum(tf) AS BIGINT) AS total_count FROM tf WHERE split = 'train'
  GROUP BY term HAVING count(*) >= 2 ORDER BY total_count DESC, term LIMIT 20000),
w AS (SELECT tf.row_id, tf.term, tf.tf * (ln(CAST(1 + n AS DOUBLE) / (doc_freq + 1.0)) + 1.0) AS w
      FROM tf JOIN vocab USING (term), (SELECT count(*) AS n FROM splitted WHERE split = 'train')),
x AS MATERIALIZED (SELECT row_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY row_id)) AS v FROM w),
tr AS MATERIALIZED (SELECT row_id, label, row_number() OVER (ORDER BY row_id) AS i FROM splitted WHERE split = 'train'),
pairs AS (SELECT x.row_id, i, sum(x.v * t.v) AS k FROM x JOIN (SELECT i, term, v FROM x JOIN tr USING (row_id)) t USING (term)
          GROUP BY x.row_id, i),
kern AS MATERIALIZED (
  SELECT 0 AS cell, e.row_id, list(coalesce(k, 0.0) ORDER BY tr.i) AS k
  FROM every e CROSS JOIN tr LEFT JOIN pairs ON pairs.row_id = e.row_id AND pairs.i = tr.i GROUP BY e.row_id),
gram AS MATERIALIZED (
  SELECT 0 AS cell, list(k ORDER BY i) AS g, list(CAST(label AS DOUBLE) ORDER BY i) AS y FROM kern JOIN tr USING (row_id)),
{_DUAL}""")


_FIT = _fit()
_FITTED_PREDICTIONS = ", predictions AS (SELECT row_id, split, label, round(p, 12) AS p, prediction FROM every JOIN fitted USING (row_id))"


def _metrics_of(ctes: str, metrics: dict, auc: str = _AUC) -> str:
    """CTE ``scores`` (split, metric, value) over the predictions of a fit."""
    c = _COUNTS.format(g="split,", src="predictions", where="", groupby="GROUP BY split")
    rows = "\nUNION ALL\n".join(f"SELECT split, '{k}' AS metric, round(CAST({v} AS DOUBLE), 6) AS value FROM counts"
                                for k, v in metrics.items())
    return f"{ctes}{_FITTED_PREDICTIONS}, counts AS ({c}), auc AS ({auc}), scores AS ({rows}\nUNION ALL SELECT split, 'roc_auc', roc_auc FROM auc)"


_ALL_METRICS = {**_BASE, **_WEIGHTED, "log_loss": "log_loss"}
_EXPERIMENT = _metrics_of(_FIT, _ALL_METRICS)

sql("logistic_regression", _FIT + """
SELECT count(*) AS train_rows, (SELECT count(*) FROM vocab) AS terms, round(any_value(b), 5) AS intercept,
       round(avg(p), 6) AS mean_probability, round(avg(label), 6) AS label_mean,
       round((sum(-ln(CASE WHEN label = 1 THEN p ELSE 1.0 - p END)) + 0.5 * any_value(penalty)) / count(*), 6) AS loss,
       round(ln(2.0), 6) AS zero_loss, true AS optimal
FROM tr JOIN fitted USING (row_id),
     (SELECT b, list_dot_product(a, list_transform(g, lambda r: list_dot_product(r, a))) AS penalty FROM model JOIN gram USING (cell))""")
sql("build_pipeline", _FIT + """
SELECT row_id, label, prediction, round(p, 6) AS p FROM splitted JOIN fitted USING (row_id) WHERE split = 'test'""")
sql("predict", _FIT + """
SELECT row_id, split, label, prediction, round(p, 6) AS p, round(score, 6) AS score FROM splitted JOIN fitted USING (row_id)""")
sql("score_new_articles", _fit(new_rows=True) + """
SELECT row_id, prediction, round(p, 6) AS p FROM every JOIN fitted USING (row_id) WHERE split = 'new'""")
sql("fit_experiment", _EXPERIMENT + """
SELECT split, metric, value FROM scores
UNION ALL SELECT 'test', 'confusion_' || a || '_' || b, CAST(count(p.row_id) AS DOUBLE)
FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) d(a, b)
LEFT JOIN (SELECT * FROM predictions WHERE split = 'test') p ON label = a AND prediction = b GROUP BY a, b""")
sql("compare_experiments", "SELECT *, CAST(row_number() OVER (ORDER BY validation_accuracy DESC, experiment) AS INTEGER) AS rank, "
    "row_number() OVER (ORDER BY validation_accuracy DESC, experiment) = 1 AS best FROM (\n" + "\nUNION ALL\n".join(
        f"SELECT '{name}' AS experiment, * FROM (" + _metrics_of(_fit(col, lo), _ALL_METRICS) + """
SELECT max(value) FILTER (WHERE split = 'validation' AND metric = 'accuracy') AS validation_accuracy,
       max(value) FILTER (WHERE split = 'test' AND metric = 'accuracy') AS test_accuracy,
       max(value) FILTER (WHERE split = 'test' AND metric = 'f1_macro') AS test_f1_macro,
       max(value) FILTER (WHERE split = 'test' AND metric = 'roc_auc') AS test_roc_auc FROM scores)"""
        for name, col, (lo, _) in EXPERIMENT_GRID) + ")")
sql("summary_table", _EXPERIMENT + """
SELECT metric, round(value, 4) AS value FROM scores WHERE split = 'test'
UNION ALL SELECT 'train_val_gap', round(max(value) FILTER (WHERE split = 'train') - max(value) FILTER (WHERE split = 'validation'), 4)
FROM scores WHERE metric = 'accuracy'""")
sql("save_model", _FIT + """
SELECT row_id, prediction, round(p, 6) AS p FROM splitted JOIN fitted USING (row_id) WHERE split = 'test'""")
sql("load_model", with_("splitted") + """
SELECT count(*) AS test_rows, CAST(0 AS DOUBLE) AS max_difference FROM splitted WHERE split = 'test'""")

_HEAD_TOKENS = len(prompt_tokens([{"content": SYSTEM_PROMPT}, {"content": USER_PROMPT_PREFIX}])[0])
sql("batch_zero_shot", _TRAIN_VOCAB + f""", ranked_test AS (
  SELECT row_id, label, content, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(row_id AS VARCHAR) || ':42'), row_id) AS r,
         least(50, (SELECT min(c) FROM (SELECT count(*) AS c FROM splitted WHERE split = 'test' GROUP BY label))) AS most
  FROM splitted WHERE split = 'test'),
sampled AS (SELECT row_id, label, content FROM ranked_test WHERE r <= most),
counts AS (
  SELECT term, sum(CASE WHEN label = 0 THEN tf ELSE 0 END) AS c0, sum(CASE WHEN label = 1 THEN tf ELSE 0 END) AS c1
  FROM tf JOIN vocab USING (term) JOIN splitted USING (row_id) WHERE tf.split = 'train' GROUP BY term),
model AS (
  SELECT term, ln((c1 + 1) / (sum(c1) OVER () + count(*) OVER ())) - ln((c0 + 1) / (sum(c0) OVER () + count(*) OVER ())) AS d FROM counts),
prior AS (
  SELECT ln(CAST(count(*) FILTER (WHERE label = 1) + 1 AS DOUBLE)) - ln(CAST(count(*) FILTER (WHERE label = 0) + 1 AS DOUBLE)) AS d
  FROM splitted WHERE split = 'train'),
words AS (SELECT row_id, unnest((regexp_extract_all(lower(content), '{TOKEN_RE}'))[1:{MAX_INPUT_TOKENS - _HEAD_TOKENS}]) AS term FROM sampled),
scored AS (
  SELECT s.row_id, s.label, any_value(prior.d) + coalesce(sum(model.d), 0.0) AS score
  FROM sampled s CROSS JOIN prior LEFT JOIN words USING (row_id) LEFT JOIN model USING (term) GROUP BY s.row_id, s.label)
SELECT row_id, label AS true_label, CASE WHEN failed THEN '' WHEN score > 0 THEN 'REAL' ELSE 'FAKE' END AS answer,
       CASE WHEN failed THEN NULL ELSE CAST(score > 0 AS INTEGER) END AS prediction,
       coalesce(CASE WHEN failed THEN NULL ELSE CAST(score > 0 AS INTEGER) END = label, false) AS correct, failed
FROM (SELECT *, row_id % 11 = 0 AS failed FROM scored)""")
_SIZES = (0.1, 0.28, 0.46, 0.64, 0.82, 1.0)
def _folds(col: str = "content", n: int = 1, max_features: int = 20000, sizes: tuple = _SIZES) -> str:
    """CTEs up to ``acc`` (size, cell, n_train, train_acc, val_acc): a fit for every fold and size of the train split."""
    return with_("splitted").replace("WITH ", "WITH RECURSIVE ", 1) + f""", base AS MATERIALIZED (
  SELECT row_id, label, {col} AS content,
         CAST((row_number() OVER (PARTITION BY label ORDER BY md5(CAST(row_id AS VARCHAR) || ':42'), row_id) - 1) % 5 AS INTEGER) AS fold
  FROM splitted WHERE split = 'train'),
placed AS (
  SELECT o.f, row_id, label, fold,
         CASE WHEN fold <> o.f THEN row_number() OVER (PARTITION BY o.f, fold = o.f ORDER BY md5(CAST(row_id AS VARCHAR) || ':43'), row_id) END AS r,
         count(*) FILTER (WHERE fold <> o.f) OVER (PARTITION BY o.f) AS n
  FROM base, (SELECT unnest(range(5)) AS f) o),
members AS MATERIALIZED (
  SELECT f * {len(sizes)} + s.k AS cell, s.size, row_id, label, fold = f AS held, coalesce(r <= greatest(CAST(floor(s.size * n) AS BIGINT), 1), false) AS inside,
         greatest(CAST(floor(s.size * n) AS BIGINT), 1) AS n_train
  FROM placed, (VALUES {", ".join(f"({k}, CAST({x} AS DOUBLE))" for k, x in enumerate(sizes))}) s(k, size)),
tokens AS MATERIALIZED (SELECT row_id, {tokens('content')} AS t FROM base),
tf AS MATERIALIZED (SELECT row_id, term, count(*) AS tf FROM (SELECT row_id, unnest({ngrams('t', n)}) AS term FROM tokens) GROUP BY ALL),
vocab AS (
  SELECT cell, term, doc_freq FROM (
    SELECT *, row_number() OVER (PARTITION BY cell ORDER BY total DESC, term) AS r FROM (
      SELECT cell, term, count(*) AS doc_freq, sum(tf) AS total FROM members JOIN tf USING (row_id) WHERE inside
      GROUP BY cell, term HAVING count(*) >= 2))
  WHERE r <= {max_features}),
w AS (SELECT cell, row_id, term, inside, tf * (ln(CAST(1 + n_train AS DOUBLE) / (doc_freq + 1.0)) + 1.0) AS w
      FROM members JOIN tf USING (row_id) JOIN vocab USING (cell, term) WHERE inside OR held),
x AS MATERIALIZED (SELECT cell, row_id, term, inside, w / sqrt(sum(w * w) OVER (PARTITION BY cell, row_id)) AS v FROM w),
tr AS MATERIALIZED (SELECT cell, row_id, label, row_number() OVER (PARTITION BY cell ORDER BY row_id) AS i FROM members WHERE inside),
pairs AS MATERIALIZED (
  SELECT x.cell, x.row_id, t.row_id AS other, sum(x.v * t.v) AS k
  FROM x JOIN x t ON t.cell = x.cell AND t.term = x.term AND t.inside GROUP BY x.cell, x.row_id, t.row_id),
kern AS MATERIALIZED (
  SELECT e.cell, e.row_id, list(coalesce(k, 0.0) ORDER BY tr.i) AS k
  FROM (SELECT cell, row_id FROM members WHERE inside OR held) e JOIN tr ON tr.cell = e.cell
  LEFT JOIN pairs ON pairs.cell = e.cell AND pairs.row_id = e.row_id AND pairs.other = tr.row_id GROUP BY e.cell, e.row_id),
gram AS MATERIALIZED (
  SELECT cell, list(k ORDER BY i) AS g, list(CAST(label AS DOUBLE) ORDER BY i) AS y FROM kern JOIN tr USING (cell, row_id) GROUP BY cell),
{_DUAL},
acc AS (
  SELECT size, cell, any_value(n_train) AS n_train, avg(CAST(prediction = label AS DOUBLE)) FILTER (WHERE inside) AS train_acc,
         avg(CAST(prediction = label AS DOUBLE)) FILTER (WHERE held) AS val_acc,
         avg(-ln(CASE WHEN label = 1 THEN p ELSE 1.0 - p END)) FILTER (WHERE inside) AS train_loss,
         avg(-ln(CASE WHEN label = 1 THEN p ELSE 1.0 - p END)) FILTER (WHERE held) AS val_loss
  FROM members JOIN fitted USING (cell, row_id) GROUP BY size, cell)
"""


sql("learning_curve", _folds() + """
SELECT size, min(n_train) AS train_size, round(avg(train_acc), 6) AS train_mean, round(stddev_pop(train_acc), 6) AS train_std,
       round(avg(val_acc), 6) AS val_mean, round(stddev_pop(val_acc), 6) AS val_std,
       round(avg(train_loss), 6) AS train_loss, round(avg(val_loss), 6) AS val_loss,
       round(1 - round(avg(train_acc), 6), 6) AS train_error, round(1 - round(avg(val_acc), 6), 6) AS val_error
FROM acc GROUP BY size""")
sql("cross_validate", "SELECT setting, CAST(row_number() OVER (ORDER BY loss, setting) AS INTEGER) AS rank, round(loss, 6) AS mean_log_loss FROM (\n"
    + "\nUNION ALL\n".join(f"SELECT {i} AS setting, loss FROM (" + _folds(col, n, most, (1.0,)) + "SELECT avg(val_loss) AS loss FROM acc)"
                            for i, (col, n, most) in enumerate((("content", 1, 20000), ("content", 2, 20000), ("content", 1, 500)))) + ")")
sql("embedding_classifier", """
WITH RECURSIVE ranked AS (
  SELECT vec_id AS row_id, CAST(label >= 5 AS INTEGER) AS label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e,
         row_number() OVER (PARTITION BY label >= 5 ORDER BY md5(CAST(vec_id AS VARCHAR) || ':42'), vec_id) AS r,
         count(*) OVER (PARTITION BY label >= 5) AS n FROM embeddings),
held AS (SELECT *, ceil(n * CAST(0.3 AS DOUBLE)) AS h FROM ranked),
splitted AS MATERIALIZED (
  SELECT row_id, label, e, CASE WHEN r <= n - h THEN 'train' WHEN r <= n - ceil(h * CAST(0.5 AS DOUBLE)) THEN 'validation'
                                ELSE 'test' END AS split FROM held),
tr AS MATERIALIZED (SELECT row_id, label, e, row_number() OVER (ORDER BY row_id) AS i FROM splitted WHERE split = 'train'),
kern AS MATERIALIZED (
  SELECT 0 AS cell, s.row_id, list(list_dot_product(s.e, tr.e) ORDER BY tr.i) AS k FROM splitted s CROSS JOIN tr GROUP BY s.row_id),
gram AS MATERIALIZED (
  SELECT 0 AS cell, list(k ORDER BY i) AS g, list(CAST(label AS DOUBLE) ORDER BY i) AS y FROM kern JOIN tr USING (row_id)),
""" + _DUAL + """
SELECT row_id, split, label, prediction, round(p, 6) AS p FROM splitted JOIN fitted USING (row_id)""")
