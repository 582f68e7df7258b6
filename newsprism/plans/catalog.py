"""Registered queries: key -> callable(spark, sf_dir) -> DataFrame.

Each one runs an operator of the package over whole tables (or views Spark
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsprism.functions import text as tx
from newsprism.functions import vectors as vx
from newsprism.operators import clean, embed, explore, fisher, quality, splits
from newsprism.operators import explain as ex
from newsprism.operators import inference as inf
from newsprism.operators import metrics as mt
from newsprism.operators import models as md
from newsprism.operators import terms as tm
from newsprism.operators.linear import certificate
from newsprism.plans import views as V
from newsprism.session import checkpoint_dir, cut_lineage
from newsprism.sources import articles as src
from newsprism.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(key: str):
    def deco(fn: Query) -> Query:
        REGISTRY[key] = fn
        return fn
    return deco


# ---- 2.1 sources -----------------------------------------------------------

@register("load_labeled")
def q_load_labeled(spark, sf):
    return V.labeled_articles(spark, sf)


@register("load_labeled_csv")
def q_load_labeled_csv(spark, sf):
    """The labelled sources written as two CSV folders (columns out of order, one extra) and loaded by name."""
    home = f"{checkpoint_dir(spark).rstrip('/')}/csv/{uuid.uuid4().hex}"
    rows = V.labeled_articles(spark, sf)
    for name, label in (("fake", src.FAKE_LABEL), ("real", src.REAL_LABEL)):
        own = rows.where(F.col("label") == label).select("date", F.lit("x").alias("extra"), "subject", "text", "title")
        (own.write.option("header", True).option("quoteAll", False).option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{home}/{name}"))
    loaded = src.load_labeled(spark, f"{home}/fake", f"{home}/real")
    return loaded.select("title", "text", "subject", "label")


@register("source_shape")
def q_source_shape(spark, sf):
    return quality.source_shape(V.raw_articles(spark, sf), V.cleaned(spark, sf),
                                {"fake": src.FAKE_LABEL, "real": src.REAL_LABEL})


@register("validate_columns")
def q_validate_columns(spark, sf):
    raw = V.raw_articles(spark, sf)
    src.validate_columns(raw, "articles")
    return raw.select("row_id", *src.REQUIRED_COLUMNS, "label")


@register("source_files")
def q_source_files(spark, sf):
    return src.source_files(read_table(spark, sf, "documents")).select("file_name", "count")


# ---- 2.2 projections -------------------------------------------------------

@register("normalize_text_fields")
def q_normalize(spark, sf):
    return clean.normalize_text_fields(V.raw_articles(spark, sf))


@register("build_content")
def q_build_content(spark, sf):
    n = clean.normalize_text_fields(V.raw_articles(spark, sf))
    return n.select("row_id", tx.build_content("title", "text").alias("content"))


@register("word_counts")
def q_word_counts(spark, sf):
    n = clean.normalize_text_fields(V.raw_articles(spark, sf))
    return n.select("row_id", tx.word_count("title").alias("title_words"),
                    tx.word_count("text").alias("text_words"))


@register("style_features")
def q_style_features(spark, sf):
    return explore.add_style_features(V.cleaned(spark, sf)).select(
        "row_id", *explore.STYLE_FEATURES)


def _marker_name(m: str) -> str:
    return "m_" + "".join(ch if ch.isalnum() else "_" for ch in m)


@register("marker_flags")
def q_marker_flags(spark, sf):
    c = V.cleaned(spark, sf)
    return c.select("row_id", *[tx.contains_ci("content", m).alias(_marker_name(m)) for m in tx.MARKERS])


@register("parse_dates")
def q_parse_dates(spark, sf):
    d = V.dated(spark, sf)
    return d.select("row_id", "date", tx.parse_date("date").alias("date_clean"))


@register("date_year")
def q_date_year(spark, sf):
    d = V.dated(spark, sf).select("row_id", tx.parse_date("date").alias("d"))
    return d.filter(F.col("d").isNotNull()).select("row_id", F.year("d").cast("bigint").alias("year"))


@register("decode_label")
def q_decode_label(spark, sf):
    return V.labeled(spark, sf).select("row_id", "label", tx.decode_label("label").alias("label_name"))


@register("parse_binary_answer")
def q_parse_answer(spark, sf):
    a = V.answers(spark, sf)
    return a.select("row_id", "answer", tx.parse_binary_answer("answer").alias("prediction"))


@register("build_prompt")
def q_build_prompt(spark, sf):
    c = V.cleaned(spark, sf)
    msgs = c.select("row_id", F.posexplode(tx.build_prompt("content")).alias("turn", "msg"))
    return msgs.select("row_id", F.col("turn").cast("bigint").alias("turn"),
                       F.col("msg.role").alias("role"), F.col("msg.content").alias("content"))


@register("content_preview")
def q_content_preview(spark, sf):
    return V.cleaned(spark, sf).select("row_id", tx.content_preview("content").alias("preview"))


@register("correct_flag")
def q_correct_flag(spark, sf):
    a = V.answers(spark, sf).withColumn("prediction", tx.parse_binary_answer("answer"))
    return a.select("row_id", "true_label", "prediction",
                    tx.correct_flag("prediction", "true_label").alias("correct"))


def _binary_logits(spark, sf) -> DataFrame:
    """Two logits per vector: the sums of its first and of its second half."""
    e = V.embeddings(spark, sf).withColumn("embedding", F.col("embedding").cast("array<double>"))
    half = F.floor(F.size("embedding") / 2).cast("int")
    total = lambda part: F.aggregate(part, F.lit(0.0), lambda a, x: a + x)
    return e.select("vec_id", (F.col("label") >= 5).cast("int").alias("label"),
                    F.array(total(F.slice("embedding", F.lit(1), half)),
                            total(F.slice("embedding", half + 1, F.size("embedding")))).alias("logits"))


@register("softmax_predict")
def q_softmax(spark, sf):
    lg = _binary_logits(spark, sf)
    probs = vx.softmax("logits")
    return lg.select("vec_id", vx.argmax("logits").alias("prediction"),
                     F.round(probs[1], 6).alias("p_real"))


# ---- 2.3 filters -----------------------------------------------------------

@register("blank_rows")
def q_blank_rows(spark, sf):
    return quality.blank_rows(V.raw_articles(spark, sf), "text").select("row_id", "title", "label")


@register("blank_label_dist")
def q_blank_label_dist(spark, sf):
    return quality.blank_label_dist(V.raw_articles(spark, sf), "text")


@register("invalid_dates")
def q_invalid_dates(spark, sf):
    return quality.invalid_dates(V.dated(spark, sf), "date").select("row_id", "date", "label")


@register("class_subset")
def q_class_subset(spark, sf):
    return explore.class_subset(V.labeled(spark, sf), 0, "title")


@register("misclassified")
def q_misclassified(spark, sf):
    p = V.predictions(spark, sf)
    wrong = p.filter(~tx.correct_flag("prediction", "label"))
    return wrong.orderBy("row_id").limit(20).select("row_id", "split", "label", "prediction", "p")


@register("label_domain_check")
def q_label_domain(spark, sf):
    return quality.label_domain_check(V.raw_articles(spark, sf))


@register("quarantine")
def q_quarantine(spark, sf):
    """Rows of both outputs by reason, with the counts observed while they were written."""
    home = f"{checkpoint_dir(spark).rstrip('/')}/quarantine/{uuid.uuid4().hex}"
    good, bad, seen = quality.quarantine(V.raw_articles(spark, sf), home)
    rows = good.select(F.lit("good").alias("output"), F.lit(None).cast("string").alias("reason")).unionByName(
        bad.select(F.lit("bad").alias("output"), "reason"))
    observed = F.when(F.col("output") == "good", seen["good"]).otherwise(seen["bad"]).cast("long")
    return rows.groupBy("output", "reason").agg(F.count(F.lit(1)).alias("rows")).withColumn("observed", observed)


# ---- 2.4 joins -------------------------------------------------------------

@register("class_balance_by_split")
def q_class_balance(spark, sf):
    return explore.class_balance_by_split(V.split_articles(spark, sf))


@register("select_split_rows")
def q_select_split_rows(spark, sf):
    return V.split_articles(spark, sf).filter(F.col("split") == "test").select("row_id", "label", "title")


@register("counts_reindexed")
def q_counts_reindexed(spark, sf):
    return explore.counts_reindexed(V.labeled(spark, sf))


@register("same_text_diff_title")
def q_same_text(spark, sf):
    return quality.same_text_diff_title(V.raw_articles(spark, sf)).select("row_id", "title", "label")


# ---- 2.5 aggregations --------------------------------------------------------

@register("class_counts")
def q_class_counts(spark, sf):
    return explore.class_counts(V.labeled(spark, sf))


@register("class_share")
def q_class_share(spark, sf):
    return explore.class_share(V.labeled(spark, sf))


@register("split_sizes")
def q_split_sizes(spark, sf):
    return explore.split_sizes(V.split_articles(spark, sf))


@register("null_counts")
def q_null_counts(spark, sf):
    return quality.null_counts(V.raw_articles(spark, sf))


@register("quality_report")
def q_quality_report(spark, sf):
    return quality.quality_report(V.raw_articles(spark, sf))


@register("duplicate_counts")
def q_duplicate_counts(spark, sf):
    return quality.duplicate_counts(V.raw_articles(spark, sf))


@register("label_conflicts")
def q_label_conflicts(spark, sf):
    return quality.label_conflicts(V.raw_articles(spark, sf))


@register("length_summary")
def q_length_summary(spark, sf):
    return explore.length_summary(V.labeled(spark, sf))


@register("describe_lengths")
def q_describe(spark, sf):
    return explore.describe_lengths(V.cleaned(spark, sf))


@register("subject_crosstab")
def q_subject_crosstab(spark, sf):
    return explore.subject_crosstab(V.labeled(spark, sf))


@register("year_crosstab")
def q_year_crosstab(spark, sf):
    return explore.year_crosstab(V.dated(spark, sf))


@register("marker_prevalence")
def q_marker_prevalence(spark, sf):
    return explore.marker_prevalence(V.labeled(spark, sf))


@register("term_prevalence")
def q_term_prevalence(spark, sf):
    return explore.term_prevalence(V.labeled(spark, sf), "reuters", "text")


@register("style_means")
def q_style_means(spark, sf):
    return explore.style_means(V.labeled(spark, sf))


@register("fisher_numeric")
def q_fisher_numeric(spark, sf):
    styled = explore.add_style_features(V.labeled(spark, sf))
    return fisher.fisher_numeric(styled, list(explore.STYLE_FEATURES) + ["text_words"])


# ---- 2.7 dedup / union -----------------------------------------------------

@register("dedup_articles")
def q_dedup(spark, sf):
    return clean.dedup_articles(clean.normalize_text_fields(V.raw_articles(spark, sf)))


@register("union_sources")
def q_union_sources(spark, sf):
    raw = V.labeled_articles(spark, sf)
    fake = raw.filter(F.col("label") == src.FAKE_LABEL).withColumn("source_name", F.lit("Fake"))
    real = raw.filter(F.col("label") == src.REAL_LABEL).withColumn("source_name", F.lit("True"))
    return src.union_sources([fake, real]).select("row_id", "label", "source_name")


# ---- 2.8 sampling / splitting ----------------------------------------------

@register("stratified_split")
def q_split(spark, sf):
    return V.split_articles(spark, sf).select("row_id", "label", "split")


@register("shuffle_rows")
def q_shuffle(spark, sf):
    return splits.shuffle_rows(V.cleaned(spark, sf).select("row_id")).select("row_id", "position")


@register("stratified_sample")
def q_sample(spark, sf):
    rows = cut_lineage(V.labeled(spark, sf).select("row_id", "label"))  # two jobs read it; the text is not needed
    return splits.stratified_sample(rows, per_class=50).select("row_id", "label")


@register("stratified_kfold")
def q_kfold(spark, sf):
    return splits.stratified_kfold(V.labeled(spark, sf), k=5).select("row_id", "label", "fold")


# ---- 2.9 text features -----------------------------------------------------


@register("tokenize")
def q_tokenize(spark, sf):
    c = V.cleaned(spark, sf).select("row_id", tm.tokenize("content").alias("t"))
    return c.select("row_id", F.size("t").cast("bigint").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@register("remove_stop_words")
def q_stop_words(spark, sf):
    c = V.cleaned(spark, sf).select("row_id", tm.remove_stop_words(tm.tokenize("content")).alias("t"))
    return c.select("row_id", F.size("t").cast("bigint").alias("n_terms"), F.array_join("t", " ").alias("terms"))


@register("ngrams")
def q_ngrams(spark, sf):
    c = V.cleaned(spark, sf).select("row_id", tm.analyzed_terms("content", (2, 2)).alias("t"))
    return c.select("row_id", F.size("t").cast("bigint").alias("n_bigrams"), F.array_join("t", "|").alias("bigrams"))


@register("term_counts")
def q_term_counts(spark, sf):
    return tm.stats_of(V.cleaned(spark, sf).select(tm.analyzed_terms("content").alias("t")), "t")


@register("vocabulary")
def q_vocabulary(spark, sf):
    return V.train_terms(spark, sf)[2]


@register("bigram_vocabulary")
def q_bigram_vocabulary(spark, sf):
    """Words and bigrams of all articles; most bigrams occur once and are never shuffled."""
    words = cut_lineage(V.cleaned(spark, sf).select(tm.remove_stop_words(tm.tokenize("content")).alias("w")))
    rows = words.select(F.concat("w", tm.ngrams("w", 2)).alias("t"))
    return tm.vocabulary_of(tm.heavy_stats(rows, "t"))


@register("tfidf")
def q_tfidf(spark, sf):
    return V.train_tfidf(spark, sf).select("row_id", "term", F.round("tfidf", 6).alias("tfidf"))


@register("feature_matrix_shape")
def q_feature_matrix_shape(spark, sf):
    s, _, vocab, _ = V.train_terms(spark, sf)
    n_terms = vocab.count()
    return explore.split_sizes(s).select("split", "rows", F.lit(n_terms).cast("bigint").alias("terms"))


@register("top_words")
def q_top_words(spark, sf):
    return tm.top_terms_per_class(V.labeled(spark, sf), "text", 20)


@register("top_bigrams")
def q_top_bigrams(spark, sf):
    return tm.top_terms_per_class(V.labeled(spark, sf), "text", 20, (2, 2))


@register("top_title_words")
def q_top_title_words(spark, sf):
    return tm.top_terms_per_class(V.labeled(spark, sf), "title", 20)


@register("fisher_terms_text")
def q_fisher_text(spark, sf):
    return tm.fisher_terms(cut_lineage(V.labeled(spark, sf).select("row_id", "label", "text")), "text", min_df=5, max_features=20000, top_n=30)


@register("fisher_terms_title")
def q_fisher_title(spark, sf):
    return tm.fisher_terms(cut_lineage(V.labeled(spark, sf).select("row_id", "label", "title")), "title", min_df=5, max_features=10000, top_n=30)


SORTED_TOP = 5


@register("sorted_topk")
def q_sorted_topk(spark, sf, n: int = SORTED_TOP):
    """The ``n`` highest Fisher scores, ties by feature."""
    styled = explore.add_style_features(V.labeled(spark, sf))
    scores = fisher.fisher_numeric(styled, list(explore.STYLE_FEATURES) + ["text_words"])
    return scores.orderBy(F.desc("fisher_score"), F.asc("feature")).limit(n)


# ---- 2.5 metrics -----------------------------------------------------------


@register("confusion")
def q_confusion(spark, sf):
    return mt.confusion(V.predictions(spark, sf).filter(F.col("split") == "test"))


@register("classification_metrics")
def q_classification_metrics(spark, sf):
    return mt.classification_metrics(V.predictions(spark, sf), group_cols=("split",))


@register("metrics_weighted")
def q_metrics_weighted(spark, sf):
    return mt.classification_metrics(V.predictions(spark, sf), group_cols=("split",), weighted=True)


@register("roc_auc")
def q_roc_auc(spark, sf):
    return mt.roc_auc(V.predictions(spark, sf), "label", "p", group_cols=("split",))


@register("log_loss")
def q_log_loss(spark, sf):
    return mt.log_loss(V.predictions(spark, sf), "label", "p", group_cols=("split",))


@register("classification_report")
def q_classification_report(spark, sf):
    return mt.classification_report(V.predictions(spark, sf).filter(F.col("split") == "test"))


@register("error_rates")
def q_error_rates(spark, sf):
    return mt.error_rates(V.predictions(spark, sf))


@register("train_val_gap")
def q_train_val_gap(spark, sf):
    return mt.train_val_gap(V.predictions(spark, sf))


@register("latency_stats")
def q_latency_stats(spark, sf):
    return mt.latency_stats(read_table(spark, sf, "events"), "value")


@register("latency_histogram")
def q_latency_histogram(spark, sf):
    return mt.latency_histogram(read_table(spark, sf, "events"), "value", 20)


@register("valid_invalid_counts")
def q_valid_invalid(spark, sf):
    a = V.answers(spark, sf).withColumn("prediction", tx.parse_binary_answer("answer"))
    return mt.valid_invalid_counts(a)


@register("smoothed_cross_entropy")
def q_smoothed_ce(spark, sf):
    lg = _binary_logits(spark, sf)
    return lg.agg(F.round(F.avg(vx.smoothed_cross_entropy("logits", "label", 0.05)), 6)
                  .alias("smoothed_cross_entropy"))


@register("evaluate_zero_shot")
def q_evaluate_zero_shot(spark, sf):
    a = V.answers(spark, sf).withColumn("prediction", tx.parse_binary_answer("answer"))
    return mt.evaluate_zero_shot(a)


@register("ms_per_article")
def q_ms_per_article(spark, sf):
    return mt.ms_per_article(V.answers(spark, sf), "latency_seconds")


@register("select_best_run")
def q_select_best_run(spark, sf):
    return mt.select_best_run(V.run_history(spark, sf))


# ---- 2.10 models, evaluation, explanation ------------------------------------


def _r6(*cols):
    return [F.round(c, 6).alias(c) for c in cols]


@register("feature_coef_join")
def q_feature_coef_join(spark, sf):
    j = ex.feature_coef_join(V.log_odds_coefficients(spark, sf)[2])
    return j.select("row_id", "term", *_r6("tfidf", "coefficient", "contribution"))


@register("prediction_contributions")
def q_prediction_contributions(spark, sf):
    _, intercept, parts = V.log_odds_coefficients(spark, sf)
    c = ex.prediction_contributions(parts, intercept, top_n=15)
    return c.select("row_id", "prediction", *_r6("p_fake", "p_real"), F.col("rank").cast("bigint").alias("rank"),
                    "term", *_r6("tfidf", "coefficient", "contribution"))


@register("explain_decision")
def q_explain_decision(spark, sf):
    _, intercept, parts = V.log_odds_coefficients(spark, sf)
    e = ex.explain_decision(parts, intercept, top_n=15)
    return e.select("row_id", *_r6("decision_score"), "direction", F.col("rank").cast("bigint").alias("rank"), "term",
                    *_r6("contribution"))


@register("decision_scores")
def q_decision_scores(spark, sf):
    _, intercept, parts = V.log_odds_coefficients(spark, sf)
    d = ex.decision_scores(parts, intercept)
    return d.select("row_id", *_r6("decision_score", "p_fake", "p_real"), "prediction", "n_toward_real", "n_toward_fake")


@register("top_terms_global")
def q_top_terms_global(spark, sf):
    coefs, _, _ = V.log_odds_coefficients(spark, sf)
    return ex.top_terms_global(coefs, 15).select("direction", "term", *_r6("coefficient"))


def _fitted(spark, sf, text_column="content", ngram_range=(1, 1)):
    s = V.split_articles(spark, sf, materialize=True)
    model = md.build_pipeline(ngram_range, text_col=text_column).fit(s.filter(F.col("split") == "train"))
    return s, model


@register("logistic_regression")
def q_logistic_regression(spark, sf):
    """The fit and its certificate: ``optimal`` holds if no entry of the penalised loss's gradient exceeds 1e-8."""
    train = V.split_articles(spark, sf, materialize=True).filter(F.col("split") == "train")
    vectorizer, classifier = md.build_pipeline().getStages()
    vec = vectorizer.fit(train)
    rows = cut_lineage(vec.transform(train).select("label", md.FEATURES_COL))
    model = classifier.fit(rows)
    told = certificate(rows, model.coefficients.toArray(), model.intercept)
    means = md.scored(model, rows, ("label",)).agg(F.avg("p").alias("mean_probability"), F.avg("label").alias("label_mean"))
    return means.select(F.lit(told["rows"]).cast("long").alias("train_rows"), F.lit(len(vec.terms())).cast("long").alias("terms"),
                        F.round(F.lit(model.intercept), 5).alias("intercept"), *_r6("mean_probability", "label_mean"),
                        F.round(F.lit(told["loss"]), 6).alias("loss"), F.round(F.lit(told["zero_loss"]), 6).alias("zero_loss"),
                        F.lit(told["gradient"] < 1e-8).alias("optimal"))


@register("build_pipeline")
def q_build_pipeline(spark, sf):
    s, model = _fitted(spark, sf)
    return md.predict(model, s.filter(F.col("split") == "test"), keep=("row_id", "label")).select(
        "row_id", "label", "prediction", *_r6("p"))


@register("predict")
def q_predict(spark, sf):
    s, model = _fitted(spark, sf)
    return md.predict(model, s, keep=("row_id", "split", "label")).select(
        "row_id", "split", "label", "prediction", *_r6("p", "score"))


def _experiment(spark, sf):
    s = V.split_articles(spark, sf, materialize=True)
    return md.fit_experiment("content_unigram", s, text_column="content", ngram_range=(1, 1))


@register("fit_experiment")
def q_fit_experiment(spark, sf):
    """Every metric of every split, and the cells of the test split's confusion matrix."""
    r = _experiment(spark, sf)
    cell = F.concat(F.lit("confusion_"), F.col("label").cast("string"), F.lit("_"), F.col("prediction").cast("string"))
    return r.metrics.unionByName(r.confusion.select(F.lit("test").alias("split"), cell.alias("metric"),
                                                    F.col("count").cast("double").alias("value")))


@register("compare_experiments")
def q_compare_experiments(spark, sf):
    s = V.split_articles(spark, sf, materialize=True)
    return md.compare_experiments(md.run_experiments(s)).drop("training_seconds")


@register("summary_table")
def q_summary_table(spark, sf):
    """The summary without its two wall-clock rows."""
    return md.summary_table(_experiment(spark, sf)).where(~F.col("metric").endswith("_seconds"))


@register("learning_curve")
def q_learning_curve(spark, sf):
    train = V.split_articles(spark, sf, materialize=True).filter(F.col("split") == "train")
    curve = md.learning_curve(train, text_column="content", ngram_range=(1, 1))
    return curve.withColumn("train_size", F.col("train_size").cast("bigint"))


#: Settings of the cross-validation: n-gram range and vocabulary size.
CV_GRID = [{"ngramMax": 1}, {"ngramMin": 2, "ngramMax": 2}, {"maxFeatures": 500}]


@register("cross_validate")
def q_cross_validate(spark, sf):
    """Mean log loss over the stratified folds of the train split for each setting, by Spark's CrossValidator."""
    train = V.split_articles(spark, sf, materialize=True).filter(F.col("split") == "train")
    table = md.cross_validate(train, CV_GRID, metric="logLoss", parallelism=4)
    return table.select("setting", "rank", F.round("mean", 6).alias("mean_log_loss"))


@register("embedding_classifier")
def q_embedding_classifier(spark, sf):
    e = V.embeddings(spark, sf).select(F.col("vec_id").alias("row_id"), "embedding",
                                       (F.col("label") >= 5).cast("int").alias("label"))
    data = splits.stratified_split(e)
    _, preds = md.embedding_classifier(data)
    return preds.select("row_id", "split", "label", "prediction", *_r6("p"))


@register("score_new_articles")
def q_score_new_articles(spark, sf):
    _, model = _fitted(spark, sf)
    new = clean.add_derived_columns(clean.normalize_text_fields(src.unlabeled_articles(spark, sf)))
    return md.predict(model, new, keep=("row_id",)).select("row_id", "prediction", *_r6("p"))


def _reloaded(spark, sf):
    """The test rows, the fitted model and the model saved and loaded again."""
    s, model = _fitted(spark, sf)
    path = f"{checkpoint_dir(spark).rstrip('/')}/models/{uuid.uuid4().hex}"
    md.save_model(model, path)
    return s.filter(F.col("split") == "test"), model, md.load_model(path)


@register("save_model")
def q_save_model(spark, sf):
    """The test rows by the saved model."""
    test, _, loaded = _reloaded(spark, sf)
    return md.predict(loaded, test).select("row_id", "prediction", *_r6("p"))


@register("mean_pooling")
def q_mean_pooling(spark, sf):
    e = V.embeddings(spark, sf)
    grouped = (e.select(((F.col("vec_id") - F.col("vec_id") % 8) / 8).cast("bigint").alias("group_id"),
                        F.struct("vec_id", F.col("embedding").cast("array<double>").alias("h"),
                                 (F.col("vec_id") % 3 != 0).cast("int").alias("m")).alias("tok"))
               .groupBy("group_id").agg(F.sort_array(F.collect_list("tok")).alias("toks")))
    pooled = grouped.select("group_id", vx.mean_pool(F.col("toks.h"), F.col("toks.m")).alias("v"))
    return pooled.select("group_id", F.posexplode("v").alias("dim", "value")).select(
        "group_id", F.col("dim").cast("bigint").alias("dim"), F.round("value", 6).alias("value"))


@register("batch_encode")
def q_batch_encode(spark, sf):
    """Every article by word vectors learned from all of them, its first 512 tokens pooled."""
    c = V.cleaned(spark, sf)
    vectors = embed.learn_word_vectors(c, "content", dim=64)
    return inf.batch_encode(c, vectors.encoder(), text_col="content", batch_size=256, max_tokens=512).select("row_id", "embedding")


@register("batch_zero_shot")
def q_batch_zero_shot(spark, sf):
    """Up to 50 test articles of each class, as many as the smaller class has, by per-class language models of the
    train split; articles whose id is divisible by 11 fail, to show errors as rows."""
    s, rows, vocab, _ = V.train_terms(spark, sf)
    model = inf.class_language_models(rows.where(F.col("split") == "train"), vocab, {0: "FAKE", 1: "REAL"})
    test = s.filter(F.col("split") == "test").select("row_id", "label", "content")
    least = test.groupBy("label").count().agg(F.min("count")).first()[0] or 0
    sample = splits.stratified_sample(test, per_class=min(50, least))
    broken = F.when(F.col("row_id") % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("content"))
    return inf.batch_zero_shot(sample.withColumn("content", broken), inf.class_generator_factory(model)).select(
        "row_id", "true_label", "answer", "prediction", "correct", F.col("error").isNotNull().alias("failed"))


@register("load_model")
def q_load_model(spark, sf):
    """Round trip: the reloaded pipeline scores exactly like the fitted one."""
    test, model, loaded = _reloaded(spark, sf)
    before = md.predict(model, test).select("row_id", "p")
    after = md.predict(loaded, test).select("row_id", F.col("p").alias("q"))
    return before.join(after, "row_id").agg(F.count("q").alias("test_rows"),
                                            F.max(F.abs(F.col("p") - F.col("q"))).alias("max_difference"))
