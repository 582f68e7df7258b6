"""Derived views shared by the registered queries (Spark side)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsprism.operators import terms as tm
from newsprism.operators.clean import clean_articles
from newsprism.operators.splits import stratified_split
from newsprism.session import cut_lineage
from newsprism.sources.articles import articles_from_tables, dated_from_orders
from newsprism.sources.tables import read_table


def raw_articles(spark: SparkSession, sf: str) -> DataFrame:
    """Every document; the label is null where there is none."""
    return articles_from_tables(spark, sf)


def labeled_articles(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a label: the input of everything that learns or counts labels."""
    return articles_from_tables(spark, sf).where(F.col("label").isNotNull())


def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned, de-duplicated articles, labelled or not."""
    return clean_articles(raw_articles(spark, sf))


def labeled(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned, de-duplicated labelled articles."""
    return clean_articles(labeled_articles(spark, sf))


def split_articles(spark: SparkSession, sf: str, materialize: bool = False) -> DataFrame:
    """Labelled articles with their split. ``materialize`` writes them once to the
    shared checkpoint folder for queries that run several jobs over them."""
    df = stratified_split(labeled(spark, sf))
    return cut_lineage(df) if materialize else df


def dated(spark: SparkSession, sf: str) -> DataFrame:
    return dated_from_orders(spark, sf)


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Closed-form scores for metric checks: p = n / (n + 1000) for a text of n characters,
    prediction = p >= 0.5; ties occur for equal lengths. Narrow: the text stays
    behind before the split."""
    rows = labeled(spark, sf).select("row_id", "label", F.length("text").alias("_len"))
    p = F.col("_len").cast("double") / (F.col("_len") + 1000)
    return stratified_split(rows).select("row_id", "split", "label", p.alias("p"),
                                         (p >= 0.5).cast("int").alias("prediction"))


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Generator answers chosen by doc_id % 5 from the answer fixtures, with a
    recorded latency and an error for every 7th row (prediction then missing)."""
    a = labeled_articles(spark, sf)
    k = F.col("row_id") % 5
    answer = (F.when(k == 0, "FAKE").when(k == 1, "fake.").when(k == 2, "REAL")
              .when(k == 3, "Real news").otherwise("unknown"))
    failed = (F.col("row_id") % 7) == 0
    return a.select(
        "row_id", F.col("label").alias("true_label"),
        F.when(failed, F.lit("")).otherwise(answer).alias("answer"),
        F.when(failed, F.lit(None).cast("double"))
         .otherwise(F.length("text").cast("double") / F.lit(1000.0)).alias("latency_seconds"),
        F.when(failed, F.lit("generation failed")).otherwise(F.lit(None).cast("string")).alias("error"))


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "embeddings")


def run_history(spark: SparkSession, sf: str) -> DataFrame:
    """Per-epoch validation history derived from ``events``: five epochs per run
    (run_id = event_id div 5, epoch = event_id % 5 + 1), f1 = floor(value) / 500
    (ties on purpose), loss = (event_id * 7 % 11) / 10."""
    e = read_table(spark, sf, "events").select("event_id", "value")
    return e.select(((F.col("event_id") - F.col("event_id") % 5) / 5).cast("bigint").alias("run_id"),
                    (F.col("event_id") % 5 + 1).cast("bigint").alias("epoch"),
                    (F.floor("value").cast("double") / F.lit(500.0)).alias("f1"),
                    ((F.col("event_id") * 7 % 11).cast("double") / F.lit(10.0)).alias("loss"))


def train_terms(spark: SparkSession, sf: str, min_df: int = 2, max_features: int = 20000):
    """Split articles, their term rows (with split and label), the train
    vocabulary and the train rows per label (one bounded collect)."""
    s = split_articles(spark, sf, materialize=True)
    rows = cut_lineage(tm.term_rows(s, "content", ("row_id", "split", "label")))
    train = F.col("split") == "train"
    vocab = tm.vocabulary(rows.where(train).select(F.inline("terms")), min_df, max_features)
    sizes = {r["label"]: r["count"] for r in s.filter(train).groupBy("label").count().collect()}
    return s, rows, vocab, sizes


def train_tfidf(spark: SparkSession, sf: str, min_df: int = 2, max_features: int = 20000) -> DataFrame:
    """Long-form TF-IDF of every row, fitted on train."""
    _, rows, vocab, sizes = train_terms(spark, sf, min_df, max_features)
    weighted = tm.weighted_rows(rows, *tm.collected(vocab, sum(sizes.values())))
    return weighted.select("row_id", "split", "label", F.inline("features"))


def log_odds_coefficients(spark: SparkSession, sf: str):
    """Closed-form linear coefficients over the train vocabulary, so explanation
    operators have a SQL oracle: coef = ln((df1+1)/(n1+2)) - ln((df0+1)/(n0+2))
    with df_k the class-k train documents containing the term; intercept =
    ln(n1/n0). Returns (coefficients, intercept, every row's parts)."""
    _, rows, vocab, sizes = train_terms(spark, sf)
    n0, n1 = float(sizes.get(0, 0)), float(sizes.get(1, 0))
    per = (rows.where(F.col("split") == "train").select("label", F.inline("terms")).groupBy("term")
           .agg(F.count_if(F.col("label") == 0).alias("df0"), F.count_if(F.col("label") == 1).alias("df1"))
           .join(vocab.select("term", "feature_index"), "term"))
    coef = (F.log((F.col("df1") + 1.0) / F.lit(n1 + 2.0)) - F.log((F.col("df0") + 1.0) / F.lit(n0 + 2.0)))
    intercept = math.log(n1 / n0) if n0 > 0 and n1 > 0 else 0.0
    coefs = cut_lineage(per.select("term", "feature_index", coef.alias("coefficient")))
    terms, idf = tm.collected(vocab, sum(sizes.values()))
    slope = {r["term"]: r["coefficient"] for r in coefs.collect()}  # max_features rows at most
    return coefs, intercept, tm.weighted_rows(rows.select("row_id", "terms"), terms, idf, [slope[t] for t in terms])
