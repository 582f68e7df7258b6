"""Exploration aggregates: class balance, lengths, crosstabs, markers, style."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsprism.functions import text as tx
from newsprism.functions.reshape import rows_from
from newsprism.sources.articles import LABEL_DOMAIN

SPLITS = ("train", "validation", "test")


def class_subset(df: DataFrame, label: int, column: str = "text") -> DataFrame:
    return df.filter(F.col("label") == label).select("row_id", column)


def class_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("count"))


def class_share(df: DataFrame, percent: bool = False) -> DataFrame:
    """Share of each label; the total comes from a window over the tiny grouped table."""
    scale = 100.0 if percent else 1.0
    counts = class_counts(df)
    total = F.sum("count").over(Window.partitionBy())
    return counts.select("label", "count", F.round(scale * F.col("count") / total, 6).alias("share"))


def counts_reindexed(df: DataFrame, domain: Sequence[int] = LABEL_DOMAIN) -> DataFrame:
    """Label counts forced onto the label domain; a missing label keeps a null count.

    Both sides hold one row per label.
    """
    spark = df.sparkSession
    dom = spark.createDataFrame([(int(v),) for v in domain], "label int")
    return dom.join(class_counts(df), "label", "left")


def split_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


def class_balance_by_split(df: DataFrame, splits: Sequence[str] = SPLITS) -> DataFrame:
    """Label share per split, one column per split (pivot with explicit values)."""
    counts = df.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))
    share = counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("split")), 4))
    return share.groupBy("label").pivot("split", list(splits)).agg(F.first("share"))


def length_summary(df: DataFrame, columns: Sequence[str] = ("title_words", "text_words")) -> DataFrame:
    """mean / median / min / max of word counts per label.

    ``median`` is exact; its buffer holds one counter per distinct value, and
    word counts have few distinct values, so the state stays small at any scale.
    """
    aggs = []
    for c in columns:
        aggs += [F.round(F.avg(c), 6).alias(f"{c}_mean"), F.median(c).alias(f"{c}_median"),
                 F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return df.groupBy("label").agg(*aggs)


def describe_lengths(df: DataFrame, columns: Sequence[str] = ("title_words", "text_words")) -> DataFrame:
    """count, mean, sample std, min, 25/50/75 % (exact, linear), max per column."""
    aggs = []
    for c in columns:
        aggs += [F.count(c).alias(f"{c}__count"), F.avg(c).alias(f"{c}__mean"),
                 F.stddev_samp(c).alias(f"{c}__std"), F.min(c).cast("double").alias(f"{c}__min"),
                 F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"{c}__q"),
                 F.max(c).cast("double").alias(f"{c}__max")]
    wide = df.agg(*aggs)
    rows = [{"feature": F.lit(c),
             "count": F.col(f"{c}__count"),
             "mean": F.round(f"{c}__mean", 6),
             "std": F.round(f"{c}__std", 6),
             "min": F.col(f"{c}__min"),
             "p25": F.round(F.col(f"{c}__q")[0], 6),
             "p50": F.round(F.col(f"{c}__q")[1], 6),
             "p75": F.round(F.col(f"{c}__q")[2], 6),
             "max": F.col(f"{c}__max")} for c in columns]
    return rows_from(wide, rows)


def label_crosstab(df: DataFrame, key: str) -> DataFrame:
    """key x label counts, zero filled; explicit pivot values avoid a pre-scan."""
    pivot = df.groupBy(key).pivot("label", list(LABEL_DOMAIN)).agg(F.count(F.lit(1)))
    renamed = pivot.select(key, *[F.coalesce(F.col(str(v)), F.lit(0)).cast("bigint")
                                  .alias(tx.LABEL_NAMES[v].lower()) for v in LABEL_DOMAIN])
    return renamed


def subject_crosstab(df: DataFrame) -> DataFrame:
    return label_crosstab(df, "subject")


def year_crosstab(dated: DataFrame) -> DataFrame:
    years = dated.select(F.year(tx.parse_date("date")).alias("year"), "label").filter(F.col("year").isNotNull())
    return label_crosstab(years, "year")


def marker_prevalence(df: DataFrame, markers: Sequence[str] = tx.MARKERS,
                      column: str = "content") -> DataFrame:
    """% of each class whose content contains each marker: one scan, then unpivot."""
    aggs = []
    for i, m in enumerate(markers):
        flag = tx.contains_ci(column, m).cast("double")
        for v in LABEL_DOMAIN:
            aggs.append(F.avg(F.when(F.col("label") == v, flag)).alias(f"m{i}_{v}"))
    wide = df.agg(*aggs)
    rows = [{"marker": F.lit(m),
             **{f"{tx.LABEL_NAMES[v].lower()}_pct": F.round(100.0 * F.col(f"m{i}_{v}"), 6) for v in LABEL_DOMAIN}}
            for i, m in enumerate(markers)]
    return rows_from(wide, rows)


def term_prevalence(df: DataFrame, pattern: str = "reuters", column: str = "text") -> DataFrame:
    """Per label: texts matching ``pattern`` (case-insensitive regex; null = no match)."""
    hit = tx.matches_ci(column, pattern).cast("bigint")
    return (df.groupBy("label")
            .agg(F.sum(hit).alias("matches"), F.count(F.lit(1)).alias("rows"))
            .select("label", "matches", F.round(100.0 * F.col("matches") / F.col("rows"), 6).alias("pct")))


def add_style_features(df: DataFrame, column: str = "title") -> DataFrame:
    return df.withColumns({
        "exclamation_count": tx.char_count(column, "!"),
        "question_count": tx.char_count(column, "?"),
        "uppercase_words": tx.uppercase_word_count(column),
        "title_words": tx.word_count(column),
    })


STYLE_FEATURES = ("exclamation_count", "question_count", "uppercase_words", "title_words")


def style_means(df: DataFrame) -> DataFrame:
    styled = add_style_features(df)
    return styled.groupBy("label").agg(*[F.round(F.avg(c), 6).alias(c) for c in STYLE_FEATURES])
