"""Cleaning flow: normalise fields, drop duplicate (title, text), derive columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsprism.functions import text as tx

# The text columns of an article.
TEXT_FIELDS = ("title", "text", "subject", "date")


def normalize_text_fields(df: DataFrame, columns: Sequence[str] = TEXT_FIELDS) -> DataFrame:
    """null -> "", cast to string, Unicode strip (``fillna("").astype(str).str.strip()``)."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: tx.clean_field(c) for c in present})


def dedup_articles(df: DataFrame, keys: Sequence[str] = ("title", "text"),
                   order_col: str = "row_id") -> DataFrame:
    """Keep the first row (lowest ``order_col``, which names a row) of every distinct key tuple.

    Only digests of the (possibly very long) keys and row ids are grouped, with
    partial counts and minima, so a key holding a third of all rows collapses before
    the shuffle. The ids of the later copies are then anti joined; unless the planner
    knows beforehand that they are few, that join shuffles the texts once.
    """
    hashes = [f"_h{i}" for i in range(len(keys))]
    keyed = df.select(F.col(order_col).alias("_id"), *[
        F.coalesce(F.sha2(F.col(k).cast("string"), 256), F.lit("")).alias(h) for k, h in zip(keys, hashes)])
    repeated = (keyed.groupBy(*hashes).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
                .where("_n > 1").drop("_n"))
    later = keyed.join(repeated, hashes).where("_id > _first").select(F.col("_id").alias(order_col))
    return df.join(later, order_col, "left_anti").select(*df.columns)


def add_derived_columns(df: DataFrame) -> DataFrame:
    """content = strip(title + " " + text); word counts of title and text."""
    return df.withColumns({
        "content": tx.build_content("title", "text"),
        "title_words": tx.word_count("title"),
        "text_words": tx.word_count("text"),
    })


def clean_articles(df: DataFrame) -> DataFrame:
    """Library order: strip first, then dedup on (title, text), then derive."""
    return add_derived_columns(dedup_articles(normalize_text_fields(df)))
