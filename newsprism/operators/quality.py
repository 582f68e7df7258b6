"""Data-quality and leakage checks: nulls, blanks, duplicates, conflicts, dates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsprism.functions import text as tx
from newsprism.functions.reshape import rows_from
from newsprism.sources.articles import CORRUPT, LABEL_DOMAIN

#: Tasks over which one hot text is spread in joins.
SALTS = 16


def _key_digests(keys: Sequence[str]):
    """Hash + null flag per key: groups like pandas (null is a value) on short keys."""
    cols = []
    for i, k in enumerate(keys):
        cols.append(F.sha2(F.coalesce(F.col(k).cast("string"), F.lit("")), 256).alias(f"_h{i}"))
        cols.append(F.col(k).isNull().alias(f"_n{i}"))
    return cols


def source_shape(raw: DataFrame, cleaned: DataFrame, labels: Mapping[str, int]) -> DataFrame:
    """(source, rows, columns) of each labelled source and of the cleaned articles; the sources in one pass over ``raw``."""
    sizes = raw.agg(*[F.count_if(F.col("label") == v).alias(f"_{v}") for v in labels.values()])
    shapes = rows_from(sizes, [{"source": F.lit(name), "rows": F.col(f"_{v}"), "columns": F.lit(len(raw.columns))}
                               for name, v in labels.items()])
    whole = cleaned.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit("cleaned").alias("source"), "rows", F.lit(len(cleaned.columns)).alias("columns"))
    return shapes.unionByName(whole)


def blank_rows(df: DataFrame, column: str = "text", null_is_blank: bool = True) -> DataFrame:
    """Rows whose ``column`` is empty or whitespace-only.

    ``null_is_blank`` follows the fill-then-strip variant; otherwise a null
    compares as not blank.
    """
    value = F.coalesce(F.col(column), F.lit("")) if null_is_blank else F.col(column)
    return df.filter(F.coalesce(tx.strip(value) == F.lit(""), F.lit(False)))


def blank_label_dist(df: DataFrame, column: str = "text") -> DataFrame:
    """Label counts and percentage among blank rows (global aggregate + tiny window)."""
    counts = blank_rows(df, column).groupBy("label").agg(F.count(F.lit(1)).alias("count"))
    # the grouped table holds one row per label, so this window is bounded
    total = F.sum("count").over(Window.partitionBy())
    return counts.select("label", "count", F.round(100.0 * F.col("count") / total, 6).alias("pct"))


def invalid_dates(df: DataFrame, column: str = "date") -> DataFrame:
    """Rows whose date string does not parse in any accepted layout."""
    return df.filter(tx.parse_date(column).isNull())


def same_text_diff_title(df: DataFrame, text_col: str = "text", title_col: str = "title") -> DataFrame:
    """Rows whose text occurs under more than one distinct title.

    A text is offending if its least and greatest title digest differ: partial
    minima and maxima collapse a hot text (blank ones, say) before the shuffle. The
    rows then join the offending digests with a salt, so that a hot text is spread
    over SALTS tasks.
    """
    keyed = df.withColumns({"_th": F.sha2(F.col(text_col), 256),
                            "_salt": F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).cast("int")})
    title = F.sha2(F.col(title_col), 256)
    offenders = (keyed.filter(F.col("_th").isNotNull()).groupBy("_th")
                 .agg(F.min(title).alias("_lo"), F.max(title).alias("_hi")).filter("_lo <> _hi")
                 .select("_th", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")))
    return keyed.join(offenders, ["_th", "_salt"], "left_semi").drop("_th", "_salt")


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Nulls per column plus a 'total' row, all from one scan."""
    columns = list(columns or df.columns)
    agg = df.agg(*[F.sum(F.col(c).isNull().cast("bigint")).alias(c) for c in columns])
    nulls = {c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in columns}
    return rows_from(agg, [{"column": F.lit(c), "nulls": n} for c, n in nulls.items()]
                     + [{"column": F.lit("total"), "nulls": sum(nulls.values(), F.lit(0).cast("bigint"))}])


def duplicate_counts(df: DataFrame, subsets: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(subset, duplicates) for several key subsets from one scan.

    Every row is emitted once per subset with its key digests (padded to the
    widest subset), so one grouping serves all subsets; the partial
    aggregation collapses repeated keys before the shuffle.
    """
    subsets = subsets or {"title": ["title"], "text": ["text"], "title+text": ["title", "text"]}
    width = max(len(k) for k in subsets.values())

    rows = []
    for name, keys in subsets.items():
        r = {"subset": F.lit(name)}
        for i, k in enumerate(keys):
            r[f"_h{i}"] = F.sha2(F.coalesce(F.col(k).cast("string"), F.lit("")), 256)
            r[f"_n{i}"] = F.col(k).isNull()
        for i in range(len(keys), width):
            r[f"_h{i}"], r[f"_n{i}"] = F.lit(""), F.lit(False)
        rows.append(r)
    key_cols = [c for i in range(width) for c in (f"_h{i}", f"_n{i}")]
    groups = rows_from(df, rows).groupBy("subset", *key_cols).count()
    return groups.groupBy("subset").agg((F.sum("count") - F.count(F.lit(1))).cast("bigint").alias("duplicates"))


def quality_report(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Null cells in total, blank texts, duplicate (title, text) rows: (metric, value).

    One scan and one grouping on the (title, text) digests; null and blank
    counts ride along as sums, so the report needs no second pass.
    """
    null_cells = sum(F.col(c).isNull().cast("bigint") for c in df.columns)
    blank = F.coalesce(tx.strip(F.coalesce(F.col(text_col), F.lit(""))) == "", F.lit(False)).cast("bigint")
    keys = ["_h0", "_h1", "_n0", "_n1"]
    groups = (df.select(*_key_digests(["title", "text"]), null_cells.alias("_nulls"), blank.alias("_blank"))
              .groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.sum("_nulls").alias("_nulls"),
                                  F.sum("_blank").alias("_blank")))
    totals = groups.agg(F.coalesce(F.sum("_nulls"), F.lit(0)).cast("bigint").alias("nulls"),
                        F.coalesce(F.sum("_blank"), F.lit(0)).cast("bigint").alias("blank"),
                        (F.coalesce(F.sum("_rows"), F.lit(0)) - F.count(F.lit(1))).cast("bigint").alias("dups"))
    return rows_from(totals, [{"metric": F.lit("missing_values"), "value": F.col("nulls")},
                              {"metric": F.lit("blank_texts"), "value": F.col("blank")},
                              {"metric": F.lit("duplicate_title_text"), "value": F.col("dups")}])


def label_conflicts(df: DataFrame, keys: Sequence[str] = ("title", "text")) -> DataFrame:
    """Number of key groups carrying more than one label (null keys excluded)."""
    keyed = df.filter(F.greatest(*[F.col(k).isNull() for k in keys]) == F.lit(False)) if len(keys) > 1 \
        else df.filter(F.col(keys[0]).isNotNull())
    groups = (keyed.select(*[F.sha2(F.col(k), 256).alias(f"_h{i}") for i, k in enumerate(keys)], "label")
              .groupBy(*[f"_h{i}" for i in range(len(keys))])
              .agg(F.countDistinct("label").alias("_labels")))
    return groups.agg(F.count_if(F.col("_labels") > 1).alias("conflicting_groups"))


def label_domain_check(df: DataFrame, domain: Sequence[int] = LABEL_DOMAIN) -> DataFrame:
    """One row: rows outside the label domain (null labels included) and distinct labels."""
    return df.agg(
        F.count_if(~F.coalesce(F.col("label").isin(*domain), F.lit(False))).alias("invalid_labels"),
        F.countDistinct("label").alias("distinct_labels"),
    )


def quarantine(df: DataFrame, path: str, domain: Sequence[int] = LABEL_DOMAIN, corrupt_col: str = CORRUPT
               ) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Route rows in one pass: (good rows, bad rows with their ``reason``, observed counts of both).

    A row is bad if its line was malformed (``corrupt_col``, where there is one), if its
    title and text are both blank or null, or if it has a label column whose value lies
    outside the domain; the first of these is its reason. Both outputs are written by a
    single job, as two partitions of a table under ``path`` (a folder that all executors
    share), which counts them on the way.
    """
    rules = [("blank", tx.clean_field("title").eqNullSafe("") & tx.clean_field("text").eqNullSafe(""))]
    if corrupt_col in df.columns:
        rules.insert(0, ("malformed", F.col(corrupt_col).isNotNull()))
    if "label" in df.columns:
        rules.append(("label", ~F.coalesce(F.col("label").isin(*domain), F.lit(False))))
    reason = F.coalesce(*[F.when(rule, F.lit(name)) for name, rule in rules])
    routed = df.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())
    seen = Observation()
    routed = routed.observe(seen, F.count_if("accepted").alias("good"), F.count_if(~F.col("accepted")).alias("bad"))
    routed.write.mode("errorifexists").partitionBy("accepted").parquet(path)
    written = df.sparkSession.read.schema(routed.schema).parquet(path)
    return (written.where("accepted").drop("reason", "accepted"), written.where("not accepted").drop("accepted"),
            {name: int(seen.get[name]) for name in ("good", "bad")})


def assert_label_domain(df: DataFrame, domain: Sequence[int] = LABEL_DOMAIN) -> None:
    """Raise when any label lies outside ``domain``; stops at the first offender."""
    if not df.filter(~F.coalesce(F.col("label").isin(*domain), F.lit(False))).isEmpty():
        raise ValueError(f"labels outside {list(domain)}")
